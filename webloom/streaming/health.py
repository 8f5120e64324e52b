"""Streaming forms of the host-health folds and of the frontier's dedupe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.health import breaker_step, limiter_step

#: The state store that ``transformWithStateInPandas`` needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in a trigger, in the order of their events: batches of a key arrive in any order."""
    return pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")


class BreakerProcessor(StatefulProcessor):
    """Circuit breaker of each key, by the same step as the batch form; ``events`` counts all triggers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "state string, failures int, successes int, since double, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        *state, n = self.state.get() if self.state.exists() else (None, 0)
        state = tuple(state) if state[0] is not None else None
        pdf = in_order(rows)
        for at, ok in zip(pdf["at"], pdf["ok"]):
            state = breaker_step(state, float(at), bool(ok))
        if state is not None:
            self.state.update((*state, n + len(pdf)))
            yield pd.DataFrame({"key": [key[0]], "state": [state[0]], "failures": [state[1]], "events": [n + len(pdf)]})

    def close(self) -> None:
        pass


class LimiterProcessor(StatefulProcessor):
    """Adaptive delay of each key; events without a latency say nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limiter", "delay double, mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        for ms in in_order(rows)["ms"].dropna():
            state = limiter_step(state, float(ms))
        if state is not None:
            self.state.update(state)
            yield pd.DataFrame({"key": [key[0]], "delay": [state[0]], "mean": [state[1]]})

    def close(self) -> None:
        pass


class ValidityProcessor(StatefulProcessor):
    """Until when a host's robots file counts; the state goes once the watermark has passed that moment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else -math.inf
        pdf = pd.concat(list(rows)).sort_values(["seconds", "kind", "ttl"], kind="stable")
        valid, fetched = [], False
        for at, kind, ttl in zip(pdf["seconds"], pdf["kind"], pdf["ttl"]):
            if kind == 0:
                until, fetched = at + ttl, True
            else:
                valid.append(at < until)
        if fetched:
            self.until.update((until,))
            self.handle.registerTimer(math.ceil(until * 1000))
        asked = pdf[pdf["kind"] == 1]
        yield pd.DataFrame({"host": [key[0]] * len(asked), "seq": asked["seq"].tolist(), "valid": valid})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and math.ceil(self.until.get()[0] * 1000) <= expiredTimerInfo.getExpiryTimeInMs():  # not renewed meanwhile
            self.until.clear()
        yield pd.DataFrame({"host": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "valid": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def validity_stream(requests: DataFrame, fetches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``host, seq, valid`` of a stream of requests (``host, at, seq``), by a stream of fetches (``host, at, transient``).

    As ``operators.robots.valid_at``, for rows that come in order of time from trigger to
    trigger; within one they may come in any.  Rows later than ``delay`` are dropped.
    """
    ttl = F.when(F.coalesce("transient", F.lit(False)), 300.0).otherwise(86400.0)
    asked = requests.select("host", "at", F.lit(1).alias("kind"), F.lit(0.0).alias("ttl"), F.col("seq").cast("long").alias("seq"))
    got = fetches.select("host", "at", F.lit(0).alias("kind"), ttl.alias("ttl"), F.lit(0).cast("long").alias("seq"))
    rows = asked.unionByName(got).withWatermark("at", delay).withColumn("seconds", F.unix_micros("at") / 1e6)
    return rows.groupBy("host").transformWithStateInPandas(ValidityProcessor(), "host string, seq long, valid boolean", "Append", "EventTime")


def breaker_stream(events: DataFrame) -> DataFrame:
    """States of breakers from a stream of ``key, at, seq, ok``."""
    return events.groupBy("key").transformWithStateInPandas(BreakerProcessor(), "key string, state string, failures long, events long", "Update", "None")


def limiter_stream(events: DataFrame) -> DataFrame:
    """Delays from a stream of ``key, at, seq, ms``."""
    return events.groupBy("key").transformWithStateInPandas(LimiterProcessor(), "key string, delay double, mean double", "Update", "None")


def new_urls(urls: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First sight of each url in a stream; the state of a url goes once the watermark has passed it."""
    return urls.withWatermark(at, delay).dropDuplicatesWithinWatermark(["url"])


def error_rates(events: DataFrame, window: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """Errors and outcomes of each key in tumbling windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "key").agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("int")).alias("errors"))

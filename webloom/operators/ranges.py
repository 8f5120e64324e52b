"""The circuit breaker's fold over ranges of events: each range is summed up for every state it may begin in.

A key's events lie in as many ranges as they need, wherever Spark cuts them, so a key with
nearly all events is folded by all cores.  A closed breaker is told by its failures, a
half-open one by its one success; an open one only by the first event that comes late enough
to probe, which is among the events of the range's first WAIT_S seconds and the one after.  A range's
summary names the state at its end for each of these; one row a range then meets by key.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .health import CLOSED, FAILURES, HALF_OPEN, OPEN, SUCCESSES, WAIT_S

assert SUCCESSES == 2  # a half-open breaker that waits has one success

State = tuple[str, int, float]  # name, failures, since when (of open and half-open ones)


def _late(at: np.ndarray, since: float) -> int:
    """The first event more than WAIT_S after ``since``."""
    return bisect_left(range(len(at)), True, key=lambda j: at[j] - since > WAIT_S)


class Range:
    """States at the end of a range of events (times ascending, outcomes), by the event from which a state holds."""

    def __init__(self, at: np.ndarray, ok: np.ndarray):
        self.at, self.ok, n = at, ok, len(at)
        run = np.zeros(n + 1, np.int64)  # failures in a row from each event
        late = np.empty(n, np.int64)
        j = n
        for i in range(n - 1, -1, -1):
            run[i] = 0 if ok[i] else run[i + 1] + 1
            while j > i + 1 and at[j - 1] - at[i] > WAIT_S:
                j -= 1
            late[i] = j
        self.run, self.late = run, late
        self.closed: list[State] = [(CLOSED, 0, 0.0)] * (n + 2)  # closed without failures before event i
        self.opened: list[State | None] = [None] * n  # opened at event i; None: still open since then
        self.half: list[State] = [(HALF_OPEN, 0, 0.0)] * n  # probed with success at event i
        for i in range(n - 1, -1, -1):
            j = int(late[i])
            self.opened[i] = None if j == n else self.half[j] if ok[j] else self._open(j, 1)
            if i + 1 == n:
                self.half[i] = (HALF_OPEN, 0, float(at[i]))
            elif at[i + 1] - at[i] > WAIT_S:
                self.half[i] = self._open(i + 1, 0)
            else:
                self.half[i] = self.closed[i + 2] if ok[i + 1] else self._open(i + 1, 1)
            self.closed[i] = self.from_closed(i, 0)

    def _open(self, i: int, failures: int) -> State:
        return self.opened[i] or (OPEN, failures, float(self.at[i]))

    def from_closed(self, i: int, failures: int) -> State:
        """Closed with some failures before event i."""
        fails = int(self.run[i])
        if failures + fails >= FAILURES:
            return self._open(i + FAILURES - failures - 1, FAILURES)
        if i + fails >= len(self.at):
            return (CLOSED, failures + fails, 0.0)
        return self.closed[i + fails + 1]

    def summary(self) -> dict:
        """``closed`` by failures, ``half`` (waited too long, or not), and ``open``: [time, state] of the events that may probe, the last of each run with one end."""
        late = _late(self.at, float(self.at[0]))  # whenever it was opened, this one is late enough
        pieces: list[list] = []
        for j in range(min(late + 1, len(self.at))):
            state = self.half[j] if self.ok[j] else self._open(j, 1)
            if pieces and pieces[-1][1] == state:
                pieces[-1][0] = float(self.at[j])
            else:
                pieces.append([float(self.at[j]), state])
        half = [self._open(0, 0), self.closed[1] if self.ok[0] else self._open(0, 1)]
        return {"n": len(self.at), "first": float(self.at[0]), "closed": [self.from_closed(0, b) for b in range(FAILURES)], "half": half, "open": pieces}


def applied(state: State, s: dict) -> State:
    """The state after a range that began in ``state``."""
    name, failures, since = state
    if name == CLOSED:
        return tuple(s["closed"][failures])
    if name == HALF_OPEN:
        return tuple(s["half"][0 if s["first"] - since > WAIT_S else 1])
    return next((tuple(to) for t, to in s["open"] if t - since > WAIT_S), state)


def breaker_states(events: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", ok: Column | str = "ok") -> DataFrame:
    """``key, state, failures, events``: as ``health.breaker_states``, whatever part of the events one key has."""
    us = F.unix_micros(F.col(at).cast("timestamp")).cast("double") / 1e6
    rows = events.select(F.col(key).alias("key"), us.alias("at"), F.col(order).alias("seq"), (F.col(ok) if isinstance(ok, str) else ok).alias("ok")).where("key is not null")
    rows = rows.repartitionByRange("key", "at", "seq").sortWithinPartitions("key", "at", "seq")
    kind = events.schema[key].dataType.simpleString()

    def told(key_, parts):
        joined = pd.concat(parts)
        t = joined["at"].to_numpy()
        return (key_, json.dumps(Range(t, joined["ok"].fillna(False).to_numpy(bool)).summary()))

    def run(batches):
        last, parts = None, []
        for b in batches:
            out = []
            for k, part in b.groupby("key", sort=False):
                if parts and k != last:
                    out.append(told(last, parts))
                    parts = []
                last = k
                parts.append(part[["at", "ok"]])
            yield pd.DataFrame(out, columns=["key", "summary"])
        if parts:
            yield pd.DataFrame([told(last, parts)], columns=["key", "summary"])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, n = (CLOSED, 0, 0.0), 0
        for text in pdf.sort_values("place")["summary"]:
            s = json.loads(text)
            state, n = applied(state, s), n + s["n"]
        return pd.DataFrame([(pdf["key"].iloc[0], state[0], state[1], n)], columns=[key, "state", "failures", "events"])

    summaries = rows.mapInPandas(run, f"key {kind}, summary string").withColumn("place", F.spark_partition_id())
    return summaries.groupBy("key").applyInPandas(compose, f"{key} {kind}, state string, failures long, events long")

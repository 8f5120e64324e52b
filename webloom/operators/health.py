"""Host health: error kinds, backoff, limiter, breaker, cron. One pure step serves batch and stream."""

from __future__ import annotations

import calendar
import datetime
from bisect import bisect
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.urls import any_of, let


def error_kind(message: Column) -> Column:
    out = F
    for kind, words in T.ERROR_WORDS:
        out = out.when(any_of([message.contains(w) for w in words]), kind)
    return out.otherwise("unknown")


def is_retryable_kind(kind: Column) -> Column:
    return kind.isin(*T.RETRYABLE_KINDS)


def is_retryable_status(status: Column) -> Column:
    return status.isin(408, 429) | (status >= 500)


def backoff_ms(attempt: Column, first: int = 1000, factor: int = 2, most: int = 30_000, jitter: float = 0.0, seed: int | None = None) -> Column:
    """Exponential wait before an attempt, with an optional part of random spread."""
    base = F.least(F.lit(float(most)), F.pow(F.lit(float(factor)), attempt) * first)
    return base if not jitter else base * (1 + jitter * (F.rand(seed) * 2 - 1))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, as a number or a date; 0 if it says neither."""
    at = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$| UTC$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(header.try_cast("double"), (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double"), F.lit(0.0))


def bucket_starts(events: DataFrame, key: str, at: str, order: str, delay: float) -> DataFrame:
    """Start of each request behind a bucket of one token: max(own time, previous start + delay), in closed form."""
    w = W.partitionBy(key).orderBy(at, order)
    n = F.row_number().over(w).cast("bigint")
    numbered = events.withColumn("_n", n)
    lead = F.max(F.col(at) - F.col("_n") * delay).over(w.rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn("start", lead + F.col("_n") * delay).drop("_n")


# -- adaptive limiter -------------------------------------------------------------------


def limiter_step(state: tuple[float, float] | None, latency: float, least: float = 100.0, most: float = 30_000.0, first: float = 1000.0) -> tuple[float, float]:
    """(delay, average latency) in ms after one more latency; the first one is only stored."""
    if state is None:
        return first, latency
    delay, mean = state
    mean = 0.7 * mean + 0.3 * latency
    if mean > 3 * delay:
        delay = min(2 * delay, most)
    elif mean < delay / 3:
        delay = max(delay / 2, least)
    return delay, mean


# -- circuit breaker --------------------------------------------------------------------

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
# Failures that open, successes that close, seconds that an open breaker or a probe waits.
FAILURES, SUCCESSES, WAIT_S = 5, 2, 60.0


def breaker_step(state: tuple[str, int, int, float] | None, at: float, ok: bool) -> tuple[str, int, int, float]:
    """(state, failures, successes, time of the last failure or probe) after one more outcome.

    An open breaker lets a probe pass after more than WAIT_S; a half-open one whose probe
    has not settled within WAIT_S opens again, and the request at hand isn't made.
    """
    name, bad, good, since = state or (CLOSED, 0, 0, at)
    if name == OPEN:
        if not at - since > WAIT_S:
            return name, bad, good, since
        name, bad, good, since = HALF_OPEN, 0, 0, at
    elif name == HALF_OPEN and at - since > WAIT_S:
        return OPEN, bad, good, at
    if name == HALF_OPEN:
        if not ok:
            return OPEN, bad + 1, 0, at
        good += 1
        return (CLOSED, 0, 0, at) if good >= SUCCESSES else (HALF_OPEN, bad, good, since)
    if ok:
        return CLOSED, 0, 0, since
    bad += 1
    return (OPEN, bad, 0, at) if bad >= FAILURES else (CLOSED, bad, 0, at)


def fold(step, rows: Iterable[tuple], state=None):
    """The states after each row."""
    for row in rows:
        state = step(state, *row)
        yield state


def folded(events: DataFrame, key: str, at: str, order: str, value: Column, step, result, schema: str) -> DataFrame:
    """``key`` and ``schema``: what ``result(key, state, events)`` makes of each key's state after its last event.

    Events come to a task by key and time, sorted by Spark (which spills), and pass through
    one at a time: a key with very many events takes time, not memory.
    """
    us = F.unix_micros(F.col(at).cast("timestamp")).cast("double") / 1e6
    rows = events.select(F.col(key).alias("key"), us.alias("at"), F.col(order).alias("seq"), value.alias("value")).where("key is not null")
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "seq")
    full = f"{key} {events.schema[key].dataType.simpleString()}, {schema}"

    def run(batches):
        last, state, n = None, None, 0
        for b in batches:
            out = []
            for k, t, v in zip(b["key"], b["at"], b["value"]):
                if n and k != last:
                    out.append((last, *result(state, n)))
                    state, n = None, 0
                last, state, n = k, step(state, t, v), n + 1
            yield pd.DataFrame(out, columns=names)
        if n:
            yield pd.DataFrame([(last, *result(state, n))], columns=names)

    names = [key, *(x.split()[0] for x in schema.split(", "))]
    return rows.mapInPandas(run, full)


def breaker_states(events: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", ok: str = "ok") -> DataFrame:
    """Breaker state of each key after its last event."""
    return folded(events, key, at, order, F.col(ok), breaker_step, lambda s, n: (s[0], s[1], n), "state string, failures long, events long")


def limiter_delays(events: DataFrame, key: str = "user_id", at: str = "ts", order: str = "event_id", latency: str = "value") -> DataFrame:
    """Delay and mean latency of each key after its last latency; events without one say nothing."""
    events = events.where(F.col(latency).isNotNull())
    step = lambda state, _, ms: limiter_step(state, float(ms))
    return folded(events, key, at, order, F.col(latency).cast("double"), step, lambda s, n: (round(s[0], 6), round(s[1], 6)), "delay double, mean double")


def outcomes(events: DataFrame, key: str, order: str, ok: Column, attempts: int = 3) -> DataFrame:
    """``attempts`` (of the first success, null if there is none) and ``ok`` of each key's retry loop; ranks are cut before the shuffle."""
    k = F.row_number().over(W.partitionBy(key).orderBy(order))
    a = events.select(key, ok.alias("_ok"), k.alias("_k")).where(F.col("_k") <= attempts)
    return a.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.col("_k"))).alias("attempts"), F.bool_or("_ok").alias("ok"))


def idle(events: DataFrame, key: str, at: str, minutes: int = 10) -> DataFrame:
    """Keys whose last event is older than ``minutes`` before the last of all; one pass finds both."""
    last = events.groupBy(key).agg(F.max(at).alias("last"))
    now = last.agg(F.max("last").alias("now"))
    return last.join(F.broadcast(now), F.col("last") < F.col("now") - F.make_dt_interval(mins=F.lit(minutes))).select(key)  # one row


def first_of_host(pages: DataFrame, url: str = "url", seq: str = "page_id") -> DataFrame:
    """``host`` and the first page of each: what is fetched once a host."""
    from ..functions import urls as U

    return pages.groupBy(U.host(F.col(url)).alias("host")).agg(F.min(seq).alias(seq))


# -- cron -------------------------------------------------------------------------------


def _field(pattern: str, value, least: int):
    """Whether a column, or a plain number, fits the field."""
    if pattern == "*":
        return True
    tests = []
    for p in (x.strip() for x in pattern.split(",")):
        if p.isdigit():
            tests.append(value == int(p))
        elif "-" in p:
            lo, hi = (int(x) for x in p.split("-")[:2])
            tests.append((value >= lo) & (value <= hi))
        elif p.startswith("*/") and int(p[2:]) > 0:
            tests.append((value - least) % int(p[2:]) == 0)
    return reduce(or_, tests) if tests else False


def _day_fits(fields: list[str], day, month, weekday):
    """Of two restricted day fields one is enough."""
    d, w = _field(fields[2], day, 1), _field(fields[4], weekday, 0)
    return _field(fields[3], month, 1) & (d & w if "*" in (fields[2], fields[4]) else d | w)


def cron_matches(fields: list[str], at: Column) -> Column:
    """Minute, hour, day, month, weekday (Sunday 0); of two restricted day fields one is enough."""
    clock = _field(fields[0], F.minute(at), 0) & _field(fields[1], F.hour(at), 0)
    return F.lit(True) & clock & _day_fits(fields, F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1)


def _cron_clock(fields: list[str]) -> list[int]:
    """For each minute of a day the next one that fits, 1440 and more in the day after; empty if none does."""
    fit = [m for m in range(1440) if _field(fields[0], m % 60, 0) & _field(fields[1], m // 60, 0)]
    return [(*fit, 1440 + fit[0])[bisect(fit, m)] for m in range(1440)] if fit else []


def _cron_days(fields: list[str]) -> tuple[list[int | None], list[int]]:
    """Days until one fits. By kind of year (twice the weekday of its first day, and 1 in a leap year) and day of it: within that year,
    or null. By year modulo 400, after which the calendar comes again: from its first day on; empty if no day ever fits."""
    within = []
    for kind in range(14):
        lengths = [31, 28 + kind % 2, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
        days = [(d, m, (kind // 2 + i) % 7) for i, (m, d) in enumerate((m, d) for m, n in enumerate(lengths, 1) for d in range(1, n + 1))]
        left, table = None, [None] * 366
        for i in reversed(range(len(days))):
            table[i] = left = 0 if _day_fits(fields, *days[i]) else left if left is None else left + 1
        within += table
    kinds = [2 * (datetime.date(y, 1, 1).isoweekday() % 7) + calendar.isleap(y) for y in range(2000, 2400)]
    if all(within[366 * k] is None for k in kinds):
        return within, []
    left, years = 0, [0] * 800
    for y in reversed(range(800)):  # twice the cycle: what the last years lack is found in the first ones
        k = kinds[y % 400]
        years[y] = left = left + 365 + k % 2 if within[366 * k] is None else within[366 * k]
    return within, years[:400]


def _table(numbers: list[int | None], at: Column) -> Column:
    """The number at a place of a list, which is one literal of the plan."""
    return F.get(F.split(F.lit(",".join("" if x is None else str(x) for x in numbers)), ",").try_cast("array<int>"), at)


def cron_next(rows: DataFrame, fields: list[str], at: str = "ts", minutes: int = 525_600) -> DataFrame:
    """Adds ``next``: the first matching minute after ``at``, a day later if there is none within ``minutes``.

    Clock and calendar are tables made of the fields alone, so a row takes three lookups, however far its next minute is.
    """
    t, none = F.col(at), F.col(at) + F.expr("interval 24 hours")
    clock, (within, years) = _cron_clock(fields), _cron_days(fields)
    if not clock or not years:
        return rows.withColumn("next", none)
    now = F.hour(t) * 60 + F.minute(t)

    def over(soon):
        return F.when(soon < 1440, 0).otherwise(1)

    def until(day):
        year, nth = F.year(day), F.dayofyear(day)
        leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) - 365
        kind = F.pmod(F.dayofweek(day) - nth, F.lit(7)) * 2 + leap
        return F.coalesce(_table(within, kind * 366 + nth - 1), 366 + leap - nth + _table(years, F.pmod(year + 1, F.lit(400))))

    def found(soon, day, ahead):
        minute = F.when(ahead == 0, soon % 1440).otherwise(clock[-1] - 1440)
        at = F.timestamp_add("MINUTE", minute, F.date_add(day, ahead).cast("timestamp_ntz"))
        return F.when((over(soon) + ahead) * 1440 + minute - now <= minutes, at)

    x = let(_table(clock, now), lambda soon: let(F.date_add(F.to_date(t), over(soon)), lambda day: let(until(day), lambda ahead: found(soon, day, ahead))))
    # only in an hour that clocks repeat is the first such time past; then it is the second one
    x = let(x, lambda at: F.when(at <= t, t + (at - t.cast("timestamp_ntz"))).otherwise(at))
    return rows.withColumn("next", F.coalesce(x, none))

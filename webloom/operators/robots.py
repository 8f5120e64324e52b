"""Robots rules: parsing, matching, longest match, validity."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rule_regex(rule: Column) -> Column:
    """Anchored expression of a rule: ``*`` is any text, all else (``$`` too) is literal."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(rule, r"([\\^$.|?+()\[\]{}])", r"\\$1"), r"\*", ".*"))


def matches(rule: Column, path: Column) -> Column:
    return F.when(rule.contains("*"), F.regexp_like(path, rule_regex(rule))).otherwise(F.startswith(path, rule))


def evaluate(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed`` to ``paths`` (``host, path``): the longest matching rule of the host decides, ties and none allow.

    ``rules``: ``host, rule, allow``.  A rule is found by its head, what stands before its
    first ``*``: a path is cut at the lengths that its host's heads have, and host and head are
    joined as equals, so a host's other rules are never looked at.  Rules are joined once per
    distinct path, so that repeated paths cost nothing.
    """
    one = paths.select("host", "path").where("host is not null and path is not null").distinct()
    heads = rules.where(F.coalesce("rule", F.lit("")) != "").select("host", "rule", "allow", F.substring_index("rule", "*", 1).alias("head"))
    lengths = heads.groupBy("host").agg(F.collect_set(F.length("head")).alias("lengths"))  # a number for each length
    cuts = one.join(lengths, "host").select("host", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    cuts = cuts.select("host", "path", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("head"))
    hit = cuts.join(heads, ["host", "head"]).where(matches(F.col("rule"), F.col("path")))
    best = hit.groupBy("host", "path").agg(
        F.coalesce(F.max(F.when(F.col("allow"), F.octet_length("rule"))), F.lit(-1)).alias("a"),
        F.coalesce(F.max(F.when(~F.col("allow"), F.octet_length("rule"))), F.lit(-1)).alias("b"),
    )
    return paths.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce(F.col("a") >= F.col("b"), F.lit(True))).drop("a", "b")


def parse(text: str, agent: str) -> dict:
    """Rules of one robots.txt for an agent: ``allow``, ``disallow``, ``delay`` (seconds) and ``sitemaps``.

    The first group that names the agent wins and ends the search; rules of ``*`` groups
    before it stay.  Comments are whole lines; empty values say nothing; site maps are global.
    """
    out = {"allow": [], "disallow": [], "delay": 0.0, "sitemaps": []}
    on = named = False
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or ":" not in line:
            continue
        field, value = (x.strip() for x in line.split(":", 1))
        field = field.lower()
        if field == "user-agent":
            own = value != "*" and value.lower() in agent.lower() and value != ""
            on = (own or value == "*") and not named
            named = named or own
        elif field == "sitemap" and value:
            out["sitemaps"].append(value)
        elif on and value and field in ("allow", "disallow"):
            out[field].append(value)
        elif on and field == "crawl-delay" and re.fullmatch(r"[0-9]*\.?[0-9]+", value):
            out["delay"] = float(value)
    return out


def by_status(status: int, text: str, agent: str) -> dict:
    """As ``parse``, by the response's status: server errors disallow everything, other failures allow everything."""
    if status == 200:
        return parse(text.encode()[: 500 << 10].decode("utf-8", "ignore"), agent) | {"transient": False}
    return {"allow": [], "disallow": ["/"] if status >= 500 else [], "delay": 0.0, "sitemaps": [], "transient": status >= 500}


_PARSED = "host string, allow array<string>, disallow array<string>, delay double, sitemaps array<string>, transient boolean"


def parsed(files: DataFrame, agent: str) -> DataFrame:
    """``host, allow, disallow, delay, sitemaps, transient`` of fetched files (``host, status, body``), one row a file."""

    def run(batches):
        for b in batches:
            rows = [(host, *(got[c] for c in ("allow", "disallow", "delay", "sitemaps", "transient"))) for host, status, body in zip(b["host"], b["status"], b["body"]) for got in [by_status(int(status or 0), body or "", agent)]]
            yield pd.DataFrame(rows, columns=["host", "allow", "disallow", "delay", "sitemaps", "transient"])

    return files.select("host", "status", "body").mapInPandas(run, _PARSED)


def rules(entries: DataFrame) -> DataFrame:
    """``host, rule, allow`` of parsed files, one row a rule."""
    one = lambda c, v: entries.select("host", F.explode(c).alias("rule"), F.lit(v).alias("allow"))
    return one("allow", True).unionByName(one("disallow", False))


def effective_delay(entries: DataFrame, key: str, delay: Column, default: float) -> DataFrame:
    """``key, delay``: the greatest delay that a host's entries ask for, or the default where none does."""
    return entries.groupBy(key).agg(F.coalesce(F.nullif(F.max(delay), F.lit(0.0)), F.lit(default)).alias("delay"))


# How long a fetched file counts, and one that a server error stands for.
VALID, VALID_TRANSIENT = "interval 24 hours", "interval 5 minutes"


def validity(rows: DataFrame, key: str, at: str, order: str, is_fetch: Column, transient: Column) -> DataFrame:
    """Adds ``valid`` to every row: whether the key's last fetch up to it still counts (false without any); one sort, no join."""
    until = F.col(at) + F.when(transient, F.expr(VALID_TRANSIENT)).otherwise(F.expr(VALID))
    w = W.partitionBy(key).orderBy(at, order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(is_fetch, until), ignorenulls=True).over(w)
    return rows.withColumn("valid", F.coalesce(F.col(at) < last, F.lit(False)))


def valid_at(requests: DataFrame, fetches: DataFrame, key: str = "host", at: str = "at") -> DataFrame:
    """Adds ``valid`` to requests (``key, at``): whether the last of the key's fetches (``key, at, transient``) up to then still counts.

    An as-of join of two tables: both go through one sort, a fetch before the requests of its
    moment; repeated requests are each answered.
    """
    cols = [F.col(c) for c in requests.columns]
    asked = requests.select(F.struct(*cols).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(False).alias("_transient"))
    got = fetches.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.coalesce("transient", F.lit(False)).alias("_transient"))
    # of fetches at one moment the one that counts longer is last
    every = got.unionByName(asked).withColumn("_order", F.col("_kind") * 2 + F.when(F.col("_transient"), 0).otherwise(1))
    out = validity(every, "_key", "_at", "_order", F.col("_kind") == 0, F.col("_transient"))
    return out.where("_kind = 1").select("_row.*", "valid")


def unexpired(entries: DataFrame, fetched: str, now: Column) -> DataFrame:
    """Cached files that were fetched no longer than the validity ago; the others are dropped."""
    return entries.where(F.col(fetched) + F.expr(VALID) >= now)

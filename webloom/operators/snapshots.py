"""Versioned snapshots of pages and what changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def captured(rows: DataFrame, key: str, version: str, body: str, keep: int = 10) -> DataFrame:
    """The newest ``keep`` versions of each key, without those equal to the one before; adds ``hash`` and ``rank`` (1: newest)."""
    hashed = rows.withColumn("hash", F.sha2(F.coalesce(F.col(body), F.lit("")), 256)).drop(body)
    w = W.partitionBy(key).orderBy(version)
    fresh = hashed.withColumn("_before", F.lag("hash").over(w)).where("_before is null or _before <> hash").drop("_before")
    return fresh.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where(F.col("rank") <= keep)


def changes(rows: DataFrame, key: str, version: str, body: str) -> DataFrame:
    """``key, version, changed``: whether each version differs from the one before (the first does not)."""
    hashed = rows.select(key, version, F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("_h"))
    before = F.lag("_h").over(W.partitionBy(key).orderBy(version))
    return hashed.select(key, version, F.coalesce(F.col("_h") != before, F.lit(False)).alias("changed"))


def changed_keys(rows: DataFrame, key: str, body: str) -> DataFrame:
    """``key, n_versions`` of the keys with more than one distinct body; digests alone are shuffled."""
    n = rows.select(key, F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("_h")).groupBy(key).agg(F.countDistinct("_h").alias("n_versions"))
    return n.where("n_versions > 1")


def step_diffs(elements: DataFrame, key: str, version: str, selector: str = "selector", digest: str = "text_hash", ignore: list[str] = ()) -> DataFrame:
    """``structural_diff`` of every version of every key against the version before it.

    An element takes part twice, as new in its own version and as old in the next one; both
    are told apart in one aggregation that combines before its shuffle, without a join of
    elements with elements.
    """
    w = W.partitionBy(key).orderBy(version)
    turns = elements.select(key, version).distinct().select(key, version, F.lead(version).over(w).alias("_next"), F.lag(version).over(w).isNull().alias("_first"))
    sides = F.array(F.struct(F.col(version).alias("v"), (~F.col("_first")).alias("on"), F.lit(True).alias("new")), F.struct(F.col("_next").alias("v"), F.col("_next").isNotNull().alias("on"), F.lit(False).alias("new")))
    both = elements.join(turns, [key, version]).select(key, selector, digest, "pos", F.explode(F.filter(sides, lambda s: s["on"])).alias("s"))
    for part in ignore:
        both = both.where(~F.col(selector).contains(part))
    last = lambda new: F.max_by(digest, F.when(F.col("s.new") == new, F.col("pos")))
    found = both.groupBy(key, F.col("s.v").alias(version), selector).agg(last(False).alias("was"), last(True).alias("now"), F.bool_or(~F.col("s.new")).alias("_o"), F.bool_or("s.new").alias("_n"))
    change = F.when(~F.col("_o"), "added").when(~F.col("_n"), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return found.select(key, version, selector, change.alias("change")).where("change is not null")


def structural_diff(old: DataFrame, new: DataFrame, key: str | list[str], selector: str = "selector", digest: str = "text_hash", ignore: list[str] = ()) -> DataFrame:
    """``key, selector, change`` (added, removed, modified) between two versions; of repeated selectors the last (by ``pos``) counts.

    Selectors that hold an ignored part are left out.
    """
    key = [key] if isinstance(key, str) else list(key)
    last = lambda df, name: df.groupBy(*key, selector).agg(F.max_by(digest, "pos").alias(name))
    both = last(old, "was").withColumn("_o", F.lit(True)).join(last(new, "now").withColumn("_n", F.lit(True)), [*key, selector], "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    out = both.select(*key, selector, change.alias("change")).where("change is not null")
    for part in ignore:
        out = out.where(~F.col(selector).contains(part))
    return out

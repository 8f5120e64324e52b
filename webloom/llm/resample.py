"""Target-distribution importance resampling over hashed n-grams, in DataFrame functions throughout.

Each text's words and word runs are exploded once to count buckets and once to meet the
gain table: a bucket's gain says how much likelier it is in the target than in the corpus.
Documents are drawn without replacement by the Gumbel trick: a document's mean gain plus
noise from a hash of its id is sorted over all machines, and the first ones are drawn.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import drop, table, written

#: What stands between words: ASCII but for letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets of features, longest run of words, least words of a document that may be drawn, percent of them that are.
BUCKETS, RUNS, LEAST, PERCENT, SEED = 10_000, 2, 20, 25, 7


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case (null: none)."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATOR), "")


def features(w: str, runs: int = RUNS) -> Column:
    """All runs of 1 to ``runs`` consecutive words of an array column, joined by one space, with repeats."""
    grams = [F.col(w)]
    for k in range(2, runs + 1):
        before = F.slice(grams[-1], F.lit(1), F.greatest(F.size(grams[-1]) - 1, F.lit(0)))
        grams.append(F.zip_with(before, F.slice(F.col(w), F.lit(k), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(*grams)


def _buckets(rows: DataFrame, buckets: int, runs: int, *kept: str) -> DataFrame:
    """``kept`` columns and ``bucket`` of each feature of each row (one null bucket where there is none)."""
    return rows.select(*kept, F.explode_outer(features("w", runs)).alias("f")).select(*kept, (F.crc32(F.col("f").cast("binary")) % buckets).cast("int").alias("bucket"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """``bucket, n`` of all features of all texts."""
    found = _buckets(texts.select(words(F.col("text")).alias("w")), buckets, runs)
    return found.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain``: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket, from two tables of counts."""
    s_all, t_all = (x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (corpus, target))
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for x, name in ((corpus, "s"), (target, "t")):
        both = both.join(x.withColumnRenamed("n", name), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") + 1.0 for c in ("s", "t"))
    return both.select("bucket", F.floor(1000.0 * F.log(t * float(s_all + buckets) / (s * float(t_all + buckets)))).alias("gain"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each document; ``rank`` (1, 2, ...) where it is drawn.

    Of the documents with ``least`` words, ``percent`` of a hundred (rounded down) are drawn:
    those of the highest score, ties to the smaller id (a null id first, repeated rows in any
    order among each other).  A null text has no words and weight 0; a null id is hashed as
    an empty one.  Bucket counts are of all documents.  Empty tables are corpora without
    features; other columns aren't read.  Ranks come from one distributed sort: rows are
    numbered in their own part, and a part starts where the ones before it end; only the parts'
    counts reach the driver.
    """
    spark = docs.sparkSession
    s, t = (written(bucket_counts(x, buckets, runs), "counts") for x in (docs, target))
    gain = F.broadcast(gains(s, t, buckets))  # a row for each bucket
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("at"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    summed = _buckets(rows, buckets, runs, "at", "doc_id", "n_words").join(gain, "bucket", "left").groupBy("at").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total")
    )
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.expr("if(n_features = 0, 0, (total - pmod(total, n_features)) div n_features)")
    scored = summed.select("doc_id", "n_features", weight.alias("weight"), (F.col("n_words") >= least).alias("able"), "at").withColumn("score", F.col("weight") + noise)
    ordered = scored.orderBy(F.desc("able"), F.desc("score"), F.asc_nulls_first("doc_id"), "at").withColumn("m", F.monotonically_increasing_id())
    ordered = written(ordered.drop("at"), "ordered")
    part, nth = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("able").cast("long")).alias("able")).orderBy("p").collect()  # a row for each part
    draw, offset, at = sum(c["able"] for c in counts) * percent // 100, {}, 0
    for c in counts:
        offset[c["p"]], at = at, at + c["n"]
    starts = F.broadcast(spark.createDataFrame(sorted(offset.items()), "p int, start long"))
    ranked = ordered.withColumn("p", part.cast("int")).join(starts, "p", "left").withColumn("rank", F.col("start") + nth + 1)
    out = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= draw), F.col("rank")).alias("rank"))
    drop(spark, s, t)
    return out


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP13_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
texts AS MATERIALIZED (
  SELECT row_number() OVER () AS place, doc_id, {_WORDS} AS w FROM documents
  UNION ALL SELECT NULL, NULL, {_WORDS} FROM benchmark),
runs AS MATERIALIZED (
  SELECT place, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(hex(encode(f))) // 2), lambda i: ('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM runs), crc),
counts AS MATERIALIZED (SELECT bucket, count(*) FILTER (place IS NOT NULL) AS s, count(*) FILTER (place IS NULL) AS t FROM runs JOIN hashed USING (f) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counts),
gain AS MATERIALIZED (
  SELECT bucket, floor(1000.0::DOUBLE * ln((c.t + 1)::DOUBLE * (total.s + 10000) / ((c.s + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain FROM counts c, total),
sums AS (SELECT place, count(*) AS n, sum(gain)::BIGINT AS g FROM runs JOIN hashed USING (f) JOIN gain USING (bucket) WHERE place IS NOT NULL GROUP BY place),
scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n, 0) AS n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN sums USING (place) WHERE place IS NOT NULL),
noisy AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (able) OVER () AS many FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * many // 100 THEN r END AS rank FROM ranked
"""

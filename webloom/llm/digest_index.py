"""Exact dedup against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest.  New documents are
digested once, reduced to one row a digest, and sort-merge anti-joined with the index: as
the index is bucketed by the join key, only the new digests are shuffled.  What the index
does not know is appended to it.  Texts themselves never move.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, fresh_path, table, written

#: A digest is frequent beyond this part of all rows, so that at most so many digests are, and their table fits a broadcast.
FREQUENT = 4096
#: Increments in which the query's table meets its index.
STEPS = 2


class DigestIndex:
    """Digests of documents in a folder that all machines share; it outlives the session.

    ``buckets`` counts for a new index (default: the session's shuffle partitions); an index
    that exists keeps its own number.  Columns: ``digest`` (binary), ``keep_id`` (id of the
    document that stays), ``at`` (its row in the batch), ``batch``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(n).alias("buckets")).coalesce(1).write.json(f"{self.path}/buckets")
        self.buckets = spark.read.schema("buckets int").json(f"{self.path}/buckets").first()[0]
        self.name = f"webloom_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        where = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, at BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}/digests'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (one for each ``digest``) that the index doesn't know."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the unseen of ``groups`` (``digest, keep_id, at``).

        A batch is committed as a whole or not at all; given again, it adds nothing.
        """
        new = self.unseen(groups).select("digest", "keep_id", "at", F.lit(batch).alias("batch"))
        if self.read().isEmpty():  # an empty side is optimised away, and its partitioning with it
            new = new.repartition(self.buckets, "digest")
        new.write.insertInto(self.name)

    def forget(self) -> None:
        """Delete the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.spark, self.path)


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each digest: the greatest id (nulls last) and the row that has it."""
    first = F.coalesce("doc_id", F.lit(-(1 << 63)))
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("at", first).alias("at"))


def exact_dedup(docs: DataFrame, index: DigestIndex, steps: int = 1) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each document; new digests are in ``index`` afterwards.

    Texts are equal when their UTF-8 is; a null text counts as empty.  A document whose text
    the index knew before is not kept, and ``keep_id`` is the one known then.  Of equal new
    texts the row with the greatest id stays (null ids are last); of rows that repeat an id
    exactly one stays.  ``group_size`` counts the rows of ``docs`` with that text.  With
    ``steps`` the ids are cut into that many ranges of like size, which meet the index one after
    another, the greatest first: each task then has that part of the digests, and a lost job
    repeats one range.  Empty tables give no rows; other columns aren't read.
    """
    spark, batch = docs.sparkSession, uuid.uuid4().hex
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("at")), "digests")
    cuts = [n / steps for n in range(steps - 1, 0, -1)]
    total, *more = rows.agg(F.count("*"), *([F.percentile_approx("doc_id", cuts, 10_000)] if cuts else [])).first()
    edges = [None, *sorted(set(more[0] or []), reverse=True), None] if more else [None, None]
    for high, low in zip(edges, edges[1:]):
        part = rows if low is None else rows.where(F.col("doc_id") >= low)
        if high is not None:
            part = part.where((F.col("doc_id") < high) | F.col("doc_id").isNull())
        index.append(_groups(part), batch)
    known = index.read().hint("merge").select("digest", "keep_id", F.when(F.col("batch") == batch, F.col("at")).alias("kept_at"))
    sizes = written(rows.groupBy("digest").agg(F.count("*").alias("group_size")).join(known, "digest"), "sizes")
    most = max(1, total // FREQUENT)
    # frequent digests stay where they are; of the others no task gets more than `most` rows of one
    tagged = rows.join(F.broadcast(sizes.where(F.col("group_size") > most)), "digest", "left")
    rest = tagged.where("group_size is null").select("doc_id", "digest", "at").join(sizes.where(F.col("group_size") <= most).hint("merge"), "digest")
    out = tagged.where("group_size is not null").unionByName(rest)
    kept = F.coalesce(F.col("at") == F.col("kept_at"), F.lit(False))
    out = written(out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), "dedup")
    drop(spark, rows, sizes)
    return out


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole table meets a new index in STEPS increments; the index goes when its answers are written."""
    index = DigestIndex(spark, fresh_path(spark, "index"))
    out = exact_dedup(table(spark, sf_dir, "documents"), index, STEPS)
    index.forget()
    return out


OP12_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""

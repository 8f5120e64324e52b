"""Reading and writing of clone trees, indexes, audit logs and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

AUDIT = "event_id string, ts timestamp, type string, actor string, action string, resource string, status string, ip string, session string, message string, details string, duration_ns long"
SNAPSHOT = "url string, ts timestamp, html_hash string, text_content string, structure array<struct<tag:string,selector:string,attributes:map<string,string>,text_hash:string,child_count:int>>, metadata map<string,string>"


def clone_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``rel_path, url, size, modified, content`` of stored files; content is only read where it is used."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace("file://", "") + "/", "")
    return files.select(rel.alias("rel_path"), U.url_from_local_path(rel).alias("url"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def write_index(files: DataFrame, path: str) -> None:
    """One JSON line for each url of a file index, by url."""
    files.orderBy("url").write.mode("overwrite").json(path)


def write_audit(events: DataFrame, path: str, most: int = 1_000_000) -> None:
    """Audit events as JSON lines, one folder a day; a day's events may be in many files, of ``most`` events each at most."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").option("maxRecordsPerFile", most).partitionBy("day").json(path)


def read_audit(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, **one_of: list[str]) -> DataFrame:
    """Audit events between two days (inclusive; only their folders are read) whose columns are in the given lists; header lines are dropped."""
    out = spark.read.schema(AUDIT + ", day date").json(path).where("type is null or type <> 'audit_log'")
    tests: list[Column] = ([F.col("day") >= F.lit(since).cast("date")] if since else []) + ([F.col("day") <= F.lit(until).cast("date")] if until else [])
    for test in [*tests, *[F.col(k).isin(v) for k, v in one_of.items()]]:
        out = out.where(test)
    return out


def write_snapshots(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_snapshots(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """Snapshots, of each url the newest ``keep``."""
    from pyspark.sql import Window as W

    out = spark.read.schema(SNAPSHOT).json(path)
    if keep is None:
        return out
    return out.withColumn("_rank", F.row_number().over(W.partitionBy("url").orderBy(F.desc("ts")))).where(F.col("_rank") <= keep).drop("_rank")


def snapshot_counts(rows: DataFrame) -> DataFrame:
    """``url, n_snapshots, newest`` of stored snapshots."""
    return rows.groupBy("url").agg(F.count("*").alias("n_snapshots"), F.max("ts").alias("newest"))


def clean_snapshots(spark: SparkSession, path: str, target: str, keep: int = 10) -> DataFrame:
    """The newest ``keep`` snapshots of each url, written to a new folder ``target``, and read from there."""
    write_snapshots(read_snapshots(spark, path, keep), target)
    return read_snapshots(spark, target)


def snapshot_report(changes: DataFrame) -> DataFrame:
    """``url, added, removed, modified`` of structural changes (``url, change``)."""
    n = lambda kind: F.sum((F.col("change") == kind).cast("int")).alias(kind)
    return changes.groupBy("url").agg(n("added"), n("removed"), n("modified"))


def write_tree(files: DataFrame, target: str) -> DataFrame:
    """Write files (``rel_path``, binary ``content``) below a shared folder; ``rel_path, size`` of what was written.

    A file is written under another name and renamed, so a task that is run again does no harm.
    """
    from .warc import _fs

    def run(batches):
        import uuid

        import pyarrow as pa

        fs, root = _fs(target)
        for b in batches:
            done = []
            for path, content in zip(b.column(0), b.column(1)):
                name, data = path.as_py(), content.as_py() or b""
                if name is None or ".." in name.split("/"):
                    continue
                fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                part = f"{root}/{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(data)
                fs.move(part, f"{root}/{name}")
                done.append((name, len(data)))
            yield pa.record_batch([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["rel_path", "size"])

    return files.select("rel_path", "content").mapInArrow(run, "rel_path string, size long")


def kafka_queue(spark: SparkSession, servers: str, topic: str, **options: str):
    """A stream of queued items (``url, depth``) of a Kafka topic; the connector's jar must be there."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), "url string, depth int").alias("item")).select("item.*")


def to_kafka(items: DataFrame, servers: str, topic: str) -> None:
    """Append items (``url, depth``) to a Kafka topic, by url."""
    items.select(F.col("url").alias("key"), F.to_json(F.struct("url", "depth")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def jdbc_queue(spark: SparkSession, url: str, table: str, column: str = "seq", lower: int = 0, upper: int = 1 << 31, parts: int = 64, **options: str) -> DataFrame:
    """Queued items of a table, read by ranges of ``column``; the database's driver must be there."""
    how = {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**how, **options).load()


def to_jdbc(items: DataFrame, url: str, table: str, **options: str) -> None:
    items.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()

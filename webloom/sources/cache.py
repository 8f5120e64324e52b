"""The validators of fetched urls (etag, last-modified) in hash buckets; a merge rewrites only the buckets that it touches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frontier import _folder, _pointers

_ENTRIES = "url string, etag string, last_modified string, status int, fetched timestamp"


def validators(responses: DataFrame) -> DataFrame:
    """``url, etag, last_modified, status, fetched``: what responses (``url, status, etag, last_modified, at, seq``) say of each url.

    Only a response with a validator, or with status 304, counts; of each field the last
    non-empty value holds (a status above 0), and the time is that of the last response.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = responses.where(F.col("url").isNotNull() & (some("etag").isNotNull() | some("last_modified").isNotNull() | (F.col("status") == 304)))
    place = F.struct("at", "seq")
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), place))
    status = F.when(F.col("status") > 0, F.col("status").cast("int"))
    return rows.groupBy("url").agg(last(some("etag")).alias("etag"), last(some("last_modified")).alias("last_modified"), last(status).alias("status"), F.max("at").cast("timestamp").alias("fetched"))


class CacheStore:
    """``buckets`` folders of entries below a shared ``path``; a numbered pointer names the folder of each.

    The pointer is renamed into place last, so a merge that dies leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        found = self._version()
        if found:
            self.buckets = found["buckets"]

    def _version(self) -> dict | None:
        fs, root, _ = _folder(self.spark, f"{self.path}/pointers")
        found = _pointers(fs, root)
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{found[-1]}", wholetext=True).first()[0]) if found else None

    def folders(self) -> dict[str, str]:
        """The folder of each bucket that has entries."""
        return (self._version() or {"folders": {}})["folders"]

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """``url, etag, last_modified, status, fetched`` of all buckets, or of some."""
        found = [f for b, f in self.folders().items() if buckets is None or b in buckets]
        return self.spark.read.schema(_ENTRIES).parquet(*[f"{self.path}/{f}" for f in found]) if found else self.spark.createDataFrame([], _ENTRIES)

    def merge(self, responses: DataFrame) -> list[str]:
        """Upsert what responses say: new non-empty fields replace old ones, others stay.  The buckets that were rewritten."""
        bucket = F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int").alias("bucket")
        version, name = self._version() or {"folders": {}, "buckets": self.buckets}, uuid.uuid4().hex
        staged = f"{self.path}/staged/{name}"
        validators(responses).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(staged)
        new = self.spark.read.schema(f"{_ENTRIES}, bucket int").parquet(staged)
        touched = sorted(str(r[0]) for r in new.select("bucket").distinct().collect())  # a row for each bucket at most
        if not touched:
            return []
        old = self.read(touched).select("url", *[F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "status", "fetched")])
        merged = new.drop("bucket").join(old, "url", "full")
        both = [F.coalesce(c, f"_{c}").alias(c) for c in ("etag", "last_modified", "status")]
        merged = merged.select("url", *both, F.greatest("fetched", "_fetched").alias("fetched")).withColumn("bucket", bucket)
        merged.write.partitionBy("bucket").parquet(f"{self.path}/entries/{name}")
        version["folders"] |= {b: f"entries/{name}/bucket={b}" for b in touched}
        fs, root, at = _folder(self.spark, f"{self.path}/pointers")
        last = max(map(int, _pointers(fs, root)), default=0)
        out = fs.create(at(f"{self.path}/pointers/.{name}"))
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        if not fs.rename(at(f"{self.path}/pointers/.{name}"), at(f"{self.path}/pointers/{last + 1:012d}")):
            raise RuntimeError(f"another merge into {self.path} came first")
        fs.delete(at(staged), True)
        return touched

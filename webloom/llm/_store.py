"""Where operators keep tables between jobs: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share.

    Where it is unset, a session on one machine (master ``local``) gets a temporary one; on
    a cluster that is an error, as other machines would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            found = got.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="webloom-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return found.rstrip("/")


#: Bytes that go to a Python worker at once, by a setting of the session; a smaller one is kept.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, so that very long texts meet few others on their way to Python."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder and read from there (lineage ends here)."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._webloom_path = path
    return out


def drop(spark: SparkSession, *frames: DataFrame | str | None) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for x in frames:
        path = x if isinstance(x, str) else getattr(x, "_webloom_path", None)
        if path:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_place(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` and two columns (file, row in it) that name each of its rows, the same ones in every job.

    Rows of a plain Parquet scan have a place; anything else is written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    files = plan.relation() if plan.getClass().getSimpleName() == "LogicalRelation" else None
    if files is None or files.getClass().getSimpleName() != "HadoopFsRelation" or files.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        docs = written(docs, "rows")
    at = docs.metadataColumn("_metadata")
    return docs, [F.xxhash64(at["file_path"]), at["row_index"]]


#: Bytes of a training sample that may reach the driver.
SAMPLE_BYTES = 200 << 20


def spot(*ids: str) -> Column:
    """A number below 2^20 that a sample may be thinned by: a hash of the row's id, so that rows of equal content are told apart."""
    return F.pmod(F.xxhash64(*ids, F.lit(17)), F.lit(1 << 20)).cast("int").alias("spot")


def collected(df: DataFrame, name: str):
    """The rows of ``df`` (a sample with binary columns, and ``spot``) as an Arrow table; they pass through the shared folder once.

    The sample is bounded in bytes as well: beyond SAMPLE_BYTES it is thinned by ``spot``, so
    that documents of any length fit the driver.
    """
    kept = written(df, name)
    wide = [c for c, kind in kept.dtypes if kind == "binary"]
    size = kept.agg(F.sum(reduce(add, [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in wide]))).first()[0] or 0
    part = int(min(1.0, SAMPLE_BYTES / max(size, 1)) * (1 << 20))
    out = kept.where(F.col("spot") < part).drop("spot").toArrow()
    drop(df.sparkSession, kept)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

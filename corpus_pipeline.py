"""A training corpus from raw documents: quality, near duplicates, decontamination, personal data, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and gives the next stage what it reads from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm._store import drop, row_place, table, written
from webloom.llm.decontaminate import without_contaminated
from webloom.llm.ngram_join import BROADCAST_ROWS, ngram_join
from webloom.llm.pii import redacted
from webloom.llm.quality import kept_good
from webloom.llm.sentencepiece_codec import encode

#: Words of a shingle and percent of similarity of near duplicates.
SHINGLE, SIMILAR = 5, 80


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts, each row by its own text and metadata (nulls are values of their own)."""
    return kept_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id (a null id is last), then the first row.

    Rows are told apart by their place in the files, so rows without an id, with a repeated
    id, and repeated rows are documents like others.  Texts without words are no duplicates.
    """
    docs, (file, row) = row_place(docs)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), file.alias("f"), row.alias("r"))
    joined = ngram_join(docs.select(name.alias("doc_id"), "text"), k=SHINGLE, percent=SIMILAR)
    out = written(joined.where("component_id <> doc_id").select("doc_id.f", "doc_id.r"), "duplicates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), file.alias("f"), row.alias("r"))
    drop(spark, joined)
    return rows.join(_bounded(out), ["f", "r"], "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row by its own text."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each document, with begin and end ids."""
    return encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("token_ids", token_ids)]

#: Training and segmentation can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        drop(spark, before)
        before = docs
    return docs

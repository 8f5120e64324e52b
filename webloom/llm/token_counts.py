"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a run of little-endian 16- or 32-bit ids in which one id ends a document;
nothing tells where documents begin.  Files are read in blocks of equal size, by any
executor in any order.  Each block finds its separators with one vectorised comparison;
a prefix scan over the (few) numbers of each block then gives every document its place,
and stitches documents that cross blocks.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scan
from ._store import drop, fresh_path, table, written
from .chunk_table import ChunkTable, batches_of, blank_chunks

#: Bytes of a block of a token file.
BLOCK_BYTES = 8 << 20
#: Blocks that one task of the prefix scan adds up.
SPAN = 4096
VOCABULARY, END_OF_DOCUMENT = "byte_bpe_50k.tiktoken", 50256


def _open(uri: str):
    """(file system, path in it) of a folder or file that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Byte-level BPE ids of texts as packed 16-bit integers, by distinct chunks."""

    def __init__(self, name: str):
        self.enc = _encoding(name)
        self.table = ChunkTable(lambda chunks: [np.array(self.enc.encode_ordinary(c), "<u2").tobytes() for c in chunks])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [blank_chunks(x) if x else [] for x in texts]
        get = self.table.lookup([x for x in cut if x] or [[]]).__getitem__
        return [b"".join(map(get, c)) if c is not None else np.array(self.enc.encode_ordinary(x), "<u2").tobytes() for c, x in zip(cut, texts)]


_tokenizers: dict[str, Tokenizer] = {}


def _write(folder: str, name: str):
    def run(batches):
        if name not in _tokenizers:
            _tokenizers[name] = Tokenizer(name)
        encode, end = _tokenizers[name], np.array([END_OF_DOCUMENT], "<u2").tobytes()
        fs, root = _open(folder)
        file, out, nth = f"{uuid.uuid4().hex}.bin", None, 0  # a retried task writes another file; only files of finished tasks are listed
        try:
            for batch in batches:
                for texts, ids in zip(batches_of(batch.column(1)), batches_of(batch.column(0))):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{file}")
                    for tokens in encode(texts):
                        out.write(tokens)
                        out.write(end)
                    yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array([file] * len(ids)), pa.array(range(nth, nth + len(ids)), pa.int64())], ["doc_id", "file", "nth"])
                    nth += len(ids)
        finally:
            if out is not None:
                out.close()

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write texts as flat 16-bit token files; (folder, rows of ``doc_id, file, nth``).

    ``folder`` must be shared by all machines (a new one in spark.checkpoint.dir by default).
    Null texts are empty documents; a text's ids never hold the separator.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("file", T.StringType()), T.StructField("nth", T.LongType())])
    return folder, written(base.mapInArrow(_write(folder, vocabulary), schema), "token-index")


def _scan_blocks(folder: str, separator: int, width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]):
        fs, root = _open(folder)
        for batch in batches:
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in range(3))):
                with fs.open_input_file(f"{root}/{name}") as f:
                    data = f.read_at(min(block, size - at), at)
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)
                seps = np.flatnonzero(ids == separator)
                inner = np.diff(seps) - 1
                head, tail = (int(seps[0]), len(ids) - int(seps[-1]) - 1) if len(seps) else (len(ids), 0)
                yield pa.record_batch(
                    [pa.array([name]), pa.array([at // block]), pa.array([len(seps)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inner.astype("<i8").tobytes()], pa.binary())],
                    ["file", "block", "n_seps", "head", "tail", "inner"],
                )

    return run


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for row in range(batch.num_rows):
            file, first, n, inner = (batch.column(names.index(c))[row].as_py() for c in ("file", "first", "stitched", "inner"))
            counts = np.concatenate(([n], np.frombuffer(inner, "<i8")))
            yield pa.record_batch([pa.array([file] * len(counts)), pa.array(np.arange(first, first + len(counts))), pa.array(counts.astype(np.int64))], ["file", "nth", "n_tokens"])


def separator_counts(spark: SparkSession, folder: str, files: DataFrame | None = None, separator: int = END_OF_DOCUMENT, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, nth, n_tokens`` of every document in a folder's token files (the separator isn't counted).

    ``files`` (a column ``file``) restricts the scan to files that finished tasks wrote.
    Tokens after a file's last separator are a last document without an end, if there are
    any.  Empty files and empty folders give no rows; two separators in a row enclose an
    empty document.  ``width`` is 2 or 4 bytes; bytes past a whole number of ids are left out.
    """
    from pyarrow import fs as pafs

    fs, root = _open(folder)
    block = block_bytes - block_bytes % width
    found = [(x.base_name, x.size - x.size % width) for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.size >= width]
    listed = spark.createDataFrame(found, "file string, size long")
    if files is not None:
        listed = listed.join(files.select("file").distinct(), "file", "left_semi")
    blocks = listed.select("file", F.explode(F.expr(f"sequence(0L, size - 1, {block}L)")).alias("at"), "size")
    blocks = blocks.repartition(max(2 * spark.sparkContext.defaultParallelism, 1 + sum(s for _, s in found) // (8 * block)))
    scanned = written(blocks.mapInArrow(_scan_blocks(folder, separator, width, block), "file string, block long, n_seps long, head long, tail long, inner binary"), "blocks")
    # prefix scan in two levels, over spans of blocks and within a span: separators before a block, and tokens since the last one
    thin = scanned.select("file", "block", "n_seps", "head", "tail", F.floor(F.col("block") / SPAN).alias("span"))
    earlier = lambda by, at: F.coalesce(F.sum("n_seps").over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = thin.groupBy("file", "span").agg(F.sum("n_seps").alias("n_seps")).select("file", "span", earlier(["file"], "span").alias("base"))
    thin = thin.withColumn("within", earlier(["file", "span"], "block")).join(spans, ["file", "span"])
    thin = thin.select("file", "block", "n_seps", "head", "tail", (F.col("within") + F.col("base")).alias("first"))
    # blocks without a separator add all they have to the tail of the last block with one
    held = thin.withColumn("whole", F.when(F.col("n_seps") == 0, F.col("head")).otherwise(0))
    since = held.where("n_seps = 0").groupBy("file", "first").agg(F.sum("whole").alias("since"))
    carry = held.where("n_seps > 0").select("file", (F.col("first") + F.col("n_seps")).alias("first"), F.col("tail").alias("carried"))
    j = held.join(carry, ["file", "first"], "left").join(since, ["file", "first"], "left")
    j = j.withColumn("open", F.coalesce("carried", F.lit(0)) + F.coalesce("since", F.lit(0)))
    stitched = j.where("n_seps > 0").select("file", "block", "first", (F.col("head") + F.col("open")).alias("stitched"))
    docs = stitched.join(scanned.select("file", "block", "inner"), ["file", "block"]).select("file", "first", "stitched", "inner").mapInArrow(_emit, "file string, nth long, n_tokens long")
    # what follows the last separator of a file
    ends = held.groupBy("file").agg(F.sum("n_seps").alias("nth"))
    last = held.join(ends, "file").withColumn("rest", F.when(F.col("first") == F.col("nth"), F.col("whole")).otherwise(0) + F.when((F.col("n_seps") > 0) & (F.col("first") + F.col("n_seps") == F.col("nth")), F.col("tail")).otherwise(0))
    open_ = last.groupBy("file", "nth").agg(F.sum("rest").alias("n_tokens")).where("n_tokens > 0")
    out = docs.unionByName(open_)
    out._webloom_path = scanned._webloom_path  # may be dropped once the counts are written
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every row: texts go to flat token files, which are then counted by their separators."""
    spark = docs.sparkSession
    folder, index = write_tokens(docs, id_col=id_col, text_col=text_col)
    counts = separator_counts(spark, folder, index)
    counted = written(index.join(counts, ["file", "nth"]).select("doc_id", "n_tokens"), "token-counts")
    fs, root = _open(folder)
    fs.delete_dir(root)
    drop(spark, index, counts)
    return counted


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

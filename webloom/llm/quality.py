"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees shapes and words of the text, hashed; the metadata view sees language,
source and length.  Both start from the labelled documents.  In each round the executors
score every other document with both views; where a view is sure, its label goes to the
other view.  Those pseudo-labelled documents, however many, reach the driver as the sums of
their features by label and bag (a hash of the document), and the other view learns from the
bags' means.  On labelled documents held back, each view is calibrated and the calibrated
views are combined; the combination scores every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scan
from ._store import collected, spot, table
from .linear import Rows, dense_logistic, logistic, sigmoid

#: Hashed features of the text view: the first half are word shapes, the rest words.
DIMS = 1 << 15
META_DIMS = 1 << 12
#: Documents expected in the labelled sample (drawn by a hash of the id).
LABELLED = 6_000
#: Rounds of exchange (each reads all documents), probability from which a view is sure, bags of a label, weight of all pseudo-labels.
ROUNDS, CONFIDENT, BAGS, TRUST = 2, 0.97, 4, 0.5
#: Steps of a feature of 1 in sums, which are exact in any order.
FIXED = 1 << 20
KEEP = 0.5


def _hash_text(values: list) -> np.ndarray:
    buf, offs = _scan.buffers(pa.array([str(v) for v in values], pa.string()))
    h = _scan.mix(np.arange(1, 2, dtype=np.uint64))
    out = np.zeros(len(values), np.uint64)
    some = offs[1:] > offs[:-1]
    if some.any():
        out[some] = _scan.hash_spans(buf, offs[:-1][some], offs[1:][some])
    return out ^ h


class TextView:
    """Relative frequencies of shapes and words of many texts, as sparse rows (square roots, which even out length)."""

    @staticmethod
    def rows(arr: pa.Array) -> Rows:
        buf, offs = _scan.buffers(arr)
        half = np.uint64(DIMS // 2)
        sh, at = _scan.shapes(buf, offs)
        _, _, wh, wat = _scan.words(buf, offs, _scan.SPACE_PUNCT)
        n = len(offs) - 1
        row = np.concatenate((np.repeat(np.arange(n), np.diff(at)), np.repeat(np.arange(n), np.diff(wat))))
        idx = np.concatenate((sh % half, half + wh % half)).astype(np.int64)
        key, count = np.unique(row * DIMS + idx, return_counts=True)
        row, idx = key // DIMS, key % DIMS
        total = np.where(idx < DIMS // 2, np.maximum(np.diff(at), 1)[row], np.maximum(np.diff(wat), 1)[row]) if n else row
        return Rows(idx, np.sqrt(count / total), np.searchsorted(row, np.arange(n + 1)))


class MetaView:
    """Indicators of language, source, both, and the magnitude of n_chars."""

    @staticmethod
    def rows(lang: list, source: list, n_chars: list) -> Rows:
        n = len(lang)
        size = [-1 if x is None or x < 0 else int(2 * np.log2(x + 1)) for x in n_chars]
        cols = [_hash_text([f"{tag}={v}" for v in vs]) for tag, vs in (("lang", lang), ("source", source), ("both", list(zip(lang, source))), ("size", size))]
        idx = (np.stack(cols, 1) % np.uint64(META_DIMS)).astype(np.int64).ravel() if n else np.zeros(0, np.int64)
        return Rows(idx, np.ones(len(idx)), np.arange(n + 1) * 4)


def _sampled(docs: DataFrame, expect: int, total: int, seed: int) -> DataFrame:
    """About ``expect`` of ``total`` rows, drawn by a hash of the id."""
    part = min(1.0, expect / max(total, 1))
    return docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)


def _column(part: pa.RecordBatch, name: str):
    return part.column(part.schema.get_field_index(name))


def _meta(part: pa.RecordBatch) -> Rows:
    return MetaView.rows(*(_column(part, c).to_pylist() for c in ("lang", "source", "n_chars")))


def _features(batches):
    for batch in batches:
        for part in _scan.slices(batch, "text"):
            x = TextView.rows(_column(part, "text"))
            pack = lambda a, kind: pa.array([a[i:j].astype(kind).tobytes() for i, j in zip(x.at, x.at[1:])], pa.binary())
            yield pa.record_batch([*(_column(part, c) for c in ("label", "spot", "lang", "source", "n_chars")), pack(x.idx, "<i4"), pack(x.val, "<f4")], ["label", "spot", "lang", "source", "n_chars", "idx", "val"])


def sure(p: np.ndarray) -> np.ndarray:
    """Pseudo-labels: 1, 0, or -1 where the view isn't sure."""
    return np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1))


def _exchanged(text: np.ndarray, meta: np.ndarray):
    """Sums of the features that either view learns from the other's pseudo-labels: ``view, cell, feature, total`` (feature -1: documents)."""

    def run(batches):
        sums = [np.zeros((2 * BAGS, dims + 1), np.int64) for dims in (DIMS, META_DIMS)]
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                views = TextView.rows(_column(part, "text")), _meta(part)
                said = [sure(sigmoid(v.dot(w[:-1]) + w[-1])) for v, w in zip(views, (text, meta))]
                bag = _column(part, "bag").to_numpy()
                for v, label, out in zip(views, said[::-1], sums):
                    at = np.flatnonzero(label >= 0)
                    cell = label * BAGS + bag
                    own = v.take(at)
                    where = cell[at][own.row] * np.int64(out.shape[1]) + own.idx
                    out += np.bincount(where, np.round(own.val * np.float64(FIXED)), out.size).astype(np.int64).reshape(out.shape)
                    out[:, -1] += np.bincount(cell[at], minlength=2 * BAGS)
        for view, out in enumerate(sums):
            cell, feature = np.nonzero(out)
            total = out[cell, feature]
            feature = np.where(feature == out.shape[1] - 1, -1, feature)
            for lo in range(0, len(cell), 1 << 16):
                hi = min(lo + (1 << 16), len(cell))
                yield pa.record_batch([pa.array(np.full(hi - lo, view, np.int32)), pa.array(cell[lo:hi].astype(np.int32)), pa.array(feature[lo:hi].astype(np.int32)), pa.array(total[lo:hi])], ["view", "cell", "feature", "total"])
        _scan.trim()

    return run


def _bags(got: pa.Table, view: int) -> tuple[Rows, np.ndarray, np.ndarray]:
    """(mean features, label, documents) of the bags of a view."""
    of, cell, feature, total = (got[c].to_numpy() for c in ("view", "cell", "feature", "total"))
    mine = of == view
    n = np.bincount(cell[mine & (feature < 0)], total[mine & (feature < 0)], 2 * BAGS)
    mine &= feature >= 0
    order = np.lexsort((feature[mine], cell[mine]))
    cell, feature, total = (x[mine][order] for x in (cell, feature, total))
    full = np.flatnonzero(n)
    x = Rows(feature, total / FIXED / np.maximum(n, 1)[cell], np.searchsorted(cell, np.arange(2 * BAGS + 1)))
    return x.take(full), (full >= BAGS).astype(float), n[full]


class Model:
    """The two views' weights, their calibration and the combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, calibrate: tuple, combine: np.ndarray):
        self.text, self.meta, self.calibrate, self.combine = text.astype(np.float32), meta.astype(np.float32), calibrate, combine

    def score(self, x: Rows, m: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view, metadata view) probabilities of good quality."""
        a = x.dot(self.text[:-1]) + self.text[-1]
        b = m.dot(self.meta[:-1]) + self.meta[-1]
        a, b = (c[0] * v + c[1] for c, v in zip(self.calibrate, (a, b)))
        return sigmoid(np.clip(np.stack([a, b], 1), -12, 12) @ self.combine[:-1] + self.combine[-1]), sigmoid(a), sigmoid(b)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Co-train on a bounded sample of labelled documents (LABELLED rows are expected) and on all other documents."""
    lab = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    some = _sampled(lab, LABELLED, lab.count(), 1)  # about LABELLED rows of 12 bytes, so it may be broadcast
    base = _documents(docs)
    got = collected(base.join(F.broadcast(some), "doc_id").select("*", spot("doc_id")).mapInArrow(_features, "label int, spot int, lang string, source string, n_chars long, idx binary, val binary"), "co-training").to_pylist()
    got.sort(key=lambda r: tuple(str(r[c]) if c in ("lang", "source", "n_chars") else r[c] for c in ("label", "lang", "source", "n_chars", "idx", "val")))  # an order that doesn't depend on partitions
    mixed = np.argsort([zlib.crc32(r["idx"] + r["val"]) for r in got], kind="stable")
    got = [got[i] for i in mixed.tolist()]
    at = np.concatenate(([0], np.cumsum([len(r["idx"]) // 4 for r in got]))).astype(np.int64)
    x = Rows(np.frombuffer(b"".join([r["idx"] for r in got]), "<i4"), np.frombuffer(b"".join([r["val"] for r in got]), "<f4"), at)
    m = MetaView.rows(*([r[c] for r in got] for c in ("lang", "source", "n_chars")))
    y = np.array([r["label"] for r in got], int)
    del got
    rest = base.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").withColumn("bag", F.pmod(F.xxhash64("doc_id", "text"), F.lit(BAGS)).cast("int"))

    def exchange(text: np.ndarray, meta: np.ndarray) -> pa.Table:
        told = rest.mapInArrow(_exchanged(text, meta), "view int, cell int, feature int, total long")
        return told.groupBy("view", "cell", "feature").agg(F.sum("total").alias("total")).toArrow()  # a row for each bag and feature at most

    return fit(x, m, y, exchange)


def fit(x: Rows, m: Rows, y: np.ndarray, exchange) -> Model:
    """``exchange(text weights, metadata weights)`` gives the sums of what either view learns from the other."""
    if len(set(y.tolist())) < 2:  # nothing to tell apart: everything passes or fails alike
        only = 4.0 if not len(y) or y[0] == 1 else -4.0
        return Model(np.zeros(DIMS + 1), np.zeros(META_DIMS + 1), ((1.0, 0.0), (1.0, 0.0)), np.array([0.0, 0.0, only]))
    held = np.arange(len(y))[::4]
    learn = np.setdiff1d(np.arange(len(y)), held)
    views = [(x, DIMS), (m, META_DIMS)]
    weights = [logistic(v.take(learn), y[learn].astype(float), dims) for v, dims in views]
    for _ in range(ROUNDS):
        got = exchange(weights[0].astype(np.float32), weights[1].astype(np.float32))
        new = []
        for view, (v, dims) in enumerate(views):
            bags, label, n = _bags(got, view)
            trust = np.concatenate((np.ones(len(learn)), TRUST * len(learn) * n / max(n.sum(), 1)))
            new.append(logistic(v.take(learn).then(bags), np.concatenate((y[learn], label)).astype(float), dims, weight=trust))
        weights = new
    logits = [v.take(held).dot(w[:-1]) + w[-1] for (v, _), w in zip(views, weights)]
    target = y[held].astype(float)
    scales = tuple(tuple(dense_logistic(z[:, None], target)) for z in logits)
    both = np.clip(np.stack([c[0] * z + c[1] for c, z in zip(scales, logits)], 1), -12, 12)
    return Model(weights[0], weights[1], scales, dense_logistic(both, target))


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                p, a, b = model.score(TextView.rows(_column(part, "text")), _meta(part))
                yield pa.record_batch([part.column(0), pa.array(np.round(p, 6)), pa.array(np.round(a, 6)), pa.array(np.round(b, 6)), pa.array((p >= KEEP).astype(np.int32))], ["doc_id", "score", "text_score", "meta_score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, text_score, meta_score, predicted`` of every row (predicted 1: good).

    ``docs`` has ``doc_id, text, lang, source, n_chars``; nulls in any of them are values of
    their own, a null text counts as empty.  Repeated rows are each answered, each row by
    itself; other columns aren't read.  Without labels of both kinds every document gets the
    one kind there is, or good.
    """
    model = train(docs, labels)
    base = _documents(docs)
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), *T._parse_datatype_string("score double, text_score double, meta_score double, predicted int").fields])
    return base.mapInArrow(_score(model), schema)


def _good(model: Model):
    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                p, _, _ = model.score(TextView.rows(_column(part, "text")), _meta(part))
                yield part.filter(pa.array(p >= KEEP))

    return run


def kept_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier calls good, with all their columns."""
    return docs.mapInArrow(_good(train(docs, labels)), docs.schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

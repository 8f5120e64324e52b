"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels.

A sentence's probability is logistic in its words, their beginnings, and which of these its
document had before; a document is toxic
unless none of its sentences is: 1 - prod(1 - p).  Only document labels are known; gradients
reach the sentences through the noisy-or.  Only words that stand out in toxic documents are
evidence, and a sentence below the probability ``FLOOR`` is none, so that a clean document
scores 0 at any length.  The learnt sentence scores also locate what offends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scan
from ._store import collected, drop, spot, table, written
from .linear import Adam, Rows, sigmoid

#: Documents expected in the training sample (drawn by a hash of the id).
SAMPLE = 12_000
#: Toxic documents that must hold a word for it to count, the G statistic that it must reach, and words that count at most.
LEAST_DOCS, LEAST_G, MOST_WORDS = 3, 15.0, 20_000
#: Bytes of a word's beginnings that are features as well.
HEADS = (4, 6)
#: Probability below which a sentence is no evidence.
FLOOR = 0.2
#: Score from which a document is called toxic, and a sentence is reported.
TOXIC = 0.7
_AGAIN = np.uint64(0x5851F42D4C957F2D)
_STOP = _scan.mask_of(b".!?\n")
_Z0 = float(np.log(FLOOR / (1 - FLOOR)))


class Sentences:
    """Features of many texts: ``feature`` hash and ``sent`` of each; ``row, start, end`` (bytes) of each sentence."""

    def __init__(self, arr: pa.Array):
        self.buf, self.offs = _scan.buffers(arr)
        s, e, h, rows = _scan.words(self.buf, self.offs, _scan.SPACE_PUNCT)
        row = np.repeat(np.arange(len(self.offs) - 1), np.diff(rows))
        if not len(s):
            z = np.zeros(0, np.int64)
            self.feature, self.sent, self.row, self.start, self.end = h, z, z, z, z
            return
        stops = np.concatenate(([0], np.cumsum(_STOP[self.buf], dtype=np.int32)))
        new = np.ones(len(s), bool)
        new[1:] = (row[1:] != row[:-1]) | (stops[s[1:]] > stops[e[:-1]])
        sent = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        features, of = [h], [sent]
        for n in HEADS:
            at = np.flatnonzero(e - s > n)
            features.append(_scan.mix(_heads(self.buf, s[at], n) ^ np.uint64(n)))
            of.append(sent[at])
        for f, where in list(zip(features, of)):  # one word may be chance; that it comes again is a feature of its own
            at = _again(f, row[first][where])
            features.append(_scan.mix(f[at] ^ _AGAIN))
            of.append(where[at])
        self.feature, self.sent = np.concatenate(features), np.concatenate(of)
        self.row, self.start, self.end = row[first], s[first], e[np.append(first[1:], len(s)) - 1]

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, position in ``words``) of the features that are among ``words``, each once a sentence, by sentence."""
        if not len(words) or not len(self.feature):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(1 << 16, bool)
        seen[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(seen[(self.feature & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(words, self.feature[at]), len(words) - 1)
        ok = words[k] == self.feature[at]
        pair = np.unique(self.sent[at[ok]] * np.int64(len(words)) + k[ok])
        return pair // len(words), pair % len(words)


def _heads(buf: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each start, A-Z as a-z."""
    out = np.zeros(len(start), np.uint64)
    for j in range(n):
        out = _scan.mix(out + _scan.LOWER[buf[start + j]])
    return out


def _again(feature: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of features that their row had before."""
    key = feature ^ _scan.mix(row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    return np.sort(order[1:][key[order[1:]] == key[order[:-1]]])


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _evidence(z: np.ndarray) -> np.ndarray:
    """What a sentence adds to minus the log of "not toxic"."""
    return np.maximum(0, softplus(z) - softplus(np.float64(_Z0)))


class Model:
    """Words with a weight (ascending hashes) and the intercept of a sentence."""

    def __init__(self, words: np.ndarray, weight: np.ndarray, bias: float, only: float | None = None):
        self.words, self.weight, self.bias, self.only = words, weight, float(bias), only

    def score(self, x: Sentences, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(document scores, sentence scores): a document is toxic unless none of its sentences is; a sentence without evidence scores 0."""
        p = np.zeros(len(x.row))
        if self.only is not None:
            return np.full(n_rows, self.only), p
        sent, k = x.pairs(self.words)
        some, at = np.unique(sent, return_inverse=True)
        said = _evidence(self.bias + np.bincount(at, self.weight[k], len(some)))
        p[some] = 1 - np.exp(-said)
        return 1 - np.exp(-np.bincount(x.row[some], said, n_rows)), p


def fit(x: Rows, times: np.ndarray, doc: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weights, intercept) from sentences ``x`` that occur ``times`` in document ``doc``, the documents' labels and first weights."""
    w = np.append(start.astype(float), -2.0)
    opt = Adam(len(w), 0.05)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for _ in range(steps if len(x.at) > 1 else 0):
        z = x.dot(w[:-1]) + w[-1]
        s = np.bincount(doc, times * _evidence(z), len(y))
        # loss: y = 0 gives s, y = 1 gives -log(1 - exp(-s))
        ds = np.where(y == 1, -1.0 / np.expm1(np.clip(s, 0.05, 50)), 1.0) * weight
        g = ds[doc] * times * sigmoid(z) * (z > _Z0)
        grad = np.append(x.back(g, len(start)), g.sum())
        grad[:-1] += 1e-4 * np.sign(w[:-1])
        opt.step(w, grad)
    return w[:-1], float(w[-1])


def _counts(batches):
    """``feature, toxic, clean``: documents of either label that hold it; feature 0 has all documents of either label."""
    for batch in batches:
        for part in _scan.slices(batch, "text"):
            x = Sentences(part.column(part.schema.get_field_index("text")))
            y = part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            f, inverse = np.unique(x.feature, return_inverse=True)
            pair = np.unique(inverse * np.int64(len(y)) + x.row[x.sent]) if len(f) else np.zeros(0, np.int64)
            of, label = (pair // max(len(y), 1)), y[pair % max(len(y), 1)] if len(pair) else pair
            n = [np.bincount(of, label == v, len(f)).astype(np.int64) for v in (1, 0)]
            sums = [int((y == v).sum()) for v in (1, 0)]
            yield pa.record_batch([pa.array(np.append(f, np.uint64(0)).view(np.int64)), *[pa.array(np.append(c, s)) for c, s in zip(n, sums)]], ["feature", "toxic", "clean"])


def _evidence_of(words: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                x = Sentences(part.column(part.schema.get_field_index("text")))
                sent, k = x.pairs(words)
                cut = np.searchsorted(x.row[sent] if len(sent) else sent, np.arange(part.num_rows + 1))
                out = []
                for a, z in zip(cut, cut[1:]):  # a sentence that is repeated in a document is sent once
                    kinds: dict[bytes, int] = {}
                    for one in np.split(k[a:z], np.flatnonzero(np.diff(sent[a:z])) + 1) if z > a else ():
                        key = one.astype("<i4").tobytes()
                        kinds[key] = kinds.get(key, 0) + 1
                    out.append(kinds)
                pack = lambda values, kind: np.array(values, kind).tobytes()
                yield pa.record_batch(
                    [
                        part.column(part.schema.get_field_index("label")),
                        part.column(part.schema.get_field_index("spot")),
                        pa.array([b"".join(d) for d in out], pa.binary()),
                        pa.array([pack([len(s) // 4 for s in d], "<i4") for d in out], pa.binary()),
                        pa.array([pack(list(d.values()), "<i4") for d in out], pa.binary()),
                    ],
                    ["label", "spot", "words", "sizes", "times"],
                )

    return run


def learnable(docs: DataFrame) -> DataFrame:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Model:
    """Train on a bounded sample (SAMPLE documents are expected) of labelled rows outside the held-out fold.

    Words are counted by label in Spark; only those that stand out, and the sentences that
    hold them, reach the driver.
    """
    lab = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    lab = learnable(lab).groupBy("doc_id").agg(F.max("label").alias("label"))
    part = min(1.0, SAMPLE / max(lab.count(), 1))
    some = lab.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", spot("doc_id"), "text")  # about SAMPLE rows of 12 bytes
    counts = known.mapInArrow(_counts, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    counts = written(counts, "toxic-words")
    all_t, all_c = (int(x or 0) for x in counts.where("feature = 0").agg(F.sum("t"), F.sum("c")).first())
    spark = docs.sparkSession
    none = np.zeros(0, np.uint64)
    if not all_t or not all_c:
        drop(spark, counts)
        return Model(none, np.zeros(0), 0.0, 1.0 if all_t else 0.0)
    # toxic documents that hold the word against those expected from the share of toxic ones
    share = all_t / (all_t + all_c)
    t, n = F.col("t"), F.col("t") + F.col("c")
    g = 2 * (t * F.log(t / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0))
    lift = F.log(((t + 0.5) / all_t) / ((F.col("c") + 0.5) / all_c))
    best = counts.where(F.col("feature") != 0).where((t >= LEAST_DOCS) & (t > 2 * share * n)).select("feature", lift.alias("lift"), g.alias("g")).where(F.col("g") >= LEAST_G)
    best = best.orderBy(F.desc("g"), "feature").limit(MOST_WORDS).toArrow()
    drop(spark, counts)
    words = best["feature"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    words, start = words[order], np.clip(best["lift"].to_numpy()[order], 0, 4)
    got = collected(known.mapInArrow(_evidence_of(words), "label int, spot int, words binary, sizes binary, times binary"), "toxic-sentences").to_pylist()
    got.sort(key=lambda r: (r["label"], r["words"], r["sizes"], r["times"]))  # an order that doesn't depend on partitions
    ints = lambda c: np.frombuffer(b"".join([r[c] for r in got]), "<i4").astype(np.int64)
    sizes = ints("sizes")
    idx = ints("words")
    x = Rows(idx, np.ones(len(idx)), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
    doc = np.repeat(np.arange(len(got)), [len(r["sizes"]) // 4 for r in got])
    weight, bias = fit(x, ints("times"), doc, np.array([r["label"] for r in got], np.int64), start)
    return Model(words, weight, bias)


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                x = Sentences(part.column(1))
                p, each = model.score(x, part.num_rows)
                where: dict[int, list[int]] = {}
                for i in np.flatnonzero(each >= TOXIC).tolist():
                    where.setdefault(int(x.row[i]), []).append(i)
                spans = {}
                for r, found in where.items():
                    lo = x.offs[r]
                    a, b = (_scan.code_points(x.buf[lo : x.offs[r + 1]], v[found] - lo) for v in (x.start, x.end))
                    spans[r] = ",".join(f"{i}:{j}" for i, j in zip(a.tolist(), b.tolist()))
                p = np.clip(p, 0, 1)
                yield pa.record_batch([part.column(0), pa.array(p), pa.array((p >= TOXIC).astype(np.int32)), pa.array([spans.get(r, "") for r in range(part.num_rows)])], ["doc_id", "score", "predicted", "sentences"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, predicted, sentences`` of every row.

    ``sentences`` are the spans (``start:end`` in code points, comma-joined) of sentences
    scored 0.7 or more.  A text without words or without evidence scores 0; null texts count
    as empty; repeated rows are each answered, and each row by its own text alone; other
    columns aren't read.  Without labels of both kinds all documents score alike.
    """
    model = train(docs, labels)
    base = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), *T._parse_datatype_string("score double, predicted int, sentences string").fields])
    return base.mapInArrow(_score(model), schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "sentences")

"""Language identification in two levels: family first, then one-versus-one linear support vector machines.

Features are hashed byte trigrams of the lower-cased letters, a blank after each text.  One
machine per family says which family a text belongs to; within a family, one machine per
pair of its languages votes.  Weights are integers (fixed point) that are summed along the
text, so a text of any length takes one pass and constant memory beyond itself, and no sum
depends on the rows beside it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scan
from ._store import collected, spot, table
from .linear import Rows, sigmoid, squared_hinge

DIMS = 1 << 14
#: Documents expected in the training sample of each language, and of all languages together.
SAMPLE, SAMPLE_ALL = 1_500, 12_000
#: Documents expected of each language, however many languages there are.
LEAST = 20
#: Languages of a family that are told apart by pairs; a larger family is cut into parts of at most PART.
MOST_MEMBERS, PART = 16, 8
#: Rows of the table of languages that may be broadcast.
BROADCAST_ROWS = 10_000
#: Steps of a weight of 1.
FIXED = 1 << 16
# Families of languages by ISO 639-1 code; others are families of their own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "semitic": "am ar he mt".split(),
    "indic": "bn gu hi mr ne pa sd si ur".split(),
    "turkic": "az kk ky tk tr uz".split(),
    "uralic": "et fi hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "br cy ga gd".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32
_LOW[:65] = 32
_LOW[91:97] = 32
_LOW[123:128] = 32


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def families_of(langs: list[str]) -> dict[str, list[str]]:
    """Members of each family; languages of no known family are one together where they are many, and large families are cut in parts."""
    groups: dict[str, list[str]] = {}
    for lang in sorted(langs):
        groups.setdefault(family_of(lang), []).append(lang)
    alone = [f for f, members in groups.items() if len(members) == 1]
    if len(alone) > MOST_MEMBERS:
        groups["others"] = sorted(groups.pop(f)[0] for f in alone)
    out = {}
    for f, members in groups.items():
        parts = [members] if len(members) <= MOST_MEMBERS else [members[i : i + PART] for i in range(0, len(members), PART)]
        out |= {f"{f} {n}" if len(parts) > 1 else f: p for n, p in enumerate(parts)}
    return dict(sorted(out.items()))


def trigrams(buf: np.ndarray, offs: np.ndarray | None = None) -> np.ndarray:
    """Hashed trigram that begins at each byte; what is no letter counts as a blank, and so does what follows a row."""
    c = np.concatenate((_LOW[buf], np.full(2, 32, np.uint32)))
    second, third = c[1:-1].copy(), c[2:].copy()
    if offs is not None and len(buf):
        end = offs[1:][offs[1:] > 0]
        second[end - 1] = third[end - 1] = 32
        third[end[end > 1] - 2] = 32
    x = c[:-2] | (second << np.uint32(8)) | (third << np.uint32(16))
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int32)


def row_blocks(buf: np.ndarray, offs: np.ndarray, size: int = 1 << 18):
    """(first byte, trigrams) block by block, as of the whole array."""
    for lo in range(0, len(buf), size):
        hi = min(len(buf), lo + size)
        near = offs[(offs > lo) & (offs <= hi + 2)] - lo
        yield lo, trigrams(buf[lo : hi + 2], np.concatenate(([0], near)))[: hi - lo]


def has_letter(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


class Model:
    """``machines``: rows of weights; the first are one per family, then one per pair of languages within a family."""

    def __init__(self, families: dict[str, list[str]], pairs: list[tuple[str, str]], weight: np.ndarray, bias: np.ndarray):
        self.families, self.pairs = families, pairs
        self.weight, self.bias = np.ascontiguousarray(np.round(weight.T * FIXED), np.int32), bias
        self.members = list(families.values())
        of = {lang: f for f, members in enumerate(self.members) for lang in members}
        self.own: list[list[tuple[int, str, str]]] = [[] for _ in self.members]  # machines of each family's pairs
        for j, (a, b) in enumerate(pairs, len(families) if len(families) > 1 else 0):
            self.own[of[a]].append((j, a, b))

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n, m = len(offs) - 1, self.weight.shape[1]
        out = np.zeros((n, m), np.int64)
        if m:
            for lo, t in row_blocks(buf, offs, max(1 << 12, min(1 << 18, (1 << 22) // m))):  # long texts and many machines need no more memory
                hi = lo + len(t)
                a = int(np.searchsorted(offs, lo, "right")) - 1
                z = int(np.searchsorted(offs, hi, "left"))
                cut = np.clip(offs[a:z], lo, hi) - lo
                some = np.flatnonzero(np.diff(np.append(cut, hi - lo)) > 0)
                out[a + some] += np.add.reduceat(self.weight[t], cut[some], axis=0, dtype=np.int64)
        return out / (np.maximum(np.diff(offs), 1)[:, None] * float(FIXED)) + self.bias

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score: the chance of the family times that of winning its votes."""
        n = len(margins)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        k = len(self.families)
        fam = sigmoid(4 * margins[:, :k]) if k > 1 else np.ones((n, 1))
        fam = fam / fam.sum(1, keepdims=True)
        best = fam.argmax(1)
        names, score = np.full(n, "", object), fam[np.arange(n), best]
        for f, members in enumerate(self.members):
            at = np.flatnonzero(best == f)
            votes, sure = np.zeros((len(at), len(members))), np.zeros((len(at), len(members)))
            for j, a, b in self.own[f]:
                p = sigmoid(4 * margins[at, j])
                i, o = members.index(a), members.index(b)
                votes[:, i] += p >= 0.5
                votes[:, o] += p < 0.5
                sure[:, i] += p
                sure[:, o] += 1 - p
            won = (votes * 1000 + sure).argmax(1) if len(at) else at
            names[at] = np.array(members, object)[won] if len(members) else "und"
            if len(members) > 1:
                score[at] *= sure[np.arange(len(at)), won] / (len(members) - 1)
        return names.tolist(), score


def _machine(x: Rows, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of one machine, trained on the features that its rows have (others stay 0)."""
    some, idx = np.unique(x.idx, return_inverse=True)
    w = squared_hinge(Rows(idx, x.val, x.at), y, len(some))
    out = np.zeros(DIMS + 1, np.float32)
    out[some], out[-1] = w[:-1], w[-1]
    return out


def fit(x: Rows, lang: np.ndarray, scale: float = 1.0) -> Model:
    """Machines on rows whose values are ``scale`` times relative frequencies."""
    families = families_of(sorted(set(lang.tolist())))
    of = {v: f for f, members in families.items() for v in members}
    own = np.array([of[v] for v in lang], object)
    rows_of = {v: np.flatnonzero(lang == v) for v in of}
    machines, pairs = [], []
    if len(families) > 1:
        machines += [_machine(x, np.where(own == f, 1.0, -1.0)) for f in families]
    for members in families.values():
        for a, b in combinations(members, 2):
            rows = np.sort(np.concatenate((rows_of[a], rows_of[b])))
            machines.append(_machine(x.take(rows), np.where(lang[rows] == a, 1.0, -1.0)))
            pairs.append((a, b))
    w = np.stack(machines) if machines else np.zeros((0, DIMS + 1))
    return Model(families, pairs, w[:, :-1] * scale, w[:, -1])


def _features(batches):
    for batch in batches:
        for part in _scan.slices(batch, "text"):
            buf, offs = _scan.buffers(part.column(part.schema.get_field_index("text")))
            idx, val = [], []
            for a, b in zip(offs, offs[1:]):
                n = np.zeros(DIMS, np.int64)
                for _, t in row_blocks(buf[a:b], np.array([0, b - a])):
                    n += np.bincount(t, minlength=DIMS)
                some = np.flatnonzero(n)
                idx.append(some.astype("<i2").tobytes())
                val.append((n[some] / max(n.sum(), 1)).astype("<f4").tobytes())
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in ("lang", "spot")), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["lang", "spot", "idx", "val"])


def train(docs: DataFrame) -> Model:
    """Train on a bounded sample: SAMPLE documents are expected of each language, SAMPLE_ALL of all, but LEAST of each; text and language alone are read, texts whole.

    Every language of the sample is learnt.  The model has about PART / 2 machines of DIMS
    weights (64 KB) for each language, so its size grows with the languages, not with the rows.
    """
    base = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    base = base.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 4 != 2)
    n = base.groupBy("lang").agg(F.count("*").alias("n"))
    kinds = n.count()
    share = float(min(SAMPLE, max(LEAST, SAMPLE_ALL / max(kinds, 1))))
    part = n.select("lang", F.least(F.lit(1.0), F.lit(share) / F.col("n")).alias("part"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = base.join(F.broadcast(part) if kinds <= BROADCAST_ROWS else part, "lang").where(place < F.col("part")).select("lang", spot("doc_id"), "text")
    got = collected(drawn.mapInArrow(_features, "lang string, spot int, idx binary, val binary"), "languages").to_pylist()
    got = sorted((r["lang"], r["idx"], r["val"]) for r in got)  # an order that doesn't depend on partitions
    at = np.concatenate(([0], np.cumsum([len(i) // 2 for _, i, _ in got]))).astype(np.int64)
    x = Rows(np.frombuffer(b"".join([i for _, i, _ in got]), "<i2"), np.frombuffer(b"".join([v for _, _, v in got]), "<f4") * np.float32(30), at)
    return fit(x, np.array([v for v, _, _ in got], object), 30)


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                texts = part.column(1)
                letters = has_letter(texts)
                names, score = model.predict(model.margins(*_scan.buffers(texts)))
                names = [x if ok else "und" for x, ok in zip(names, letters)]
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` with score 0 for a null text or one without a letter.

    Learns from the rows of ``docs`` that have a language and lie outside the held-out fold
    (crc32 of the id as text, modulo 4, is 2; a null id is outside).  Without any such row
    everything is ``und``.  Repeated rows are each answered, and each row's answer depends on
    its own text alone; other columns than ``doc_id, text, lang`` aren't read.
    """
    model = train(docs)
    base = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), *T._parse_datatype_string("lang_pred string, score double").fields])
    return base.mapInArrow(_score(model), schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    out = languages(table(spark, sf_dir, "documents"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")

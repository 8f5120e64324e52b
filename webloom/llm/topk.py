"""Exact top-k search by inner product: Fagin's threshold algorithm on sorted per-dimension lists.

Candidates are dealt into blocks; a block keeps, per dimension, its vectors sorted by that
component.  All lists are walked together from both ends (a query prefers the end that its
sign says), so the vectors met by some depth are the same for every query: the block is laid
out in that order, and a group of queries scores each further stretch of it at once.  A query
stops when the threshold - the sum of its components times the values at the depth reached -
is below its kth score.  The kth score is known from the start: each query first meets the
longest vectors, and what it finds there bounds it in every block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import drop, table, written

#: Vectors of a block, least vectors of one (there are blocks for every core first), and queries that walk it in one call.
BLOCK, LEAST_BLOCK, QUERIES = 32_768, 4_096, 16_384
#: Longest vectors that bound the kth score of each query before the blocks are walked.
FIRST = 2_048
#: First depth of a walk (each round goes to twice the depth), queries that walk together, and vectors that they score at once.
DEPTH, TOGETHER, STRETCH = 64, 256, 8_192
#: Components and sums that floats hold exactly.
SMALL, EXACT32, EXACT64 = 1 << 20, 1 << 24, 1 << 53
_MOST = (1 << 63) - 1


def _dense(col, dims: int) -> np.ndarray:
    """Vectors (whole numbers in doubles) as a matrix; shorter ones are padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten(), np.float64)
    out = np.zeros((len(col), dims))
    out[np.repeat(np.arange(len(col)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles as Python integers, which have no end."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class Lists:
    """The sorted lists of one block of vectors whose scores floats hold exactly."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray):
        up = np.argsort(vec, axis=0, kind="stable")  # column d: rows by ascending component d
        n = len(ids)
        met = np.full(n, n)  # the depth at which a vector is met first, from either end of any list
        depth = np.minimum(np.arange(n), np.arange(n)[::-1])
        for d in range(vec.shape[1]):
            met[up[:, d]] = np.minimum(met[up[:, d]], depth)
        order = np.lexsort((ids, met))
        self.ids, self.vec = ids[order], vec[order]
        stops, at = [], DEPTH
        while at < (n + 1) // 2:
            stops.append(at)
            at *= 2
        self.ends = [*np.searchsorted(met[order], stops).tolist(), n]  # vectors met by each depth
        self.low = [vec[up[s, range(vec.shape[1])], range(vec.shape[1])] for s in stops]  # what the next ones have at least, and at most
        self.high = [vec[up[n - 1 - s, range(vec.shape[1])], range(vec.shape[1])] for s in stops]
        self.most = float(np.abs(vec).max(initial=0))
        self.kept: dict = {}

    def top(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all that may be among the k best of each query; ``floor``: a score that its kth one reaches."""
        bound = self.most * float(np.abs(q).sum(1).max(initial=0))
        kind = np.float32 if bound < EXACT32 else np.float64
        vec = self.kept.setdefault(kind, self.vec.astype(kind, copy=False))
        w, kth = q.astype(kind), floor.copy()
        live, at, found = np.arange(len(q)), 0, []
        for nth, end in enumerate(self.ends):
            for lo in range(at, end, STRETCH):
                hi = min(lo + STRETCH, end)
                score = w[live] @ vec[lo:hi].T
                score[own[live][:, None] == self.ids[None, lo:hi]] = -np.inf  # a query's own row is no candidate
                many = np.flatnonzero((score >= kth[live][:, None]).sum(1) > k)
                if len(many):  # the kth score of these bounds it as well
                    part = np.partition(score[many], hi - lo - k, axis=1)[:, hi - lo - k]
                    kth[live[many]] = np.maximum(kth[live[many]], part)
                i, j = np.nonzero((score >= kth[live][:, None]) & (score > -np.inf))
                found.append((live[i], lo + j, score[i, j].astype(np.float64)))
            if nth < len(self.low):
                edge = np.maximum(q[live], 0) @ self.high[nth] + np.minimum(q[live], 0) @ self.low[nth]
                live = live[edge >= kth[live]]  # below it, nothing unseen can tie
            at = end
            if not len(live):
                break
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, s = (np.concatenate([f[x] for f in found]) for x in range(3))
        keep = s >= kth[i]
        return i[keep], j[keep], s[keep]


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query i: by score, ties by id."""
    order = np.lexsort((ids, -score, i))
    first = np.flatnonzero(np.concatenate(([True], np.diff(i[order]) > 0))) if len(i) else np.zeros(0, np.int64)
    nth = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    return order[nth < k]


def _over(score: int) -> str:
    """A key that sorts as the scores do that a long can't hold."""
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score > 0 else f"0{9999 - len(digits):04d}" + "".join(chr(105 - ord(c)) for c in digits)


def _plain(q: np.ndarray, own: np.ndarray, floor: np.ndarray, ids: np.ndarray, vec: np.ndarray, k: int) -> tuple:
    """Exact scores of a few vectors that floats can't add up: (query, id, score, key)."""
    whole, out = _whole(vec), ([], [], [], [])
    for n in range(len(q)):
        scores = whole @ _whole(q[n])
        some = [(-s, v) for s, v in zip(scores.tolist(), ids.tolist()) if v != own[n] and s >= floor[n]]
        for s, v in sorted(some)[:k]:
            for o, x in zip(out, (n, v, max(-_MOST - 1, min(_MOST, -s)), _over(-s) if abs(s) >= _MOST else None)):
                o.append(x)
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.int64), out[3]


def _walk(k: int):
    def run(key, queries: pa.Table, block: pa.Table) -> pa.Table:
        parts = []
        if len(queries) and len(block):
            dims = max(int(np.diff(np.asarray(t["v"].combine_chunks().offsets)).max(initial=0)) for t in (queries, block))
            q, own = _dense(queries["v"], dims), queries["query_id"].to_numpy()
            floor = queries["floor"].fill_null(-np.inf).to_numpy() if "floor" in queries.column_names else np.full(len(q), -np.inf)
            ids, vec = block["vec_id"].to_numpy(), _dense(block["v"], dims)
            # a few vectors of enormous components are scored apart
            big, wide = (np.abs(x).max(1, initial=0) > SMALL for x in (vec, q))
            if dims * float(SMALL) ** 2 >= EXACT64:
                limit = (EXACT64 / max(dims, 1)) ** 0.5
                big, wide = (np.abs(x).max(1, initial=0) >= limit for x in (vec, q))
            lists = Lists(ids[~big], vec[~big])
            tame = np.flatnonzero(~wide)
            for lo in range(0, len(tame) if len(lists.ids) else 0, TOGETHER):
                at = tame[lo : lo + TOGETHER]
                i, j, s = lists.top(q[at], own[at], k, floor[at])
                keep = _best(i, lists.ids[j], s, k)
                parts.append((own[at][i[keep]], lists.ids[j[keep]], s[keep].astype(np.int64), [None] * len(keep)))
            for rows, cols in ((wide, np.ones(len(vec), bool)), (~wide, big)):
                if rows.any() and cols.any():
                    i, v, s, over = _plain(q[rows], own[rows], floor[rows], ids[cols], vec[cols], k)
                    parts.append((own[rows][i], v, s, over))
        cols = [np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in cols] + [pa.array([x for p in parts for x in p[3]], pa.string())], ["query_id", "vec_id", "score", "over"])

    return run


def integer_vectors(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` with floor(scale * x) of each component, a whole number in a double, without a limit.

    Vectors that are null or hold a null, NaN or infinity (also one that scaling makes) are
    left out, and so are null ids.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    down = lambda y: F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)  # noqa: E731  floor() of Spark ends at the range of a long
    return rows.select("vec_id", F.transform("x", lambda x: down(x * scale)).alias("v"))


_FOUND = "query_id long, vec_id long, score long, over string"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of greatest inner product with each query.

    Both tables have ``vec_id, v`` (array<double> of whole numbers).  A query's own id is no
    candidate of its; ties go to the smaller id; fewer candidates than k are all returned.
    Shorter vectors count as padded with zeros.  Scores are exact integers of any size and
    rank as such; one that a long can't hold is reported as the greatest or least long.
    Repeated candidate rows are each candidates; of repeated query ids one row is asked (the
    least vector).  Each block meets the queries in groups, so no task holds more than a
    block and a group.  Empty tables give no rows; other columns aren't read.
    """
    spark = queries.sparkSession
    n, m = candidates.count(), queries.count()
    cores = spark.sparkContext.defaultParallelism
    blocks, groups = max(1, -(-n // BLOCK), min(cores, -(-n // LEAST_BLOCK))), max(1, -(-m // QUERIES))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    q = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("g", deal("query_id", groups))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))
    longest = candidates.select("vec_id", "v").orderBy(F.desc(length), "vec_id").limit(FIRST)
    seeds = longest.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    near = q.groupBy("g").cogroup(seeds.groupBy("g")).applyInArrow(_walk(k), _FOUND)
    # the kth score of the first ones; a score that a long can't hold bounds nothing
    floor = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor"), F.max("over").alias("over"))
    floor = floor.where((F.col("n") >= k) & F.col("over").isNull() & (F.abs("floor") < float(EXACT64))).select("query_id", "floor")
    asked = written(q.join(floor, "query_id", "left").select("query_id", "v", "g", "floor"), "queries")
    each = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a vector that is repeated very often must not fill one block
    spot = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    c = candidates.select("vec_id", "v", spot.alias("b")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = each.groupBy("b", "g").cogroup(c.groupBy("b", "g")).applyInArrow(_walk(k), _FOUND)
    out = written(_ranked(found, k).select("query_id", "rank", "vec_id", "score"), "top-k")
    drop(spark, asked)
    return out


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    v = integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top_k(v.where(F.pmod("vec_id", F.lit(20)) == 0), v)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

"""Centroid clustering of integer vectors, exact, by partial-distance search.

Each task compares its vectors with all centroids over the dimensions of greatest variance
first.  The centroid that is nearest so far is measured in full, and that distance bounds the
others: one whose partial sum is strictly above it is abandoned, survivors go on stretch by
stretch to the last dimension.  Sums of squares are whole numbers throughout.  Vectors are
never shuffled: a round moves one row of sums for each task, cluster and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, table, written

#: Dimensions, scale, centroids, rounds and seed of the query.
DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Dimensions of a stretch, and vectors measured at once.
STRETCH, ROWS = 16, 2_048
#: Components up to which 64-bit sums of squares are exact; beyond it Python's integers are used.
TAME = 1 << 26
#: Bits of a limb in which sums of any size travel.
LIMB = 40
_MOST = (1 << 63) - 1


def _integers(col: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, as whole numbers in doubles, and rows beyond TAME."""
    x = np.floor(np.asarray(col.flatten(), np.float64).reshape(-1, dims) * scale)
    return x, np.abs(x).max(1, initial=0) > TAME


def _whole(x) -> list[list[int]]:
    return [[int(v) for v in row] for row in x]


class Nearest:
    """The nearest of some centroids (lists of integers), ties to the smaller number."""

    def __init__(self, centroids: list[list[int]], order: np.ndarray, stretch: int = STRETCH):
        tame = [n for n, c in enumerate(centroids) if max(map(abs, c), default=0) <= TAME]
        self.all, self.order, self.stretch = centroids, order, stretch
        self.number = np.array(tame, np.int64)
        self.wild = [n for n in range(len(centroids)) if n not in set(tame)]
        self.c = np.array([centroids[n] for n in tame], np.int64).reshape(len(tame), len(order))[:, order]
        self.finished = 0  # pairs that went through all dimensions

    def _exact(self, row: list[int], numbers: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(row, self.all[n])), n) for n in numbers)

    def of(self, x: np.ndarray, wild: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row; distances are Python integers where they must be."""
        out, far = np.zeros(len(x), np.int64), np.zeros(len(x), object if wild.any() or self.wild else np.int64)
        tame = np.flatnonzero(~wild)
        if len(self.number):
            for lo in range(0, len(tame), ROWS):
                at = tame[lo : lo + ROWS]
                out[at], far[at] = self._search(x[at].astype(np.int64)[:, self.order])
        if self.wild or wild.any():
            for i, row in enumerate(_whole(x)):
                if wild[i] or not len(self.number):
                    far[i], out[i] = self._exact(row, range(len(self.all)))
                elif self.wild:
                    far[i], out[i] = min((int(far[i]), int(out[i])), self._exact(row, self.wild))
        return out, far

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, dims, step = len(x), x.shape[1], self.stretch
        part = np.zeros((n, len(self.c)), np.int64)
        for d in range(min(step, dims)):
            gap = x[:, d, None] - self.c[None, :, d]
            part += gap * gap
        near = part.argmin(1)  # nearest so far: its full distance bounds the others
        rest = x[:, step:] - self.c[near, step:]
        best = part[np.arange(n), near] + (rest * rest).sum(1)
        i, j = np.nonzero(part <= best[:, None])
        sums = part[i, j]
        for lo in range(step, dims, step):
            gap = x[i, lo : lo + step] - self.c[j, lo : lo + step]
            sums += (gap * gap).sum(1)
            keep = sums <= best[i]  # strictly above it: abandoned
            i, j, sums = i[keep], j[keep], sums[keep]
        self.finished += len(i)
        first = np.searchsorted(i, np.arange(n))  # each row keeps one at least
        best = np.minimum.reduceat(sums, first) if n else sums
        hit = np.flatnonzero(sums == best[i])
        rows, at = np.unique(i[hit], return_index=True)  # the first hit of a row has its smallest number
        return self.number[j[hit[at]]], best[rows]


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """(limb, part) of a sum of any size; parts add up limb by limb."""
    sign, total, n = (-1 if total < 0 else 1), abs(total), 0
    while total:
        yield n, sign * (total & ((1 << LIMB) - 1))
        total, n = total >> LIMB, n + 1


def _sums(near: Nearest, dims: int, scale: int):
    """Per task: rows of each cluster (dim -1) and sums of each of their dimensions, in limbs."""

    def run(batches):
        totals: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            x, wild = _integers(b.column("v"), dims, scale)
            which = near.of(x, wild)[0]
            for c in np.unique(which).tolist():
                own = which == c
                for kind, rows in (("tame", x[own & ~wild].astype(np.int64)), ("wild", np.array(_whole(x[own & wild]), object).reshape(-1, dims))):
                    if len(rows):
                        have = totals.setdefault(c, [0] * (dims + 1))
                        for d, s in enumerate(rows.sum(0).tolist()):
                            have[d] += int(s)
                        have[dims] += len(rows)
        out = [(c, d if d < dims else -1, limb, part) for c, have in totals.items() for d, s in enumerate(have) for limb, part in _limbs(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "limb", "total"])

    return run


def _variance(dims: int, scale: int):
    """Per task: rows, sums and sums of squares of each dimension, of vectors within TAME."""

    def run(batches):
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            x, wild = _integers(b.column("v"), dims, scale)
            x = x[~wild]  # the order of dimensions is a matter of speed only
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, float(n))), pa.array(s), pa.array(q)], ["dim", "n", "s", "q"])

    return run


def _labels(near: Nearest, dims: int, scale: int):
    def run(batches):
        for b in batches:
            which, far = near.of(*_integers(b.column("v"), dims, scale))
            far = far if far.dtype != object else np.array([min(int(v), _MOST) for v in far], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(which, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def kept_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (array<double>) of vectors with exactly ``dims`` components, all finite (also when scaled)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dims)
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))))


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """Integers of the k vectors whose ids hash lowest (ties: the lesser vector; null ids are no candidates); k rows reach the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").orderBy(h, "v").limit(k).collect()
    return _whole([np.floor(np.array(r["v"], np.float64) * scale) for r in found])


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector with ``dims`` finite components.

    Other vectors (null, shorter, longer, with a null, NaN or infinity) take no part; a null
    id takes part but is no first centroid; repeated rows count as often as they occur.  Fewer
    vectors (with an id) than ``k`` make fewer clusters, none give no rows.  Distances and sums are exact at
    any size; one that a long can't hold is reported as the greatest long.  A round reads the
    vectors once and brings k * dims sums to the driver; other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, dims, scale)
    centroids = first_centroids(rows, k, seed, scale)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        none = spark.createDataFrame([], schema)
        return none.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    spread = rows.mapInArrow(_variance(dims, scale), "dim int, n double, s double, q double").groupBy("dim").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()
    variance = np.zeros(dims)
    for d, n, s, q in spread:
        variance[d] = q / n - (s / n) ** 2 if n else 0.0
    order = np.argsort(-variance, kind="stable")
    for _ in range(rounds):
        told = rows.mapInArrow(_sums(Nearest(centroids, order), dims, scale), "cluster int, dim int, limb int, total long")
        sums: dict[tuple[int, int], int] = {}
        for c, d, limb, total in told.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
            sums[c, d] = sums.get((c, d), 0) + (int(total) << (LIMB * limb) if total >= 0 else -(int(-total) << (LIMB * limb)))
        centroids = [[sums.get((c, d), 0) // sums[c, -1] for d in range(dims)] if (c, -1) in sums else old for c, old in enumerate(centroids)]
    got = written(rows.mapInArrow(_labels(Nearest(centroids, order), dims, scale), schema), "clusters")
    inertia = {c: int(s) for c, s in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = [(c, min(s, _MOST), min(sum(inertia.values()), _MOST), digest[c]) for c, s in inertia.items()]
    per = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    out = [
        """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < 40)"""
    ]
    for n in range(ROUNDS + 1):
        out.append(
            f"""a{n} AS MATERIALIZED (
  SELECT place, vec_id, v, cluster, distance FROM (
    SELECT *, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance FROM kept, c{n})
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY distance, cluster) = 1)"""
        )
        if n < ROUNDS:
            out.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN (
    SELECT cluster, list(floor_mean ORDER BY i) AS c FROM (
      SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
      FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{n}) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
            )
    return ",\n".join(out) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)
"""


OP11_SQL = _sql()

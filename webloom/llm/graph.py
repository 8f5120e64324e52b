"""Connected components of an edge table, in blocks and then by alternating stars; nothing reaches the driver but counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scan
from ._store import drop, written

#: Edges of a block that one task connects (16 bytes each).
BLOCK_EDGES = 500_000


def least_reached(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least place that each of n places reaches by pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _block(batches):
    """``u, v``: every node of the edges of this block but the roots, and the root that it reaches here."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if parts:
        nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
        at = at.reshape(2, -1)
        root = nodes[least_reached(at[0], at[1], len(nodes))]
        keep = root != nodes
        yield pa.record_batch([pa.array(nodes[keep]), pa.array(root[keep])], ["u", "v"])
    _scan.trim()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the least node reachable.

    Blocks of edges are connected within a task first, which is all there is to do where one
    block holds the graph, and else leaves paths that are short.  Then each round hooks
    larger neighbours to the least one (large star), and smaller neighbours likewise (small
    star).  Sums and minima combine before the shuffle, joins are on node ids, so that
    Spark's skew join splits a hub.  Self loops and repeated edges are allowed; null ends are
    ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    first = written(e, "edges")
    blocks = -(-first.count() // BLOCK_EDGES)
    e = written(first.repartition(max(1, blocks)).mapInArrow(_block, "u long, v long"), "edges")
    drop(spark, first)
    mark = None
    while blocks > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = written(low.select("u", F.col("m").alias("v")).unionByName(hooked).distinct(), "edges")
        now = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        drop(spark, e)
        e = new
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

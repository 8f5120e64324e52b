import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from webloom.llm import centroids as C
from webloom.llm import digest_index as D
from webloom.llm import resample as R


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def drawn(docs, target, percent=25, least=20, buckets=10_000, runs=2, seed=7):
    """Plain Python over rows (doc_id, text)."""

    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    counts = []
    for texts in ([t for _, t in docs], target):
        counts.append([0] * buckets)
        for t in texts:
            for b in feats(t)[1]:
                counts[-1][b] += 1
    s_all, t_all = map(sum, counts)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(*counts)]
    rows = []
    for i, t in docs:
        n, f = feats(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n >= least, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], -1 if r[1] is None else r[1]))
    most = len(able) * percent // 100
    return sorted([(r[1], r[2], r[3], r[4], k + 1 if k < most else None) for k, r in enumerate(able)] + [(*r[1:], None) for r in rows if not r[0]], key=repr)


@pytest.mark.parametrize("runs,least", [(2, 20), (3, 1)])
def test_resampling(spark, odd_docs, runs, least):
    docs = odd_docs.select("doc_id", "text", F_lit("clash").alias("bucket"), F_lit(1).alias("w"), F_lit(2).alias("at"))
    many = [(100 + i, " ".join(f"w{(i * k) % 37}" for k in range(1, 40))) for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame([(*r, "x", 1, 2) for r in many], docs.schema)).repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 the quick brown",), (None,), ("",)], "text string")
    got = R.resampled(docs, target, percent=40, least=least, runs=runs).collect()
    want = drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent=40, least=least, runs=runs)
    assert sorted([tuple(r) for r in got], key=repr) == want
    assert sum(r.rank is not None for r in got) > 10
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.resampled(empty, target).count() == 0
    assert {r.weight for r in R.resampled(docs.where("text is null"), empty).collect()} == {0}


def test_resampling_ties(spark):
    docs = spark.createDataFrame([(5, "a b c")] * 4 + [(6, "a b c")] * 4, "doc_id long, text string").repartition(4)
    got = R.resampled(docs, docs, percent=50, least=1).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4] and len({r.doc_id for r in got if r.rank}) == 1


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_exact_dedup(spark, odd_docs, tmp_path):
    docs = odd_docs.withColumn("digest", odd_docs.text).withColumn("at", odd_docs.doc_id)
    docs = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(20 + i, "hot", None, None, None, None, "hot", i) for i in range(500)], docs.schema)).repartition(7)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    for steps in (1, 3):
        index = D.DigestIndex(spark, f"file://{tmp_path}/index{steps}", 5)
        got = D.exact_dedup(docs, index, steps).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == sorted((i, best[t], len(groups[t]), sha(t)) for i, t in rows if i is not None)
        assert len(got) == len(rows)
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
        # a batch that comes later meets the index again, also from another session's point of view
        again = D.DigestIndex(spark.newSession(), f"file://{tmp_path}/index{steps}")
        assert again.buckets == 5 and again.read().count() == len(groups)
        more = spark.createDataFrame([(1000, "hot"), (1001, "new"), (1002, "new"), (1003, None)], "doc_id long, text string")
        later = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in D.exact_dedup(more, index).collect()}
        assert later == {1000: (519, 1, False), 1001: (1002, 2, False), 1002: (1002, 2, True), 1003: (4, 1, False)}
        assert D.DigestIndex(spark, f"file://{tmp_path}/index{steps}").read().count() == len(groups) + 1
    assert D.exact_dedup(docs.limit(0), D.DigestIndex(spark, f"file://{tmp_path}/none", 3), 2).count() == 0


def test_index_is_not_shuffled(spark, tmp_path):
    index = D.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    rows = spark.range(1000).selectExpr("id as doc_id", "unhex(sha2(cast(id as string), 256)) as digest", "id as at")
    index.append(D._groups(rows), "a")
    index.append(D._groups(rows), "a")  # a batch that is repeated adds nothing
    assert index.read().count() == 1000
    plan = index.unseen(D._groups(rows))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert plan.count("Exchange hashpartitioning(digest") == 1  # that of the new digests


def clusters(rows, k, rounds, dims, scale=256, seed=2):
    """Plain Python over (vec_id, components)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c[n] for n in range(len(c))]
    found = [(i, *near(v)) for i, v in kept]
    most = (1 << 63) - 1
    inertia = {n: min(most, sum(min(most, d) for _, d, m in found if m == n)) for _, _, n in found}
    return sorted([(i, n, min(d, most), inertia[n], min(most, sum(min(most, d) for _, d, _ in found)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found], key=repr)


@pytest.mark.parametrize("huge", [False, True])
def test_centroids(spark, huge):
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=8) * r.choice([0.01, 1, 3])).tolist()) for i in range(300)] + [(7, [0.5] * 8)] * 50
    rows += [(400, None), (401, []), (402, [1.0] * 7), (403, [1.0] * 9), (404, [1.0] * 7 + [None]), (405, [float("nan")] * 8), (406, [float("inf")] + [0.0] * 7), (None, [0.25] * 8), (408, [0.0] * 8), (409, [-0.0] * 8)]
    if huge:
        rows += [(500, [1e30] + [0.0] * 7), (501, [-(2.0**40)] * 8), (502, [1e300] * 8), (503, [3e5] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int").repartition(6)
    for k in (1, 12, 500):
        got = C.clustered(df, k=k, rounds=3, dims=8)
        assert sorted([tuple(x) for x in got.collect()], key=repr) == clusters(rows, k, 3, 8)
    assert C.clustered(df.limit(0)).count() == 0 and C.clustered(df.limit(0)).columns == got.columns
    assert C.clustered(df.where("vec_id is null"), dims=8).count() == 0  # nothing to start from


def test_partial_distances():
    r = np.random.default_rng(5)
    spread = np.array([900] * 4 + [20] * 60)
    centres = (r.normal(size=(40, 64)) * spread).astype(np.int64)
    x = np.floor(centres[r.integers(0, 40, 3000)] + r.normal(size=(3000, 64)) * 15)
    near = C.Nearest(centres.tolist(), np.argsort(-x.var(0), kind="stable"))
    which, far = near.of(x, np.zeros(len(x), bool))
    full = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (which == full.argmin(1)).all() and (far == full.min(1)).all()
    assert near.finished < 1.1 * len(x)  # of 40 centroids a row, nearly all but the nearest are abandoned
    same = C.Nearest([[1, 1], [1, 1], [3, 3]], np.array([0, 1]), stretch=1)  # ties go to the smaller number
    assert same.of(np.array([[1.0, 1.0], [2.0, 2.0]]), np.zeros(2, bool))[0].tolist() == [0, 0]

import random
import re

import numpy as np
import pytest

from webloom.llm import ngram_join as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, k, percent):
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        group = [x for x, _ in (docs[j] for j in range(len(docs)) if find(j) == find(i)) if x is not None]
        out.append((d, len(sets[i]), (min(group) if group else None) if sets[i] else d))
    return sorted(out, key=str)


def corpus():
    """Chains of edits, exact copies, a shared passage, short texts."""
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    docs, shared = [], [r.choice(vocab) for _ in range(60)]
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 9, 20, 60, 150, 400]))]
        if g % 3 == 0:
            base = shared + base
        for _ in range(r.choice([1, 2, 6, 14])):
            docs.append(" ".join(base))
            if r.random() < 0.7:  # each is an edit of the one before
                base = list(base)
                base[r.randrange(len(base))] = r.choice(vocab)
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_as_brute_force(spark, k, percent):
    docs = corpus()
    got = N.ngram_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs, k, percent)


def test_blocks_of_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 3)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    docs = corpus()[:80]
    got = N.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs, 3, 90)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = N.ngram_join(odd_docs, 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)
    assert N.ngram_join(odd_docs.limit(0), 3, 90).count() == 0


def test_tree_bound_keeps_all_links():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = r.integers(0, 1 << 54, r.integers(5, 300), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.append(base[: int(len(base) * 0.97)], r.integers(0, 1 << 54, 2, dtype=np.uint64)))]
    s = N.Sets.__new__(N.Sets)
    s.at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    s.hash, s.row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    tree = N.RTree(s.counts(), s.sizes())
    i, j = tree.join(tree, 80)
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    assert len(found) == len(i) < 40 * 79  # each pair once, and unlike sets are kept apart
    left, right = N.RTree(s.counts()[:50], s.sizes()[:50]), N.RTree(s.counts()[50:], s.sizes()[50:])
    i, j = left.join(right, 80)
    assert {frozenset(p) for p in zip(i.tolist(), (j + 50).tolist())} == {p for p in found if min(p) < 50 <= max(p)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert frozenset((a, b)) in found


def links(docs, k, percent):
    """Number of other shingle sets that each document's own set links to."""
    sets = [shingle_set(t, k) for _, t in docs]
    other = set(sets) - {frozenset()}
    return {d: sum(1 for o in other if o != s and 100 * len(s & o) >= percent * len(s | o)) if s else 0 for (d, _), s in zip(docs, sets)}


@pytest.mark.parametrize("leaf,block,columns", [(2048, 1_000_000, 1024), (7, 3_000, 16)])
def test_links_as_brute_force(spark, monkeypatch, leaf, block, columns):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("COLUMNS", columns)):
        monkeypatch.setattr(N, name, value)
    r = random.Random(8)
    base = [f"v{i}" for i in range(150)]
    near = [" ".join(w if i != e else f"x{e}" for i, w in enumerate(base)) for e in r.sample(range(150), 40)]
    docs = list(enumerate([t for _, t in corpus()] + near + near[:3] + ["", "two words"]))
    got = N.ngram_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 90)
    assert {x.doc_id: x.n_links for x in got.collect()} == links(docs, 3, 90)


@pytest.mark.parametrize("block", [500_000, 7])
def test_components(spark, monkeypatch, block):
    """Chains, stars, loops and repeated edges, in one block and across many."""
    from webloom.llm import graph as G

    monkeypatch.setattr(G, "BLOCK_EDGES", block)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(20)] + [(r.randrange(900, 930), r.randrange(900, 930)) for _ in range(18)] + [(3, 3), (None, 4), (7, None), (-5, 8), (8, -5)]
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = G.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(root.items())
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0

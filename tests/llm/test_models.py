import zlib

import duckdb
import numpy as np
import pytest

from webloom.llm import language as L
from webloom.llm import quality as Q
from webloom.llm import topk as K
from webloom.llm import toxicity as X
from webloom.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def tables(spark, *names):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in names]


def test_quality(spark, odd_docs):
    docs, labels = tables(spark, "documents", "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = Q.quality_scores(docs, labels.where("doc_id % 3 > 0")).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.doc_id % 3 == 0]) > 0.9
    assert Q.quality_scores(odd_docs, labels).count() == odd_docs.count()
    assert Q.kept_good(docs, labels).columns == docs.columns
    assert {r.predicted for r in Q.quality_scores(odd_docs, labels.limit(0)).collect()} == {1}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_as_brute_force(spark, odd_docs):
    """Pseudo-labels and scores row by row, by plain dictionaries of features."""
    import pyarrow as pa

    docs, labels = tables(spark, "documents", "labels")
    docs = Q._documents(docs.limit(60).unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))).withColumn("bag", docs.doc_id * 0)
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "cast(pmod(coalesce(doc_id, 0), 4) as int) as bag").repartition(3)
    r = np.random.default_rng(1)
    w = [np.append(r.normal(size=d) * 9, 0.1).astype(np.float32) for d in (Q.DIMS, Q.META_DIMS)]

    def views(row):
        x = Q.TextView.rows(pa.array([row.text], pa.string())), Q.MetaView.rows([row.lang], [row.source], [row.n_chars])
        return [dict(zip(v.idx.tolist(), v.val.tolist())) for v in x]

    logit = lambda v, w: sum(float(w[i]) * x for i, x in v.items()) + float(w[-1])
    want = {}
    for row in docs.collect():
        v = views(row)
        p = [1 / (1 + np.exp(-logit(a, b))) for a, b in zip(v, w)]
        for view in (0, 1):
            if p[1 - view] >= Q.CONFIDENT or p[1 - view] <= 1 - Q.CONFIDENT:
                cell = int(p[1 - view] >= Q.CONFIDENT) * Q.BAGS + row.bag
                want[view, cell, -1] = want.get((view, cell, -1), 0) + 1
                for i, x in v[view].items():
                    want[view, cell, i] = want.get((view, cell, i), 0) + round(x * Q.FIXED)
    told = docs.mapInArrow(Q._exchanged(*w), "view int, cell int, feature int, total long").groupBy("view", "cell", "feature").sum("total").collect()
    assert {(a, b, c): n for a, b, c, n in told} == {k: n for k, n in want.items() if n} and len({k[:2] for k in want}) > 8
    x, label, n = Q._bags(docs.mapInArrow(Q._exchanged(*w), "view int, cell int, feature int, total long").groupBy("view", "cell", "feature").agg({"total": "sum"}).withColumnRenamed("sum(total)", "total").toArrow(), 0)
    for i, cell in enumerate(sorted(c for v, c, f in want if v == 0 and f == -1)):
        own = {f: t for (v, c, f), t in want.items() if (v, c) == (0, cell) and f >= 0 and t}
        assert n[i] == want[0, cell, -1] and label[i] == (cell >= Q.BAGS)
        assert np.allclose([own[f] / Q.FIXED / n[i] for f in sorted(own)], x.val[x.at[i] : x.at[i + 1]]) and x.idx[x.at[i] : x.at[i + 1]].tolist() == sorted(own)

    model = Q.train(*tables(spark, "documents", "labels"))
    scored = docs.mapInArrow(Q._score(model), "doc_id long, score double, text_score double, meta_score double, predicted int").collect()
    plain = []
    for row in docs.collect():
        a, b = (c[0] * logit(v, u) + c[1] for c, v, u in zip(model.calibrate, views(row), (model.text, model.meta)))
        z = np.clip(a, -12, 12) * model.combine[0] + np.clip(b, -12, 12) * model.combine[1] + model.combine[2]
        plain.append((str(row.doc_id), 1 / (1 + np.exp(-z))))
    assert np.allclose([s for _, s in sorted(plain)], [s for _, s in sorted((str(r.doc_id), r.score) for r in scored)], atol=1e-5)


def recall_and_false(rows, truth):
    found = [r for r in rows if truth.get(r.doc_id) == 1]
    clean = [r for r in rows if truth.get(r.doc_id) == 0]
    return np.mean([r.predicted for r in found]), np.mean([r.predicted for r in clean])


def test_toxicity(spark, odd_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in X.toxicity(docs, labels).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    recall, false = recall_and_false(held, truth)
    assert recall > 0.9 and false < 0.02
    of = {r.doc_id: r.lang for r in docs.collect()}
    for lang in ("de", "en", "es", "fr"):
        assert recall_and_false([r for r in held if of[r.doc_id] == lang], truth)[0] > 0.8
    assert all(r.predicted for r in held if r.sentences)  # what offends stands in a document that is called toxic
    docs, labels = tables(spark, "documents", "labels")
    odd = X.toxicity(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert X.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in X.toxicity(odd_docs, labels.limit(0)).collect()} == {0}


BAD = ["fine words here. you vile toad! more words"] * 12
GOOD = ["fine words here. more words and more"] * 40


@pytest.fixture(scope="module")
def toads(spark):
    texts = BAD + GOOD
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(3 * i, int(t in BAD)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    learn = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    return X.train(learn, labels)


def test_words_that_come_again():
    import pyarrow as pa

    x = X.Sentences(pa.array(["a toad! a toad, no a.", "toad b"]))
    first = {f for f, s in zip(x.feature.tolist(), x.sent.tolist()) if s == 0}
    new = [f for f, s in zip(x.feature.tolist(), x.sent.tolist()) if s == 1 and f not in first]
    assert len(x.feature) == 6 + 2 + 3 and len(new) == 4  # "no", and that "a" (twice) and "toad" were there before
    assert len([1 for s in x.sent.tolist() if s == 2]) == 2  # another row begins anew


def test_noisy_or_locates_sentences(toads):
    import pyarrow as pa

    x = X.Sentences(pa.array([BAD[0], GOOD[0]]))
    p, each = toads.score(x, 2)
    assert p[0] > 0.7 and p[1] == 0 and each.argmax() == 1


def test_long_clean_texts_stay_clean(spark, toads):
    import pyarrow as pa

    long = " ".join(["fine words here. more words and more. unheard syllables!"] * 20_000)
    p, _ = toads.score(X.Sentences(pa.array([long, long + " you vile toad!"])), 2)
    assert p[0] == 0 and p[1] > 0.7
    docs, labels = tables(spark, "documents", "labels")
    model = X.train(docs, labels)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").limit(40).collect()]
    once, often = (model.score(X.Sentences(pa.array([c * n for c in clean])), len(clean))[0] for n in (1, 50))
    assert (often >= X.TOXIC).sum() <= (once >= X.TOXIC).sum() + 1


def test_toxicity_as_brute_force(toads):
    """Scores by plain loops over the sentences, whatever stands beside a text."""
    import re

    import pyarrow as pa

    weight = dict(zip(toads.words.tolist(), toads.weight))
    texts = ["You VILE toad. you vile toad! vile", "toady vileness, toads\nvile", "", None, "vile " * 300, *BAD[:1], *GOOD[:1]]

    def plain(text):
        s = 0.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            x = X.Sentences(pa.array([sentence]))
            own = [weight[f] for f in set(x.feature.tolist()) if f in weight]
            if own:
                z = toads.bias + sum(own)
                s += max(0, np.logaddexp(0, z) - np.logaddexp(0, np.log(X.FLOOR / (1 - X.FLOOR))))
        return 1 - np.exp(-s)

    got, _ = toads.score(X.Sentences(pa.array(texts)), len(texts))
    assert np.allclose(got, [plain(t) for t in texts])


def test_language(spark, odd_docs):
    (docs,) = tables(spark, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.languages(docs).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    odd = {(r.doc_id, r.lang_pred) for r in L.languages(odd_docs).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= odd
    assert {r.lang_pred for r in L.languages(odd_docs.withColumn("lang", odd_docs.lang.substr(5, 1)).where("doc_id = 3")).collect()} == {"und"}
    assert L.languages(docs.limit(0)).count() == 0


def test_language_of_a_row_is_its_own(spark, monkeypatch):
    """Order, neighbours, blocks and batches change nothing; margins are as by plain sums."""
    import pyarrow as pa

    (docs,) = tables(spark, "documents")
    model = L.train(docs)
    texts = [r.text[:n] for r in docs.limit(150).collect() for n in (1, 2, 3, 25, 4000)] + ["", None, "é", "a\nb"]
    whole = model.predict(model.margins(*_buffers(texts)))
    back = model.predict(model.margins(*_buffers(texts[::-1])))
    one = [model.predict(model.margins(*_buffers([t]))) for t in texts]
    assert whole[0] == back[0][::-1] == [o[0][0] for o in one]
    assert whole[1].tolist() == back[1][::-1].tolist() == [o[1][0] for o in one]
    default = L.row_blocks.__defaults__
    monkeypatch.setattr(L.row_blocks, "__defaults__", (7,))
    assert model.margins(*_buffers(texts)).tolist() == [model.margins(*_buffers([t]))[0].tolist() for t in texts]
    monkeypatch.setattr(L.row_blocks, "__defaults__", default)
    for t in texts[:60]:
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (t or "").encode()) + b"  "
        grams = [b[i] | b[i + 1] << 8 | b[i + 2] << 16 for i in range(len(b) - 2)]
        want = sum((model.weight[((g * 0x9E3779B1) & 0xFFFFFFFF) >> 18].astype(np.int64) for g in grams), np.zeros(model.weight.shape[1], np.int64))
        assert model.margins(*_buffers([t]))[0].tolist() == (want / (max(len(grams), 1) * float(L.FIXED)) + model.bias).tolist()
    assert pa is not None


def _buffers(texts):
    import pyarrow as pa

    from webloom.llm import _scan

    return _scan.buffers(pa.array(texts, pa.string()))


def test_language_families_vote():
    assert L.family_of("de") == L.family_of("en-GB") == "germanic" and L.family_of("xx") == "only xx"


def test_language_by_family_then_votes(spark):
    """A plain reading of the margins: the greatest family, then a vote for each pair, ties to the sum of chances."""
    names = ["de", "en", "es", "fr", "it", "nl", "xx"]
    families = L.families_of(names)
    assert families == {"germanic": ["de", "en", "nl"], "only xx": ["xx"], "romance": ["es", "fr", "it"]}
    pairs = [(a, b) for m in families.values() for i, a in enumerate(m) for b in m[i + 1 :]]
    model = L.Model(families, pairs, np.zeros((3 + len(pairs), 4)), np.zeros(3 + len(pairs)))
    r = np.random.default_rng(8)
    margins = r.normal(size=(500, 3 + len(pairs))).round(1)
    got, score = model.predict(margins)
    p = 1 / (1 + np.exp(-4 * margins))
    for i in range(len(margins)):
        top = int(np.argmax(p[i, :3]))
        members, chance = list(families.values())[top], p[i, top] / p[i, :3].sum()
        votes, sure = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for j, (a, b) in enumerate(pairs, 3):
            if a in members:
                votes[a if p[i, j] >= 0.5 else b] += 1
                sure[a], sure[b] = sure[a] + p[i, j], sure[b] + 1 - p[i, j]
        best = max(members, key=lambda m: votes[m] * 1000 + sure[m])
        assert got[i] == best and abs(score[i] - chance * (sure[best] / (len(members) - 1) if len(members) > 1 else 1)) < 1e-9


def test_many_languages(spark):
    """400 languages of no known family and 30 kinds of English: each is learnt and told apart."""
    r = np.random.default_rng(9)
    names = [f"l{i:03d}" for i in range(400)] + [f"en-{i:02d}" for i in range(30)]
    rows = []
    for n, name in enumerate(names):
        words = ["".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(12)]
        rows += [(n * 8 + k, " ".join(r.choice(words, 40)), name) for k in range(8)]
    got = L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    truth = {i: (name, zlib.crc32(str(i).encode()) % 4 == 2) for i, _, name in rows}
    right = [x.lang_pred == truth[x.doc_id][0] for x in got if truth[x.doc_id][1]]
    assert len(right) > 500 and np.mean(right) > 0.9
    assert {x.lang_pred for x in got} == set(names)
    parts = L.families_of(names)
    assert max(map(len, parts.values())) <= L.MOST_MEMBERS and sum(map(len, parts.values())) == 430


@pytest.mark.parametrize("block,queries,depth", [(1 << 15, 1 << 14, 64), (60, 7, 2)])
def test_top_k(spark, monkeypatch, block, queries, depth):
    for name, v in (("BLOCK", block), ("QUERIES", queries), ("DEPTH", depth), ("FIRST", 30), ("STRETCH", 50)):
        monkeypatch.setattr(K, name, v)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted(tuple(r) for r in K.op8_exact_top_k(spark, SF).collect())
    assert got == sorted(c.execute(K.OP8_SQL).fetchall())


def plain_top(queries, rows, k):
    """Best k of every query by exact integers."""
    out = []
    for q, v in sorted({q: min(v for p, v in queries if p == q) for q, _ in queries}.items()):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scores, 1)]
    return out


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(2)
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [0.5, 0.5]), (8, [1e30, 1.0]), (9, [-0.001]), (None, [1.0])]
    rows += [(10, [1e30, 2.0]), (11, [-3e38, 3e38]), (12, [3e38, 3e38]), (13, [1e15, -1e15]), (14, [1e9, 7.0]), (15, [2.0**63, 1.0]), (20, [5.0, 5.0]), (20, [4.0, 1.0]), (1, [0.5, 0.5])]
    rows += [(i, [float(x) for x in r.normal(size=r.integers(0, 4))]) for i in range(30, 60)]
    v = K.integer_vectors(spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, v string, over int"))
    plain = [(r.vec_id, r.v) for r in v.collect()]
    assert {i for i, _ in plain} == {0, 1, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 20, *range(30, 60)} and [9, [-1.0]] in [list(x) for x in plain]
    v = v.selectExpr("*", "1 as g", "2 as b", "'x' as floor", "3L as query_id", "4 as rank", "0.5 as score")  # other columns aren't read
    q = v.where("vec_id % 4 < 3")
    for k in (1, 4, 100):
        got = sorted(tuple(r) for r in K.exact_top_k(q, v, k).collect())
        assert got == plain_top([(r.vec_id, r.v) for r in q.collect()], plain, k)
    assert K.exact_top_k(v.limit(0), v).count() == 0 and K.exact_top_k(v, v.limit(0)).count() == 0


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    from webloom.llm import _store

    rows = spark.createDataFrame([(i, i % 4, b"x" * 1000) for i in range(800)], "doc_id long, label int, words binary").select("label", _store.spot("doc_id"), "words")
    assert _store.collected(rows, "sample").num_rows == 800
    monkeypatch.setattr(_store, "SAMPLE_BYTES", 200_000)
    got = _store.collected(rows, "sample")
    assert got.column_names == ["label", "words"] and 140 < got.num_rows < 260
    shares = np.bincount(got["label"].to_numpy(), minlength=4) / got.num_rows  # rows of equal content are thinned one by one
    assert abs(shares - 0.25).max() < 0.1


def test_url_rules(spark):
    rows = [(1, "http://A.com/x"), (2, "https://www.example.com/en/1"), (3, "https://m.example.com/en/1?q"), (4, "http://b.net/fr/x"), (5, "http://b.org/en#f"), (6, None), (7, "no scheme"), (8, "http://c.com"), (9, "http://d.com?x=/"), (1, "http://A.com/x")]
    got = sorted(U.judge(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict").collect())
    assert len(got) == 10
    by = {r.page_id: tuple(r)[1:4] for r in got}
    assert by[1] == ("a.com", "/x", "com/") and by[2][2] == "www.example.com/en/" and by[3][2] == "example.com/en/"
    assert by[4][2] == "net/fr/" and by[5] == ("b.org", "/en", None) and by[6] == by[7] == ("", "", None) and by[8] == ("c.com", "", None) and by[9] == ("d.com", "", None)
    assert U.judge(spark.createDataFrame(rows, "page_id long, url string").limit(0)).count() == 0


def plain_judge(rows):
    """Verdicts and scores by plain dictionaries."""
    import math
    import re
    from collections import Counter

    words, seen = Counter(), []
    for page, url, html in rows:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        title = re.search(r"(?i)<title[^>]*>([^<]*)", html or "")
        words.update(w for w in re.split(r"[^a-zé]+", f"{title[1] if title else ''} {path}".lower()) if 0 < len(w) <= U.LONGEST)
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = sorted(((h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: -len(x[0]))
        seen.append((page, host, path, *(fits[0] if fits else (None, None))))
    total = sum(words.values()) + 1.0
    split = lambda host: ["h:" + w for x in re.split(r"[^a-z0-9é]+", host) for w in U.viterbi(x, words, total)]
    tokens = lambda path: ["p:" + ("<num>" if w.isdigit() else w) for w in re.split(r"[^a-z0-9é]+", path.lower()) if w]
    count = {v: Counter(t for _, h, p, _, w in seen if w == v for t in split(h) + tokens(p)) for v in ("allow", "block")}
    kinds, n = set(count["allow"]) | set(count["block"]), {v: sum(c.values()) for v, c in count.items()}
    pages = Counter(w for *_, w in seen)
    odds = lambda t: round((math.log((count["block"][t] + 1) / (n["block"] + len(kinds) + 1)) - math.log((count["allow"][t] + 1) / (n["allow"] + len(kinds) + 1))) * 1e6) if t in kinds else 0
    out = []
    for page, host, path, rule, verdict in seen:
        score = round(math.log(pages["block"] / pages["allow"]) * 1e6) + sum(map(odds, split(host))) + sum(map(odds, tokens(path)))
        out.append((str(page), host, path, rule, verdict or ("block" if score > 0 else "allow"), score / 1e6))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [16 << 20, 0])
def test_urls_as_brute_force(spark, monkeypatch, sent):
    """Nulls, repeated rows, very long urls, clashing columns; models sent to the executors, and joined."""
    monkeypatch.setattr(U, "SENT_BYTES", sent)
    r = np.random.default_rng(4)
    word = lambda: str(r.choice(["red", "cat", "offer", "home", "news", "spam", "caté", "averyveryverylongwordofmanyletters"]))
    rows = [(int(i), f"http{'s' * (i % 2)}://{word()}{word()}.{r.choice(['com', 'net', 'org', 'example.com'])}/{r.choice(['en', 'es', 'fr', '7'])}/{word()}-{word()}?q={word()}", f"<title>{word()} {word()}</title>" if i % 3 else None) for i in range(120)]
    rows += [rows[0], rows[0], (None, "http://x.org/spam", None), (500, None, None), (501, "", "<p>"), (502, "http://" + "redcat" * 700 + ".org/" + "offer/" * 3000, None), (503, "://", None), (504, "a://B.ORG", None)]
    pages = spark.createDataFrame([(*x, "c", "d", 1.0, 2) for x in rows], "page_id long, url string, html string, host string, path string, score double, token int")
    got = U.judge(pages).collect()
    assert sorted(((str(x.page_id), x.host, x.path, x.rule, x.verdict, x.score) for x in got), key=str) == plain_judge(rows)


def test_viterbi():
    counts = {"red": 10, "cat": 8, "redc": 1, "at": 2}
    assert U.viterbi("redcat", counts, 30.0) == ["red", "cat"]
    assert U.viterbi("", counts, 30.0) == []


def test_bayes_learns_from_rules(spark):
    rows = [(i, f"http://spamword{i}.net/fr/offer") for i in range(20)] + [(100 + i, f"http://nicehome{i}.com/home") for i in range(20)] + [(500, "http://x.org/offer"), (501, "http://x.org/home")]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[500] == "block" and got[501] == "allow"

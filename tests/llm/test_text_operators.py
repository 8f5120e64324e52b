import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from webloom.llm import decontaminate as D
from webloom.llm import pii as P
from webloom.llm import sentencepiece_codec as C
from webloom.llm import token_counts as TC

# -- decontamination ---------------------------------------------------------------------


def test_reparameterised_items(spark):
    r = random.Random(2)
    prose = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "zeta"]) for _ in range(30))
    item = "A farmer sells 12 boxes to Maria for 5 dollars each and then buys 7 more boxes from Maria before noon"
    changed = "A farmer sells 31 boxes to Petra for 9 dollars each and then buys 2 more boxes from Petra before noon"
    broken = "A farmer sells 31 boxes to Petra for 9 dollars each and then buys 2 more boxes from Quentin before noon"
    docs = spark.createDataFrame([(1, f"{prose}. {item}. {prose}"), (2, f"{prose}. {changed}"), (3, f"{prose}\n{broken}. {prose}"), (4, prose), (5, None), (6, ""), (7, " ".join(item.split()[:9])), (None, item), (8, item.upper()), (1, f"{prose}. {item}. {prose}")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "one two")], "item_id long, text string")
    got = sorted((str(x.doc_id), x.item_id, x.n_changed > 0) for x in D.contaminated(docs, bench).collect())
    assert ("1", 10, False) in got and got.count(("1", 10, False)) == 2 and ("2", 10, True) in got and ("None", 10, False) in got
    assert not {"3", "4", "5", "6", "7"} & {x[0] for x in got if x[1] == 10}
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items(spark):
    """Items of fewer tokens than a window, inside longer documents."""
    bench = spark.createDataFrame([(1, "What is 3 + 4?"), (2, "name the four rivers"), (3, "two"), (4, "How many legs has a spider with 2 eyes")], "item_id long, text string")
    rows = [(1, "so what is 3 + 4? he asked"), (2, "so what is 5 + 9? he asked"), (3, "please NAME the four rivers, now"), (4, "name the five rivers"), (5, "two"), (6, "two words"), (7, "What is 3 4")]
    got = sorted((r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    assert got == [(1, 1), (3, 2), (5, 3), (7, 1)]


def plain_items(bench, text):
    """Items that a text holds, by comparing every alignment token by token."""
    t = D.Template(pa.array([text or ""]))
    found = set()
    for item, body in bench:
        u = D.Template(pa.array([body or ""]))
        n, length = len(u.token), min(len(u.token), D.WINDOW)
        total = max(n - D.WINDOW + 1, 1)
        exact = n < D.WINDOW and (~u.slot).sum() < D.PLAIN_WORDS
        if not n or n == 1 and len(t.token) != 1:
            continue
        covered = set()
        for d in range(-n, len(t.token)):
            met = []
            for q in range(n - length + 1):
                if d + q < 0 or d + q + length > len(t.token):
                    continue
                a, b = list(u.token[q : q + length]), list(t.token[d + q : d + q + length])
                if a == b or q == 0 and u.capital[0] and [D._NAME, *a[1:]] == [int(x) for x in b]:
                    met.append(q)
            under = sorted({q + j for q in met for j in range(length)})
            pairs = {x: (u.value[x], t.value[d + x]) for x in under if u.slot[x]}
            bad = {x for x, (v, y) in pairs.items() if exact and v != y or any((v == v2) != (y == y2) for v2, y2 in pairs.values())}
            covered |= {q for q in met if not bad & set(range(q, q + length))}
        if covered and len(covered) >= D.COVER * total - 1e-9:
            found.add(item)
    return found


def test_decontamination_as_brute_force(spark, odd_docs):
    r = random.Random(12)
    word = lambda: r.choice(["Ann", "Bob", "the", "a", "has", "3", "17", "4.5", "km", "apples", "and", "then.", "buys", "sold", "Rome"])
    bench = [(i, " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 14])))) for i in range(60)] + [(60, None), (61, "7 8 9 10 11 12"), (62, "7 8 9 10 11 12"), (None, "Ann has 3 apples and then Bob has 17")]
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(r.choice([0, 1, 4, 30, 80])))
        if r.random() < 0.6:
            text += " " + " ".join(w if r.random() < 0.9 else word() for w in (r.choice(bench)[1] or "").split()) + " " + " ".join(word() for _ in range(10))
        rows.append((100 + i, text))
    rows.append((99, " ".join(str(i % 13) for i in range(400))))
    docs = spark.createDataFrame([(*x, "extra", 1) for x in rows], "doc_id long, text string, item_id string, n_windows int").unionByName(odd_docs, allowMissingColumns=True)
    table = spark.createDataFrame([(*x, 5) for x in bench], "item_id long, text string, coverage int")
    all_rows = docs.collect()
    want = sorted((str(x.doc_id), str(i)) for x in all_rows for i in plain_items(bench, x.text))
    assert sorted((str(x.doc_id), str(x.item_id)) for x in D.contaminated(docs, table).collect()) == want
    held = {(str(x.doc_id), x.text) for x in all_rows if plain_items(bench, x.text)}
    kept = D.without_contaminated(docs, table).collect()
    assert sorted(str(x) for x in kept) == sorted(str(x) for x in all_rows if (str(x.doc_id), x.text) not in held)


def test_hot_windows_are_linear():
    """A long table of numbers against items of numbers: no posting is met position by position."""
    import time

    bench = D.Bench(list(range(300)), [" ".join(str(j * (i + 2)) for j in range(12)) for i in range(300)])
    began = time.time()
    D._found(bench, pa.array([" ".join(str(i * 37 % 1009) for i in range(2_000)), "words only"]))
    assert time.time() - began < 60


def test_passes_agree(spark, data, monkeypatch):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "PASS_WINDOWS", 200)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == one
    items = {r.item_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in bench.collect()}
    plain = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in " ".join(re.findall(r"\w+", r.text.lower()))}
    assert plain <= {x[:2] for x in one}


# -- SentencePiece -----------------------------------------------------------------------


def test_as_the_library(spark, odd_docs):
    whole = C.load(C.model_path())[0]
    r = random.Random(3)
    parts = [" ", "  ", "\n", "a", "the", "ing", "▁", "é", "①", "\t", "<s>", "\x00", "😀"]
    docs = spark.createDataFrame([(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(500)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    want = []
    for x in rows:
        ids = [1, *whole.encode(x.text or ""), 2]
        want.append((str(x.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids).encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in C.digests(docs).collect()) == sorted(want)
    back = C.decode(C.encode(docs)).collect()
    assert sorted(str((x.doc_id, x.text)) for x in back) == sorted(str((x.doc_id, whole.decode([1, *whole.encode(x.text or ""), 2]))) for x in rows)
    assert C.digests(docs.limit(0)).count() == 0


def test_flushed_table():
    a, b = C.Codec(C.model_path()), C.Codec(C.model_path())
    b.table.most = 5
    texts = ["one two three four five six seven", "eight nine ten\neleven", "z" * 100 + " one"]
    assert [a.both([t]) for t in texts] == [b.both([t]) for t in texts]


# -- token counts ------------------------------------------------------------------------


def test_counts_of_documents(spark, odd_docs):
    enc = TC._encoding(TC.VOCABULARY)
    want = sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or ""))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in TC.token_counts(odd_docs).collect()) == want
    assert TC.token_counts(odd_docs.limit(0)).count() == 0


def test_blocks_of_flat_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TC, "SPAN", 5)
    r = random.Random(1)
    want = {}
    for name in ("a", "b", "c", "d"):
        ids = [r.choice([7, 7, 7, 9]) for _ in range({"a": 500, "b": 1, "c": 0, "d": 64}[name])]
        if name == "d":
            ids = [7] * 64  # a document that no separator ends
        np.array(ids, "<u4").tofile(tmp_path / name)
        cuts = [i for i, x in enumerate(ids) if x == 9]
        counts = [b - a - 1 for a, b in zip([-1, *cuts], cuts)]
        if len(ids) - 1 - (cuts[-1] if cuts else -1):
            counts.append(len(ids) - 1 - (cuts[-1] if cuts else -1))
        want |= {(name, i): n for i, n in enumerate(counts)}
    for block in (4, 12, 64, 1 << 20):
        got = TC.separator_counts(spark, str(tmp_path), separator=9, width=4, block_bytes=block)
        assert {(x.file, x.nth): x.n_tokens for x in got.collect()} == want


# -- personal data -----------------------------------------------------------------------

KINDS = ["email", "ip", "card", "phone"]
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base(text):
    out = []
    for rank, (kind, rx) in enumerate(zip(KINDS, PLAIN)):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1]))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and (not 12 <= len(d) <= 19 or luhn % 10) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_entities(spark, odd_docs):
    texts = ["a@b.c_x@y.z", "x" * 3000 + "@" + "y", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "é😀 4952935900253052 4952 9359-0025 3052", "+1 (864) 555-0138 +123 +12345678901234567", " ".join(["a@b.co 1.1.1.1"] * 200), "+1.2.3.4@5.6.7.8", "4952935900253052" * 2]
    r = random.Random(4)
    texts += ["".join(r.choice("a1. +-@()_9%") for _ in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    want = sorted((str(x.doc_id), hashlib.sha256(base(x.text or "").encode()).hexdigest()) for x in docs.collect())
    got = P.personal_data(docs).collect()
    assert sorted((str(x.doc_id), x.base_sha256) for x in got) == want
    assert P.personal_data(docs.limit(0)).count() == 0


def test_patterns_find_the_unseen(spark, monkeypatch):
    keys = [hashlib.md5(str(i).encode()).hexdigest() + "a1b2c3" for i in range(8)]
    docs = spark.createDataFrame([(i, f'some words {i} then token = "{k}" end') for i, k in enumerate(keys)] + [(50, 'other words token = "abc123" end'), (51, "plain room abc123 here"), (52, None)], "doc_id long, text string")
    spans = {x.doc_id: x.spans for x in P.personal_data(docs).collect()}
    assert spans[50] == "id:21:27" and spans[51] == "" and spans[52] == ""
    monkeypatch.setattr(P, "INLINE", 0)
    assert {x.doc_id: x.spans for x in P.personal_data(docs).collect()} == spans
    out = {x.doc_id: x.text for x in P.redacted(docs).collect()}
    assert out[50] == 'other words token = "[id]" end' and out[51] == "plain room abc123 here" and out[52] is None


CLASHING = "base cands more spans row new k1 k2 pattern token _key _null _spans _new _hits _d x y".split()


def test_redaction_keeps_all_other_columns(spark, monkeypatch):
    mixed = spark.createDataFrame([(1, "x a@b.co y 1.2.3.4", 18, *range(len(CLASHING)))], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING))
    for inline in (500, -1):  # patterns as literals, and by a join
        monkeypatch.setattr(P, "INLINE", inline)
        out = P.redacted(mixed)
        assert out.schema.names == mixed.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in mixed.schema]
        assert tuple(out.first()) == (1, "x [email] y [ip]", 16, *range(len(CLASHING)))
        assert P.personal_data(mixed).first().spans == "email:2:8,ip:11:18"


def cut(text, spans):
    """Spans replaced by their kinds, by one pass over the text."""
    out, at = [], 0
    for kind, a, z in spans:
        if a >= at:
            out.append(text[at:a] + f"[{kind}]")
        at = max(at, z)
    return "".join(out) + text[at:]


def test_redaction_as_brute_force(spark, odd_docs):
    r = random.Random(6)
    word = lambda: r.choice(["a@b.co", "1.2.3.4", "é😀" * r.randint(1, 400), "+1 (864) 555-0138", "4952935900253052", "x" * r.randint(1, 2000), "+1.2.3.4@5.6.7.8"])
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(r.choice([1, 5, 300])))) for i in range(100, 140)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    spans = {(r.doc_id): [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in r.spans.split(",") if x)] for r in P.personal_data(docs).collect()}
    want = sorted((str(x.doc_id), None if x.text is None else cut(x.text, spans[x.doc_id])) for x in docs.where("text is not null").collect())
    assert sorted((str(x.doc_id), x.text) for x in P.redacted(docs).where("text is not null").collect()) == want
    assert P.redacted(docs).where("text is null").count() == 1 and P.redacted(docs.limit(0)).count() == 0


def test_long_table_of_numbers(spark):
    """Work is linear: ten times the length takes no more than some thirty times as long."""
    import time

    def took(n):
        text = " ".join(f"{i * 7919 % 100000:05d}.{i}.1.1 a{i}@b.co row{i:06d}" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = P.redacted(docs).first().text
        assert got.count("[email]") == n
        return time.time() - began

    took(100)
    small, large = took(3_000), took(30_000)
    assert large < 30 * small + 10


def test_pattern_spans_as_brute_force(spark):
    """Scores, rounds and what they find, by plain loops over the graph."""
    r = random.Random(9)
    tokens = [f"{r.choice(['ab', 'cd', 'ef'])}{i:04d}/{i}" for i in range(60)] + [hashlib.md5(str(i).encode()).hexdigest() for i in range(15)]
    texts = [" and ".join(f"{r.choice(['key', 'room', 'order', 'code', 'flat'])} {r.choice(['is', 'no', 'was'])}: {r.choice(tokens)}" for _ in range(r.randint(1, 6))) for _ in range(120)]
    rx = re.compile(P.TOKEN.replace("++", "+").replace("*+", "*"))
    found = []
    for d, t in enumerate(texts):
        end = 0
        for m in rx.finditer(t):
            left = t[end : m.start()][-P.LEFT :].lower()
            found.append((d, m.start(), m.end(), m[0], re.sub("[0-9]", "0", re.search(r"((?:[^\s]+\s+)?[^\s]*\s*)$", left)[1])))
            end = m.end()
    seed = lambda t: len(t) >= 32 and len(re.sub("[^0-9]", "", t)) >= 8 and len(re.sub("[^A-Za-z]", "", t)) >= 4
    edges = {(p, t) for *_, t, p in found if p.strip()}
    score, known, good = {t: float(seed(t)) for _, t in edges}, {t: seed(t) for _, t in edges}, {}
    while True:
        now = {}
        for p in {p for p, _ in edges}:
            mine = [t for q, t in edges if q == p]
            s, n = sum(score[t] for t in mine) / (len(mine) + 0.5), sum(known[t] for t in mine)
            if s >= P.CONFIDENCE and n >= P.SEEDS:
                now[p] = s
        if now == good or not now:
            break
        good = now
        for p, t in edges:
            if p in good:
                score[t], known[t] = max(score[t], good[p]), True
    want = {d: ",".join(f"id:{a}:{z}" for e, a, z, _, p in found if e == d and p in good) for d in range(len(texts))}
    got = P.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.spans for x in got} == want


def test_words_and_hashes():
    from webloom.llm import _scan

    texts = ["One two", None, "", "x" * 300_000, " ONE  é ", "two"]
    buf, offs = _scan.buffers(pa.array(texts))
    s, e, h, rows = _scan.words(buf, offs)
    assert [bytes(buf[a:b]).decode()[:5] for a, b in zip(s, e)] == ["One", "two", "xxxxx", "ONE", "é", "two"]
    assert np.diff(rows).tolist() == [2, 0, 0, 1, 2, 1]
    assert h[0] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 4


def test_found_tokens_are_instances(spark):
    """Three contexts, each known only through the tokens of the one before; the last token is longer than 64 characters."""
    two, three, long = [f"bb{i:02d}zz99" for i in range(15)], [f"cc{i:02d}zz99" for i in range(5)], "k" * 90 + "7"
    rows = [f"first hop: {x}" for x in [f"user{i:02d}@example.org" for i in range(60)] + two]
    rows += [f"second hop: {x}" for x in two + three]
    rows += [f"third hop: {x}" for x in [*three, long]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in P.personal_data(docs).collect()}
    at = {t: i for i, t in enumerate(rows)}
    for t in (f"second hop: {three[0]}", f"third hop: {long}"):
        start = t.index(": ") + 2
        assert spans[at[t]] == f"id:{start}:{len(t)}"


def test_items_of_one_template():
    """Items that differ in numbers and names only are one class; each is found with the number of values that differ."""
    import time

    import pyarrow as pa

    text = lambda a, b, n: f"If {a} apples cost {b} dollars, how many dollars do {a} pears of {n} cost?"
    names = ["Anna", "Bob", "Carla"]
    items = [text(i % 50, 100 + i // 50, names[i % 3]) for i in range(100_000)]
    items += ["If 3 apples cost 3 dollars, how many dollars do 3 pears of Anna cost?", "If 1 apples cost 2 dollars, how many dollars do 5 pears of Anna cost?"]
    bench = D.Bench(list(range(len(items))), items)
    assert len(bench.members) == 3  # by which values are equal
    began = time.time()
    doc = "Some words before. " + text(7, 123, "Bob") + " And after."
    got = D._found(bench, pa.array([doc, "no such thing", "", None]))
    took = time.time() - began
    assert took < 20 and {x[0] for x in got} == {0} and [x[1] for x in got] == list(range(100_000))
    for _, i, windows, cover, slots, changed, *_ in got[:: 997]:
        # 7 stands twice, dollars after a number is a unit
        want = 2 * (i % 50 != 7) + (100 + i // 50 != 123) + (names[i % 3] != "Bob")
        assert (cover, changed) == (1.0, want), items[i]
    one = D._found(bench, pa.array([doc]), first=True)
    assert len({x[0] for x in one}) == 1
    few = D.Bench(list(range(300)), items[:300])
    alone = [[(r, i, *x) for r, _, *x in D._found(D.Bench([0], [t]), pa.array([doc]))] for i, t in enumerate(items[:300])]
    assert D._found(few, pa.array([doc])) == sorted(sum(alone, []))

"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Regular expressions and checks find the base entities (e-mail, ip, card, phone).  They and
tokens of the shape of long keys are the seeds.  The words before a candidate token are its
pattern; patterns and tokens form a bipartite graph, on which scores go back and forth:
a pattern is worth the part of its tokens that are known, a token the best of its patterns;
tokens behind an accepted pattern are instances for the others, until nothing changes.
What stands behind a pattern of high confidence is then personal data as well (kind ``id``),
though no expression knows it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import drop, table, written

#: Kinds in the order that breaks ties; the method's own kind is last.
KINDS = ("email", "ip", "card", "phone", "id")
# Same matches as the plain expressions, in linear time: a run can only match from its first character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidate tokens: 6 characters or more with a digit; parts may be joined by ``+``, ``/`` or ``.``.
TOKEN = r"(?<![A-Za-z0-9_-])(?<![A-Za-z0-9_-][+/.])(?=[A-Za-z_+/.-]*+[0-9])(?=[A-Za-z0-9_+/.-]{6})[A-Za-z0-9_-]++(?:[+/.]++[A-Za-z0-9_-]++)*+"
#: Characters before a token in which its pattern lies.
LEFT = 48
#: Confidence and distinct instances (seeds or tokens found since) that a pattern needs.
CONFIDENCE, SEEDS = 0.7, 3
#: Patterns that are put into the plan as a set of literals (some 60 bytes each); with more, a join finds them.
INLINE = 5_000
#: Elements that are folded one by one, and characters of a piece of text.
_BLOCK, _PIECE = 64, 1024
_SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"
_MATCHES = "array<struct<start:bigint,end:bigint,m:string,left:string>>"


# Expressions over arrays are built as SQL text: a plan of many small lambdas is parsed at once.
_names = itertools.count()


def _fresh(n: int = 1) -> list[str]:
    return [f"v{next(_names)}" for _ in range(n)]


def _let(value: str, body) -> str:
    """``body(name)`` with ``value`` evaluated once (what a lambda names is evaluated for each element)."""
    (x,) = _fresh()
    return f"get(transform(array({value}), {x} -> {body(x)}), 0)"


def _folds(x: str, zero: str, op, levels: int = 2) -> str:
    """Array of the folds of x up to each element, in linear work: of its block, upon the folds of the blocks before."""

    def fold(a: str) -> str:
        s, w = _fresh(2)
        return f"aggregate({a}, {zero}, ({s}, {w}) -> {op(s, w)})"

    def few(y: str) -> str:
        v, i = _fresh(2)
        return f"transform({y}, ({v}, {i}) -> {fold(f'slice({y}, 1, {i} + 1)')})"

    def many(y: str) -> str:
        b, v, i = _fresh(3)
        totals = f"transform(sequence(0, int((size({y}) - 1) div {_BLOCK})), {b} -> {fold(f'slice({y}, {b} * {_BLOCK} + 1, {_BLOCK})')})"
        mine = fold(f"slice({y}, int({i} div {_BLOCK}) * {_BLOCK} + 1, {i} % {_BLOCK} + 1)")
        upon = lambda before: op(f"get({before}, int({i} div {_BLOCK}) - 1)", mine)
        return _let(_folds(totals, zero, op, levels - 1), lambda before: f"transform({y}, ({v}, {i}) -> if({i} < {_BLOCK}, {mine}, {upon(before)}))")

    return _let(x, lambda y: f"if(size({y}) <= {_BLOCK}, {few(y)}, {many(y)})" if levels else few(y))


def _matches(text: str, pattern: str, when: str) -> str:
    """Array of (start, end, m, left) of all matches, in code points."""
    none = f"cast(array() as {_MATCHES})"

    def spans(m: str, g: str) -> str:
        x, i, y, j = _fresh(4)
        ends = _folds(f"transform({m}, ({x}, {i}) -> bigint(length({x}) + length(get({g}, {i}))))", "0L", lambda s, v: f"{s} + {v}")
        one = lambda e: f"named_struct('start', get({e}, {j}) - length({y}), 'end', get({e}, {j}), 'm', {y}, 'left', right(get({g}, {j}), {LEFT}))"
        return _let(ends, lambda e: f"transform({m}, ({y}, {j}) -> {one(e)})")

    gaps = f"split({text}, r'{pattern}', -1)"
    some = lambda m: f"if(size({m}) > 0, {_let(gaps, lambda g: spans(m, g))}, {none})"
    found = _let(f"regexp_extract_all({text}, r'{pattern}', 0)", some)
    return f"if({when}, {found}, {none})"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    one = lambda i: F.substring(d, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, one(i)).when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) > 3, F.lit(False)).when(plain == "", F.lit(True)).otherwise(plain.cast("int") <= 255)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _check(kind: str):
    return lambda s: _VALID[kind](s["m"])


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined; spans are (start, rank, end)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def _overlaps(base: str, tokens: str) -> str:
    """Array of booleans: whether each token (ascending, disjoint) overlaps a base span, by one sorted sweep."""
    most = str(1 << 62) + "L"
    s, t = _fresh(2)
    at = lambda x, is_token: f"named_struct('start', {x}.start, 'token', {is_token}, 'end', {x}.end)"
    events = f"sort_array(concat(transform({base}, {s} -> {at(s, 0)}), transform({tokens}, {s} -> {at(s, 1)})))"

    def sweep(e: str) -> str:
        x, y, z, i, u, w = _fresh(6)
        # the furthest end of the base spans that begin before, and the next base span's start after
        reach = _folds(f"transform({e}, {x} -> if({x}.token = 0, {x}.end, -1L))", "-1L", lambda a, b: f"greatest({a}, {b})")
        ahead = "reverse(" + _folds(f"transform(reverse({e}), {y} -> if({y}.token = 0, {y}.start, {most}))", most, lambda a, b: f"least({a}, {b})") + ")"
        mark = lambda r, a: f"transform({e}, ({z}, {i}) -> named_struct('token', {z}.token, 'hit', get({r}, {i}) > {z}.start or get({a}, {i}) < {z}.end))"
        marked = _let(reach, lambda r: _let(ahead, lambda a: mark(r, a)))
        return f"transform(filter({marked}, {u} -> {u}.token = 1), {w} -> {w}.hit)"

    return f"if(size({base}) > 0, {_let(events, sweep)}, transform({tokens}, {t} -> false))"


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (a column ``text``; the other names are free but for ``base`` and ``cands``) with two more columns.

    ``base``: sorted (start, rank, end) of the base entities.  ``cands``: candidate tokens
    with their pattern, whether they lie inside a base entity, and whether they look like a key.
    """
    text = "coalesce(text, '')"
    digit = f"rlike({text}, '[0-9]')"
    kinds = (("email", EMAIL, f"contains({text}, '@')"), ("ip", IP, f"{digit} and contains({text}, '.')"), ("card", CARD, digit), ("phone", PHONE, f"{digit} and contains({text}, '+')"))
    kept = [_ranked(F.filter(F.expr(_matches(text, pattern, when)), _check(kind)), rank) for rank, (kind, pattern, when) in enumerate(kinds)]
    df = rows.withColumn("base", F.sort_array(F.concat(*kept)))
    s, i = _fresh(2)
    left = f"regexp_replace(regexp_extract(lower({s}.left), r'((?:[^\\s]+\\s+)?[^\\s]*\\s*)$', 1), '[0-9]', '0')"
    key = f"length({s}.m) >= 32 and length(regexp_replace({s}.m, '[^0-9]', '')) >= 8 and length(regexp_replace({s}.m, '[^A-Za-z]', '')) >= 4"  # 32 characters or more, among them 8 digits and 4 letters
    one = lambda hit: f"named_struct('start', {s}.start, 'end', {s}.end, 'token', {s}.m, 'pattern', {left}, 'inside', get({hit}, {i}), 'key', {key})"
    return df.withColumn("cands", F.expr(_let(_matches(text, TOKEN, digit), lambda t: _let(_overlaps("base", t), lambda hit: f"transform({t}, ({s}, {i}) -> {one(hit)})"))))


def patterns(found: DataFrame) -> DataFrame:
    """``pattern, score`` of the patterns of high confidence, scored on the graph of patterns and tokens."""
    occ = found.select(F.explode("cands").alias("c")).select("c.pattern", "c.token", (F.col("c.inside") | F.col("c.key")).alias("seed")).where("trim(pattern) <> ''")
    edges = written(occ.groupBy("pattern", "token").agg(F.max(F.col("seed").cast("int")).alias("seed")), "pattern-graph")
    spark = found.sparkSession
    known = written(edges.groupBy("token").agg(F.max("seed").cast("double").alias("s"), F.max("seed").alias("seed")), "known-tokens")
    scored, mark = None, None
    while True:
        now = edges.select("pattern", "token").join(known, "token").groupBy("pattern").agg((F.sum("s") / (F.count("*") + 0.5)).alias("score"), F.sum("seed").alias("seeds"))
        now = written(now.where((F.col("score") >= CONFIDENCE) & (F.col("seeds") >= SEEDS)).select("pattern", "score"), "patterns")
        drop(spark, scored)
        scored = now
        # scores only grow, so equal marks mean that nothing new was accepted and no score moved
        last, mark = mark, tuple(scored.agg(F.count("*"), F.coalesce(F.sum(F.floor(F.col("score") * 1_000_000)), F.lit(0))).first())
        if mark[0] == 0 or (last is not None and mark <= last):
            break
        reached = edges.select("pattern", "token").join(scored, "pattern").groupBy("token").agg(F.max("score").alias("r"))
        grown = known.join(reached, "token", "left").select("token", F.greatest("s", F.coalesce("r", F.lit(0.0))).alias("s"), F.when(F.col("r").isNotNull(), 1).otherwise(F.col("seed")).alias("seed"))
        grown = written(grown, "known-tokens")
        drop(spark, known)
        known = grown
    drop(spark, edges, known)
    return scored


def _with_found(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adds ``spans``: sorted (start, rank, end) of the base entities and of what stands behind accepted patterns."""
    some = [r[0] for r in accepted.select("pattern").orderBy("pattern").limit(INLINE + 1).collect()]
    span = lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("rank"), c["end"].alias("end"))
    if len(some) <= INLINE:
        good = F.filter("cands", lambda c: ~c["inside"] & c["pattern"].isin(some)) if some else F.filter("cands", lambda c: F.lit(False))
        return found.withColumn("spans", F.sort_array(F.concat("base", F.transform(good, span))))
    # spans follow from the text alone, so two hashes of it are the key: a text is one row here, however often it occurs
    hits = found.select("k1", "k2", F.explode("cands").alias("c")).where("not c.inside").withColumn("pattern", F.col("c.pattern")).join(accepted.select("pattern"), "pattern")
    hits = hits.groupBy("k1", "k2").agg(F.collect_set(span(F.col("c"))).alias("more"))
    return found.join(hits, ["k1", "k2"], "left").withColumn("spans", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(_SPANS))))).drop("more")


def _keyed(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return rows.withColumn("k1", F.xxhash64(text)).withColumn("k2", F.xxhash64(F.lit(1), text))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, base counts ``n_email, n_ip, n_card, n_phone``, ``base_sha256``, ``spans``, ``n_spans``.

    Counts and digest are of the base entities; ``spans`` and ``n_spans`` also have what
    patterns found (kind ``id``).  Spans are ``kind:start:end`` in code points, by start, then
    kind.  Null and empty texts have none; repeated rows are each answered; an empty table
    gives no rows; other columns aren't read.  Work is linear in the length of a text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = written(base_spans(_keyed(rows)).drop("text"), "personal-data")
    accepted = patterns(found)
    out = _with_found(found, accepted)
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [n(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS[:4])]
    out = out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
    out = written(out, "entities")
    drop(docs.sparkSession, found, accepted)
    return out


def _between(pieces: str, a: str, b: str) -> str:
    """The text from code point a up to b, from its pieces of equal length."""
    piece = lambda n: f"coalesce(get({pieces}, {n}), '')"

    def cut(i: str, j: str) -> str:
        across = f"concat(substring({piece(i)}, int({a} % {_PIECE}) + 1), array_join(slice({pieces}, {i} + 2, greatest(0, {j} - {i} - 1)), ''), substring({piece(j)}, 1, int({b} % {_PIECE})))"
        return f"if({i} = {j}, substring({piece(i)}, int({a} % {_PIECE}) + 1, int({b} - {a})), {across})"

    return cut(f"int({a} div {_PIECE})", f"int({b} div {_PIECE})")


def _mended(text: str, spans: str) -> str:
    """``text`` with its (sorted, not empty) spans replaced, in linear work."""
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    e, x, i = _fresh(3)

    def put(s: str, ends: str, pieces: str) -> str:
        before = f"if({i} > 0, get({ends}, {i} - 1), 0L)"
        kept = _let(before, lambda b: f"if({x}.start < {b}, '', concat({_between(pieces, b, f'{x}.start')}, get({names}, {x}.rank)))")
        rest = _let(f"get({ends}, size({ends}) - 1)", lambda b: _between(pieces, b, f"bigint(length({text}))"))
        return f"concat(array_join(transform({s}, ({x}, {i}) -> {kept}), ''), {rest})"

    pieces = f"regexp_extract_all({text}, r'(?s).{{1,{_PIECE}}}', 0)"
    ends = lambda s: _folds(f"transform({s}, {e} -> {e}.end)", "0L", lambda a, b: f"greatest({a}, {b})")
    return _let(spans, lambda s: _let(ends(s), lambda n: _let(pieces, lambda p: put(s, n, p))))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets; ``n_chars`` follows, null texts stay null.

    Of overlapping spans the one that begins first counts, and reaches to the end of the
    last.  All other columns stay as they are, whatever their names; repeated rows and rows
    without an id are each answered.  Texts are searched twice (for the patterns, then to
    replace) and never written between.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    accepted = patterns(base_spans(docs.select("text")))
    found = base_spans(rows if accepted.limit(INLINE + 1).count() <= INLINE else _keyed(rows))
    out = _with_found(found, accepted)
    some = F.size("spans") > 0
    out = out.withColumn("new", F.when(some, F.expr(_mended("text", "spans"))).otherwise(F.col("text")))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(some, F.length("new").cast(kind)).otherwise(F.col("row")["n_chars"])
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))

"""URL filters: rules by host and path, then naive Bayes over segmented host and path words.

Host names run words together.  A unigram model of the words in titles and paths splits
each distinct host label by Viterbi.  Multinomial naive Bayes learns from the urls that
rules decide, and judges the others by the words of host and path.  Hosts are scored once
each; a path is scored in its own row while the model fits a bound in bytes.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scan
from ._store import drop, table, written

#: (verdict, host, start of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Steps of a log odds of 1: sums of whole numbers don't depend on their order.
FIXED = 1_000_000
#: Characters of the longest word that segmentation looks for: those of the longest label of a host.
LONGEST = 63
#: Bytes of a table of words, hosts or weights that may be sent to every executor; larger ones are joined by shuffles.
SENT_BYTES = 16 << 20
SMOOTH = 1.0


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*+)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*+([^?#]*+)", 1)


def rule_and_verdict(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns ``host`` and ``path``; null where none does."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in order]
    pick = lambda values: reduce(lambda acc, x: x[0].when(x[1], x[2]) if acc is None else acc.when(x[1], x[2]), [(F, c, F.lit(v)) for c, v in zip(fits, values)], None)
    return pick([h + p for _, h, p in order]), pick([v for v, _, _ in order])


def _small(df: DataFrame, key: str) -> bool:
    """Whether a table (a text column and numbers) is within the bytes that may be sent."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(key) + 48), F.lit(0))).first()[0]
    return size <= SENT_BYTES


def _bounded(df: DataFrame, key: str) -> DataFrame:
    return F.broadcast(df) if _small(df, key) else df


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def unigrams(pages: DataFrame) -> DataFrame:
    """``word, n``: how often each word of at most LONGEST letters stands in the titles and paths of all pages."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<title[^>]*+>([^<]*+)", 1) if "html" in pages.columns else F.lit("")
    text = pages.select(F.concat_ws(" ", title, path_of(F.col("url"))).alias("t"))
    return text.select(F.explode(_words(F.col("t"))).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: float) -> list[str]:
    """Best split of a label into known words and, at a price per letter, unknown runs."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            n = counts.get(word)
            p = math.log(n / total) if n else -math.log(total) - 2.0 - 2.5 * (end - start)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def _pieces(batches):
    """``name, word``: what a window of each length up to LONGEST shows as it slides along a label, some thousand pieces at a time."""
    for batch in batches:
        for label, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for lo in range(0, len(label), 200):
                words = list({label[i:j] for i in range(lo, min(lo + 200, len(label))) for j in range(i + 1, min(i + LONGEST, len(label)) + 1)})
                yield pa.record_batch([pa.array([name] * len(words), pa.string()), pa.array(words, pa.string())], ["name", "word"])


def segments(labels: DataFrame, words: DataFrame, total: float) -> DataFrame:
    """``label, parts`` of distinct host labels (column ``label``)."""
    named = labels.where(F.length("label") > 0).select("label", F.sha2("label", 256).alias("name"))
    pieces = named.mapInArrow(_pieces, "name string, word string")
    known = pieces.join(_bounded(words, "word"), "word").distinct().groupBy("name").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))
    every = named.join(known, "name", "left")

    def split(batches):
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "parts": [viterbi(x, dict(zip(w, c)) if w is not None else {}, total) for x, w, c in zip(b["label"], b["words"], b["ns"])]})

    return every.mapInPandas(split, "label string, parts array<string>")


def _path_tokens(path: Column) -> Column:
    raw = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.transform(raw, lambda w: F.concat(F.lit("p:"), F.when(w.rlike("^[0-9]+$"), F.lit("<num>")).otherwise(w)))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page.

    ``rule`` is the longest that fits (null if none); ``verdict`` is the rule's, else that of
    naive Bayes (``score`` is its log odds for block, ties allow).  Null urls and urls
    without ``://`` have empty host and path and get the prior's verdict.  Repeated rows are
    each answered; an empty table gives no rows; other columns than ``html`` (for its title)
    aren't read.  Without urls of both verdicts the one there is holds, or allow.
    """
    spark = pages.sparkSession
    html = ["html"] if "html" in pages.columns else []
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), *html)
    words = written(unigrams(base), "unigrams")
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + 1.0
    u = base.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    u = u.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_and_verdict(rules)
    u = u.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))

    # counts by host first: a host with very many pages is one row from here on
    kinds = [F.sum(F.when(F.col("by_rule") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")]
    hosts = written(u.groupBy("host").agg(*kinds), "hosts")
    labels = hosts.select(F.explode(F.split("host", r"[^\p{L}\p{N}]+")).alias("label")).distinct()
    parts = written(segments(labels, words, total), "segments")
    host_tokens = hosts.select("host", "allow", "block", F.explode(F.split("host", r"[^\p{L}\p{N}]+")).alias("label")).join(_bounded(parts, "label"), "label")
    host_tokens = written(host_tokens.select("host", "allow", "block", F.explode("parts").alias("w")).select("host", "allow", "block", F.concat(F.lit("h:"), "w").alias("token")), "host-tokens")
    ruled = [F.sum(F.when(F.col("by_rule") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")]
    path_tokens = u.where("by_rule is not null").select("by_rule", F.explode(_path_tokens(F.col("path"))).alias("token")).groupBy("token").agg(*ruled)

    counts = host_tokens.select("token", "allow", "block").unionByName(path_tokens.select("token", "allow", "block")).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).where("allow + block > 0")
    counts = written(counts, "token-counts")
    size, na, nb = (float(x) for x in counts.agg(F.count("*"), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first())
    da, db = (float(x) for x in hosts.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first())
    odds = F.log((F.col("block") + SMOOTH) / (nb + SMOOTH * (size + 1))) - F.log((F.col("allow") + SMOOTH) / (na + SMOOTH * (size + 1)))
    odds = F.rint(odds * FIXED).cast("long")
    model = counts.select("token", odds.alias("odds"))
    prior = round(math.log(db / da) * FIXED) if da and db else (1 if db else -1) * 10**6 * FIXED

    by_host = host_tokens.join(_bounded(model, "token"), "token").groupBy("host").agg(F.sum("odds").alias("host_odds"))
    by_host = written(by_host, "host-odds")
    of_paths = model.where("startswith(token, 'p:')")
    if _small(of_paths, "token"):
        weight = {r["token"]: r["odds"] for r in of_paths.toArrow().to_pylist()}  # within SENT_BYTES
        u = u.withColumn("tokens", _path_tokens(F.col("path"))).mapInArrow(_path_odds(weight), u.schema.add("path_odds", "long"))
    else:
        paths = u.select("path").distinct().select("path", F.explode(_path_tokens(F.col("path"))).alias("token"))
        by_path = paths.join(of_paths, "token").groupBy("path").agg(F.sum("odds").alias("path_odds"))
        u = u.join(by_path, "path", "left")
    out = u.join(_bounded(by_host, "host"), "host", "left")
    score = (F.lit(prior).cast("long") + F.coalesce("host_odds", F.lit(0)) + F.coalesce("path_odds", F.lit(0))) / FIXED
    out = out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
    out = written(out, "judged")
    drop(spark, words, hosts, parts, host_tokens, counts, by_host)
    return out


def _path_odds(weight: dict[str, int]):
    """Adds ``path_odds``, the sum of the weights of a row's ``tokens``, which go."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                odds = [sum(weight.get(t, 0) for t in tokens) for tokens in part.column(part.schema.get_field_index("tokens")).to_pylist()]
                names = [n for n in part.schema.names if n != "tokens"]
                yield pa.record_batch([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(odds, pa.int64())], [*names, "path_odds"])
        _scan.trim()

    return run


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

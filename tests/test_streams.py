"""Frontier, robots validity and host health as streams: two triggers, a restart, replays, and the batch form's rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import health, membership, robots
from webloom.streaming import health as H
from webloom.streaming.frontier import Frontier


def run(query):
    query.awaitTermination(180)
    assert query.exception() is None


def in_triggers(spark, tmp_path, frames, stream, name):
    """Feed frames one after another, each with a restart of the query; all rows that came out, by trigger."""
    source, out = str(tmp_path / f"{name}-in"), []
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(df.schema).parquet(source)
        got = []
        q = stream(s).writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).outputMode("append" if name == "valid" else "update")
        run(q.option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start())
        out.append(got)
    return out


@pytest.fixture
def small_batches(spark):
    spark.conf.set(*H.STATE_STORE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frontier_of_batches(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    f = Frontier(spark, path, 5)
    rows = lambda *r: spark.createDataFrame(list(r), "url string, depth int, seq long")
    assert f.push(rows(("a", 2, 1), ("b", 0, 2), ("a", 1, 3), ("c", 1, 4)), "1") == 3
    assert f.push(rows(("z", 0, 9)), "1") == 0  # the batch was here before
    assert f.push(rows(("d", 0, 7), ("e", 0, 6), ("g", 0, 8), ("a", 0, 5)), "2") == 2 and {r.url for r in f.pending().collect()} == {"a", "b", "c", "d", "e"}
    assert f.push(rows(("h", 0, 10)), "3") == 0
    first = [tuple(r) for r in f.pop(2, "1").orderBy("depth", "seq").collect()]
    assert first == [("b", 0, 2), ("e", 0, 6)] == [tuple(r) for r in f.pop(2, "1").orderBy("depth", "seq").collect()]
    f.compact()
    again = Frontier(spark, path, 5)
    assert again.push(rows(("x", 0, 1)), "2") == 0 and again.push(rows(("b", 0, 1), ("g", 0, 8), ("h", 0, 10), ("i", 3, 11)), "4") == 2
    assert {r.url for r in again.pending().collect()} == {"a", "c", "d", "g", "h"} and again.seen().count() == 7
    assert again.pop(100, "2").count() == 5 and again.pending().count() == 0 and again.pop(1, "3").count() == 0


def test_frontier_of_a_stream(spark, tmp_path):
    path, source = f"file://{tmp_path}/f", str(tmp_path / "in")
    f = Frontier(spark, path, 1000)
    for n in range(3):
        df = spark.createDataFrame([(f"u{i % 70}", i % 3, n * 100 + i) for i in range(n * 30, n * 30 + 60)], "url string, depth int, seq long")
        df.write.mode("append").parquet(source)
        s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run(Frontier(spark, path, 1000).follow(s, "urls", str(tmp_path / "cp")))
        f.push(df, "urls-0")  # a replayed trigger
    assert sorted(r.url for r in f.pending().collect()) == sorted(f"u{i}" for i in range(70))


def test_saved_filter(spark, tmp_path, monkeypatch):
    urls = spark.range(20_000).select(F.concat(F.lit("https://e.com/"), F.col("id")).alias("url"))
    own = membership.SeenFilter.sized(10_000, 0.01)
    seen = urls.where("cast(substring(url, 15, 9) as int) < 10000")
    halves = [seen.where("xxhash64(url) % 2 = 0"), seen.where("xxhash64(url) % 2 <> 0").unionByName(spark.createDataFrame([(None,)], "url string"))]
    table = own.merge(*map(own.build, halves))
    path = f"file://{tmp_path}/filter"
    own.save(table, membership.merged_sketch(*map(membership.distinct_sketch, halves)), path)
    stored, table, sketch = membership.load(spark, path)
    assert (stored.bits, stored.hashes) == (own.bits, own.hashes) and sorted(map(tuple, table.collect())) == sorted(map(tuple, own.build(seen).collect()))
    assert abs(stored.count(table) - 10_000) < 300 and abs(membership.distinct_estimate(sketch) - 10_000) < 300
    for sent in (1 << 25, 0):
        monkeypatch.setattr(membership, "SENT_BYTES", sent)
        got = stored.maybe(urls, table).withColumn("in", F.expr("cast(substring(url, 15, 9) as int) < 10000")).groupBy("in", "maybe").count().collect()
        n = {(r["in"], r["maybe"]): r["count"] for r in got}
        assert n[True, True] == 10_000 and n.get((True, False), 0) == 0 and n.get((False, True), 0) < 200  # 1 percent of 10 000, doubled
        assert stored.unseen(urls, table, seen).count() == 10_000
        assert stored.maybe(spark.createDataFrame([(None,)], "url string"), table).first()["maybe"] is False
    assert own.maybe(urls, own.build(urls.limit(0))).where("maybe").count() == 0


def plain_allowed(rules, path):
    import re

    best = {True: -1, False: -1}
    for rule, allow in rules:
        if rule and (re.match("^" + ".*".join(map(re.escape, rule.split("*"))), path) if "*" in rule else path.startswith(rule)):
            best[allow] = max(best[allow], len(rule.encode()))
    return best[True] >= best[False]


def test_longest_rule_by_heads(spark):
    r = random.Random(6)
    text = lambda n: "/" + "".join(r.choice("ab/é*") for _ in range(r.randint(0, n)))
    rules = [(f"h{i % 3}", text(5), r.random() < 0.5) for i in range(120)] + [("h0", "*b", False), ("h0", "", True), ("h1", None, True), (None, "/a", True)]
    paths = [(f"h{i % 4}", text(9).replace("*", "x"), i) for i in range(400)] + [("h0", "/a", 1), ("h0", "/a", 1), (None, "/a", 2), ("h1", None, 3), ("h2", "", 4)]
    got = robots.evaluate(spark.createDataFrame(paths, "host string, path string, n int"), spark.createDataFrame(rules, "host string, rule string, allow boolean")).collect()
    assert len(got) == len(paths)
    for x in got:
        assert x.allowed == (x.host is None or x.path is None or plain_allowed([(b, c) for a, b, c in rules if a == x.host], x.path)), x


def test_very_many_rules_of_a_host(spark):
    rules = spark.range(50_000).select(F.lit("h").alias("host"), F.concat(F.lit("/p/"), F.col("id"), F.lit("/")).alias("rule"), (F.col("id") % 2 == 0).alias("allow"))
    paths = spark.range(20_000).select(F.lit("h").alias("host"), F.concat(F.lit("/p/"), F.col("id") * 5, F.lit("/x")).alias("path"), F.col("id"))
    got = robots.evaluate(paths, rules)
    assert got.where("allowed = (id * 5 >= 50000 or id % 2 = 0)").count() == 20_000
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_validity_stream_equals_batch(spark, tmp_path, small_batches):
    r = random.Random(7)
    rows, at = [], 0.0
    for i in range(400):
        at += r.choice([0.0, 10.0, 400.0, 40_000.0])
        rows.append((f"h{r.randint(0, 4)}", at, i, r.random() < 0.15, r.random() < 0.5))
    rows = [(h, datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=at), *rest) for h, at, *rest in rows]
    df = spark.createDataFrame(rows, "host string, at timestamp, seq long, fetch boolean, transient boolean")
    batch = robots.valid_at(df.where("not fetch").select("host", "at", "seq"), df.where("fetch").select("host", "at", "transient"))
    cuts = (0, 130, 131, 400)  # a moment that lies in one trigger only
    while rows[cuts[1]][1] == rows[cuts[1] - 1][1]:
        cuts = (0, cuts[1] + 1, cuts[1] + 2, 400)
    while rows[cuts[2]][1] == rows[cuts[2] - 1][1]:
        cuts = (0, cuts[1], cuts[2] + 1, 400)
    frames = [spark.createDataFrame(rows[a:b], df.schema) for a, b in zip(cuts, cuts[1:])]
    out = in_triggers(spark, tmp_path, frames, lambda s: H.validity_stream(s.where("not fetch"), s.where("fetch")), "valid")
    assert sorted(map(tuple, sum(out, []))) == sorted((x.host, x.seq, x.valid) for x in batch.collect())
    assert {x.valid for x in batch.collect()} == {True, False}


def test_fetches_and_requests_of_one_moment(spark):
    t = lambda s: datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=s)
    fetches = spark.createDataFrame([("a", t(0), True), ("a", t(0), False), ("b", t(0), True), ("b", t(600), None)], "host string, at timestamp, transient boolean")
    asked = spark.createDataFrame([("a", t(0), "x"), ("a", t(86399), "x"), ("a", t(86400), "x"), ("b", t(299), "y"), ("b", t(300), "y"), ("b", t(600), "y"), ("c", t(0), "z"), ("a", t(0), "x"), (None, t(0), "n")], "host string, at timestamp, transient string")
    got = sorted((str(r.host), r.at, r.valid) for r in robots.valid_at(asked, fetches).collect())
    assert [v for *_, v in got] == [False, True, True, True, False, True, False, True, False]


def test_health_streams_equal_batch(spark, tmp_path, small_batches):
    r = random.Random(8)
    rows = [(f"k{r.randint(0, 2)}", float(i * 7), i, r.random() < 0.6, r.choice([None, 20.0, 900.0, 5000.0])) for i in range(300)]
    shuffled = rows[:150], rows[150:]
    for part in shuffled:
        r.shuffle(part)
    frames = [spark.createDataFrame(p, "key string, at double, seq long, ok boolean, ms double") for p in shuffled]
    out = in_triggers(spark, tmp_path, frames, H.breaker_stream, "breaker")
    slow = in_triggers(spark, tmp_path, frames, H.limiter_stream, "limiter")
    for key in ("k0", "k1", "k2"):
        state, delay = None, None
        own = [x for x in rows if x[0] == key]
        for _, at, _, ok, ms in own:
            state = health.breaker_step(state, at, ok)
            delay = health.limiter_step(delay, ms) if ms is not None else delay
        got = next(x for x in out[1] if x.key == key)
        assert (got.state, got.failures, got.events) == (state[0], state[1], len(own))
        assert next(tuple(x)[1:] for x in slow[1] if x.key == key) == pytest.approx(delay)


def test_new_urls_and_error_rates(spark, tmp_path):
    t = lambda s: datetime.datetime(2025, 1, 1) + datetime.timedelta(seconds=s)
    frames = [spark.createDataFrame([(f"u{i % 5}", t(i), "k", i % 3 > 0) for i in range(lo, lo + 30)], "url string, ts timestamp, key string, ok boolean") for lo in (0, 30)]
    out = in_triggers(spark, tmp_path, frames, H.new_urls, "valid")
    assert sorted(x.url for x in sum(out, [])) == [f"u{i}" for i in range(5)]
    rates = in_triggers(spark, tmp_path, frames, H.error_rates, "rates")
    assert {(x.n, x.errors) for x in rates[1]} == {(60, 20)}


def test_buffers_of_a_stream(spark, tmp_path, small_batches):
    from webloom.operators import archive
    from webloom.streaming import buffers

    r = random.Random(11)
    rows = [(f"k{r.randint(0, 2)}", float(i // 3), i, f"n{r.randint(0, 9)}", f"v{i}") for i in range(240)]
    parts = [rows[:100], rows[100:101], rows[101:]]
    for p in parts:
        r.shuffle(p)
    frames = [spark.createDataFrame(p, "key string, at double, seq long, name string, value string") for p in parts]
    out = in_triggers(spark, tmp_path, frames, lambda s: buffers.last_rows(s.withColumnRenamed("value", "item"), 5), "rows")
    jar = in_triggers(spark, tmp_path, frames, lambda s: buffers.last_values(s, 4), "jar")
    every = spark.createDataFrame(rows, "key string, at double, seq long, name string, value string")
    batch = archive.newest(every, "key", ["at", "seq"], 5).collect()
    assert sorted((x.key, x.seq, x["item"]) for x in out[2]) == sorted((x.key, x.seq, x.value) for x in batch)
    assert [x.place for x in sorted(out[2], key=lambda x: (x.key, x.seq))] == [0, 1, 2, 3, 4] * 3
    cookies = archive.cookie_jar(every, "key", "name", "seq", 4).collect()
    assert sorted((x.key, x.name, x.seq) for x in jar[2]) == sorted((x.key, x.name, x.seq) for x in cookies)


def test_table_functions_in_sql(spark):
    from webloom.functions import dom
    from webloom.functions.table_functions import FUNCTIONS, register

    register(spark)
    pages = [(1, "<body id=b><video src=v></video><a href='/x'>x</a><button>y</button></body>"), (2, None), (3, "")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    kinds = {"page_elements": "structure", "page_media": "media", "page_accessibility": "accessibility", "page_links": "links", "page_census": "census"}
    for name, what in kinds.items():
        got = spark.sql(f"SELECT p.page_id, e.* FROM {{df}} p, LATERAL {name}(p.html) e", df=df)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dom.extract(df, what).collect())), name
    rules = spark.sql("SELECT * FROM robots_rules('User-agent: *\nDisallow: /a\nAllow: /a/b', 'x')").collect()
    assert [tuple(r) for r in rules] == [("/a/b", True), ("/a", False)] and set(FUNCTIONS) == {*kinds, "robots_rules"}


def test_breaker_of_ranges_equals_the_fold(spark):
    import numpy as np

    from webloom.operators import ranges

    r = random.Random(12)
    for _ in range(300):
        at, rows = 0.0, []
        for _ in range(r.randint(1, 60)):
            at += r.choice([0.0, 0.0, 0.5, 5.0, 30.0, 60.0, 61.0])
            rows.append((at, r.random() < r.choice([0.1, 0.5, 0.9])))
        cuts = sorted({0, len(rows), *[r.randint(0, len(rows)) for _ in range(4)]})
        state = (ranges.CLOSED, 0, 0.0)
        for a, b in zip(cuts, cuts[1:]):
            state = ranges.applied(state, ranges.Range(np.array([t for t, _ in rows[a:b]]), np.array([o for _, o in rows[a:b]])).summary())
        want = None
        for t, ok in rows:
            want = health.breaker_step(want, t, ok)
        assert state[:2] == want[:2] and (state[0] == ranges.CLOSED or state[2] == want[3]), (rows, cuts)


def test_breaker_of_a_hot_key(spark):
    from webloom.operators import ranges

    t0 = datetime.datetime(2025, 1, 1)
    r = random.Random(13)
    at, rows = 0.0, []
    for i in range(20_000):
        at += r.choice([0.0, 0.01, 1.0, 20.0])
        rows.append(("hot" if r.random() < 0.9 else f"k{r.randint(0, 9)}", t0 + datetime.timedelta(seconds=at), i, r.random() < 0.4))
    rows.append((None, t0, -1, True))
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, event_id long, ok boolean").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, ranges.breaker_states(df).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(tuple, health.breaker_states(df).collect())) and len(got) == 11
    assert ranges.breaker_states(df.limit(0)).count() == 0

"""Small cases of parsers, rewriters and folds, without Spark where it isn't needed."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions import markdown as M
from webloom.functions import urls as U
from webloom.operators import dedupe as D
from webloom.operators import frontier as R
from webloom.operators import health as H
from webloom.operators import rewrite as RW
from webloom.operators import robots as B


def test_css_scanner():
    css = ".a { background: url(https://example.com/fonts/foo\\(bar\\).woff2); }\n.b { background: url(\"https://example.com/spaced%20file.png\"); }"
    assert dom.css_scanned(css) == ["https://example.com/fonts/foo(bar).woff2", "https://example.com/spaced%20file.png"]
    assert dom.css_scanned("") == dom.css_scanned("url()") == [] and dom.css_scanned("URL(a") == ["a"]


@pytest.mark.parametrize(
    "html,markdown",
    [
        ("<div>a</div>", "<div>a</div>\n"),
        ("a<hr>b", "a---\n\nb\n"),
        ("<pre>x</pre>", "<pre>x</pre>\n"),
        ("<pre><code class='language-go'>x</code></pre>", "```go\nx\n```\n"),
        ("<h1>a\nb</h1><h2> c </h2>", "<h1>a\nb</h1>## c\n"),
        ("<p>a <a href='/x'>b</a></p>", "a b\n"),
        ("<a href='/x'>b</a><a name=y>c</a>", "[b](/x)<a name=y>c</a>\n"),
        ("<table></table>", "\n"),
        ("<table><tr><td>a</td></tr></table>", "| a |\n| --- |\n"),
        ("<!-- a\nb --><!-- c -->", "<!-- a\nb -->\n"),
        ("", "\n"),
        (None, "\n"),
    ],
)
def test_markdown(html, markdown):
    assert M.to_markdown(html) == markdown


def test_structure_of_a_wide_page():
    rows = dom.structure("<ul>" + "<li>x</li>" * 20_000 + "</ul>")
    assert rows[-1]["selector"] == "ul:nth-child(1) > li:nth-child(20000)" and rows[0]["child_count"] == 20_000


def test_articles():
    assert dom.article("<title> T </title><article>a<script>b</script></article>") == {"title": "T", "how": "article", "content": "a"}
    assert dom.article("<div id=content>c</div>")["how"] == "id=content"
    assert dom.article("<div>few</div><div>many words</div>")["content"] == "many words"
    assert dom.article("<body>x</body>")["how"] == "body" and dom.article("")["how"] == "none"


def test_robots_files():
    text = "# c\nUser-agent: *\nDisallow: /admin/\nCrawl-delay: 1.5\nSitemap: /a.xml\n\nUser-agent: WebLoom\nAllow: /admin/public/\nDisallow: /private/\nUser-agent: other\nDisallow: /"
    got = B.parse(text, "webloom/1.0")
    assert got == {"allow": ["/admin/public/"], "disallow": ["/admin/", "/private/"], "delay": 1.5, "sitemaps": ["/a.xml"]}
    assert B.by_status(503, "", "x")["disallow"] == ["/"] and B.by_status(404, "", "x")["disallow"] == []
    long = "é" * (300 << 10) + "\nUser-agent: *\nDisallow: /late"
    assert B.by_status(200, long, "x")["disallow"] == []  # bytes count, not characters


def test_robots_rules(spark):
    rules = [("h", "/admin/", False), ("h", "/private/", False), ("h", "/admin/public/", True), ("i", "/*.jpg", False), ("i", "/dir/*/end", False), ("j", "/page", False), ("j", "/page/public", True), ("k", "/a", False), ("k", "/a", True)]
    want = {("h", "/page"): True, ("h", "/admin/"): False, ("h", "/admin/public/"): True, ("h", "/private/secret"): False, ("h", "/public/page"): True, ("i", "/image.jpg"): False, ("i", "/dir/image.jpg"): False, ("i", "/dir/anything/end"): False, ("i", "/dir/anything/other"): True, ("j", "/page/public/file"): True, ("j", "/page/other"): False, ("k", "/a"): True}
    got = B.evaluate(spark.createDataFrame(list(want), "host string, path string"), spark.createDataFrame(rules, "host string, rule string, allow boolean"))
    assert {(r.host, r.path): r.allowed for r in got.collect()} == want


def test_breaker_steps():
    run = lambda rows: list(H.fold(H.breaker_step, rows))[-1][0]
    fails = [(t, False) for t in range(5)]
    assert run(fails) == "open" and run([*fails, (64.0, True)]) == "open"  # exactly 60 s after the last failure
    assert run([*fails, (64.5, True)]) == "half_open" and run([*fails, (64.5, True), (65, True)]) == "closed"
    assert run([*fails, (64.5, False)]) == "open"
    assert run([*fails, (64.5, True), (125, True)]) == "open"  # the probe never settled
    assert run([*fails[:4], (5, True), *fails[:4]]) == "closed"


def test_folds_by_key(spark):
    rows = [(k, f"2025-01-01 00:00:{s:02d}", i, i % 7 > 0 or k == "b") for i, (k, s) in enumerate((k, s) for k in "abc" for s in range(40))]
    e = spark.createDataFrame(rows, "user_id string, ts string, event_id long, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.user_id: (r.state, r.failures, r.events) for r in H.breaker_states(e).collect()}
    assert got["b"] == ("closed", 0, 40) and {n for *_, n in got.values()} == {40}
    assert H.breaker_states(e.limit(0)).count() == 0


@pytest.mark.parametrize(
    "url",
    ["https://U:p@H.com:443/a/../b%20c/?b=2&a=1&utm_source=x#/f", "http://h", "no url", "", "http://h/a\nb?c#d", "http://h/p?x\x00y", "HTTP://H:8080//a//?=&&#", "http://h/x.html?q=/a:b", "http://h/..%2f/x", "ftp://h/a"],
)
def test_parts_are_those_of_the_pattern(spark, url):
    df = spark.createDataFrame([(url,)], "url string")
    u = F.col("url")
    got = df.select(U.parts(u).alias("p"), F.array(*[U.part(u, n) for n in range(1, 6)]).alias("q")).first()
    assert got.p == got.q


def test_saved_versions(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    with pytest.raises(FileNotFoundError):
        R.load_state(spark, path)
    for n in (3, 5):
        R.save_state(path, frontier=spark.range(n), visited=spark.range(1))
    assert R.load_state(spark, path)["frontier"].count() == 5
    spark.range(9).write.parquet(f"{path}/lost/frontier")  # a run that stopped before its pointer moved
    assert R.load_state(spark, path)["frontier"].count() == 5


def test_bundles():
    m = {"https://e.com/m.js": "e.com/m.js"}
    js = 'import("https://e.com/m.js");a={publicPath:"/_next/"};__webpack_require__.p="//cdn/_next/";b={assetPrefix:"x"}'
    assert RW.rewrite_js(js, "https://e.com/a.js", "e.com/a.js", m) == 'import("./m.js");a={publicPath:"/_next/"};__webpack_require__.p="./_next/";b={assetPrefix:"./"}'
    assert RW.rewrite_js("x", "https://e.com/", "e.com/a.js", {}) == "x"


def test_localised_null_and_repeated_refs(spark):
    refs = spark.createDataFrame([("https://a/x.png",), ("https://a/x.png",), (None,), ("",), ("b",)], "url string")
    none = spark.createDataFrame([], "url string, path string")
    got = D.localised(refs, none, none.select("path"))
    assert got.count() == 5 and {r.how for r in got.collect()} == {"none"}


def test_site_maps_in_parts(spark):
    pages = spark.createDataFrame([(f"http://h/{i}",) for i in range(7)], "url string")
    got = sorted((r.part, r.body.count("<loc>")) for r in R.sitemaps(pages, most=3).collect())
    assert got == [(0, 3), (1, 3), (2, 1)]


def test_files_rotate(spark, tmp_path):
    from webloom.sources import files as S
    from webloom.sources import warc as W

    rows = spark.range(40).select(F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("date"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.encode(F.repeat(F.lit("x"), 1000), "UTF-8").alias("body")).coalesce(1)
    W.write_warc(rows, f"file://{tmp_path}/w", rotate=5_000)
    names = [n for n in W._listed(f"file://{tmp_path}/w", ".warc.gz")]
    assert len(names) >= 10 and W.read_warc(spark, f"file://{tmp_path}/w").count() == 40
    index = W.cdx(spark, f"file://{tmp_path}/w").collect()
    for r in index[:5]:  # a record is where the index says
        import gzip

        with open(f"{tmp_path}/w/{r.file}", "rb") as f:
            f.seek(r.offset)
            assert W.parse_record(gzip.decompress(f.read(r.length)))[0] == r.url
    e = spark.range(25).select(F.col("id").cast("string").alias("event_id"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("x").alias("type")).coalesce(1)
    S.write_audit(e, f"{tmp_path}/a", most=10)
    assert len(list((tmp_path / "a").rglob("*.json"))) == 3 and S.read_audit(spark, f"{tmp_path}/a").count() == 25


def test_rewritten_in_place_is_rewritten(spark, data):
    from webloom.functions import html as E

    p = spark.read.parquet(f"{data}/pages.parquet")
    refs = E.links(F.col("url"), F.col("html"))
    mapping = p.select("page_id", F.explode(F.array_distinct(refs)).alias("ref_url")).withColumn("path", U.path_for_url(F.col("ref_url")))
    want = RW.rewritten(p.withColumn("path", U.path_for_url(F.col("url"))), mapping)
    got = RW.rewritten_in_place(p, refs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("html like '%href=\"../%'").count() > 0
    assert "Exchange" not in got._jdf.queryExecution().toString().split("Physical Plan")[-1]


def test_replay_prefers_the_operation(spark):
    from webloom.operators import archive as A

    c = spark.createDataFrame([("https://h/graphql", "POST", 1, '{"operationName":"a"}'), ("https://h/graphql", "POST", 2, '{"operationName":"b"}'), ("https://h/x?q=1", "GET", 3, None), ("https://h/y", None, 4, None)], "url string, method string, seq long, body string")
    q = spark.createDataFrame([(1, "https://h/graphql", "POST", '{"operationName":"b"}'), (2, "https://h/x?q=2#f", "GET", None), (3, "https://h/x?q=1", "POST", None), (4, "https://h/y?z", "DELETE", None), (5, "https://h/none", "GET", None)], "id long, url string, method string, body string")
    assert {r.id: r.hit for r in A.replayed(q, c).collect()} == {1: 2, 2: 3, 3: None, 4: 4, 5: None}

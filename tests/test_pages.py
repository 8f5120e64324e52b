"""Extraction, markdown, rewriting, robots, health, archives and streams on small cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from webloom.functions import config, dom, markdown
from webloom.functions import html as H
from webloom.operators import frontier, health, plugins, rewrite, robots
from webloom.plans import registry
from webloom.sources import warc


def test_markdown():
    page = "<html><head><title>T</title><script>var a='<p>';</script></head><body><h2> Head </h2><p>One <b>two</b></p><ul><li>a</li><li><i>b</i></li></ul><ol><li>x</li></ol><a href='/l'>L</a><img src='/i.png' alt='I'><pre><code class='language-py'>x=1</code></pre><blockquote>q</blockquote><hr><table><tr><th>A</th></tr><tr><td>1</td></tr></table></body></html>"
    got = markdown.to_markdown(page)
    for part in ("## Head", "One two", "- a", "1. x", "[L](/l)", "![I](/i.png)", "```", "> q", "---", "| A |\n| --- |\n| 1 |"):
        assert part in got
    assert "var a" not in got and got.endswith("\n") and "\n\n\n" not in got
    assert markdown.to_markdown(None) == "\n"
    assert markdown.sanitize_ref("https://e.com/a b?c") == "e-com-a-b-c"


def test_extraction(spark):
    html = F.lit('<!-- <a href="/no"> --><a href="/a?x=1&amp;y=2">1</a><a href="#t">2</a><img src="//cdn.h/x.png"><a href="mailto:x@y">3</a><script>var u="<a href=\'/no2\'>"</script>')
    got = spark.range(1).select(H.links(F.lit("https://e.com/p/q"), html)).first()[0]
    assert got == ["https://e.com/a?x=1&y=2"]
    maps = F.lit('<script type="importmap">{"imports":{"a":"/a.js"}}</script><script type="module" src="/m.js"></script>')
    assert {tuple(x) for x in spark.range(1).select(H.module_urls(maps)).first()[0]} == {("importmap", "/a.js"), ("module-script", "/m.js")}


def test_exact_links_agree_with_native(spark, data):
    native = registry.queries()["e01_links"](spark, data).agg(F.sum("n")).first()[0]
    exact = registry.queries()["e01_exact_links"](spark, data).where("not ref rlike '^(#|javascript:|mailto:)'").agg(F.sum("n")).first()[0]
    assert native == exact


def test_dom():
    page = "<body><div id=a>x</div><p class='c d'>y</p><p><img><img alt=k></p><video src=v><source src=w></video></body>"
    got = dom.structure(page)
    assert [x["selector"] for x in got][1:3] == ["#a", "p.c"]
    assert dom.text_hash("ab") == f"{97 * 31 + 98:x}"
    assert dom.media(page) == [{"src": "v", "type": "video"}, {"src": "w", "type": "video-source"}]
    assert dom.accessibility(page)["missing_alt"] == 1 and dom.accessibility(page, strict=True)["missing_alt"] == 2


MAP = {"https://e.com/a.css": "e.com/a.css", "https://e.com/i.png": "e.com/img/i.png", "https://e.com/m.js": "e.com/m.js"}


def test_rewriting():
    page = '<base href="/"><link rel=x href="/a.css" integrity="sha"><img srcset="/i.png 1x, /no.png 2x" style="background:url(/i.png)"><a href="#x">k</a><style>@import "/a.css";</style>'
    got = rewrite.rewrite_html(page, "https://e.com/p/", "e.com/p/index.html", MAP)
    for part in ('href="../a.css"', 'integrity=""', 'srcset="../img/i.png 1x, /no.png 2x"', "url(../img/i.png)", 'href="#x"', '@import "../a.css"'):
        assert part in got
    assert "<base" not in got
    same = "<p class=a data-x='1'>t &amp; u</p><!-- <a href=/a.css> --><script>var a = '<a href=/a.css>'</script>"
    assert rewrite.rewrite_html(same, "https://e.com/", "e.com/index.html", {}) == same
    assert rewrite.rewrite_css("a{b:url( '/i.png' )}", "https://e.com/", "e.com", MAP) == "a{b:url('img/i.png')}"
    assert rewrite.rewrite_js('import("https://e.com/m.js")', "https://e.com/", "e.com/index.js", MAP) == 'import("./m.js")'
    assert '"assetPrefix":""' in rewrite.rewrite_next_data('<script id="__NEXT_DATA__">{"assetPrefix":"/x"}</script>', {})
    one = rewrite.inline_assets('<link rel="stylesheet" href="/a.css"><img src="/i.png">', "https://e.com/", {"https://e.com/a.css": ("text/css", b"p{}"), "https://e.com/i.png": ("image/png", b"\x00")})
    assert one == '<style>p{}</style><img src="data:image/png;base64,AA==">'


def test_robots(spark):
    text = "# c\nUser-agent: *\nDisallow: /all\nUser-agent: mybot\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\nUser-agent: *\nDisallow: /later\nSitemap: https://e.com/s.xml"
    got = robots.parse(text, "MyBot/1.0")
    assert got["disallow"] == ["/all", "/a"] and got["allow"] == ["/a/b"] and got["delay"] == 2.0 and got["sitemaps"] == ["https://e.com/s.xml"]
    assert robots.by_status(503, "", "x")["disallow"] == ["/"] and robots.by_status(404, "", "x")["disallow"] == []
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True), ("h", "/x*y$", False)], "host string, rule string, allow boolean")
    paths = spark.createDataFrame([("h", "/a/c"), ("h", "/a/b/c"), ("h", "/q"), ("h", "/x1y$"), ("h", "/x1y")], "host string, path string")
    assert {r.path: r.allowed for r in robots.evaluate(paths, rules).collect()} == {"/a/c": False, "/a/b/c": True, "/q": True, "/x1y$": False, "/x1y": True}


def test_breaker():
    s = None
    for i in range(5):
        s = health.breaker_step(s, float(i), False)
    assert s[0] == "open"
    assert health.breaker_step(s, 10.0, True)[0] == "open"
    half = health.breaker_step(s, 70.0, True)
    assert half[0] == "half_open" and health.breaker_step(half, 71.0, True)[0] == "closed" and health.breaker_step(half, 71.0, False)[0] == "open"


def test_cron(spark):
    rows = spark.createDataFrame([(datetime.datetime(2025, 1, 31, 23, 59),)], "ts timestamp_ntz")
    nxt = lambda f: health.cron_next(rows, f).first()["next"]
    assert nxt(["0", "0", "1", "*", "*"]) == datetime.datetime(2025, 2, 1)
    assert nxt(["*/20", "*", "*", "*", "*"]) == datetime.datetime(2025, 2, 1)
    assert nxt(["5", "4", "10", "*", "1"]) == datetime.datetime(2025, 2, 3, 4, 5)  # a Monday comes before the 10th


def test_cron_tables(spark):
    """A row looks its next minute up, whatever the calendar; the search ends by the minute; hours that clocks skip or repeat."""
    T = datetime.datetime
    times = [T(2023, 3, 1, 5), T(2024, 2, 28, 23, 59, 59, 9), T(1999, 12, 31, 23, 59), T(2100, 2, 27, 3, 7), T(2024, 1, 30, 4, 45), T(1960, 1, 1), None]
    rows = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    fits = {
        "0 10 29 2 *": lambda t: (t.minute, t.hour, t.day, t.month) == (0, 10, 29, 2),
        "30 6 13 2,3 0": lambda t: (t.minute, t.hour) == (30, 6) and t.month in (2, 3) and (t.day == 13 or t.isoweekday() == 7),
        "*/15 2-4 * * *": lambda t: t.minute % 15 == 0 and 2 <= t.hour <= 4,
        "*/25 23 */10 * 1-5": lambda t: t.minute % 25 == 0 and t.hour == 23 and (t.day % 10 == 1 or t.isoweekday() < 6),
        "0 0 30 2 *": lambda t: False,
        "0 24 * * *": lambda t: False,
    }
    one = datetime.timedelta(minutes=1)
    for fields, fit in fits.items():
        df = health.cron_next(rows, fields.split(), minutes=60_000)
        assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()  # no list of days or minutes a row
        for t, got in df.collect():
            tries = (t.replace(second=0, microsecond=0) + i * one for i in range(1, 60_001)) if t else ()
            assert got == (next(filter(fit, tries), t + 1440 * one) if t else None), (fields, t)
    year = {r.ts: r.next for r in health.cron_next(rows, ["0", "10", "29", "2", "*"]).where("next > ts").collect()}
    assert year[times[0]] == T(2023, 3, 2, 5)  # the 29th of February comes 300 minutes too late
    assert year[times[1]] == T(2024, 2, 29, 10) and year[times[5]] == T(1960, 2, 29, 10)
    far = {r.ts: r.next for r in health.cron_next(rows, ["0", "10", "29", "2", "*"], minutes=9 * 525_600).collect()}
    assert far[times[0]] == T(2024, 2, 29, 10) and far[times[3]] == T(2104, 2, 29, 10)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        at = spark.createDataFrame([("2024-11-03 06:20:07",), ("2025-03-09 07:20:07",)], "s string").selectExpr("to_timestamp(s || 'Z') AS ts")
        wait = health.cron_next(at, ["30", "1-2", "*", "*", "*"]).orderBy("ts").selectExpr("unix_seconds(next) - unix_seconds(ts)")
        assert [r[0] for r in wait.collect()] == [593, 79_793]  # the second 1:30 of the day; 22:09:53 from 3:20:07 to 1:30
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_plugins(spark):
    r = plugins.Registry()
    r.transformer("upper", F.upper)
    r.transformer("none", lambda c: F.lit(""))
    r.enricher("n", lambda c: F.create_map(F.lit("k"), F.lit("new")))
    with pytest.raises(ValueError):
        r.filter("upper", lambda c: c.isNotNull())
    df = spark.createDataFrame([("a", {"k": "old", "z": "1"})], "t string, m map<string,string>")
    assert r.transformed(df, "t").first()[0] == "A"
    assert r.enriched(df, "t", "m").first()[1] == {"k": "new", "z": "1"}


def test_frontier(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = frontier.expand(spark.createDataFrame([(1,)], "node long"), edges, 2)
    assert {tuple(r) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}


def test_warc_round_trip(spark, tmp_path):
    rows = [(f"https://e.com/{i}", datetime.datetime(2025, 1, 1, 0, i), "text/html", 200, bytes([i]) * 100) for i in range(20)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, warc.SCHEMA).repartition(3), path, rotate=1500)
    back = warc.read_warc(spark, path).collect()
    assert sorted((r.url, r.status, bytes(r.body)) for r in back) == sorted((u, s, b) for u, _, _, s, b in rows)
    index = warc.cdx(spark, path).collect()
    assert len(index) == 20
    one = index[7]
    import gzip

    with open(f"{path}/{one.file}", "rb") as f:
        f.seek(one.offset)
        assert warc.parse_record(gzip.decompress(f.read(one.length)))[0] == one.url
    import hashlib
    import json
    import os
    import zipfile

    out = str(tmp_path / "packages")
    made = warc.packages(spark, path, out, "t").collect()
    assert len(made) > 1 and sum(r.n_records for r in made) == 20 and {r.file for r in made} == {x for x in os.listdir(path) if x.endswith(".warc.gz")}
    text = "".join(open(f"{out}/datapackage/{n}").read() for n in sorted(os.listdir(f"{out}/datapackage")) if n.startswith("part-"))
    told = {x["path"]: x["hash"] for x in json.loads(text)["resources"]}
    for r in made:
        with open(f"{out}/{r.package}", "rb") as f:
            assert told[r.package] == r.hash == "sha256:" + hashlib.sha256(f.read()).hexdigest()
        with zipfile.ZipFile(f"{out}/{r.package}") as z, open(f"{path}/{r.file}", "rb") as f:
            assert z.read(f"archive/{r.file}") == f.read() and len(z.read("pages/pages.jsonl").splitlines()) == r.n_records + 1
    back = warc.read_packages(spark, out).collect()
    assert sorted((r.url, r.file, r.offset) for r in back) == sorted((r.url, r.file, r.offset) for r in index)
    with open(f"{out}/{made[0].package}", "r+b") as f:
        f.seek(150)
        f.write(b"xx")
    with pytest.raises(Exception, match="not as packaged|Bad CRC"):
        warc.read_packages(spark, out).collect()


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"max_depth": ${DEPTH}}')
    assert config.Config.load(str(p), {"DEPTH": "3"}).max_depth == 3
    with pytest.raises(ValueError, match="max_depth.*max_retries"):
        config.Config(max_depth=-1, max_retries=-1).validated()


def test_breaker_stream_equals_batch(spark, tmp_path, data):
    from webloom.streaming import health as stream

    spark.conf.set(*stream.STATE_STORE)
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ok", F.col("event_type") != "error")
    batch = {str(r.user_id): r.state for r in health.breaker_states(e).collect()}
    rows = e.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), "ok")
    rows.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream.breaker_stream(s).writeStream.format("memory").queryName("breakers").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.key: r.state for r in spark.table("breakers").collect()} == batch


def varied_pages(n: int = 100) -> list[str]:
    """Pages with several attributes a tag, quoted in each way or not, sets of sources, raw text and comments."""
    import random

    r, out = random.Random(3), []
    names = "href src action poster data-src data-srcset srcset data-url data-lazy-src title alt class data-x".split()
    for page in range(n):
        parts = []
        for _ in range(r.randint(1, 12)):
            attrs = []
            for name in r.sample(names, r.randint(0, 5)):
                value = r.choice(["/a%d", "b/c%d?x=1&amp;y=2", "https://e.com/d%d", "//cdn.e/%d", "#f%d", "javascript:%d", "mailto:a@%d"]) % r.randint(0, 99)
                value = ", ".join(f"/s{r.randint(0, 9)}.png {k}x" for k in (1, 2)) if "srcset" in name else value
                quote = r.choice(['"', "'", ""]) if " " not in value else r.choice("\"'")
                if quote == '"' and name in ("title", "alt"):
                    value += " > it's href='/no'"
                blank = r.choice(["", " ", "\n"])
                attrs.append(f"{r.choice([name, name.upper()])}{blank}={blank}{quote}{value}{quote}")
            parts.append(f"<{r.choice('a img video link form source div'.split())} {r.choice([' ', chr(9)]).join(attrs)}{r.choice(['', ' disabled', ' /'])}>")
            parts.append(r.choice(["text 1 < 2", "<!-- <a href='/no'> -->", "<script src='/s.js'>var x = '<a href=/no>'</script>", "<style>a > b{}</style>", "</div>"]))
        out.append("".join(parts))
    return out


def test_links_equal_a_tokenizer(spark):
    pages = varied_pages()
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    base = "https://e.com/p/q"
    got = {r.page_id: list(r.refs) for r in df.select("page_id", H.links(F.lit(base), F.col("html")).alias("refs")).collect()}
    from urllib.parse import urljoin, urlsplit

    for i, page in enumerate(pages):
        tree = dom.Tree(page)
        want = []
        for node in tree.nodes:
            for k, v in node["all"] if node["tag"] not in ("script", "style") else []:
                if k in ("srcset", "data-srcset"):
                    want += [urljoin(base, x.split()[0]) for x in v.split(",") if x.strip()]
                elif k in ("href", "src", "action", "poster", "data-src", "data-url", "data-lazy-src") and v and not v.startswith(("#", "javascript:", "mailto:")):
                    want.append(urljoin(base, v))
        want = [u for u in want if urlsplit(u).hostname in (None, "e.com")]
        assert got[i] == want, page


def test_raw_text_is_no_markup(spark):
    page = "<title><a href=/no></title><TEXTAREA x='>'><img src=/no></textarea><script src=/s.js><!-- </script><a href=/yes><style>x{}<a href=/no>"
    assert spark.range(1).select(H.links(F.lit("https://e.com/"), F.lit(page))).first()[0] == ["https://e.com/yes"]
    long = "<a href='/1' " + "x=1 " * 50_000 + "data-src=/2>"  # a tag with very many attributes
    assert spark.range(1).select(H.links(F.lit("https://e.com/"), F.lit(long))).first()[0] == ["https://e.com/1", "https://e.com/2"]


def test_asset_urls(spark):
    page = """<html><head>
<meta property="og:image" content="https://example.com/og.png"><link rel="stylesheet" href="https://example.com/assets/style.css"></head><body>
<img src="https://example.com/images/logo.png"><img srcset="https://example.com/a.jpg 1x, https://example.com/b.jpg 2x">
<script src="https://example.com/app.js"></script><a href="https://example.com/other-page">page</a><a href="https://example.com/file.pdf">pdf</a>
<video src="https://example.com/v.mp4" poster="https://example.com/p.png"></video><div style="background: url(https://example.com/bg.png)"></div></body></html>"""
    got = spark.range(1).select(H.asset_urls(F.lit("https://example.com/"), F.lit(page), css_relative=False)).first()[0]
    assert got == sorted(f"https://example.com/{x}" for x in "og.png assets/style.css images/logo.png a.jpg b.jpg app.js file.pdf v.mp4 p.png bg.png".split())
    assert spark.range(1).select(H.asset_urls(F.lit("https://e.com/"), F.lit(None).cast("string"))).first()[0] is None


def test_localised_pages():
    page = """<head><meta HTTP-EQUIV='Content-Security-Policy' content="default-src 'self'"><meta property="og:image" content="/i.png"><meta name=description content="/i.png">
<link rel=preload imagesrcset="/i.png 1x, /no.png 2x" imagesrc="/i.png"></head><body><div data-bg="/i.png" data-other-src="/i.png"></div><SCRIPT async src="a/ws-replay.js">
</SCRIPT></body></html>"""
    got = rewrite.rewrite_html(page, "https://e.com/p/", "e.com/p/index.html", MAP, replay="ws-replay.js")
    for part in ("content=\"default-src * &#x27;unsafe-inline&#x27;", 'property="og:image" content="../img/i.png"', 'name=description content="/i.png"', 'imagesrcset="../img/i.png 1x, /no.png 2x" imagesrc="../img/i.png"', 'data-bg="../img/i.png" data-other-src="/i.png"', '<script src="../../ws-replay.js"></script></body>'):
        assert part in got, part
    assert "a/ws-replay" not in got and "ws-replay" not in rewrite.rewrite_html(page, "https://e.com/p/", "e.com/p/index.html", MAP)


def test_crawled_pages():
    mapping = {"https://example.com/assets/style.css": "/output/example.com/assets/style.css", "https://example.com/assets/script.js": "/output/example.com/page/../assets/script.js"}
    page = '<html><head><base href="/x" target=_top><link href="https://example.com/assets/style.css"></head><body><script src="https://example.com/assets/script.js"></script></body></html>'
    got = rewrite.rewrite_crawled(page, "https://example.com/page/", "/output/example.com/page/index.html", mapping)
    assert '<base href="." target=_top>' in got and 'href="../assets/style.css"' in got and 'src="../assets/script.js"' in got and "https://example.com" not in got
    assert got.endswith('<script src="ws-replay.js"></script></body></html>') and rewrite.rewrite_crawled(got, "https://example.com/page/", "/output/example.com/page/index.html", mapping) == got
    assert rewrite.rewrite_crawled("<html><p>Hello</p></html>", "https://e.com/", "e.com/index.html", {}) == '<html><p>Hello</p><script src="ws-replay.js"></script></html>'
    assert rewrite.rewrite_crawled("<svg><text>Hello</text></svg>", "https://e.com/", "e.com/index.html", {}) == "<svg><text>Hello</text></svg>"
    text = "it's `https://e.com/a` and \"https://e.com/a/b\" 'https://e.com/a\" https://e.com/a"
    assert rewrite.rewrite_crawled(text, "https://e.com/", "e.com/index.html", {"https://e.com/a": "e.com/a.html", "https://e.com/a/b": "e.com/b.html"}) == "it's `a.html` and \"b.html\" 'https://e.com/a\" https://e.com/a"


def test_longest_replacement_equals_one_by_one():
    import random

    r = random.Random(5)
    for _ in range(200):
        keys = {"https://e.com/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 30))}
        pairs = {k: f"<{n}>" for n, k in enumerate(sorted(keys))}
        text = "".join(r.choice([*keys, "https://e.com/", "x", "a", '"']) for _ in range(30))
        want = text
        for k in sorted(keys, key=len, reverse=True):
            want = want.replace(k, pairs[k])
        assert rewrite.Longest(pairs).sub(text) == want


def test_repair(spark):
    from webloom.operators import dedupe

    html = r'<link href="https://example.com/assets/style.css"><img src="https://example.com/assets/img.png"><p style="b:url(https://example.com/a\(b\)\,c.png)">https://example.com/assets/img.png</p>'
    pages = spark.createDataFrame([(1, "https://example.com/home/", "site/home/index.html", html), (2, "https://example.com/", "site/index.html", None), (3, "https://o.e/", "o.e/index.html", "<img src=https://o.e/x.png>")], "page_id long, url string, path string, html string")
    files = [("https://example.com/assets/style.css", "site/assets/style.css"), ("https://example.com/assets/img.png", "site/assets/img.png"), ("https://example.com/a(b),c.png", "site/a(b),c.png")]
    got = {r.page_id: r.html for r in dedupe.repair(pages, spark.createDataFrame(files, "url string, path string")).collect()}
    assert got == {1: r'<link href="../assets/style.css"><img src="../assets/img.png"><p style="b:url(../a\(b\)\,c.png)">../assets/img.png</p>', 2: None, 3: "<img src=https://o.e/x.png>"}
    assert spark.range(1).select(dedupe.css_escaped(F.lit("https://example.com/a(b),c'"))).first()[0] == rewrite.css_escaped("https://example.com/a(b),c'") == r"https://example.com/a\(b\)\,c\'"


def test_next_data_always_has_a_prefix():
    assert rewrite.rewrite_next_data('<script id="__NEXT_DATA__">{"page":"/"}</script>', {}) == '<script id="__NEXT_DATA__">{"page":"/","assetPrefix":""}</script>'

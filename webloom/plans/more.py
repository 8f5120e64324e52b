"""Further queries: assets, closures, resume, plugins, archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..operators import dedupe as D
from ..operators import frontier as R
from ..operators import rewrite as RW
from . import sqltext as S
from .registry import query
from .urls import pages

_EXTRA = """<img src="/i%.png" srcset="https://h.e/s1.png 1x, https://h.e/s2.png 2x"><link href="https://h.e/a.css"><a href="https://h.e/page">x</a><div data-lazy-src="https://h.e/l.jpg" style="background:url(/bg.png)"></div><style>a{b:url('https://h.e/c.png')}</style><meta property="og:image" content="https://h.e/o.png">"""
# several url attributes in a tag, none quoted, signs of markup in values and in scripts
_EXTRA += """<video src="/v%.mp4" title='a > "b"' poster="https://h.e/p.png"></video><a href=https://h.e/u.pdf class=x>u</a><img alt="src=/no.png" data-src="https://h.e/d.png" src='https://h.e/t.gif'><script>x = '<img src="https://h.e/no.png">'</script><!-- <img src="https://h.e/no.png"> --><a href="#top"></a>"""
_TAGS = "'https://h.e/a.css', 'https://h.e/l.jpg', 'https://h.e/s1.png', 'https://h.e/s2.png', 'https://h.e/p.png', 'https://h.e/u.pdf', 'https://h.e/d.png', 'https://h.e/t.gif'"
_ABS = f"{_TAGS}, 'https://h.e/c.png', 'https://h.e/o.png'"


def with_assets(spark, d):
    return pages(spark, d).select("page_id", "url", F.replace(F.lit(_EXTRA), F.lit("%"), F.col("page_id").cast("string")).alias("html"))


_ROOT = f"{S.part('url', 1)} || '://' || {S.part('url', 2)}"


@query("e05_asset_urls", f"SELECT page_id, unnest([{_ABS}, {_ROOT} || '/bg.png']) AS asset FROM pages")
def e05(spark, d):
    return with_assets(spark, d).select("page_id", F.explode(H.asset_urls(F.col("url"), F.col("html"))).alias("asset"))


@query("e06_asset_urls_absolute", f"SELECT page_id, unnest([{_ABS}]) AS asset FROM pages")
def e06(spark, d):
    return with_assets(spark, d).select("page_id", F.explode(H.asset_urls(F.col("url"), F.col("html"), css_relative=False)).alias("asset"))


@query("e07_asset_urls_resolved", f"SELECT page_id, unnest([{_TAGS}, {_ROOT} || '/i' || page_id || '.png', {_ROOT} || '/v' || page_id || '.mp4']) AS asset FROM pages")
def e07(spark, d):
    return with_assets(spark, d).select("page_id", F.explode(H.asset_urls(F.col("url"), F.col("html"), relative=True, styles=False)).alias("asset"))


@query("e08_url_refs", f"SELECT page_id, unnest([{_TAGS}, 'https://h.e/c.png', 'https://h.e/page', {_ROOT} || '/bg.png', {_ROOT} || '/i' || page_id || '.png', {_ROOT} || '/v' || page_id || '.mp4']) AS ref FROM pages")
def e08(spark, d):
    return with_assets(spark, d).select("page_id", F.explode(H.url_refs(F.col("url"), F.col("html"))).alias("ref"))


@query("e10_module_urls", "SELECT page_id, x.type AS type, x.ref AS ref FROM (SELECT page_id, unnest([{'type': 'importmap', 'ref': '/a.js'}, {'type': 'importmap', 'ref': '/b/' || page_id}, {'type': 'module-script', 'ref': '/m.js'}]) AS x FROM pages)")
def e10(spark, d):
    html = F.concat(F.lit('<script type="importmap">{"imports":{"a":"/a.js","b":"/b/'), F.col("page_id").cast("string"), F.lit('"}}</script><script type="module" src="/m.js"></script>'))
    return pages(spark, d).select("page_id", F.explode(H.module_urls(html)).alias("x")).select("page_id", "x.type", "x.ref")


def _closure(n: int, most: int, suffix: str) -> str:
    return f"WITH RECURSIVE e AS (SELECT page_id AS src, (page_id * {n} + 1) % 1000 AS dst FROM pages), c AS (SELECT page_id AS node, 0 AS depth FROM pages WHERE page_id < 3 UNION SELECT dst, depth + 1 FROM c JOIN e ON e.src = c.node WHERE depth < {most}) SELECT 'https://h.e/' || node || '.{suffix}' AS node, min(depth) AS depth FROM c GROUP BY 1"


def _files(spark, d, n: int, suffix: str, text: str):
    """A stored file for each page: ``url`` and a text that names the next file."""
    url = lambda i: F.concat(F.lit("https://h.e/"), i.cast("string"), F.lit(f".{suffix}"))
    a, z = text.split("%")
    to = ((F.col("page_id") * n + 1) % 1000).cast("string")
    return pages(spark, d).select("page_id", url(F.col("page_id")).alias("url"), F.concat(F.lit(a), to, F.lit(z)).alias("body"))


@query("e11_js_closure", _closure(3, 3, "js"))
def e11(spark, d):
    """Scripts that scripts import, three levels deep: references are read from the scripts' texts."""
    files = _files(spark, d, 3, "js", 'const a = 1; import("./%.js"); fetch("/api/x")')
    return R.closure(files, H.js_imports(F.col("body")), files.where("page_id < 3").select(F.col("url").alias("node")), 3)


@query("e12_css_import_closure", _closure(5, 8, "css"))
def e12(spark, d):
    files = _files(spark, d, 5, "css", "@import url('%.css'); @charset \"x\"; a{b:url(i.png)}")
    return R.closure(files, H.css_imports(F.col("body")), files.where("page_id < 3").select(F.col("url").alias("node")), 8)


@query("e21_shadow_roots", "SELECT page_id, '<b>' || page_id || '</b>' AS root FROM pages")
def e21(spark, d):
    html = F.concat(F.lit('<x-a><template shadowrootmode="open"><b>'), F.col("page_id").cast("string"), F.lit("</b></template></x-a><template>no</template>"))
    return pages(spark, d).select("page_id", F.explode(H.shadow_roots(html)).alias("root"))


@query("e23_json_of_element", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '{\"id\":' || page_id || '}' END AS data FROM pages")
def e23(spark, d):
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"id": '), F.col("page_id").cast("string"), F.lit("}"))).otherwise("{broken")
    html = F.concat(F.lit('<script type="application/json" id="data">'), body, F.lit("</script>"))
    return pages(spark, d).select("page_id", H.json_of(html, "data").alias("data"))


@query("f10_checkpoint", f"SELECT page_id, {S.normal_url('url')} AS url FROM pages")
def f10(spark, d):
    """A frontier's table as it comes back from a saved version."""
    from ..sources.warc import shared_folder

    p = pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("url"))
    path = shared_folder(spark, "frontier")
    R.save_state(path, frontier=p.limit(0))
    R.save_state(path, frontier=p)
    return R.load_state(spark, path)["frontier"]


@query("f11_resume", f"WITH v AS (SELECT DISTINCT {S.normal_url('url')} AS url FROM pages WHERE page_id % 3 = 0), w AS (SELECT DISTINCT {S.normal_url('url')} AS url FROM pages) SELECT url, 1 AS depth FROM w WHERE url NOT IN (SELECT url FROM v) AND NOT ({S.holds('url', U.T.RESUME_RAW)} OR {S.holds('lower(' + S.part('url', 3) + ')', U.T.RESUME_PATHS)})")
def f11(spark, d):
    p = pages(spark, d)
    return R.resume(p.where("page_id % 3 = 0"), p)[1]


_CRAWLED = """<base href='/'><meta http-equiv=content-security-policy content="default-src 'self'"><a href='/i%.png'>x</a><script>a="https://e.com/i%.png",b='https://e.com/i%.png/2',c=`https://e.com/i%.png`,d="https://e.com/i%.png?q",e='it"s'</script><body></body></html>"""
_CRAWLED_TO = """<base href="."><meta http-equiv="Content-Security-Policy" content="default-src * &#x27;unsafe-inline&#x27; &#x27;unsafe-eval&#x27; data: blob:;"><a href="i%.png">x</a><script>a="i%.png",b='i%/2.png',c=`i%.png`,d="https://e.com/i%.png?q",e='it"s'</script><body><script src="ws-replay.js"></script></body></html>"""


@query("d07_rewrite_quoted", f"SELECT page_id, replace({S.quoted([_CRAWLED_TO])}, '%', page_id::VARCHAR) || html AS html FROM pages")
def d07(spark, d):
    """A crawl's page: base, policy, quoted urls in scripts (longest first), replay script; the stored page behind it stays as it is."""
    n = F.col("page_id").cast("string")
    html = F.replace(F.lit(_CRAWLED), F.lit("%"), n)
    p = pages(spark, d, "html").select("page_id", F.lit("https://e.com/p/").alias("url"), F.lit("e.com/p/index.html").alias("path"), F.concat(html, F.regexp_replace("html", "</(?=body>|html>)", "</ ")).alias("html"))
    files = F.array(*[F.struct(F.concat(F.lit("https://e.com/i"), n, F.lit(a)).alias("ref_url"), F.concat(F.lit("e.com/p/i"), n, F.lit(b)).alias("path")) for a, b in ((".png", ".png"), (".png/2", "/2.png"))])
    return RW.rewritten(p, p.select("page_id", F.inline(files)), RW.rewrite_crawled).withColumn("html", F.regexp_replace("html", "</ ", "</"))


@query("d09_rewrite_css", "SELECT page_id, 'a{b:url(../i' || page_id || '.png)} @import \"/no.css\";' AS css FROM pages")
def d09(spark, d):
    n = F.col("page_id").cast("string")
    p = pages(spark, d).select("page_id", F.lit("https://e.com/c/x.css").alias("url"), F.lit("e.com/c/x.css").alias("path"), F.concat(F.lit("a{b:url(/i"), n, F.lit('.png)} @import "/no.css";')).alias("css"))
    m = p.select("page_id", F.concat(F.lit("https://e.com/i"), n, F.lit(".png")).alias("ref_url"), F.concat(F.lit("e.com/i"), n, F.lit(".png")).alias("path"))
    return RW.rewritten(p, m, RW.rewrite_css_file, "css")


_JS = """import("https://e.com/m%.js");import("./kept.js");x={assetPrefix:"/q"};__webpack_require__.p="https://e.com/_next/";y={publicPath:"/_next/"};__webpack_require__.e("c%");z={buildId:"b",loader:"https://e.com/m%.js"};w="//e.com/m%.js";v="https://o.e/n.js\""""


@query("d10_rewrite_js", """SELECT page_id, replace('import("./m%.js");import("./kept.js");x={assetPrefix:"./"};__webpack_require__.p="./_next/";y={publicPath:"/_next/"};__webpack_require__.e("c%");z={buildId:"b",loader:"./m%.js"};w="./m%.js";v="https://o.e/n.js"', '%', page_id::VARCHAR) AS js FROM pages""")
def d10(spark, d):
    """Every pass over a bundle: what has a file is mapped, relative paths, chunks and build ids stay."""
    n = F.col("page_id").cast("string")
    p = pages(spark, d).select("page_id", F.lit("https://e.com/a.js").alias("url"), F.lit("e.com/a.js").alias("path"), F.replace(F.lit(_JS), F.lit("%"), n).alias("js"))
    m = p.select("page_id", F.concat(F.lit("https://e.com/m"), n, F.lit(".js")).alias("ref_url"), F.concat(F.lit("e.com/m"), n, F.lit(".js")).alias("path"))
    return RW.rewritten(p, m, RW.rewrite_js, "js")


@query("d13_css_escaped", r"SELECT page_id, 'a\(' || page_id || '\)\, b\''c' AS escaped FROM pages")
def d13_escaped(spark, d):
    return pages(spark, d).select("page_id", D.css_escaped(F.concat(F.lit("a("), F.col("page_id").cast("string"), F.lit("), b'c"))).alias("escaped"))


@query("a09_warc_round_trip", "SELECT url, strlen(html)::INTEGER AS n_bytes, md5(html) AS body_md5 FROM pages")
def a09(spark, d):
    """Pages as they come back from WARC files."""
    from ..sources.warc import read_warc, shared_folder, write_warc

    p = pages(spark, d, "html").select("url", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("date"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.encode("html", "UTF-8").alias("body"))
    path = shared_folder(spark, "warc")
    write_warc(p, path, rotate=1 << 20)
    return read_warc(spark, path).select("url", F.octet_length("body").alias("n_bytes"), F.md5("body").alias("body_md5"))


@query("a17_json_lines", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') AND ts::DATE <= (SELECT min(ts)::DATE FROM events)")
def a17(spark, d):
    """Audit events of the first day, as they come back from daily JSON lines."""
    from ..sources.files import read_audit, write_audit
    from ..sources.warc import shared_folder

    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("actor"))
    path = shared_folder(spark, "audit")
    write_audit(rows, path)
    first = str(e.agg(F.to_date(F.min("ts"))).first()[0])
    return read_audit(spark, path, until=first, type=["error", "view"]).select(F.col("event_id").cast("long").alias("event_id"), F.col("type").alias("event_type"))


@query("p02_transformers", "SELECT page_id, lower(regexp_replace(html, '<[^>]*>', '', 'g')) AS html FROM pages")
def p02(spark, d):
    from ..operators.plugins import Registry

    r = Registry()
    r.transformer("strip", lambda c: F.regexp_replace(c, "<[^>]*>", ""))
    r.transformer("lower", F.lower)
    r.transformer("empty", lambda c: F.lit(""))
    return r.transformed(pages(spark, d, "html"), "html").select("page_id", "html")


@query("p04_enrichers", "SELECT page_id, unnest(['host', 'n']) AS key, unnest([regexp_extract(url, '://([^/]*)', 1), 'new']) AS value FROM pages")
def p04(spark, d):
    from ..operators.plugins import Registry

    r = Registry()
    r.enricher("host", lambda c: F.create_map(F.lit("host"), F.regexp_extract(c, "://([^/]*)", 1)))
    r.enricher("n", lambda c: F.create_map(F.lit("n"), F.lit("new")))
    rows = pages(spark, d).withColumn("m", F.create_map(F.lit("n"), F.lit("old")))
    return r.enriched(rows, "url", "m").select("page_id", F.explode("m").alias("key", "value"))

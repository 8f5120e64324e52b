"""Queries of extraction and markdown over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markdown as M
from ..functions import tables as T
from . import sqltext as S
from .registry import query
from .urls import pages

_VIS = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
_ATTRS = "|".join([*T.URL_ATTRS, *T.DATA_URL_ATTRS, "srcset"])
_ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)?)?"""
_TAG = rf"<[a-zA-Z][^\s/>]*(?:[\s/=]+|{_ATTRIBUTE})*>"
_SETS = "name IN ('srcset', 'data-srcset')"


def attributes_sql(source: str = "pages", names: str = _ATTRS, but: str = "script|style") -> str:
    """CTEs that end in ``refs (page_id, url, tag_no, attr_no, ref_no, name, ref)``: tags are cut first, then all attributes of each."""
    return rf"""WITH tags AS (SELECT page_id, url, unnest(t) AS tag, generate_subscripts(t, 1) AS tag_no FROM (SELECT page_id, url, regexp_extract_all({_VIS}, '{_TAG}') AS t FROM {source})),
attrs AS (SELECT page_id, url, tag_no, unnest(a) AS a, generate_subscripts(a, 1) AS attr_no FROM (SELECT page_id, url, tag_no, regexp_extract_all(tag, '{_ATTRIBUTE}') AS a FROM tags WHERE NOT regexp_matches(tag, '(?i)^<(?:{but})[\s/>]'))),
named AS (SELECT page_id, url, tag_no, attr_no, lower(regexp_extract(a, '^[^\s=]*')) AS name, regexp_replace(a, '^[^=]*=\s*', '') AS v FROM attrs WHERE regexp_matches(a, '(?i)^(?:{names})\s*=')),
plain AS (SELECT page_id, url, tag_no, attr_no, name, replace(CASE WHEN v[1] IN ('"', '''') THEN substr(v, 2, length(v) - 2) ELSE v END, '&amp;', '&') AS v FROM named),
refs AS (SELECT page_id, url, tag_no, attr_no, name, generate_subscripts(r, 1) AS ref_no, unnest(r) AS ref FROM (SELECT *, CASE WHEN {_SETS} THEN list_transform(string_split(v, ','), lambda x: string_split(trim(x), ' ')[1]) ELSE [v] END AS r FROM plain))"""


_KEPT = f"ref <> '' AND ({_SETS} OR NOT regexp_matches(ref, '^(?:#|javascript:|mailto:)'))"
_LINKS = f"""{attributes_sql()}, l AS (SELECT *, {S.part('url', 1)} || '://' || {S.part('url', 2)} || ref AS link FROM refs WHERE {_KEPT} AND starts_with(ref, '/') AND NOT starts_with(ref, '//'))"""


@query("e01_links", f"{_LINKS} SELECT page_id, link, count(*) AS n FROM l GROUP BY 1, 2")
def e01(spark, d):
    out = pages(spark, d, "html").select("page_id", F.explode(H.links(F.col("url"), F.col("html"))).alias("link"))
    return out.groupBy("page_id", "link").agg(F.count("*").alias("n"))


#: Markup that stands before each stored page: several url attributes in a tag, unquoted and single-quoted values, sets, raw text.
_MANY = """<video poster="/p%.png" src='/v%.mp4'></video><img src=/i%.png title="x href='/no' > y" srcset="/a%.png 1x, /b%.png 2x" data-src=/l%.png><textarea><a href="/no"></textarea><FORM ACTION = /f%/s.cgi><source data-srcset="/c%.webp 100w"><a href="/q%?a=1&amp;b=2" data-url="/u%">z</a>"""


@query("e01_links_of_many_attributes", f"{attributes_sql('(SELECT page_id, url, replace(' + S.quoted([_MANY.replace('<textarea><a href="/no"></textarea>', '')]) + ', chr(37), page_id::VARCHAR) || html AS html FROM pages)')} SELECT page_id, {S.part('url', 1)} || '://' || {S.part('url', 2)} || ref AS link, count(*) AS n FROM refs WHERE {_KEPT} AND starts_with(ref, '/') GROUP BY 1, 2")
def e01_many(spark, d):
    p = pages(spark, d, "html").withColumn("html", F.concat(F.replace(F.lit(_MANY), F.lit("%"), F.col("page_id").cast("string")), "html"))
    return p.select("page_id", F.explode(H.links(F.col("url"), F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("e01_links_per_host", f"{_LINKS} SELECT {S.host('url')} AS host, count(*) AS n_links FROM l GROUP BY 1")
def e01_hosts(spark, d):
    from ..functions import urls as U

    out = pages(spark, d, "html").select(U.host(F.col("url")).alias("host"), F.size(H.links(F.col("url"), F.col("html"))).alias("n"))
    return out.groupBy("host").agg(F.sum("n").alias("n_links"))


_CSS = """'@font-face{font-family:a;src:url("/f/a.woff2") format("woff2"),url(/f/a.ttf)} .x{background:url(''/img/' || page_id || '.png'')} .y{src:url(data:image/png;base64,AA)} .z{background:url( /img/z.png )}'"""


def _css():
    return F.concat(F.lit('@font-face{font-family:a;src:url("/f/a.woff2") format("woff2"),url(/f/a.ttf)} .x{background:url(\'/img/'), F.col("page_id").cast("string"), F.lit(".png')} .y{src:url(data:image/png;base64,AA)} .z{background:url( /img/z.png )}"))


@query("e02_font_urls", "SELECT page_id, unnest(['/f/a.woff2', '/f/a.ttf']) AS ref FROM pages")
def e02(spark, d):
    return pages(spark, d).select("page_id", F.explode(H.font_urls(_css())).alias("ref"))


@query("e03_css_urls", "WITH c AS (SELECT page_id, " + _CSS + " AS css FROM pages), u AS (SELECT page_id, unnest(regexp_extract_all(css, '(?i)url\\(\\s*[\"'']?([^\"'')]+)[\"'']?\\s*\\)', 1)) AS ref FROM c) SELECT DISTINCT page_id, trim(ref) AS ref FROM u WHERE NOT starts_with(ref, 'data:')")
def e03(spark, d):
    return pages(spark, d).select("page_id", F.explode(H.css_urls(_css())).alias("ref"))


_JS = """import("./a.js"); const b = require('b'); fetch("/api/x"); axios.post('/p', 1); x.open("GET", "/xhr"); importScripts("/w.js"); System.import('s.js'); __webpack_require__("m")"""


@query("e09_js_urls", "SELECT page_id, x.type AS type, x.ref AS ref FROM (SELECT page_id, unnest([{'type': 'dynamic-import', 'ref': './a.js'}, {'type': 'require', 'ref': 'b'}, {'type': 'fetch', 'ref': '/api/x'}, {'type': 'xhr-open', 'ref': '/xhr'}, {'type': 'importScripts', 'ref': '/w.js'}, {'type': 'dynamic-import', 'ref': 's.js'}, {'type': 'system-import', 'ref': 's.js'}, {'type': 'axios', 'ref': '/p'}, {'type': 'webpack-require', 'ref': 'm'}]) AS x FROM pages)")
def e09(spark, d):
    js = F.lit(_JS)
    return pages(spark, d).select("page_id", F.explode(H.js_urls(js)).alias("x")).select("page_id", "x.type", "x.ref").distinct()


@query("e13_meta_tags", "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html || '<meta property=\"og:title\" content=\"T\">', '(?i)<meta\\b[^>]*>')) AS tag FROM pages) SELECT page_id, regexp_extract(tag, '(?i)\\s(?:property|name)\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS name, regexp_extract(tag, '(?i)\\s(?:content)\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS content FROM t WHERE regexp_extract(tag, '(?i)\\s(?:property|name)\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) <> ''")
def e13(spark, d):
    html = F.concat("html", F.lit('<meta property="og:title" content="T">'))
    return pages(spark, d, "html").select("page_id", F.explode(H.meta_pairs(html)).alias("m")).select("page_id", "m.name", "m.content")


_LD = """<script type="application/ld+json">{"@id": %s}</script><script type='application/ld+json'>{broken</script><meta property="og:title" content="T"><meta name="twitter:card" content="c"><meta name="author" content="A"><meta name="author" content="B">"""


@query("e13_structured_data", "SELECT page_id, ['{\"@id\":' || page_id || '}'] AS jsonld, 'T' AS og_title, 'c' AS twitter_card, 'B' AS author FROM pages")
def e13_all(spark, d):
    a, b = _LD.split("%s")
    x = pages(spark, d).select("page_id", H.structured_data(F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(b))).alias("x"))
    return x.select("page_id", "x.jsonld", F.col("x.og")["title"].alias("og_title"), F.col("x.twitter")["card"].alias("twitter_card"), F.col("x.meta")["author"].alias("author"))


@query("e14_article_ladder", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'class=content' WHEN 2 THEN 'itemprop=articleBody' ELSE 'largest' END AS how, 'words ' || page_id AS content FROM pages")
def e14_ladder(spark, d):
    from ..functions import dom

    n = F.concat(F.lit("words "), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 4
    a = F.when(kind == 0, F.lit("<article><p>")).when(kind == 1, F.lit('<p class="x content">')).when(kind == 2, F.lit('<b itemprop=articleBody>')).otherwise(F.lit("<section>"))
    z = F.when(kind == 0, F.lit("</p></article>")).when(kind == 1, F.lit("</p>")).when(kind == 2, F.lit("</b>")).otherwise(F.lit("</section>"))
    p = pages(spark, d).select("page_id", F.concat(F.lit("<body><div>few</div>"), a, n, z, F.lit("</body>")).alias("html"))
    return dom.extract(p, "article").select("page_id", "how", "content")


@query("e14_article", "SELECT page_id, md5(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)) AS article_md5 FROM pages")
def e14(spark, d):
    return pages(spark, d, "html").select("page_id", F.md5(H.article(F.col("html"))).alias("article_md5"))


_TEXT = f"regexp_replace({_VIS}, '<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"


@query("e15_text_stats", f"SELECT page_id, md5(trim(regexp_replace({_TEXT}, '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS text_md5, length(trim(regexp_replace({_TEXT}, '[ \\t\\n\\f\\r]+', ' ', 'g')))::INTEGER AS n_chars FROM pages")
def e15(spark, d):
    t = H.text_content(F.col("html"))
    return pages(spark, d, "html").select("page_id", F.md5(t).alias("text_md5"), F.length(t).alias("n_chars"))


@query("e17_iframes", "SELECT page_id, unnest(['/f?' || page_id, '/lazy']) AS src FROM pages")
def e17(spark, d):
    html = F.concat(F.lit('<iframe src="/f?'), F.col("page_id").cast("string"), F.lit('"></iframe><IFRAME data-src=\'/lazy\'></IFRAME><iframe title="x"></iframe>'))
    return pages(spark, d).select("page_id", F.explode(H.iframe_sources(html)).alias("src"))


_SIGNS = ["<div id=\"__next\">", "<script>window.__NUXT__={}</script>", "<p class='a svelte-1x'>", "<app ng-version=\"17\">", "<b data-v-=1>", "__NEXT_DATA__", "plain"]


@query("e19_framework", f"SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'react' WHEN 1 THEN 'nuxt' WHEN 2 THEN 'svelte' WHEN 3 THEN 'angular' WHEN 4 THEN 'vue' WHEN 5 THEN 'nextjs' ELSE 'unknown' END AS framework FROM pages")
def e19(spark, d):
    sign = F.get(F.array(*[F.lit(x) for x in _SIGNS]), (F.col("page_id") % 7).cast("int"))
    return pages(spark, d, "html").select("page_id", H.framework(F.concat("html", sign)).alias("framework"))


@query("e20_routes", f"{_LINKS}, x AS (SELECT page_id, link, min(tag_no * 1000000 + attr_no * 1000 + ref_no) AS pos FROM l GROUP BY 1, 2) SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM x) WHERE k <= 50")
def e20(spark, d):
    return pages(spark, d, "html").select("page_id", F.explode(H.routes(F.col("url"), F.col("html"))).alias("link"))


_PUSHED = """<div class="app is-loading"><script>history.pushState({a: 1}, '', '/r%/1'); window.history.replaceState(null, "t", "r%?x=1"); history.pushState(s, '', '/r%/1'); history.pushState({}, '', link)</script></div>"""


@query("e20_pushed_routes", f"SELECT page_id, unnest([{S.part('url', 1)} || '://' || {S.part('url', 2)} || '/r' || page_id || '/1', {S.part('url', 1)} || '://' || {S.part('url', 2)} || coalesce(nullif(regexp_replace({S.part('url', 3)}, '[^/]*$', ''), ''), '/') || 'r' || page_id || '?x=1']) AS link FROM pages")
def e20_pushed(spark, d):
    html = F.concat(F.replace(F.lit(_PUSHED), F.lit("%"), F.col("page_id").cast("string")), "html")
    p = pages(spark, d, "html").withColumn("html", html)
    return p.select("page_id", F.explode(H.routes_to_crawl(F.col("url"), F.col("html"), H.pushed_routes(F.col("html")))).alias("link"))


@query("e19_skeleton", "SELECT page_id, page_id % 3 <> 2 AS skeleton FROM pages")
def e19_skeleton(spark, d):
    sign = F.get(F.array(F.lit("<i class='a shimmer-2'>"), F.lit('<i title="x" class="loader b">'), F.lit('<i title="class=\'loading\'" class="preloader loadin"> spinner')), (F.col("page_id") % 3).cast("int"))
    return pages(spark, d, "html").select("page_id", H.skeleton(F.concat("html", sign)).alias("skeleton"))


@query("e24_sitemap_locs", "SELECT page_id, url AS loc FROM pages UNION ALL SELECT page_id, 'http://x/' || page_id FROM pages")
def e24(spark, d):
    esc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<urlset><url><loc> "), esc, F.lit("\n</loc></url><x:loc>http://x/"), F.col("page_id").cast("string"), F.lit("</x:loc></urlset>"))
    return pages(spark, d).select("page_id", F.explode(H.sitemap_locs(xml)).alias("loc"))


@query("e25_graphql_operation", "SELECT event_id, coalesce(json_extract_string('{\"operationName\":\"' || event_type || '\",\"x\":1}', '$.operationName'), '') AS op FROM events")
def e25(spark, d):
    body = F.concat(F.lit('{"operationName":"'), F.col("event_type"), F.lit('","x":1}'))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", H.graphql_operation(body).alias("op"))


@query("e26_challenge", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'recaptcha' WHEN 1 THEN 'hcaptcha' WHEN 2 THEN 'generic' END AS widget FROM pages")
def e26(spark, d):
    sign = F.get(F.array(*[F.lit(x) for x in ("<div class='g-recaptcha' data-sitekey=1>", "<script src=//hcaptcha.com/1.js>", "<div data-sitekey='k'>", "")]), (F.col("page_id") % 4).cast("int"))
    return pages(spark, d, "html").select("page_id", H.challenge(F.concat("html", sign)).alias("widget"))


@query("m01_title", "SELECT page_id, CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE 'Untitled' END AS title FROM pages")
def m01(spark, d):
    return pages(spark, d, "html").select("page_id", H.title(F.col("html")).alias("title"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?i)<!--.*?-->', '', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g')"


@query("m02_clean_html", f"SELECT page_id, md5({_CLEAN}) AS clean_md5, strlen({_CLEAN})::INTEGER AS n_bytes FROM pages")
def m02(spark, d):
    c = M.clean_html(F.col("html"))
    return pages(spark, d, "html").select("page_id", F.md5(c).alias("clean_md5"), F.octet_length(c).alias("n_bytes"))


_HEAD = "html"
for _n in range(1, 7):
    _HEAD = f"regexp_replace({_HEAD}, '(?i)<h{_n}[^>]*>(.*?)</h{_n}>', '{'#' * _n} \\1' || chr(10) || chr(10), 'g')"


@query("m03_headings", f"SELECT page_id, md5({_HEAD}) AS md FROM pages")
def m03(spark, d):
    return pages(spark, d, "html").select("page_id", F.md5(M.headings(F.col("html"))).alias("md"))


@query("m05_emphasis", "SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?is)<(strong|b)[^>]*>(.*?)</(?:strong|b)>', '**\\2**', 'g'), '(?is)<(em|i)[^>]*>(.*?)</(?:em|i)>', '*\\2*', 'g')) AS md FROM pages")
def m05(spark, d):
    return pages(spark, d, "html").select("page_id", F.md5(M.emphasis(F.col("html"))).alias("md"))


def _planted(spark, d, html: str):
    """A page of this markup for each page, with its number for ``%``."""
    parts = html.split("%")
    cols = [x for p in parts for x in (F.lit(p), F.col("page_id").cast("string"))][:-1]
    return pages(spark, d).select("page_id", F.concat(*cols).alias("html"))


def _sql(text: str) -> str:
    """The same, as SQL."""
    return " || page_id || ".join("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in text.split("%"))


#: Step of the conversion, markup (% is the page's number), what it becomes.
_STEPS = {
    "m04_paragraphs": ("paragraphs", "<p class=a> one <b>%</b>\ntwo </p><P>x</P>", "one %\ntwo\n\nx\n\n"),
    "m06_links": ("links", "<a class=x href='/p%'> to <b>%</b> </a><a href=\"\">none</a>", "[to %](/p%)<a href=\"\">none</a>"),
    "m07_images": ("images", "<img src=\"/i%.png\" alt='a %'><img alt=x>", "![a %](/i%.png)<img alt=x>"),
    "m08_lists": ("lists", "<ol><li> a </li><li><b>%</b></li></ol><ul><li>c</li></ul>", "1. a\n2. %\n\n- c\n\n"),
    "m09_code": ("code", "<pre><code class=\"language-go\"> f(%) </code></pre><pre>kept</pre><code>x</code>", "```go\nf(%)\n```\n\n<pre>kept</pre>`x`"),
    "m10_quotes": ("quotes", "<blockquote> a\n\n <i>%</i> </blockquote>", "> a\n> %\n\n"),
    "m11_rules": ("rules", "%<hr><HR /><hr class=x>", "%---\n\n---\n\n<hr class=x>"),
    "m12_tables": ("tables", "<table><tr><th>a|b</th><th>c</th></tr><tr><td>%</td></tr></table>", "| a\\|b | c |\n| --- | --- |\n| % |\n\n"),
    "m13_cleanup": ("cleanup", "\n a\n\n\n\n% \n", "a\n\n%\n"),
    "m06_markdown": (None, "<h2> T </h2><!-- no --><div><p>a <b>%</b></p><hr><ul><li>x</li></ul></div><style>s</style>", "## T\n\n<div>a %\n\n---\n\n- x\n\n</div>\n"),
}


def _step(name: str, only: str | None, html: str, becomes: str) -> None:
    @query(name, f"SELECT page_id, {_sql(becomes)} AS markdown FROM pages")
    def run(spark, d):
        return M.convert(_planted(spark, d, html), only=only)


for _name, _case in _STEPS.items():
    _step(_name, *_case)


@query("m06_reference_links", f"SELECT page_id, {_sql('[t][h-e-p%]![a][i-%]') } || chr(10) AS markdown FROM pages")
def m06_reference(spark, d):
    """Links and images in reference style."""
    return M.convert(_planted(spark, d, "<a href='https://h.e/p%'>t</a><img src='/i/%/' alt='a'>"), links="reference", images="reference")


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return x


_NL = "chr(10)"
_HEADED = _replaced(_CLEAN, ("(?i)<h1[^>]*>\\s*(.*?)\\s*</h1>", f"'# \\1' || {_NL} || {_NL}"))
#: Each piece up to a paragraph's end: what stands behind the paragraph's begin loses its tags.
_PIECE = f"CASE WHEN regexp_matches(s, '<p[^>]*>') THEN regexp_extract(s, '(?s)^(.*?)<p[^>]*>', 1) || regexp_replace(regexp_extract(s, '(?s)^.*?<p[^>]*>\\s*(.*?)\\s*$', 1), '<[^>]+>', '', 'g') || {_NL} || {_NL} ELSE s || '</p>' END"
_PIECES = f"string_split({_HEADED}, '</p>')"
_MD = _replaced(
    f"(array_to_string(list_transform(list_slice({_PIECES}, 1, -2), lambda s: {_PIECE}), '') || list_extract({_PIECES}, -1))",
    ("(?is)<a\\s+[^>]*href\\s*=\\s*[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>", "'[\\2](\\1)'"),
    ("(?is)<li[^>]*>(.*?)</li>", f"'- \\1' || {_NL}"),
    ("<ul[^>]*>", "''"),
    ("</ul>", _NL),
    ("\\n{3,}", f"{_NL} || {_NL}"),
)


@query("m21_markdown_of_pages", f"SELECT page_id, md5(trim({_MD}, ' ' || chr(10)) || chr(10)) AS md FROM pages")
def m21(spark, d):
    """The whole conversion over the stored pages."""
    return M.convert(pages(spark, d, "html")).select("page_id", F.md5("markdown").alias("md"))


_PARTS = """<a href="/in%"> t <b>%</b></a><a href='https://o.e/x'>o</a><img src="/i%.png" alt="a" title='T'><img src='https://o.e/j.png'><table><tr><th>h</th></tr><tr><td>%</td><td>2</td></tr></table><table><tr></tr></table><pre><code>p%</code></pre><pre><code class="language-js">j%</code></pre><pre><code>p%</code></pre>"""


@query("m14_md_links", "SELECT page_id, unnest([0, 1])::INTEGER AS pos, unnest(['t ' || page_id, 'o']) AS text, unnest(['https://h.e/in' || page_id, 'https://o.e/x']) AS url, unnest([true, false]) AS internal FROM pages")
def m14(spark, d):
    return M.parts_of(_planted(spark, d, _PARTS), "links", F.lit("https://h.e"))


@query("m15_images", "SELECT page_id, unnest([0, 1])::INTEGER AS pos, unnest(['a', '']) AS alt, unnest(['https://h.e/i' || page_id || '.png', 'https://o.e/j.png']) AS url, unnest(['T', '']) AS title FROM pages")
def m15(spark, d):
    return M.parts_of(_planted(spark, d, _PARTS), "images", F.lit("https://h.e"))


@query("m16_tables", "SELECT page_id, 0 AS pos, 'h' AS headers, page_id || ',2' AS cells FROM pages")
def m16(spark, d):
    t = M.parts_of(_planted(spark, d, _PARTS), "tables", F.lit(""))
    return t.select("page_id", "pos", F.array_join("headers", ",").alias("headers"), F.array_join(F.flatten("rows"), ",").alias("cells"))


@query("m17_code_blocks", "SELECT page_id, unnest([0, 1])::INTEGER AS pos, unnest(['js', '']) AS language, unnest(['j' || page_id, 'p' || page_id]) AS code FROM pages")
def m17(spark, d):
    return M.parts_of(_planted(spark, d, _PARTS), "code", F.lit(""))


_A = "'(?is)<a\\s+[^>]*href\\s*=\\s*[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>'"


@query("m14_links_of_pages", f"SELECT page_id, url, text, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, {_A}, 1)) AS url, trim(regexp_replace(unnest(regexp_extract_all(html, {_A}, 2)), '<[^>]+>', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM pages) GROUP BY 1, 2, 3")
def m14_pages(spark, d):
    out = M.parts_of(pages(spark, d, "html"), "links", F.lit(""))
    return out.groupBy("page_id", "url", "text").agg(F.count("*").alias("n"))


@query("m18_reading_stats", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+'))::INTEGER AS n_words, strlen(text)::INTEGER AS n_bytes, (len(regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')) // 200 + 1)::INTEGER AS minutes FROM documents")
def m18(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", *M.stats(F.col("text")))


@query("m19_sanitize_ref", "SELECT page_id, substr(trim(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 50) AS ref FROM pages")
def m19(spark, d):
    return pages(spark, d).select("page_id", M.sanitized_ref(F.col("url")).alias("ref"))


@query("m20_truncate", "SELECT page_id, CASE WHEN strlen(title) > 20 THEN left(title, 20) || '...' ELSE title END AS short FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[^ -~]', '', 'g') AS title FROM pages)")
def m20(spark, d):
    t = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), "[^ -~]", "")
    return pages(spark, d, "html").select("page_id", M.truncated(t, 20).alias("short"))

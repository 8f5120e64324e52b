"""Queries of the tokenizer tier, of the rewriters, and of stored files and archives."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import dom
from ..functions import html as H
from ..functions import urls as U
from ..operators import rewrite as RW
from . import sqltext as S
from .html import _planted, attributes_sql
from .registry import query
from .urls import pages


@query("e01_exact_links", f"{attributes_sql()} SELECT page_id, ref, count(*) AS n FROM refs WHERE ref <> '' GROUP BY 1, 2")
def e01_exact(spark, d):
    return dom.extract(pages(spark, d, "html"), "links").groupBy("page_id", "ref").agg(F.count("*").alias("n"))


@query("e04_css_scanner", "SELECT page_id, unnest(['https://e.com/f/foo(bar).woff2', 'https://e.com/' || page_id || '.png', 'a(b(c))d', 'last']) AS ref FROM pages")
def e04(spark, d):
    """Escaped and balanced brackets, quotes, upper case, and an end that is missing."""
    css = r""".a{b:url(https://e.com/f/foo\(bar\).woff2)} .c{d:URL( "https://e.com/%.png" )} e{f:url(a(b(c))d);g:url()} h{i:url('last'"""
    return dom.extract(_planted(spark, d, css), "css")


_BODY = '<body><main id="m"><div class="x y"><p>a %</p><p>b</p></div><img src=i alt=""><a href="/p"></a><h1>t</h1><h3>u</h3><input type=text></main></body>'


@query("e16_page_structure", "SELECT page_id, unnest(['body', 'main', 'div', 'p', 'p', 'img', 'a', 'h1', 'h3', 'input']) AS tag, unnest(['body:nth-child(1)', '#m', 'div.x', 'body:nth-child(1) > main:nth-child(1) > div:nth-child(1) > p:nth-child(1)', 'body:nth-child(1) > main:nth-child(1) > div:nth-child(1) > p:nth-child(2)', 'body:nth-child(1) > main:nth-child(1) > img:nth-child(2)', 'body:nth-child(1) > main:nth-child(1) > a:nth-child(3)', 'body:nth-child(1) > main:nth-child(1) > h1:nth-child(4)', 'body:nth-child(1) > main:nth-child(1) > h3:nth-child(5)', 'body:nth-child(1) > main:nth-child(1) > input:nth-child(6)']) AS selector, unnest([1, 6, 2, 0, 0, 0, 0, 0, 0, 0])::INTEGER AS child_count, unnest(range(10))::INTEGER AS pos FROM pages")
def e16(spark, d):
    return dom.extract(_planted(spark, d, _BODY), "structure").select("page_id", "tag", "selector", "child_count", "pos")


@query("e16_elements_of_pages", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script[^>]*>).*?</script>', '\\1', 'g'), '(?is)(<style[^>]*>).*?</style>', '\\1', 'g') AS html FROM pages)) GROUP BY 1, 2")
def e16_pages(spark, d):
    return dom.extract(pages(spark, d, "html"), "structure").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("e16_elements_in_sql", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<script[^>]*>).*?</script>', '\\1', 'g'), '(?is)(<style[^>]*>).*?</style>', '\\1', 'g') AS html FROM pages)) GROUP BY 1, 2")
def e16_sql(spark, d):
    """The same elements by a table function in SQL text."""
    from ..functions.table_functions import register

    register(spark)
    return spark.sql("SELECT p.page_id, e.tag, count(*) AS n FROM {pages} p, LATERAL page_elements(p.html) e GROUP BY p.page_id, e.tag", pages=pages(spark, d, "html"))


@query("e18_media", "SELECT page_id, unnest(['/v' || page_id || '.mp4', '/v.webm', '/a.mp3', '/s']) AS src, unnest(['video', 'video-source', 'audio', 'source']) AS type FROM pages")
def e18(spark, d):
    return dom.extract(_planted(spark, d, "<video src=/v%.mp4><source src=/v.webm></video><audio src=/a.mp3></audio><source src=/s><video src=/v%.mp4></video>"), "media")


@query("e22_accessibility", "SELECT page_id, 10 AS node_count, 3 AS max_depth, 1 AS missing_alt, 1 AS missing_label, 1 AS empty_link, 1 AS heading_skip, 2 AS headings, 1 AS landmarks, 0 AS required FROM pages")
def e22(spark, d):
    return dom.extract(_planted(spark, d, _BODY), "accessibility")


_ACTIVE = """<button onclick="f(%)">a</button><button type=SUBMIT class="x btn">b</button><button disabled class=btn>c</button><input type="submit"><input type=button disabled><a href="mailto:x">m</a><a href="/p" target="_blank">p</a><a>q</a><div role=button aria-disabled=true></div><b role=button data-toggle=tab class="collapsible">t</b><details><summary aria-expanded=false>s</summary></details><details open><summary>s</summary></details><i class="collapsible active" data-bs-toggle=modal></i>"""
_COUNTS = {dom.SELECTORS[i]: n for i, n in {0: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 10: 1, 12: 2, 13: 1, 16: 1, 17: 1, 19: 1, 20: 1}.items()}


@query("e27_interactive_census", f"""{attributes_sql(names='href', but='script|style|link')}, l AS (SELECT page_id, {S.quoted([dom.SELECTORS[1]])} AS kind, count(*)::INTEGER AS n FROM refs WHERE NOT regexp_matches(ref, '^(mailto|tel|javascript):') GROUP BY 1)
SELECT * FROM l UNION ALL SELECT page_id, unnest([{S.quoted(_COUNTS)}]), unnest({list(_COUNTS.values())})::INTEGER FROM pages""")
def e27(spark, d):
    """Every stored page with one of each kind before it; of what is stored only links can be acted on."""
    p = pages(spark, d, "html").withColumn("html", F.concat(F.replace(F.lit(_ACTIVE), F.lit("%"), F.col("page_id").cast("string")), "html"))
    return dom.extract(p, "census")


_SEGMENTS = "list_filter(string_split(p, '/')[:-2], lambda s: s <> '')"
_SAME = f"len(list_filter(range(1, least(len({_SEGMENTS}), len(string_split(t, '/'))) + 1), lambda i: ({_SEGMENTS})[1:i] = string_split(t, '/')[1:i]))"


@query("d06_rewrite_html", f"""{attributes_sql()},
m AS (SELECT DISTINCT page_id, ref, {S.local_path('url')} AS p, {S.local_path(f"({S.part('url', 1)} || '://' || {S.part('url', 2)} || ref)")} AS t FROM refs WHERE starts_with(ref, '/') AND NOT starts_with(ref, '//')),
r AS (SELECT page_id, replace(ref, '&', '&amp;') AS ref, replace(repeat('../', len({_SEGMENTS}) - {_SAME}) || array_to_string(string_split(t, '/')[{_SAME} + 1:], '/'), '&', '&amp;') AS rel FROM m),
g AS (SELECT page_id, list(ref || chr(1) || rel) AS pairs FROM r GROUP BY 1),
h AS (SELECT page_id, list_reduce(list_prepend(html, coalesce(pairs, [])), lambda a, b: replace(a, '<a href="' || split_part(b, chr(1), 1) || '"', '<a href="' || split_part(b, chr(1), 2) || '"')) AS html FROM pages LEFT JOIN g USING (page_id))
SELECT page_id, md5(html) AS md, strlen(html)::INTEGER AS n_bytes FROM h""")
def d06(spark, d):
    """Each page with its own references mapped to local paths; no body is shuffled."""
    p = pages(spark, d, "html")
    return RW.rewritten_in_place(p, H.links(F.col("url"), F.col("html"))).select("page_id", F.md5("html").alias("md"), F.octet_length("html").alias("n_bytes"))


@query("d06_rewritten_parts", """SELECT page_id, '<html><head><style>a{b:url(i' || page_id || '.png)}</style><script src="../s.js" integrity=""></script><!-- <a href="/x"> --></head><body style="c:url(i' || page_id || '.png)"><a href="../p' || page_id || '/index.html#f">x</a><img srcset="i' || page_id || '.png 1x, /none.png 2x"><link imagesrcset="i' || page_id || '.png 2x"><meta content="i' || page_id || '.png" property=og:image><meta http-equiv="Content-Security-Policy" content="default-src * &#x27;unsafe-inline&#x27; &#x27;unsafe-eval&#x27; data: blob:;"><a href="https://o.e/">o</a><script src="../../ws-replay.js"></script></body></html>' AS html FROM pages""")
def d06_parts(spark, d):
    """Attributes, style sheets, sets of sources, fragments, integrity and base; comments and what has no file stay."""
    html = """<html><head><base href="/"><style>a{b:url(/i%.png)}</style><script src='/s.js' integrity="sha"></script><!-- <a href="/x"> --></head><body style="c:url(/i%.png)"><a href=/p%/#f>x</a><img srcset="/i%.png 1x, /none.png 2x"><link imagesrcset="/i%.png 2x"><meta content="/i%.png" property=og:image><meta http-equiv="Content-Security-Policy" content="default-src 'self'"><a href="https://o.e/">o</a><script defer src="old/ws-replay.js"> </script></body></html>"""
    p = _planted(spark, d, html).withColumn("url", F.lit("https://h.e/d/")).withColumn("path", F.lit("h.e/d/index.html"))
    n = F.col("page_id").cast("string")
    one = lambda url, path: F.struct(F.replace(F.lit(url), F.lit("%"), n).alias("ref_url"), F.replace(F.lit(path), F.lit("%"), n).alias("path"))
    refs = F.array(one("https://h.e/i%.png", "h.e/d/i%.png"), one("https://h.e/s.js", "h.e/s.js"), one("https://h.e/p%/", "h.e/p%/index.html"))
    return RW.rewritten(p, p.select("page_id", F.inline(refs)), partial(RW.rewrite_html, replay="ws-replay.js"))


@query("d11_next_data", """SELECT page_id, '<script id="__NEXT_DATA__" type="application/json">{"assetPrefix":"","dynamicImports":["c/' || page_id || '.js","/d.js"],"page":"é"}</script><script id="__NEXT_DATA__">{broken</script><script id="__NEXT_DATA__">{"page":"/","assetPrefix":""}</script>' AS html FROM pages""")
def d11(spark, d):
    html = """<script id="__NEXT_DATA__" type="application/json">{"assetPrefix": "https://cdn", "dynamicImports": ["/c%.js", "/d.js"], "page": "é"}</script><script id="__NEXT_DATA__">{broken</script><script id="__NEXT_DATA__">{"page": "/"}</script>"""
    p = _planted(spark, d, html).withColumn("url", F.lit("https://h.e/")).withColumn("path", F.lit("h.e/index.html"))
    n = F.col("page_id").cast("string")
    m = p.select("page_id", F.concat(F.lit("/c"), n, F.lit(".js")).alias("ref_url"), F.concat(F.lit("c/"), n, F.lit(".js")).alias("path"))
    return RW.rewritten(p, m, RW.next_data)


@query("d15_single_file", """SELECT page_id, '<style>a{b:' || page_id || '}</style><script>f(' || page_id || ')</script><img src="data:image/png;base64,' || to_base64(('i' || page_id)::BLOB) || '"><img src="/none.png">' AS html FROM pages""")
def d15(spark, d):
    html = """<link rel="stylesheet" href="/s.css"><script src="/j.js"></script><img src="/i.png"><img src="/none.png">"""
    p = _planted(spark, d, html).withColumn("url", F.lit("https://h.e/"))
    n = F.col("page_id").cast("string")
    one = lambda name, mime, text: F.struct(F.lit(f"https://h.e/{name}").alias("ref_url"), F.lit(mime).alias("mime"), F.encode(text, "UTF-8").alias("content"))
    files = F.array(one("s.css", "text/css", F.concat(F.lit("a{b:"), n, F.lit("}"))), one("j.js", "text/javascript", F.concat(F.lit("f("), n, F.lit(")"))), one("i.png", "image/png", F.concat(F.lit("i"), n)))
    return RW.inlined(p, p.select("page_id", F.inline(files)))


@query("a08_har_entries", f"SELECT page_id, '{{\"startedDateTime\":\"2025-01-01T00:00:00Z\",\"request\":{{\"method\":\"GET\",\"url\":' || to_json(url) || ',\"httpVersion\":\"HTTP/1.1\",\"queryString\":' || to_json(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {{'name': string_split(p, '=')[1], 'value': CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END}})) || '}},\"response\":{{\"status\":200,\"content\":{{\"size\":' || strlen(title) || ',\"mimeType\":\"text/html\",\"text\":' || to_json(title) || '}}}}}}' AS entry FROM (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)")
def a08(spark, d):
    from ..sources.warc import har_entry

    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages(spark, d, "html").select("page_id", har_entry(F.col("url"), F.lit("GET"), F.lit(200), F.lit("text/html"), title, F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("entry"))


@query("a12_wacz_package", "SELECT url, 'text/html' AS mime, 200 AS status, '20250101000000' AS date FROM pages")
def a12(spark, d):
    """The index lines of packages, one for each archive file, whose parts are checked against their data packages."""
    from ..sources.warc import packages, read_packages, shared_folder, write_warc

    p = pages(spark, d, "html").select("url", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("date"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.encode("html", "UTF-8").alias("body"))
    path = shared_folder(spark, "wacz")
    write_warc(p, path, rotate=1 << 20)
    packages(spark, path, f"{path}-packages", "pages")
    return read_packages(spark, f"{path}-packages").select("url", "mime", "status", "date")


@query("s06_cdx_lines", "SELECT url, '20250101000000' AS date, 'text/html' AS mime, 200 AS status FROM pages")
def s06(spark, d):
    """The index of a written archive, as it comes back; every record is where the index says."""
    from ..sources.warc import cdx, shared_folder, write_warc

    p = pages(spark, d, "html").select("url", F.lit("2025-01-01 00:00:00").cast("timestamp").alias("date"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.encode("html", "UTF-8").alias("body"))
    path = shared_folder(spark, "cdx")
    write_warc(p, path, rotate=1 << 20)
    return cdx(spark, path).where("length > 0 and offset >= 0").select("url", "date", "mime", "status")


@query("s02_clone_tree", f"SELECT DISTINCT rel_path, 'https://' || rel_path AS url, strlen(path)::BIGINT AS size FROM (SELECT {S.local_path('url')} AS rel_path, {S.local_path('url')} AS path FROM pages)")
def s02(spark, d):
    """A tree of files (each holds its own path), written and scanned."""
    from ..sources.files import clone_tree, write_tree
    from ..sources.warc import shared_folder

    path = U.path_for_url(F.col("url"))
    files = pages(spark, d).select(path.alias("rel_path")).distinct().select("rel_path", F.encode("rel_path", "UTF-8").alias("content"))
    root = shared_folder(spark, "tree")
    write_tree(files, root).count()
    return clone_tree(spark, root).select("rel_path", "url", "size")


@query("s11_tree_export", f"SELECT DISTINCT {S.local_path('url')} AS rel_path, strlen({S.local_path('url')})::BIGINT AS size FROM pages")
def s11(spark, d):
    from ..sources.files import write_tree
    from ..sources.warc import shared_folder

    path = U.path_for_url(F.col("url"))
    files = pages(spark, d).select(path.alias("rel_path")).distinct().select("rel_path", F.encode("rel_path", "UTF-8").alias("content"))
    return write_tree(files, shared_folder(spark, "export"))


@query("s03_one_object", f"SELECT {S.normal_url('url')} || '\"\\é' AS url, min({S.local_path('url')}) AS path FROM pages GROUP BY 1")
def s03_object(spark, d):
    """A mapping as one JSON object, written by many tasks and read by ranges of bytes."""
    from ..sources.documents import json_map, write_json_map
    from ..sources.warc import shared_folder

    p = pages(spark, d).select(F.concat(U.normalize_url(F.col("url")), F.lit('"\\é')).alias("url"), U.path_for_url(F.col("url")).alias("path")).groupBy("url").agg(F.min("path").alias("path"))
    root = shared_folder(spark, "mapping")
    write_json_map(p, root)
    return json_map(spark, root)


@query("a08_har_document", f"SELECT page_id, url, 200 AS status, 'OK' AS status_text, 'text/html' AS mime, strlen(html)::INTEGER AS size, (44 + strlen(page_id::VARCHAR))::INTEGER AS headers_size, len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> ''))::INTEGER AS n_query FROM pages")
def a08_document(spark, d):
    """Every page in one HAR document, as its entries come back."""
    from ..sources.documents import read_har, write_har
    from ..sources.warc import shared_folder

    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=x"), F.lit("X-Id"), F.col("page_id").cast("string"))
    r = pages(spark, d, "html").select("url", F.lit("GET").alias("method"), F.lit(200).alias("status"), headers.alias("headers"), F.col("html").alias("body"), F.lit("").alias("request_body"), F.lit("2025-01-01 00:00:00").cast("timestamp").alias("at"), F.col("page_id").alias("seq"))
    root = shared_folder(spark, "har")
    write_har(r, root, "2025-01-01T00:00:00Z")
    e = read_har(spark, root)
    page = F.get(F.filter("request.headers", lambda h: h["name"] == "X-Id"), 0)["value"].cast("long")
    return e.select(page.alias("page_id"), "request.url", "response.status", F.col("response.statusText").alias("status_text"), F.col("response.content.mimeType").alias("mime"), "response.content.size", F.col("response.headersSize").alias("headers_size"), F.size("request.queryString").alias("n_query"))


@query("s03_index_json", f"SELECT {S.normal_url('url')} AS url, min({S.local_path('url')}) AS path FROM pages GROUP BY 1")
def s03(spark, d):
    """A file index as JSON lines, as it comes back."""
    from ..sources.files import write_index
    from ..sources.warc import shared_folder

    p = pages(spark, d).select(U.normalize_url(F.col("url")).alias("n"), U.path_for_url(F.col("url")).alias("path")).groupBy(F.col("n").alias("url")).agg(F.min("path").alias("path"))
    root = shared_folder(spark, "index")
    write_index(p, root)
    return spark.read.schema("url string, path string").json(root)

"""Queries of dedupe, mapping and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import dedupe as D
from ..operators import rewrite as RW
from . import sqltext as S
from .registry import query
from .urls import pages

_ART = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"


@query(
    "d01_content_dedupe",
    f"""WITH a AS (SELECT page_id, url, sha256({_ART}) AS sha FROM pages WHERE {_ART} <> ''),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM a)
    SELECT {S.host('url')} AS host, count(*) AS n_pages, count(DISTINCT sha) AS n_distinct, sum((first <> page_id)::INTEGER)::BIGINT AS n_aliased FROM f GROUP BY 1""",
)
def d01(spark, d):
    p = pages(spark, d, "html").select("page_id", "url", F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1).alias("body"))
    return D.content_report(p, F.col("body"), U.host(F.col("url")), F.col("page_id"))


@query("d01_document_dedupe", "SELECT sha256(text) AS sha, min(doc_id) AS kept, count(*) AS n_docs FROM documents WHERE text <> '' GROUP BY 1")
def d01_docs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text <> ''")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("n_docs"))


_VAR = "SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '/?([?#].*)?$', '') || '/page/2' FROM pages UNION ALL SELECT regexp_replace(url, '/?([?#].*)?$', '') || '?utm_source=x&a=1' FROM pages"


@query(
    "d02_page_dedupe",
    f"""WITH v AS ({_VAR}), k AS (SELECT {S.canonical('url')} AS key, {S.weight('url')} AS w, {S.local_path('url')} AS path FROM v
      WHERE NOT {S.starts(f"lower({S.part('url', 3)})", ['/wp-json', '/cart', '/feed'])})
    SELECT key, arg_min(path, (w, path)) AS kept, count(*) AS n_pages FROM k GROUP BY 1""",
)
def d02(spark, d):
    u = pages(spark, d).select("url")
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    v = u.unionByName(u.select(F.concat(bare, F.lit("/page/2")).alias("url"))).unionByName(u.select(F.concat(bare, F.lit("?utm_source=x&a=1")).alias("url")))
    return D.dedupe_pages(v.withColumn("path", U.path_for_url(F.col("url"))))


_KEYED = f"v AS ({_VAR}), k AS (SELECT {S.canonical('url')} AS key, {S.weight('url')} AS w, {S.local_path('url')} AS path, {S.starts(f'lower({S.part(chr(117) + chr(114) + chr(108), 3)})', ['/wp-json', '/cart', '/feed'])} AS noise FROM v)"


def _variants(spark, d):
    u = pages(spark, d).select("url")
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    v = u.unionByName(u.select(F.concat(bare, F.lit("/page/2")).alias("url"))).unionByName(u.select(F.concat(bare, F.lit("?utm_source=x&a=1")).alias("url")))
    return v.withColumn("path", U.path_for_url(F.col("url")))


@query("d02_dedupe_manifest", f"WITH {_KEYED}, f AS (SELECT key, arg_min(path, (w, path)) AS kept FROM k WHERE NOT noise GROUP BY 1) SELECT kept, path AS collapsed FROM k JOIN f USING (key) WHERE NOT noise AND path <> kept")
def d02_manifest(spark, d):
    from ..sources.warc import shared_folder

    folder = shared_folder(spark, "dedupe")
    D.export_pages(_variants(spark, d), folder)
    return spark.read.parquet(f"{folder}/manifest")


@query("d02_dedupe_report", f"WITH {_KEYED}, n AS (SELECT count(*) AS pages_total, sum(noise::INTEGER)::BIGINT AS noise_dropped, count(DISTINCT key) FILTER (NOT noise) AS pages_kept FROM k) SELECT *, pages_total - pages_kept AS pages_collapsed FROM n")
def d02_report(spark, d):
    from ..sources.warc import shared_folder

    got = D.export_pages(_variants(spark, d), shared_folder(spark, "dedupe"))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


@query("d03_asset_copies", "WITH f AS (SELECT 'e/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.png' ELSE '/index.html' END AS path, sha256((page_id % 7)::VARCHAR) AS sha FROM pages) SELECT ends_with(path, 'html') AS is_page, count(*) AS n_files, count(DISTINCT sha) AS n_contents FROM f GROUP BY 1")
def d03(spark, d):
    n = F.col("page_id").cast("string")
    f = pages(spark, d).select(F.concat(F.lit("https://e/"), n, F.when(F.col("page_id") % 3 == 0, ".png").otherwise("/index.html")).alias("path"), (F.col("page_id") % 7).cast("string").alias("body"))
    return D.asset_copies(f, F.col("path"), F.sha2("body", 256))


@query(
    "d04_mapping",
    f"""WITH a AS (SELECT regexp_replace(url, '[?#].*$', '') || '/index.html' AS url, 'm/' || page_id AS path, 0 AS rank FROM pages WHERE page_id % 2 = 0
      UNION ALL SELECT regexp_replace(url, '[?#].*$', '') || '/index.html', 'i/' || page_id, 1 FROM pages),
    e AS (SELECT unnest([url, regexp_replace(url, 'index\\.html$', ''), regexp_replace(url, '/index\\.html$', '')]) AS url, path, rank FROM a)
    SELECT url, arg_min(path, (rank, path)) AS path FROM e GROUP BY 1""",
)
def d04(spark, d):
    p = pages(spark, d).select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/index.html")).alias("url"))
    one = p.where("page_id % 2 = 0").select("url", F.concat(F.lit("m/"), F.col("page_id").cast("string")).alias("path"))
    two = p.select("url", F.concat(F.lit("i/"), F.col("page_id").cast("string")).alias("path"))
    return D.resolved_mapping([one, two])


@query("d05_localise_ref", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'mapped' WHEN 1 THEN 'unescaped' WHEN 2 THEN 'derived' ELSE 'none' END AS how, CASE page_id % 4 WHEN 0 THEN 'm/' || page_id WHEN 1 THEN 'u/' || page_id WHEN 2 THEN 'h.e/a b' || page_id || '.png' END AS path FROM pages")
def d05(spark, d):
    """References found by url, by decoded url, by the place of their file, and not at all."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    p = pages(spark, d).select("page_id", n.alias("n"), kind.alias("kind"))
    refs = p.select("page_id", F.concat(F.lit("https://h.e/a%20b"), "n", F.when(F.col("kind") == 3, ".gif").otherwise(".png")).alias("url"))
    mapping = p.where("kind = 0").select(F.concat(F.lit("https://h.e/a%20b"), "n", F.lit(".png")).alias("url"), F.concat(F.lit("m/"), "n").alias("path"))
    mapping = mapping.unionByName(p.where("kind = 1").select(F.concat(F.lit("https://h.e/a b"), "n", F.lit(".png")).alias("url"), F.concat(F.lit("u/"), "n").alias("path")))
    files = p.where("kind <> 3").select(F.concat(F.lit("h.e/a b"), "n", F.lit(".png")).alias("path"))
    return D.localised(refs, mapping, files).select("page_id", "how", "path")


@query("d08_srcset", "SELECT page_id, 'i' || page_id || '.png 1x, https://h.e/big.png 2x' AS srcset FROM pages")
def d08(spark, d):
    n = F.col("page_id").cast("string")
    p = pages(spark, d).select("page_id", F.lit("https://h.e/p/").alias("url"), F.lit("h.e/p/index.html").alias("path"), F.concat(F.lit("/i"), n, F.lit(".png 1x ,  https://h.e/big.png 2x")).alias("srcset"))
    m = p.select("page_id", F.concat(F.lit("https://h.e/i"), n, F.lit(".png")).alias("ref_url"), F.concat(F.lit("h.e/p/i"), n, F.lit(".png")).alias("path"))
    return RW.rewritten(p, m, RW.rewrite_srcset_of, "srcset")


_REFS = "regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1)"


@query("d12_missing_assets", f"WITH r AS (SELECT DISTINCT page_id, unnest({_REFS}) AS ref FROM pages), h AS (SELECT DISTINCT ref FROM r WHERE page_id % 3 = 0) SELECT ref, count(DISTINCT page_id) AS n_pages FROM r WHERE ref NOT IN (SELECT ref FROM h) GROUP BY 1")
def d12(spark, d):
    p = pages(spark, d, "html")
    refs = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))).alias("ref")).distinct()
    return D.missing_assets(refs, refs.where("page_id % 3 = 0").select(F.col("ref").alias("url")))


_BROKEN = r"""<img src="https://h.e/i%.png"><img srcset="https://h.e/i%.png/x.png 1x"><style>a{b:url(https://h.e/i\(%\).png)}</style>"""
_UP = f"repeat('../', len(string_split({S.local_path('url')}, '/')) - 1)"


@query("d13_repair", f"SELECT page_id, md5(replace(replace(replace(replace({S.quoted([_BROKEN])}, '%', page_id::VARCHAR) || html, 'https://h.e/i' || page_id || '.png/x.png', {_UP} || 'h.e/x' || page_id || '.png'), 'https://h.e/i' || page_id || '.png', {_UP} || 'h.e/i' || page_id || '.png'), 'https://h.e/i\\(' || page_id || '\\).png', {_UP} || 'h.e/b\\(' || page_id || '\\).png')) AS md FROM pages")
def d13(spark, d):
    """Every page with three urls whose files were fetched anew: one begins another, one is escaped."""
    n = F.col("page_id").cast("string")
    p = pages(spark, d, "html").select("page_id", "url", U.path_for_url(F.col("url")).alias("path"), F.concat(F.replace(F.lit(_BROKEN), F.lit("%"), n), "html").alias("html"))
    pair = lambda a, b: F.struct(F.replace(F.lit(a), F.lit("%"), n).alias("url"), F.replace(F.lit(b), F.lit("%"), n).alias("path"))
    files = p.select(F.inline(F.array(pair("https://h.e/i%.png", "h.e/i%.png"), pair("https://h.e/i%.png/x.png", "h.e/x%.png"), pair("https://h.e/i(%).png", "h.e/b(%).png"))))
    return D.repair(p, files).select("page_id", F.md5("html").alias("md"))


@query("d14_page_discovery", f"SELECT page_id, {S.local_path('url')} AS path FROM pages WHERE ends_with({S.local_path('url')}, 'index.html') AND len(string_split({S.local_path('url')}, '/')) >= 2")
def d14(spark, d):
    return D.stored_pages(pages(spark, d), U.path_for_url(F.col("url"))).select("page_id", "path")


@query("d16_run_report", f"SELECT count(*) AS n_pages, sum({S.is_page('url')}::INTEGER)::BIGINT AS n_html, sum(strlen(html))::BIGINT AS n_bytes FROM pages")
def d16(spark, d):
    return D.run_report(pages(spark, d, "html"), F.col("url"), F.col("html"))

"""Queries of the url functions over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from . import sqltext as S
from .registry import query


def pages(spark, d, *more):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", *more)


def _simple(name: str, column: str, spark_of, sql: str):
    """A query that gives one function of each page's url."""

    @query(name, f"SELECT page_id, {sql} AS {column} FROM pages")
    def run(spark, d):
        return pages(spark, d).select("page_id", spark_of(F.col("url")).alias(column))

    return run


_simple("u01_normalize_url", "normal_url", U.normalize_url, S.normal_url("url"))
_simple("u02_normalize_path", "normal_path", lambda u: U.normalize_path(F.concat(F.lit("/./a//b/"), U.path(u))), S.normal_path(f"'/./a//b/' || {S.part('url', 3)}"))
_simple("u03_sort_query", "sorted_query", lambda u: U.sort_query(F.concat(U.query(u), F.lit("&z=1&a=2&fbclid=x"))), S.sorted_query(f"{S.part('url', 4)} || '&z=1&a=2&fbclid=x'"))
_simple("u05_normalize_clean", "clean_url", lambda u: U.normalize_and_clean(F.concat(u, F.when(U.fragment(u) == "", "#!/r").otherwise(""))), f"CASE WHEN {S.part('url', 5)} = '' THEN {S.normal_url('url')} || '#!/r' ELSE {S.normal_url('url')} END")
_simple("u09_valid_url", "ok", U.is_valid_url, f"lower({S.part('url', 1)}) IN ('http', 'https')")
_simple("u10_page_vs_asset", "is_page", U.is_html_page_url, S.is_page("url"))
_simple("u11_allowed_domain", "ok", lambda u: U.is_allowed_domain(u, ["example.com", "example.org"]), f"({S.host('url')} IN ('example.com', 'example.org') OR ends_with({S.host('url')}, '.example.com') OR ends_with({S.host('url')}, '.example.org'))")
_simple("u12_excluded", "excluded", lambda u: U.is_excluded(u, ["/fr/", "ref="]), "(contains(url, '/fr/') OR contains(url, 'ref='))")
_simple("u13_glob_match", "hits", lambda u: U.glob_match("/en/*", u).cast("int") + U.glob_match("https://**.html", u).cast("int") * 2 + U.glob_match("/[!e]?/**", u).cast("int") * 4, f"regexp_matches({S.part('url', 3)}, '^/en/[^/]*$')::INTEGER + 2 * regexp_matches(url, '^https://.*\\.html$')::INTEGER + 4 * regexp_matches({S.part('url', 3)}, '^/[^e][^/]/.*$')::INTEGER")
_simple("u15_canonical_key", "canonical_key", lambda u: U.canonical_key(u), S.canonical("url"))
_simple("u16_strip_drop_query", "kept_query", lambda u: U.strip_drop_query(U.query(u)), S.drop_query(S.part("url", 4)))
_simple("u17_drop_segments", "canonical_key", lambda u: U.canonical_key(F.concat(U.part(u, 1), F.lit("://"), U.part(u, 2), F.regexp_replace(U.path(u), "/$", ""), F.lit("/page/3/x/comment-page-2/2024"))), S.canonical(f"({S.part('url', 1)} || '://' || {S.part('url', 2)} || regexp_replace({S.part('url', 3)}, '/$', '') || '/page/3/x/comment-page-2/2024')"))
_simple("u18_noise_path", "noise", lambda u: U.is_noise_path(F.concat(F.lit("http://h"), F.when(F.col("page_id") % 3 == 0, "/cart").when(F.col("page_id") % 3 == 1, "/Feed").otherwise("/x"), U.path(u))), S.starts(f"lower(CASE page_id % 3 WHEN 0 THEN '/cart' WHEN 1 THEN '/Feed' ELSE '/x' END || {S.part('url', 3)})", T.NOISE_PREFIXES))
_simple("u19_clean_weight", "weight", U.clean_weight, S.weight("url"))
_simple("u20_resume_noise", "noise", lambda u: U.is_resume_noise(F.concat(u, F.when(F.col("page_id") % 4 == 0, "/page/2").when(F.col("page_id") % 4 == 1, "&cpage=1").otherwise(""))), f"({S.holds('v', T.RESUME_RAW)} OR {S.holds('lower(' + S.part('v', 3) + ')', T.RESUME_PATHS)})")
_simple("u22_path_for_url", "local_path", U.path_for_url, S.local_path("url"))
_simple("u23_path_for_api", "api_path", U.path_for_api, f"CASE WHEN regexp_replace({S.part('url', 3)}, '^/', '') = '' THEN '' ELSE regexp_replace(regexp_replace({S.part('url', 3)}, '^/', ''), '/$', '') || CASE WHEN ends_with({S.part('url', 3)}, '/') OR NOT regexp_matches({S.part('url', 3)}, '\\.[^./]*$') THEN '.json' ELSE '' END END")
_simple("u24_url_from_local_path", "back", lambda u: U.url_from_local_path(U.path_for_url(u)), f"'https://' || {S.local_path('url')}")
_simple("u25_rel_path", "rel", lambda u: U.rel_path(F.concat(U.host(u), F.lit("/en/deep")), U.path_for_url(u)), f"CASE WHEN starts_with({S.part('url', 3)}, '/en/') THEN '../' || substr({S.local_path('url')}, length({S.host('url')}) + 5) ELSE '../../' || substr({S.local_path('url')}, length({S.host('url')}) + 2) END")
_simple("u26_asset_path", "asset", lambda u: U.asset_path(u, F.lit("")), f"{S.host('url')} || CASE WHEN {S.part('url', 3)} = '' THEN '/index' ELSE {S.part('url', 3)} END")
_simple("u28_mask_url", "masked", U.mask_url, f"{S.part('url', 1)} || '://' || {S.host('url')} || '/***MASKED***'")
# the suffix of u20's url is part of the expression
from . import registry as _r  # noqa: E402

_r._SQL["u20_resume_noise"] = f"SELECT page_id, ({S.holds('v', T.RESUME_RAW)} OR {S.holds('lower(' + S.part('v', 3) + ')', T.RESUME_PATHS)}) AS noise FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/page/2' WHEN 1 THEN '&cpage=1' ELSE '' END AS v FROM pages)"


@query("u04_tracking_param", f"WITH k AS (SELECT page_id, unnest(string_split({S.part('url', 4)}, '&')) AS p FROM pages) SELECT page_id, string_split(p, '=')[1] AS key, {S.tracking("string_split(p, '=')[1]")} AS tracking FROM k WHERE p <> ''")
def u04(spark, d):
    k = pages(spark, d).select("page_id", F.explode(F.split(U.query(F.col("url")), "&")).alias("p")).where("p <> ''")
    key = F.substring_index("p", "=", 1)
    return k.select("page_id", key.alias("key"), U.is_tracking_param(key).alias("tracking"))


_REFS = ("/a/b?x=1", "c.html#top", "../up", "//cdn.example.com/x.js", "?q=2", "#frag", "https://other.example.org/z", "./here/./x")


@query(
    "u06_resolve_url",
    f"""WITH r AS (SELECT page_id, url, unnest([{S.quoted(_REFS)}]) AS ref FROM pages),
    p AS (SELECT *, {S.part('url', 1)} || '://' || {S.part('url', 2)} AS root, {S.part('url', 3)} AS path, regexp_replace({S.part('url', 3)}, '[^/]*$', '') AS folder FROM r)
    SELECT page_id, ref, CASE ref WHEN '/a/b?x=1' THEN root || ref WHEN 'c.html#top' THEN root || folder || ref
      WHEN '../up' THEN root || regexp_replace(folder, '[^/]*/$', '') || 'up' WHEN '//cdn.example.com/x.js' THEN {S.part('url', 1)} || ':' || ref
      WHEN '?q=2' THEN root || path || ref WHEN '#frag' THEN regexp_replace(url, '#.*$', '') || ref
      WHEN './here/./x' THEN root || folder || 'here/x' ELSE ref END AS resolved FROM p""",
)
def u06(spark, d):
    r = pages(spark, d).select("page_id", "url", F.explode(F.array(*[F.lit(x) for x in _REFS])).alias("ref"))
    return r.select("page_id", "ref", U.resolve(F.col("url"), F.col("ref")).alias("resolved"))


_LIKE = ("cdn.example.com/x", "theme.css", "/root", "https://a.b", "no dots", "a b.c", "mailto:a@b.c", "exa_mple.com", "h.example:80/x?y")


@query("u07_protocol_relative", f"WITH r AS (SELECT unnest([{S.quoted(_LIKE)}]) AS ref) SELECT ref, NOT regexp_matches(ref, '^(?:https?://|/|\\./|\\.\\./|#|javascript:|mailto:|tel:|data:|blob:)') AND NOT contains(ref, ' ') AND regexp_matches(ref, '^[A-Za-z0-9:-]*\\.[A-Za-z0-9.:-]*(?:[/?#].*)?$') AS relative FROM r")
def u07(spark, d):
    r = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in _LIKE])).alias("ref"))
    return r.select("ref", U.is_protocol_relative(F.col("ref")).alias("relative"))


@query("u08_host_counts", f"SELECT {S.host('url')} AS host, count(*) AS n_pages FROM pages GROUP BY 1")
def u08(spark, d):
    return pages(spark, d).groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"))


@query("u14_seed_pages", f"WITH s AS (SELECT DISTINCT {S.normal_url('url')} AS u FROM pages WHERE page_id % 7 = 0) SELECT page_id FROM pages WHERE {S.normal_url('url')} IN (SELECT u FROM s)")
def u14(spark, d):
    p = pages(spark, d).withColumn("u", U.normalize_url(F.col("url")))
    return p.join(p.where("page_id % 7 = 0").select("u").distinct(), "u", "left_semi").select("page_id")


@query("u21_directory_aliases", "WITH v AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/index.html' AS u FROM pages) SELECT page_id, unnest([u, regexp_replace(u, 'index\\.html$', ''), regexp_replace(u, '/index\\.html$', '')]) AS alias FROM v")
def u21(spark, d):
    u = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/index.html"))
    return pages(spark, d).select("page_id", F.explode(U.directory_aliases(u)).alias("alias"))


_MIMES = ("text/html; charset=utf-8", "application/javascript", "image/svg+xml", "font/woff2", "font/woff", "application/json", "application/ld+json", "application/grpc", "text/plain", "")


@query("u26_mime_extension", f"WITH m AS (SELECT unnest([{S.quoted(_MIMES)}]) AS mime) SELECT mime, CASE {' '.join(f"WHEN contains(mime, '{a}') THEN '{b}'" for a, b in T.MIME_SUFFIXES)} ELSE '' END AS suffix FROM m")
def u26(spark, d):
    m = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in _MIMES])).alias("mime"))
    return m.select("mime", U.extension_for_mime(F.col("mime")).alias("suffix"))


@query("u27_file_kinds", f"SELECT page_id, regexp_matches(lower({S.local_path('url')}), '\\.html?$') AS is_html, contains(substr(html, 1, 512), chr(0)) AS is_binary FROM pages")
def u27(spark, d):
    p = pages(spark, d, "html")
    head = F.lower(F.substring("html", 1, 512))
    binary = F.when(head.contains("<html") | head.contains("<!doctype"), F.lit(False)).otherwise(F.instr(head, "\0") > 0)
    return p.select("page_id", F.lower(U.path_for_url(F.col("url"))).rlike(r"\.html?$").alias("is_html"), binary.alias("is_binary"))


@query("a01_api_content", f"WITH m AS (SELECT page_id, url, unnest([{S.quoted(_MIMES)}]) AS mime FROM pages), b AS (SELECT *, trim(string_split(mime, ';')[1]) AS base FROM m) SELECT page_id, mime, base IN ({S.quoted(T.JSON_MIMES)}) AS is_json, {S.holds('base', T.API_MIME_PARTS)} OR {S.holds('lower(' + S.part('url', 3) + ')', T.API_PATH_PARTS)} AS is_api FROM b")
def a01(spark, d):
    m = pages(spark, d).select("page_id", "url", F.explode(F.array(*[F.lit(x) for x in _MIMES])).alias("mime"))
    return m.select("page_id", "mime", U.is_json_content(F.col("mime")).alias("is_json"), U.is_api_content(F.col("url"), F.col("mime")).alias("is_api"))

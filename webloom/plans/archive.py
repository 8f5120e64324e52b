"""Queries of archive, API and audit data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..operators import archive as A
from . import sqltext as S
from .health import events
from .registry import query
from .urls import pages


@query("a02_api_capture", f"SELECT page_id FROM pages WHERE regexp_matches({S.part('url', 3)}, '^/en/.*$')")
def a02(spark, d):
    return pages(spark, d).where(U.glob_match("/en/**", F.col("url"))).select("page_id")


@query("a03_first_response", f"SELECT {S.normal_url('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def a03(spark, d):
    return A.first_responses(pages(spark, d))


@query("a04_keep_last_n", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def a04(spark, d):
    return A.newest(events(spark, d).select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 5).select("event_id")


@query("a05_exact_seen", "SELECT DISTINCT user_id, event_type FROM events")
def a05(spark, d):
    return A.exact_seen(events(spark, d), "user_id", "event_type")


@query("a06_messages_by_key", "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events")
def a06(spark, d):
    return A.ordered_messages(events(spark, d).select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("a07_replay_lookup", """WITH c AS (SELECT page_id AS seq, CASE WHEN page_id % 6 = 0 THEN 'https://h.e/graphql' ELSE url END AS url, CASE page_id % 4 WHEN 0 THEN 'GET' ELSE '' END AS m, CASE WHEN page_id % 6 = 0 THEN 'q' || (page_id % 5) END AS op FROM pages WHERE page_id % 2 = 0),
k AS (SELECT CASE WHEN op IS NULL THEN url ELSE url || '|gql:' || op END AS key, string_split(url, '?')[1] AS base, op IS NULL AS plain, m, seq FROM c),
q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://h.e/graphql' ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN 'POST' ELSE 'GET' END AS m, CASE WHEN page_id % 3 = 0 THEN 'q' || (page_id % 5) END AS op FROM pages),
r AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS bare FROM q)
SELECT page_id, coalesce((SELECT min(seq) FROM k WHERE k.key = r.url || '|gql:' || r.op AND k.m IN ('', r.m)), (SELECT min(seq) FROM k WHERE k.key = r.url AND k.m IN ('', r.m)), (SELECT min(seq) FROM k WHERE k.key = r.bare AND k.m IN ('', r.m)), (SELECT min(seq) FROM k WHERE plain AND k.base = r.bare AND k.m IN ('', r.m))) AS hit FROM r""")
def a07(spark, d):
    """Requests by method; every third is a GraphQL one, told apart by its operation."""
    p = pages(spark, d)
    body = F.concat(F.lit('{"operationName":"q'), (F.col("page_id") % 5).cast("string"), F.lit('"}'))
    at = lambda n: F.when(F.col("page_id") % n == 0, F.lit("https://h.e/graphql")).otherwise(F.col("url"))
    captured = p.where("page_id % 2 = 0").select(F.col("page_id").alias("seq"), at(6).alias("url"), F.when(F.col("page_id") % 4 == 0, "GET").alias("method"), F.when(F.col("page_id") % 6 == 0, body).alias("body"))
    requests = p.select("page_id", at(3).alias("url"), F.when(F.col("page_id") % 5 == 0, "POST").otherwise("GET").alias("method"), F.when(F.col("page_id") % 3 == 0, body).alias("body"))
    return A.replayed(requests, captured).select("page_id", "hit")


@query("a11_cdx_index", f"SELECT page_id, url, coalesce(sum(strlen(html)) OVER (ORDER BY url, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_raw FROM pages")
def a11(spark, d):
    """Offsets by two levels: sums of ranges of urls, then within a range; no task sees all rows."""
    from ..sources.warc import running_offsets

    return running_offsets(pages(spark, d, "html").select("page_id", "url", F.octet_length("html").cast("long").alias("size")), ["url", "page_id"], "size").select("page_id", "url", F.col("offset").alias("offset_raw"))


@query("a13_conditional_cache", "SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS etag, max(ts) AS fetched FROM events GROUP BY 1")
def a13(spark, d):
    etag = F.when(F.col("event_type") != "view", F.col("event_type"))
    return A.cache_upserts(events(spark, d), "user_id", ["ts", "event_id"], etag)


_RESPONSES = "r AS (SELECT user_id, ts AS t, event_id AS seq, CASE event_type WHEN 'click' THEN 304 WHEN 'error' THEN 500 ELSE 200 END AS status, CASE WHEN event_type = 'view' THEN 'e' || event_id % 50 END AS etag, CASE WHEN event_type = 'purchase' THEN 'm' || event_id ELSE '' END AS lm FROM events)"


@query("a13_cache_merged", f"WITH {_RESPONSES}, v AS (SELECT * FROM r WHERE etag IS NOT NULL OR lm <> '' OR status = 304) SELECT 'https://h.e/' || user_id AS url, arg_max(etag, (t, seq)) FILTER (etag IS NOT NULL) AS etag, arg_max(lm, (t, seq)) FILTER (lm <> '') AS last_modified, arg_max(status, (t, seq)) AS status FROM v GROUP BY 1")
def a13_merged(spark, d):
    """Responses merged into a stored cache in four batches, by time."""
    from ..sources.cache import CacheStore
    from ..sources.warc import shared_folder

    kind = F.col("event_type")
    r = events(spark, d).select(
        F.concat(F.lit("https://h.e/"), F.col("user_id")).alias("url"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(kind == "click", 304).when(kind == "error", 500).otherwise(200).alias("status"),
        F.when(kind == "view", F.concat(F.lit("e"), F.col("event_id") % 50)).alias("etag"), F.when(kind == "purchase", F.concat(F.lit("m"), "event_id")).otherwise("").alias("last_modified"),
    )
    store = CacheStore(spark, shared_folder(spark, "cache"), 8)
    cuts = r.agg(F.percentile_approx(F.unix_micros(F.col("at").cast("timestamp")), [0.25, 0.5, 0.75])).first()[0]
    at = F.unix_micros(F.col("at").cast("timestamp"))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = r if lo is None else r.where(at >= lo)
        store.merge(part if hi is None else part.where(at < hi))
    return store.read().select("url", "etag", "last_modified", "status")


@query("a14_conditional_headers", "WITH c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS etag FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT event_id, coalesce(etag, '') AS if_none_match, CASE WHEN c.user_id IS NULL THEN '' ELSE 'm' || c.user_id END AS if_modified_since FROM events e LEFT JOIN c USING (user_id)")
def a14(spark, d):
    e = events(spark, d)
    cache = a13(spark, d).where("user_id % 2 = 0").select("user_id", "etag", F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("last_modified"))
    return A.conditional_headers(e.select("event_id", "user_id"), cache, "user_id").select("event_id", "if_none_match", "if_modified_since")


@query("a15_file_index", f"SELECT {S.local_path('url')} AS local_path, arg_max(sha256(html), page_id) AS sha, arg_max(strlen(html), page_id)::INTEGER AS size FROM pages GROUP BY 1")
def a15(spark, d):
    return A.file_index(pages(spark, d, "html"), U.path_for_url(F.col("url")), F.col("html"), "page_id")


@query("a16_audit_query", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND user_id % 3 = 0 AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 HOUR ORDER BY ts, event_id LIMIT 50 OFFSET 10")
def a16(spark, d):
    e = events(spark, d)
    since = F.lit(e.agg(F.min("ts") + F.expr("interval 1 hour")).first()[0]).cast(e.schema["ts"].dataType)
    hit = A.audit_query(e.where("user_id % 3 = 0"), "ts", since=since, limit=50, offset=10, order=["event_id"], event_type=["error", "purchase"])
    return hit.select("event_id", "user_id", "event_type")


@query("a18_client_ip", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '10.1.0.1' ELSE '10.2.0.2' END AS ip FROM events")
def a18(spark, d):
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 1.1.1.1"))).otherwise("")
    real = F.when(F.col("event_id") % 3 == 1, "10.1.0.1").otherwise("")
    return events(spark, d).select("event_id", A.client_ip(forwarded, real, F.lit("10.2.0.2")).alias("ip"))


@query("a19_cookie_jar", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2)) WHERE k <= 2")
def a19(spark, d):
    return A.cookie_jar(events(spark, d), "user_id", "event_type", "event_id", 2)


@query("a19_injected_cookies", f"WITH p AS (SELECT page_id, {S.host('url')} AS host FROM pages), j AS (SELECT * FROM (VALUES ('example.com', 'a'), ('com', 'b'), ('net', 'c'), ('nowhere.org', 'd')) t(domain, name)) SELECT page_id, name FROM p JOIN j ON host = domain OR ends_with(host, '.' || domain)")
def a19_injected(spark, d):
    jar = spark.createDataFrame([("example.com", "a"), ("com", "b"), ("net", "c"), ("nowhere.org", "d")], "domain string, name string")
    return A.injected_cookies(pages(spark, d).select("page_id", U.host(F.col("url")).alias("host")), jar).select("page_id", "name")


@query("a20_metrics", "SELECT count(*) AS pages, sum(strlen(html))::BIGINT AS bytes FROM pages")
def a20(spark, d):
    return A.metrics(pages(spark, d, "html"))


@query("p01_word_count", "SELECT page_id, len(list_filter(regexp_split_to_array(html, '[ \\n\\t]+'), lambda w: w <> ''))::INTEGER AS n_words, strlen(html)::INTEGER AS n_bytes FROM pages")
def p01(spark, d):
    return pages(spark, d, "html").select("page_id", H.word_count(F.col("html")).alias("n_words"), F.octet_length("html").alias("n_bytes"))


@query("p01_variant", "SELECT page_id, len(list_filter(regexp_split_to_array(html, '[ \\n\\t]+'), lambda w: w <> ''))::INTEGER AS n_words, strlen(html)::INTEGER AS n_bytes, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS h1 FROM pages")
def p01_variant(spark, d):
    """Extractors of several types in one VARIANT, taken apart by path."""
    from ..operators.plugins import Registry

    r = Registry()
    r.extractor("words", H.word_count)
    r.extractor("size", lambda html: F.struct(F.octet_length(html).alias("bytes")))
    r.extractor("heads", lambda html: F.regexp_extract_all(html, F.lit("<h1[^>]*>([^<]*)"), F.lit(1)))
    v = r.extracted_variant(pages(spark, d, "html"), "html")
    get = lambda path, kind: F.try_variant_get("data", path, kind)
    return v.select("page_id", get("$.words", "int").alias("n_words"), get("$.size.bytes", "int").alias("n_bytes"), F.coalesce(get("$.heads[0]", "string"), F.lit("")).alias("h1"))


@query("p03_url_filter_plugin", "SELECT page_id FROM pages WHERE NOT contains(url, 'en/1') AND NOT contains(url, 'login')")
def p03(spark, d):
    from ..operators.plugins import Registry

    r = Registry()
    r.filter("no_admin", lambda u: ~u.contains("en/1"))
    r.filter("no_login", lambda u: ~u.contains("login"))
    return r.filtered(pages(spark, d), "url").select("page_id")

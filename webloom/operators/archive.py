"""Captured traffic, caches and cookies: DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import graphql_operation


def first_responses(rows: DataFrame, url: str = "url", seq: str = "page_id") -> DataFrame:
    """``url`` (normal) and the first response of each."""
    return rows.groupBy(U.normalize_url(F.col(url)).alias("url")).agg(F.min(seq).alias(seq))


def newest(rows: DataFrame, key: str, at: list[str], keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key; ranks are cut before the shuffle."""
    k = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in at]))
    return rows.withColumn("_k", k).where(F.col("_k") <= keep).drop("_k")


def exact_seen(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys: what a bounded cache of seen keys approximates."""
    return rows.select(*keys).distinct()


def ordered_messages(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Adds ``place`` (from 0): messages of a key in their order, one row each, so that no key is gathered in memory."""
    from ..sources.warc import placed

    return placed(rows, key, at)


def replayed(requests: DataFrame, captured: DataFrame) -> DataFrame:
    """Adds ``hit`` (the captured ``seq``) to requests (``url, method, body``).

    ``captured`` is ``url, method, seq, body``.  A GraphQL request looks for its operation
    first; then the whole url counts, then the url without query and fragment, then a
    captured url that is alike without its query; each time of the same method (or of none).
    All these ways are keys of one join, of which the first that hits counts; requests that are
    alike are looked up once.
    """
    bare = F.regexp_replace("url", "[?#].*$", "")
    base = F.substring_index("url", "?", 1)
    graph = F.col("url").contains("/graphql") | F.col("url").contains("/gql")
    gql = F.when(graph & (graphql_operation(F.col("body")) != ""), F.concat("url", F.lit("|gql:"), graphql_operation(F.col("body"))))
    method = F.coalesce("method", F.lit(""))
    keys = F.array(F.struct(F.lit("key").alias("kind"), F.coalesce(gql, F.col("url")).alias("key")), F.struct(F.when(gql.isNull(), "base").alias("kind"), base.alias("key")))
    known = captured.select(F.inline(keys), method.alias("m"), "seq").where("kind is not null and key is not null").groupBy("kind", "key", "m").agg(F.min("seq").alias("s"))
    one = requests.select(F.col("url").alias("_u"), method.alias("_m"), gql.alias("_g")).distinct()
    way = lambda n, kind, key: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), key.alias("key"))
    bare = F.regexp_replace("_u", "[?#].*$", "")
    ways = one.select("_u", "_m", "_g", F.inline(F.array(way(0, "key", F.col("_g")), way(1, "key", F.col("_u")), way(2, "key", bare), way(3, "base", bare))))
    ways = ways.where("key is not null").withColumn("m", F.explode(F.array_distinct(F.array("_m", F.lit("")))))  # a capture without a method answers all
    found = ways.join(known, ["kind", "key", "m"]).groupBy("_u", "_m", "_g").agg(F.min(F.struct("n", "s"))["s"].alias("hit"))
    q = requests.withColumn("__g", gql).withColumn("__m", method)
    return q.join(found, F.col("url").eqNullSafe(F.col("_u")) & (F.col("__m") == F.col("_m")) & F.col("__g").eqNullSafe(F.col("_g")), "left").drop("_u", "_m", "_g", "__g", "__m")


def cache_upserts(responses: DataFrame, key: str, at: list[str], etag: Column) -> DataFrame:
    """``key, etag, fetched``: the last validator that a response gave, and when the last came."""
    last = F.max_by(etag, F.when(etag.isNotNull(), F.struct(*at)))
    return responses.groupBy(key).agg(last.alias("etag"), F.max(at[0]).alias("fetched"))


def conditional_headers(requests: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """Adds ``if_none_match`` and ``if_modified_since`` (empty where the cache, ``key, etag, last_modified``, has none)."""
    c = cache.select(F.col(key), F.col("etag").alias("_e"), F.col("last_modified").alias("_l"))
    joined = requests.join(c, key, "left")
    return joined.withColumns({"if_none_match": F.coalesce("_e", F.lit("")), "if_modified_since": F.coalesce("_l", F.lit(""))}).drop("_e", "_l")


def file_index(files: DataFrame, path: Column, body: Column, seq: str) -> DataFrame:
    """``local_path, sha, size`` of the last file at each place; bodies are digested before the shuffle."""
    p = files.select(path.alias("local_path"), F.col(seq).alias("_s"), F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("size"))
    return p.groupBy("local_path").agg(F.max_by("sha", "_s").alias("sha"), F.max_by("size", "_s").alias("size"))


def client_ip(forwarded: Column, real: Column, remote: Column) -> Column:
    """First forwarded address, else the real one, else the remote end."""
    first = F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit(""))
    return F.coalesce(first, F.nullif(real, F.lit("")), remote)


def cookie_jar(cookies: DataFrame, domain: str, name: str, seq: str, keep: int = 50) -> DataFrame:
    """The last cookie of each domain and name, the newest ``keep`` of a domain."""
    last = cookies.groupBy(domain, name).agg(F.max(seq).alias(seq))
    return newest(last, domain, [seq], keep)


def injected_cookies(requests: DataFrame, jar: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """Requests with every cookie of their host's domain and those above it: one row a cookie.

    A host is matched by the list of its own suffixes, so the join is on equal keys.
    """
    labels = F.split(F.col(host), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = requests.select(host).distinct().select(host, F.explode(above).alias(domain))
    return requests.join(hosts.join(jar, domain), host)


def audit_query(events: DataFrame, at: str, since: Column | None = None, until: Column | None = None, limit: int | None = None, offset: int = 0, order: list[str] = (), **one_of: list) -> DataFrame:
    """Events in an inclusive range of time whose columns are in the given lists; a page of them in order, if asked."""
    for test in [*([F.col(at) >= since] if since is not None else []), *([F.col(at) <= until] if until is not None else []), *[F.col(k).isin(v) for k, v in one_of.items()]]:
        events = events.where(test)
    if limit is None:
        return events
    return events.orderBy(at, *order).offset(offset).limit(limit)


def metrics(pages: DataFrame, body: str = "html") -> DataFrame:
    """``pages, bytes`` in one row."""
    return pages.agg(F.count("*").alias("pages"), F.sum(F.octet_length(body)).alias("bytes"))

"""Queries of the crawl frontier; page p links to pages 2p + 1 and 2p + 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import frontier as R
from . import sqltext as S
from .registry import query
from .urls import pages


def items(spark, d):
    """Frontier items: normal urls, depth from the id, order of arrival."""
    return pages(spark, d).select(U.normalize_url(F.col("url")).alias("url"), (F.col("page_id") % 4).cast("int").alias("depth"), F.col("page_id").alias("seq"))


_ITEMS = f"items AS (SELECT {S.normal_url('url')} AS url, (page_id % 4)::INTEGER AS depth, page_id AS seq FROM pages)"


@query("f01_frontier_dedupe", f"WITH {_ITEMS}, seen AS (SELECT url FROM items WHERE seq % 5 = 0), f AS (SELECT url, min((depth, seq)) AS m FROM items GROUP BY 1) SELECT url, m[1] AS depth, m[2] AS seq FROM f WHERE url NOT IN (SELECT url FROM seen)")
def f01(spark, d):
    it = items(spark, d)
    return R.push(it, it.where("seq % 5 = 0"))


@query("f02_pop", f"WITH {_ITEMS} SELECT * FROM items ORDER BY depth, seq LIMIT 20")
def f02(spark, d):
    return R.pop(items(spark, d), 20)


@query("f03_admission", f"WITH {_ITEMS} SELECT url, depth, seq FROM items WHERE ends_with({S.host('url')}, '.example.com') AND NOT contains(url, '/fr/') AND url NOT IN (SELECT url FROM items WHERE seq % 5 = 0)")
def f03(spark, d):
    it = items(spark, d)
    return R.admitted(it, it.where("seq % 5 = 0"), ["example.com"], ["/fr/"]).select("url", "depth", "seq")


@query("f03_admission_caps", f"WITH {_ITEMS} SELECT url, m[1] AS depth, m[2] AS seq FROM (SELECT url, min((depth, seq)) AS m FROM items WHERE ends_with({S.host('url')}, '.example.com') AND NOT contains(url, '/fr/') AND url NOT IN (SELECT url FROM items WHERE seq % 5 = 0) GROUP BY 1) ORDER BY m, url LIMIT 10")
def f03_caps(spark, d):
    it = items(spark, d)
    return R.admitted(it, it.where("seq % 5 = 0"), ["example.com"], ["/fr/"], 90, 100, 3, 100_000)


@query("f04_bfs_depth", "WITH RECURSIVE e AS (SELECT p.page_id AS src, unnest([2 * p.page_id + 1, 2 * p.page_id + 2]) AS dst FROM pages p), b AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN e ON e.src = b.node WHERE depth < 6 AND dst IN (SELECT page_id FROM pages)) SELECT node, min(depth) AS depth FROM b GROUP BY 1")
def f04(spark, d):
    ids = pages(spark, d).select("page_id")
    e = ids.select(F.col("page_id").alias("src"), F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("dst"))
    e = e.join(ids.withColumnRenamed("page_id", "dst"), "dst", "left_semi")
    return R.expand(spark.range(1).select(F.col("id").alias("node")), e, 6)


@query("f05_host_cap", f"WITH {_ITEMS} SELECT seq, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {S.host('url')} ORDER BY depth, seq) AS rank FROM items) WHERE rank <= 3")
def f05(spark, d):
    return R.host_capped(items(spark, d), 3).select("seq", "rank")


@query("f06_global_cap", f"WITH {_ITEMS} SELECT seq FROM items ORDER BY depth, seq LIMIT 100")
def f06(spark, d):
    return R.pop(items(spark, d), 100).select("seq")


@query("f07_routing", f"SELECT page_id, CASE WHEN {S.is_page('url')} THEN 'page' WHEN contains(url, '/fr/') THEN 'blocked' ELSE 'asset' END AS lane FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[?#].*$', '') || '/x.png' ELSE url END AS url FROM pages)")
def f07(spark, d):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/x.png"))).otherwise(F.col("url"))
    p = pages(spark, d).select("page_id", u.alias("url"))
    return p.select("page_id", R.lane(F.col("url"), ["/fr/"]).alias("lane"))


@query("f08_seeds", f"SELECT DISTINCT {S.normal_url('url')} AS url, 0 AS depth FROM (SELECT url FROM pages UNION ALL SELECT url || '#x' FROM pages)")
def f08(spark, d):
    p = pages(spark, d)
    return R.seeds([p, p.select(F.concat("url", F.lit("#x")).alias("url"))])


@query("f09_seen_membership", f"WITH {_ITEMS} SELECT seq, url IN (SELECT url FROM items WHERE seq % 5 = 0) AS seen FROM items")
def f09(spark, d):
    it = items(spark, d)
    return R.membership(it, it.where("seq % 5 = 0")).select("seq", "seen")


@query("f01_frontier_batches", f"""WITH {_ITEMS}, a AS (SELECT url, m[1] AS depth, m[2] AS seq FROM (SELECT url, min((depth, seq)) AS m FROM items WHERE seq % 2 = 0 GROUP BY 1) ORDER BY m[2] LIMIT 100),
p AS (SELECT url FROM a ORDER BY depth, seq LIMIT 20),
b AS (SELECT url, m[1] AS depth, m[2] AS seq FROM (SELECT url, min((depth, seq)) AS m FROM items WHERE url NOT IN (SELECT url FROM a) GROUP BY 1) ORDER BY m[2] LIMIT (SELECT 100 - count(*) + 20 FROM a))
SELECT * FROM a WHERE url NOT IN (SELECT url FROM p) UNION ALL SELECT * FROM b""")
def f01_batches(spark, d):
    """A stored frontier of 100 items: batches pushed (one of them twice), popped, folded and pushed again by another instance."""
    from ..sources.warc import shared_folder
    from ..streaming.frontier import Frontier

    it, path = items(spark, d), shared_folder(spark, "frontier")
    first = Frontier(spark, path, 100)
    for batch in ("even", "even"):
        first.push(it.where("seq % 2 = 0"), batch)
    first.pop(20, "first")
    first.compact()
    again = Frontier(spark, path, 100)
    again.push(it.where("seq % 2 = 0"), "even")
    again.push(it, "all")
    return again.pending()


@query("f09_saved_filter", f"WITH {_ITEMS} SELECT seq, url IN (SELECT url FROM items WHERE seq % 5 = 0) AS seen, FALSE AS missed FROM items")
def f09_saved(spark, d):
    """Urls by a stored and merged filter of bits, then exactly; a seen url that the filter denies would be missed."""
    from ..operators import membership as B
    from ..sources.warc import shared_folder

    it, path = items(spark, d), shared_folder(spark, "filter")
    own = B.SeenFilter.sized(100_000, 0.001)
    parts = [it.where(f"seq % 10 = {r}") for r in (0, 5)]
    own.save(own.merge(*map(own.build, parts)), B.merged_sketch(*map(B.distinct_sketch, parts)), path)
    stored, table, _ = B.load(spark, path)
    new = stored.unseen(it, table, it.where("seq % 5 = 0")).select("seq", F.lit(False).alias("s"))
    marked = stored.maybe(it, table).join(new, "seq", "left").withColumn("seen", F.coalesce("s", F.lit(True)))
    return marked.select("seq", "seen", (F.col("seen") & ~F.col("maybe")).alias("missed"))


@query("f12_missing_resources", f"WITH {_ITEMS} SELECT DISTINCT url FROM items WHERE seq % 2 = 0 EXCEPT SELECT url FROM items WHERE seq % 3 = 0")
def f12(spark, d):
    it = items(spark, d)
    return R.missing(it.where("seq % 2 = 0"), it.where("seq % 3 = 0"))


_MIMES = "CASE event_type WHEN 'view' THEN 'text/css' WHEN 'click' THEN 'application/javascript' WHEN 'purchase' THEN 'image/png' ELSE 'text/html' END"


@query("f13_priority_order", f"SELECT event_id, priority, row_number() OVER (ORDER BY priority DESC, event_id) - 1 AS place FROM (SELECT event_id, CASE WHEN regexp_matches({_MIMES}, 'css|javascript|font|image') THEN 10 ELSE 0 END AS priority FROM events)")
def f13(spark, d):
    return R.prioritised(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), F.expr(_MIMES), "event_id").select("event_id", "priority", "place")


@query("f14_download_stats", "SELECT user_id, count(*) AS total, sum((event_type <> 'error')::INTEGER)::BIGINT AS completed, sum((event_type = 'error')::INTEGER)::BIGINT AS failed, round(sum(CASE WHEN event_type <> 'error' THEN value END) / nullif(sum((event_type <> 'error')::INTEGER), 0), 6) AS mean_value FROM events GROUP BY 1")
def f14(spark, d):
    return R.download_stats(spark.read.parquet(f"{d}/events.parquet"), "user_id", F.col("event_type") != "error", F.col("value"))


@query("f15_sitemap", f"SELECT {S.host('url')} AS host, 0 AS part, string_agg(DISTINCT '<url><loc>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc></url>', '' ORDER BY '<url><loc>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc></url>') AS body FROM pages GROUP BY 1")
def f15(spark, d):
    return R.sitemaps(pages(spark, d))


@query("f16_site_aggregate", f"SELECT {S.host('url')} AS host, arg_min(page_id, (CASE WHEN page_id % 10 = 0 THEN 0 ELSE 1 END, page_id)) AS page_id FROM pages GROUP BY 1")
def f16(spark, d):
    return R.site_pages(pages(spark, d), F.col("page_id") % 10 == 0)

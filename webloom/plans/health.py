"""Queries of host health, snapshots and robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import urls as U
from ..operators import health as H
from ..operators import robots as R
from ..operators import snapshots as C
from ..operators.ranges import breaker_states
from . import sqltext as S
from .registry import query
from .urls import pages


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


_MSG = ("lookup: no such host", "tls: bad certificate", "context deadline exceeded", "429 too many requests", "403 blocked by captcha", "login required 401", "connection reset by peer", "cannot allocate memory", "canceled", "odd", "Timeout", "DNS")
_KIND = "CASE " + " ".join(f"WHEN {S.holds('message', ws)} THEN '{k}'" for k, ws in T.ERROR_WORDS) + " ELSE 'unknown' END"


@query("h01_error_class", f"WITH m AS (SELECT event_id, list_extract([{S.quoted(_MSG)}], (event_id % {len(_MSG)})::INTEGER + 1) AS message FROM events) SELECT event_id, {_KIND} AS kind, {_KIND} IN ({S.quoted(T.RETRYABLE_KINDS)}) AS retryable FROM m")
def h01(spark, d):
    m = F.get(F.array(*[F.lit(x) for x in _MSG]), (F.col("event_id") % len(_MSG)).cast("int"))
    e = events(spark, d).select("event_id", H.error_kind(m).alias("kind"))
    return e.select("event_id", "kind", H.is_retryable_kind(F.col("kind")).alias("retryable"))


@query("h03_retry_status", "SELECT event_id, s::INTEGER AS status, (s IN (408, 429) OR s >= 500) AS retryable, s IN (429, 503) AS limited FROM (SELECT event_id, 100 + (event_id * 7) % 500 AS s FROM events)")
def h03(spark, d):
    s = events(spark, d).select("event_id", (100 + F.col("event_id") * 7 % 500).cast("int").alias("status"))
    return s.select("event_id", "status", H.is_retryable_status(F.col("status")).alias("retryable"), F.col("status").isin(429, 503).alias("limited"))


@query("h04_backoff", "WITH a AS (SELECT event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS attempt FROM events) SELECT event_id, attempt, least(30000.0::DOUBLE, 1000 * pow(2::DOUBLE, least(attempt, 40))) AS wait_ms FROM a WHERE event_type = 'error'")
def h04(spark, d):
    """The wait before each failed attempt of a user is repeated."""
    from pyspark.sql import Window as W

    a = events(spark, d).withColumn("attempt", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")).where("event_type = 'error'")
    return a.select("event_id", "attempt", H.backoff_ms(F.least("attempt", F.lit(40))).alias("wait_ms"))


@query("h05_retry_after", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 300)::DOUBLE WHEN 1 THEN event_id % 300 + 0.5::DOUBLE WHEN 2 THEN greatest(0, floor(epoch(ts::TIMESTAMP)) - epoch(TIMESTAMP '2024-01-01') - 0)::DOUBLE ELSE 0::DOUBLE END AS seconds FROM events")
def h05(spark, d):
    """Headers of each event: whole and broken seconds, the event's time as an HTTP date, words, nothing."""
    date = F.concat(F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    n = F.col("event_id") % 300
    header = F.when(F.col("event_id") % 5 == 0, n.cast("string")).when(F.col("event_id") % 5 == 1, F.concat(n, F.lit(".5"))).when(F.col("event_id") % 5 == 2, date).when(F.col("event_id") % 5 == 3, "soon").otherwise("")
    return events(spark, d).select("event_id", H.retry_after_seconds(header, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("seconds"))


@query("h06_retry_outcome", "WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, min(CASE WHEN event_type <> 'error' THEN k END)::INTEGER AS attempts, bool_or(event_type <> 'error') AS ok FROM a WHERE k <= 3 GROUP BY 1")
def h06(spark, d):
    return H.outcomes(events(spark, d), "user_id", "event_id", F.col("event_type") != "error")


_EV = "e AS (SELECT user_id, epoch_us(ts) / 1e6 AS at, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_STEP = """CASE WHEN s.st = 'open' AND NOT e.at - s.since > 60 THEN {'st': 'open', 'bad': s.bad, 'good': s.good, 'since': s.since}
  WHEN s.st = 'half_open' AND e.at - s.since > 60 THEN {'st': 'open', 'bad': s.bad, 'good': s.good, 'since': e.at}
  WHEN s.st = 'open' AND e.ok THEN {'st': 'half_open', 'bad': 0, 'good': 1, 'since': e.at}
  WHEN s.st = 'open' THEN {'st': 'open', 'bad': 1, 'good': 0, 'since': e.at}
  WHEN s.st = 'half_open' AND e.ok AND s.good + 1 >= 2 THEN {'st': 'closed', 'bad': 0, 'good': 0, 'since': e.at}
  WHEN s.st = 'half_open' AND e.ok THEN {'st': 'half_open', 'bad': s.bad, 'good': s.good + 1, 'since': s.since}
  WHEN s.st = 'half_open' THEN {'st': 'open', 'bad': s.bad + 1, 'good': 0, 'since': e.at}
  WHEN e.ok THEN {'st': 'closed', 'bad': 0, 'good': 0, 'since': s.since}
  WHEN s.bad + 1 >= 5 THEN {'st': 'open', 'bad': s.bad + 1, 'good': 0, 'since': e.at}
  ELSE {'st': 'closed', 'bad': s.bad + 1, 'good': 0, 'since': e.at} END"""
_BREAKER = f"""WITH RECURSIVE {_EV},
s AS (SELECT user_id, 0::BIGINT AS k, 'closed' AS st, 0 AS bad, 0 AS good, 0.0::DOUBLE AS since FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, n.st, n.bad, n.good, n.since FROM (SELECT e.user_id, e.k, {_STEP} AS n FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)),
b AS (SELECT user_id, arg_max(st, k) AS state, arg_max(bad, k)::BIGINT AS failures, max(k) AS events FROM s GROUP BY 1)"""


@query("h07_breaker_states", f"{_BREAKER} SELECT * FROM b")
def h07(spark, d):
    e = events(spark, d).withColumn("ok", F.col("event_type") != "error")
    return breaker_states(e)


@query("h08_limiter", """WITH RECURSIVE e AS (SELECT user_id, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
s AS (SELECT user_id, k, 1000.0::DOUBLE AS delay, ms::DOUBLE AS mean FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, CASE WHEN s.mean * 0.7 + e.ms * 0.3 > 3 * s.delay THEN least(2 * s.delay, 30000.0) WHEN s.mean * 0.7 + e.ms * 0.3 < s.delay / 3 THEN greatest(s.delay / 2, 100.0) ELSE s.delay END, s.mean * 0.7 + e.ms * 0.3
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, round(arg_max(delay, k), 6) AS delay, round(arg_max(mean, k), 6) AS mean FROM s GROUP BY 1""")
def h08(spark, d):
    return H.limiter_delays(events(spark, d))


@query("h09_token_bucket", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS sec FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS k FROM e) SELECT event_id, round(max(sec - k * 2.5) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) + k * 2.5, 3) AS start FROM n")
def h09(spark, d):
    e = events(spark, d).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return H.bucket_starts(e, "user_id", "at", "event_id", 2.5).select("event_id", F.round("start", 3).alias("start"))


@query("h10_idle_hosts", "SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def h10(spark, d):
    return H.idle(events(spark, d), "user_id", "ts")


@query("h11_breaker_gauges", f"{_BREAKER} SELECT state, count(*) AS n FROM b GROUP BY 1")
def h11(spark, d):
    return h07(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query("h12_cron_next", "SELECT event_id, (SELECT min(m) FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 25 HOUR, INTERVAL 15 MINUTE)) AS m) WHERE hour(m) BETWEEN 2 AND 4) AS next FROM events")
def h12(spark, d):
    return H.cron_next(events(spark, d).select("event_id", "ts"), ["*/15", "2-4", "*", "*", "*"]).select("event_id", "next")


@query("h13_first_per_host", f"SELECT {S.host('url')} AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def h13(spark, d):
    return H.first_of_host(pages(spark, d))


def versions(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")


@query("c01_snapshot_newest_n", "WITH h AS (SELECT conv_id, turn, sha256(text) AS hash, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), f AS (SELECT conv_id, turn, hash, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM h WHERE b IS NULL OR b <> hash) SELECT conv_id, turn, hash, rank::INTEGER AS rank FROM f WHERE rank <= 2")
def c01(spark, d):
    return C.captured(versions(spark, d), "conv_id", "turn", "text", 2)


@query("c02_changed", "WITH h AS (SELECT conv_id, turn, sha256(text) <> lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS changed FROM conversations) SELECT conv_id, turn, coalesce(changed, false) AS changed FROM h")
def c02(spark, d):
    return C.changes(versions(spark, d), "conv_id", "turn", "text")


def _elements(spark, d):
    words = F.posexplode(F.split("text", " "))
    e = versions(spark, d).select("conv_id", "turn", words.alias("pos", "w"))
    return e.select("conv_id", "turn", F.substring("w", 1, 3).alias("selector"), F.md5("w").alias("text_hash"), "pos")


_DIFF = """WITH t AS (SELECT conv_id, turn, lead(turn) OVER w AS nxt, lag(turn) OVER w AS prv FROM (SELECT DISTINCT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT conv_id, turn, substr(w, 1, 3) AS selector, arg_max(md5(w), pos) AS h FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations) GROUP BY 1, 2, 3),
n AS (SELECT l.* FROM l JOIN t USING (conv_id, turn) WHERE prv IS NOT NULL), o AS (SELECT l.conv_id, nxt AS turn, selector, h FROM l JOIN t USING (conv_id, turn) WHERE nxt IS NOT NULL),
c AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.turn, n.turn) AS turn, coalesce(o.selector, n.selector) AS selector, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM o FULL OUTER JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn AND o.selector = n.selector WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h)"""


@query("c03_structural_diff", f"{_DIFF} SELECT * FROM c")
def c03(spark, d):
    """Every version of every conversation against the one before."""
    return C.step_diffs(_elements(spark, d), "conv_id", "turn")


@query("c04_ignored_selectors", f"{_DIFF} SELECT * FROM c WHERE NOT contains(selector, 'th')")
def c04(spark, d):
    return C.step_diffs(_elements(spark, d), "conv_id", "turn", ignore=["th"])


@query("c06_snapshot_files", "WITH k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id::VARCHAR AS url, least(count(*), 3)::BIGINT AS n_snapshots, max(turn)::BIGINT AS newest_turn FROM k GROUP BY 1")
def c06(spark, d):
    """Snapshots written, cleaned (three are kept) and counted as they come back."""
    from ..sources import files as S2
    from ..sources.warc import shared_folder

    v = versions(spark, d).select(F.col("conv_id").cast("string").alias("url"), F.timestamp_seconds(F.col("turn")).alias("ts"), F.sha2("text", 256).alias("html_hash"), F.col("text").alias("text_content"))
    path = shared_folder(spark, "snapshots")
    S2.write_snapshots(v, f"{path}/all")
    kept = S2.clean_snapshots(spark, f"{path}/all", f"{path}/kept", 3)
    return S2.snapshot_counts(kept).select("url", "n_snapshots", F.unix_timestamp("newest").alias("newest_turn"))


@query("c06_change_report", f"{_DIFF} SELECT conv_id::VARCHAR AS url, sum((change = 'added')::INTEGER)::BIGINT AS added, sum((change = 'removed')::INTEGER)::BIGINT AS removed, sum((change = 'modified')::INTEGER)::BIGINT AS modified FROM c GROUP BY 1")
def c06_report(spark, d):
    from ..sources import files as S2

    return S2.snapshot_report(c03(spark, d).withColumn("url", F.col("conv_id").cast("string")))


@query("c05_changed_pages", "SELECT conv_id, count(DISTINCT sha256(text)) AS n_versions FROM conversations GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def c05(spark, d):
    return C.changed_keys(versions(spark, d), "conv_id", "text")


_RULES = (("/", False), ("/en/", True), ("/fr/*.html", False), ("/*/1", True), ("/de/", True), ("/en/4", False))
_RULE_SQL = "(VALUES " + ", ".join(f"('{r}', {str(a).lower()}, '^{r.replace('.', chr(92) + '.').replace('*', '.*')}')" for r, a in _RULES) + ") r(rule, allow, rx)"


@query("r04_robots_evaluate", f"WITH p AS (SELECT page_id, {S.part('url', 3)} AS path FROM pages), m AS (SELECT page_id, coalesce(max(CASE WHEN allow THEN length(rule) END), -1) AS a, coalesce(max(CASE WHEN NOT allow THEN length(rule) END), -1) AS b FROM p JOIN {_RULE_SQL} ON regexp_matches(path, rx) GROUP BY 1) SELECT p.page_id, coalesce(a >= b, true) AS allowed FROM p LEFT JOIN m USING (page_id)")
def r04(spark, d):
    p = pages(spark, d).select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    rules = F.broadcast(spark.createDataFrame(list(_RULES), "rule string, allow boolean"))
    every = p.select("host").distinct().crossJoin(rules)
    return R.evaluate(p, every).select("page_id", "allowed")


_FILES = "# all\nUser-agent: *\nDisallow: /p%s/\nAllow: /p%s/open\nCrawl-delay: 2.5\nSitemap: /map%s.xml\nUser-agent: Other\nDisallow: /\n"


def _files(spark, d):
    """A file for each page's host: rules, a file with a delay alone, a missing one, a failed one."""
    n = F.col("page_id").cast("string")
    a, b, c, e = _FILES.split("%s")
    full = F.concat(F.lit(a), n, F.lit(b), n, F.lit(c), n, F.lit(e))
    kind = F.col("page_id") % 4
    body = F.when(kind == 0, full).when(kind == 1, F.lit("User-agent: webloom\nCrawl-delay: 7\n")).otherwise(F.lit("User-agent: *\nDisallow: /x"))
    return pages(spark, d).select(n.alias("host"), F.when(kind == 2, 404).when(kind == 3, 503).otherwise(200).alias("status"), body.alias("body"))


@query("r01_robots_parse", "SELECT page_id::VARCHAR AS host, unnest(['/p' || page_id || '/', '/p' || page_id || '/open']) AS rule, unnest([false, true]) AS allow FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id::VARCHAR, '/', false FROM pages WHERE page_id % 4 = 3")
def r01(spark, d):
    return R.rules(R.parsed(_files(spark, d), "webloom/1.0"))


@query("r02_robots_status", "SELECT page_id::VARCHAR AS host, CASE page_id % 4 WHEN 0 THEN 2.5 WHEN 1 THEN 7.0 ELSE 0.0 END::DOUBLE AS delay, (page_id % 4 = 3) AS transient, CASE page_id % 4 WHEN 0 THEN '/map' || page_id || '.xml' ELSE '' END AS maps FROM pages")
def r02(spark, d):
    return R.parsed(_files(spark, d), "webloom/1.0").select("host", "delay", "transient", F.array_join("sitemaps", ",").alias("maps"))


@query("r05_robots_validity", "WITH f AS (SELECT event_id, ts, last_value(CASE WHEN event_type IN ('view', 'error') THEN ts + CASE WHEN event_type = 'error' THEN INTERVAL 5 MINUTE ELSE INTERVAL 24 HOUR END END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS until FROM events) SELECT event_id, coalesce(ts < until, false) AS valid FROM f")
def r05(spark, d):
    """Views and errors fetch the host's file; does it count at each event?"""
    fetch = F.col("event_type").isin("view", "error")
    return R.validity(events(spark, d), "user_id", "ts", "event_id", fetch, F.col("event_type") == "error").select("event_id", "valid")


@query("r05_valid_requests", """WITH f AS (SELECT user_id, ts, bool_and(coalesce(value < 30, FALSE)) AS transient FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT r.event_id, coalesce(r.ts < f.ts + CASE WHEN f.transient THEN INTERVAL 5 MINUTE ELSE INTERVAL 24 HOUR END, FALSE) AS valid FROM (SELECT * FROM events WHERE event_type <> 'view') r ASOF LEFT JOIN f ON r.user_id = f.user_id AND r.ts >= f.ts""")
def r05_requests(spark, d):
    """An as-of join of two tables: what a user's last fetch says of each of its requests."""
    e = events(spark, d)
    fetches = e.where("event_type = 'view'").select(F.col("user_id").alias("host"), F.col("ts").alias("at"), (F.col("value") < 30).alias("transient"))
    asked = e.where("event_type <> 'view'").select(F.col("user_id").alias("host"), F.col("ts").alias("at"), "event_id")
    return R.valid_at(asked, fetches).select("event_id", "valid")


@query("r06_effective_delay", "SELECT user_id, coalesce(nullif(max(CASE WHEN event_type = 'error' THEN 2.0 ELSE 0.0 END), 0), 1.0)::DOUBLE AS delay FROM events GROUP BY 1")
def r06(spark, d):
    return R.effective_delay(events(spark, d), "user_id", F.when(F.col("event_type") == "error", 2.0).otherwise(0.0), 1.0)


@query("r07_robots_expiry", "SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR >= (SELECT max(ts) FROM events)")
def r07(spark, d):
    e = events(spark, d)
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast(e.schema["ts"].dataType)
    return R.unexpired(e, "ts", now).select("event_id")

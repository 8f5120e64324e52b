"""Content and page dedupe, mapping, repair: DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from . import rewrite as RW


def content_aliases(rows: DataFrame, body: Column, path: Column, seq: Column, key: str = "sha") -> DataFrame:
    """Adds ``sha``, ``path`` and ``alias``: the first row (by ``seq``) with a body keeps its path, later ones take it.

    Bodies that are empty or null are left out.  The digest alone is shuffled; the first
    path of each is found by a minimum that combines before the shuffle.
    """
    narrow = rows.where(F.coalesce(F.length(body), F.lit(0)) > 0).select(F.sha2(body, 256).alias(key), seq.alias("seq"), path.alias("own_path"))
    first = narrow.groupBy(key).agg(F.min(F.struct("seq", "own_path")).alias("f"))
    joined = narrow.join(first, key)
    return joined.select(key, "seq", F.col("f.own_path").alias("path"), (F.col("f.seq") != F.col("seq")).alias("alias"))


def content_report(rows: DataFrame, body: Column, group: Column, seq: Column) -> DataFrame:
    """``host, n_pages, n_distinct, n_aliased`` of a group of pages (their host): how many bodies are another page's.

    The first row (by ``seq``) with a body keeps it.  One scan; what is shuffled are counts
    by digest and group, so a body that very many pages share is a row for each group.
    """
    narrow = rows.where(F.coalesce(F.length(body), F.lit(0)) > 0).select(F.sha2(body, 256).alias("sha"), group.alias("host"), seq.alias("seq"))
    each = narrow.groupBy("sha", "host").agg(F.count("*").alias("n"), F.min("seq").alias("own"))
    first = each.withColumn("first", F.min("own").over(W.partitionBy("sha")))
    kept = (F.col("own") == F.col("first")).cast("int")
    return first.groupBy("host").agg(F.sum("n").alias("n_pages"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - kept).alias("n_aliased"))


def _keyed(pages: DataFrame, url: str, path: str, keep_query: list[str], keep_segments: list[str]) -> DataFrame:
    """``key, w, path, noise`` of each page; the url is taken apart once, its parts go on as a column."""
    rows = pages.select(F.col(url).alias("u"), U.parts(F.col(url)).alias("p"), F.col(path).alias("path"))
    return rows.select(U.key_of_parts(F.col("u"), F.col("p"), keep_query, keep_segments).alias("key"), U.weight_of_parts(F.col("p")).alias("w"), "path", U.noise_of_parts(F.col("p")).alias("noise"))


def dedupe_pages(pages: DataFrame, url: str = "url", path: str = "path", keep_query: list[str] = (), keep_segments: list[str] = ()) -> DataFrame:
    """One row per canonical page: ``key, kept, n_pages``; noise routes are dropped.

    The cleanest url (least weight, then path) of each group is kept.
    """
    return _kept(_keyed(pages, url, path, keep_query, keep_segments))


def _kept(rows: DataFrame) -> DataFrame:
    return rows.where("not noise").groupBy("key").agg(F.min(F.struct("w", "path"))["path"].alias("kept"), F.count("*").alias("n_pages"))


def export_pages(pages: DataFrame, folder: str, url: str = "url", path: str = "path", keep_query: list[str] = (), keep_segments: list[str] = ()) -> dict[str, int]:
    """Write what ``dedupe_pages`` keeps to ``folder/kept``, and its manifest to ``folder/manifest``; the counters of the run.

    The manifest has a row ``kept, collapsed`` for each page that another one stands for.
    ``pages_total``, ``noise_dropped`` and ``pages_collapsed`` (noise among them) are observed
    while the pages are read, and bytes are those of the paths' table; nothing is read again for them.
    """
    spark = pages.sparkSession
    seen, done = Observation(), Observation()
    rows = _keyed(pages, url, path, keep_query, keep_segments).observe(seen, F.count("*").alias("pages_total"), F.sum(F.col("noise").cast("long")).alias("noise_dropped"))
    rows.write.parquet(f"{folder}/keys")
    keys = spark.read.schema(rows.schema).parquet(f"{folder}/keys")
    _kept(keys).observe(done, F.count("*").alias("pages_kept")).write.parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    many = kept.where("n_pages > 1").select("key", "kept")
    manifest = keys.where("not noise").select("key", F.col("path").alias("collapsed")).join(many, "key").where("collapsed <> kept").select("kept", "collapsed")
    manifest.write.parquet(f"{folder}/manifest")
    total, noise, n = (x or 0 for x in (seen.get["pages_total"], seen.get["noise_dropped"], done.get["pages_kept"]))
    return {"pages_total": total, "noise_dropped": noise, "pages_kept": n, "pages_collapsed": total - n}


def missing_assets(refs: DataFrame, present: DataFrame, ref: str = "ref", url: str = "url") -> DataFrame:
    """Distinct references that no stored url answers, with the number of pages that need them."""
    found = present.select(F.col(url).alias(ref)).distinct()
    return refs.join(found, ref, "left_anti").groupBy(ref).agg(F.countDistinct("page_id").alias("n_pages"))


def css_escaped(url: Column) -> Column:
    """A url as it stands in style sheets: quotes, brackets, commas and backslashes behind a backslash."""
    return F.regexp_replace(url, r"""([(),'"\\])""", r"\\$1")


def repair(pages: DataFrame, mapping: DataFrame, html: str = "html") -> DataFrame:
    """``page_id`` and the pages (``page_id, url, path``, html) with repaired urls as relative paths, plain and as style sheets write them.

    ``mapping`` (``url, path``) has all files that were fetched anew; a page meets those of
    its own asset urls, longest first where one url begins another.
    """
    refs = pages.select("page_id", F.explode(H.asset_urls(F.col("url"), F.col(html), css_relative=False)).alias("ref_url"))
    found = mapping.groupBy(F.col("url").alias("ref_url")).agg(F.min("path").alias("path"))
    return RW.rewritten(pages, refs.join(found, "ref_url"), RW.repaired_html, html)


def resolved_mapping(sources: list[DataFrame]) -> DataFrame:
    """``url, path`` of several mappings; those named first win, with aliases of index pages."""
    every = None
    for rank, s in enumerate(sources):
        one = s.select(F.explode(U.directory_aliases(F.col("url"))).alias("url"), "path", F.lit(rank).alias("rank"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("url").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))


def asset_copies(files: DataFrame, path: Column, digest: Column) -> DataFrame:
    """``is_page, n_files, n_contents``: stored files by kind, and how many contents they have; assets are all kept, whatever their content."""
    each = files.groupBy(U.is_html_page_url(path).alias("is_page"), digest.alias("_sha")).agg(F.count("*").alias("n"))
    return each.groupBy("is_page").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_contents"))


def localised(refs: DataFrame, mapping: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``path`` and ``how`` (mapped, unescaped, derived, none) to references (absolute ``url``).

    A reference's stored file is that of its url in ``mapping`` (``url, path``), else that of
    its percent-decoded url, else the place where it would have been saved, if it is among
    ``files`` (``path``).  Urls are looked up once each, so a very frequent one costs no more.
    """
    one = refs.select(url).distinct()
    decoded = F.coalesce(F.try_url_decode(F.replace(F.col(url), F.lit("+"), F.lit("%2B"))), F.col(url))
    one = one.select(url, decoded.alias("_d"), F.when(U.is_valid_url(F.col(url)) & (U.host(F.col(url)) != ""), U.path_for_url(F.col(url))).alias("_p"))
    known = mapping.groupBy(F.col("url").alias("_u")).agg(F.min("path").alias("_m"))
    have = files.select(F.col("path").alias("_p")).distinct().withColumn("_has", F.lit(True))
    one = one.join(known, F.col(url) == F.col("_u"), "left").drop("_u")
    one = one.join(known.select(F.col("_u"), F.col("_m").alias("_n")), F.col("_d") == F.col("_u"), "left").drop("_u").join(have, "_p", "left")
    how = F.when(F.col("_m").isNotNull(), "mapped").when(F.col("_n").isNotNull(), "unescaped").when(F.col("_has"), "derived").otherwise("none")
    one = one.select(url, F.coalesce("_m", "_n", F.when(F.col("_has"), F.col("_p"))).alias("path"), how.alias("how"))
    return refs.join(one, url, "left").withColumn("how", F.coalesce("how", F.lit("none")))


def stored_pages(files: DataFrame, path: Column) -> DataFrame:
    """Rows whose stored path is a page of its own folder."""
    return files.withColumn("path", path).where(F.col("path").endswith("index.html") & (F.size(F.split("path", "/")) >= 2))


def run_report(files: DataFrame, url: Column, body: Column) -> DataFrame:
    """``n_pages, n_html, n_bytes`` of a run, in one row."""
    return files.agg(F.count("*").alias("n_pages"), F.sum(U.is_html_page_url(url).cast("int")).alias("n_html"), F.sum(F.octet_length(body)).alias("n_bytes"))

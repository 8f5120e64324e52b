"""Crawl frontier: admission, caps, expansion."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls as U


def push(items: DataFrame, seen: DataFrame) -> DataFrame:
    """New urls (``url, depth, seq``), the first of each, that were never seen."""
    first = items.groupBy("url").agg(F.min(F.struct("depth", "seq")).alias("f")).select("url", "f.depth", "f.seq")
    return first.join(seen.select("url").distinct(), "url", "left_anti")


def pop(items: DataFrame, k: int) -> DataFrame:
    """The k items of least depth, first come first."""
    return items.orderBy("depth", "seq").limit(k)


def admitted(items: DataFrame, seen: DataFrame, domains: list[str] = (), excluded: list[str] = (), total: int = 0, most_total: int | None = None, size: int = 0, most_size: int | None = None) -> DataFrame:
    """Valid, allowed, not excluded, not seen; cheap tests come before the join.

    ``most_total`` urls are taken in all (``total`` of them before), and ``most_size`` are
    queued at once (``size`` are now): the first new ones by (depth, seq) get the room there
    is, each url once.
    """
    u = F.col("url")
    fit = items.where(U.is_valid_url(u) & U.is_allowed_domain(u, list(domains)) & ~U.is_excluded(u, list(excluded))).join(seen.select("url").distinct(), "url", "left_anti")
    rooms = [most - now for most, now in ((most_total, total), (most_size, size)) if most is not None]
    if not rooms:
        return fit
    from ..sources.warc import running_offsets

    first = fit.groupBy("url").agg(F.min(F.struct("depth", "seq")).alias("f")).select("url", "f.depth", "f.seq", F.lit(1).cast("long").alias("_one"))
    return running_offsets(first, ["depth", "seq", "url"], "_one").where(F.col("offset") < max(0, min(rooms))).select("url", "depth", "seq")


def host_capped(items: DataFrame, most: int) -> DataFrame:
    """The first ``most`` urls of each host by (depth, seq); ranks are cut before the shuffle."""
    ranked = items.withColumn("host", U.host(F.col("url")))
    rank = F.row_number().over(W.partitionBy("host").orderBy("depth", "seq"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= most)


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """Least depth of every node (``node, depth``) that edges (``src, dst``) reach from seeds (``node``).

    One join a level with the new nodes only; lineage ends at each level's checkpoint.
    """
    from ..sources.warc import checkpointed

    front = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = front  # a union of the levels' checkpoints: none is written again
    for depth in range(1, max_depth + 1):
        found = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        front = checkpointed(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure(files: DataFrame, refs: Column, roots: DataFrame, max_depth: int) -> DataFrame:
    """``node, depth`` of the files (``url``) that roots (``node``) reach by references in their texts, ``max_depth`` deep.

    References are resolved against their file; each file's text is read once.
    """
    edges = files.select(F.col("url").alias("src"), F.explode(U.let(U.parts(F.col("url")), lambda p: F.transform(refs, lambda r: U.resolve_parts(F.col("url"), p, r)))).alias("dst"))
    return expand(roots, edges.distinct(), max_depth)


def seeds(lists: list[DataFrame], url: str = "url") -> DataFrame:
    """Distinct normal urls of all lists, at depth 0."""
    every = reduce(DataFrame.unionByName, [x.select(F.col(url).alias("url")) for x in lists])
    return every.select(U.normalize_url(F.col("url")).alias("url"), F.lit(0).alias("depth")).distinct()


def lane(url: Column, blocked: list[str] = ()) -> Column:
    """``page``, ``asset``, or ``blocked`` for an asset that holds a blocked part."""
    return F.when(U.is_html_page_url(url), "page").when(U.is_excluded(url, list(blocked)), "blocked").otherwise("asset")


def membership(items: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``seen``: whether the url is among the seen ones (exact, where a filter of bits would err)."""
    known = seen.select(F.col(url)).distinct().withColumn("_hit", F.lit(True))
    return items.join(known, url, "left").withColumn("seen", F.coalesce("_hit", F.lit(False))).drop("_hit")


def missing(wanted: DataFrame, have: DataFrame, url: str = "url") -> DataFrame:
    """Distinct wanted urls that aren't there."""
    return wanted.select(url).distinct().join(have.select(url), url, "left_anti")


# Parts of media types that are fetched first.
CRITICAL = ("css", "javascript", "font", "image")


def prioritised(requests: DataFrame, mime: Column, seq: str) -> DataFrame:
    """Adds ``priority`` (10 for what a page needs to show, else 0) and ``place`` in the order of fetching, over all requests."""
    from ..sources.warc import running_offsets

    rows = requests.withColumn("priority", F.when(mime.rlike("|".join(CRITICAL)), 10).otherwise(0)).withColumn("_first", -F.col("priority")).withColumn("_one", F.lit(1).cast("long"))
    return running_offsets(rows, ["_first", seq], "_one").withColumnRenamed("offset", "place").drop("_first", "_one")


def download_stats(results: DataFrame, key: str, ok: Column, size: Column) -> DataFrame:
    """``total, completed, failed, mean_value`` of each key."""
    done = F.sum(ok.cast("int"))
    return results.groupBy(key).agg(F.count("*").alias("total"), done.alias("completed"), F.sum((~ok).cast("int")).alias("failed"), F.round(F.sum(F.when(ok, size)) / F.nullif(done, F.lit(0)), 6).alias("mean_value"))


#: Entries of one site map file.
SITEMAP = 50_000


def sitemaps(pages: DataFrame, url: str = "url", most: int = SITEMAP) -> DataFrame:
    """``host, part, body``: site maps of each host's distinct urls in order, ``most`` entries a part, so that no body grows with its host.

    Places of entries come from ranges of all of them, so a host with very many urls is no task of its own.
    """
    from ..sources.warc import placed

    esc = F.replace(F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    e = pages.select(U.host(F.col(url)).alias("host"), F.concat(F.lit("<url><loc>"), esc, F.lit("</loc></url>")).alias("e")).where("host is not null").distinct()
    e = placed(e, "host", ["e"]).withColumn("part", F.floor(F.col("place") / most).cast("int"))
    return e.groupBy("host", "part").agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("body"))


def site_pages(pages: DataFrame, is_seed: Column, url: str = "url", seq: str = "page_id") -> DataFrame:
    """``host`` and the page that stands for it: a seed before others, then the first."""
    key = F.struct(F.when(is_seed, 0).otherwise(1), F.col(seq))
    return pages.groupBy(U.host(F.col(url)).alias("host")).agg(F.min_by(seq, key).alias(seq))


def save_state(path: str, **tables: DataFrame) -> str:
    """Write a frontier's tables (frontier, visited, host_state, ...) as a new version; the pointer to it is renamed into place last.

    Pointers are numbered files, of which the last one counts, so that a crash at any point
    leaves the version before.
    """
    some = next(iter(tables.values()))
    spark, version = some.sparkSession, uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    fs, root, at = _folder(spark, f"{path}/pointers")
    last = max([int(x) for x in _pointers(fs, root)], default=0)
    out = fs.create(at(f"{path}/pointers/.{version}"))
    out.write(bytearray(f"{version},{','.join(sorted(tables))}".encode()))
    out.close()
    if not fs.rename(at(f"{path}/pointers/.{version}"), at(f"{path}/pointers/{last + 1:012d}")):
        raise RuntimeError(f"another version of {path} was saved meanwhile")
    return version


def _folder(spark, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    root = at(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    return fs, root, at


def _pointers(fs, root) -> list[str]:
    return sorted(x.getPath().getName() for x in fs.listStatus(root) if x.getPath().getName().isdigit())


def load_state(spark, path: str) -> dict[str, DataFrame]:
    """The tables of the version that the last pointer names."""
    fs, root, _ = _folder(spark, f"{path}/pointers")
    found = _pointers(fs, root)
    if not found:
        raise FileNotFoundError(f"no saved version in {path}")
    version, *names = spark.read.text(f"{path}/pointers/{found[-1]}", wholetext=True).first()[0].split(",")
    return {name: spark.read.parquet(f"{path}/{version}/{name}") for name in names}


def resume(stored: DataFrame, refs: DataFrame, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(visited, pending) of an interrupted run: urls on disk with their aliases, and references to no such url.

    Pending urls are normal, valid, no noise, at depth 1, and at most ``most`` (in order of text).
    """
    visited = stored.select(F.explode(U.directory_aliases(U.normalize_url(F.col("url")))).alias("url")).distinct()
    wanted = refs.select(U.normalize_url(F.col("url")).alias("url")).where(U.is_valid_url(F.col("url")) & ~U.is_resume_noise(F.col("url"))).distinct()
    pending = wanted.join(visited, "url", "left_anti").withColumn("depth", F.lit(1)).orderBy("url").limit(most)
    return visited, pending

"""One JSON document of any size: read by ranges of bytes, written by many tasks; no row or task holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .warc import checkpointed


def json_text(value: Column) -> Column:
    """A string as JSON writes it."""
    text = F.to_json(F.array(value))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """``url, path`` of a file (or of the part files of a document) with one flat JSON object of strings; a repeated key gives a row each.

    Spark cuts the file at quotes, range by range.  Which pieces are inside of strings follows
    from the number of quotes before them: those of each range are counted, the counts of the
    ranges added up, and a quote behind an odd number of backslashes doesn't count.
    Anything else than strings between the quotes is an error.
    """
    at = lambda c: F.col(f"_metadata.{c}")
    pieces = spark.read.option("lineSep", '"').text(path).select("value", at("file_path").alias("file"), at("file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"))
    behind = F.length(F.regexp_extract("value", r"\\*+\z", 0)) % 2
    pieces = pieces.withColumn("quote", (1 - behind).cast("long"))
    ranges = pieces.groupBy("file", "start").agg(F.sum("quote").alias("n"))
    before = ranges.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("quote").over(W.partitionBy("file", "start").orderBy("m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("inside", inside).join(F.broadcast(before), ["file", "start"]).withColumn("s", F.col("base") + F.col("inside"))  # a row for each range
    plain = F.when(F.col("value").rlike(r"^[\s{},:]*+\z"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("no flat object of strings: "), F.substring("value", 1, 40))).cast("boolean"))
    strings = rows.where((F.col("s") % 2 == 1) | plain).withColumn("k", F.expr("(s + 1) div 2"))
    pairs = strings.groupBy("file", F.expr("(k + 1) div 2").alias("pair")).agg(F.array_sort(F.collect_list(F.struct("k", "start", "m", "value"))).alias("x"))
    text = lambda odd: F.get(F.from_json(F.concat(F.lit('["'), F.array_join(F.transform(F.filter("x", lambda p: p["k"] % 2 == odd), lambda p: p["value"]), '"'), F.lit('"]')), "array<string>"), F.lit(0))
    return pairs.select(text(1).alias("url"), text(0).alias("path"))


def write_document(entries: DataFrame, entry: Column, order: list[str], path: str, head: str, tail: str) -> None:
    """One JSON document as part files that make it up in the order of their names: ``head``, the entries with commas between, ``tail``.

    Each entry is a line; the first and the last one are found by their place in the sorted table.
    """
    lines = checkpointed(entries.orderBy(*order).select(entry.alias("value"), F.monotonically_increasing_id().alias("m")))
    first, last = lines.agg(F.min("m"), F.max("m")).first()
    if first is None:
        entries.sparkSession.range(1).select(F.lit(head + tail).alias("value")).coalesce(1).write.text(path)
        return
    begin = F.when(F.col("m") == first, F.lit(head)).otherwise(F.lit(","))
    lines.select(F.concat(begin, "value", F.when(F.col("m") == last, F.lit(tail)).otherwise(F.lit("")))).write.text(path)


def write_json_map(files: DataFrame, path: str) -> None:
    """``url, path`` as one JSON object, by url."""
    write_document(files, F.concat(json_text(F.col("url")), F.lit(":"), json_text(F.col("path"))), ["url"], path, "{", "}")


# What a HAR file says of itself, and texts of status codes.
HAR_VERSION, HAR_HTTP, HAR_PAGE = "1.2", "HTTP/2", "page_1"
STATUS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 206: "Partial Content", 301: "Moved Permanently", 302: "Found", 303: "See Other",
    304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found",
    405: "Method Not Allowed", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 413: "Request Entity Too Large", 415: "Unsupported Media Type",
    422: "Unprocessable Entity", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}


def har_entry(r: DataFrame) -> Column:
    """One HAR entry as JSON of a captured response (``url, method, status, headers`` (map), ``body, request_body, at``)."""
    name_value = lambda k, v: F.struct(k.alias("name"), v.alias("value"))
    headers = F.transform(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))), lambda e: name_value(e["key"], e["value"]))
    cookies = F.filter(headers, lambda h: F.lower(h["name"]).isin("set-cookie", "cookie"))
    size = F.aggregate(headers, F.lit(0), lambda n, h: n + F.octet_length(h["name"]) + F.coalesce(F.octet_length(h["value"]), F.lit(0)) + 4)
    pairs = F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: p != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    query = F.transform(pairs, lambda p: name_value(plain(F.substring_index(p, "=", 1)), plain(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(""))))
    kind = F.coalesce(F.try_element_at("headers", F.lit("Content-Type")), F.try_element_at("headers", F.lit("content-type")), F.lit("application/octet-stream"))
    text = F.coalesce("body", F.lit(""))
    named = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    posted = F.when(F.coalesce("request_body", F.lit("")) != "", F.struct(F.coalesce(F.try_element_at("headers", F.lit("Content-Type")), F.lit("application/octet-stream")).alias("mimeType"), F.col("request_body").alias("text"), F.array().cast("array<string>").alias("params")))
    sizes = lambda: (size.alias("headersSize"), F.octet_length(text).alias("bodySize"))
    request = F.struct(F.col("method"), F.col("url"), F.lit(HAR_HTTP).alias("httpVersion"), headers.alias("headers"), query.alias("queryString"), cookies.alias("cookies"), *sizes(), posted.alias("postData"))
    content = F.struct(F.octet_length(text).alias("size"), F.trim(F.substring_index(kind, ";", 1)).alias("mimeType"), text.alias("text"), F.lit("none").alias("encoding"))
    response = F.struct(F.col("status"), F.coalesce(F.try_element_at(named, F.col("status").cast("int")), F.lit("Unknown")).alias("statusText"), F.lit(HAR_HTTP).alias("httpVersion"), headers.alias("headers"), cookies.alias("cookies"), content.alias("content"), F.lit("").alias("redirectURL"), *sizes())
    zero = F.lit(0)
    return F.to_json(
        F.struct(
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("startedDateTime"), zero.alias("time"), request.alias("request"), response.alias("response"),
            F.create_map().cast("map<string,string>").alias("cache"), F.struct(zero.alias("send"), zero.alias("wait"), zero.alias("receive")).alias("timings"), F.lit(HAR_PAGE).alias("pageref"),
        )
    )


def write_har(responses: DataFrame, path: str, started: str, creator: str = "webloom", title: str = "Crawl Session") -> None:
    """Captured responses (as for ``har_entry``, with ``seq``) as one HAR document in the order of ``seq``."""
    page = f'{{"startedDateTime":"{started}","id":"{HAR_PAGE}","title":"{title}","pageTimings":{{"onContentLoad":0,"onLoad":0}}}}'
    head = f'{{"log":{{"version":"{HAR_VERSION}","creator":{{"name":"{creator}","version":"1.0"}},"browser":{{"name":"Chrome","version":"120.0"}},"pages":[{page}],"entries":['
    write_document(responses, har_entry(responses), ["seq"], path, head, "]}}")


_NV = "array<struct<name:string,value:string>>"
_ENTRY = f"startedDateTime string, request struct<method:string,url:string,headers:{_NV},queryString:{_NV},cookies:{_NV},headersSize:int,bodySize:int>, response struct<status:int,statusText:string,content:struct<size:int,mimeType:string,text:string>,headersSize:int,bodySize:int>"


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a document of ``write_har``, line by line."""
    line = F.regexp_replace(F.regexp_replace("value", r'^(?:,|\{"log":.*?"entries":\[)', ""), r"\]\}\}$", "")
    return spark.read.text(path).select(F.from_json(line, _ENTRY).alias("e")).where("e.request is not null").select("e.*")

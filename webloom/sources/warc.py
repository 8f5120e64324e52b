"""Archive files: WARC writer and reader as Spark data sources, CDX index, HAR documents."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import json
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Texts of status codes in response records.
STATUS = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 304: "Not Modified", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable"}
SCHEMA = "url string, date timestamp, mime string, status int, body binary"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share.

    Where it is unset, a session on one machine (master ``local``) gets a temporary one; on
    a cluster that is an error, as other machines would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            root = got.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="webloom-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in spark.checkpoint.dir."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{shared_root(spark)}/webloom-{name}-{uuid.uuid4().hex}"


def running_offsets(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Adds ``offset``: the sum of ``size`` of all rows before, in this order.

    Rows are dealt into ranges of the order; sums of the ranges are added up on their own,
    so that only a number for each range meets in one task.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_range", start.alias("_start"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_in", inside).join(F.broadcast(starts), "_range").withColumn("offset", F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0) of each row among those of its (non-null) key, by ranges of all rows: a frequent key is in many tasks."""
    every = running_offsets(rows.withColumn("_one", F.lit(1).cast("long")), [key, *order], "_one").drop("_one")
    first = every.groupBy(key).agg(F.min("offset").alias("_first"))
    return every.join(first, key).withColumn("place", F.col("offset") - F.col("_first")).drop("offset", "_first")


def record(url: str, date: datetime, mime: str, status: int, body: bytes) -> bytes:
    """One response record: headers, HTTP block, two line ends."""
    http = f"HTTP/1.1 {status} {STATUS.get(status, 'Unknown')}\r\nContent-Type: {mime}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = [
        "WARC/1.0",
        "WARC-Type: response",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date}')}>",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[str, datetime, str, int, bytes]:
    """The fields that ``record`` was made of."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    first, *rest = http.decode().split("\r\n")
    mime = next((x.split(": ", 1)[1] for x in rest if x.lower().startswith("content-type: ")), "")
    return fields["WARC-Target-URI"], datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"), mime, int(first.split(" ")[1]), body


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class _Commit(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    """Each task writes its own files, rotated by size; a commit names those that count in an index."""

    def __init__(self, path: str, rotate: int):
        self.path, self.rotate = path, rotate

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        out, name, held, files, index = None, "", 0, [], []
        for r in rows:
            raw = record(r["url"] or "", r["date"] or datetime(1970, 1, 1), r["mime"] or "", r["status"] or 0, bytes(r["body"] or b""))
            if out is None or held + len(raw) > self.rotate and held:
                if out is not None:
                    out.close()
                name, held = f"{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                files.append(name)
            member = gzip.compress(raw, mtime=0)
            at = out.tell()
            out.write(member)
            held += len(raw)
            index.append({"url": r["url"], "date": f"{r['date'] or datetime(1970, 1, 1):%Y%m%d%H%M%S}", "mime": r["mime"], "status": r["status"], "digest": base64.b32encode(hashlib.sha1(bytes(r["body"] or b"")).digest()).decode(), "length": len(member), "offset": at, "file": name})
        if out is not None:
            out.close()
        if index:
            side = f"{uuid.uuid4().hex}.cdxj"
            with fs.open_output_stream(f"{root}/{side}") as f:
                f.write("".join(json.dumps(x) + "\n" for x in index).encode())
            files.append(side)
        return _Commit(files)

    def commit(self, messages) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_files") as f:
            f.write("\n".join(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{root}/{x}")


def _listed(path: str, suffix: str) -> list[str]:
    fs, root = _fs(path)
    with fs.open_input_file(f"{root}/_files") as f:
        return [x for x in f.read().decode().split("\n") if x.endswith(suffix)]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in _listed(self.path, ".warc.gz")] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        if partition.value is None:
            return
        fs, root = _fs(self.path)
        with fs.open_input_stream(f"{root}/{partition.value}", compression=None) as f, gzip.GzipFile(fileobj=io.BufferedReader(f)) as plain:
            while line := plain.readline():
                head = line
                while (line := plain.readline()) not in (b"\r\n", b""):
                    head += line
                size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
                yield parse_record(head + b"\r\n" + plain.read(size + 4))


class Warc(DataSource):
    """``format("warc")``: one gzip member a record; option ``rotate`` is the bytes of a file before the next begins."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("rotate", 1 << 30)))


def write_warc(rows: DataFrame, path: str, rotate: int = 1 << 30) -> None:
    """Write rows (url, date, mime, status, body) as WARC files with a CDX line for each record."""
    rows.sparkSession.dataSource.register(Warc)
    rows.select("url", "date", "mime", "status", "body").write.format("warc").mode("append").option("rotate", rotate).save(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Warc)
    return spark.read.format("warc").load(path)


def cdx(spark: SparkSession, path: str) -> DataFrame:
    """Index of a written archive by url and date, with exact offsets of the gzip members."""
    schema = "url string, date string, mime string, status int, digest string, length long, offset long, file string"
    files = [f"{path}/{x}" for x in _listed(path, ".cdxj")]
    return (spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)).orderBy("url", "date")


_PACKED = "package string, file string, hash string, bytes long, n_records long"


def packages(spark: SparkSession, path: str, target: str, title: str = "") -> DataFrame:
    """``package, file, hash, bytes, n_records``: a WACZ package in ``target`` for each archive file of ``path``, made by its own task.

    Archive files are rotated by size, so a package and its index are bounded.  A package is
    written under another name, block by block, and renamed, so a task that runs again does no
    harm.  ``target/datapackage`` is a document that names all packages.
    """
    to, place = _fs(target)
    to.create_dir(place, recursive=True)
    fields = ["url", "date", "mime", "status", "digest", "length", "offset", "file"]

    def pack(lines):
        import pyarrow as pa

        fs, root = _fs(path)
        out_fs, out_root = _fs(target)
        rows = lines.select(fields).sort_by([("url", "ascending"), ("date", "ascending"), ("offset", "ascending")]).to_pylist()
        name = rows[0]["file"]
        package, part, resources = f"{name.removesuffix('.warc.gz')}.wacz", f"{out_root}/.{uuid.uuid4().hex}", []

        def add(z, inside: str, blocks) -> None:
            digest, size = hashlib.sha256(), 0
            with z.open(inside, "w", force_zip64=True) as out:
                for block in blocks:
                    out.write(block)
                    digest.update(block)
                    size += len(block)
            resources.append({"name": inside.split("/")[-1], "path": inside, "hash": f"sha256:{digest.hexdigest()}", "bytes": size})

        with out_fs.open_output_stream(part, compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                add(z, f"archive/{name}", iter(lambda: f.read(1 << 20), b""))
            add(z, "indexes/index.cdxj", ((json.dumps(r) + "\n").encode() for r in rows))
            pages = ({"url": r["url"], "ts": r["date"]} for r in rows if "html" in (r["mime"] or ""))
            add(z, "pages/pages.jsonl", ((json.dumps(x) + "\n").encode() for x in itertools.chain([{"format": "json-pages-1.0", "id": "pages", "title": title}], pages)))
            z.writestr("datapackage.json", json.dumps({"profile": "data-package", "title": title, "wacz_version": "1.1.1", "resources": resources}))
        digest, size = hashlib.sha256(), 0
        with out_fs.open_input_stream(part, compression=None) as f:
            while block := f.read(1 << 20):
                digest.update(block)
                size += len(block)
        out_fs.move(part, f"{out_root}/{package}")
        return pa.table({"package": [package], "file": [name], "hash": [f"sha256:{digest.hexdigest()}"], "bytes": pa.array([size], pa.int64()), "n_records": pa.array([len(rows)], pa.int64())})

    made = checkpointed(cdx(spark, path).groupBy("file").applyInArrow(pack, _PACKED))
    from .documents import write_document

    one = F.to_json(F.struct(F.col("package").alias("name"), F.col("package").alias("path"), "hash", "bytes"))
    write_document(made, one, ["package"], f"{target}/datapackage", '{"profile":"multi-wacz-package","resources":[', "]}")
    return made


def read_packages(spark: SparkSession, target: str) -> DataFrame:
    """Index lines of all packages of a folder, each by its own task; a resource that isn't as packaged is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(target).select("path")  # contents aren't read here
    schema = "package string, url string, date string, mime string, status int, digest string, length long, offset long, file string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                fs, place = _fs(re.sub("^file:/+", "file:///", path))
                with fs.open_input_file(place) as raw, zipfile.ZipFile(raw) as z:
                    for r in json.loads(z.read("datapackage.json"))["resources"]:
                        digest, size = hashlib.sha256(), 0
                        with z.open(r["path"]) as f:
                            while block := f.read(1 << 20):
                                digest.update(block)
                                size += len(block)
                        if size != r["bytes"] or f"sha256:{digest.hexdigest()}" != r["hash"]:
                            raise ValueError(f"{path}: {r['path']} is not as packaged")
                    with z.open("indexes/index.cdxj") as f:
                        while lines := list(itertools.islice(f, 10_000)):
                            rows = [json.loads(x) for x in lines]
                            yield pd.DataFrame([{"package": path.rsplit("/", 1)[-1], **x} for x in rows], columns=names)

    return found.mapInPandas(run, schema)


def har_entry(url: Column, method: Column, status: Column, mime: Column, body: Column, at: Column) -> Column:
    """One HAR entry as JSON; the query string is taken apart in order."""
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    query = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("value")))
    request = F.struct(method.alias("method"), url.alias("url"), F.lit("HTTP/1.1").alias("httpVersion"), query.alias("queryString"))
    content = F.struct(F.octet_length(body).alias("size"), mime.alias("mimeType"), body.alias("text"))
    return F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startedDateTime"), request.alias("request"), F.struct(status.alias("status"), content.alias("content")).alias("response")))

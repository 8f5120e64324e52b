"""One JSON document by ranges of bytes, HAR, the validators' store, page export."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from webloom.functions import dom
from webloom.functions import html as H
from webloom.operators import dedupe, frontier
from webloom.sources import cache, documents


def test_one_json_object(spark, tmp_path):
    odd = {f"https://e.com/{i}": f"e.com/{i}" + ["", ' "q"', "\\", '\\"', "é\n\t", "{},:", "\\\\"][i % 7] * (i % 3) for i in range(3000)} | {"": "", '"': '\\"'}
    one = tmp_path / "one.json"
    one.write_text(json.dumps(odd, indent=2, ensure_ascii=False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spark.read.text(str(one)).rdd.getNumPartitions() > 10
        assert {r.url: r.path for r in documents.json_map(spark, str(one)).collect()} == odd
        out = str(tmp_path / "many")
        documents.write_json_map(spark.createDataFrame(list(odd.items()), "url string, path string").repartition(7), out)
        text = "".join(open(f"{out}/{n}", encoding="utf-8").read() for n in sorted(os.listdir(out)) if n.startswith("part-"))
        assert json.loads(text) == odd and len([n for n in os.listdir(out) if n.startswith("part-")]) > 1
        assert {r.url: r.path for r in documents.json_map(spark, out).collect()} == odd
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for text, want in (("{}", 0), ('{"a": "b"}', 1), ('{"a":1}', None), ('{"a": {"b": ["c"]}}', None)):
        (tmp_path / "x.json").write_text(text)
        if want is None:
            with pytest.raises(Exception, match="no flat object"):
                documents.json_map(spark, str(tmp_path / "x.json")).collect()
        else:
            assert documents.json_map(spark, str(tmp_path / "x.json")).count() == want
    documents.write_json_map(spark.createDataFrame([], "url string, path string"), str(tmp_path / "none"))
    assert documents.json_map(spark, str(tmp_path / "none")).count() == 0


def test_har_document(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1)
    rows = [(i, f"https://e.com/a{i}?x={i}&y=%C3%A9+b&z", "POST" if i % 2 else "GET", [200, 404, 299][i % 3], {"Content-Type": "text/html; charset=x", "Set-Cookie": "a=b"} if i % 4 else None, None if i == 5 else f'b"{i}"\n]}}', "p" if i % 2 else None, at) for i in range(50)]
    df = spark.createDataFrame(rows, "seq int, url string, method string, status int, headers map<string,string>, body string, request_body string, at timestamp").repartition(4)
    path = str(tmp_path / "har")
    documents.write_har(df, path, "2025-01-01T00:00:00Z")
    har = json.loads("".join(open(f"{path}/{n}", encoding="utf-8").read() for n in sorted(os.listdir(path)) if n.startswith("part-")))["log"]
    assert har["version"] == "1.2" and har["pages"][0]["id"] == "page_1" and [e["request"]["url"] for e in har["entries"]] == [r[1] for r in rows]
    e = har["entries"][1]
    assert e["request"]["headersSize"] == len("Content-Type") + len("text/html; charset=x") + 4 + len("Set-Cookie") + 3 + 4 == e["response"]["headersSize"]
    assert e["request"]["queryString"] == [{"name": "x", "value": "1"}, {"name": "y", "value": "é b"}, {"name": "z", "value": ""}] and e["request"]["cookies"] == [{"name": "Set-Cookie", "value": "a=b"}]
    assert e["request"]["postData"]["text"] == "p" and "postData" not in har["entries"][2]["request"] and e["cache"] == {}
    assert (e["response"]["statusText"], e["response"]["content"]["mimeType"], e["response"]["content"]["text"]) == ("Not Found", "text/html", 'b"1"\n]}')
    assert har["entries"][4]["response"]["content"]["mimeType"] == "application/octet-stream" and har["entries"][2]["response"]["statusText"] == "Unknown"
    back = documents.read_har(spark, path)
    assert back.count() == 50 and {r.u for r in back.select(F.col("request.url").alias("u")).collect()} == {r[1] for r in rows}


def test_cache_store(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    store = cache.CacheStore(spark, path, 16)
    t = lambda n: datetime.datetime(2025, 1, 1, 0, n)
    schema = "url string, status int, etag string, last_modified string, at timestamp, seq long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    many = [(f"https://e.com/{i}", 200, f"e{i}", None, t(0), i) for i in range(200)]
    touched = store.merge(rows(*many, ("https://e.com/plain", 200, "", None, t(0), 900), (None, 304, "x", "y", t(0), 901)))
    assert len(touched) == 16 and store.read().count() == 200
    before = {b: f for b, f in store.folders().items()}
    stamp = {f: os.listdir(f"{tmp_path}/cache/{f}") for f in before.values()}
    again = cache.CacheStore(spark, path)
    assert again.buckets == 16
    touched = again.merge(rows(("https://e.com/7", 304, None, "", t(5), 1), ("https://e.com/7", 200, None, "m1", t(6), 2), ("https://e.com/7", 0, "e7b", "", t(7), 3)))
    assert len(touched) == 1
    after = again.folders()
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    assert all(os.listdir(f"{tmp_path}/cache/{f}") == names for f, names in stamp.items())
    assert {r.url: tuple(r)[1:] for r in again.read().where("url = 'https://e.com/7' or url = 'https://e.com/8'").collect()} == {"https://e.com/7": ("e7b", "m1", 200, t(7)), "https://e.com/8": ("e8", None, 200, t(0))}
    assert again.read().count() == 200 and again.merge(rows().limit(0)) == []
    os.remove(f"{tmp_path}/cache/pointers/000000000002")  # a merge that died before its pointer leaves the version before
    assert {r.etag for r in cache.CacheStore(spark, path).read().where("url = 'https://e.com/7'").collect()} == {"e7"}


def test_page_export(spark, tmp_path):
    pages = spark.createDataFrame([("https://e.com/a/", "e.com/a/index.html"), ("https://e.com/a/page/2", "e.com/a/page/2/index.html"), ("https://e.com/a?utm_source=x", "e.com/a_x/index.html"), ("https://e.com/b", "e.com/b/index.html"), ("https://e.com/wp-json/x", "e.com/wp-json/x/index.html")], "url string, path string")
    got = dedupe.export_pages(pages, str(tmp_path / "out"))
    assert got == {"pages_total": 5, "noise_dropped": 1, "pages_kept": 2, "pages_collapsed": 3}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "manifest")).collect()} == {("e.com/a/index.html", "e.com/a/page/2/index.html"), ("e.com/a/index.html", "e.com/a_x/index.html")}
    assert {r.kept for r in spark.read.parquet(str(tmp_path / "out" / "kept")).collect()} == {"e.com/a/index.html", "e.com/b/index.html"}
    assert dedupe.export_pages(pages.limit(0), str(tmp_path / "none")) == {"pages_total": 0, "noise_dropped": 0, "pages_kept": 0, "pages_collapsed": 0}


def test_admission_caps(spark):
    items = spark.createDataFrame([(f"https://e.com/{i % 20}", i % 3, i) for i in range(60)], "url string, depth int, seq long")
    seen = items.where("seq < 3").select("url")
    got = frontier.admitted(items, seen, total=95, most_total=100, size=1, most_size=10).collect()
    first = {}
    for i in range(60):
        if i % 20 > 2:
            first[i % 20] = min(first.get(i % 20, (9, 0)), (i % 3, i))
    assert sorted((r.depth, r.seq) for r in got) == sorted(first.values())[:5]
    assert frontier.admitted(items, seen, total=100, most_total=100).count() == 0 and frontier.admitted(items, seen, size=100_000, most_size=100_000).count() == 0


def test_census_and_signs(spark):
    html = '<a href=/x class="btn accordion-header">x</a><a href=javascript:y>y</a><details><p><summary>no child</summary></p></details><input type=Submit>'
    assert {x["kind"]: x["n"] for x in dom.census(html)} == {dom.SELECTORS[1]: 1, dom.SELECTORS[3]: 1, ".btn:not([disabled])": 1, "summary": 1, ".accordion-header": 1}
    page = F.lit("""<a href="/k">k</a><script>history.pushState({a: {}}, "", "/yes"); history.pushState(null,'','/k'); history.pushState({}, "a,b", "x?y#z")</script>""")
    got = spark.range(1).select(H.routes_to_crawl(F.lit("https://e.com/p/q"), page, H.pushed_routes(page))).first()[0]
    assert got == ["https://e.com/yes", "https://e.com/p/x?y#z"]

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import urls as U


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def check(spark, f, cases):
    assert apply(spark, f, [a for a, _ in cases]) == [b for _, b in cases]


def test_normalize_url(spark):
    check(spark, U.normalize_url, [
        ("HTTP://Example.COM/path", "http://example.com/path"),
        ("http://example.com:80/a", "http://example.com/a"),
        ("https://example.com:443/a", "https://example.com/a"),
        ("https://example.com:8443/a", "https://example.com:8443/a"),
        ("https://example.com/a/./b/../c", "https://example.com/a/c"),
        ("https://example.com//a//b/", "https://example.com/a/b"),
        ("https://example.com/?b=2&a=1", "https://example.com/?a=1&b=2"),
        ("https://example.com/?utm_source=x&a=1", "https://example.com/?a=1"),
        ("https://example.com/a#frag", "https://example.com/a"),
        ("https://user:pw@example.com/a", "https://example.com/a"),
        ("https://example.com/%7Euser", "https://example.com/~user"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com/../a", "https://example.com/a"),
        ("https://example.com/?a=1;b=2", "https://example.com/?a=1;b=2"),
        ("ftp://example.com/a", "ftp://example.com/a"),
        ("", ""),
        ("not a url", "not a url"),
    ])


def test_fragments_that_route(spark):
    check(spark, U.normalize_and_clean, [("https://e.com/a#/r", "https://e.com/a#/r"), ("https://e.com/a#!/r", "https://e.com/a#!/r"), ("https://e.com/a#x", "https://e.com/a")])


def test_canonical_key(spark):
    check(spark, U.canonical_key, [
        ("https://e.com/blog/page/3", "https://e.com/blog"),
        ("https://e.com/blog/comment-page-2/", "https://e.com/blog"),
        ("https://e.com/news/2026/05/12/slug", "https://e.com/news/2026/05/12/slug"),
        ("https://e.com/a?utm_source=x&orderby=d", "https://e.com/a?orderby=d"),
        ("https://e.com/a/?paged=2", "https://e.com/a"),
    ])
    assert apply(spark, lambda u: U.canonical_key(u, ["paged"], ["page"]), ["https://e.com/page/2?paged=3"]) == ["https://e.com/page/2?paged=3"]


def test_noise_and_kinds(spark):
    check(spark, U.is_noise_path, [("https://e.com/cart/x", True), ("https://e.com/cartoon", True), ("https://e.com/a/cart", False)])
    check(spark, U.is_html_page_url, [("https://e.com/", True), ("https://e.com/a.PHP", True), ("https://e.com/a.css", False), ("https://e.com/v1.2/a", True)])
    check(spark, U.is_protocol_relative, [("cdn.example.com/x", True), ("theme.css", True), ("/a.b", False), ("a b.c", False), ("nodot", False)])


def test_paths(spark):
    check(spark, U.path_for_url, [
        ("https://e.com", "e.com/index.html"),
        ("https://e.com/a/", "e.com/a/index.html"),
        ("https://e.com/a", "e.com/a/index.html"),
        ("https://e.com/a.css?v=1/2", "e.com/a_v=1_2.css"),
        ("https://e.com/../../etc/passwd", "e.com/_safe_path"),
    ])
    check(spark, U.path_for_api, [("https://e.com/api/x", "api/x.json"), ("https://e.com/", ""), ("https://e.com/a.json", "a.json")])


@pytest.mark.parametrize(
    "pattern,url,hit",
    [
        ("*.js", "a.js", True),
        ("https://a/**", "https://a/b/c", True),
        ("/x/*", "https://a/x/y", True),
        ("/x/*", "https://a/x/y/z", False),
        ("https://a/[!b]", "https://a/c", True),
        ("https://a/[!b]", "https://a/b", False),
        ("https://a/?", "https://a/b", True),
    ],
)
def test_glob(spark, pattern, url, hit):
    assert apply(spark, lambda u: U.glob_match(pattern, u), [url]) == [hit]


def test_resolve(spark):
    base = F.lit("https://e.com/a/b?q=1#f")
    check(spark, lambda r: U.resolve(base, r), [
        ("c", "https://e.com/a/c"), ("/c", "https://e.com/c"), ("../c", "https://e.com/c"), ("?x", "https://e.com/a/b?x"),
        ("#y", "https://e.com/a/b?q=1#y"), ("//h/p", "https://h/p"), ("mailto:a@b", "mailto:a@b"), ("https://z/", "https://z/"),
    ])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"\Ahttps?://[a-z]{1,5}\.com(/[a-z.]{0,6}){0,4}(\?[a-z]=[a-z0-9]{0,3}(&[a-z]=[0-9]){0,2})?\Z"), min_size=5, max_size=30))
def test_normal_form_is_stable(spark, urls):
    once = apply(spark, U.normalize_url, urls)
    assert apply(spark, U.normalize_url, once) == once
    key = apply(spark, U.canonical_key, urls)
    assert apply(spark, U.canonical_key, key) == key


def test_masks(spark):
    check(spark, U.mask_url, [("https://u:p@e.com/secret?x", "https://e.com/***MASKED***"), ("abc", "***MASKED***"), ("", "")])
    check(spark, U.mask_password, [("postgres://u:pw@h/db", "postgres://u:***@h/db")])

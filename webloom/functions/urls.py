"""URL functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

#: scheme, authority, path, query, fragment
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests) if tests else F.lit(False)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def parts(url: Column) -> Column:
    """Array of scheme, authority, path, query and fragment (empty strings where the url has none), by one pass over the url."""
    cut = F.split(F.regexp_replace(url, PARTS, "$1\0$2\0$3\0$4\0$5"), "\0", -1)
    slow = F.array(*[part(url, n) for n in range(1, 6)])
    return let(cut, lambda c: F.when((F.size(c) == 5) & ~url.rlike("[\\n\\r\\x00\\u0085\\u2028\\u2029]"), c).otherwise(slow))


def _host_of(authority: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$", "")


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    """Host and port without user information, lower case."""
    return F.lower(F.regexp_replace(part(url, 2), r"^.*@", ""))


def host(url: Column) -> Column:
    """Host name without port, as written in lower case; empty where there is none."""
    return F.regexp_replace(authority(url), r":[0-9]*$", "")


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def fragment(url: Column) -> Column:
    return part(url, 5)


def is_valid_url(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_tracking_param(key: Column) -> Column:
    k = F.lower(key)
    return k.isin(*T.TRACKING_KEYS) | any_of([k.startswith(p) for p in T.TRACKING_PREFIXES])


def normalize_path(p: Column) -> Column:
    """Percent-decoded, without ``.`` and empty segments, ``..`` resolved (never above the root), no ending slash."""
    decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(F.split(decoded, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def sort_query(q: Column) -> Column:
    """Parameters by key (values of a key keep their order) without tracking keys; a query that can't be parsed stays."""
    broken = q.contains(";") | q.rlike("%(?![0-9A-Fa-f]{2})")
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    key = lambda p: F.try_url_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.try_url_decode(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit("")))
    rows = F.transform(pairs, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), value(p).alias("v")))
    rows = F.array_sort(F.filter(rows, lambda r: ~is_tracking_param(r["k"])))
    text = F.array_join(F.transform(rows, lambda r: F.concat(F.url_encode(r["k"]), F.lit("="), F.url_encode(r["v"]))), "&")
    return F.when(broken, q).otherwise(text)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, user or fragment, path and query in normal form; others stay as they are."""

    def text(p: Column) -> Column:
        kind, q = F.lower(F.get(p, 0)), F.get(p, 3)
        asked = F.when(q == "", "").otherwise(let(sort_query(q), lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise("")))

        def full(name: Column) -> Column:
            port = F.regexp_extract(name, r":([0-9]+)$", 1)
            plain = port.isin("") | ((kind == "http") & (port == "80")) | ((kind == "https") & (port == "443"))
            bare = F.regexp_replace(name, r":[0-9]*$", "")
            shown = F.when(plain, bare).otherwise(F.concat(bare, F.lit(":"), port))
            out = F.concat(kind, F.lit("://"), shown, normalize_path(F.get(p, 2)), asked)
            return F.when(kind.isin("http", "https") & (bare != ""), out).otherwise(url)

        return let(F.lower(F.regexp_replace(F.get(p, 1), r"^.*@", "")), full)

    return let(parts(url), text)


def normalize_and_clean(url: Column) -> Column:
    """``normalize_url``, but a fragment that routes (``/`` or ``!/``) stays."""
    f = fragment(url)
    return let(normalize_url(url), lambda n: F.when(f.rlike("^!?/"), F.concat(n, F.lit("#"), f)).otherwise(n))


def resolve(base: Column, ref: Column) -> Column:
    """RFC 3986 resolution of absolute, ``//``, ``/``, ``?``, ``#`` and relative references."""
    return let(parts(base), lambda p: resolve_parts(base, p, ref))


def resolve_parts(base: Column, p: Column, ref: Column) -> Column:
    """``resolve``, with the base's parts at hand."""
    root = F.concat(F.get(p, 0), F.lit("://"), F.get(p, 1))
    folder = F.regexp_replace(F.when(F.get(p, 2) == "", "/").otherwise(F.get(p, 2)), "[^/]*$", "")
    tail = F.regexp_extract(ref, r"[?#].*$", 0)
    bare = F.regexp_replace(ref, r"[?#].*$", "")
    merged = F.when(ref.startswith("/"), bare).otherwise(F.concat(folder, bare))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.get(p, 0), F.lit(":"), ref))
        .when(ref.startswith("?"), F.concat(root, F.get(p, 2), ref))
        .when(ref.startswith("#") | (ref == ""), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .otherwise(F.concat(root, let(merged, _dots), tail))
    )


def _dots(p: Column) -> Column:
    """``.`` and ``..`` segments resolved; an ending slash stays."""
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))


def is_protocol_relative(ref: Column) -> Column:
    """A domain-like reference without a scheme."""
    r = F.trim(ref)
    return ~r.rlike(r"^(?:https?://|/|\./|\.\./|#|javascript:|mailto:|tel:|data:|blob:)") & ~r.contains(" ") & r.rlike(r"^[A-Za-z0-9:-]*\.[A-Za-z0-9.:-]*(?:[/?#].*)?$")


def is_html_page_url(url: Column) -> Column:
    last = F.regexp_extract(F.regexp_replace(path(url), "/$", ""), "([^/]*)$", 1)
    return ~last.contains(".") | F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1)).isin(*T.PAGE_SUFFIXES)


def is_allowed_domain(url: Column, domains: list[str]) -> Column:
    """Host is one of the domains or below one; no domains allow all."""
    return any_of([(host(url) == d) | host(url).endswith("." + d) for d in domains]) if domains else F.lit(True)


def is_excluded(url: Column, parts: list[str]) -> Column:
    return any_of([url.contains(p) for p in parts])


def glob_regex(pattern: str) -> str:
    """``**`` any text, ``*`` any but a slash, ``?`` one but a slash, ``[!x]`` and ``[^x]`` negated classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + re.escape(inner[1:]) if inner[:1] in ("!", "^") else re.escape(inner)).replace("\\-", "-") + "]"
            i = end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(pattern: str, url: Column) -> Column:
    """A pattern that begins with a slash sees the path, any other the whole url."""
    return (path(url) if pattern.startswith("/") else url).rlike(glob_regex(pattern))


def is_drop_segment(s: Column, prev: Column, keep: list[str] = ()) -> Column:
    low, before = F.lower(F.trim(s)), F.lower(F.trim(prev))
    marker = r"^(?:page|paged|comment-page)(?:[-_].*)?$"
    kept = low.isin(*keep) | before.isin(*keep) if keep else F.lit(False)
    return (low != "") & ~kept & (low.rlike(marker) | (low.rlike(r"^[+-]?[0-9]+$") & before.rlike(marker)))


def strip_drop_query(q: Column, keep: list[str] = ()) -> Column:
    key = lambda p: F.lower(F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.lit("")))
    kept = lambda k: k.isin(*keep) if keep else F.lit(False)
    return F.array_join(F.filter(F.split(q, "&"), lambda p: let(key(p), lambda k: kept(k) | ~(k.isin(*T.DROP_KEYS) | k.startswith("utm_")))), "&")


def canonical_key(url: Column, keep_query: list[str] = (), keep_segments: list[str] = ()) -> Column:
    """Without noise parameters, pagination segments and an ending slash; order, case and fragment stay."""
    return let(parts(url), lambda p: key_of_parts(url, p, keep_query, keep_segments))


def key_of_parts(url: Column, p: Column, keep_query: list[str] = (), keep_segments: list[str] = ()) -> Column:
    """``canonical_key``, with the url's parts at hand."""

    def kept(segs: Column) -> Column:
        drop = lambda s, i: is_drop_segment(s, F.when(i > 0, F.get(segs, i - 1)).otherwise(""), keep_segments)
        marked = F.transform(segs, lambda s, i: F.when(~drop(s, i), s))
        return F.array_join(F.filter(marked, lambda s: s.isNotNull()), "/")

    segs = let(F.split(F.regexp_replace(F.get(p, 2), "^/+|/+$", ""), "/"), kept)
    q = F.when(F.get(p, 3) == "", "").otherwise(strip_drop_query(F.get(p, 3), keep_query))
    asked = let(q, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise(""))
    text = F.concat(F.get(p, 0), F.lit("://"), F.get(p, 1), F.lit("/"), segs, asked, F.when(F.get(p, 4) != "", F.concat(F.lit("#"), F.get(p, 4))).otherwise(""))
    return F.when(F.get(p, 0) != "", text).otherwise(url)


def is_noise_path(url: Column) -> Column:
    return any_of([F.lower(path(url)).startswith(p) for p in T.NOISE_PREFIXES])


def noise_of_parts(p: Column) -> Column:
    """``is_noise_path``, with the url's parts at hand."""
    return let(F.lower(F.get(p, 2)), lambda x: any_of([x.startswith(n) for n in T.NOISE_PREFIXES]))


def weight_of_parts(p: Column) -> Column:
    """``clean_weight``, with the url's parts at hand."""
    paged = F.get(p, 2).contains("/page/") | F.get(p, 2).contains("/comment-page")
    return F.when(F.get(p, 3) != "", 10).otherwise(0) + F.when(paged, 5).otherwise(0)


def clean_weight(url: Column) -> Column:
    p = path(url)
    return F.when(query(url) != "", 10).otherwise(0) + F.when(p.contains("/page/") | p.contains("/comment-page"), 5).otherwise(0)


def is_resume_noise(url: Column) -> Column:
    return any_of([url.contains(x) for x in T.RESUME_RAW]) | any_of([F.lower(path(url)).contains(x) for x in T.RESUME_PATHS])


def directory_aliases(url: Column) -> Column:
    """The url, and for ``…/index.html`` its folder with and without the slash."""
    base = F.regexp_replace(url, "index\\.html$", "")
    return F.when(url.endswith("/index.html"), F.array(url, base, F.regexp_replace(base, "/$", ""))).otherwise(F.array(url))


def path_for_url(url: Column) -> Column:
    """Path of a url's file below the output folder, safe against traversal."""
    return let(parts(url), path_of_parts)


def path_of_parts(p: Column) -> Column:
    """``path_for_url``, with the url's parts at hand."""
    path, asked = F.get(p, 2), F.get(p, 3)
    raw = F.when(path.isin("", "/"), "/index.html").otherwise(path)
    decoded = let(raw, lambda r: F.coalesce(F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))), r))
    named = let(decoded, lambda d: F.regexp_replace(F.when(d.endswith("/"), F.concat(d, F.lit("index.html"))).otherwise(d), "^/", ""))
    full = let(named, lambda n: F.when(F.substring_index(n, "/", -1).contains("."), n).otherwise(F.concat(n, F.lit("/index.html"))))

    def with_query(f: Column) -> Column:
        safe = F.when(f.contains(".."), "_safe_path").otherwise(f)
        suffix = F.regexp_extract(f, r"(\.[^./]*)$", 1)
        stem = lambda x: F.concat(F.substring(f, F.lit(1), F.length(f) - F.length(x)), F.lit("_"), F.translate(asked, "/\\:?&", "_____"), x)
        renamed = F.when(f.contains(".."), F.concat(F.lit("_safe_path_"), F.translate(asked, "/\\:?&", "_____"))).otherwise(let(suffix, stem))
        return F.when(asked == "", safe).otherwise(renamed)

    return F.concat(let(_host_of(F.get(p, 1)), lambda h: F.when(h == "", "_unknown").otherwise(h)), F.lit("/"), let(full, with_query))


def path_for_api(url: Column) -> Column:
    """Path of an API response's file (the host is no part of it); empty where there is none."""
    p = F.regexp_replace(path(url), "^/", "")
    bare = p.endswith("/") | ~p.rlike(r"\.[^./]*$")
    return F.when((p == "") | p.contains(".."), "").otherwise(F.concat(F.regexp_replace(p, "/$", ""), F.when(bare, ".json").otherwise("")))


def url_from_local_path(p: Column) -> Column:
    """``https://host/rest`` of a stored file's relative path."""
    return F.concat(F.lit("https://"), F.replace(p, F.lit(" "), F.lit("%20")))


def rel_path(base: Column, target: Column) -> Column:
    """Relative path from folder ``base`` to ``target``."""
    b, t = F.filter(F.split(base, "/"), lambda s: s != ""), F.split(target, "/")
    same = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(F.size(b), F.size(t) - 1) - 1, F.lit(0))), F.lit(0), lambda n, i: F.when((n == i) & (F.get(b, i) == F.get(t, i)), n + 1).otherwise(n))
    ups = F.repeat(F.lit("../"), F.size(b) - same)
    return F.concat(ups, F.array_join(F.slice(t, same + 1, F.size(t)), "/"))


def extension_for_mime(mime: Column) -> Column:
    out = F
    for has, suffix in T.MIME_SUFFIXES:
        out = out.when(mime.contains(has), suffix)
    return out.otherwise("")


def asset_path(url: Column, mime: Column) -> Column:
    p = F.when(path(url) == "", "/index").otherwise(path(url))
    return F.concat(host(url), p)


def base_mime(mime: Column) -> Column:
    return F.trim(F.substring_index(mime, ";", 1))


def is_json_content(mime: Column) -> Column:
    return base_mime(mime).isin(*T.JSON_MIMES)


def is_api_content(url: Column, mime: Column) -> Column:
    low = F.lower(path(url))
    return any_of([base_mime(mime).contains(x) for x in T.API_MIME_PARTS]) | any_of([low.contains(x) for x in T.API_PATH_PARTS])


def mask_url(url: Column) -> Column:
    """Scheme and host, the rest masked; what is no url is masked as a whole."""
    return F.when(url == "", "").when(host(url) != "", F.concat(part(url, 1), F.lit("://"), host(url), F.lit("/***MASKED***"))).otherwise("***MASKED***")


def mask_password(dsn: Column) -> Column:
    return F.regexp_replace(dsn, r"(://[^:/@]+):[^@]+@", "$1:***@")

"""Extraction from HTML, CSS and scripts as Column expressions (possessive patterns, so long inputs are safe)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from . import urls as U

#: ASCII white space as RE2 counts it.
WS = r"[ \t\n\f\r]"


def without(html: Column, *patterns: str) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p, ""), patterns, html)


COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return without(html, COMMENT, SCRIPT, STYLE)


def text_content(html: Column) -> Column:
    """Text outside tags, white space collapsed, the five basic entities decoded."""
    t = unescaped(F.regexp_replace(visible(html), "<[^>]*>", " "))
    return F.trim(F.regexp_replace(t, WS + "+", " "))


#: A start tag with its attributes; a quote counts only where a value begins, so values may hold any other sign.
ATTRIBUTE = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
TAG = rf"<[a-zA-Z][^\s/>]*+(?:[\s/=]++|{ATTRIBUTE})*+>"
#: Comments, and elements whose content is no markup (their start tag is the first group).
NO_MARKUP = r"""(?is)<!--.*?(?:-->|\z)|(<(script|style|textarea|title|iframe|noembed|noframes|xmp)\b(?:[^>"']|"[^"]*+"|'[^']*+')*+>).*?(?=</\2\b|\z)"""
#: Attributes that hold lists of urls.
SETS = ("srcset", "data-srcset")


def tags(html: Column) -> Column:
    """All start tags of a page, as they are written; not those in comments, scripts and other raw text."""
    return F.regexp_extract_all(F.regexp_replace(html, NO_MARKUP, "$1"), F.lit(TAG), F.lit(0))


def unescaped(value: Column) -> Column:
    """The five basic entities decoded."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def attributes(found: Column, names: list[str], but: str = "") -> Column:
    """(name, value) of every attribute of these names (expressions) in tags, in order, quoted or not; ``but``: tags to pass over."""
    wanted = "(?i)^(?:" + "|".join(names) + r")\s*+="
    if but:
        found = F.filter(found, lambda t: ~t.rlike(rf"(?i)^<(?:{but})[\s/>]"))
    one = lambda a: F.struct(
        F.lower(F.regexp_extract(a, r"^[^\s=]*+", 0)).alias("name"),
        unescaped(F.regexp_extract(a, r"""(?s)^[^=]*+=\s*+(["']?+)(.*?)\1\z""", 2)).alias("value"),
    )
    return F.flatten(F.transform(found, lambda t: F.transform(F.filter(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(wanted)), one)))


def set_urls(value: Column) -> Column:
    """Urls of a ``srcset``."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.substring_index(F.trim(F.regexp_replace(x, WS, " ")), " ", 1)), lambda u: u != "")


def links(base: Column, html: Column) -> Column:
    """Resolved urls of url attributes (every one of a tag, sets of sources too): no fragments, scripts or mail, the page's own host or none."""
    found = attributes(tags(html), [*T.URL_ATTRS, *T.DATA_URL_ATTRS, "srcset"], but="script|style")
    plain = lambda v: F.when((v != "") & ~v.rlike("^(?:#|javascript:|mailto:)"), F.array(v)).otherwise(F.array().cast("array<string>"))
    refs = F.flatten(F.transform(found, lambda a: F.when(a["name"].isin(*SETS), set_urls(a["value"])).otherwise(plain(a["value"]))))

    def own(b: Column) -> Column:
        full = F.transform(refs, lambda r: U.resolve_parts(base, b, r))
        host = U._host_of(F.get(b, 1))
        return U.let(host, lambda h: F.filter(full, lambda u: (U.host(u) == h) | (U.part(u, 1) == "")))

    return U.let(U.parts(base), own)


def routes(base: Column, html: Column, most: int = 50) -> Column:
    """The first ``most`` distinct site links of a page, in the order of the page."""
    return F.slice(F.array_distinct(links(base, html)), 1, most)


def skeleton(html: Column) -> Column:
    """Whether a page shows signs of loading: classes that name loaders, spinners, skeletons, placeholders or shimmer."""
    classes = F.transform(attributes(tags(html), ["class"]), lambda a: a["value"])
    return F.exists(classes, lambda c: c.rlike("loading|spinner|skeleton|placeholder|shimmer") | F.array_contains(F.split(c, WS + "+"), "loader"))


def pushed_routes(html: Column) -> Column:
    """Addresses that a page's scripts push into (or replace in) the history, as they are written."""
    return F.regexp_extract_all(html, F.lit(r"""history\.(?:pushState|replaceState)\(\s*+(?:[^,()]*+|\{[^{}]*+\}),\s*+(?:"[^"]*+"|'[^']*+'|[^,()]*+),\s*+["']([^"']*+)["']\s*+\)"""), F.lit(1))


def routes_to_crawl(base: Column, html: Column, pushed: Column, most: int = 50) -> Column:
    """The first ``most`` distinct pushed addresses of a page, resolved, that none of its links names."""
    known = links(base, html)

    def new(k: Column) -> Column:
        full = U.let(U.parts(base), lambda b: F.transform(F.filter(pushed, lambda r: r != ""), lambda r: U.resolve_parts(base, b, r)))
        return F.slice(F.array_except(F.array_distinct(full), k), 1, most)

    return U.let(known, new)


def title(html: Column) -> Column:
    """``<title>``, else the first ``<h1>``, else ``Untitled``."""
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    h = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    return F.when(t != "", t).when(h != "", h).otherwise("Untitled")


def framework(html: Column) -> Column:
    """Front-end framework; of several signs the last of next, nuxt, angular, react, vue, svelte counts."""
    return (
        F.when(html.rlike(r"class=[\"'][^\"']*svelte-"), "svelte")
        .when(html.rlike(r"\sdata-v-[\s=>]|__VUE__"), "vue")
        .when(html.rlike(r"data-reactroot|id=[\"']__next[\"']"), "react")
        .when(html.rlike("ng-version"), "angular")
        .when(html.contains("__NUXT__"), "nuxt")
        .when(html.contains("__NEXT_DATA__"), "nextjs")
        .otherwise("unknown")
    )


def challenge(html: Column) -> Column:
    """Kind of challenge widget in stored markup; the first sign counts."""
    return (
        F.when(html.rlike(r"class=[\"'][^\"']*g-recaptcha|recaptcha/api"), "recaptcha")
        .when(html.rlike(r"class=[\"'][^\"']*h-captcha|hcaptcha\.com"), "hcaptcha")
        .when(html.rlike(r"class=[\"'][^\"']*cf-turnstile|challenges\.cloudflare\.com"), "turnstile")
        .when(html.rlike(r"\sdata-sitekey="), "generic")
    )


def css_urls(css: Column) -> Column:
    """Distinct ``url()`` references but for data urls, quotes taken off; a sign behind a backslash belongs to the url."""
    found = F.regexp_extract_all(css, F.lit(r"""(?i)url\(\s*+["']?+((?:\\.|[^"')])++)["']?+\s*+\)"""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.trim(u)), lambda u: ~u.startswith("data:") & (u != "")))


def font_urls(css: Column) -> Column:
    """Distinct urls of ``src`` in ``@font-face`` blocks."""
    faces = F.regexp_extract_all(css, F.lit(r"(?is)@font-face\s*\{([^}]*)\}"), F.lit(1))
    sources = F.flatten(F.transform(faces, lambda f: F.regexp_extract_all(f, F.lit(r"(?i)src\s*:\s*([^;]+)"), F.lit(1))))
    return css_urls(F.array_join(sources, ";"))


def js_urls(js: Column) -> Column:
    """(type, ref) of references in scripts, by kind of expression."""
    return F.concat(*[F.transform(F.regexp_extract_all(js, F.lit(p), F.lit(1)), _typed(kind)) for kind, p in T.JS_PATTERNS])


def _typed(kind: str):
    return lambda r: F.struct(F.lit(kind).alias("type"), r.alias("ref"))


def js_imports(js: Column) -> Column:
    """Distinct references of a script that lead to scripts."""
    refs = F.transform(js_urls(js), lambda x: x["ref"])
    return F.array_distinct(F.filter(refs, lambda r: r.rlike(r"(?i)\.m?js(?:[?#].*)?$")))


def css_imports(css: Column) -> Column:
    """Distinct style sheets that a sheet imports, plain or by ``url()``."""
    found = F.regexp_extract_all(css, F.lit(r"""(?i)@import\s+(?:url\(\s*)?["']?([^"')\s;]+)"""), F.lit(1))
    return F.array_distinct(found)


def module_urls(html: Column) -> Column:
    """(type, ref) of import map values and module scripts."""
    maps = F.regexp_extract_all(html, F.lit(T.IMPORT_MAP), F.lit(1))
    values = F.flatten(F.transform(maps, lambda m: F.regexp_extract_all(m, F.lit(T.IMPORT_ENTRY), F.lit(1))))
    modules = F.regexp_extract_all(html, F.lit(T.MODULE_SCRIPT), F.lit(1))
    return F.concat(F.transform(values, _typed("importmap")), F.transform(modules, _typed("module-script")))


def sitemap_locs(xml: Column) -> Column:
    """``<loc>`` values of site maps and their indexes, nothing of other documents."""
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.when(xml.rlike("(?i)<(?:\\w+:)?(?:urlset|sitemapindex)"), locs).otherwise(F.array().cast("array<string>"))


def iframe_sources(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<iframe\b[^>]*>"), F.lit(0))
    one = lambda t, a: F.regexp_extract(t, rf"(?i)\s{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.when(one(t, "src") != "", one(t, "src")).when(one(t, "data-src") != "", one(t, "data-src")).otherwise(one(t, "data-lazy-src"))), lambda s: s != ""))


def meta_pairs(html: Column) -> Column:
    """(name, content) of meta tags, name or property first."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    one = lambda t, a: F.regexp_extract(t, rf"(?i)\s(?:{a})\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.filter(F.transform(tags, lambda t: F.struct(one(t, "property|name").alias("name"), one(t, "content").alias("content"))), lambda m: m["name"] != "")


def graphql_operation(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.operationName"), F.lit(""))


#: Names of further attributes that lead to files, as an expression.
DATA_ATTRS = r"data-[^\s/>=]*?(?:src|url|bg|image|lazy)[^\s/>=]*+"
NO_FILE = "^(?:#|javascript:|mailto:|tel:|data:)"


def asset_urls(page: Column, html: Column, relative: bool = False, css_relative: bool = True, styles: bool = True) -> Column:
    """Distinct urls of a page's assets, sorted.

    Sources, posters, srcsets, lazy ``data-`` attributes and preview images; ``href`` and
    ``action`` only where they lead to no page; ``url()`` of style attributes and sheets.
    ``relative`` resolves relative references of attributes, ``css_relative`` those of styles;
    otherwise only absolute ones count.  Without ``styles`` only attributes are looked at.
    """
    found = attributes(tags(html), ["src", "poster", "data", "srcset", "href", "action", "style", DATA_ATTRS])

    def of(base: Column) -> Column:
        full = lambda r: U.resolve_parts(page, base, F.trim(r))
        refs = lambda keep: F.filter(F.filter(found, keep), lambda a: (a["value"] != "") & ~a["value"].rlike(NO_FILE))
        sets = F.flatten(F.transform(refs(lambda a: a["name"].isin(*SETS)), lambda a: set_urls(a["value"])))
        plain = F.transform(refs(lambda a: ~a["name"].isin(*SETS, "href", "action", "style")), lambda a: a["value"])
        hrefs = F.transform(refs(lambda a: a["name"].isin("href", "action")), lambda a: a["value"])
        hrefs = F.filter(hrefs, lambda r: ~U.is_html_page_url(full(r)))
        got = F.concat(plain, sets, hrefs)
        if relative:
            got = F.transform(got, full)
        if styles:
            metas = F.transform(F.filter(meta_pairs(without(html, COMMENT)), lambda m: F.lower(m["name"]).isin("og:image", "twitter:image")), lambda m: unescaped(m["content"]))
            sheets = F.regexp_extract_all(without(html, COMMENT), F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1))
            css = css_urls(F.array_join(F.concat(sheets, F.transform(refs(lambda a: a["name"] == "style"), lambda a: a["value"])), " "))
            css = F.transform(css, lambda u: F.regexp_replace(u, r"\\(.)", "$1"))
            got = F.concat(got, metas, F.transform(css, full) if css_relative else css)
        return F.array_sort(F.array_distinct(F.filter(got, lambda u: u.rlike("^https?://"))))

    return U.let(U.parts(page), of)


def url_refs(page: Column, content: Column) -> Column:
    """Distinct absolute urls of ``url()``, of reference attributes and sets of sources, resolved against the page, sorted."""
    found = attributes(tags(content), ["href", "src", "action", "poster", "data", "srcset", DATA_ATTRS])
    refs = F.concat(css_urls(content), F.flatten(F.transform(found, lambda a: F.when(a["name"] == "srcset", set_urls(a["value"])).otherwise(F.array(a["value"])))))
    refs = F.filter(F.transform(refs, lambda r: F.trim(r)), lambda r: (r != "") & ~r.rlike("^(?:#|data:|javascript:|mailto:|tel:|blob:)"))
    return U.let(U.parts(page), lambda b: F.array_sort(F.array_distinct(F.filter(F.transform(refs, lambda r: U.resolve_parts(page, b, r)), lambda u: U.is_valid_url(u)))))


def shadow_roots(html: Column) -> Column:
    """Content of declarative shadow roots (the form in which stored pages hold them)."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<template\b[^>]*\sshadowrootmode=[^>]*>(.*?)</template>"), F.lit(1))


def json_of(html: Column, element_id: str) -> Column:
    """JSON text of a script element; null if it can't be parsed."""
    text = F.regexp_extract(html, rf"(?s)<script[^>]*\sid=[\"']{element_id}[\"'][^>]*>(.*?)</script>", 1)
    return F.to_json(F.try_parse_json(F.nullif(F.trim(text), F.lit(""))))


def json_ld(html: Column) -> Column:
    """JSON-LD blocks of a page that can be parsed, as JSON text."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*\stype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.to_json(F.try_parse_json(F.trim(t)))), lambda j: j.isNotNull())


def structured_data(html: Column) -> Column:
    """(jsonld, og, twitter, meta): JSON-LD blocks and meta tags by kind, prefixes taken off; of a repeated name the last counts."""
    pairs = meta_pairs(html)
    part = lambda keep, cut: F.map_from_entries(F.transform(_last(F.filter(pairs, keep)), lambda m: F.struct(F.substring(m["name"], F.lit(cut + 1), F.length(m["name"])), m["content"])))
    og, twitter = (lambda m: m["name"].startswith("og:")), (lambda m: m["name"].startswith("twitter:"))
    return F.struct(json_ld(html).alias("jsonld"), part(og, 3).alias("og"), part(twitter, 8).alias("twitter"), part(lambda m: ~og(m) & ~twitter(m), 0).alias("meta"))


def _last(pairs: Column) -> Column:
    """The last pair of each name."""
    return F.filter(pairs, lambda m, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda o: o["name"] == m["name"]))


def article(html: Column) -> Column:
    """Content of the first ``<article>``; empty without one (``dom.article`` has the further ways)."""
    return F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)


def word_count(html: Column) -> Column:
    """Words of a page's text between blanks, tags included."""
    return F.size(F.filter(F.split(html, r"[ \n\t]+"), lambda w: w != ""))

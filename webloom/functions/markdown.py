"""HTML to Markdown: native columns for what one expression can say, one Arrow function for the ordered rewriting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import WS, title  # noqa: F401

_I, _IS = re.I | re.A, re.I | re.S | re.A

# The expressions of the conversion, which results depend on.
TAG = r"<[^>]+>"
PARAGRAPH = r"<p[^>]*>(.*?)</p>"
ANCHOR = r"<a\s+[^>]*href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
IMAGE = r"<img\s+[^>]*src\s*=\s*[\"']([^\"']+)[\"'][^>]*>"
ALT, TITLE = r"alt\s*=\s*[\"']([^\"']*)[\"']", r"title\s*=\s*[\"']([^\"']*)[\"']"
ORDERED, UNORDERED, ITEM = r"<ol[^>]*>(.*?)</ol>", r"<ul[^>]*>(.*?)</ul>", r"<li[^>]*>(.*?)</li>"
CODE_BLOCK = r"<pre[^>]*><code[^>]*>(.*?)</code></pre>"
CODE_OF = r"<pre[^>]*><code[^>]*class\s*=\s*[\"']language-(\w+)[\"'][^>]*>(.*?)</code></pre>"
LANGUAGE = r"class\s*=\s*[\"']language-(\w+)[\"']"
CODE = r"<code[^>]*>(.*?)</code>"
QUOTE, RULE = r"<blockquote[^>]*>(.*?)</blockquote>", r"<hr\s*/?>"
TABLE, ROW, CELL = r"<table[^>]*>(.*?)</table>", r"<tr[^>]*>(.*?)</tr>", r"<(?:th|td)[^>]*>(.*?)</(?:th|td)>"
#: White space that is trimmed.
_BLANK = " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _sub(pattern: str, by, flags=_IS) -> Callable[[str], str]:
    rx = re.compile(pattern, flags)
    return lambda s: rx.sub(by, s)


def _plain(inner: str) -> str:
    """Trimmed, then without tags."""
    return re.sub(TAG, "", inner.strip(_BLANK))


def sanitize_ref(url: str) -> str:
    """Link label: no scheme, what is no letter or digit as a dash, 50 characters."""
    return re.sub(r"[^a-zA-Z0-9]+", "-", re.sub(r"^https?://", "", url)).strip("-")[:50]


def _list(numbered: bool):
    def by(m: re.Match) -> str:
        items = re.findall(ITEM, m[1], _IS)
        return "".join(f"{f'{i}.' if numbered else '-'} {_plain(x)}\n" for i, x in enumerate(items, 1)) + "\n"

    return by


def table_cells(inner: str) -> list[list[str]]:
    """Cells of each row of a table's content."""
    return [[_plain(c) for c in re.findall(CELL, r, _IS)] for r in re.findall(ROW, inner, _IS)]


def _table(m: re.Match) -> str:
    lines = []
    for i, cells in enumerate(table_cells(m[1])):
        lines.append("| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |")
        if not i:
            lines.append("| " + " | ".join("---" for _ in cells) + " |")
    return "\n".join(lines) + "\n\n"


def _ref(kind: str, mark: str) -> Callable[[re.Match], str]:
    def by(m: re.Match) -> str:
        alt = re.search(ALT, m[0])
        text = (alt[1] if alt else "") if mark else _plain(m[2])
        return f"{mark}[{text}][{sanitize_ref(m[1])}]" if kind == "reference" else f"{mark}[{text}]({m[1]})"

    return by


def _quote(m: re.Match) -> str:
    return "".join(f"> {line.strip(_BLANK)}\n" for line in _plain(m[1]).split("\n") if line.strip(_BLANK)) + "\n"


def _code(m: re.Match) -> str:
    lang = re.search(LANGUAGE, m[0])
    return f"```{lang[1] if lang else ''}\n{m[1].strip(_BLANK)}\n```\n\n"


def steps(links: str = "inline", images: str = "inline") -> dict[str, list[Callable[[str], str]]]:
    """The steps by name, in their order; each sees what those before have left."""
    return {
        "clean": [_sub(r"<script[^>]*>.*?</script>", ""), _sub(r"<style[^>]*>.*?</style>", ""), _sub(r"<!--.*?-->", "", re.A), _sub(r"<noscript[^>]*>.*?</noscript>", "")],
        "headings": [_sub(rf"<h{n}[^>]*>(.*?)</h{n}>", lambda m, n=n: f"{'#' * n} {m[1].strip(_BLANK)}\n\n", _I) for n in range(1, 7)],
        "paragraphs": [_sub(PARAGRAPH, lambda m: _plain(m[1]) + "\n\n")],
        "emphasis": [_sub(r"<(strong|b)[^>]*>(.*?)</(?:strong|b)>", r"**\2**"), _sub(r"<(em|i)[^>]*>(.*?)</(?:em|i)>", r"*\2*")],
        "links": [_sub(ANCHOR, _ref(links, ""))],
        "images": [_sub(IMAGE, _ref(images, "!"))],
        "lists": [_sub(ORDERED, _list(True)), _sub(UNORDERED, _list(False))],
        "code": [_sub(CODE_BLOCK, _code), _sub(CODE, r"`\1`")],
        "quotes": [_sub(QUOTE, _quote)],
        "rules": [_sub(RULE, "---\n\n")],
        "tables": [_sub(TABLE, _table)],
        "cleanup": [lambda s: re.sub(r"\n{3,}", "\n\n", s).strip(_BLANK) + "\n"],
    }


#: The steps as they run unless told otherwise.
STEPS = steps()


def to_markdown(html: str | None, only: str | None = None, links: str = "inline", images: str = "inline") -> str:
    """Markdown of one page (or what one step makes of it); an empty or null page is a line break."""
    out = html or ""
    for name, parts in (STEPS if (links, images) == ("inline", "inline") else steps(links, images)).items():
        if only in (None, name):
            for step in parts:
                out = step(out)
    return out


def _by_rows(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes."""
    rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def convert(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", only: str | None = None, links: str = "inline", images: str = "inline") -> DataFrame:
    """``page_id, markdown`` of all pages, some of them at a time; failures can't occur, nulls are empty pages."""
    base = pages.select(F.col(id_col), F.col(html_col))

    def run(batches):
        for b in batches:
            for part in _by_rows(b):
                yield pa.record_batch([part.column(0), pa.array([to_markdown(x, only, links, images) for x in part.column(1).to_pylist()], pa.string())], [id_col, "markdown"])

    return base.mapInArrow(run, T.StructType([base.schema[0], T.StructField("markdown", T.StringType())]))


def _absolute(url: str, base: str) -> str:
    return base + url if url.startswith("/") else url


def page_links(html: str, base: str) -> list[dict]:
    return [{"text": _plain(t), "url": (u := _absolute(h, base)), "internal": u.startswith(base)} for h, t in re.findall(ANCHOR, html, _IS)]


def page_images(html: str, base: str) -> list[dict]:
    first = lambda rx, tag: m[1] if (m := re.search(rx, tag)) else ""
    return [{"alt": first(ALT, m[0]), "url": _absolute(m[1], base), "title": first(TITLE, m[0])} for m in re.finditer(IMAGE, html, _IS)]


def page_tables(html: str, _: str) -> list[dict]:
    """Tables whose first row has a cell."""
    found = [table_cells(inner) for inner in re.findall(TABLE, html, _IS)]
    return [{"headers": rows[0], "rows": rows[1:]} for rows in found if rows and rows[0]]


def page_code(html: str, _: str) -> list[dict]:
    """Code blocks with a language first, then those of other texts without one."""
    out = [{"language": lang, "code": code.strip(_BLANK)} for lang, code in re.findall(CODE_OF, html, _IS)]
    seen = {b["code"] for b in out}
    for code in (c.strip(_BLANK) for c in re.findall(CODE_BLOCK, html, _IS)):
        if code not in seen:
            seen.add(code)
            out.append({"language": "", "code": code})
    return out


_PARTS = {
    "links": (page_links, "text string, url string, internal boolean"),
    "images": (page_images, "alt string, url string, title string"),
    "tables": (page_tables, "headers array<string>, rows array<array<string>>"),
    "code": (page_code, "language string, code string"),
}


def parts_of(pages: DataFrame, what: str, base: Column, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of the links, images, tables or code blocks of each page, in order (``pos`` from 0); paths that begin with a slash follow ``base``."""
    f, fields = _PARTS[what]
    rows = pages.select(F.col(id_col), F.coalesce(F.col(html_col), F.lit("")).alias("html"), base.alias("base"))
    schema = T.StructType([rows.schema[0], T.StructField("pos", T.IntegerType()), *T._parse_datatype_string(fields).fields])
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}

    def run(batches):
        for b in batches:
            arrow = pa.schema([(id_col, b.schema.field(0).type), ("pos", pa.int32()), *[(x.name, kinds[x.dataType.simpleString()]) for x in schema.fields[2:]]])
            for part in _by_rows(b):
                found = [{id_col: i, "pos": n, **x} for i, h, base in zip(*(part.column(c).to_pylist() for c in range(3))) for n, x in enumerate(f(h, base or ""))]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return rows.mapInArrow(run, schema)


def sanitized_ref(url: Column) -> Column:
    """``sanitize_ref`` of a column."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^A-Za-z0-9]+", "-"), F.lit("-")), 1, 50)


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """At most ``most`` bytes of a text, and a mark where something is missing; a character that is cut goes."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(mark))).otherwise(text)


def clean_html(html: Column) -> Column:
    """Without scripts, styles, one-line comments and noscript parts."""
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?id)<!--.*?-->", r"(?is)<noscript[^>]*>.*?</noscript>"):
        html = F.regexp_replace(html, p, "")
    return html


def headings(html: Column) -> Column:
    for n in range(1, 7):
        html = F.regexp_replace(html, rf"(?id)<h{n}[^>]*>(.*?)</h{n}>", "#" * n + " $1\n\n")
    return html


def emphasis(html: Column) -> Column:
    html = F.regexp_replace(html, r"(?is)<(strong|b)[^>]*>(.*?)</(?:strong|b)>", "**$2**")
    return F.regexp_replace(html, r"(?is)<(em|i)[^>]*>(.*?)</(?:em|i)>", "*$2*")


def stats(text: Column) -> list[Column]:
    """Words, bytes and reading minutes."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\f\r]+"), F.lit(0)))
    return [words.alias("n_words"), F.octet_length(text).alias("n_bytes"), (F.floor(words / 200) + 1).cast("int").alias("minutes")]

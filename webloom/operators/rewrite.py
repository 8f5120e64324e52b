"""Rewriting of stored pages, style sheets and scripts to local paths."""

from __future__ import annotations

import html as _html
import json
import os
import posixpath
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import tables as T
from ..functions import urls as U

_SKIP = ("#", "javascript:", "mailto:", "tel:", "data:", "blob:")
_URL = re.compile(r"""url\(\s*("[^"]*+"|'[^']*+'|(?:[^()"'\\]|\\.|\((?:[^()\\]|\\.)*+\))*+)\s*\)""", re.I)
_IMPORT = re.compile(r"""(@import\s+)(["'])([^"']+)\2""", re.I)
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"""([^\s=/>"']+)(\s*=\s*)("[^"]*+"|'[^']*+'|[^\s>"']+)""")
_RAW = re.compile(r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>")
_URL_ATTRS = {*T.URL_ATTRS, "data", "imagesrc", *T.DATA_URL_ATTRS}
_POLICY = re.compile(r"""(?i)\shttp-equiv\s*=\s*["']?content-security-policy(?:["'\s/]|$)""")
_PREVIEW = re.compile(r"""(?i)\s(?:property|name)\s*=\s*["']?(?:og|twitter):image(?:["'\s/]|$)""")
# The policy of localised pages, and how a page names its replay script.
RELAXED = "default-src * 'unsafe-inline' 'unsafe-eval' data: blob:;"
REPLAY = re.compile(r"""(?i)<script[^>]*\bsrc="[^"]*ws-replay\.js"[^>]*>\s*</script>""")


def local(ref: str, base: str, folder: str, mapping: dict[str, str]) -> str | None:
    """Relative path of a reference's stored file, or None if there is none."""
    ref = ref.strip()
    if not ref or ref.startswith(_SKIP):
        return None
    url = urljoin(base, ref)
    bare, _, fragment = url.partition("#")
    for u in (url, bare, unquote(bare)):
        if u in mapping:
            path = posixpath.relpath(mapping[u], folder or ".")
            return path + ("#" + fragment if fragment and u != url else "")
    return None


def rewrite_css(css: str, base: str, folder: str, mapping: dict[str, str]) -> str:
    """``url()`` and quoted ``@import`` references become relative paths; what has no stored file stays."""

    def url(m: re.Match) -> str:
        inner = m[1]
        quote = inner[0] if inner[:1] in "\"'" and inner else ""
        ref = inner[1:-1] if quote else re.sub(r"\\(.)", r"\1", inner)
        to = local(ref, base, folder, mapping)
        return f"url({quote}{to}{quote})" if to is not None else m[0]

    def imported(m: re.Match) -> str:
        to = local(m[3], base, folder, mapping)
        return f"{m[1]}{m[2]}{to}{m[2]}" if to is not None else m[0]

    return _IMPORT.sub(imported, _URL.sub(url, css))


def rewrite_css_file(css: str, base: str, path: str, mapping: dict[str, str]) -> str:
    """``rewrite_css`` for a style sheet stored at ``path``."""
    return rewrite_css(css, base, os.path.dirname(path), mapping)


def rewrite_srcset_of(value: str, base: str, path: str, mapping: dict[str, str]) -> str:
    """``rewrite_srcset`` for a page stored at ``path``."""
    return rewrite_srcset(value, base, os.path.dirname(path), mapping)


def rewrite_srcset(value: str, base: str, folder: str, mapping: dict[str, str]) -> str:
    out = []
    for part in value.split(","):
        ref, *more = part.split() or [""]
        to = local(ref, base, folder, mapping)
        out.append(" ".join([to if to is not None else ref, *more]))
    return ", ".join(x for x in out if x)


def rewrite_html(html: str, base: str, path: str, mapping: dict[str, str], replay: str = "", crawled: bool = False) -> str:
    """References in attributes, style attributes, preview images and style sheets become relative paths.

    ``<base>`` goes, ``integrity`` is emptied, a content security policy is relaxed; comments
    and scripts stay as they are, but a replay script is taken out, and set in again before the
    end of the body where the stored one (``replay``, its path) is given.  With an empty
    mapping and none of these, the page is returned unchanged.  ``crawled`` leaves ``<base>``
    in place with ``href="."`` and the replay script alone.
    """
    folder = os.path.dirname(path)

    def attr(tag: str, relaxed: bool, preview: bool):
        def one(m: re.Match) -> str:
            name, raw = m[1].lower(), m[3]
            quote = raw[0] if raw[0] in "\"'" else ""
            value = _html.unescape(raw[1:-1] if quote else raw)
            if name == "integrity":
                return f'{m[1]}{m[2]}""'
            if relaxed and name in ("content", "http-equiv"):
                to = RELAXED if name == "content" else "Content-Security-Policy"
            elif tag == "base":
                to = "." if name == "href" else None
            elif name in ("srcset", "data-srcset", "imagesrcset"):
                to = rewrite_srcset(value, base, folder, mapping)
                to = None if to == ", ".join(" ".join(x.split()) for x in value.split(",")) else to
            elif name == "style":
                to = rewrite_css(value, base, folder, mapping)
                to = None if to == value else to
            elif name in _URL_ATTRS or preview and name == "content":
                to = local(value, base, folder, mapping)
            else:
                to = None
            return m[0] if to is None else f"{m[1]}{m[2]}\"{_html.escape(to, quote=True)}\""

        return one

    def tag(m: re.Match) -> str:
        name = m[1].lower()
        if name == "base" and not crawled:
            return ""
        if "=" not in m[2]:
            return m[0]
        meta = m[2] if name == "meta" else ""
        return f"<{m[1]}{_ATTR.sub(attr(name, bool(_POLICY.search(meta)), bool(_PREVIEW.search(meta))), m[2])}>"

    def raw(m: re.Match) -> str:
        if (m[1] or "").lower() == "style":
            head, rest = m[0].split(">", 1)
            body, close = rest.rsplit("</", 1)
            return f"{head}>{rewrite_css(body, base, folder, mapping)}</{close}"
        if m[1]:  # a script's own tag may have a reference
            head, rest = m[0].split(">", 1)
            return _TAG.sub(tag, head + ">") + rest
        return m[0]

    out, at = [], 0
    for m in _RAW.finditer(html):
        out += [_TAG.sub(tag, html[at : m.start()]), raw(m)]
        at = m.end()
    out.append(_TAG.sub(tag, html[at:]))
    html = "".join(out)
    if crawled:
        return html
    html = REPLAY.sub("", html)
    return before_end(html, f'<script src="{_html.escape(posixpath.relpath(replay, folder or "."))}"></script>') if replay else html


def before_end(html: str, text: str) -> str:
    """``text`` set in before the last ``</body>``, else the last ``</html>``; without either nothing changes."""
    at = html.rfind("</body>")
    at = html.rfind("</html>") if at < 0 else at
    return html if at < 0 else html[:at] + text + html[at:]


class Longest:
    """Replaces many texts at once, leftmost and longest first, in one pass over a page however many there are."""

    def __init__(self, pairs: dict[str, str]):
        self.pairs = {k: v for k, v in pairs.items() if k}
        anchor = min([12, *map(len, self.pairs)])
        self.lengths: dict[str, list[int]] = {}
        for k in self.pairs:
            self.lengths.setdefault(k[:anchor], []).append(len(k))
        self.lengths = {a: sorted(set(n), reverse=True) for a, n in self.lengths.items()}
        self.anchors = re.compile("|".join(map(re.escape, sorted(self.lengths)))) if self.pairs else None

    def sub(self, text: str) -> str:
        out, at = [], 0
        m = self.anchors.search(text) if self.anchors else None
        while m:
            i = m.start()
            key = next((text[i : i + n] for n in self.lengths[m[0]] if text[i : i + n] in self.pairs), "")
            if key:
                out += [text[at:i], self.pairs[key]]
                at = i + len(key)
            m = self.anchors.search(text, max(i + 1, at))
        return "".join([*out, text[at:]])


def rewrite_crawled(html: str, base: str, path: str, mapping: dict[str, str]) -> str:
    """As a crawl writes a page: references as ``rewrite_html``, then mapped urls between quotes of any kind, anywhere; ``<base href=".">`` and the replay script."""
    folder = os.path.dirname(path)
    html = rewrite_html(html, base, path, mapping, crawled=True)
    quoted = {q + url + q: q + posixpath.relpath(to, folder or ".") + q for url, to in mapping.items() for q in "\"'`"}
    html = Longest(quoted).sub(html)
    return html if 'src="ws-replay.js"' in html else before_end(html, '<script src="ws-replay.js"></script>')


def css_escaped(text: str) -> str:
    return re.sub(r"""([(),'"\\])""", r"\\\1", text)


def repaired_html(html: str, base: str, path: str, mapping: dict[str, str]) -> str:
    """Absolute urls become relative paths wherever they stand, plain and as style sheets escape them."""
    pairs = {}
    for url, to in mapping.items():
        rel = posixpath.relpath(to, os.path.dirname(path) or ".")
        pairs |= {css_escaped(url): css_escaped(rel), url: rel}
    return Longest(pairs).sub(html)


_STRING = r"""(["'`])([^"'`]*)\2"""
# Where bundles name urls.
PUBLIC_PATH = r"(__webpack_require__\.p\s*=\s*|publicPath\s*:\s*)"
DYNAMIC = r"(\bimport\s*\(\s*)"
PREFIX = r"([\"']?assetPrefix[\"']?\s*:\s*)"
IMAGES = r"([\"']?loader(?:Path|File)?[\"']?\s*:\s*)"


def rewrite_js(js: str, base: str, path: str, mapping: dict[str, str]) -> str:
    """The passes over a bundle: public path, dynamic imports, chunks, prefix and build id, image loader, other strings.

    An absolute public path becomes ``./_next/``, a relative one stays; chunk names and build
    ids stay; asset prefixes become ``./``; imports, loaders and strings with a stored file
    become its relative path.
    """
    folder = os.path.dirname(path)

    def stored(ref: str) -> str | None:
        to = None if ref.startswith(("./", "../")) and urljoin(base, ref) not in mapping else local(ref, base, folder, mapping)
        return None if to is None else to if to.startswith(".") else "./" + to

    def mapped(m: re.Match) -> str:
        to = stored(m[3])
        return m[0] if to is None else f"{m[1]}{m[2]}{to}{m[2]}"

    def public(m: re.Match) -> str:
        return f"{m[1]}{m[2]}./_next/{m[2]}" if m[3].startswith(("http://", "https://", "//")) else m[0]

    js = re.sub(PUBLIC_PATH + _STRING, public, js)
    js = re.sub(DYNAMIC + _STRING, mapped, js)
    js = re.sub(PREFIX + _STRING, r"\1\2./\2", js)
    js = re.sub(IMAGES + _STRING, mapped, js)

    def string(m: re.Match) -> str:
        to = stored(m[2])
        return m[0] if to is None else f"{m[1]}{to}{m[1]}"

    return re.sub(r"""(["'`])((?:https?:)?//[^"'`\s]+|\.{0,2}/[^"'`\s]+\.m?js)\1""", string, js)


def rewrite_next_data(html: str, mapping: dict[str, str]) -> str:
    """The page data of Next.js with an empty asset prefix and mapped dynamic imports; broken data stays."""

    def data(m: re.Match) -> str:
        try:
            got = json.loads(m[2])
        except ValueError:
            return m[0]
        if not isinstance(got, dict):
            return m[0]
        got["assetPrefix"] = ""
        if isinstance(got.get("dynamicImports"), list):
            got["dynamicImports"] = [mapping.get(x, x) if isinstance(x, str) else x for x in got["dynamicImports"]]
        return m[1] + json.dumps(got, separators=(",", ":"), ensure_ascii=False) + m[3]

    return re.sub(r"""(?s)(<script[^>]*id=["']__NEXT_DATA__["'][^>]*>)(.*?)(</script>)""", data, html)


def inline_assets(html: str, base: str, bodies: dict[str, tuple[str, bytes]]) -> str:
    """A page in one file: style sheets and scripts in place, images as data urls (``bodies``: url to mime and content)."""
    import base64

    def got(ref: str):
        return bodies.get(urljoin(base, _html.unescape(ref)))

    def css(m: re.Match) -> str:
        ref = re.search(r"""href\s*=\s*["']([^"']+)""", m[0], re.I)
        found = got(ref[1]) if ref and re.search(r"""rel\s*=\s*["']?stylesheet""", m[0], re.I) else None
        return f"<style>{found[1].decode('utf-8', 'replace')}</style>" if found else m[0]

    def js(m: re.Match) -> str:
        found = got(m[1])
        return f"<script>{found[1].decode('utf-8', 'replace')}</script>" if found else m[0]

    def img(m: re.Match) -> str:
        found = got(m[2])
        return f"{m[1]}data:{found[0]};base64,{base64.b64encode(found[1]).decode()}{m[3]}" if found else m[0]

    html = re.sub(r"<link\b[^>]*>", css, html, flags=re.I)
    html = re.sub(r"""<script[^>]*\ssrc\s*=\s*["']([^"']+)["'][^>]*>\s*</script>""", js, html, flags=re.I)
    return re.sub(r"""(<img[^>]*\ssrc\s*=\s*["'])([^"']+)(["'])""", img, html, flags=re.I)


def _parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes."""
    rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _run(how: Callable, body: str):
    def run(batches):
        for b in batches:
            for part in _parts(b):
                out = []
                for url, path, text, pairs in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                    out.append(None if text is None else how(text, url or "", path or "", {x["ref_url"]: x["path"] for x in pairs or ()}))
                yield pa.record_batch([part.column(0), pa.array(out, pa.string())], ["page_id", body])

    return run


#: Bytes of what pages need of others that may be sent to every executor, so that pages stay where they are.
SENT_BYTES = 32 << 20


def _sent(rows: DataFrame, own: DataFrame, *wide: str) -> DataFrame:
    """``own``, broadcast if ``rows`` (their columns ``wide``) are within SENT_BYTES."""
    size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(64)).cast("long"))).first()[0] or 0
    return F.broadcast(own) if size <= SENT_BYTES else own


def inlined(pages: DataFrame, bodies: DataFrame, body: str = "html") -> DataFrame:
    """``page_id`` and pages in one file (``page_id, url``, body); ``bodies`` is ``page_id, ref_url, mime, content`` of each page's own assets."""
    own = bodies.groupBy("page_id").agg(F.collect_list(F.struct("ref_url", "mime", "content")).alias("_files"))
    rows = pages.select("page_id", "url", body).join(_sent(bodies, own, "ref_url", "content"), "page_id", "left")

    def run(batches):
        for b in batches:
            for part in _parts(b):
                out = [None if text is None else inline_assets(text, url or "", {x["ref_url"]: (x["mime"], x["content"]) for x in files or ()}) for url, text, files in zip(*(part.column(i).to_pylist() for i in range(1, 4)))]
                yield pa.record_batch([part.column(0), pa.array(out, pa.string())], ["page_id", body])

    return rows.mapInArrow(run, types.StructType([pages.schema["page_id"], types.StructField(body, types.StringType())]))


def next_data(html: str, base: str, path: str, mapping: dict[str, str]) -> str:
    """``rewrite_next_data`` as a rewriter of pages."""
    return rewrite_next_data(html, mapping)


def rewritten(pages: DataFrame, mapping: DataFrame, how: Callable = rewrite_html, body: str = "html") -> DataFrame:
    """``page_id`` and the rewritten ``body`` of pages (``page_id, url, path``, body).

    ``mapping`` is ``page_id, ref_url, path``: for each page the stored files of its own
    references (a join of references and files), so that no task needs all files.  A mapping
    within SENT_BYTES goes to the pages; only beyond it bodies are shuffled.  Where a
    reference's path follows from its url, ``rewritten_in_place`` shuffles nothing.
    """
    own = mapping.groupBy("page_id").agg(F.collect_list(F.struct("ref_url", "path")).alias("_map"))
    rows = pages.select("page_id", "url", "path", body).join(_sent(mapping, own, "ref_url", "path"), "page_id", "left")
    return rows.mapInArrow(_run(how, body), types.StructType([pages.schema["page_id"], types.StructField(body, types.StringType())]))


def rewritten_in_place(pages: DataFrame, refs: Column, how: Callable = rewrite_html, body: str = "html") -> DataFrame:
    """As ``rewritten``, with the files of the references ``refs`` (an array of urls) by their rule; bodies stay where they are."""
    own = F.transform(F.array_distinct(refs), lambda u: F.struct(u.alias("ref_url"), U.path_for_url(u).alias("path")))
    rows = pages.select("page_id", "url", U.path_for_url(F.col("url")).alias("path"), body, own.alias("_map"))
    return rows.mapInArrow(_run(how, body), types.StructType([pages.schema["page_id"], types.StructField(body, types.StringType())]))

"""What needs a tokenizer: elements of a page with selectors, media, accessibility, challenge-free extraction of links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import DATA_URL_ATTRS, URL_ATTRS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Tree(HTMLParser):
    """Flat list of elements: (tag, attributes, parent, depth, own text parts)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}  # number of children by parent
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else -1
        place = self.children[parent] = self.children.get(parent, 0) + 1
        self.nodes.append({"tag": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "all": [(k, v or "") for k, v in attrs], "parent": parent, "place": place, "depth": len(self.open), "text": []})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for i in self.open[-1:]:
            self.nodes[i]["text"].append(data)


def text_hash(text: str) -> str:
    """32-bit rolling hash (times 31 plus unit) of a text, as hex."""
    h = 0
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h * 31 + unit) & 0xFFFFFFFF
    return f"{h - (1 << 32) if h >> 31 else h:x}"


def structure(html: str) -> list[dict]:
    """Elements with a selector (``#id``, else ``.class``, else the path of places), hash of their text and number of children."""
    tree, out = Tree(html), []
    nodes, children = tree.nodes, tree.children
    for i, n in enumerate(nodes):
        if n["attrs"].get("id"):
            selector = "#" + n["attrs"]["id"]
        elif n["attrs"].get("class", "").split():
            selector = n["tag"] + "." + n["attrs"]["class"].split()[0]
        else:
            path, at = [], i
            while at >= 0:
                path.append(f"{nodes[at]['tag']}:nth-child({nodes[at]['place']})")
                at = nodes[at]["parent"]
            selector = " > ".join(reversed(path))
        out.append({"tag": n["tag"], "selector": selector, "text_hash": text_hash("".join(n["text"]).strip()), "child_count": children.get(i, 0), "pos": i})
    return out


def media(html: str) -> list[dict]:
    """Video and audio with their sources, distinct by url."""
    nodes, seen, out = Tree(html).nodes, set(), []
    for n in nodes:
        kind = n["tag"] if n["tag"] in ("video", "audio") else None
        if n["tag"] == "source":
            above = nodes[n["parent"]]["tag"] if n["parent"] >= 0 else ""
            kind = f"{above}-source" if above in ("video", "audio") else "source"
        src = n["attrs"].get("src", "")
        if kind and src and src not in seen:
            seen.add(src)
            out.append({"src": src, "type": kind})
    return out


_LANDMARKS = {"nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary", "form": "form"}


def accessibility(html: str, strict: bool = False) -> dict:
    """Counts of an accessibility summary; ``strict`` doesn't take ``alt`` as a name."""
    nodes = Tree(html).nodes
    out = {"node_count": len(nodes), "max_depth": max((n["depth"] for n in nodes), default=0), "missing_alt": 0, "missing_label": 0, "empty_link": 0, "heading_skip": 0, "headings": 0, "landmarks": 0, "required": 0}
    level, marks = 0, set()
    for n in nodes:
        a = n["attrs"]
        name = a.get("aria-label") or a.get("aria-labelledby") or ("" if strict else a.get("alt", ""))
        text = "".join(n["text"]).strip()
        if n["tag"] == "img" and not name:
            out["missing_alt"] += 1
        if n["tag"] in ("input", "select", "textarea"):
            out["required"] += "required" in a or a.get("aria-required") == "true"
            out["missing_label"] += not (name or a.get("id") or a.get("title") or a.get("type") in ("hidden", "submit", "button"))
        if n["tag"] == "a" and not (name or text):
            out["empty_link"] += 1
        if len(n["tag"]) == 2 and n["tag"][0] == "h" and n["tag"][1] in "123456":
            out["headings"] += 1
            out["heading_skip"] += bool(level) and int(n["tag"][1]) > level + 1
            level = int(n["tag"][1])
        if role := a.get("role") if a.get("role") in _LANDMARKS.values() else _LANDMARKS.get(n["tag"]):
            marks.add(role)
    out["landmarks"] = len(marks)
    return out


def exact_links(html: str) -> list[str]:
    """Raw urls of all url attributes and sets of sources of all start tags but scripts and styles, in order (entities decoded)."""
    out = []
    for k, v in (a for n in Tree(html).nodes if n["tag"] not in ("script", "style") for a in n["all"]):
        if k in ("srcset", "data-srcset"):
            out += [x.split()[0] for x in v.split(",") if x.strip()]
        elif v and (k in URL_ATTRS or k in DATA_URL_ATTRS):
            out.append(v)
    return out


# What a visitor can act on, as selectors in the order in which they are tried.
SELECTORS = (
    'button:not([disabled]):not([type="submit"]):not([type="reset"])',
    'a[href]:not([href^="mailto:"]):not([href^="tel:"]):not([href^="javascript:"]):not([target="_blank"])',
    'input[type="button"]:not([disabled])',
    'input[type="submit"]:not([disabled])',
    '[role="button"]:not([aria-disabled="true"])',
    "[onclick]",
    ".btn:not([disabled])",
    "button.btn:not([disabled])",
    "[data-action]",
    "[data-click]",
    "[data-toggle]",
    "[data-dismiss]",
    "summary",
    "details:not([open]) > summary",
    ".accordion-header",
    ".accordion-trigger",
    '[aria-expanded="false"]',
    ".collapsible:not(.active)",
    '[data-bs-toggle="collapse"]',
    '[data-bs-toggle="modal"]',
    '[data-toggle="tab"]',
    '[data-toggle="pill"]',
)
_PART = re.compile(r"""^(\w+)|\.([\w-]+)|\[([\w-]+)(?:(\^?=)"([^"]*)")?\]|:not\(([^)]*)\)""")


def selected(selector: str):
    """Whether an element (and the one above it) fits a selector of tags, classes, attributes, ``:not`` and ``>``."""
    *above, own = selector.split(" > ")
    tests = []
    for tag, cls, name, how, value, negated in _PART.findall(own):
        if tag:
            tests.append(lambda n, up, x=tag: n["tag"] == x)
        elif cls:
            tests.append(lambda n, up, x=cls: x in n["attrs"].get("class", "").split())
        elif name and how == "^=":
            tests.append(lambda n, up, k=name, v=value: n["attrs"].get(k, "").startswith(v))
        elif name and how:
            tests.append(lambda n, up, k=name, v=value: n["attrs"].get(k) is not None and (n["attrs"][k].lower() if k == "type" else n["attrs"][k]) == v)
        elif name:
            tests.append(lambda n, up, k=name: k in n["attrs"])
        else:
            tests.append(lambda n, up, f=selected(negated): not f(n, up))
    if above:
        tests.append(lambda n, up, f=selected(above[-1]): up is not None and f(up, None))
    return lambda n, up: all(t(n, up) for t in tests)


_SELECTED = [(s, selected(s)) for s in SELECTORS]


def census(html: str) -> list[dict]:
    """How many elements of a stored page each selector finds (``kind``), those that it finds anywhere."""
    nodes, out = Tree(html).nodes, dict.fromkeys(SELECTORS, 0)
    for n in nodes:
        up = nodes[n["parent"]] if n["parent"] >= 0 else None
        for s, fits in _SELECTED:
            out[s] += fits(n, up)
    return [{"kind": s, "n": n} for s, n in out.items() if n]


def css_scanned(css: str) -> list[str]:
    """``url()`` references of a style sheet with balanced brackets; what stands behind a backslash is taken as it is."""
    low, out, at = css.lower(), [], 0
    while (found := low.find("url(", at)) >= 0:
        depth, value, at = 1, [], found + 4
        while at < len(css):
            c = css[at]
            if c == "\\" and at + 1 < len(css):
                value.append(css[at + 1])
                at += 2
                continue
            depth += (c == "(") - (c == ")")
            if not depth:
                break
            value.append(c)
            at += 1
        at += 1
        ref = "".join(value).strip().strip("\"'").strip()
        if ref:
            out.append(ref)
    return out


# Where an article is looked for when there is no <article>, in this order (attribute, value).
ARTICLES = (("role", "main"), ("class", "main-content"), ("class", "content"), ("id", "content"), ("class", "post-content"), ("class", "entry-content"), ("class", "article-body"), ("itemprop", "articleBody"))


def article(html: str) -> dict:
    """Title, where the article was found, and its text: ``<article>``, a usual container, else the one with most text."""
    tree = Tree(html)
    nodes = tree.nodes
    ends, own = [0] * len(nodes), [[] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):  # elements below i are those up to its end
        ends[i] = max(i + 1, ends[i])
        if nodes[i]["parent"] >= 0:
            ends[nodes[i]["parent"]] = max(ends[nodes[i]["parent"]], ends[i])
    text = lambda i: " ".join("".join(t for n in nodes[i : ends[i]] if n["tag"] not in ("script", "style") for t in n["text"]).split())
    has = lambda n, a, v: v in n["attrs"].get("class", "").split() if a == "class" else n["attrs"].get(a) == v
    title = next((text(i) for i, n in enumerate(nodes) if n["tag"] == "title"), "")
    at, how = next((i for i, n in enumerate(nodes) if n["tag"] == "article"), None), "article"
    for a, v in ARTICLES:
        if at is None:
            at, how = next((i for i, n in enumerate(nodes) if has(n, a, v)), None), f"{a}={v}"
    if at is None:
        length = lambda i: sum(len("".join(n["text"]).strip()) for n in nodes[i : ends[i]] if n["tag"] not in ("script", "style"))
        sizes = [(length(i), -i) for i, n in enumerate(nodes) if n["tag"] in ("div", "section", "main")]
        at, how = (-max(sizes)[1], "largest") if sizes and max(sizes)[0] else (next((i for i, n in enumerate(nodes) if n["tag"] == "body"), None), "body")
    return {"title": title, "how": how if at is not None else "none", "content": text(at) if at is not None else ""}


_SCHEMAS = {
    "css": (lambda h: [{"ref": x} for x in css_scanned(h)], "ref string"),
    "article": (lambda h: [article(h)], "title string, how string, content string"),
    "census": (census, "kind string, n int"),
    "structure": (structure, "tag string, selector string, text_hash string, child_count int, pos int"),
    "media": (media, "src string, type string"),
    "accessibility": (lambda h: [accessibility(h)], "node_count int, max_depth int, missing_alt int, missing_label int, empty_link int, heading_skip int, headings int, landmarks int, required int"),
    "links": (lambda h: [{"ref": x} for x in exact_links(h)], "ref string"),
}


def extract(pages: DataFrame, what: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of one kind (structure, media, accessibility, links) for each page; null pages are empty."""
    f, fields = _SCHEMAS[what]
    inner = T._parse_datatype_string(fields)
    names = [x.name for x in inner.fields]
    base = pages.select(id_col, html_col)

    def run(batches):
        for b in batches:
            rows_at_once = max(1, min(200, b.num_rows * (1 << 20) // max(b.nbytes, 1)))
            for lo in range(0, b.num_rows, rows_at_once):
                part = b.slice(lo, rows_at_once)
                rows = [(i, r) for i, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in f(h or "")]
                yield pa.RecordBatch.from_pylist([{id_col: i, **{n: (int(r[n]) if isinstance(r[n], bool) else r[n]) for n in names}} for i, r in rows], schema=_arrow(b.schema.field(0).type, id_col, inner))

    return base.mapInArrow(run, T.StructType([base.schema[0], *inner.fields]))


def _arrow(id_type, id_col: str, inner: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32()}
    return pa.schema([(id_col, id_type), *[(x.name, kinds[x.dataType.simpleString()]) for x in inner.fields]])

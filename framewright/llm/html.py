"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, less the share of linked text; the best
container is kept with siblings that score well. Boilerplate subtrees (menus, headers and footers outside the
article, sidebars, notices, adverts, forms, comments) leave the tree first. Pages are parsed row by row in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("script style textarea title xmp iframe noembed noframes head nav aside form noscript template button select svg canvas object video audio dialog menu fieldset map".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td li dd h2 h3 h4 h5 h6 figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open tag of the key is closed by a start tag of the value, up to the fence.
CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|sidebar|side|rail|widget|related|recommend\w*|more|trending|popular|"
    r"nav\w*|menu|breadcrumbs?|pagination|pager|header|masthead|footer|foot|copyright|comments?|comment-?list|disqus|replies|reply|respond|discussion|toolbar|tags|skip|hidden|print|rss|meta|byline)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|content|main|body|story|text|page)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "block", "items", "score", "text", "linked", "said", "commas")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.block: Node | None = self if tag in BLOCK or parent is None else parent.block  # the nearest block, or the root
        self.score, self.text, self.linked, self.said, self.commas = 0.0, 0, 0, 0, 0


def parse(html: str) -> Node:
    """A tree of nodes and strings; end tags that are missing are implied, stray ones ignored."""
    root = Node("#root", {}, None)
    at, pos, n, open_tags = root, 0, len(html), Counter()

    def up_to(node: Node) -> Node:
        x = at
        while x is not node:
            open_tags[x.tag] -= 1
            x = x.parent
        return node

    while pos < n:
        m = TOKEN.search(html, pos)
        if m is None:
            at.items.append(unescape(html[pos:]))
            break
        if m.start() > pos:
            at.items.append(unescape(html[pos : m.start()]))
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at if open_tags[tag] else root
            while up is not root and up.tag != tag:
                if up.tag in ("table", "article", "body") and tag not in ("html", "body", "article", "main", "section", "div"):
                    break
                up = up.parent
            if up.tag == tag:
                at = up_to(up.parent)
            continue
        if tag in BLOCK and at.block.tag == "p":  # a block ends an open paragraph, whatever inline tags are open in it
            at = up_to(at.block.parent)
        if tag in CLOSES:
            names, fences = CLOSES[tag]
            up = at if any(open_tags[x] for x in names.split()) else root
            while up is not root and up.tag not in fences and up.tag not in names.split():
                up = up.parent
            if up is not root and up.tag in names.split():
                at = up_to(up.parent)
        node = Node(tag, {k.lower(): (v or "").strip("\"'") for k, v in ATTR.findall(m[3] or "")}, at)
        at.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            at = node
            open_tags[tag] += 1
    return root


def _unwanted(x: Node, inside: bool) -> bool:
    if x.tag in DROP or (x.tag in ("header", "footer") and not inside) or x.tag == "footer":
        return True
    if "hidden" in x.attrs or x.attrs.get("aria-hidden") == "true" or "display:none" in x.attrs.get("style", "").replace(" ", "").lower():
        return True
    if x.attrs.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"):
        return True
    if x.tag in ("html", "body", "article", "main") or x.tag not in BLOCK and x.tag not in ("span", "a", "ins"):
        return False
    mark = f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}"
    return bool(mark.strip() and UNLIKELY.search(mark) and not LIKELY.search(mark))


def prune(root: Node) -> None:
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        x.items = [y for y in x.items if isinstance(y, str) or not _unwanted(y, inside)]
        todo += [(y, inside or y.tag in ("article", "main")) for y in x.items if not isinstance(y, str)]


def _walk(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [y for y in reversed(x.items) if not isinstance(y, str)]
    return out


def best(root: Node) -> list[Node]:
    """The container with the most points and the siblings that are kept with it, in page order."""
    nodes = _walk(root)
    for x in reversed(nodes):
        for y in x.items:
            if isinstance(y, str):
                line = SPACE.sub(" ", y)
                x.text, x.said, x.commas = x.text + len(line.strip()), x.said + len(line), x.commas + line.count(",")
            else:
                x.text, x.said, x.commas = x.text + y.text, x.said + y.said + (y.tag in BLOCK), x.commas + y.commas
        x.linked = x.text if x.tag == "a" else sum(y.linked for y in x.items if not isinstance(y, str))
    base = {"article": 30.0, "main": 25.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "body": 0.0}
    for x in nodes:
        mark = f"{x.attrs.get('class', '')} {x.attrs.get('id', '')} {x.attrs.get('itemprop', '')}"
        x.score += base.get(x.tag, -2.0 if x.tag in ("ul", "ol", "form", "th") else 0.0) + (25.0 if mark.strip() and LIKELY.search(mark) else 0.0)
    for x in nodes:
        text = x.tag in PARAGRAPH or (x.tag in ("div", "section") and x.text and all(isinstance(y, str) or y.tag not in BLOCK for y in x.items))
        if not text or x.text < 1:
            continue
        points = (1 + x.commas + min(x.said / 100, 3.0)) * (1 - x.linked / max(1, x.text)) * min(1.0, x.said / 25)
        up, share = x.parent, 1.0
        for level in range(4):
            if up is None or up.tag in ("#root", "html"):
                break
            up.score += points * share
            share = 0.5 if level == 0 else share / 1.5
            up = up.parent
    fit = [x for x in nodes if x.tag in BLOCK and x.tag != "html" and x.tag not in PARAGRAPH and x.text] or [root]
    top = max(fit, key=lambda x: x.score * (1 - x.linked / max(1, x.text)))
    if top.parent is None or top.tag in ("body", "html", "#root"):
        return [top]
    least, mark = max(10.0, 0.2 * top.score), top.attrs.get("class", "")
    out = []
    for y in top.parent.items:
        if isinstance(y, str):
            continue
        density = y.linked / max(1, y.text)
        bonus = 0.2 * top.score if mark and y.attrs.get("class", "") == mark else 0.0
        same = y.tag in ("article", "section", "div", "main") and density < 0.3 and y.score * (1 - density) + bonus >= least and y.tag == top.tag
        prose = y.tag == "p" and y.text and (density < 0.25 and y.text > 80 or density == 0 and _said(y).rstrip().endswith((".", "!", "?")))
        if y is top or same or prose:
            out.append(y)
    return out


def _said(x: Node) -> str:
    out, todo = [], [x]
    while todo:
        y = todo.pop()
        if isinstance(y, str):
            out.append(y)
        else:
            todo += reversed(y.items)
            if y.tag in BLOCK or y.tag == "br":
                out.append(" ")
    return SPACE.sub(" ", "".join(out)).strip()


def blocks(x: Node) -> list[str]:
    """Text of each block below, in page order; white space in a block is one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list = [x]
    while todo:
        y = todo.pop()
        if y is None:
            flush()
        elif isinstance(y, str):
            line.append(y)
        elif y.tag == "br":
            line.append(" ")
        else:
            if y.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(y.items)
    flush()
    return out


def extract(html: str | None) -> str:
    """The main text of a page; null, empty and wordless pages give the empty text."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return " ".join(b for x in best(root) for b in blocks(x))


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``; ids and addresses may be null, repeated rows agree, pages are taken whole, no rows give no rows, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

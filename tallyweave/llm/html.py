"""Main text of HTML pages by tag-path ratios.

Text blocks are grouped by their root-to-leaf tag path.  For each path, text length and punctuation are averaged over
its blocks; the averages are smoothed over the page's blocks in order, fused, and weighed: a path that names itself a
notice, a search box or the like is doubted, and so is one outside of a page's article or main element.  The blocks of
paths above a threshold are anchors.  Where all anchors are inside an article or main element, that is the content,
else the element that holds the anchors together, whatever its blocks score.  Long, punctuated text outweighs a doubt.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from math import inf, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Batches, kind, only

#: Fixed values of the HTML standard.
VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
})
CLOSES_P = frozenset({
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "ul",
})
#: An opened element ends an open one of these kinds, up to the given ancestors.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"}),
}
#: Elements whose content is no text of the page, and raw text that ends only at their own end tag.
RAW = frozenset({
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes",
})
HIDDEN = frozenset({
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "head", "noscript", "template", "svg", "math", "object", "audio",
    "video", "canvas", "select", "datalist",
})
BOILERPLATE = frozenset({
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset",
})
#: Words of class and id that name what is never the text, and words that do so less surely.
NEVER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|breadcrumbs?|sidebar|footer|foot|masthead|comments?|commentlist|reply|replies|"
    r"respond|disqus|newsletter|signup|login|cookies?|consent|gdpr|pagination|pager)(?:$|[\s_-])",
    re.I,
)
DOUBTED = re.compile(
    r"(?:^|[\s_-])(?:banner|menu|side|header|discussion|related|recommend\w*|share|sharing|social|subscribe|subscription|notice|notices|notification|alert|popup|"
    r"modal|overlay|toolbar|widget|copyright|legal|form|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset({
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar",
})
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")

#: Weights of neighbouring blocks.
SMOOTH = (1, 2, 4, 2, 1)
#: Part of the page's largest score that the path of an anchor reaches.
ANCHOR = 0.5
#: Factor of a doubted path's score, and the score it needs before that: about a sentence with a comma.
DOUBT, PROSE = 0.2, 6.0
#: Elements that are a part of the text around them: an anchor in one stands for what is outside of it too.
PARTS = frozenset({
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "pre", "blockquote", "address", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption",
    "thead", "tbody", "tfoot", "tr", "figure", "figcaption", "summary",
})


@dataclass
class Element:
    tag: str
    path: int  #: identity of the root-to-leaf path
    weight: float  #: 0 for what is never the text, DOUBT below a doubted name, else 1
    inside: bool
    parent: Element | None = None
    number: int = 0  #: in the order of start tags
    doubted: int = 0  #: number of the outermost element with a doubted name around this one
    last: float = inf  #: number of the last element inside


@dataclass
class Block:
    path: int
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    paths: dict[tuple[int, str, float, bool], int] = {}
    stack = [Element("", 0, 1.0, False)]
    out: list[Block] = []
    now: Block | None = None
    links, hidden, opened = 0, None, 0
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal now
        if hidden is not None or not raw:
            return
        if now is None:
            now = Block(stack[-1].path, stack[-1])
        said = html.unescape(raw) if "&" in raw else raw
        now.parts.append(said)
        if links:
            now.linked += len(said)

    def cut() -> None:
        nonlocal now, links
        if now is not None:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
        now, links = None, 0

    def drop(index: int) -> None:
        nonlocal hidden
        cut()
        for element in stack[index:]:
            element.last = opened
        del stack[index:]
        if hidden is not None and len(stack) <= hidden:
            hidden = None

    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        closing, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                cut()
            elif tag in ("br", "wbr"):
                text(" " if tag == "br" else "")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    drop(i)
                    break
                # A cell or an item is not left by the end of something outside it.
                if tag in ("p", "li") and stack[i].tag in ("table", "td", "th", "article", "section", "ul", "ol"):
                    break
            else:
                cut()
            continue
        cut()
        if tag in CLOSES_P and stack[-1].tag == "p":
            drop(len(stack) - 1)
        if tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in ends:
                    drop(i)
                    break
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end if not close else close.end()
            if close:
                bracket = page.find(">", at)
                at = end if bracket < 0 else bracket + 1
            continue
        if tag == "body" and hidden is not None:  # a head that was never closed
            drop(hidden)
        top = stack[-1]
        marks = {}
        if rest and ("=" in rest):
            for m in ATTRIBUTE.finditer(rest):
                marks.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        label = tag + "".join(f".{x}" for x in marks.get("class", "").split())
        inside = top.inside or tag in ("article", "main") or marks.get("role", "").lower() in ("main", "article")
        role, names = marks.get("role", "").lower(), [marks[m] for m in ("class", "id") if m in marks]
        weight = top.weight
        if tag in BOILERPLATE or (tag == "header" and not top.inside) or role in ROLES:
            weight = 0.0
        elif tag == "article" and any(re.search(r"(?:^|[\s_-])(?:comments?|reply|replies|advert\w*|related)(?:$|[\s_-])", n, re.I) for n in names):
            weight = 0.0
        elif tag not in ("html", "body", "article", "main"):
            weight = 0.0 if any(map(NEVER.search, names)) else min(weight, DOUBT) if any(map(DOUBTED.search, names)) else weight
        opened += 1
        doubted = top.doubted or (opened if weight == DOUBT else 0)
        stack.append(Element(tag, paths.setdefault((top.path, label, weight, inside), len(paths) + 1), weight, inside, top, opened, doubted))
        if hidden is None and tag in HIDDEN:
            hidden = len(stack) - 1
    cut()
    return out


def container(anchors: list[Block]) -> Element:
    """The innermost element that holds all anchors and is no mere part of a text."""
    places = [b.element for b in anchors]
    out, far = min(places, key=lambda e: e.number), max(e.number for e in places)
    while out.parent is not None and (out.last < far or out.tag in PARTS):
        out = out.parent
    return out


def path_scores(page: list[Block]) -> dict[int, float]:
    """Score of each path of the blocks that may be content: fused averages, smoothed over the page, weighed."""
    totals: dict[int, list[float]] = {}
    for b in page:
        t = totals.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)))):
            t[i] += x
    fused = []
    for b in page:
        n, chars, marks, linked = totals[b.path]
        fused.append((log1p(chars / n), log1p(marks / n), 1 - linked / chars))
    reach = len(SMOOTH) // 2
    by_path: dict[int, list[float]] = {}
    for i, b in enumerate(page):
        near = [(SMOOTH[j - i + reach], fused[j]) for j in range(max(0, i - reach), min(len(page), i + reach + 1))]
        weight = sum(w for w, _ in near)
        length, marks = (sum(w * f[k] for w, f in near) / weight for k in (0, 1))
        by_path.setdefault(b.path, []).append(length * (1 + marks) * fused[i][2])
    framed = any(b.element.inside for b in page)
    out: dict[int, float] = {}
    for b in page:
        if b.path not in out:
            score, n, (_, chars, marks, _) = sum(by_path[b.path]), len(by_path[b.path]), totals[b.path]
            doubt = b.element.weight if log1p(chars / n) * (1 + log1p(marks / n)) >= PROSE or b.element.weight == 1 else 0.0
            out[b.path] = score / n * doubt * (DOUBT if framed and not b.element.inside else 1.0)
    return out


def main_text(page: str) -> str:
    """Content blocks in page order, joined by an empty line."""
    good = [b for b in blocks(page) if b.element.weight > 0]
    score = path_scores(good)
    most = max(score.values(), default=0.0)
    anchors = [b for b in good if score[b.path] >= most * ANCHOR and score[b.path] > 0]
    if any(b.element.inside and not b.element.doubted for b in good) and not anchors:  # all of it is links
        return "\n\n".join(b.text for b in good if b.element.inside and not b.element.doubted)
    if not anchors:
        return ""
    trusted = {b.element.doubted for b in anchors} | {0}
    good = [b for b in good if b.element.doubted in trusted]
    if all(b.element.inside for b in anchors):
        return "\n\n".join(b.text for b in good if b.element.inside)
    whole = container(anchors)
    # A page's title often stands above the element of its text; a site's name there is a link.
    return "\n\n".join(
        b.text for b in good if whole.number <= b.element.number <= whole.last or (b.element.tag == "h1" and b.linked < len(b.text))
    )


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, text and n_chars (code points) of every page.  Map-only.

    Null and empty pages give an empty text; repeated rows each get their row; a page of any length is read whole, in
    one task.  A page whose blocks are all boilerplate, or all links and in no article, gives an empty text.  Other
    columns of ``df``, whatever their names, are not read.
    """
    picked = only(df, id=id_col, url=url_col, html=html_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = [main_text(x or "") for x in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = picked.mapInArrow(run, f"id {kind(picked, 'id')}, url {kind(picked, 'url')}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))

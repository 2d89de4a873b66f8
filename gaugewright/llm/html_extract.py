"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree. Each is main text or not; the potential of a parent and its child depends on the child's tag,
and each element's class names, text length, link share and place among its siblings are evidence. Sum-product messages go up and
then down the tree and give every element its marginal. The potentials are counts from labelled pages. Blocks of text whose element
is more likely main text than not are the result; what a page hides, and all below it, is never main text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_samples import labelled_pages

# HTML's void, inline and hidden elements.
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
INLINE = {*"a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split()}
HIDDEN = {*"script style noscript template textarea title iframe svg math select button canvas audio video object datalist dialog".split()}
#: Controls that pages leave open: without an end tag of their own they end at a block.
CONTROLS = {t: re.compile(rf"<(/?){t}\b", re.IGNORECASE) for t in ("select", "button")}
IN_CONTROL = {"option", "optgroup"}
#: An open element of the key's tag ends where one of these tags begins.
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}
SCOPES = {"ul", "ol", "dl", "table", "select"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
#: What hides an element: ``hidden`` by itself, or these values.
_HIDES = re.compile(r"(?:^|\s)(?:hidden(?=[\s/]|\Z)|hidden\s*=|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.IGNORECASE)
_MAY_HIDE = re.compile("hidden|display|visibility", re.IGNORECASE)
_QUOTED = re.compile(r"(?<![\w-])(?!style\b)[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.IGNORECASE)
HEADINGS = {*"h1 h2 h3 h4 h5 h6".split()}
#: Elements that articles and lists of comments alike are made of.
WRAPPERS = {*"div section article aside ul ol dl li dd details blockquote".split()}
_LABEL = re.compile(r'data-main="([01])"')
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """The block elements in page order; a parent comes before its children. The first is the body, which every page has."""

    tags: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[list[str]] = field(default_factory=lambda: [[]])
    labels: list[int | None] = field(default_factory=lambda: [None])
    own: list[int] = field(default_factory=lambda: [0])  # characters of text of its own
    linked: list[int] = field(default_factory=lambda: [0])  # of these, inside links
    hidden: list[bool] = field(default_factory=lambda: [False])  # by itself or by an element around it
    blocks: list[tuple[int, str]] = field(default_factory=list)  # element, text


def parse(source: str | None) -> Page:
    """Read a page as it comes: unclosed, cut off and misnested elements are allowed."""
    page = Page()
    if not source:
        return page
    stack, texts, in_link, link_chars, at = [0], [], 0, 0, 0
    hidden, depth, unended = None, 0, False

    def without_end(tag: str, start: int) -> bool:
        after = CONTROLS[tag].search(source, start) if tag in CONTROLS else None
        return tag in CONTROLS and not (after and after[1])

    def flush() -> None:
        nonlocal link_chars
        if texts:
            text = " ".join("".join(texts).split())
            texts.clear()
            if text:
                page.blocks.append((stack[-1], text))
                page.own[stack[-1]] += len(text)
                page.linked[stack[-1]] += min(link_chars, len(text))
        link_chars = 0

    def take(end: int) -> None:
        nonlocal link_chars
        if hidden is None and end > at:
            text = html.unescape(source[at:end]) if "&" in (part := source[at:end]) else part
            texts.append(text)
            if in_link:
                link_chars += len(text)

    raw = None
    for m in _MARKUP.finditer(source):
        tag = (m[2] or m[5] or "").lower()
        closing = bool(m[1] or m[4])
        if raw is not None:  # inside an element without markup of its own
            if not (closing and tag == raw):
                continue
            raw = None
            at = m.end()
            if hidden == tag:
                hidden = None
            continue
        take(m.start())
        at = m.end()
        if not tag:
            continue
        if hidden is not None:
            if unended and tag not in INLINE and tag not in VOID and tag not in HIDDEN and tag not in IN_CONTROL:
                hidden = None  # a block begins, or one around the control ends
            elif tag == hidden and tag in CONTROLS:
                hidden = None if closing else hidden  # a control ends an open one of its kind
                unended = without_end(tag, at)
            elif tag == hidden:
                if not closing and tag in ("svg", "math") and m[0].endswith("/>"):
                    continue
                depth += -1 if closing else 1
                if not depth:
                    hidden = None
            elif tag in ("script", "style") and not closing:
                raw = tag
            if hidden is not None or tag in HIDDEN:
                continue
        if tag in HIDDEN:
            if not closing and not (tag in ("svg", "math") and m[0].endswith("/>")):
                hidden, depth, unended = tag, 1, without_end(tag, at)
                if tag in ("script", "style", "textarea", "title", "iframe", "noscript"):
                    raw = tag
            continue
        if tag in INLINE or tag in VOID:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                texts.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        in_link = 0
        if tag in ("html", "head", "body"):
            if label := _LABEL.search(m[3] or m[6] or ""):
                page.labels[0] = int(label[1])
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if page.tags[stack[i]] == tag:
                    del stack[i:]
                    break
            continue
        if page.tags[stack[-1]] == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            open_tag = page.tags[stack[i]]
            if tag in CLOSED_BY.get(open_tag, ()):
                del stack[i:]
                break
            if open_tag in SCOPES:
                break
        names, label = [], None
        attrs = m[3] or m[6]
        if attrs:
            for name, *values in _ATTR.findall(attrs):
                value = "".join(values)
                if name == "data-main":
                    label = int(value)
                else:
                    names += ["role" + value.lower()] if name.lower() == "role" else [t.lower() for t in _TOKEN.findall(value)]
        hides = bool(attrs) and _MAY_HIDE.search(attrs) is not None and _hides(attrs)
        page.hidden.append(hides or page.hidden[stack[-1]])
        page.parents.append(stack[-1])
        stack.append(len(page.tags))
        page.tags.append(tag)
        page.names.append(names)
        page.labels.append(label)
        page.own.append(0)
        page.linked.append(0)
    if raw is None:
        take(len(source))
    flush()
    return page


def _hides(attrs: str) -> bool:
    """Whether attributes hide their element; the other attributes' values do not count."""
    aria = re.search(r"aria-hidden\s*=\s*[\"']?true", attrs, re.IGNORECASE)
    return bool(aria or _HIDES.search(" " + _QUOTED.sub(" ", attrs)))


def _places(page: Page) -> list[list[str]]:
    """What an element's place tells. ``twin``: a wrapper without a heading of its own beside another that begins alike, as comments and teasers
    are; ``around``: one that holds such; ``tail``: a wrapper after the last paragraph of its parent, where there are paragraphs."""
    children: list[list[int]] = [[] for _ in page.tags]
    for i in range(1, len(page.tags)):
        children[page.parents[i]].append(i)
    out: list[list[str]] = [[] for _ in page.tags]
    for i, own in enumerate(children):
        if not own:
            continue
        shapes: dict[tuple, list[int]] = defaultdict(list)
        for c in own:
            inside = [page.tags[x] for x in children[c]]
            if page.tags[c] in WRAPPERS and inside and not HEADINGS & set(inside):
                shapes[page.tags[c], inside[0]].append(c)
        twins = [c for same in shapes.values() if len(same) > 1 for c in same]
        for c in twins:
            out[c].append("place twin")
        if twins and i:
            out[i].append("place around")
        paragraphs = [c for c in own if page.tags[c] == "p" and page.own[c]]
        if paragraphs:
            for c in own:
                if c > paragraphs[-1] and page.tags[c] in WRAPPERS:
                    out[c].append("place tail " + ("list" if page.tags[c] in ("ul", "ol", "dl") else "headed" if HEADINGS & {page.tags[x] for x in children[c]} else "plain"))
    return out


def evidence(page: Page) -> list[list[str]]:
    """Of each element: its class names, the length of its own text, the share of links in the text below it, and its place."""
    places = _places(page)
    below, linked = page.own.copy(), page.linked.copy()
    for i in range(len(below) - 1, 0, -1):
        below[page.parents[i]] += below[i]
        linked[page.parents[i]] += linked[i]
    out = []
    for i, names in enumerate(page.names):
        seen = ["name " + n for n in dict.fromkeys(names)]
        if page.own[i]:
            seen.append(f"own {min(6, page.own[i].bit_length() // 2)}")
        if below[i]:
            seen.append(f"links {4 * linked[i] // below[i]}")
        out.append(seen + places[i])
    return out


@dataclass(frozen=True)
class Model:
    """``pair``: of a child's tag, the chance of main text below other text and below main text; ``odds``: of evidence, its log-likelihood ratio."""

    pair: dict[str, tuple[float, float]]
    rare: tuple[float, float]
    odds: dict[str, float]

    def marginals(self, page: Page) -> list[float]:
        """Sum-product: messages from the leaves to the root, then from the root to the leaves."""
        n = len(page.tags)
        pairs = [self.pair.get(t, self.rare) for t in page.tags]
        odds = [-9.0 if gone else max(-9.0, min(9.0, sum(self.odds.get(e, 0.0) for e in seen))) for gone, seen in zip(page.hidden, evidence(page), strict=True)]
        # up[i]: evidence at and below i for each state; message[i]: what i says to its parent's states
        up = [[1.0, exp(x)] for x in odds]
        message = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b = up[i]
            s = a + b
            a, b = a / s, b / s
            up[i] = [a, b]
            p0, p1 = pairs[i]
            message[i] = ((1 - p0) * a + p0 * b, (1 - p1) * a + p1 * b)
            parent = up[page.parents[i]]
            parent[0] *= message[i][0]
            parent[1] *= message[i][1]
            s = parent[0] + parent[1]
            parent[0] /= s
            parent[1] /= s
        belief = [0.0] * n  # the chance of main text
        top = pairs[0][0]
        belief[0] = up[0][1] * top / (up[0][1] * top + up[0][0] * (1 - top))
        for i in range(1, n):
            parent = belief[page.parents[i]]
            # the parent without what i told it
            q0, q1 = (1 - parent) / message[i][0], parent / message[i][1]
            s = q0 + q1
            q0, q1 = q0 / s, q1 / s
            p0, p1 = pairs[i]
            a = up[i][0] * (q0 * (1 - p0) + q1 * (1 - p1))
            b = up[i][1] * (q0 * p0 + q1 * p1)
            belief[i] = b / (a + b)
        return belief


def train(pages: Iterable[str]) -> Model:
    """Count over labelled pages (``data-main`` 1 or 0 on every element). Unseen tags take the pooled counts."""
    pair: dict[str, list[list[float]]] = defaultdict(lambda: [[0.0, 0.0], [0.0, 0.0]])
    pooled = [[0.5, 0.5], [0.5, 0.5]]
    seen: dict[str, list[float]] = defaultdict(lambda: [0.5, 0.5])
    total = [1.0, 1.0]
    kinds: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for source in pages:
        page = parse(source)
        features = evidence(page)
        for i in range(len(page.tags)):
            y, above = page.labels[i] or 0, (page.labels[page.parents[i]] or 0) if i else 0
            pair[page.tags[i]][above][y] += 1
            pooled[above][y] += 1
            total[y] += 1
            for e in features[i]:
                seen[e][y] += 1
                if not e.startswith(("name ", "place ")):
                    kinds[e.split()[0]][y] += 1
    odds = {}
    for e, (a, b) in seen.items():
        alone = e.startswith(("name ", "place "))
        base = total if alone else kinds[e.split()[0]]
        # lengths and link shares of neighbours go together: they count for less
        odds[e] = (log(b / base[1]) - log(a / base[0])) * (1.0 if alone else 0.75)
    rare = (pooled[0][1] / sum(pooled[0]), pooled[1][1] / sum(pooled[1]))
    # a tag's own counts, and the pooled chance as one more
    chance = {t: ((c[0][1] + rare[0]) / (sum(c[0]) + 1), (c[1][1] + rare[1]) / (sum(c[1]) + 1)) for t, c in pair.items()}
    return Model(chance, rare, odds)


def main_text(source: str | None, model: Model) -> str:
    page = parse(source)
    belief = model.marginals(page)
    return "\n\n".join(text for i, text in page.blocks if belief[i] > 0.5 and not page.hidden[i])


def extract(pages: DataFrame, model: Model | None = None, page_html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with ``into``: the main text of the whole page, its blocks joined by an empty line; empty for null, for
    empty pages and for pages without main text. A column of that name is replaced; repeated rows pass row by row."""
    model = model or train(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def of(sources: pa.Array) -> pa.Array:
        return pa.array([main_text(s, shared.value) for s in sources.to_pylist()], pa.string())

    return pages.withColumn(into, of(F.col(page_html).cast("string")))

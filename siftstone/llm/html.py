"""Main text of web pages by a tree-structured graphical model.

The block-level elements of a page are binary variables (content or not) on the
DOM tree. Each has a potential from its tag, names, text and links; each edge a
potential over the labels of parent and child, by the kind of child. Messages
pass upward and downward once, which gives every node's exact marginal. The
weights maximise the likelihood of labelled pages; its gradient comes from the
same two passes.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_texts
from .html_pages import Part, labelled_page, page_html

#: HTML's own element classes: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Their text isn't shown.
HIDDEN = frozenset("template svg object canvas audio video select annotation annotation-xml".split())
FOREIGN = frozenset(("svg", "math"))
#: Start tags that end an svg or math element.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("ul ol dl table html body article section div td th".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    attributes: str
    parent: int
    #: Characters of text of its own, of them in links, and the same with what is below.
    own: int = 0
    linked: int = 0
    marks: int = 0
    total: int = 0
    total_linked: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: Texts in page order: (node, text), one for each block.
    blocks: list[tuple[int, str]] = field(default_factory=list)


class _Open:
    """The open elements but for inline ones, which only count in the element they are in.

    Where each tag is open is known, so that no tag searches the whole stack: the
    work is linear in the page, however its tags are nested.
    """

    def __init__(self):
        self.tags, self.nodes, self.inline = ["#page"], [0], [{}]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        self.links = self.hidden = self.foreign = 0

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in SCOPES:
            self.scopes.append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)
        self.inline.append({})
        self._count(tag, 1)

    def _count(self, tag: str, n: int) -> None:
        self.links += n * (tag == "a")
        self.hidden += n * (tag in HIDDEN)
        self.foreign += n * (tag in FOREIGN)

    def drop(self, index: int) -> None:
        """Ends the element at ``index`` and all inside it."""
        while len(self.tags) > index:
            tag = self.tags.pop()
            self.at[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag not in INLINE:
                self.blocks.pop()
            self._count(tag, -1)
            self.nodes.pop()
            self.links -= self.inline.pop().get("a", 0)

    def begin_inline(self, tag: str) -> None:
        self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        self.links += tag == "a"

    def end_inline(self, tag: str) -> bool:
        """Whether an inline element of that tag was open in the innermost element; it is closed."""
        n = self.inline[-1].get(tag, 0)
        if n:
            self.inline[-1][tag] = n - 1
            self.links -= tag == "a"
        return n > 0

    def last(self, *tags: str) -> int:
        """Where the innermost element of one of the tags is open; 0 if none is."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(source: str) -> Page:
    """The tree of block-level elements and the texts of their blocks. Lenient: what isn't closed ends with its parent."""
    page = Page([Node("#page", "", -1)])
    nodes, open_ = page.nodes, _Open()
    pieces: list[str] = []
    at, end = 0, len(source)
    last: dict[str, int] = {}

    def ends(tag: str) -> bool:
        """Whether an end tag is still to come."""
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>]|$)", source, re.I)), default=-1)
        return last[tag] >= at

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = nodes[open_.nodes[-1]]
                page.blocks.append((open_.nodes[-1], text))
                node.own += len(text)
                node.marks += text.count(",") + text.count(". ")
            pieces.clear()

    def close(index: int) -> None:
        flush()
        open_.drop(index)

    def add(raw: str) -> None:
        if open_.hidden:
            return
        pieces.append(entities.unescape(raw) if "&" in raw else raw)
        if open_.links > 0:
            nodes[open_.nodes[-1]].linked += len(raw)

    while at < end:
        found = _TOKEN.search(source, at)
        if found is None:
            add(source[at:])
            break
        if found.start() > at:
            add(source[at : found.start()])
        at = found.end()
        slash, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag in INLINE and open_.end_inline(tag):
                continue
            i = open_.last(tag)
            if i and (tag not in INLINE or not open_.blocks or open_.blocks[-1] < i):  # an inline end tag doesn't end blocks
                if open_.nodes[i] == open_.nodes[i - 1]:  # it has no node of its own
                    open_.drop(i)
                else:
                    close(i)
            continue
        if tag in RAW or (tag == "head" and ("head" not in last or last["head"] >= at)):
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)" if tag != "head" else r"</head\s*>|(?=<body)", re.I).search(source, at)
            if stop is None and tag == "head":
                last["head"] = -1
                continue
            at = end if stop is None else stop.end()
            pieces.append(" ")
            continue
        if tag == "head":
            continue
        if open_.foreign and tag in BREAKOUT and (i := open_.last(*FOREIGN)) > open_.last("foreignobject"):
            open_.drop(i)
        if tag in HIDDEN or tag == "math" or open_.hidden or open_.foreign:
            # Part of its block's text, if shown. What never ends holds nothing.
            pieces.append(" " if tag in HIDDEN else "")
            if tag not in VOID and not attributes.endswith("/") and (tag not in HIDDEN or ends(tag)):
                open_.push(tag, open_.nodes[-1])
            continue
        if tag in VOID or tag in INLINE:
            if tag in VOID:
                if tag == "hr":
                    flush()
                pieces.append(" " if tag in ("br", "img", "input", "hr") else "")
            elif not attributes.endswith("/"):
                open_.begin_inline(tag)
            continue
        ended = [*CLOSED_BY.get(tag, ()), *(("p",) if tag in CLOSES_P else ())]
        i = open_.last(*ended)
        if i and i >= (open_.scopes[-1] if open_.scopes else 0):
            close(i)
        flush()
        nodes.append(Node(tag, attributes, open_.nodes[-1]))
        if not attributes.endswith("/"):
            open_.push(tag, len(nodes) - 1)
    close(1)
    flush()
    for n in reversed(nodes):
        n.total += n.own
        n.total_linked += min(n.linked, n.own)
        if n.parent >= 0:
            nodes[n.parent].total += n.total
            nodes[n.parent].total_linked += n.total_linked
    return page


def _features(nodes: list[Node], i: int) -> list[str]:
    n = nodes[i]
    parent = nodes[n.parent].tag if n.parent >= 0 else ""
    out = ["bias", f"t:{n.tag}", f"u:{parent}>{n.tag}", f"s:{n.total.bit_length()}"]
    if n.attributes:
        names = {w for m in _NAMES.finditer(n.attributes) for w in _WORD.findall(m.group(1).lower())}
        out += [f"c:{w}" for w in sorted(names)]
    if n.total:
        out.append(f"d:{4 * n.total_linked // n.total}:{min(n.total.bit_length(), 8)}")
    if n.own:
        out += [f"l:{n.own.bit_length()}", f"m:{min(n.marks, 8)}"]
    return out


#: Kinds of child that have edge potentials of their own.
def _kind(n: Node) -> int:
    return 0 if n.tag in ("p", "li", "tr", "td", "th", "dt", "dd", "ul", "ol", "dl", "table", "tbody", "blockquote", "pre", "figure", "figcaption") else 1 if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 2


def _share(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


@dataclass
class ContentModel:
    weights: dict[str, float] = field(default_factory=dict)
    #: For each kind of child, log potentials [parent label][child label].
    edges: list[list[list[float]]] = field(default_factory=lambda: [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)])

    def unary(self, page: Page) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in _features(page.nodes, i)]) for i in range(len(page.nodes))]

    def passes(self, page: Page) -> tuple[list[float], list[float], list[float]]:
        """Log-odds of each node's marginal, each node's upward message, and its log-odds without what its children say."""
        nodes = page.nodes
        own = self.unary(page)
        belief, up = list(own), [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
            e, b = self.edges[_kind(nodes[i])], belief[i]
            up[i] = _share(e[1][1] + b, e[1][0]) - _share(e[0][1] + b, e[0][0])
            belief[nodes[i].parent] += up[i]
        below = list(belief)
        for i in range(1, len(nodes)):
            e, b = self.edges[_kind(nodes[i])], belief[nodes[i].parent] - up[i]
            belief[i] += _share(e[1][1] + b, e[0][1]) - _share(e[1][0] + b, e[0][0])
        return belief, up, below

    def marginals(self, page: Page) -> list[float]:
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in self.passes(page)[0]]

    def edge_marginals(self, page: Page):
        """For each node but the root: probabilities of [parent label][own label]."""
        belief, up, below = self.passes(page)
        for i in range(1, len(page.nodes)):
            e, b = self.edges[_kind(page.nodes[i])], belief[page.nodes[i].parent] - up[i]
            logs = [[e[p][c] + p * b + c * below[i] for c in (0, 1)] for p in (0, 1)]
            top = max(map(max, logs))
            raw = [[math.exp(v - top) for v in row] for row in logs]
            total = sum(map(sum, raw))
            yield i, [[v / total for v in row] for row in raw]


def _labels(part: Part, out: list[int]) -> None:
    """Labels of block-level parts in page order, which is the order of the parsed nodes."""
    if part[0] not in INLINE and part[0] not in VOID:
        out.append(part[2])
    for child in part[3]:
        if not isinstance(child, str):
            _labels(child, out)


def fit(pages: list[Part], epochs: int = 6, rate: float = 0.3, shrink: float = 1e-4) -> ContentModel:
    """Maximum likelihood by stochastic gradient with AdaGrad steps."""
    model = ContentModel()
    examples = []
    for part in pages:
        page, labels = parse(page_html(part)), []
        _labels(part, labels)
        if len(labels) == len(page.nodes):
            examples.append((page, labels, [_features(page.nodes, i) for i in range(len(labels))]))
    squares: dict = {}

    def step(key, gradient: float) -> float:
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        return rate * gradient / math.sqrt(squares[key])

    for _ in range(epochs):
        for page, labels, features in examples:
            near = model.marginals(page)
            both = list(model.edge_marginals(page))
            moves: dict[str, float] = {}
            for label, p, fs in zip(labels, near, features, strict=True):
                for f in fs:
                    moves[f] = moves.get(f, 0.0) + label - p
            for f, g in moves.items():
                w = model.weights.get(f, 0.0)
                model.weights[f] = w + step(f, g - shrink * w)
            turns: dict[tuple[int, int, int], float] = {}
            for i, p in both:
                kind, a, b = _kind(page.nodes[i]), labels[page.nodes[i].parent], labels[i]
                for x in (0, 1):
                    for y in (0, 1):
                        turns[kind, x, y] = turns.get((kind, x, y), 0.0) + ((x, y) == (a, b)) - p[x][y]
            for (kind, x, y), g in turns.items():
                model.edges[kind][x][y] += step((kind, x, y), g)
    return model


@cache
def default_model(pages: int = 400) -> ContentModel:
    """Trained on ``pages`` labelled example pages."""
    return fit([labelled_page(seed) for seed in range(pages)])


def main_text(source: str, model: ContentModel) -> str:
    """Blocks whose node is content with a marginal of a half or more, in page order, one to a line."""
    page = parse(source)
    near = model.marginals(page)
    return "\n".join(text for node, text in page.blocks if near[node] >= 0.5)


def extract(pages: DataFrame, carry: list[str], html_col: str = "html", model: ContentModel | None = None) -> DataFrame:
    """The columns ``carry``, ``text`` and ``n_chars`` (code points) for every row, from its whole html.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed. Null or empty html, and pages
    without content, give an empty text. Cut-off pages are read as far as they
    go. Rows that repeat are extracted each. An empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # the weights of some hundred names

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        m = shared.value

        def run(texts: pa.Array) -> list[pa.Array]:
            out = [main_text(t.as_py(), m) for t in texts]
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return run

    return map_texts(pages, html_col, carry, [("text", "string"), ("n_chars", "long")], make)

"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier (page_model.py) gives every block a probability of being content,
from its text, links, element, nearest landmark and container names; the negative logarithms are the costs of either
label and the capacities to the two terminals. Blocks that follow each other, and blocks with the same parent, the last
one and the last of the same element, are tied by smoothness edges: the log-odds that such blocks agree, which weaken
with their distance in the DOM. All edges of a block together hold at most HELD, so that what stands around it decides
on a block only where the classifier is not sure. The minimum cut between the terminals is the labelling of least total
cost; the blocks on the content side are kept.

Markup is read as browsers do where it matters: elements close implicitly, a tag cut off by the end of the page
is dropped, a bare ``<`` is text, comments, scripts and styles are skipped, character references are decoded.
Inline elements do not break a block; ``br`` and table cells count as white space in it. In a tag a quote opens a value
only behind ``=``, so a stray apostrophe does not swallow what follows.

Edge cases: a null or empty html, or one without content, gives an empty text. Repeated rows have a row each,
alike. Very long pages are read whole; time is linear in the markup, however deep it is, and the cut's graph has three
edges a block at most.
An empty table gives an empty result. Input columns but the id, url and html are not carried.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.page_model import FAR, SUREST, fitted

Model = tuple[Sequence[float], Sequence[float]]
#: Costs are whole numbers: so many to one unit of log-odds. An edge has EDGE of its log-odds, as a block has two to four,
#: and a block's edges HELD of them at most: what a probability of 0.83 has.
SCALE, EDGE, HELD = 1000, 0.7, 1.6
#: What a container's names still say one level deeper.
FADING = 0.8
PROSE, HEADINGS, LISTED = frozenset("p blockquote pre figcaption dd td".split()), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("tr td th caption dt dd address".split())
TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<odd>[!?][^>]*(?:>|\Z))|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?>[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?P<end>>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SKIPPED = frozenset("script style noscript template svg math iframe object head title select textarea button datalist audio video canvas".split())
#: Of these, the content is not markup; only their own end tag ends them.
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
    "blockquote pre figure figcaption form fieldset legend details summary address hr menu dialog center option".split()
)
SPACED = frozenset("br td th img".split())
CLOSES_P = BLOCK - {"html", "body", "option", "legend", "caption", "thead", "tbody", "tfoot", "tr", "summary", "figcaption"}
NOT_P, LISTS = BLOCK - {"p"}, frozenset(("ul", "ol", "dl", "table", "menu"))
AWAY = frozenset("nav aside footer form fieldset menu dialog address".split())
HOME = frozenset("article main".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead sidebar side aside widget related recommended share sharing social comment comments reply replies disqus discussion "
    "cookie cookies consent notice notices alert disclaimer copyright legal newsletter subscribe subscription signup login search form popup modal "
    "toolbar pagination pager tags skip sitemap".split()
)
GOOD_NAMES = frozenset("article content entry post story body text main".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
WORD = re.compile(r"[A-Za-z]+")


@dataclass(eq=False)
class _Open:
    """An open element; ``place`` is its nearest landmark, ``names`` what it and its containers are called: 1 bad, -1 good."""

    tag: str
    parent: _Open | None = None
    place: str = ""
    names: float = 0.0
    depth: int = 0


@dataclass
class Block:
    text: str
    node: _Open
    link_share: float

    @property
    def own(self) -> str:
        return self.node.tag

    @property
    def place(self) -> str:
        return self.node.place

    @property
    def names(self) -> float:
        return self.node.names


def _opened(tag: str, attributes: str, parent: _Open) -> _Open:
    place, carried = parent.place, FADING * parent.names
    if tag in ("html", "body"):
        return _Open(tag, parent, depth=parent.depth + 1)  # names of the whole page say nothing on a part of it
    words: list[str] = []
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if kind.lower() != "role":
            words += WORD.findall(value)
        elif BAD_ROLES & set(value.split()):
            place = "away"
    own = sum((w in BAD_NAMES) - (w in GOOD_NAMES) for w in words) / len(words) if words else 0.0
    if tag in HOME:
        # An article in an article, or in what is called comments, may be a reader's.
        carried = carried if place == "home" or (tag == "article" and carried >= 0.5) else 0.0
        place = "home"
    elif tag in AWAY and not (tag == "address" and place == "home"):  # an article may tell an address
        place = "away"
    elif tag == "header":
        place = "home header" if place == "home" else "away"
    return _Open(tag, parent, place, own if abs(own) >= abs(carried) else carried, parent.depth + 1)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in page order, with what the classifier looks at."""
    root = _Open("")
    stack: list[_Open] = []
    opened: Counter = Counter()  # open elements by tag, so that an end tag without a beginning is no search
    out: list[Block] = []
    parts: list[str] = []
    linked = at = 0
    in_link = False

    def close(k: int) -> None:
        for o in stack[k:]:
            opened[o.tag] -= 1
        del stack[k:]

    def close_last(ends: set[str], barriers: frozenset[str]) -> None:
        if any(opened[t] for t in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    close(k)
                    return
                if stack[k].tag in barriers:
                    return

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, stack[-1] if stack else root, min(1.0, linked / len(text))))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        tag = TAG.match(page, lt)
        if not tag:
            say("<")
            at = lt + 1
            continue
        at = tag.end()
        if tag["name"] is None or not tag["end"]:
            continue
        name = tag["name"].lower()
        if tag["close"]:
            if name == "a":
                in_link = False
            elif name in SPACED:
                parts.append(" ") if parts else None
            elif name in BLOCK:
                flush()
                close_last({name}, frozenset())
            continue
        if name in SKIPPED:
            if not tag["attrs"].rstrip().endswith("/"):
                at = _skip(page, at, name)
            continue
        if name == "a":
            in_link = True
        elif name in SPACED:
            parts.append(" ") if parts else None
        elif name in BLOCK:
            flush()
            if name in CLOSES_P:
                close_last({"p"}, NOT_P)
            if name in ("li", "dt", "dd", "tr", "option"):
                close_last({"dt", "dd"} if name in ("dt", "dd") else {name}, LISTS)
            if name not in VOID:
                stack.append(_opened(name, tag["attrs"], stack[-1] if stack else root))
                opened[name] += 1
    flush()
    return out


def _skip(page: str, at: int, name: str) -> int:
    """Behind the end tag of an element that is skipped; nested ones of the same name count where markup does."""
    depth, tags = 1, re.compile(rf"<(/?){name}\b[^>]*>", re.I)
    for tag in tags.finditer(page, at):
        depth += -1 if tag[1] else 0 if name in RAW else 1
        if depth == 0:
            return tag.end()
    # Never closed: a head ends where the body begins, others at the page's end.
    body = re.compile(r"<body\b", re.I).search(page, at) if name == "head" else None
    return body.start() if body else len(page)


def features(blocks: list[Block]) -> list[list[float]]:
    """What the classifier looks at: text, links, own element, nearest landmark, names, place in the page."""
    out, n = [], len(blocks)
    for k, b in enumerate(blocks):
        size = len(b.text)
        ends = sum(b.text.count(c) for c in ".!?")
        heading = b.own in HEADINGS
        home = b.place.startswith("home")
        out.append([
            1.0, min(1.0, math.log1p(size) / 6), min(1.0, 20 * ends / (size + 1)), 1.0 if b.text[-1] in ".!?:" else 0.0, b.link_share, 1.0 if b.own in PROSE else 0.0, 1.0 if heading else 0.0,
            1.0 if b.own == "li" else 0.0, 1.0 if b.own in LISTED else 0.0, 1.0 if home else 0.0, 1.0 if b.place == "away" else 0.0, b.link_share if home else 0.0, max(0.0, b.names), max(0.0, -b.names), 0.0 if home else abs(2 * (k + 0.5) / n - 1),
        ])
    return out


def terminal_costs(blocks: list[Block], weights: Sequence[float]) -> tuple[list[int], list[int]]:
    """(costs of calling each boilerplate, costs of calling it content): minus the logarithm of the classifier's probability."""
    content, boilerplate = [], []
    for row in features(blocks):
        z = sum(w * x for w, x in zip(weights, row, strict=True))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        p = min(SUREST, max(1 - SUREST, p))
        content.append(round(-SCALE * math.log(1 - p)))
        boilerplate.append(round(-SCALE * math.log(p)))
    return content, boilerplate


def dom_distance(a: Block, b: Block) -> int:
    """Steps between two blocks' elements in the DOM, up to FAR."""
    x, y, steps = a.node, b.node, 0
    while x is not y and steps < FAR:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return steps


def neighbours(blocks: list[Block]) -> list[tuple[int, int]]:
    """Blocks that follow each other; with the same parent, the last one and the last of the same element, past what stands between."""
    found, last_of, last_like = set(), {}, {}
    for k, block in enumerate(blocks):
        if k:
            found.add((k - 1, k))
        parent = id(block.node.parent)
        for last, key in ((last_of, parent), (last_like, (parent, block.own))):
            if key in last:
                found.add((last[key], k))
            last[key] = k
    return sorted(found)


def edges_of(blocks: list[Block], agree: Sequence[float]) -> list[tuple[int, int, int]]:
    """(a, b, capacity) of neighbouring blocks; those of a block are scaled down to HELD where they exceed it together."""
    found = [(a, b, EDGE * agree[dom_distance(blocks[a], blocks[b])]) for a, b in neighbours(blocks)]
    total: dict[int, float] = defaultdict(float)
    for a, b, weight in found:
        total[a] += weight
        total[b] += weight
    return [(a, b, int(SCALE * weight * min(1.0, HELD / max(HELD, total[a]), HELD / max(HELD, total[b])))) for a, b, weight in found]


def minimum_cut(content: list[int], boilerplate: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes on the content side. Dinic's maximum flow; the residual's reach from the source is the side."""
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k in range(n):
        both = min(content[k], boilerplate[k])  # flows straight through
        if content[k] > both:
            link(source, k, content[k] - both, 0)
        elif boilerplate[k] > both:
            link(k, sink, boilerplate[k] - both, 0)
    for a, b, capacity in edges:
        if capacity:
            link(a, b, capacity, capacity)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while following[a] < len(out[a]):
                e = out[a][following[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                following[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                following[a] += 1


def main_blocks(page: str, model: Model | None = None) -> list[Block]:
    weights, agree = model or fitted()
    blocks = blocks_of(page)
    content, boilerplate = terminal_costs(blocks, weights)
    side = minimum_cut(content, boilerplate, edges_of(blocks, agree))
    return [b for b, kept in zip(blocks, side, strict=True) if kept]


def main_text(page: str | None, model: Model | None = None) -> str:
    return "\n".join(b.text for b in main_blocks(page or "", model))


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per page, from its whole html."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = base.schema["page_id"].dataType.simpleString()
    return base.mapInArrow(_extract(fitted()), f"page_id {kind}, url string, text string, n_chars long")

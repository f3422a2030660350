"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A linear classifier over a block's tag, its containers, its links
and its length gives a score; a positive one is the capacity from the content terminal, a negative one that to the
boilerplate terminal. Smoothness edges join blocks that follow each other, the more firmly the closer they are in the
document tree, and blocks with one parent. The blocks on the content side of a minimum cut are the main text.

A class, id or role that names a part outside the article (``sidebar``, ``share``) counts for what it wraps, unless that is
the page itself: an element that holds all articles of the page, or most of its text, is a wrapper whatever it is called.
Formulas, fallback texts of media and text in drawings are read like any inline text.

Defined results: null and empty pages, and pages without content, give an empty text. Broken markup is read as browsers
do it as far as needed: missing end tags are implied, an open comment or script runs to the end, stray signs are text. Of
equal cuts the one with the fewest content blocks is taken. Repeated pages each get a result; a page of any length is read
whole and in one pass. Empty tables give empty results. Other columns are carried only as keys.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements by their part in the layout of a page.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea annotation annotation-xml".split())
RAW_IN_DRAWINGS = frozenset("title desc metadata defs".split())
LEFT_OUT = frozenset("nav footer aside dialog menu search button select fieldset label input option head title".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an element's end is implied by.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
            "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
            "head": {"body"}}
SCOPES = frozenset("table ul ol dl".split())
# Words in class, id and role that name a part of the page outside its article.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline cookie cookies consent "
    "complementary contentinfo copyright disclaimer footer gdpr header login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notification overlay pager pagination popup privacy promo promotion recommended "
    "related search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget "
    "widgets".split())
STORY = frozenset("article entry main post story".split())
# First words of a class that says how a page is laid out, not what an element is.
SWITCHES = frozenset("has with without no is not".split())
REPLIES = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
NAME = re.compile(r"[a-z][^\s/>]*", re.I)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FULL = 10  # words that make a block prose
STOP = re.compile(r"""["'>]""")


@dataclass
class Weights:
    """The classifier and the smoothness of neighbours.

    The classifier's weights are those that ``fitted`` gives for the pages at sf0.1, whose article is known, and ten copies
    of the pages in ``tests/llm/test_html.py``, drawn to PRIOR by 20 observations of each trait.
    """

    main: float = 4.03
    linked_main: float = -0.48
    outside: float = -7.71
    replies: float = -8.03
    prose: float = 1.45
    heading: float = 0.86
    brief: float = 0.73
    linked: float = -2.19
    item: float = -0.34
    siblings: float = 0.6
    cousins: float = 0.3
    strangers: float = 0.1
    kin: float = 0.4


@dataclass
class Element:
    tag: str
    key: int
    main: bool = False
    outside: bool = False
    marks: tuple[int, ...] = ()  # elements around it, itself included, whose names put them outside the article
    replies: tuple[int, ...] = ()  # those whose names make them comments


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    parent: int
    above: int
    main: bool
    outside: bool
    marks: tuple[int, ...]
    replies: tuple[int, ...]


@dataclass
class Page:
    """A page while it is read."""

    stack: list[Element] = field(default_factory=lambda: [Element("", 0)])
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    linked: int = 0
    made: int = 0
    open_tags: Counter = field(default_factory=Counter)
    implied: int = 0  # open elements that another start tag may end
    mains: list[Element] = field(default_factory=list)  # the outermost articles

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(text := html.unescape(raw))
            self.linked += len(text) if self.links else 0

    def close_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            holders = list(islice((e for e in reversed(self.stack) if e.tag in BLOCKS), 3)) or [self.stack[0]]
            leaf = holders[0].tag in HEADINGS or holders[0].tag in ("p", "li")
            around = (holders[1:] if leaf else holders) or holders
            self.blocks.append(Block(text, self.linked, holders[0].tag, around[0].key, around[min(1, len(around) - 1)].key,
                                     top.main, top.outside, top.marks, top.replies))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.close_block()
            for k in range(len(self.stack) - 1, 0, -1 if self.implied else -len(self.stack)):
                if tag in ENDED_BY.get(self.stack[k].tag, ()):
                    self.pop(k)
                    break
                if self.stack[k].tag in SCOPES or self.stack[k].tag in MAIN:
                    break
        if tag in VOID:
            return
        self.made += 1
        self.stack.append(self.element(tag, attributes))
        self.open_tags[tag] += 1
        self.implied += tag in ENDED_BY
        self.links = self.open_tags["a"]

    def element(self, tag: str, attributes: str) -> Element:
        above = self.stack[-1]
        names, hidden = set(), False
        if attributes and tag not in ("html", "body"):
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    words = [[x.lower() for x in TOKEN.findall(one)] for one in value.split()]
                    names |= {x for one in words if one and one[0] not in SWITCHES for x in one}
                elif name == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                else:
                    hidden |= value.lower() in ("", "true", "hidden")
        main = above.main or tag in MAIN or tag in ("div", "section") and bool(names & STORY)
        # an article's own header holds its title, a page's header does not; outer wrappers say little about an article
        fresh = tag in MAIN and not above.main
        outside = (above.outside and not fresh) or tag in LEFT_OUT or hidden or tag == "header" and not main
        named = names & PARTS - ({"header"} if main else set())
        marked = tag == "form" or bool(named) and tag not in MAIN
        own = (self.made,)
        made = Element(tag, self.made, main, outside, above.marks + own * marked, above.replies + own * bool(names & REPLIES))
        if fresh:
            self.mains.append(made)
        return made

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.close_block()
        for k in range(len(self.stack) - 1 if self.open_tags[tag] else 0, 0, -1):
            if self.stack[k].tag == tag:
                self.pop(k)
                return
            # an inline end tag does not end the blocks around it, a paragraph's or item's not the article
            if self.stack[k].tag in BLOCKS and (tag not in BLOCKS or tag in ("p", "li") and self.stack[k].tag in MAIN | SCOPES):
                return

    def pop(self, k: int) -> None:
        for gone in self.stack[k:]:
            self.open_tags[gone.tag] -= 1
            self.implied -= gone.tag in ENDED_BY
        self.links = self.open_tags["a"]
        del self.stack[k:]


def _wrappers(page: Page) -> set[int]:
    """Named elements that are the page rather than a part of it.

    Such an element holds every outermost article, or nearly all text, or in several blocks more than half of it. One
    named after comments is a wrapper only if the page's title or main element is in it: comments can outgrow an article.
    """
    counted = [b for b in page.blocks if not b.outside and not b.replies]
    prose = [max(len(b.text) - b.linked, 0) for b in counted]
    total, held, number = sum(prose), Counter(), Counter()
    for block, size in zip(counted, prose, strict=True):
        for mark in block.marks:
            held[mark] += size
            number[mark] += 1
    articles = Counter(m for e in page.mains for m in e.marks)
    found = {m for m, n in articles.items() if n == len(page.mains)}
    found |= {m for m, size in held.items() if size > 0.9 * total or size > 0.5 * total and number[m] > 1}
    for block in page.blocks:
        if block.tag == "h1":
            found.update(block.replies)
    for element in page.mains:
        if element.tag == "main":
            found.update(element.replies)
    return found


def blocks(page: str) -> list[Block]:
    """All blocks of a page in order, marked as outside or as comments by elements that are not wrappers. Each sign of the page is looked at a bounded number of times."""
    out, at, size = Page(), 0, len(page)
    lost: set[str] = set()  # ends that do not come any more
    lower = page.lower() if len(page.lower()) == size else "".join(c.lower() if c.isascii() else c for c in page)

    def find(what: str, start: int) -> int:
        place = -1 if what in lost else lower.find(what, start)
        if place < 0:
            lost.add(what)
        return place

    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            out.text(page[at:])
            break
        out.text(page[at:sign])
        if page.startswith("<!--", sign):
            stop = find("-->", sign + 4)
            at = size if stop < 0 else stop + 3
            continue
        closing = page.startswith("</", sign)
        name = NAME.match(page, sign + 1 + closing)
        if not name and not page.startswith(("<!", "<?"), sign):
            out.text("<")
            at = sign + 1
            continue
        stop, here = -1, name.end() if name else sign + 1
        while found := STOP.search(page, here):
            if found[0] == ">":
                stop = found.start()
                break
            ends = find(found[0], found.end()) if page[found.start() - 1] == "=" or page[found.start() - 1].isspace() else -2
            here = ends + 1 if ends >= 0 else found.end()
        if stop < 0:
            # no tag ends any more: what is left is an unfinished tag
            break
        at = stop + 1
        if not name:
            continue
        tag = name[0].lower()
        if closing:
            out.end(tag)
        elif (tag in RAW or tag in RAW_IN_DRAWINGS and out.open_tags["svg"]) and page[stop - 1] != "/":
            ends = find(f"</{tag}", at)
            after = page.find(">", ends) if ends >= 0 else -1
            at = size if after < 0 else after + 1
        else:
            out.open(tag, page[name.end() : stop])
    out.close_block()
    through = _wrappers(out)
    for block in out.blocks:
        block.marks = tuple(m for m in block.marks if m not in through)
        block.replies = tuple(m for m in block.replies if m not in through)
    return out.blocks


def traits(block: Block) -> dict[str, float]:
    """What the classifier sees of a block, by the name of its weight."""
    linked = min(block.linked / max(len(block.text), 1), 1.0)
    return {
        "main": block.main, "outside": block.outside or bool(block.marks), "replies": bool(block.replies),
        "prose": min((block.text.count(" ") + 1) / FULL, 2.0), "heading": block.tag in HEADINGS, "brief": 1.0,
        "linked": linked * (not block.main), "linked_main": linked * block.main, "item": block.tag == "li"}


def score(block: Block, w: Weights) -> float:
    """Positive for content."""
    return sum(getattr(w, name) * value for name, value in traits(block).items())


PRIOR = Weights(main=2.0, linked_main=-0.5, outside=-6.0, replies=-8.0, prose=1.0, heading=0.4, brief=-0.3, linked=-2.0, item=-0.3)


def fitted(pages: Iterable[tuple[str, str]], prior: Weights = PRIOR, pull: float = 20.0) -> Weights:
    """Weights of the classifier by logistic regression on the blocks of pages whose main text is known.

    They are drawn to ``prior`` as if by ``pull`` observations of each trait, so what no page shows keeps its weight. The
    smoothness of neighbours is not fitted.
    """
    names, rows, known = list(traits(Block("x", 0, "p", 0, 0, False, False, (), ()))), [], []
    for page, text in pages:
        found = blocks(page)
        # the longest runs of equal lines are the article; a title that the page's header repeats is not
        same = SequenceMatcher(None, [b.text for b in found], text.split("\n"), autojunk=False).get_matching_blocks()
        inside = {k for run in same for k in range(run.a, run.a + run.size)}
        rows += [[float(v) for v in traits(b).values()] for b in found]
        known += [float(k in inside) for k in range(len(found))]
    x, y = np.array(rows).reshape(-1, len(names)), np.array(known)
    start = np.array([getattr(prior, n) for n in names])
    w = start.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + pull / 2 * ((w - start) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return replace(prior, **dict(zip(names, w.tolist(), strict=True)))


def edges(found: list[Block], w: Weights) -> list[tuple[int, int, float]]:
    """Smoothness between followers, and between the nearest blocks with one parent."""
    out, last = [], {}
    for k, block in enumerate(found):
        if k:
            before = found[k - 1]
            near = (w.siblings if before.parent == block.parent else
                    w.cousins if block.above in (before.above, before.parent) or before.above == block.parent else w.strangers)
            out.append((k - 1, k, near))
        if (kin := last.get(block.parent)) is not None and kin < k - 1:
            out.append((kin, k, w.kin))
        last[block.parent] = k
    return out


def source_side(scores: list[float], joined: list[tuple[int, int, float]]) -> list[bool]:
    """The nodes on the source side of the smallest minimum cut, by maximum flow along shortest residual paths.

    Scores are what is left of each node's terminal capacities once they are set off against each other.
    """
    n = len(scores)
    supply, demand = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in joined:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    tiny = 1e-9
    while True:
        # levels from all nodes with supply; a round pushes along many shortest paths
        level = [0 if s > tiny else -1 for s in supply]
        queue, goal = deque(k for k in range(n) if level[k] == 0), None
        while queue:
            k = queue.popleft()
            if goal is not None and level[k] >= goal:
                continue
            if demand[k] > tiny:
                goal = level[k]
                continue
            for m, c in room[k].items():
                if c > tiny and level[m] < 0:
                    level[m] = level[k] + 1
                    queue.append(m)
        if goal is None:
            return [x >= 0 for x in level]
        todo = [iter(list(r)) for r in room]
        for root in [k for k in range(n) if level[k] == 0]:
            path = [root]
            while path and supply[root] > tiny:
                k = path[-1]
                if demand[k] > tiny:
                    flow = min([supply[root], demand[k], *(room[a][b] for a, b in zip(path, path[1:], strict=False))])
                    supply[root] -= flow
                    demand[k] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        room[a][b] -= flow
                        room[b][a] += flow
                    path = [root]
                    todo[root] = iter(list(room[root]))
                    continue
                step = next((m for m in todo[k] if level[m] == level[k] + 1 and level[m] <= goal and room[k][m] > tiny), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)


def main_text(page: str | None, weights: Weights = Weights()) -> str:  # noqa: B008
    found = blocks(page or "")
    inside = source_side([score(b, weights) for b in found], edges(found, weights))
    return "\n".join(b.text for b, keep in zip(found, inside, strict=True) if keep)


def extracted(df: DataFrame, keys: list[str], page: str = "html", out: str = "text") -> DataFrame:
    """The keys and the main text of every page."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, T.StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x.as_py()) for x in batch.column(len(keys))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(texts, pa.string())],
                                                 names=schema.names)

    return df.select(*keys, page).mapInArrow(extract, schema)

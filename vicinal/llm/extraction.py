"""Main text of HTML pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
HIDDEN = RAW | frozenset("head select option button svg math object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: What may stand in a head; whatever else begins ends it.
METADATA = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
FOREIGN = frozenset("svg math".split())
SECTIONS = frozenset("article aside footer form header main nav section".split())
#: What a start tag closes if it is open, up to the elements that bound it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "body": ("head",)}
BOUNDS = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote td th select".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|data-main|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_SENTENCE = re.compile(r"[.!?…][\"')\]»]*(?:[\x20\x09-\x0D]|$)")


@dataclass
class Node:
    """A block of a page: an element that is not inline, with the inline ones in it."""

    tag: str
    parent: int
    names: tuple[str, ...] = ()
    label: int | None = None
    hidden: bool = False
    words: int = 0
    linked: int = 0
    sentences: int = 0
    kids: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The blocks of a page, parents first, and its texts in page order as (block, text).

    A text that begins a new piece of a block (after <br> or a block inside it)
    has a line feed before it. Broken markup is taken as browsers take it: end
    tags that match nothing are dropped, and what is open is closed as needed.
    """
    nodes, texts = [Node("#page", -1)], []
    stack: list[tuple[str, int]] = []  # open elements with the block they stand for
    open_tags: Counter[str] = Counter()
    links, at, block, fresh = 0, 0, 0, True

    def put(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        if stack and stack[-1][0] == "head" and raw.strip("\x20\x09\x0a\x0c\x0d"):
            close(("head",), BOUNDS)
        text = html.unescape(raw) if "&" in raw else raw
        node = nodes[block]
        texts.append((block, "\n" + text if fresh else text))
        fresh = False
        n = len(text.split())
        node.words += n
        node.linked += n if links else 0
        node.sentences += len(_SENTENCE.findall(text))

    def close_to(depth: int) -> None:
        nonlocal block, links, fresh
        while len(stack) > depth:
            tag, _ = stack.pop()
            open_tags[tag] -= 1
            links -= tag == "a"
            fresh = fresh or tag not in INLINE
        block = stack[-1][1] if stack else 0

    def close(tags: tuple[str, ...], bounds: frozenset[str]) -> None:
        if any(open_tags[t] for t in tags):
            found = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    found = i
                elif stack[i][0] in bounds:
                    break
            if found is not None:
                close_to(found)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        end, start = m[1], m[2]
        if end:
            tag = end.lower()
            if tag == "br":
                fresh = True
            elif open_tags[tag]:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag not in INLINE:
                fresh = True
        elif start:
            tag, attributes = start.lower(), m[3]
            if open_tags["head"] and tag not in METADATA:
                close(("head",), BOUNDS)
            if tag in VOID:
                fresh = fresh or tag not in INLINE
                continue
            if tag not in INLINE:
                close(("p",), BOUNDS)
                fresh = True
            if tag in CLOSES:
                close(CLOSES[tag], BOUNDS - {"td", "th"} if tag in ("tr", "td", "th", "thead", "tbody") else BOUNDS)
            if tag in INLINE:
                links += tag == "a"
            else:
                found = [(a.lower(), v.strip("\"'")) for a, v in _ATTRIBUTE.findall(attributes)]
                names = tuple(dict.fromkeys(n for a, v in found if a in ("class", "id", "role", "aria-label") for n in _NAME.findall(v.lower())))
                label = next((int(v == "1") for a, v in found if a == "data-main"), nodes[block].label)
                nodes.append(Node(tag, block, names, label, nodes[block].hidden or tag in HIDDEN or any(a == "hidden" for a, _ in found)))
                nodes[block].kids.append(len(nodes) - 1)
                block = len(nodes) - 1
            closed = attributes.endswith("/") and (tag in FOREIGN or any(open_tags[t] for t in FOREIGN))
            if tag in RAW and not closed:  # up to the end tag, whatever stands there
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else len(page)
                block = stack[-1][1] if stack else 0
            elif closed:
                links -= tag == "a"
                block = stack[-1][1] if stack else 0
            else:
                stack.append((tag, block))
                open_tags[tag] += 1
    return nodes, texts


def bucket(n: float, ends: tuple[float, ...]) -> int:
    return sum(n > e for e in ends)


def features(nodes: list[Node]) -> list[list[str]]:
    """What the model sees of each block: its tag, its names, what it stands in, and the words, links and sentences under it."""
    words, linked, sentences = [n.words for n in nodes], [n.linked for n in nodes], [n.sentences for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        if not nodes[i].hidden:
            words[p] += words[i]
            linked[p] += linked[i]
            sentences[p] += sentences[i]
    around: list[tuple[str, ...]] = [()]  # the names, or the telling tag, of the nearest block around that has any
    for n in nodes[1:]:
        p = nodes[n.parent]
        around.append(p.names or ((p.tag,) if p.tag in SECTIONS else around[n.parent]))
    return [
        [
            f"tag={n.tag}",
            f"words={bucket(words[i], (0, 4, 12, 40, 150))}",
            f"links={bucket(linked[i] / words[i], (0, 0.15, 0.5)) if words[i] else '-'}",
            f"sentences={bucket(sentences[i], (0, 1, 4)) if words[i] else '-'}",
            *[f"name={x}" for x in n.names],
            *[f"in={x}" for x in around[i]],
        ]
        for i, n in enumerate(nodes)
    ]


def stem(feature: str) -> str:
    """What stands in for a name that no labelled page has: how it begins."""
    kind, _, name = feature.partition("=")
    return f"{kind}~{name[:5]}" if kind in ("name", "in") and len(name) > 4 else feature


@dataclass
class Model:
    """Log potentials: of a block's features for its label, and of a child's label given its parent's."""

    unary: dict[str, tuple[float, float]]
    pair: tuple[tuple[float, float], tuple[float, float]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each block's probability of being content, by sum-product messages up to the root and down again."""
        n = len(nodes)
        own = [[0.0, 0.0] for _ in range(n)]
        for i, found in enumerate(features(nodes)):
            for f in found:
                a, b = self.unary.get(f) or self.unary.get(stem(f), (0.0, 0.0))
                own[i][0] += a
                own[i][1] += b
        low = [self._scaled(*x) for x in own]
        up = [(1.0, 1.0)] * n
        pair = self.pair
        for i in range(n - 1, 0, -1):  # children come after their parents
            a, b = low[i]
            message = self._normal(pair[0][0] * a + pair[0][1] * b, pair[1][0] * a + pair[1][1] * b)
            up[i] = message
            p = nodes[i].parent
            low[p] = self._normal(low[p][0] * message[0], low[p][1] * message[1])
        belief = low[:]
        for i in range(1, n):
            b0, b1 = belief[nodes[i].parent]
            rest0, rest1 = b0 / up[i][0], b1 / up[i][1]
            down0, down1 = pair[0][0] * rest0 + pair[1][0] * rest1, pair[0][1] * rest0 + pair[1][1] * rest1
            belief[i] = self._normal(low[i][0] * down0, low[i][1] * down1)
        return [b for _, b in belief]

    @staticmethod
    def _normal(a: float, b: float) -> tuple[float, float]:
        total = a + b
        return max(a / total, 1e-12), max(b / total, 1e-12)

    def _scaled(self, a: float, b: float) -> tuple[float, float]:
        top = max(a, b)
        return self._normal(math.exp(a - top), math.exp(b - top))


#: What a feature counts: those of a block's text say partly the same, its tag and names stand for themselves. What is around
#: a block says less than its own tag and names. Found by leaving labelled layouts out.
TEXT_WEIGHT, AROUND_WEIGHT, NAME_WEIGHT = 0.5, 0.5, 2.2


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the labelled pages: a fixed set, so it is the same everywhere."""
    return train(labelled_pages())


def train(pages: list[str]) -> Model:
    """The potentials, by smoothed counts over labelled pages."""
    seen: dict[str, list[float]] = {}
    totals, pair = [0.0, 0.0], [[1.0, 1.0], [1.0, 1.0]]
    for page in pages:
        nodes, _ = parse(page)
        for i, found in enumerate(features(nodes)):
            if nodes[i].hidden or i == 0:
                continue
            y = nodes[i].label or 0
            totals[y] += 1
            for f in dict.fromkeys([*found, *map(stem, found)]):
                seen.setdefault(f, [0.0, 0.0])[y] += 1
            pair[nodes[nodes[i].parent].label or 0][y] += 1
    weight = lambda f: NAME_WEIGHT if f.startswith(("tag", "name")) else AROUND_WEIGHT if f.startswith("in") else TEXT_WEIGHT
    unary = {f: tuple(weight(f) * math.log((c + 0.3) / (t + 0.6)) for c, t in zip(counts, totals, strict=True)) for f, counts in seen.items()}
    return Model(unary, tuple(tuple(x / sum(row) for x in row) for row in pair))


def main_text(page: str, model: Model | None = None, from_p: float = 0.5) -> str:
    """The texts of the blocks that are likelier content than not, in page order; empty if there are none."""
    nodes, texts = parse(page)
    p = (model or trained()).marginals(nodes)
    kept, last = [], None
    for block, text in texts:
        if p[block] >= from_p and not nodes[block].hidden:
            kept.append(text if last in (None, block) or text[0] == "\n" else "\n" + text)
            last = block
    return _BLANK.sub(" ", "".join(kept)).strip("\x20\x09\x0a\x0b\x0c\x0d")


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of every page, from its whole HTML.

    A null page is empty; a page without content gives an empty text. Repeated
    rows are extracted each, an empty table stays empty. Pages are worked on
    where they are, one at a time, without a shuffle. A column of the given name
    is replaced.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = trained()
        for batch in batches:
            yield pd.Series([main_text(page, model) for page in batch], dtype=object)

    return pages.withColumn(name, run(F.coalesce(F.col(html_col), F.lit(""))))

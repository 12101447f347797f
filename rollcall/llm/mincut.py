"""Main text of web pages by a minimum cut.

A page is cut into blocks. A classifier's costs of calling a block content or boilerplate become the capacities of its
edges to the two terminals; neighbours in the page get edges, and so do blocks and elements with the elements that hold them, so that it is
costly to part what is close in the DOM. The minimum cut (by maximum flow) is the cheapest labelling of the whole page.

The classifier is a logistic model over a block's text and its own tag, learned from blocks that markup gives away (within ``nav``,
``footer``, ``article`` and the like) on a bounded sample of pages. Markup itself is one more capacity. An explicit sign of boilerplate (an element made for it,
a role, hiding, a name like ``comments`` of an element that holds others) weighs more than the classifier's largest score, as sentences stand in footers and
comments, too; what is told by names alone, or by an article around it, weighs less: neither decides alone, and neighbours can overrule both.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: The next attribute's name, and whether a value follows.
NAMED = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(\s*+=\s*+)?)?+")
BARE = re.compile(r"[^\s>]*+")
TOLD = set("class id role hidden aria-hidden style".split())
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORDS = re.compile(r"\w+")

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template textarea title iframe object svg math canvas audio video button select head datalist".split())
RAW = set("script style textarea title noscript iframe template".split())
#: Opening one of these ends an open element of the second kind, up to one of the third.
IMPLIED = {
    **{t: ({"p"}, {"button", "td", "th", "caption", "table", "article", "section", "div", "main", "aside", "nav", "header", "footer", "form", "li", "blockquote", "figure", "dd", "body"}) for t in BLOCK},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
OUTSIDE = set("nav footer aside form dialog menu".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id that tell boilerplate, also around an article, and those that an article overrules.
FIRM = set("comment comments commenter discussion disqus respond reply replies ad ads adsense adbox advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe popup modal".split())
LOOSE = set("nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer foot header masthead banner notice alert share sharing social related recommended widget pagination pager toolbar login signup search legal copyright skip hidden".split())
#: Of these, heads of articles hold their titles.
HEADS = set("header masthead banner".split())
#: Words that may stand beside them in a name: parts of a page. Any other word makes the name a topic or a state.
PARTS = set("area bar block bottom box button center col column container content form global group holder inner item items left link links list main module outer page panel post posts primary right row secondary section site slot text top unit wrap wrapper zone".split())
#: Of the firm names, those of parts that hold articles of their own.
TALK = set("comment comments commenter discussion disqus respond reply replies".split())
#: What may stand in a head; anything else ends it.
HEAD = set("title base link meta style script noscript template head html".split())
#: A firm name of one of these is a word beside its own text.
INLINE = set("p h1 h2 h3 h4 h5 h6 span b i em strong a q cite li td dd dt blockquote".split())
TAGS = ("p", "h1", "h2", "h3", "h4", "div", "blockquote", "pre")
FEATURES = 14 + len(TAGS)


@dataclass
class Block:
    text: str
    tag: str
    parent: int  # number of the element that holds it
    depth: int
    seed: int  # what markup says: 1 content, -1 boilerplate, 0 nothing
    linked: int  # characters within links
    sure: bool = False  # by an explicit sign, not by a word of a class alone


@dataclass
class Open:
    tag: str
    number: int
    skipped: bool
    link: bool


class Stack:
    """The open elements, with the places of each tag, so that no lookup walks through them."""

    def __init__(self):
        self.open = [Open("", 0, False, False)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, e: Open) -> None:
        n = len(self.open)
        self.open.append(e)
        self.at.setdefault(e.tag, []).append(n)
        if e.tag in BLOCK:
            self.blocks.append(n)

    def cut(self, n: int) -> None:
        while len(self.open) > n:
            e = self.open.pop()
            self.at[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def end_implied(self, ends: set[str], until: set[str]) -> None:
        """Close what the opening of an element ends: the outermost of ``ends`` within the innermost of ``until``, and all in it."""
        places = [p for t in ends if (p := self.at.get(t))]
        if places:
            limit = max((self.last(t) for t in until), default=0)
            found = [p[bisect_right(p, limit)] for p in places if p[-1] > limit]
            if found:
                self.cut(min(found))


@dataclass
class Element:
    """What is known of an element once the page has been read."""

    tag: str
    attrs: list[tuple[str, str]]
    up: int
    size: int = 0  # characters of the blocks within it
    articles: int = 0  # articles that it is or holds
    mains: int = 0
    seed: int = 0
    firm: bool = False
    sure: bool = False


def boilerplate_names(values: list[str]) -> set[str]:
    """The boilerplate words of those classes and ids that consist of such words and names of parts of a page only."""
    found: set[str] = set()
    for v in values:
        words = {x.lower() for x in NAMES.findall(v)}
        if words and words <= FIRM | LOOSE | PARTS:
            found |= words & (FIRM | LOOSE)
    return found


def _says(tag: str, attrs: list[tuple[str, str]], up: Element, wraps: int) -> tuple[int, bool, bool]:
    """What the element's markup says of its blocks, whether that holds within an article, and whether the sign is explicit: an element made for
    such parts, a role, hiding, or a firm name of an element that holds others. Neither a form nor a firm name
    says anything of an element that ``wraps`` the main text (2), or all articles (1; but comments may be articles).
    """
    values, role, hidden = [], "", False
    for key, value in attrs:
        if key in ("class", "id"):
            values += value.split()
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    names = boilerplate_names(values)
    main, article = tag == "main" or role == "main", tag in ("article", "main") or role in ("article", "main")
    firm = bool(names & FIRM) and wraps < (2 if names & TALK else 1)
    if hidden or (tag in OUTSIDE or role in OUTSIDE_ROLES) and not (wraps and (tag == "form" or role == "form")):
        return -1, True, True
    if firm and not article and tag not in ("html", "body"):
        return -1, True, up.sure or tag not in INLINE
    if article:
        if up.seed < 0 and up.firm and not main:
            return up.seed, True, up.sure
        return (0, False, False) if firm and not main else (1, False, False)
    if up.seed < 0:
        return up.seed, up.firm, up.sure
    if tag == "header" and up.seed <= 0:
        return -1, False, False
    loose = names & LOOSE - HEADS if up.seed > 0 else names & LOOSE
    if loose and wraps < 2 and tag not in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6", "span", "b", "i", "em", "strong"):
        return -1, False, False
    return up.seed, up.firm, up.sure


def _settle(elements: list[Element], blocks: list[Block]) -> None:
    """Give the blocks what markup says, now that it is known what each element holds."""
    for b in blocks:
        elements[b.parent].size += len(b.text)
    for e in reversed(elements[1:]):
        up = elements[e.up]
        up.size, up.articles, up.mains = up.size + e.size, up.articles + e.articles, up.mains + e.mains
    root = elements[0]
    within = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        within[i] = within[e.up] or e.tag in ("article", "main")
        # It holds the main part, or most of the text or articles while no article is outside it.
        all_articles = not within[e.up] and e.articles == root.articles
        wraps = 2 if e.mains or all_articles and 2 * e.size > root.size else int(all_articles and e.articles > 0)
        e.seed, e.firm, e.sure = _says(e.tag, e.attrs, elements[e.up], wraps)
    for b in blocks:
        b.seed, b.sure = elements[b.parent].seed, elements[b.parent].sure


class Reader:
    """The tokens of a page, in one pass: each character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.plain = page, False
        # Where the last of each is: what begins behind it never ends.
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.comments = page.rfind("-->")

    def tag(self, at: int, quotes: bool) -> tuple[int, list[tuple[str, str]]] | None:
        """(end, attributes) of a tag whose name ends at ``at``; None where it has no end."""
        page, told = self.page, []
        if page[at : at + 1] == ">":
            return at + 1, told
        while True:
            m = NAMED.match(page, at)
            at, name = m.end(), m[1]
            if name is None:
                return (at + 1, told) if page[at : at + 1] == ">" else None
            value = ""
            if m[2]:
                q = page[at : at + 1]
                if quotes and q and q in "\"'" and self.last[q] > at:
                    end = page.index(q, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    end = BARE.match(page, at).end()
                    value, at = page[at:end], end
            name = name.lower()
            if name in TOLD:
                told.append((name, value))

    def tokens(self) -> Iterator[tuple[str, str, bool, list[tuple[str, str]], int]]:
        """(text, tag, whether it closes, attributes, end): either text or a tag. A place may be sent back, from which reading goes on."""
        page, at, none = self.page, 0, []
        while at < len(page):
            start = page.find("<", at)
            if start < 0:
                yield page[at:], "", False, none, len(page)
                return
            if start > at:
                yield page[at:start], "", False, none, start
            at = start
            if at > self.last[">"]:  # no tag any more
                rest = page[at:].split("<!--", 1)[0]
                if rest:
                    yield rest, "", False, none, len(page)
                return
            m = TAG.match(page, at)
            if m:
                found = self.tag(m.end(), not self.plain)
                if found is None:
                    # A quote has swallowed the page's last tag: from here on tags end at the first '>'.
                    self.plain = True
                    found = self.tag(m.end(), False) or (page.index(">", at) + 1, none)
                at = found[0]
                back = yield "", m[2].lower(), bool(m[1]), found[1], at
                if back is not None:
                    at = back
                    yield "", "", False, none, at
            elif page.startswith("<!--", at):
                if page.startswith((">", "->"), at + 4):
                    at = page.index(">", at) + 1
                else:
                    at = page.index("-->", at + 4) + 3 if self.comments >= at + 4 else len(page)
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                at = page.index(">", at) + 1
            else:
                yield "<", "", False, none, at + 1
                at += 1


def read_page(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks of text in order, with character references decoded and white space folded, and its elements. Linear in the page's length."""
    stack = Stack()
    out, part, linked = [], [], 0
    elements = [Element("", [], 0)]
    low = None

    def flush() -> None:
        nonlocal linked
        if part:
            text = SPACE.sub(" ", html.unescape("".join(part))).strip()
            part.clear()
            if text:
                holder = stack.open[stack.blocks[-1]]
                out.append(Block(text, holder.tag, holder.number, len(stack.open), 0, min(linked, len(text))))
        linked = 0

    tokens = Reader(page).tokens()
    for text, tag, ends, attrs, at in tokens:
        if text:
            if (head := stack.last("head")) and stack.open[-1].tag == "head" and not text.isspace():
                stack.cut(head)
            top = stack.open[-1]
            if not top.skipped:
                part.append(text)
                if top.link:
                    linked += len(text.strip())
            continue
        if ends:
            if depth := stack.last(tag):
                if stack.blocks[-1] >= depth:
                    flush()
                stack.cut(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag not in HEAD and (head := stack.last("head")):
            stack.cut(head)
        if tag in BLOCK or tag == "hr":
            flush()
            stack.end_implied(*IMPLIED.get(tag, ((), ())))
        if tag == "br":
            part.append(" ")
        if tag in VOID or page[at - 2] == "/" and tag not in BLOCK:
            continue
        up = stack.open[-1]
        elements.append(Element(tag, attrs, up.number, articles=tag == "article", mains=tag == "main"))
        if tag in RAW:
            if low is None:
                low = page.lower()
            end = low.find(f"</{tag}", at) if len(low) == len(page) else next((x.start() for x in re.compile(f"</{tag}", re.I).finditer(page, at)), -1)
            tokens.send(len(page) if end < 0 else (page.find(">", end) + 1 or len(page)))
            continue
        stack.push(Open(tag, len(elements) - 1, up.skipped or tag in SKIPPED, up.link or tag == "a"))
    flush()
    _settle(elements, out)
    return out, elements


def blocks_of(page: str) -> list[Block]:
    return read_page(page)[0]


def describe(blocks: list[Block]) -> np.ndarray:
    """A row of numbers for each block; none of what its ancestors' markup says."""
    x = np.zeros((len(blocks), FEATURES))
    for i, b in enumerate(blocks):
        t, words = b.text, len(WORDS.findall(b.text))
        n = max(1, len(t))
        x[i, :14] = (
            1, math.log1p(words) / 3, b.linked / n, words <= 3, words >= 20, t[-1] in ".!?…:;\"'”»", min(1, 10 * sum(map(t.count, ".,;:!?")) / n), sum(map(str.isdigit, t)) / n,
            any(c in t for c in "©|•»›"), t.isupper(), i / len(blocks), min(b.depth, 20) / 20, i > 0 and blocks[i - 1].parent == b.parent, min(1, n / 500),
        )
        if b.tag in TAGS:
            x[i, 14 + TAGS.index(b.tag)] = 1
    return x


#: Where no markup gives anything away: long blocks of sentences are content, short and linked ones aren't.
START = np.zeros(FEATURES)
START[[0, 1, 2, 3, 4, 5, 6, 8, 14, 15, 16]] = -1.0, 1.3, -3.0, -0.5, 1.0, 0.8, 0.8, -1.0, 0.3, 1.0, 1.0


def train(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.3, l2: float = 0.01) -> np.ndarray:
    """Logistic regression with both classes of equal weight, held near ``START``."""
    w = START.copy()
    if not len(y) or y.all() or not y.any():
        return w
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * ((weight * (p - y)) @ x + l2 * (w - START))
    return w


@dataclass
class Graph:
    """Maximum flow by Dinic's method, in whole numbers."""

    nodes: int
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.out = [[] for _ in range(self.nodes)]

    def edge(self, a: int, b: int, there: int, back: int = 0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def reach(self, source: int) -> list[int]:
        level = [-1] * self.nodes
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def flow(self, source: int, sink: int) -> int:
        total = 0
        while (level := self.reach(source))[sink] >= 0:
            tried = [0] * self.nodes
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    least = min(self.room[e] for e in path)
                    total += least
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while tried[a] < len(self.out[a]):
                    e = self.out[a][tried[a]]
                    if self.room[e] and level[self.to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(self.out[a]):
                    path.append(self.out[a][tried[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break
        return total


def edges_of(blocks: list[Block], elements: list[Element], near: float, kin: float, up: float, scale: int) -> tuple[int, dict[tuple[int, int], int]]:
    """The number of nodes (blocks, then elements that hold several of these) and the edges: neighbours in the page (closer if of one
    parent), blocks with the element that holds them, elements with the one around them.
    """
    edges: dict[tuple[int, int], int] = {}
    inside: list[list[int]] = [[] for _ in elements]
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = round(scale * near * (1.5 if abs(blocks[i - 1].parent - b.parent) <= 1 else 1))
        inside[b.parent].append(i)
    n = len(blocks)
    for k in range(len(elements) - 1, -1, -1):
        held = inside[k]
        if not held:
            continue
        node = held[0]
        if len(held) > 1:  # an element with one node is that node
            node, n = n, n + 1
            for i in held:
                edges[i, node] = round(scale * (kin if i < len(blocks) else up))
        if k:
            inside[elements[k].up].append(node)
    return n, edges


def cut(gain: list[int], edges: dict[tuple[int, int], int], settle_above: int = 500) -> list[bool]:
    """Which nodes are content: the labelling of least cost, where ``gain`` (positive: for content) is lost by the other label and
    an edge is lost if its ends differ; of equally cheap ones, that with least content.

    Of more than ``settle_above`` nodes those whose gain outweighs all their edges are settled first, their edges adding to
    their neighbours' gains. That leaves the same cut and a smaller graph.
    """
    n = len(gain)
    gain = list(gain)
    mates: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        mates[a][b] = mates[a].get(b, 0) + c
        mates[b][a] = mates[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n) if n > settle_above else ())
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(gain[i]) > sum(mates[i].values()):
            label[i] = gain[i] > 0
            for j, c in mates[i].items():
                gain[j] += c if label[i] else -c
                del mates[j][i]
                queue.append(j)
            mates[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        g = Graph(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i in rest:
            if gain[i]:
                g.edge(s, at[i], gain[i]) if gain[i] > 0 else g.edge(at[i], t, -gain[i])
            for j, c in mates[i].items():
                if i < j:
                    g.edge(at[i], at[j], c, c)
        g.flow(s, t)
        level = g.reach(s)
        for i in rest:
            label[i] = level[at[i]] >= 0
    return label  # type: ignore[return-value]


def gains(blocks: list[Block], weights: np.ndarray, most: float = 3.0, markup: float = 2.0, explicit: float = 8.0) -> np.ndarray:
    """What each block gains by being content: the classifier's score, at most ``most`` either way, and what markup says: less than that by names, more by an explicit sign."""
    return np.clip(describe(blocks) @ weights, -most, most) + np.array([b.seed * (explicit if b.sure else markup) for b in blocks])


def main_text(page: str, weights: np.ndarray, near: float = 0.6, kin: float = 0.8, up: float = 0.3, scale: int = 1000) -> str:
    blocks, elements = read_page(page)
    if not blocks:
        return ""
    n, edges = edges_of(blocks, elements, near, kin, up, scale)
    gain = [round(scale * g) for g in gains(blocks, weights).tolist()]
    label = cut(gain + [0] * (n - len(gain)), edges)
    return "\n".join(b.text for b, yes in zip(blocks, label, strict=False) if yes)


def learn(df: DataFrame, html_col: str = "html", keys: Column | None = None, pages: int = 300, blocks: int = 200) -> np.ndarray:
    """Learn from about so many pages (a hash of ``keys`` chooses) and at most so many blocks of each, spread over the page."""
    rows = df.filter(F.col(html_col).isNotNull())
    top = 1 << 30
    share = int(top * min(1.0, pages / max(1, rows.count())))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(41), keys if keys is not None else F.col(html_col)), F.lit(top)) < share).select(F.col(html_col).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, col in text_slices(batches, "h"):
            x, y = [], []
            for page in col.to_pylist():
                found = blocks_of(page)
                rows = describe(found)
                for i in range(0, len(found), max(1, len(found) // blocks)):
                    if found[i].seed:
                        x.append(rows[i].tobytes())
                        y.append(found[i].seed > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.bool_())], names=["x", "y"])

    got = sorted((bytes(r.x), r.y) for r in sample.mapInArrow(run, "x binary, y boolean").collect())
    x = np.frombuffer(b"".join(r for r, _ in got), np.float64).reshape(-1, FEATURES)
    return train(x, np.array([y for _, y in got], bool))


def extract(df: DataFrame, weights: np.ndarray, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry``, ``text`` (blocks in page order, one line each; '' if none) and ``n_chars``, one row per row.

    Null pages count as empty. Pages are read in a time linear in their length, however deeply they nest; repeated rows give equal results. A carried
    column named ``text`` or ``n_chars`` is left out in favour of the result's. An empty table gives no rows.
    """
    carry = [c for c in carry or [] if c not in ("text", "n_chars")]
    rows = df.select(*carry, F.col(html_col).alias("__html"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__html"]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in text_slices(batches, "__html"):
            texts = [main_text(page, weights) for page in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*carry, "text", "n_chars"])

    return rows.mapInArrow(run, schema)

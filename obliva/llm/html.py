"""Main-text extraction from HTML by tag-path ratios.

A page becomes a sequence of text blocks, each under a root-to-leaf tag path.
Text length, link text and punctuation are added up by path; the two ratios per
node are fused and smoothed over the sequence of blocks, where a neighbour
counts as far as its path is alike.  The ratios times the text say what each path
weighs: the place of the page that weighs most is the content, an article or
main element before others.  A block's value is its ratio, raised within that
place, and outside it lowered by how little of the place's path it shares and how
little it weighs.  The mean of a path's blocks is held against a threshold, and
the blocks of the paths above it are the text; a heading right before one of them goes with it.

What HTML itself declares to be something else (nav, footer, aside, form,
hidden and the like) never takes part.  Names of classes and ids lower a path's
value, unless what is so named holds most of the page's text; doubtful names
lower it so little that good ratios outweigh them.

The page is read once from left to right and every step looks at a bounded
number of nodes, so that broken or deeply nested pages cost no more than others
of their length.

Defined results: null or empty html, or a page without text, gives an empty
text; broken markup is read as far as it goes, and a tag that never ends is
text; very long pages are read whole; repeated rows are kept; columns other than
key and html pass through untouched if asked for.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obliva.llm.common import ship

#: A path whose blocks reach this value on average is content.
THRESHOLD = 0.3
#: Plain characters and punctuation marks a node at which the two ratios count half.
HALF_LENGTH, HALF_MARKS = 25.0, 0.5
#: Factors: a name that speaks against the content, one that may, and a place outside the page's article or main part.
NAMED, DOUBTFUL, OUTSIDE = 0.25, 0.4, 0.3
#: What a block has within the content besides its ratio: as much as the threshold asks for where HTML names the place, less elsewhere.
INSIDE, WITHIN = 0.5, 0.25
#: Paths outside the content that weigh less than this share of it count the less.
SHARE = 0.5

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^\"'>]*")
_ASSIGNED = re.compile(r"=\s*\Z")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript textarea title template iframe svg math canvas object audio video xmp noframes noembed".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_DROP = frozenset("nav footer aside form menu dialog button select fieldset head".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("ul ol dl table tr html body article section div main td th".split())
#: Elements that end an open one of their kind, and the elements that keep what is inside them apart.
_ITEM = {"li": "li", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option"}
_KEEPS = {"ul": ("li",), "ol": ("li",), "dl": ("term",), "table": ("row", "cell"), "tr": ("cell",), "select": ("option",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that stand for a place within the text, not for a container of it.
_PLACES = frozenset("p h1 h2 h3 h4 h5 h6 pre li ul ol dl dd dt td th tr tbody table blockquote figure".split())
#: Parts of names that speak against the content, and those that say nothing.
_AGAINST = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|nav\w*|menu|breadcrumbs?|sidebar|"
    r"widgets?|footer|copyright|masthead|topbar|toolbar|pagination|pager|share|sharing|social|comments?|commentlist|disqus|respond"
)
#: Parts of names that the article's own sections bear as well.
_DOUBTFUL = re.compile(r"related|recommend\w*|replies|reply|toc|search|header")
_OWN_HEADER = re.compile("entry|post|article|content", re.I)
_NEUTRAL = frozenset("site page post posts entry list box area wrap wrapper container section block links link items item inner outer top bottom left right global bar the of and widget group".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_MARKS = re.compile(r"[.,;:!?、。，،]")


class _Node:
    __slots__ = ("dead", "factor", "home", "items", "label", "linked", "p", "parent", "path", "plain", "tag", "weight")

    def __init__(self, tag: str, parent: _Node | None, path: int, dead: bool = False, factor: float = 1.0):
        self.tag, self.parent, self.path, self.factor = tag, parent, path, factor
        self.dead = dead or bool(parent and parent.dead)
        inline = tag in _INLINE
        self.home = parent.home if inline and parent else self
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.p = self if tag == "p" else None if tag in _SCOPE or parent is None else parent.p
        items = parent.items if parent else {}
        if tag in _ITEM or tag in _KEEPS:
            items = {k: v for k, v in items.items() if k not in _KEEPS.get(tag, ())}
            if tag in _ITEM:
                items[_ITEM[tag]] = self
        self.items = items
        self.plain, self.weight = 0, 1.0


class _Block:
    __slots__ = ("linked", "node", "parts")

    def __init__(self, node: _Node):
        self.node, self.parts, self.linked = node, [], 0


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)] if text and not text.isspace() else []


def _declared(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Whether HTML itself says that an element is other than the article."""
    if tag in _DROP or (tag == "header" and not inside):
        return True
    for name, value in attributes:
        low = value.strip().lower()
        if name == "hidden" or (name == "aria-hidden" and low == "true") or (name == "role" and low in _ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return True
    return False


def _name_factor(tag: str, attributes: list[tuple[str, str]]) -> float:
    """What a class or id leaves of a value, if it consists of words that speak against the content (and of such that say nothing)."""
    if tag in ("body", "html", "article", "main") or tag in _HEADINGS:
        return 1.0
    factor = 1.0
    for name, value in attributes:
        if name in ("class", "id"):
            for one in value.split():
                parts = [x for x in re.split(r"[-_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()) if x and x not in _NEUTRAL]
                if not parts or (parts == ["header"] and _OWN_HEADER.search(one)):
                    continue
                if all(map(_AGAINST.fullmatch, parts)):
                    factor = min(factor, NAMED)
                elif all(_AGAINST.fullmatch(x) or _DOUBTFUL.fullmatch(x) for x in parts):
                    factor = min(factor, DOUBTFUL)
    return factor


class _Paths:
    """Numbers of root-to-leaf tag paths: each is a parent's number and a label."""

    def __init__(self) -> None:
        self.of: dict[tuple[int, str], int] = {}
        self.parent, self.tag = [-1], [""]

    def step(self, parent: int, label: str, tag: str) -> int:
        at = self.of.setdefault((parent, label), len(self.parent))
        if at == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
        return at

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """1 for equal paths, a half for those of one parent or of parent and child, a tenth for all others."""
        parent = np.array(self.parent)
        near = (parent[a] == parent[b]) | (parent[a] == b) | (parent[b] == a)
        return np.where(a == b, 1.0, np.where(near, 0.5, 0.1))


def blocks(page: str) -> tuple[list[_Block], list[_Node], _Paths]:
    """Text blocks of a page in order, all its nodes in order, and its paths; sections declared to be something else give no blocks."""
    paths = _Paths()
    node = _Node("", None, 0)
    nodes, out = [node], []
    open_block: _Block | None = None
    articles = 0
    depth: dict[str, int] = {}
    missing: set[str] = set()  # what the rest of the page is known not to hold
    pos, n = 0, len(page)

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        k = page.find(what, at)
        if k < 0:
            missing.add(what)
        return k

    def tag_end(at: int) -> int:
        """Place of the > that ends a tag; -1 if none does."""
        first = at
        while at < n:
            at = _PLAIN.match(page, at).end()
            if at >= n:
                return find(">", first)
            if page[at] == ">":
                return at
            # A quote opens a value only right after an equals sign; elsewhere it is a letter like any other.
            k = find(page[at], at + 1) if _ASSIGNED.search(page, max(first, at - 64), at) else -1
            at = at + 1 if k < 0 else k + 1
        return find(">", first)

    def add(text: str) -> None:
        nonlocal open_block
        if node.dead:
            return
        if open_block is None:
            if text.isspace():
                return
            open_block = _Block(node.home)
            out.append(open_block)
        open_block.parts.append(text)
        if node.linked:
            open_block.linked += len(text)

    def leave(to: _Node) -> None:
        """Closes all open elements up to and with ``to``."""
        nonlocal node, articles
        while True:
            depth[node.tag] -= 1
            articles -= node.tag in ("article", "main")
            done = node is to
            node = node.parent
            if done:
                return

    def enter(tag: str, attributes: list[tuple[str, str]], label: str) -> None:
        nonlocal node, articles
        node = _Node(tag, node, paths.step(node.path, label, tag), _declared(tag, attributes, articles > 0), _name_factor(tag, attributes))
        nodes.append(node)
        depth[tag] = depth.get(tag, 0) + 1
        articles += tag in ("article", "main")

    while pos < n:
        start = page.find("<", pos)
        if start < 0:
            add(page[pos:])
            break
        if start > pos:
            add(page[pos:start])
        if page.startswith("<!--", start):
            k = find("-->", start + 4)
            pos = n if k < 0 else k + 3
            continue
        closing = page.startswith("</", start)
        m = _NAME.match(page, start + 1 + closing)
        if m is None and page[start + 1 : start + 2] not in ("!", "?"):
            add("<")
            pos = start + 1
            continue
        end = find(">", start) if m is None else tag_end(m.end())
        if end < 0:
            add(page[start:])
            break
        pos = end + 1
        if m is None:
            continue
        tag = m[0].lower()
        if closing:
            if tag not in _INLINE:
                open_block = None
            if depth.get(tag, 0):
                up = node
                if tag in _INLINE:
                    while up.tag in _INLINE and up.tag != tag:
                        up = up.parent
                else:
                    while up.tag != tag:
                        up = up.parent
                if up.tag == tag:
                    leave(up)
            continue
        rest = page[m.end() : end]
        if tag in _RAW:
            if tag not in ("svg", "math") or not rest.rstrip().endswith("/"):
                closed = _RAW_END[tag].search(page, pos)
                pos = closed.end() if closed else n
            continue
        if tag in _VOID:
            if tag == "hr":
                open_block = None
            elif tag == "br" and open_block is not None:
                open_block.parts.append(" ")
            continue
        attributes = _attributes(rest)
        if tag in _INLINE:
            enter(tag, attributes, tag)
            continue
        open_block = None
        if tag in _CLOSES_P and node.p is not None:
            leave(node.p)
        held = node.items.get(_ITEM.get(tag, ""))
        if held is not None:
            leave(held)
        if node.home is not node:
            leave_to = node.home
            while node is not leave_to:
                leave(node)
        named = [v for k, v in attributes if k in ("class", "id")] if tag in ("div", "section", "td", "ul", "ol", "table") else []
        enter(tag, attributes, ".".join([tag, *(re.sub(r"\d+", "0", v).strip() for v in named[:2])]))
    return out, nodes, paths


def _smooth(x: np.ndarray, which: np.ndarray, alike) -> np.ndarray:
    """Gaussian smoothing over page order, radius 2; a neighbour counts as far as its path is alike."""
    top, total = x.copy(), np.ones(len(x))
    for d in (1, 2):
        if len(x) > d:
            w = np.exp(-0.5 * d * d) * alike(which[d:], which[:-d])
            top[d:] += w * x[:-d]
            top[:-d] += w * x[d:]
            total[d:] += w
            total[:-d] += w
    return top / total


def _container(paths: _Paths, mass: np.ndarray) -> tuple[int, bool]:
    """The path that holds the text: the article or main element of most mass, unless others have ten times as much, or else the
    container of the path of most mass."""
    parent, tags = paths.parent, paths.tag
    under = mass.copy()
    for i in range(len(parent) - 1, 0, -1):
        under[parent[i]] += under[i]
    named = [i for i in range(1, len(parent)) if tags[i] in ("article", "main") and under[i] > 0]
    best = max(named, key=lambda i: (under[i], i), default=-1)
    if best > 0 and under[best] >= 0.1 * mass.max():
        return best, True
    at = int(mass.argmax())
    while at > 0 and tags[at] in _PLACES:
        at = parent[at]
    return at, False


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by an empty line."""
    if not page:
        return ""
    found, nodes, paths = blocks(page)
    texts, homes, linked = [], [], []
    for b in found:
        text = " ".join(entities.unescape("".join(b.parts)).split())
        if text:
            texts.append(text)
            homes.append(b.node)
            linked.append(min(b.linked, len(text)))
    if not texts:
        return ""
    which = np.array([h.path for h in homes])
    size = np.array([len(t) for t in texts], float)
    plain = size - np.array(linked, float)
    marks = np.array([len(_MARKS.findall(t)) for t in texts], float)
    count = len(paths.parent)
    times = np.bincount(which, minlength=count)
    per_node = np.maximum(times, 1)

    # Names: text under a node, from the leaves up; then factors, from the root down.
    for h, c in zip(homes, plain, strict=True):
        h.plain += c
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.plain += x.plain
    total = nodes[0].plain
    for x in nodes:
        if x.parent is not None:
            x.weight = x.parent.weight * (x.factor if x.plain < total / 2 else 1.0)
    weight = np.array([h.weight for h in homes])

    # Ratios by path, fused by block.
    length = np.bincount(which, plain, count) / per_node
    punctuation = np.bincount(which, marks * plain / size, count) / per_node
    fused = 0.5 * length / (length + HALF_LENGTH) + 0.5 * punctuation / (punctuation + HALF_MARKS)
    ratio = _smooth(fused[which], which, paths.alike)
    # What a path weighs: its text times its ratio; where all text is links, the text.
    mass = np.bincount(which, (ratio * plain if plain.any() else size) * weight, count)
    centre, semantic = _container(paths, mass)
    chain = 0
    up = centre
    on = np.zeros(count, bool)
    while up > 0:
        on[up] = True
        chain += 1
        up = paths.parent[up]
    shared = np.zeros(count)
    for i in range(1, count):
        shared[i] = shared[paths.parent[i]] + on[i]
    alike = shared / max(chain, 1) if chain else np.ones(count)

    inside = alike[which] >= 1
    heavy = np.minimum(1.0, mass / max(SHARE * mass[on | (shared >= chain)].sum(), 1e-9))
    base = INSIDE if semantic else WITHIN
    # Within the content a block's place speaks for it too (a linked heading, a short point).
    value = np.where(inside, base + (1 - base) * ratio, ratio * alike[which] ** 2 * (OUTSIDE if semantic else heavy[which])) * weight
    chosen = (np.bincount(which, value * size, count) / np.maximum(np.bincount(which, size, count), 1) >= THRESHOLD)[which]
    if not chosen.any() and mass.any():
        # A page of few words: what there is in the place that weighs most.
        chosen = inside & (weight == weight[inside].max(initial=0.0))
    after = False
    for k in range(len(texts) - 1, -1, -1):
        if homes[k].tag in _HEADINGS and not semantic and after and weight[k] == 1 and not homes[k].dead:
            chosen[k] = True
        after = bool(chosen[k])
    return "\n\n".join(t for t, c in zip(texts, chosen, strict=True) if c)


def extract(df: DataFrame, *, key: list[str] | None = None, html: str = "html", out: str = "text") -> DataFrame:
    """The columns ``key`` (all but the html by default) and the page's main text as ``out``."""
    ship(df.sparkSession)
    keep = [c for c in (key if key is not None else df.columns) if c not in (html, out)]
    slim = df.select(*keep, F.col(html).alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], schema=pa.schema([*list(part.schema)[:-1], pa.field(out, pa.string())]))

    return slim.mapInArrow(run, slim.schema)

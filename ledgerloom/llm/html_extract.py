"""Main text of web pages by wrapper induction.

Pages of one host share a template. Per host:

1. a few different pages, those of the smallest hashes, are parsed and their DOM trees aligned by simple tree matching into
   one skeleton; nodes that match are merged, and every node of the skeleton is a slot;
2. every page of the host is aligned with the skeleton, and what stands in its slots is counted over all different pages:
   how many pages fill a slot, with which texts, how much of them is link text. Each text counts once however many pages
   repeat it, so the weight of a template stays while that of content grows with the pages;
3. a slot that mostly repeats the same texts is constant, so template; one that is mostly link text is a menu. The region
   of the content is where the weight of the other, varying slots gathers: from the root down while one child holds
   ``share`` of it. Varying headings before it belong to it. This is the wrapper;
4. of every page the blocks stay that fill varying slots inside the region.

Reader comments, notices and adverts inside the region vary as prose does, so alignment cannot tell them: within the region,
slots that element, role or class name mark as such go. A class name alone is not believed: whole names count, not parts such as
that of ``has-sidebar``; the page's root, body, main element and outermost articles are never hidden by a name; and a slot is
hidden by it only if its weight agrees, that is if it is mostly links or at most ``NAMED_SHARE`` of the host's varying text
(:func:`hidden_by_name`). Where the weight gathers outside or above the one article or main element of a host (few pages, short
texts), that element is the region. A host with one page, or a page without the region of its host, has only elements, roles and
names to go by, names again only where the page's own weights agree (:func:`unwrapped_text`).

Runs of siblings with equal element, class and role are one repeating node, so trees stay small and a paragraph more or less
does not disturb the alignment. Sampling and counting combine on the map side. Wrappers are joined to pages by broadcast
if their measured size allows, else by host with the hot hosts' pages salted, so no host is one task.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Elements without an end tag, elements whose content is no text, and elements that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head title iframe object select textarea button canvas math".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may be a region of content.
CONTAINERS = frozenset("html body main article section div td form center".split())
#: Elements and roles outside the main text, and class and id names that say the same: each part of a name is one of NAMES or of
#: LAYOUT, and one at least of NAMES, so ``cookie-banner`` and ``comment-list`` do and ``has-sidebar`` and ``search-methods`` don't.
OUTSIDE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice pagination popup promo recommended related replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
LAYOUT = frozenset("area articles bar block bottom box button buttons container form global group inner item items left link links list main page posts primary right secondary section site slot stories top wrap wrapper".split())
#: Elements that no name hides, and the share of the varying text up to which a name is believed.
UNNAMED = frozenset("html body main".split())
NAMED_SHARE = 0.75
#: An open element of the key is closed by a new one of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?=/?[A-Za-z])[^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_PARTS = re.compile(r"[-_]|(?<=[a-z])(?=\d)")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element, or a run of equal ones. ``outside``: 1 for a page header, 2 for other parts outside the main text by element or
    role, 3 for those by class or id name alone."""

    __slots__ = ("children", "key", "name", "outside", "parent", "slot")

    def __init__(self, key: str, name: str = "", outside: int = 0, parent: Node | None = None) -> None:
        self.key, self.name, self.outside, self.parent, self.children, self.slot = key, name, outside, parent, [], 0

    def child(self, key: str, name: str, outside: int) -> Node:
        if not self.children or self.children[-1].key != key:
            self.children.append(Node(key, name, outside, self))
        return self.children[-1]


class Block:
    """Text of a page between two block edges. ``inside``: within an article (1) or a main element (2)."""

    __slots__ = ("heading", "inside", "linked", "node", "parts", "text")

    def __init__(self, node: Node, inside: int, heading: bool) -> None:
        self.node, self.inside, self.heading = node, inside, heading
        self.parts: list[str] = []
        self.linked, self.text = 0, ""


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _says_outside(name: str) -> bool:
    parts = [w for w in _NAME_PARTS.split(name) if w and not w.isdigit()]
    return any(w in NAMES for w in parts) and all(w in NAMES or w in LAYOUT for w in parts)


def _outside(name: str, names: list[str], role: str) -> int:
    if name in UNNAMED:
        return 0
    if name in OUTSIDE or role in ROLES:
        return 2
    if name == "header":
        return 1
    return 3 if any(map(_says_outside, names)) else 0


def parse(page: str | None) -> tuple[Node, list[Block]]:
    """The tree of a page, with runs of equal siblings merged, and its blocks of text in page order."""
    root = Node("")
    # Open elements: name, node, inside article (1) or main (2), heading.
    stack: list[tuple[str, Node, int, bool]] = [("", root, 0, False)]
    blocks: list[Block] = [Block(root, 0, False)]
    page, at, links = page or "", 0, 0

    def new_block() -> None:
        blocks.append(Block(*stack[-1][1:]))

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            blocks[-1].parts.append(text)
            if links:
                blocks[-1].linked += len(text.strip())

    def close(depth: int) -> None:
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[depth:])
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # within an element without text
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                close(depth)
            if name in BLOCKS:
                new_block()
            continue
        if name in SILENT:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else (len(page) if name in ("script", "style") else at)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                blocks[-1].parts.append(" ")
            continue
        closes = CLOSES.get(name, {"p"} if name in BLOCKS else None)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        _, parent, inside, heading = stack[-1]
        names: list[str] = []
        role = ""
        for a in _ATTRIBUTE.finditer(m[3]):
            value = (a[2] or a[3] or a[4] or "").lower()
            if a[1].lower() == "role":
                role = value
            else:
                names += value.split()
        key = " ".join([name, *sorted({_DIGITS.sub("#", n) for n in names}), *(["@" + role] if role else [])])
        node = parent.child(key, name, _outside(name, names, role))
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, node, max(inside, 2 if name == "main" else 1 if name == "article" else 0), heading or name in HEADINGS))
        links += name == "a"
        if name in BLOCKS:
            new_block()
    say(page[at:])
    for b in blocks:
        if b.parts:
            b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    return root, [b for b in blocks if b.text]


class Matching:
    """Simple tree matching of two trees: the largest top-down, order-keeping alignment.

    Nodes with equal subtrees are one class, and the size of a matching is computed once for two classes, the lower ones
    first, so neither depth nor width of a page is bounded. Children are aligned by a weighted longest common subsequence,
    whose rows are vectors; of a long one every so-many-th row is kept and the rest computed again on the way back.
    """

    def __init__(self, a: Node, b: Node) -> None:
        self.a, self.b = a, b
        self.number: dict[tuple, int] = {}
        self.key: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.height: list[int] = []
        self.of: dict[int, int] = {}
        for tree in (a, b):
            order = [tree]
            for node in order:
                order += node.children
            for node in reversed(order):
                kids = tuple(self.of[id(c)] for c in node.children)
                n = self.number.setdefault((node.key, kids), len(self.key))
                if n == len(self.key):
                    self.key.append(node.key)
                    self.kids.append(kids)
                    self.height.append(1 + max((self.height[k] for k in kids), default=0))
                self.of[id(node)] = n
        self.sizes: dict[tuple[int, int], int] = {}
        if a.key != b.key:
            return
        first = (self.of[id(a)], self.of[id(b)])
        pairs, at = [first], 0
        seen = {first}
        while at < len(pairs):
            x, y = pairs[at]
            at += 1
            below: dict[str, set[int]] = {}
            for k in self.kids[y]:
                below.setdefault(self.key[k], set()).add(k)
            for k in set(self.kids[x]):
                for other in below.get(self.key[k], ()):
                    if (k, other) not in seen:
                        seen.add((k, other))
                        pairs.append((k, other))
        for x, y in sorted(pairs, key=lambda p: self.height[p[0]]):
            xs, ys = self.kids[x], self.kids[y]
            self.sizes[x, y] = 1 + (self._small(xs, ys)[-1][-1] if len(xs) * len(ys) <= 64 else self._last(self._weights(xs, ys)))

    @property
    def size(self) -> int:
        return self.sizes.get((self.of[id(self.a)], self.of[id(self.b)]), 0)

    def _small(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[list[int]]:
        """The whole table of a short alignment."""
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            above, left, row = table[-1], 0, [0]
            for j, y in enumerate(ys):
                left = max(left, above[j + 1], above[j] + self.sizes.get((x, y), 0))
                row.append(left)
            table.append(row)
        return table

    def _weights(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[np.ndarray]:
        """For every child its matchings' sizes with the children of the other side."""
        rows: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in rows:
                rows[x] = np.fromiter((self.sizes.get((x, y), 0) for y in ys), np.int64, len(ys))
        return [rows[x] for x in xs]

    @staticmethod
    def _next(best: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = best.copy()
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + row), out=out[1:])
        return out

    def _last(self, rows: list[np.ndarray]) -> int:
        if not rows or not len(rows[0]):
            return 0
        if len(rows) == 1:
            return int(rows[0].max())
        best = np.zeros(len(rows[0]) + 1, np.int64)
        for row in rows:
            best = self._next(best, row)
        return int(best[-1])

    def _aligned(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The pairs of places of a best alignment."""
        if not xs or not ys:
            return []
        if len(xs) * len(ys) <= 64:
            table, out, i, j = self._small(xs, ys), [], len(xs), len(ys)
            while i and j:
                size = self.sizes.get((xs[i - 1], ys[j - 1]), 0)
                if size and table[i][j] == table[i - 1][j - 1] + size:
                    i, j = i - 1, j - 1
                    out.append((i, j))
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            return out[::-1]
        rows = self._weights(xs, ys)
        step = isqrt(len(rows)) + 1
        best, kept = np.zeros(len(rows[0]) + 1, np.int64), []
        for i, row in enumerate(rows):
            if i % step == 0:
                kept.append(best)
            best = self._next(best, row)
        out, j = [], len(rows[0])
        for block in range(len(kept) - 1, -1, -1):
            table = [kept[block]]
            for row in rows[block * step : (block + 1) * step]:
                table.append(self._next(table[-1], row))
            i = len(table) - 1
            while i and j:
                size = rows[block * step + i - 1][j - 1]
                if size and table[i][j] == table[i - 1][j - 1] + size:
                    i, j = i - 1, j - 1
                    out.append((block * step + i, j))
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return out[::-1]

    def partners(self) -> dict[int, Node]:
        """The partner of every matched node of the first tree, by its id()."""
        if not self.sizes:
            return {}
        found, todo = {}, [(self.a, self.b)]
        while todo:
            x, y = todo.pop()
            found[id(x)] = y
            pairs = self._aligned(self.kids[self.of[id(x)]], self.kids[self.of[id(y)]])
            todo += [(x.children[i], y.children[j]) for i, j in pairs]
        return found


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo += reversed(node.children)
    return out


def hidden(root: Node, own: dict[int, tuple[int, int]]) -> tuple[set[int], set[int]]:
    """The nodes, by id(), that are outside the main text by element or role, and those that are so by name where weights agree.

    ``own`` has the characters of every node's varying text and how many of them are link text. A form around an article or main
    element is a container. A name is believed if its node is mostly links or holds at most NAMED_SHARE of the text that is not
    in links; it never hides an article that is in no other article.
    """
    nodes = preorder(root)
    holds: set[int] = set()  # a main element or an article
    for n in reversed(nodes):
        if n.parent is not None and (n.name in ("main", "article") or id(n) in holds):
            holds.add(id(n.parent))
    hard: set[int] = set()
    gone: set[int] = set()  # hard, or below it
    within: set[int] = set()  # below an article
    for n in nodes:
        if n.outside == 2 and not (n.name == "form" and id(n) in holds):
            hard.add(id(n))
        if id(n) in hard or id(n.parent) in gone:
            gone.add(id(n))
        if n.parent is not None and (n.parent.name == "article" or id(n.parent) in within):
            within.add(id(n))
    chars = {id(n): (0, 0) if id(n) in gone else own.get(id(n), (0, 0)) for n in nodes}
    for n in reversed(nodes[1:]):
        (a, b), (c, d) = chars[id(n.parent)], chars[id(n)]
        chars[id(n.parent)] = (a + c, b + d)
    total = chars[id(root)][0] - chars[id(root)][1]
    named = set()
    for n in nodes:
        if n.outside == 3 and (n.name != "article" or id(n) in within):
            c, linked = chars[id(n)]
            if linked > 0.6 * c or c - linked <= NAMED_SHARE * total:
                named.add(id(n))
    return hard, named


def induce(pages: list[str]) -> str:
    """The skeleton of some pages of a host, as JSON: [place of the parent, key, name, outside] of every node, parents first."""
    base: Node | None = None
    for page in pages:
        tree, _ = parse(page)
        if base is None:
            base = tree
            continue
        found = Matching(tree, base).partners()
        todo = [(tree, base)]
        while todo:
            node, into = todo.pop()
            place = 0
            for c in node.children:
                if (to := found.get(id(c))) is not None:
                    todo.append((c, to))
                    place = next((i for i, x in enumerate(into.children) if x is to), place) + 1
                else:
                    c.parent = into
                    into.children.insert(place, c)
                    place += 1
    nodes = preorder(base or Node(""))
    at = {id(n): i for i, n in enumerate(nodes)}
    return json.dumps([[at[id(n.parent)] if i else -1, n.key, n.name, n.outside] for i, n in enumerate(nodes)])


def _tree(rows: list[list]) -> list[Node]:
    """The nodes of a skeleton, numbered as slots."""
    nodes: list[Node] = []
    for slot, (up, key, name, outside) in enumerate(rows):
        node = Node(key, name, outside, nodes[up] if slot else None)
        node.slot = slot
        if slot:
            nodes[up].children.append(node)
        nodes.append(node)
    return nodes


class Wrapper:
    """A skeleton, and what its slots are: ``region``, ``also`` (headings before it), ``template`` (slots that go), ``outside``
    (slots that go by element, role or name)."""

    def __init__(self, data: str) -> None:
        read = json.loads(data)
        self.nodes = _tree(read["nodes"])
        self.region: int = read["region"]
        self.also, self.template, self.outside = frozenset(read["also"]), frozenset(read["template"]), frozenset(read["outside"])


@lru_cache(32)
def _skeleton(data: str) -> Node:
    return _tree(json.loads(data))[0]


@lru_cache(32)
def _wrapper(data: str | None) -> Wrapper | None:
    return Wrapper(data) if data else None


def slots(tree: Node, skeleton: Node) -> dict[int, int]:
    """The slot of every node of a page, by id(): its partner's number, or a negative hash of its path if it has no partner."""
    found = Matching(tree, skeleton).partners()
    paths, out = {id(tree): 0}, {}
    for node in preorder(tree):
        path = xxhash.xxh3_64_intdigest(node.key.encode("utf-8", "surrogatepass"), paths[id(node)])
        partner = found.get(id(node))
        out[id(node)] = partner.slot if partner is not None else -1 - (path >> 1)
        for c in node.children:
            paths[id(c)] = path
    return out


def fillings(page: str | None, skeleton: Node) -> tuple[int, list[tuple[int, int, int, int]]]:
    """A key of the page's content (its longest text), and (slot, text mark, characters, of these in links) of its blocks.

    Mark -1 stands for the slot itself, once a page.
    """
    tree, blocks = parse(page)
    slot = slots(tree, skeleton)
    texts = [(slot[id(b.node)], b.text, b.linked) for b in blocks]
    key = _mark(max((t for _, t, _ in texts), key=lambda t: (len(t), t), default=""))
    out = {(s, _mark(t)): (len(t), min(linked, len(t))) for s, t, linked in texts}
    return key, [(s, m, *v) for (s, m), v in out.items()] + [(s, -1, 0, 0) for s in sorted({s for s, _, _ in texts})]


def decide(skeleton: str, tally: list[tuple[int, int, int, bool]], share: float = 0.85) -> str:
    """The wrapper of a host as JSON, from its skeleton and (slot, characters, of these in links, constant) of its slots.

    Top headings and the region's slot of the largest weight are no template, so near copies of one article do not lose it.
    """
    rows = json.loads(skeleton)
    nodes = _tree(rows)
    hard, named = hidden(nodes[0], {id(nodes[slot]): (chars, linked) for slot, chars, linked, constant in tally if slot >= 0 and not constant})
    away = {n.slot for n in nodes if id(n) in hard or id(n) in named}
    below, own = [False] * len(nodes), [0] * len(nodes)
    for n in nodes[1:]:
        below[n.slot] = below[n.parent.slot] or n.slot in away
    for slot, chars, linked, _ in tally:
        if slot >= 0 and not below[slot]:
            own[slot] = chars - linked
    weight = list(own)
    for n in reversed(nodes[1:]):
        weight[n.parent.slot] += weight[n.slot]
    at = nodes[0]
    while at.children:
        best = max(at.children, key=lambda c: weight[c.slot])
        if best.name not in CONTAINERS or weight[best.slot] < share * weight[at.slot] or not weight[best.slot]:
            break
        at = best
    marked = [n for n in nodes if n.name in ("main", "article") and not below[n.slot]]
    outermost = [n for n in marked if not any(up in marked for up in _ancestors(n)[1:])]
    single = [n for n in outermost if n.name == "main"] or outermost
    if len(single) == 1 and single[0] not in _ancestors(at):
        at = single[0]
    inside = {n.slot for n in preorder(at)}
    heaviest = max(inside, key=lambda i: (own[i], -i))
    template = {slot for slot, chars, linked, constant in tally if slot != heaviest and (linked > 0.6 * chars or (constant and not (slot >= 0 and nodes[slot].name == "h1")))}
    also = [n.slot for n in nodes[: at.slot] if n.name in HEADINGS and own[n.slot] and n.slot not in template]
    return json.dumps({"nodes": rows, "region": at.slot, "also": also, "template": sorted(template), "outside": sorted(away)})


def _ancestors(node: Node) -> list[Node]:
    """The node and all above it."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _weights(blocks: list[Block]) -> dict[int, tuple[int, int]]:
    """Characters and link characters of the blocks of every node, by its id()."""
    own: dict[int, tuple[int, int]] = {}
    for b in blocks:
        c, linked = own.get(id(b.node), (0, 0))
        own[id(b.node)] = (c + len(b.text), linked + min(b.linked, len(b.text)))
    return own


def unwrapped_text(blocks: list[Block]) -> str:
    """The main text by elements, roles and names alone; names where this page's weights agree."""
    if not blocks:
        return ""
    kept = []
    hard, named = hidden(_ancestors(blocks[0].node)[-1], _weights(blocks))
    for b in blocks:
        up = _ancestors(b.node)
        if any(id(n) in hard or id(n) in named for n in up) or (not b.inside and any(n.outside == 1 for n in up)):
            continue
        if not b.inside and not b.heading and b.linked > 0.6 * len(b.text):
            continue
        kept.append((b.inside, b.text))
    inside = max((i for i, _ in kept), default=0)
    return "\n\n".join(t for i, t in kept if i == inside or (inside == 1 and i >= 1))


def main_text(page: str | None, wrapper: Wrapper | None) -> str:
    """The blocks of a page that fill varying slots inside the region of its host's wrapper."""
    tree, blocks = parse(page)
    if wrapper is None:
        return unwrapped_text(blocks)
    slot = slots(tree, wrapper.nodes[0])
    nodes = preorder(tree)
    away: set[int] = set()  # of the nodes that the skeleton lacks
    if any(n.outside > 1 and slot[id(n)] < 0 for n in nodes):
        away = set().union(*hidden(tree, _weights(blocks)))
    state: dict[int, int] = {}  # of every node: 1 in the region, 2 in a part of it that goes, 0 outside
    for node in nodes:
        s, up = slot[id(node)], state[id(node.parent)] if node.parent is not None else 0
        goes = s in wrapper.template or s in wrapper.outside or (s < 0 and id(node) in away)
        state[id(node)] = 1 if s == wrapper.region and not up else 2 if up == 2 or (up == 1 and goes) else up
    if not any(state.values()):
        return unwrapped_text(blocks)
    return "\n\n".join(b.text for b in blocks if state[id(b.node)] == 1 or slot[id(b.node)] in wrapper.also)


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _drawn(pages: DataFrame, samples: int, held_bytes: int = 32_000_000) -> DataFrame:
    """``host`` and ``html`` of the ``samples`` different pages with the smallest hashes of every host."""

    def least(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, str]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(k, h, t) for k, found in held.items() for h, t in found.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "h", "html"])

        for part in parts:
            for k, h, text in zip(part.column("host").to_pylist(), part.column("h").to_pylist(), part.column("html"), strict=True):
                found = held.setdefault(k, {})
                if h in found or (len(found) >= samples and h > max(found)):
                    continue
                found[h] = text.as_py()
                size += len(found[h])
                if len(found) > samples:
                    size -= len(found.pop(max(found)))
                if size > held_bytes:
                    yield flush()
                    size = 0
        yield flush()

    some = pages.select("host", "h", "html").mapInArrow(least, "host string, h long, html string")
    rank = F.row_number().over(Window.partitionBy("host").orderBy("h"))
    return some.groupBy("host", "h").agg(F.min("html").alias("html")).withColumn("rank", rank).filter(F.col("rank") <= samples).select("host", "html")


def _by_host(pages: DataFrame, table: DataFrame, column: str, how: str, broadcast_bytes: int, salts: int = 64) -> DataFrame:
    """Pages (host, h, ...) with the table's column of their host.

    A table of at most ``broadcast_bytes`` is broadcast. A larger one is joined by host; hosts with a thousandth of all
    pages or more (so at most 1,000) are dealt out over ``salts`` copies of their row.
    """
    size = table.agg(F.coalesce(F.sum(F.length(column) + F.length("host")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return pages.join(F.broadcast(table), "host", how)
    hot = pages.groupBy("host").agg(F.count("*").alias("n")).crossJoin(pages.agg(F.count("*").alias("total"))).filter("1000 * n >= total").select("host", F.lit(True).alias("hot"))
    hot = F.broadcast(stored(hot, "hot-hosts"))
    dealt = pages.join(hot, "host", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("h", F.lit(salts)).cast("int")).otherwise(0)).drop("hot")
    every = F.sequence(F.lit(0), F.when(F.col("hot"), salts - 1).otherwise(0))
    laid = table.join(hot, "host", "left").select("host", column, F.explode(every).alias("salt"))
    return dealt.join(laid, ["host", "salt"], how).drop("salt")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", *, samples: int = 4, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """``host`` and ``wrapper`` (JSON) for every host with two different pages or more.

    At most ``samples`` pages of each make the skeleton; slots are counted over all different pages, of which those with
    the same longest text count as one (copies of one article are no template). A slot is constant if over half of what fills it
    are repeated texts, which over half of its pages hold.
    """
    known = pages.filter(F.col(html_col).isNotNull()).select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h"))
    none = pa.table({"host": pa.array([], pa.string()), "skeleton": pa.array([], pa.string())})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts = sorted(table["html"].to_pylist())
        return pa.table({"host": [key[0].as_py()], "skeleton": [induce(texts)]}) if len(texts) > 1 else none

    skeletons = stored(_drawn(known, samples).groupBy("host").applyInArrow(run, "host string, skeleton string"), "skeletons")
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("mark", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())]))

    def seen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, held = [], []
            for page, data in zip(part.column("html"), part.column("skeleton"), strict=True):
                key, found = fillings(page.as_py(), _skeleton(data.as_py()))
                keys.append(key)
                held.append([dict(zip(("slot", "mark", "chars", "linked"), f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(keys, pa.int64()), pa.array(held, kind)], ["host", "key", "seen"])

    read = _by_host(known, skeletons, "skeleton", "inner", broadcast_bytes).select("host", "html", "skeleton").mapInArrow(seen, "host string, key long, seen array<struct<slot:long,mark:long,chars:long,linked:long>>")
    once = read.groupBy("host", "key").agg(F.max("seen").alias("seen"))
    each = once.select("host", F.explode("seen").alias("x")).select("host", "x.*").groupBy("host", "slot", "mark").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    counts = stored(each, "fillings")
    # Texts with one number of pages count together before slots meet, as one slot may hold most texts of a hot host.
    alike = stored(counts.groupBy("host", "slot", (F.col("mark") == -1).alias("whole"), "n").agg(F.count("*").alias("k"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "tallies")
    total = alike.filter("whole").select("host", "slot", F.col("n").alias("total"))
    texts = alike.filter("not whole").join(total, ["host", "slot"])
    held = F.col("n") * F.col("k")
    repeated = F.sum(F.when((2 * F.col("n") > F.col("total")) & (F.col("n") > 1), held).otherwise(0))
    tally = texts.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), (2 * repeated > F.sum(held)).alias("constant"))
    # Slots outside the skeleton are needed only where they are template.
    listed = tally.filter("slot >= 0 or constant").groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "linked", "constant")).alias("tally"))

    def made(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [decide(s.as_py(), sorted((t["slot"], t["chars"], t["linked"], t["constant"]) for t in found.as_py())) for s, found in zip(part.column("skeleton"), part.column("tally"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(out, pa.string())], ["host", "wrapper"])

    return stored(skeletons.join(listed, "host").select("host", "skeleton", "tally").mapInArrow(made, "host string, wrapper string"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, samples: int = 4, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """One row per input row: the id, the URL and ``text`` (empty if there is none).

    A null page has an empty text; a null or odd URL is host ''. A host with one page has no wrapper: only elements, roles and
    names decide. Repeated rows are extracted each by itself and do not make a text constant; an empty table gives an empty
    result. Neither depth nor width nor length of a page is bounded.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    made = wrappers(rows, "url", "html", samples=samples, broadcast_bytes=broadcast_bytes)
    keyed = rows.withColumn("host", host(F.col("url"))).withColumn("h", F.xxhash64("html", "id"))
    joined = _by_host(keyed, made, "wrapper", "left", broadcast_bytes).select("id", "url", "html", "wrapper")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(page.as_py(), _wrapper(data.as_py())) for page, data in zip(part.column("html"), part.column("wrapper"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    done = joined.mapInArrow(run, f"id {kind}, url string, text string")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def html_digest(pages: DataFrame) -> DataFrame:
    """The query's columns, from :func:`extract`."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

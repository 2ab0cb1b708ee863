"""Wrappers of small hosts against a plain version: quadratic alignment by recursion, literal counts of what fills each slot."""

import random
from functools import cache

from ledgerloom.llm import html_extract as h


class Slot:
    """A node of the plain skeleton: key, name, children, and the texts that fill it, by the page they come from."""

    def __init__(self, node, up=None):
        self.key, self.name, self.up = node.key, node.name, up
        self.children = [Slot(c, self) for c in node.children]
        self.texts = {}


def aligned(a, b):
    """Pairs of a largest top-down matching of two trees with equal roots; nothing is remembered but sizes."""

    @cache
    def size(x, y):
        return table(x, y)[-1][-1] + 1 if x.key == y.key else 0

    @cache
    def table(x, y):
        best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, p in enumerate(x.children):
            for j, q in enumerate(y.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(p, q))
        return best

    pairs, best, i, j = [(a, b)], table(a, b), len(a.children), len(b.children)
    while i and j:
        here = size(a.children[i - 1], b.children[j - 1])
        if here and best[i][j] == best[i - 1][j - 1] + here:
            i, j = i - 1, j - 1
            pairs += aligned(a.children[i], b.children[j])
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs


def merge(node, slot, partner):
    at = 0
    for c in node.children:
        if c in partner:
            merge(c, partner[c], partner)
            at = slot.children.index(partner[c]) + 1
        else:
            slot.children.insert(at, Slot(c, slot))
            at += 1


def all_of(slot):
    return [slot, *[x for c in slot.children for x in all_of(c)]]


def plain(pages):
    """The texts of a host's pages, whose markup has no telling names."""
    first, *rest = sorted(pages)
    root = Slot(h.parse(first)[0])
    for p in rest:
        tree = h.parse(p)[0]
        merge(tree, root, dict(aligned(tree, root)))
    filled, orphans = [], {}
    for p in pages:
        tree, blocks = h.parse(p)
        partner = dict(aligned(tree, root))
        filled.append((partner, blocks))
        for b in blocks:
            where = partner[b.node].texts if b.node in partner else orphans.setdefault((b.node.key,), {})
            where.setdefault(b.text, set()).add(p)
    slots = all_of(root)

    def constant(texts):
        pages_of = set().union(*texts.values())
        held = sum(len(v) for v in texts.values())
        return 2 * sum(len(v) for v in texts.values() if len(v) > 1 and 2 * len(v) > len(pages_of)) > held

    own = {s: sum(map(len, s.texts)) for s in slots}
    weight = lambda s: sum(own[x] for x in all_of(s))
    at = root
    while at.children:
        best = max(at.children, key=weight)
        if best.name not in h.CONTAINERS or weight(best) < 0.85 * weight(at) or not weight(best):
            break
        at = best
    inside = all_of(at)
    heaviest = max(inside, key=lambda s: own[s])
    template = {s for s in slots if s.texts and s is not heaviest and s.name != "h1" and constant(s.texts)}

    def kept(slot):
        while slot is not None:
            if slot in template:
                return False
            if slot is at:
                return True
            slot = slot.up
        return False

    return ["\n\n".join(b.text for b in blocks if kept(partner[b.node])) for partner, blocks in filled]


def test_extraction_equals_the_plain_version(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    rows, want = [], []
    for k in range(12):
        fixed = [line(5) for _ in range(4)]
        pages = []
        for _ in range(r.randint(3, 4)):  # no more than make the skeleton, so every node has its slot
            body = "".join(r.choice([f"<p>{line(20)}</p>", f"<h2>{line(3)}</h2>", f"<ul><li>{line(4)}</li><li>{line(4)}</li></ul>"]) for _ in range(r.randint(4, 9)))
            extra = "".join(f"<div class=b{i}><i>{x}</i></div>" for i, x in enumerate(fixed) if r.random() < 0.9)
            pages.append(f"<html><body><div class=t>{fixed[0]}</div>{extra}<div class=c><h1>{line(4)}</h1><p>{line(40)}</p>{body}<div class=q>{fixed[1]}</div></div><div class=w>{fixed[2]}</div></body></html>")
        for n, (p, text) in enumerate(zip(pages, plain(pages), strict=True)):
            rows.append((len(rows), f"https://h{k}.example.com/{n}", p))
            want.append(text)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in h.html_digest(df).collect()}
    assert [got[i] for i in range(len(rows))] == want and all(want)
    # The plain rule of elements and names would not do: constants stay in its texts.
    assert any(h.unwrapped_text(h.parse(p)[1]) != w for (_, _, p), w in zip(rows, want, strict=True))

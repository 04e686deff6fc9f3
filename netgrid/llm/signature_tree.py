"""Exact set-similarity self join by signature trees.

A node of a signature tree holds the OR of its members' token bitmaps, their
range of sizes and their least number of set bits. Two nodes are walked
together; a pair of nodes is left as soon as no pair below it can overlap enough.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np

LEAF = 32
FANOUT = 8


def bitmap_width(n: int, per: int = 2) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two of at least ``per`` n, from 128 to 65,536 times half of ``per``."""
    return min(1 << 15, 1 << max(6, (n - 1).bit_length())) * per


def bitmap(tokens: np.ndarray, per: int = 2) -> bytes:
    """per: a power of two."""
    width = bitmap_width(len(tokens), per)
    bits = np.zeros(width, dtype=bool)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller width: bit i of the half is bit i or bit i + half."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def count_bits(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


@dataclass
class Node:
    lo: int  # least size
    hi: int  # greatest size
    bits: np.ndarray  # OR of the members' bitmaps
    least: int  # least number of set bits of a member at this width
    members: np.ndarray | None  # of a leaf
    each: np.ndarray | None  # members' bitmaps of a leaf, at its width
    children: list[Node]
    label: int  # the members' common label, or -1


def build(sizes: np.ndarray, maps: list[np.ndarray], labels: np.ndarray | None = None) -> Node | None:
    """A tree over sets ordered by size; neighbours in size share a leaf if their bitmaps are equally wide.

    labels: members of a frequent label share leaves of their own.
    """
    width = np.array([len(m) for m in maps])
    if labels is None:
        labels, group = np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64)
    else:
        _, at, count = np.unique(labels, return_inverse=True, return_counts=True)
        group = np.where(count[at] >= LEAF // 4, at, -1)
    order = np.lexsort((sizes, width, group))
    ends = np.flatnonzero(np.diff(group[order]) | np.diff(width[order])) + 1
    level = []
    for run in np.split(order, ends) if len(order) else []:
        for part in np.split(run, range(LEAF, len(run), LEAF)):
            words = min(len(maps[i]) for i in part)
            each = np.stack([fold(maps[i], words) for i in part])
            own = int(labels[part[0]]) if (labels[part] == labels[part[0]]).all() else -1
            level.append(Node(sizes[part].min(), sizes[part].max(), np.bitwise_or.reduce(each), int(count_bits(each).min()), part, each, [], own))
    while len(level) > 1:
        above = []
        for i in range(0, len(level), FANOUT):
            below = level[i : i + FANOUT]
            words = min(len(x.bits) for x in below)
            least = min(-(-x.least * words // len(x.bits)) for x in below)
            bits = np.bitwise_or.reduce(np.stack([fold(x.bits, words) for x in below]))
            own = below[0].label if len({x.label for x in below}) == 1 else -1
            above.append(Node(min(x.lo for x in below), max(x.hi for x in below), bits, least, None, None, below, own))
        level = above
    return level[0] if level else None


def can_overlap(p: Node, q: Node, num: int, den: int) -> bool:
    """Whether some pair below may reach intersection / union >= num / den."""
    if p.hi * den < num * q.lo or q.hi * den < num * p.lo:
        return False
    words = min(len(p.bits), len(q.bits))
    shared = int(count_bits(fold(p.bits, words) & fold(q.bits, words)))
    at = lambda x: -(-x.least * words // len(x.bits))
    most = min(p.hi - max(0, at(p) - shared), q.hi - max(0, at(q) - shared))
    return most * (num + den) >= num * (p.lo + q.lo)


def leaf_pairs(p: Node, q: Node, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of members that may link, and the most that each can share."""
    words = min(p.each.shape[1], q.each.shape[1])
    a, b = fold(p.each, words)[:, None], fold(q.each, words)[None]
    x, y = sizes[p.members][:, None], sizes[q.members][None]
    most = np.minimum(x - count_bits(a & ~b), y - count_bits(b & ~a))
    ok = most * (num + den) >= num * (x + y)
    if p is q:
        ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
    i, j = np.nonzero(ok)
    return p.members[i], q.members[j], most[i, j]


def candidates(
    sizes: np.ndarray, maps: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs that may link, by a dual walk of the tree with itself; none that links is missed.

    labels: nodes that share one label are not compared.
    """
    root, found = build(sizes, maps, labels), []
    stack = [(root, root)] if root else []
    while stack:
        p, q = stack.pop()
        if (labels is not None and p.label == q.label != -1) or not can_overlap(p, q, num, den):
            continue
        if p.members is not None and q.members is not None:
            found.append(leaf_pairs(p, q, sizes, num, den))
        elif p is q:
            stack += [(x, y) for i, x in enumerate(p.children) for y in p.children[i:]]
        elif p.members is None and (q.members is not None or p.hi - p.lo >= q.hi - q.lo):
            stack += [(x, q) for x in p.children]
        else:
            stack += [(p, y) for y in q.children]
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def chain(sizes: np.ndarray, maps: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours that may link, in the order of their bitmaps: a few likely links of a large group."""
    width = np.array([len(m) for m in maps])
    found, last = [], None
    for words in np.unique(width):
        own = np.flatnonzero(width == words)
        each = np.stack([maps[i] for i in own])
        order = np.lexsort(each.T[::-1])
        own, each = own[order], each[order]
        if last is not None:  # the last set of the narrower bitmaps
            found.append(_may_link(last[0], last[1], own[:1], fold(each[:1], last[1].shape[1]), sizes, num, den))
        found.append(_may_link(own[:-1], each[:-1], own[1:], each[1:], sizes, num, den))
        last = own[-1:], each[-1:]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _may_link(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.minimum(sizes[a] - count_bits(x & ~y), sizes[b] - count_bits(y & ~x))
    ok = most * (num + den) >= num * (sizes[a] + sizes[b])
    return a[ok], b[ok]


def forest(a: np.ndarray, b: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Of candidate pairs of n nodes, those of a spanning forest, highest scores first."""
    top = np.arange(n)

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    keep = []
    for i in np.argsort(-score, kind="stable"):
        x, y = find(a[i]), find(b[i])
        if x != y:
            top[max(x, y)] = min(x, y)
            keep.append(i)
            if len(keep) == n - 1:
                break
    return np.array(keep, dtype=np.int64)


def groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal rows of a key matrix."""
    if not len(keys):
        return []
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return list(pairwise([0, *cut.tolist(), len(keys)]))

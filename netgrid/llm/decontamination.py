"""Benchmark decontamination by latent semantic retrieval.

0. The documents' words are hashed once and written as numbers of terms.
1. Passages of ``WINDOW`` words are TF-IDF vectors over the benchmark's words;
   every other word counts in a passage's length only. Passage frequencies are
   counted over all documents.
2. A randomised singular value decomposition of the whole passage matrix A:
   each task adds up its part of A'(A W) and (A W)'(A W) for a random W, and the
   sums give the leading right singular vectors (Nystrom's form).
3. Every passage of every document is compared with every item in that space:
   the cosine there, times the part of the passage's length that is in words of
   the benchmark. A passage whose part alone is below the least similarity is
   passed over at once, which loses nothing.
4. Pairs found are kept when the longest common subsequence of words with the
   surrounding text covers enough of the item, and, for paraphrases, when its
   answer (the last sentence) is there too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.hashing import chunks, one_word_hashes, word_hashes
from netgrid.llm.memory import released, small_batches
from netgrid.plans.storage import materialise

WINDOW, HOP = 32, 16
RANK, EXTRA = 96, 16
LEAST_COSINE = 0.3
OTHER = 7.0  # weight of words outside the benchmark's vocabulary
COPY, PARAPHRASE, ANSWER = 0.8, 0.5, 0.3
#: A paraphrase has so many words of the item in order, or this share of a short one.
SOME_WORDS, SHORT = 12, 0.6
MOST_WORDS = 100_000  # of the benchmark's vocabulary in one block of items
RUN, PIECE = 1 << 18, 8192  # words handled at once, and rows gathered at once
_table = bytes.maketrans(bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b).isspace())), b" " * sum(not (chr(b).isalnum() or chr(b).isspace()) for b in range(128)))
F32 = np.float32


def plain(text: str | None) -> bytes:
    """Lower-case bytes with ASCII punctuation made spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_table)


def hashed(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For runs of texts: the number of the first, word hashes with the text's number in the run, and how many texts."""
    data = [plain(t) for t in texts]
    for lo, hi in chunks(data):
        yield lo, *word_hashes(data[lo:hi]), hi - lo


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows of ``term_table``: the number of the first, the terms, and the text's number in the run."""
    data = column.to_pylist()
    size = np.array([len(x) // 4 for x in data], dtype=np.int64)
    run = np.cumsum(size) // RUN
    cut = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(data)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if size[lo:hi].any():
            yield lo, np.frombuffer(b"".join(data[lo:hi]), "<i4"), np.repeat(np.arange(hi - lo), size[lo:hi])


def starts_of(owner: np.ndarray, hop: int) -> np.ndarray:
    """Word positions at which passages start: every ``hop`` words of each text."""
    if not len(owner):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[first, len(owner)])
    count = np.maximum(1, -(-(size - WINDOW) // hop) + 1)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + within * hop


def ends_of(owner: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each passage ends: after WINDOW words or with its text."""
    return np.minimum(starts + WINDOW, np.searchsorted(owner, owner[starts], side="right"))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted

    def __post_init__(self):
        self.near = np.zeros(1 << 16, dtype=bool)
        self.near[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term of each word, or -1."""
        out = np.full(len(h), -1, dtype=np.int32)
        at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        if len(at):
            own = h[at]
            i = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            ok = self.hashes[i] == own
            out[at[ok]] = i[ok]
        return out


@dataclass
class Space:
    """TF-IDF weights of the terms, and their places in the latent space."""

    vocabulary: Vocabulary
    idf: np.ndarray
    other: float  # weight of a word that the benchmark does not use, the same for every number of passages
    terms: np.ndarray | None = None  # (terms, rank)

    def lengths(self, term: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages' lengths as vectors, whole and in the benchmark's words alone."""
        own = np.where(term >= 0, self.idf[term] ** 2, 0)
        energy = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, own, self.other**2))])
        own = np.concatenate([[0.0], np.cumsum(own)])
        return np.sqrt(np.maximum(energy[ends] - energy[starts], 1e-9)), np.sqrt(np.maximum(own[ends] - own[starts], 0))

    def weighted(self, matrix: np.ndarray) -> np.ndarray:
        """Rows of terms times their weights."""
        return np.ascontiguousarray(self.idf[:, None] * matrix, F32)


def add_rows(out: np.ndarray, matrix: np.ndarray, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``out[group] += matrix[rows]``, where equal groups are neighbours."""
    for lo in range(0, len(rows), PIECE):
        g = group[lo : lo + PIECE]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        out[g[first]] += np.add.reduceat(matrix[rows[lo : lo + PIECE]], first)
    return out


def entries(term: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The benchmark's terms of all passages one after another, and the passage of each."""
    n = ends - starts
    t = term[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    ok = t >= 0
    return t[ok], np.repeat(np.arange(len(starts)), n)[ok]


def term_table(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, terms)``: every word's term as four bytes, -1 for words that the benchmark does not use."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = sent.value
        for b in batches:
            out = []
            for _, h, owner, n in hashed(b.column(1).to_pylist()):
                term, cut = v.lookup(h).astype("<i4"), np.searchsorted(owner, np.arange(n + 1))
                out += [term[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "terms"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, terms binary")


def frequencies(texts: DataFrame, v: int) -> tuple[np.ndarray, int]:
    """In how many of all passages each of v terms occurs, and how many passages there are."""

    def run(batches):
        count, passages = np.zeros(v, np.int64), 0
        for b in batches:
            for _, term, owner in runs(b.column(0)):
                start = starts_of(owner, WINDOW)
                passages += len(start)
                at = np.searchsorted(start, np.arange(len(term)), side="right")
                key = np.unique((at * v + term)[term >= 0])
                count += np.bincount(key % v, minlength=v)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[passages, count[at]])], names=["term", "n"])

    rows = texts.select("terms").mapInArrow(released(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(v + 1, np.int64)
    out[np.asarray(rows.column(0))] = np.asarray(rows.column(1))
    return out[:-1], int(out[-1])


def latent_terms(texts: DataFrame, space: Space, seed: int = 17) -> np.ndarray:
    """The leading right singular vectors of all passages, by one pass; sums come in rows of one term each."""
    v = len(space.idf)
    k = min(RANK + EXTRA, v)
    omega = np.random.default_rng(seed).normal(size=(v, k)).astype(F32)
    sent = texts.sparkSession.sparkContext.broadcast((space, omega))

    def run(batches):
        s, w = sent.value
        w = s.weighted(w)
        left, gram = np.zeros((v, k), np.float64), np.zeros((k, k))
        for b in batches:
            for _, term, owner in runs(b.column(0)):
                start = starts_of(owner, WINDOW)
                end = ends_of(owner, start)
                length = s.lengths(term, start, end)[0].astype(F32)[:, None]
                t, passage = entries(term, start, end)
                y = add_rows(np.zeros((len(start), k), F32), w, t, passage) / length
                gram += y.T @ y
                order = np.argsort(t.astype(np.uint16) if v < 1 << 16 else t, kind="stable")
                add_rows(left, y / length, passage[order], t[order])
        left *= s.idf[:, None]
        at = np.flatnonzero(left.any(axis=1))
        rows = np.concatenate([left[at], gram])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, np.arange(-k, 0)]), pa.array(list(rows))], names=["row", "x"])

    parts = texts.select("terms").mapInArrow(released(run), "row long, x array<double>")
    # one row for each term and each column of the Gram matrix, of fixed width
    sums = parts.groupBy("row").agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(k)]).toArrow()
    found = np.asarray(sums.column(0))
    values = np.stack([np.asarray(sums.column(i + 1)) for i in range(k)], axis=1) if len(found) else np.zeros((0, k))
    b, gram = np.zeros((v, k)), np.zeros((k, k))
    b[found[found >= 0]] = values[found >= 0]
    gram[found[found < 0] + k] = values[found < 0]
    if not b.any():
        return np.zeros((v, 1), F32)
    # A'A is about B G^-1 B': its eigenvectors from the factor B G^-1/2
    e, q = np.linalg.eigh((gram + gram.T) / 2)
    ok = e > e.max() * 1e-9
    u, _, _ = np.linalg.svd(b @ (q[:, ok] / np.sqrt(e[ok])), full_matrices=False)
    return np.ascontiguousarray(u[:, :RANK], F32)


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vectors: np.ndarray  # latent, length 1
    of: np.ndarray  # item number of each vector


def answer_of(text: str) -> str:
    """The last sentence or line that has a word."""
    parts = [p for p in re.split(r"[.!?]+(?:\s+|$)|\n+", text) if plain(p).strip()]
    return parts[-1] if parts else ""


def prepare_items(items: list[tuple[int, str]], space: Space) -> Items:
    words = [space.vocabulary.lookup(word_hashes([plain(t)])[0]) for _, t in items]
    answers = [space.vocabulary.lookup(word_hashes([plain(answer_of(t))])[0]) for _, t in items]
    terms = space.weighted(space.terms)
    vectors, of = [], []
    for i, term in enumerate(words):
        own = np.zeros(len(term), np.int64)
        start = np.zeros(1, np.int64) if len(term) <= WINDOW + HOP else starts_of(own, HOP)
        end = np.minimum(start + (WINDOW if len(start) > 1 else len(term)), len(term))
        y = add_rows(np.zeros((len(start), terms.shape[1]), F32), terms, *entries(term, start, end))
        vectors.append(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-6))
        of += [i] * len(start)
    return Items([i for i, _ in items], words, answers, np.concatenate(vectors), np.array(of))


def enough(size: int) -> int:
    """How many words in order make a paraphrase of an item of ``size`` words."""
    return max(math.ceil(PARAPHRASE * size - 1e-9), min(SOME_WORDS, math.ceil(SHORT * size - 1e-9)))


def common(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, the rows of the table being bits of one integer."""
    row = full = (1 << size) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def before(term: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The place of the same term before, in the same text, or -1."""
    order = np.lexsort((term, owner))
    same = (term[order[1:]] == term[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    out = np.full(len(term), -1, np.int32)
    out[order[1:][same]] = order[:-1][same]
    return out


def words_in(has: np.ndarray, k: np.ndarray, term: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """How many different words of the item k are in ``term[a:b]``, for many regions at once. ``last``: from ``before``."""
    out = np.zeros(len(k), np.int64)
    n = b - a
    part = np.cumsum(n) // size
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(k) else []
    flat, width = has.ravel(), has.shape[1]
    known = np.where(term < 0, width - 1, term)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        m = n[lo:hi]
        begin = np.cumsum(m) - m
        at = np.repeat((a[lo:hi] - begin).astype(np.int32), m) + np.arange(m.sum(), dtype=np.int32)
        hit = flat[np.repeat((k[lo:hi] * width).astype(np.int32), m) + known[at]]
        hit &= last[at] < np.repeat(a[lo:hi].astype(np.int32), m)
        out[lo:hi] = np.add.reduceat(hit, begin, dtype=np.int32)
    return out


def bit_masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def project(term: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Latent vectors of passages that start every HOP words; each is the sum of its blocks of HOP words."""
    first = np.searchsorted(owner, owner)
    block = np.cumsum(np.r_[True, owner[1:] != owner[:-1]] | ((np.arange(len(owner)) - first) % HOP == 0)) - 1
    at = block[starts][:, None] + np.arange(WINDOW // HOP)
    inside = at <= block[ends - 1][:, None]
    used = np.zeros(block[-1] + 2, bool)
    used[at[inside]] = True
    ok = (term >= 0) & used[block]
    number = np.cumsum(used) - 1
    sums = add_rows(np.zeros((number[-1] + 2, terms.shape[1]), F32), terms, term[ok], number[block[ok]])
    return sum(sums[np.where(inside[:, i], number[np.minimum(at[:, i], block[-1])], -1)] for i in range(at.shape[1]))


def search(texts: DataFrame, space: Space, items: Items) -> DataFrame:
    """``(doc_id, item_id, word, cosine, overlap, answer)``: the best place of each document and item that match."""
    sent = texts.sparkSession.sparkContext.broadcast((space, items))
    names = ["doc_id", "item_id", "word", "cosine", "overlap", "answer"]

    def run(batches):
        s, it = sent.value
        terms = s.weighted(s.terms)
        masks = [(bit_masks(w), len(w)) for w in it.words]
        # a common subsequence lacks each word of the item that the text lacks
        least = np.array([len(m) - (n - enough(n)) for m, n in masks])
        ends = [(bit_masks(w), len(w)) for w in it.answers]
        sizes = np.array([n for _, n in masks])
        has = np.zeros((len(masks), len(s.idf) + 1), bool)  # the last one for other words, which are in no item
        for i, (m, _) in enumerate(masks):
            has[i, list(m)] = True
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for base, term, owner in runs(b.column(1)):
                start = starts_of(owner, HOP)
                end = ends_of(owner, start)
                length, inside = s.lengths(term, start, end)
                keep = inside >= LEAST_COSINE * length
                if not keep.any():
                    continue
                start, end, part = start[keep], end[keep], (inside[keep] / length[keep]).astype(F32)
                text_start, text_end = np.searchsorted(owner, owner[start]), np.searchsorted(owner, owner[start], side="right")
                y = project(term, owner, start, end, terms)
                y *= (part / np.maximum(np.linalg.norm(y, axis=1), 1e-6))[:, None]
                last = before(term, owner)
                best: dict[tuple[int, int], tuple] = {}
                for lo in range(0, len(start), 1024):
                    sim = y[lo : lo + 1024] @ it.vectors.T
                    row, column = np.nonzero(sim >= LEAST_COSINE)
                    at, k = row + lo, it.of[column]
                    left, right = np.maximum(text_start[at], start[at] - sizes[k]), np.minimum(text_end[at], end[at] + sizes[k])
                    near = np.flatnonzero(words_in(has, k, term, last, left, right) >= least[k])
                    at = at[near]
                    places = (start[at], text_start[at], left[near], right[near], k[near], sim[row[near], column[near]])
                    for p, first, x, z, k, cosine in zip(*(v.tolist() for v in places), strict=True):
                        size, region, doc = masks[k][1], term[x:z].tolist(), int(owner[p])
                        matched = common(*masks[k], region)
                        if matched < enough(size):
                            continue
                        share = matched / size
                        tail = common(*ends[k], region) / max(ends[k][1], 1)
                        if share < COPY and tail < ANSWER:
                            continue
                        found = (share, cosine, tail, p - first)
                        if found > best.get((doc, k), (0,)):
                            best[doc, k] = found
                out += [(ids[base + d], it.ids[k], at, cos, share, tail) for (d, k), (share, cos, tail, at) in sorted(best.items())]
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return texts.select("doc_id", "terms").mapInArrow(released(run), "doc_id long, item_id long, word long, cosine double, overlap double, answer double")


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded vocabulary, streamed through the driver one block at a time."""
    block, size = [], 0
    for r in benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        words = len(plain(r[1]).split())
        if not words:
            continue
        if block and size + words > MOST_WORDS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += words
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that match, with the place and the measures.

    Rows with a null id, and texts or items without words, match nothing.
    Repeated rows are searched each; extra columns are ignored. An empty
    benchmark gives no rows. Each block of items (MOST_WORDS words) reads the
    documents once, into a table of terms that is read three times and stays in
    the shared folder.
    """
    small_batches(docs.sparkSession)
    src = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark):
        words = list({w for _, t in block for w in plain(t).split()})
        vocabulary = Vocabulary(np.unique(one_word_hashes(words)))
        texts = materialise(term_table(src, vocabulary), "terms")
        count, passages = frequencies(texts, len(vocabulary.hashes))
        space = Space(vocabulary, np.log((passages + 1) / (count + 1)) + 0.1, OTHER)
        space.terms = latent_terms(texts, space)
        found = materialise(search(texts, space, prepare_items(block, space)), "leaks")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, word long, cosine double, overlap double, answer double")
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with their columns."""
    leaks = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)

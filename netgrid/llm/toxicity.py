"""Toxicity by subword-bag embeddings.

A word is the mean of the vectors of its character n-grams (hashed), a passage
the mean of its words, and a linear softmax tells its class. Vectors
and softmax are trained jointly. A text is as toxic as its worst passage: the
passages of a toxic text that look worst are the ones trained as toxic.

As the softmax is linear in the mean, a word adds one number to the log-odds;
scoring a text is a sum over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.hashing import mix
from netgrid.llm.labelled import fitted, fold, keep_rows, logistic, sample_texts, sigmoid
from netgrid.llm.memory import released, small_batches

BUCKETS = 1 << 17
SIZE = 8  # of a vector
PASSAGE = 4  # words
STEP = 2
DROP = 0.4  # share of n-grams left out of a training step
EDGE = ".,;:!?\"'()[]{}<>|#%&*$-_/\\«»¿¡…“”‘’"
MOST_WORDS = 200_000  # that a worker keeps


def ngrams(words: list[str], size: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of 3 to 5 characters, with end marks, of all words; and each word's count."""
    parts = [_ngrams(words[i : i + size]) for i in range(0, len(words), size)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w.strip(EDGE) or w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    last = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(chars))
    h, buckets, owner = mix(chars + np.uint64(1)), [], []
    roll = np.zeros(len(chars), dtype=np.uint64)
    for k in range(5):
        roll[: len(chars) - k] = roll[: len(chars) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        if k >= 2:
            ok = at + k < last
            buckets.append((mix(roll[ok]) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(word[ok])
    flat = np.concatenate(owner)
    return np.concatenate(buckets)[np.argsort(flat, kind="stable")], np.bincount(flat, minlength=len(words))


def is_word(token: str) -> bool:
    """Whether a token has a letter or a digit; others, such as bars between words, take no part."""
    return any(map(str.isalnum, token))


def passages(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words; the last one ends with the text."""
    if n <= PASSAGE:
        return np.zeros(1 if n else 0, dtype=np.int64)
    return np.union1d(np.arange(0, n - PASSAGE + 1, STEP), [n - PASSAGE])


@dataclass
class Toxicity:
    worth: np.ndarray  # log-odds that each bucket adds to a passage's mean
    constant: float
    scale: tuple[float, float]  # from the worst passage's log-odds to those of the text

    def score(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        out = np.empty(len(texts))
        split = [(t or "").lower().split() for t in texts]
        new = list(set().union(*split).difference(known))
        if new and len(known) > MOST_WORDS:
            known.clear()
            new = list(set().union(*split))
        known.update((w, np.nan) for w in new if not is_word(w))
        new = [w for w in new if w not in known]
        if new:
            buckets, n = ngrams(new)
            known.update(zip(new, (np.add.reduceat(self.worth[buckets], np.cumsum(n) - n) / n).tolist(), strict=True))
        for i, tokens in enumerate(split):
            value = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
            value = value[~np.isnan(value)]
            if not len(value):
                out[i] = self.constant
                continue
            sums = np.zeros(len(value) + 1)
            np.cumsum(value, out=sums[1:])
            at = passages(len(value))
            end = np.minimum(at + PASSAGE, len(value))
            out[i] = ((sums[end] - sums[at]) / (end - at)).max() + self.constant
        return sigmoid(self.scale[0] * out + self.scale[1])


class _Bag:
    """The training texts as word numbers, their passages, and each word's buckets."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        word: dict[str, bool] = {}
        flat, starts, owner, size = [], [], [], 0
        for i, t in enumerate(texts):
            tokens = [w for w in t.lower().split() if word.get(w) or word.setdefault(w, is_word(w))]
            ids = np.array([number.setdefault(w, len(number)) for w in tokens], dtype=np.int32)
            p = passages(len(ids))
            flat.append(ids)
            starts.append(np.stack([p + size, np.minimum(p + PASSAGE, len(ids)) + size]).astype(np.int32))
            owner.append(np.full(len(p), i, np.int32))
            size += len(ids)
        none = np.zeros(0, np.int32)
        self.flat = np.concatenate([none, *flat])  # the words of all texts one after another
        self.start, self.end = np.concatenate([np.zeros((2, 0), np.int32), *starts], axis=1)  # of each passage
        self.owner = np.concatenate([none, *owner])
        self.text = list(number)
        del number, word, flat
        self.buckets, n = ngrams(self.text)
        self.first = np.concatenate([[0], np.cumsum(n)])

    def words(self, rows: np.ndarray) -> np.ndarray:
        """The words of passages, a row of PASSAGE each, filled up with -1."""
        at = self.start[rows][:, None] + np.arange(PASSAGE, dtype=np.int32)
        return np.where(at < self.end[rows][:, None], self.flat[np.minimum(at, max(len(self.flat) - 1, 0))], np.int32(-1))

    def add_misspelt(self, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Append copies of passages whose words are misspelt; the new row numbers."""
        ids = self.words(rows)
        made: dict[str, int] = {}
        new = [made.setdefault(misspelt(self.text[i], rng), len(made)) for i in ids[ids >= 0].tolist()]
        end = len(self.flat) + np.cumsum((ids >= 0).sum(1), dtype=np.int32)
        self.flat = np.concatenate([self.flat, np.array(new, dtype=np.int32) + np.int32(len(self.text))])
        buckets, n = ngrams(list(made))
        self.text += made
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        self.buckets = np.concatenate([self.buckets, buckets])
        first = len(self.start)
        self.start = np.concatenate([self.start, end - (ids >= 0).sum(1, dtype=np.int32)])
        self.end = np.concatenate([self.end, end])
        self.owner = np.concatenate([self.owner, self.owner[rows]])
        return np.arange(first, len(self.start))

    def expand(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the words one after another, where each begins, and how many it has."""
        n = self.first[ids + 1] - self.first[ids]
        begin = np.cumsum(n) - n
        return self.buckets[np.repeat(self.first[ids] - begin, n) + np.arange(n.sum())], begin, n


def misspelt(word: str, rng: np.random.Generator) -> str:
    """A word of four letters or more with one letter dropped, doubled, swapped with the next or replaced."""
    core = word.strip(EDGE)
    if len(core) < 4:
        return word
    i, kind = int(rng.integers(1, len(core) - 1)), int(rng.integers(4))
    if kind == 0:
        return core[:i] + core[i + 1 :]
    if kind == 1:
        return core[: i + 1] + core[i:]
    if kind == 2:
        return core[:i] + core[i + 1] + core[i] + core[i + 2 :]
    return core[:i] + "abcdefghijklmnopqrstuvwxyz0134*@$"[int(rng.integers(33))] + core[i + 1 :]


def _starts(n: int, size: int, least: int = 120) -> list[int]:
    """Starts of the batches of an epoch; few batches are gone through again, up to about ``least``."""
    one = list(range(0, n, size))
    return one * max(1, -(-least // len(one))) if one else []


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], axis=1)


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 5, rate: float = 0.5, seed: int = 3) -> Toxicity:
    """Train on whole texts. With one class only, every text gets that class's share as its score."""
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(np.clip(toxic.mean(), 0.01, 0.99)) if len(toxic) else 0.01
        return Toxicity(np.zeros(BUCKETS), 0.0, (0.0, float(np.log(share / (1 - share)))))
    rng = np.random.default_rng(seed)
    bag, n_texts = _Bag(texts), len(texts)
    del texts  # the bag holds what is needed
    vectors = rng.normal(0, 0.1, (BUCKETS, SIZE))
    soft = rng.normal(0, 0.5, (2, SIZE))
    bias, seen_v, seen_s = np.zeros(2), np.full((BUCKETS, 1), 1e-6), np.full((2, SIZE), 1e-6)
    y = toxic[bag.owner].astype(int)

    def odds(rows: np.ndarray) -> np.ndarray:
        worth = vectors @ (soft[1] - soft[0])
        value = np.zeros(len(bag.first))  # the last: no word
        for lo in range(0, len(value) - 1, 1 << 16):
            at = bag.first[lo : lo + (1 << 16) + 1]
            n = np.diff(at)
            value[lo : lo + len(n)] = np.add.reduceat(worth[bag.buckets[int(at[0]) : int(at[-1])]], (at[:-1] - at[0]).astype(np.int64)) / n
        out = np.empty(len(rows))
        for lo in range(0, len(rows), 1 << 16):
            w = bag.words(rows[lo : lo + (1 << 16)])
            out[lo : lo + (1 << 16)] = value[w].sum(1) / (w >= 0).sum(1)
        return out + bias[1] - bias[0]

    def worst(rows: np.ndarray, z: np.ndarray, k: int) -> np.ndarray:
        """The k passages of highest odds of each text."""
        order = np.lexsort((-z, bag.owner[rows]))
        own = bag.owner[rows][order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        return rows[order[rank < k]]

    real = len(y)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for epoch in range(epochs):
        if epoch == 0:
            a, b = pos, rng.choice(neg, min(len(neg), 2 * len(pos)), replace=False)
        else:
            a = worst(pos, odds(pos), 2)
            b = np.union1d(worst(neg, odds(neg), 1), rng.choice(neg, min(len(neg), 8 * len(a)), replace=False))
            if epoch > 1:  # by now the worst passages are known
                a = np.concatenate([a, bag.add_misspelt(np.concatenate([a, a]), rng)])
                b = np.concatenate([b, bag.add_misspelt(b, rng)])
                y = toxic[bag.owner].astype(int)
        rows = rng.permutation(np.concatenate([a, b]))
        weight = np.where(y[rows] == 1, 0.5 * len(rows) / max(len(a), 1), 0.5 * len(rows) / max(len(b), 1))
        size = 1024 if len(rows) > 40_000 else 256
        for lo in _starts(len(rows), size):
            r, wt = rows[lo : lo + size], weight[lo : lo + size]
            w = bag.words(r)
            ids, inv = np.unique(w, return_inverse=True)
            inv = inv.reshape(w.shape)
            pad = int(ids[0] == -1)
            idx, begin, n = bag.expand(ids[pad:])
            kept = rng.random(len(idx)) >= DROP  # so that no single n-gram carries a word
            n = np.maximum(np.add.reduceat(kept, begin, dtype=np.int64), 1)
            v = np.zeros((len(ids), SIZE))
            v[pad:] = np.add.reduceat(vectors[idx] * kept[:, None], begin) / n[:, None]
            count = (w >= 0).sum(1)[:, None]
            h = v[inv].sum(1) / count
            z = h @ soft.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(r)), y[r]] -= 1
            p *= wt[:, None] / len(r)
            d_soft, d_h = p.T @ h, p @ soft / count
            d_v = _sum_rows(inv.ravel(), np.repeat(d_h, PASSAGE, axis=0), len(ids))[pad:] / n[:, None]
            each = np.diff(np.append(begin, len(idx)))
            hit, where = np.unique(idx[kept], return_inverse=True)
            g = _sum_rows(where, np.repeat(d_v, each, axis=0)[kept], len(hit))
            seen_v[hit] += (g**2).mean(1, keepdims=True)
            vectors[hit] -= rate * g / np.sqrt(seen_v[hit])
            seen_s += d_soft**2
            soft -= 0.2 * d_soft / np.sqrt(seen_s)
            bias -= 0.1 * p.sum(0)
    model = Toxicity(vectors @ (soft[1] - soft[0]), float(bias[1] - bias[0]), (1.0, 0.0))
    z = odds(np.arange(real))
    top = np.full(n_texts, model.constant)
    np.maximum.at(top, bag.owner[:real], z)
    a, b = logistic(top[:, None], toxic, ridge=1e-5)
    return Toxicity(model.worth, model.constant, (float(a), float(b)))


def fit_on(docs: DataFrame, train: DataFrame, most: int) -> Toxicity:
    """Fit on the whole texts of at most ``most`` rows of ``train(doc_id, y)``."""
    return fitted(sample_texts(docs, train, most), lambda rows: fit(rows.pop("text"), np.array(rows["y"])))


def score_toxicity(docs: DataFrame, model: Toxicity, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row and its ``score``. Null or blank text is scored as a passage without words."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict[str, float] = {}
        for b in batches:
            score = np.concatenate([sent.value.score(b.column(0).slice(i, 128).to_pylist(), known) for i in range(0, b.num_rows, 128)] or [[]])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score)], names=[*keep, "score"])

    src = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    schema = src.select(*keep).schema.add("score", "double")
    return src.mapInArrow(released(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 6_000, held: int = 2, modulus: int = 4, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    The model is fitted on at most ``most`` labelled rows whose fold is not
    ``held``. Labels that are null, have no text or contradict one another are
    not learned; without labels, or with one class, every text gets that class's
    share (0.01 to 0.99) as its score. Tokens without a letter or digit are no
    words, so that bars between words part none. A text without words, null too, is scored as a
    passage without words; rows without an id and repeated ids are scored row
    by row, and a null id is not held out. Extra columns are not used; no rows give no rows.
    """
    train = labels.where(fold("doc_id", modulus) != held).select("doc_id", F.col("toxic").cast("double").alias("y"))
    out = score_toxicity(docs, fit_on(docs, train, most), ["doc_id"])
    return out.select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = 6_000, held: int = 2, modulus: int = 4, threshold: float = 0.3) -> DataFrame:
    """The documents that are not scored toxic, with their columns, row by row; rows without text stay, as do all where only clean texts are labelled."""
    train = labels.where(fold("doc_id", modulus) != held).select("doc_id", F.col("toxic").cast("double").alias("y"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_on(docs, train, most))

    def scorer():
        known: dict[str, float] = {}
        return lambda texts: np.where([bool(t) for t in texts], sent.value.score(texts, known), 0.0)

    return keep_rows(docs, scorer, lambda s: s < threshold)

"""Quality classifier by positive-unlabelled learning.

Trusted good texts are the positives; web text without labels is a mixture of
good and bad. A small network over the form of a text minimises the
non-negative unbiased risk (Kiryo et al., 2017) with an estimated share of good
texts among the unlabelled.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.labelled import fitted, fold, keep_rows, logistic, sample_texts, sigmoid
from netgrid.llm.memory import released, small_batches

HIDDEN = 16
_COUNTED = b"#%&*$!|?@/\\<>{}[]()_=+~^;:'\"-.,"


def form(text: str | None) -> np.ndarray:
    """Numbers about a whole text: shares of kinds of characters, repetition of words and lines, lengths."""
    t = text or ""
    data = t.encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = t.split(), [x for x in t.split("\n") if x]
    w, k = max(len(words), 1), max(len(lines), 1)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    upper, lower = h[65:91].sum(), h[97:123].sum()
    return np.array(
        [
            *(np.sqrt(h[list(_COUNTED)] / n)),
            np.sqrt(h[48:58].sum() / n), np.sqrt(h[128:].sum() / n), np.sqrt(h[10] / n), h[32] / n, np.sqrt(h[9] / n),
            upper / max(upper + lower, 1),
            distinct / w, np.log(distinct + 1) / np.log(w + 1.5), pairs / max(w - 1, 1),
            sum(map(operator.eq, words, words[1:])) / w,
            len(set(lines)) / k, min(np.log(w / k + 1), 8), min(np.log(w), 9),
            len(t) / w / 10 if len(t) < 40 * w else 4.0,
            sum(map(str.isalpha, words)) / w, sum(map(str.istitle, words)) / w, sum(map(str.isupper, words)) / w,
        ]
    )


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    scale: tuple[float, float] = (1.0, 0.0)

    def value(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.value(x) + self.scale[1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, bins: int = 20) -> float:
    """The share of positives among the unlabelled, from scores that tell the two samples apart.

    Where there are only positives the densities have the ratio of the share; the
    ratio over bins of equal positive mass is least there. The lower quartile of
    the bins' ratios damps chance.
    """
    cuts = np.quantile(positive, np.linspace(0, 1, bins + 1)[1:-1])
    p = np.bincount(np.searchsorted(cuts, positive), minlength=bins) / len(positive)
    u = np.bincount(np.searchsorted(cuts, unlabelled), minlength=bins) / len(unlabelled)
    ratio = u[p > 0] / p[p > 0]
    return float(np.clip(np.quantile(ratio, 0.25), 0.05, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, epochs: int = 60, rate: float = 0.01, seed: int = 5) -> tuple[Network, float]:
    """Minimise the non-negative risk by Adam; when the negative part falls below zero its gradient is turned round."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, spread = both.mean(0), both.std(0) + 1e-6
    if prior is None:
        z = np.clip((both - mean) / spread, -5, 5)
        y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
        c = logistic(z, y, ridge=1e-3)
        s = z @ c[:-1]
        prior = class_prior(s[: len(positive)], s[len(positive) :])
    d = both.shape[1]
    net = Network(mean, spread, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    moments = [[np.zeros_like(np.asarray(v, float)), np.zeros_like(np.asarray(v, float))] for v in (net.w1, net.b1, net.w2, net.b2)]
    step = 0
    for _ in range(epochs):
        u_order = rng.permutation(len(unlabelled))
        for lo in range(0, len(unlabelled), 512):
            u = unlabelled[u_order[lo : lo + 512]]
            p = positive[rng.integers(0, len(positive), 512)]
            z = np.clip((np.concatenate([p, u]) - mean) / spread, -5, 5)
            a = np.tanh(z @ net.w1 + net.b1)
            g = a @ net.w2 + net.b2
            s = sigmoid(g)
            # logistic losses: softplus(-g) for good, softplus(g) for bad
            gp, gu = g[: len(p)], g[len(p) :]
            bad = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            up, uu = s[: len(p)] / len(p), s[len(p) :] / len(u)
            if bad >= 0:
                dg = np.r_[prior * (s[: len(p)] - 1) / len(p) - prior * up, uu]
            else:
                dg = np.r_[prior * up, -uu]
            da = np.outer(dg, net.w2) * (1 - a**2)
            grads = [z.T @ da + 1e-4 * net.w1, da.sum(0), a.T @ dg + 1e-4 * net.w2, dg.sum()]
            step += 1
            new = []
            for v, gr, m in zip((net.w1, net.b1, net.w2, net.b2), grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * gr
                m[1] = 0.999 * m[1] + 0.001 * gr**2
                new.append(v - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = new
    return net, prior


def fit(good: list[str], unlabelled: list[str], bad: list[str]) -> tuple[Network, float] | None:
    """The network; its log-odds are scaled on trusted texts, where some are known to be bad."""
    if not good or not unlabelled:
        return None
    p, u = np.array([form(t) for t in good]), np.array([form(t) for t in unlabelled])
    net, prior = fit_pu(p, u)
    if bad:
        x = np.r_[net.value(p), net.value(np.array([form(t) for t in bad]))]
        a, b = logistic(x[:, None], np.r_[np.ones(len(good)), np.zeros(len(bad))])
        if a > 0:
            net.scale = (float(a), float(b))
    return net, prior


def score_quality(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``score`` of every row; 0.5 without a model. Null text is scored as an empty one."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            if sent.value is None or not b.num_rows:
                score = np.full(b.num_rows, 0.5)
            else:
                score = sent.value.score(np.array([form(t) for t in b.column(0).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score, pa.float64())], names=[*keep, "score"])

    src = docs.select(F.col("text").cast("string").alias("_text"), *keep)
    return src.mapInArrow(released(run), src.select(*keep).schema.add("score", "double"))


def fit_on(docs: DataFrame, labels: DataFrame, most: int, held: int, modulus: int) -> Network | None:
    """Fit on at most about ``most`` labelled and as many unlabelled rows, whole texts, outside the held-out fold."""
    use = fold("doc_id", modulus) != held
    known = sample_texts(docs, labels.where(use).select("doc_id", F.col("quality").cast("double").alias("y")), most)
    free = docs.where(use & F.col("text").isNotNull()).select("doc_id").join(labels.where("quality is not null"), "doc_id", "left_anti")
    others = sample_texts(docs, free.select("doc_id", F.lit(-1.0).alias("y")), most)

    def run(rows: dict[str, list]) -> Network | None:
        found = fit(*([x for x, v in zip(rows["text"], rows["y"], strict=True) if v == k] for k in (1, -1, 0)))
        return found and found[0]

    return fitted(known.unionByName(others), run)


def quality(docs: DataFrame, labels: DataFrame, most: int = 8_000, held: int = 0, modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Labels that are null, have no text or contradict one another are not
    learned. Without a good text, or without an unlabelled one, there is no
    model and every score is 0.5; without bad ones the scores are the network's
    own. A null text is scored as an empty one; rows without an id and repeated ids
    are scored row by row, and a null id is not held out. Extra columns are not used; no rows give no rows.
    """
    out = score_quality(docs, fit_on(docs, labels, most, held, modulus), ["doc_id"])
    return out.select(
        "doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, most: int = 8_000, held: int = 0, modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """The documents that are scored as good, with their columns, row by row; null texts are scored as empty ones; all stay where there is no model."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, most, held, modulus))

    def scorer():
        net = sent.value
        return lambda texts: net.score(np.array([form(t) for t in texts])) if net else np.ones(len(texts))

    return keep_rows(docs, scorer, lambda s: s >= threshold)

"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time. Every byte position gets a
label distribution from the states of both directions; a document's
probabilities are the mean over all positions of the whole text. Texts are run
as segments of ``SPAN`` bytes side by side, states starting at zero in each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.labelled import fitted, fold, sample
from netgrid.llm.memory import released, small_batches

STATE = 8
SPAN = 64
PAD = 256
BATCH = 4096  # segments side by side
F32 = np.float32


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (one row a segment, padded with PAD) of all texts, and each row's text number."""
    count = [-(-len(t) // SPAN) for t in texts]
    rows = np.full((sum(count), SPAN), PAD, dtype=np.int16)
    at = 0
    for t, c in zip(texts, count, strict=True):
        flat = rows[at : at + c].reshape(-1)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        at += c
    return rows, np.repeat(np.arange(len(texts)), count)


@dataclass
class Direction:
    x: np.ndarray  # (257, 3 STATE): input to the gates r, z and to the candidate, by byte
    u: np.ndarray  # (STATE, 3 STATE)
    backward: bool

    def steps(self) -> range:
        return range(SPAN - 1, -1, -1) if self.backward else range(SPAN)

    def run(self, rows: np.ndarray, keep: list | None = None):
        """Yields (position, states); ``keep`` gets what backpropagation needs."""
        h = np.zeros((len(rows), STATE), F32)
        half = F32(0.5)
        padded = (rows == PAD).any(axis=0)
        for t in self.steps():
            a = self.x[rows[:, t]]
            g = h @ self.u
            rz = np.tanh(half * (a[:, : 2 * STATE] + g[:, : 2 * STATE])) * half + half
            r, z = rz[:, :STATE], rz[:, STATE:]
            n = np.tanh(a[:, 2 * STATE :] + r * g[:, 2 * STATE :])
            new = n + z * (h - n)
            if padded[t]:
                new *= (rows[:, t] != PAD)[:, None]
            if keep is not None:
                keep.append((t, h, r, z, n, g[:, 2 * STATE :]))
            h = new
            yield t, h

    def grads(self, rows: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of x and u from those of the states, ``d_out[t]``, back through time."""
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh = np.zeros((len(rows), STATE), F32)
        for t, h, r, z, n, gn in reversed(kept):
            dh = (dh + d_out[t]) * (rows[:, t] != PAD)[:, None]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dr, dz, dn], axis=1)
            dg = np.concatenate([dr, dz, dn * r], axis=1)
            np.add.at(dx, rows[:, t], da)
            du += h.T @ dg
            dh = dh * z + dg @ self.u.T
        return dx, du


@dataclass
class Model:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # (2 STATE, languages)
    bias: np.ndarray

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities over the positions of each text; uniform for an empty one."""
        rows, owner = segments(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for lo in range(0, len(rows), BATCH):
            part = rows[lo : lo + BATCH]
            logits = np.empty((SPAN, len(part), len(self.languages)), F32)
            for t, h in self.ahead.run(part):
                np.matmul(h, self.out[:STATE], out=logits[t])
            for t, h in self.back.run(part):
                logits[t] += h @ self.out[STATE:]
            p = np.exp(logits + self.bias)
            p /= p.sum(axis=2, keepdims=True)
            p *= (part.T != PAD)[:, :, None]
            own, at = np.unique(owner[lo : lo + BATCH], return_index=True)
            total[own] += np.add.reduceat(p.sum(axis=0, dtype=float), at, axis=0)
        size = total.sum(axis=1, keepdims=True)
        return np.where(size > 0, total / np.maximum(size, 1e-9), 1 / max(len(self.languages), 1))


def fit(texts: list[bytes], langs: list[str], steps: int = 350, batch: int = 384, rate: float = 0.01, seed: int = 11) -> Model | None:
    """Train on random segments of whole texts, every language equally often, by Adam; None without texts."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    rows, owner = segments(texts)
    y = np.array([names.index(v) for v in langs])[owner]
    by = [np.flatnonzero(y == k) for k in range(len(names))]
    by = [b for b in by if len(b)]
    init = lambda *s: rng.normal(0, s[0] ** -0.5 if s[0] < 100 else 0.3, s).astype(F32)
    ahead, back = Direction(init(257, 3 * STATE), init(STATE, 3 * STATE), False), Direction(init(257, 3 * STATE), init(STATE, 3 * STATE), True)
    out, bias = init(2 * STATE, len(names)), np.zeros(len(names), F32)
    params = [ahead.x, ahead.u, back.x, back.u, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, -(-batch // len(by))) for b in by]) if by else np.zeros(0, int)
        if not len(pick):
            break
        part, label = rows[pick], y[pick]
        kept_a, kept_b = [], []
        states = np.zeros((SPAN, len(part), 2 * STATE), F32)
        for t, h in ahead.run(part, kept_a):
            states[t, :, :STATE] = h
        for t, h in back.run(part, kept_b):
            states[t, :, STATE:] = h
        z = states @ out + bias
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(part)), label] -= 1
        real = (part.T != PAD)[:, :, None]
        p = (p * real / real.sum()).astype(F32)
        d_out = np.tensordot(states, p, ((0, 1), (0, 1)))
        d_states = p @ out.T
        grads = [*ahead.grads(part, kept_a, d_states[:, :, :STATE]), *back.grads(part, kept_b, d_states[:, :, STATE:]), d_out, p.sum((0, 1))]
        lr = rate * min(1, 2 * (1 - step / (steps + 1)))
        for v, g, m, s in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(F32)
    return Model(names, ahead, back, out, bias)


def fit_on(docs: DataFrame, most: int, held: int, modulus: int, most_chars: int = 50_000_000) -> Model | None:
    """Fit on at most ``most`` documents with a language and about ``most_chars`` characters, outside the held-out fold, by a hash of the id."""
    src = docs.where("doc_id is not null and text is not null and lang is not null").where(fold("doc_id", modulus) != held)
    rows = sample(src.select("doc_id", F.col("text").cast("string").alias("text"), "lang"), ["text", "lang"], most, most_chars, 13)
    return fitted(rows, lambda t: fit([x.encode("utf-8", "surrogatepass") for x in t["text"]], t["lang"]))


def languages(docs: DataFrame, most: int = 3_000, held: int = 0, modulus: int = 5) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row: score is the document's probability of lang_pred.

    Texts that are null or have no letter, and all texts when nothing was
    learned, are ``und`` with score 0. Extra columns are not used.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_on(docs, most, held, modulus))

    def run(batches):
        m = model.value
        for b in batches:
            names, scores = [], []
            for lo in range(0, b.num_rows, 256):
                texts = b.column(1).slice(lo, 256).to_pylist()
                real = [i for i, t in enumerate(texts) if t and m and any(map(str.isalpha, t))]
                name, score = ["und"] * len(texts), [0.0] * len(texts)
                if real:
                    p = m.probabilities([texts[i].encode("utf-8", "surrogatepass") for i in real])
                    for i, k, v in zip(real, p.argmax(axis=1), p.max(axis=1), strict=True):
                        name[i], score[i] = m.languages[k], float(v)
                names += name
                scores += score
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(released(run), src.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))
    return out.select("doc_id", F.coalesce(fold("doc_id", modulus) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")

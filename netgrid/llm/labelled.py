"""Bounded samples of labelled rows, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.llm.memory import released, small_batches, trim


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def least_hash(most: int, total: int) -> int | None:
    """64-bit hashes below this keep about half as many again of ``total`` ids as are wanted; None keeps all."""
    share = (1.5 * most + 10 * most**0.5) / max(total, 1)
    return None if share >= 1 else int(-(2.0**63) + share * 2.0**64)


def sample(docs: DataFrame, columns: list[str], most: int, most_chars: int, seed: int) -> DataFrame:
    """``doc_id`` and ``columns`` (the text first) of at most ``most`` ids, those of least hash, and about ``most_chars`` characters.

    The bounds hold for every table: a repeated id counts once, with the least
    of its rows. A text that alone is longer than ``most_chars`` is passed
    over; of the others those up to ``most_chars`` in all, in the order of the hash, are taken.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    some = docs.where("doc_id is not null")
    cut = least_hash(most, some.agg(F.approx_count_distinct("doc_id")).first()[0])
    if cut is not None:
        some = some.where(h < cut)
    one = some.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("row")).select("doc_id", "row.*", h.alias("_h"))
    one = one.where(F.length(columns[0]) <= most_chars).orderBy("_h", "doc_id").limit(most)
    before = Window.orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``most`` rows
    one = one.withColumn("_before", F.coalesce(F.sum(F.length(columns[0])).over(before), F.lit(0)) + F.length(columns[0]))
    return one.where(F.col("_before") <= most_chars).select("doc_id", *columns)


def sample_texts(docs: DataFrame, labels: DataFrame, most: int, most_chars: int = 50_000_000, seed: int = 7) -> DataFrame:
    """``(doc_id, text, y)``: whole texts and labels of at most ``most`` ids of ``labels(doc_id, y)``, by a hash of the id.

    An id with different labels is left out, and so are nulls; see ``sample``.
    """
    one = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
    # ids that have no text, and texts beyond the bound, leave room: half as many labelled ids again are looked up
    found = sample(one.select("doc_id", F.lit("").alias("_"), F.col("y").cast("double").alias("y")), ["_", "y"], most + most // 2, most_chars, seed).select("doc_id", "y")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    return sample(rows.join(F.broadcast(found), "doc_id"), ["text", "y"], most, most_chars, seed)


def fitted(rows: DataFrame, fit: Callable[[dict[str, list]], Any]) -> Any:
    """The model that ``fit`` makes of the columns of a bounded table, in the order of all its columns: in one task, so that the driver holds only the model."""
    names = rows.columns

    def run(batches):
        got = list(batches)
        t = pa.Table.from_batches(got).sort_by([(c, "ascending") for c in names]) if got else None
        columns = {c: t.column(c).to_pylist() if t else [] for c in names}
        del got, t
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(columns))], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(released(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else fit({c: [] for c in names})


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(y)) if weight is None else weight
    c = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge * len(y) * c * np.r_[np.ones(len(c) - 1), 0]
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * len(y) * np.diag(np.r_[np.ones(len(c) - 1), 1e-6])
        step = np.linalg.solve(hess, grad)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def keep_rows(docs: DataFrame, scorer, good) -> DataFrame:
    """The rows of ``docs`` whose scores ``good`` accepts, all columns unchanged; ``scorer()`` makes a function of texts in each task.

    Every row is judged by its own text, so repeated ids stay or go one by one.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    texts = docs.withColumn("text", F.col("text").cast("string")) if dict(docs.dtypes)["text"] != "string" else docs

    def run(batches):
        score = scorer()
        for b in batches:
            mask = [x for i in range(0, b.num_rows, 128) for x in good(score(b.column(at).slice(i, 128).to_pylist())).tolist()]
            yield b.filter(pa.array(mask, pa.bool_()))

    return texts.mapInArrow(released(run), texts.schema)

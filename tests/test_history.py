"""Undo and redo: words against single steps, and whole logs against two stacks."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from netgrid.operators import history
from netgrid.operators.history import PUSH, REDO, UNDO, Word
from netgrid.plans.order import running


def walk(steps, k, n):
    for s in steps:
        if s == UNDO:
            k = max(k - 1, 0)
        elif s == REDO:
            k = min(k + 1, n)
        else:
            k += 1
            n = k
    return k, n


def word(steps):
    w = Word()
    for s in steps:
        w.add(s)
    return w


def test_every_short_word():
    states = [(k, n) for n in range(5) for k in range(n + 1)]
    for size in range(8):
        for steps in itertools.product((UNDO, REDO, PUSH), repeat=size):
            w = word(steps)
            for k, n in states:
                assert w.apply(k, n) == walk(steps, k, n), (steps, w.runs, k, n)


def test_long_words_stay_short():
    rng = random.Random(1)
    for weights in ((1, 1, 1), (5, 1, 1), (1, 1, 5), (4, 4, 1), (3, 2, 2)):
        steps = rng.choices((UNDO, REDO, PUSH), weights, k=20000)
        w = word(steps)
        assert len(w.runs) < 200
        for k, n in ((0, 0), (3, 9), (50, 50), (700, 900), (10**6, 2 * 10**6)):
            assert w.apply(k, n) == walk(steps, k, n)


def stacks(ops):
    done, undone = [], []
    for i, o in ops:
        if o == "undo":
            undone += [done.pop()] if done else []
        elif o == "redo":
            done += [undone.pop()] if undone else []
        else:
            done.append(i)
            undone = []
    return done


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_logs_equal_two_stacks(spark, parts):
    """One job with most rows over many ranges, others within and across them."""
    rng = random.Random(parts)
    rows = []
    for job, size, weights in ((1, 3000, (3, 2, 4)), (2, 40, (1, 1, 1)), (3, 1, (0, 0, 1)), (4, 5, (1, 1, 0)), (5, 600, (6, 5, 2)), (6, 300, (1, 0, 8)), (7, 200, (9, 9, 1))):
        for i in range(size):
            o = rng.choices(("undo", "redo", "op"), weights)[0]
            rows.append((job, 10 * i + job, rng.choice(["add", "delete", None]) if o == "op" else o))
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "job_id long, seq long, op string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in history.live_operations(log).collect():
            got.setdefault(r.job_id, []).append(r.seq)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for job in range(1, 8):
        assert sorted(got.get(job, [])) == stacks(sorted((s, o) for j, s, o in rows if j == job)), job


def test_empty_log_and_other_columns(spark):
    log = spark.createDataFrame([(None, 1, "add", "x"), (None, 2, "undo", "y"), (None, 3, "add", "z")], "job_id long, seq long, op string, place string")
    assert [(r.seq, r.place) for r in history.live_operations(log).collect()] == [(3, "z")]
    none = history.live_operations(log.limit(0))
    assert none.count() == 0 and none.columns == log.columns


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b", "c"]), i, rng.choice([None, 1, 5, -2])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    got = {(r.k, r.i): (r.before, r.twice) for r in running(df.withColumn("w", F.col("v") * 2), [F.col("k").asc_nulls_first(), "i"], {"before": "v", "twice": "w"}).collect()}
    total = 0
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        assert got[k, i] == (total, 2 * total)
        total += v or 0

"""Ledgers in the order of event time: a shuffled stream gives the batch run's rows; late rows are counted."""

import datetime as dt
import random
import time

from netgrid.streaming import trace

T0 = dt.datetime(2024, 1, 1)
FIELDS = "task_id long, step int, at timestamp, score double, version long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, folder, name, batches, build, schema):
    """Each batch is one file, read in turn; rows of the memory sink and what the listener counted."""
    src = f"{folder}/{name}"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)  # files are read by the time they were written
    heard = trace.LateRows()
    spark.streams.addListener(heard)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(100):  # events reach the listener a little later
        if str(q.id) in heard.finished:
            break
        time.sleep(0.1)
    spark.streams.removeListener(heard)
    return spark.table(name).collect(), heard.dropped[name]


def key(rows):
    return sorted((r.task_id, r.at, r.step, r.is_best, r.plateau) for r in rows)


def test_rows_out_of_order_give_the_batch_run(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, s, at(3 * s + k), rng.choice([None, rng.random()]) if s % 5 == 0 else rng.random(), rng.randrange(2)) for k in range(4) for s in range(1, 25)]
    rows += [(9, 1, None, 0.5, 0)]
    dealt = sorted(rows, key=lambda r: (r[2] or T0) + dt.timedelta(minutes=rng.uniform(0, 25)))  # up to 25 minutes late
    end = [(5, 1, at(1000), 0.1, 0)]
    batches = [dealt[i : i + 20] for i in range(0, len(dealt), 20)] + [end]
    got, dropped = run(spark, tmp_path, "ordered_rows", batches, lambda s: trace.ordered_ledger(s, "30 minutes"), FIELDS)
    want = trace.ordered_ledger(spark.createDataFrame(rows, FIELDS)).collect()
    assert dropped == 0 and key(got) == key(want) and len(want) == len(rows) - 1
    assert any(r.plateau for r in want) and any(r.is_best for r in want)
    best, n, since, version = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):  # the rule by itself
        if r[2] is None:
            continue
        k = r[0]
        better = r[3] is not None and (k not in best or (version[k] == r[4] and r[3] > best[k] + trace.MIN_GAIN))
        if better:
            best[k], version[k] = r[3], r[4]
        n[k], since[k] = n.get(k, 0) + 1, 0 if better else since.get(k, 0) + 1
        assert (k, r[2], r[1], better, n[k] > 2 and since[k] >= 2) in key(want)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    batches = [[(1, 1, at(0), 0.5, 0), (1, 2, at(100), 0.6, 0)], [(2, 1, at(200), 0.5, 0)], [(1, 3, at(5), 0.9, 0), (1, 4, at(6), 0.9, 0), (1, 5, at(205), 0.7, 0)], [(3, 1, at(900), 0.1, 0)]]
    got, dropped = run(spark, tmp_path, "late_rows", batches, lambda s: trace.ordered_ledger(s, "10 minutes"), FIELDS)
    assert sorted((r.task_id, r.step, r.is_best) for r in got) == [(1, 1, True), (1, 2, True), (1, 5, True), (2, 1, True)]
    assert dropped == 2


def test_late_rows_of_sessions_and_windows(spark, tmp_path):
    fields = "job_id long, at timestamp, type string"
    late = [(1, at(1), "tool_call"), (2, at(2), "tool_call"), (2, at(700), "tool_call")]
    batches = [[(1, at(0), "tool_call")], [(1, at(600), "tool_call")], [(1, at(601), "tool_call")], late, [(1, at(5000), "tool_call")]]
    _, dropped = run(spark, tmp_path, "late_sessions", batches, lambda s: trace.sessions(s, "10 minutes", "10 minutes"), fields)
    assert dropped == 2
    _, dropped = run(spark, tmp_path, "late_windows", batches, lambda s: trace.activity_windows(s, "1 hour"), fields)
    assert dropped == 2


def test_empty_ledger(spark):
    assert trace.ordered_ledger(spark.createDataFrame([], FIELDS)).count() == 0

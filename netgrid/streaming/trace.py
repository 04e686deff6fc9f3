"""Operators on traces and ledgers that run in batch and as Structured Streaming."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from netgrid.operators.edits import merge_network
from netgrid.operators.grid import taper
from netgrid.operators.ledger import MIN_GAIN, plateau, running_best
from netgrid.operators.lines import live_operations


def pair_calls(trace: DataFrame, late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Calls with their results and durations; a call without a result stays, with nulls.

    On a stream: an interval join with watermarks on both sides, so a lost call
    comes out once the watermark has passed the interval.
    """
    call = trace.where("type = 'tool_call'").select("job_id", "call_id", "tool", F.col("at").alias("called"))
    result = trace.where("type = 'tool_result'").select(F.col("job_id").alias("rj"), F.col("call_id").alias("rc"), F.col("at").alias("answered"))
    on = (F.col("job_id") == F.col("rj")) & (F.col("call_id") == F.col("rc"))
    if trace.isStreaming:
        call, result = call.withWatermark("called", late), result.withWatermark("answered", late)
        on = on & (F.col("answered") >= F.col("called")) & (F.col("answered") <= F.col("called") + F.expr(f"INTERVAL {within}"))
    return call.join(result, on, "left_outer").drop("rj", "rc").withColumn("seconds", F.expr("timestampdiff(SECOND, called, answered)"))


def activity_windows(trace: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and calls of every job in tumbling or sliding windows; late rows are dropped on a stream."""
    t = trace.withWatermark("at", late) if trace.isStreaming else trace
    out = t.groupBy("job_id", F.window("at", size, slide)).agg(F.count("*").alias("n"), F.count(F.when(F.col("type") == "tool_call", 1)).alias("calls"))
    return out.select("job_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "calls")


def sessions(trace: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    t = trace.withWatermark("at", late) if trace.isStreaming else trace
    out = t.groupBy("job_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return out.select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_ledger(measurements: DataFrame) -> DataFrame:
    """Keep-best over ``(task_id, step, score, version)``: on a stream ``is_best`` as rows arrive, state = the best so far."""
    if not measurements.isStreaming:
        return running_best(measurements).select("task_id", "step", "score", "is_best")

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, version = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("step")
        flags = []
        for score, v in zip(rows["score"], rows["version"], strict=True):
            better = best is None or (v == version and score > best + MIN_GAIN)
            if better:
                best, version = float(score), int(v)
            flags.append(better)
        state.update((best, version))
        yield pd.DataFrame({"task_id": rows["task_id"], "step": rows["step"], "score": rows["score"], "is_best": flags})

    return measurements.groupBy("task_id").applyInPandasWithState(
        update, "task_id long, step int, score double, is_best boolean", "best double, version long", "append", "NoTimeout"
    )


def ordered_ledger(measurements: DataFrame, late: str = "10 minutes", window: int = 2) -> DataFrame:
    """Keep-best and plateau over ``(task_id, step, at, score, version)`` in the order of event time, then step.

    On a stream, rows wait in a task's state until the watermark has passed
    their time, so rows that come out of order, within ``late``, give what the
    batch run gives; later ones are dropped and counted in the query's progress
    (``LateRows``). A task that gets no more rows is woken by an event-time timer. Rows without a
    time are left out; a null score is never best. Repeated rows count as often as they come.
    """
    m = measurements.where("at IS NOT NULL").select("task_id", "step", "at", F.col("score").cast("double"), F.col("version").cast("long"))
    if not measurements.isStreaming:
        placed = m.withColumn("_nth", F.row_number().over(Window.partitionBy("task_id").orderBy("at", "step", "score", "version")))
        out = plateau(running_best(placed, "task_id", "_nth"), "task_id", "_nth", window)
        return out.select("task_id", "step", "at", "score", "is_best", "plateau")

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, version, n, since, *held = state.get if state.exists else (None, None, 0, 0, [], [], [], [])
        waiting = list(zip(*held, strict=True))
        for p in parts:
            cols = (p["at"].astype("int64") // (1000 if p["at"].dtype == "datetime64[ns]" else 1), p["step"], p["score"], p["version"])
            waiting += zip(*([None if pd.isna(x) else x for x in c.tolist()] for c in cols), strict=True)
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[0], *((x is not None, x or 0) for x in r[1:])))
        ready = [r for r in waiting if r[0] <= passed * 1000]
        waiting = waiting[len(ready) :]
        rows = []
        for at, step, score, v in ready:
            better = score is not None and (best is None or (v == version and score > best + MIN_GAIN))
            if better:
                best, version = score, v
            n, since = n + 1, 0 if better else since + 1
            rows.append((key[0], step, at, score, better, n > window and since >= window))
        state.update((best, version, n, since, *([list(c) for c in zip(*waiting, strict=True)] or [[], [], [], []])))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed) + 1)
        out = pd.DataFrame(rows, columns=["task_id", "step", "at", "score", "is_best", "plateau"])
        yield out.astype({"at": "int64", "score": "float64"}).assign(at=lambda d: pd.to_datetime(d["at"], unit="us"))

    return m.withWatermark("at", late).groupBy("task_id").applyInPandasWithState(
        update, "task_id long, step int, at timestamp, score double, is_best boolean, plateau boolean",
        "best double, version long, n long, since long, ats array<long>, steps array<int>, scores array<double>, versions array<long>", "append", "EventTimeTimeout",
    )


class LateRows(StreamingQueryListener):
    """Counts by query (its name, or else its id) of what stateful operators dropped behind the watermark.

    Sessions and ``ordered_ledger`` drop single rows. Windows drop what Spark
    has counted already within a task: rows of one key and window that come in one task of one batch count once.
    Add it with ``spark.streams.addListener``; ``dropped`` is filled as batches end.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()
        self.finished: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.dropped[p.name or str(p.id)] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.finished.add(str(event.id))


def stream_chips(chips: DataFrame, keys: list[str], size: int, overlap: int, late: str = "10 minutes") -> DataFrame:
    """Running mosaic of chips as they come: ``(keys, r, c, v)`` with sums of weighted values over sums of weights.

    ``chips``: keys, chip_id, version, at, row_off, col_off, data (row by row). On a stream a chip that comes
    again with its version is dropped within the watermark, and the output
    mode is update. A chip of size * size values is one row.
    """
    once = ["chip_id", "version"]
    src = chips.withWatermark("at", late).dropDuplicatesWithinWatermark([*keys, *once]) if chips.isStreaming else chips.dropDuplicates([*keys, *once])
    cell = src.select(*keys, "row_off", "col_off", F.posexplode("data").alias("i", "m"))
    cell = cell.withColumns({"j": F.floor(F.col("i") / size).cast("int"), "k": (F.col("i") % size).cast("int")})
    w = taper(F.col("j"), F.lit(size), F.lit(overlap)) * taper(F.col("k"), F.lit(size), F.lit(overlap))
    at = cell.select(*keys, (F.col("row_off") + F.col("j")).alias("r"), (F.col("col_off") + F.col("k")).alias("c"), (F.col("m") * w).alias("mw"), w.alias("w"))
    return at.groupBy(*keys, "r", "c").agg((F.sum("mw") / F.sum("w")).alias("v"))


def rebuilt(log: DataFrame, model: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """The merged network of every job of an edit log ``(job, seq, op, x0, y0, x1, y1)``; ``model`` has lines by job.

    Standing adds and replaces are human lines, deletes are deleted ones.
    """
    live = live_operations(log.select(job, order, "op")).select(job, order)
    ops = log.join(live, [job, order], "left_semi")
    ends = ["x0", "y0", "x1", "y1"]
    human = ops.where("op IN ('add', 'replace')").select(job, (-F.col(order) - 1).alias("line_id"), *ends)  # apart from the model's ids
    gone = ops.where("op = 'delete'").select(job, F.col(order).alias("line_id"), *ends)
    return merge_network(model, human, gone, [job])


def stream_edits(edits: DataFrame, history: str, model: DataFrame, emit, job: str = "job_id", order: str = "seq"):
    """A ``foreachBatch`` writer: each batch is appended to the log in ``history``, and the networks of the jobs it touches are rebuilt.

    ``emit(network, batch_id)`` gets them. A batch that is tried again is written
    to the same folder, so its rows do not count twice.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
        touched = spark.read.parquet(f"{history}/batch={batch_id}").select(job).distinct()
        log = spark.read.parquet(history).where(F.col("batch") <= batch_id).drop("batch").join(touched, job, "left_semi")
        emit(rebuilt(log, model.join(touched, job, "left_semi"), job, order), batch_id)

    return edits.writeStream.foreachBatch(each)

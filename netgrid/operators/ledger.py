"""Candidate settings, measurement ledgers and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.operators.evaluate import beta_of, f_beta
from netgrid.plans.order import fold

MIN_GAIN = 0.003
# fixed values: names and ranges of settings
ALIASES = {"mask_threshold": "threshold", "thr": "threshold"}
SPEC = {"threshold": (0.0, 1.0, False), "close_radius": (0, 10, True), "min_hole_px": (0, 100000, True), "min_object_px": (0, 100000, True), "simplify_m": (0.0, 50.0, False), "min_length_m": (0.0, 1000.0, False)}


def normalise_variants(variants: DataFrame) -> DataFrame:
    """``(variant_id, settings, error)`` from rows ``(variant_id, settings MAP<STRING, STRING>)``.

    Aliases are resolved, whole numbers rounded half to even, ranges checked,
    the threshold set to 0.5 where it is missing, repeated settings dropped.
    """
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    each = variants.select("variant_id", F.explode_outer("settings").alias("k", "raw")).withColumn("k", F.coalesce(F.element_at(alias, F.col("k")), F.col("k")))
    value, lo, hi, whole = F.expr("try_cast(raw AS double)"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False)
    for name, (a, b, w) in SPEC.items():
        hit = F.col("k") == name
        lo, hi, whole = F.when(hit, float(a)).otherwise(lo), F.when(hit, float(b)).otherwise(hi), F.when(hit, w).otherwise(whole)
    v = F.when(whole, F.rint(value)).otherwise(value)
    err = F.when(F.col("k").isNull(), None).when(~F.col("k").isin(*SPEC), F.concat(F.lit("unknown: "), "k")).when(value.isNull(), F.concat(F.lit("not a number: "), "k")).when((v < lo) | (v > hi), F.concat(F.lit("out of range: "), "k"))
    one = each.select("variant_id", "k", v.alias("v"), err.alias("err")).groupBy("variant_id").agg(
        F.min("err").alias("error"), F.sort_array(F.collect_set(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("kv")
    )
    with_t = F.when(F.exists("kv", lambda x: x["k"] == "threshold"), F.col("kv")).otherwise(F.array_sort(F.concat("kv", F.array(F.struct(F.lit("threshold").alias("k"), F.lit(0.5).alias("v"))))))
    text = F.array_join(F.transform(with_t, lambda x: F.concat_ws("=", x["k"], F.format_number(x["v"], 4))), ";")
    out = one.select("variant_id", F.when(F.col("error").isNull(), text).alias("settings"), "error")
    first = F.row_number().over(Window.partitionBy("settings").orderBy("variant_id"))
    return out.withColumn("n", first).where("error IS NOT NULL OR n = 1").drop("n")


def with_score(m: DataFrame, objective: Column) -> DataFrame:
    return m.withColumn("score", f_beta(F.col("prec"), F.col("rec"), beta_of(objective)))


def running_best(m: DataFrame, task: str = "task_id", order: str = "step", gain: float = MIN_GAIN) -> DataFrame:
    """``is_best``: the first measurement, and each that beats the best so far by more than ``gain`` on the same map version.

    A fold over each task's ordered measurements; a measurement of another
    version than the best's is not comparable and changes nothing. Steps are told apart by ``order``.
    """

    def step(best: list, o: int, score: float | None, version: int | None) -> tuple | None:
        if score is None:
            return None
        if not best or (version == best[1] and score > best[0] + gain):
            best[:] = score, version
            return (o,)
        return None

    own = m.withColumns({"version": F.col("version").cast("long"), "score": F.col("score").cast("double")})
    found = fold(own, task, order, [order, "score", "version"], [m.schema[order]], list, step).distinct().withColumn("is_best", F.lit(True))
    return m.join(found, [task, order], "left").withColumn("is_best", F.coalesce("is_best", F.lit(False)))


def plateau(m: DataFrame, task: str = "task_id", order: str = "step", window: int = 2) -> DataFrame:
    """More than ``window`` measurements, and none of the last ``window`` is best."""
    w = Window.partitionBy(task).orderBy(order).rowsBetween(1 - window, 0)
    n = F.row_number().over(Window.partitionBy(task).orderBy(order))
    return m.withColumn("plateau", (n > window) & (F.max(F.col("is_best").cast("int")).over(w) == 0))


def task_state(m: DataFrame, target_p: float, target_r: float, task: str = "task_id", order: str = "step") -> DataFrame:
    """Of each task the last and the best measurement: worse than best, targets met, verdict."""
    last, best = F.max_by(F.struct("score", "prec", "rec", "plateau"), order), F.max_by(F.struct("score", order), F.struct(F.col("is_best"), F.col(order)))
    s = m.groupBy(task).agg(last.alias("last"), best.alias("best"), F.count("*").alias("n"))
    worse = F.col("last.score") < F.col("best.score") - MIN_GAIN
    met = (F.col("last.prec") >= target_p) & (F.col("last.rec") >= target_r)
    unmet = F.array_compact(F.array(F.when(worse, "worse_than_best"), F.when(~met, "targets"), F.when(~F.col("last.plateau"), "no_plateau")))
    verdict = F.when(met & ~worse, "complete").when(F.col("last.plateau"), "best_effort").otherwise("incomplete")
    return s.select(task, "n", F.col(f"best.{order}").alias("best_step"), worse.alias("worse"), met.alias("met"), F.array_join(unmet, ",").alias("unmet"), verdict.alias("verdict"))


def budget_use(calls: DataFrame, caps: dict[str, int], task: str = "job_id", tool: str = "tool") -> DataFrame:
    """Successful calls of each capped tool and what is left."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(tool))
    used = calls.where(F.col(tool).isin(*caps)).groupBy(task, tool).agg(F.count(F.when(F.col("ok"), 1)).alias("used"))
    return used.withColumn("left", F.greatest(cap - F.col("used"), F.lit(0)))


def repeat_calls(calls: DataFrame, keys: list[str], order: str, limit: Column) -> DataFrame:
    """``nth`` call with the same keys, and whether it is beyond the limit."""
    nth = F.count("*").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("nth", nth).withColumn("refused", F.col("nth") > limit)


def order_violations(calls: DataFrame, needs: dict[str, str], task: str = "job_id", order: str = "seq", stage: str = "stage") -> DataFrame:
    """Calls of a stage before the stage that it needs was first called."""
    pre = F.element_at(F.create_map(*[F.lit(x) for kv in needs.items() for x in kv]), F.col(stage))
    first = calls.groupBy(task, F.col(stage).alias("need")).agg(F.min(order).alias("first"))
    c = calls.withColumn("need", pre).where("need IS NOT NULL").join(first, [task, "need"], "left")
    return c.where(F.col("first").isNull() | (F.col("first") > F.col(order))).drop("first")


def content_version(cells: DataFrame, keys: list[str], value: str = "conf") -> DataFrame:
    """Identity of a map by its contents, in whatever order its rows are; repeated rows count as often as they come."""
    h = F.xxhash64("r", "c", value)
    sums = cells.groupBy(*keys).agg(F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return sums.select(*keys, F.xxhash64("x", F.col("s").cast("string"), "n").alias("version"), "n")


def unsupported_numbers(replies: DataFrame, evidence: DataFrame, task: str, text: str = "text", value: str = "value") -> DataFrame:
    """Numbers 0.dd to 0.dddd in replies that no evidence number of the task rounds to at the precision written."""
    tok = replies.select(task, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(0\.[0-9]{2,4})\b"), 1))).alias("token"))
    tok = tok.withColumn("digits", F.length("token") - 2).distinct()
    known = evidence.select(task, F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("digits"), value)
    known = known.select(task, "digits", F.when(F.col("digits") == 2, F.format_string("%.2f", value)).when(F.col("digits") == 3, F.format_string("%.3f", value)).otherwise(F.format_string("%.4f", value)).alias("token")).distinct()
    return tok.join(known, [task, "digits", "token"], "left_anti")


def parse_reviews(replies: DataFrame, text: str = "text") -> DataFrame:
    """Fields of the JSON between the first and the last brace; -1 for missing or non-numeric scores; problems at most 8 of 160 characters."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    num = lambda k: F.coalesce(F.expr(f"try_cast(get_json_object(body, '$.{k}') AS double)"), F.lit(-1.0))
    raw = F.get_json_object("body", "$.problems")
    many = F.coalesce(F.from_json(raw, "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))
    return replies.withColumn("body", body).select(
        *replies.columns, *[num(k).alias(k) for k in ("completeness", "correctness", "overall")], F.substring(F.coalesce(F.get_json_object("body", "$.verdict"), F.lit("")), 1, 300).alias("verdict"),
        F.transform(F.slice(many, 1, 8), lambda x: F.substring(x, 1, 160)).alias("problems"),
    )


def state_as_of(copies: DataFrame, live: DataFrame, cid: int, keys: list[str]) -> DataFrame:
    """Content of every artefact when a checkpoint began: the earliest copy at or after it, else the live one; absent ones have no row."""
    c = copies.where(F.col("cid") >= cid).groupBy(*keys).agg(F.min_by(F.struct("content", "absent"), "cid").alias("x")).select(*keys, "x.*")
    rest = live.join(c, keys, "left_anti").select(*keys, "content", F.lit(False).alias("absent"))
    return c.unionByName(rest).where("NOT absent").drop("absent")


def after_rewind(events: DataFrame, rewinds: DataFrame, job: str = "job_id", offset: str = "offset") -> DataFrame:
    """Events that no later rewind took back. ``rewinds``: job, at (offset of the rewind), to (offset it went back to)."""
    w = Window.partitionBy(job).orderBy(F.desc("o"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    e = events.select("*", F.col(offset).alias("o"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("to"))
    r = rewinds.select(job, F.col("at").alias("o"), F.lit(1).alias("kind"), F.col("to").cast("long"))
    both = e.unionByName(r, allowMissingColumns=True).withColumn("floor", F.min("to").over(w))
    return both.where((F.col("kind") == 0) & (F.col("floor").isNull() | (F.col("o") < F.col("floor")))).select(*events.columns)


def best_epoch(log: DataFrame, epoch: str = "epoch", domain: str = "domain") -> DataFrame:
    """Score of each epoch (mean of the domains' micro IoU), and whether it beats every earlier one."""
    d = log.groupBy(epoch, domain).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    s = d.groupBy(epoch).agg(F.avg(F.col("tp") / F.greatest(F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))).alias("score"))
    before = F.max("score").over(Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("is_best", F.coalesce(F.col("score") > before, F.lit(True)))


def restore_best(versions: DataFrame, m: DataFrame, task: str = "task_id", step: str = "step") -> DataFrame:
    """The rows of the best measurement of each task."""
    best = m.where("is_best").groupBy(task).agg(F.max(step).alias(step))
    return versions.join(best, [task, step], "left_semi")

"""Scores of confidence grids and masks against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.operators.blocks import as_given, grown, offsets


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def f_beta(p: Column, r: Column, beta: Column | float) -> Column:
    """Weighted harmonic mean; 0 where both are."""
    b2 = (beta if isinstance(beta, Column) else F.lit(float(beta))) ** 2
    return ratio((1 + b2) * p * r, b2 * p + r)


def beta_of(objective: Column) -> Column:
    return F.when(objective == "precision", 0.5).when(objective == "recall", 2.0).otherwise(1.0)


def with_scores(counts: DataFrame) -> DataFrame:
    """iou, precision, recall and f1 from tp, fp and fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0))


def confusion(pred: DataFrame, truth: DataFrame, keys: list[str], ignore: DataFrame | None = None) -> DataFrame:
    """Counts and scores of sparse masks (rows are set cells); cells of ``ignore`` count in neither."""
    at = [*keys, "r", "c"]
    if ignore is not None:
        pred, truth = (x.join(ignore.select(*at), at, "left_anti") for x in (pred, truth))
    both = pred.select(*at).distinct().withColumn("p", F.lit(1)).unionByName(truth.select(*at).distinct().withColumn("t", F.lit(1)), allowMissingColumns=True)
    cell = both.groupBy(*at).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    n = lambda x: F.count(F.when(x, 1))
    p, t = F.col("p").isNotNull(), F.col("t").isNotNull()
    return with_scores(cell.groupBy(*keys).agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn")))


def sweep(cells: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Scores at every threshold (conf >= t): one scan counts cells by how many thresholds they reach, and these counts are added up."""
    steps = sorted({float(x) for x in thresholds})
    y = F.col("truth") == 1
    # null confidence reaches none
    level = F.size(F.filter(F.array(*[F.lit(x) for x in steps]), lambda x: F.coalesce(F.col("conf") >= x, F.lit(False))))
    by = cells.groupBy(*keys, level.alias("level")).agg(F.count(F.when(y, 1)).alias("t"), F.count(F.when(~y, 1)).alias("f"))

    def at(i: int, x: float) -> Column:
        over = F.col("level") > i
        n = lambda v, ok: F.coalesce(F.sum(F.when(ok, F.col(v))), F.lit(0))
        return F.struct(F.lit(x).alias("threshold"), n("t", over).alias("tp"), n("f", over).alias("fp"), n("t", ~over).alias("fn"))

    each = by.groupBy(*keys).agg(F.array(*[at(i, x) for i, x in enumerate(steps)]).alias("s"))
    return with_scores(each.select(*keys, F.inline("s")))


def best_threshold(scores: DataFrame, keys: list[str], by: str = "f1") -> DataFrame:
    """The row of greatest ``by`` of each group; the least threshold on ties."""
    cols = [c for c in scores.columns if c not in keys]
    best = F.max_by(F.struct(*cols), F.struct(F.col(by), -F.col("threshold")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def dilate(cells: DataFrame, keys: list[str], radius: int, shape: str = "disk", height: int | None = None, width: int | None = None) -> DataFrame:
    """Set cells grown by a disk (dy^2 + dx^2 <= r^2) or a diamond (|dy| + |dx| <= r), clipped to the raster."""
    return as_given(grown(cells, keys, offsets(radius, shape), height, width), cells, keys)


def relaxed_scores(pred: DataFrame, truth: DataFrame, keys: list[str], slack: int = 3, shape: str = "disk") -> DataFrame:
    """Shares of each mask within ``slack`` of the other, and the F1 of the two."""
    at = [*keys, "r", "c"]

    def share(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        near = dilate(b, keys, slack, shape).withColumn("near", F.lit(1))
        return a.join(near, at, "left").groupBy(*keys).agg((F.count("near") / F.count("*")).alias(name))

    out = share(pred, truth, "relaxed_precision").join(share(truth, pred, "relaxed_recall"), keys, "full_outer").na.fill(0.0)
    return out.withColumn("relaxed_f1", f_beta(F.col("relaxed_precision"), F.col("relaxed_recall"), 1.0))


def evaluate_tiles(counts: DataFrame, keys: list[str], tile: str) -> DataFrame:
    """Per tile and over all tiles of a group (tile null): counts are summed before they are divided."""
    sums = counts.groupBy(*keys, tile).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    total = sums.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).withColumn(tile, F.lit(None).cast(dict(sums.dtypes)[tile]))
    return with_scores(sums.unionByName(total))


def judge_agreement(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman's rank correlation of ``judge`` and ``truth`` over variants, and whether both name the same winner."""
    def rank(x: str) -> Column:
        w = Window.partitionBy(*keys)
        low = F.rank().over(w.orderBy(x))
        return low + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2

    r = scores.withColumns({"rj": rank("judge"), "rt": rank("truth")})
    return r.groupBy(*keys).agg(
        F.corr("rj", "rt").alias("spearman"),
        (F.max_by("variant", F.struct("judge", "variant")) == F.max_by("variant", F.struct("truth", "variant"))).alias("same_winner"),
    )


def degrade(cells: DataFrame, mode: str, share: float = 0.4, block: int = 8, shift: int = 12) -> DataFrame:
    """Known-quality variants of a mask: block-wise erasure, shift, or blank."""
    if mode == "erase":
        b = F.pmod(F.floor(F.col("r") / block) * 7919 + F.floor(F.col("c") / block) * 104729, F.lit(100))
        return cells.where(b >= int(share * 100))
    if mode == "shift":
        return cells.withColumns({"r": F.col("r") + shift, "c": F.col("c") + shift})
    if mode == "blank":
        return cells.where(F.lit(False))
    raise ValueError(f"unknown mode {mode}")


def compare_models(counts: DataFrame, group: str, model: str, models: list[str]) -> DataFrame:
    """Group by model: the micro-averaged IoU, one column a model."""
    s = with_scores(counts.groupBy(group, model).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]))
    return s.groupBy(group).pivot(model, models).agg(F.first("iou"))


def stage_report(events: DataFrame, job: str, order: str) -> DataFrame:
    """Each evaluation with the last threshold set before it, and the best score so far."""
    w = Window.partitionBy(job).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumns({"carried": F.last("threshold", ignorenulls=True).over(w), "best": F.max("score").over(w)})
    return out.where("score is not null")

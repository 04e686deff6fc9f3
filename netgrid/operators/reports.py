"""Full reports: topology of networks in degrees or metres, and scores of tiles by cells, with slack, and by centrelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.operators.blocks import met, offsets
from netgrid.operators.cells import clean_mask
from netgrid.operators.evaluate import f_beta, ratio
from netgrid.operators.lines import is_geographic, line_length, topology_report
from netgrid.operators.vectorise import thin
from netgrid.plans.storage import materialise


def network_report(lines: DataFrame, nets: DataFrame, keys: list[str], crs: str | None = None, snap: float = 2.5) -> DataFrame:
    """The topology report of every network of ``nets``, with ``geographic``, ``verdict`` and ``notes``.

    ``lines`` has coords of any number of vertices, and may have a column ``crs`` that
    names the network's frame; without one the bounds tell whether they are
    degrees. Degrees become metres by the latitude of the first vertex of the
    network's first line; lengths are taken segment by segment. Lines of fewer
    than two vertices do not count; a network without lines has the verdict
    ``empty``, zeros and a note.
    """
    some = lines.where(F.size("coords") > 1)
    points = some.select(*keys, *([crs] if crs else []), F.explode("coords").alias("p")).select(*keys, *([crs] if crs else []), "p.x", "p.y")
    first = some.groupBy(*keys).agg(F.min_by(F.get("coords", F.lit(0))["y"], "line_id").alias("lat"))
    frame = materialise(is_geographic(points, keys, crs).join(first, keys), "frames")
    at = some.select(*keys, "line_id", "coords").join(frame, keys)
    wide = F.when(F.col("geographic"), F.cos(F.radians("lat")) * 111320.0).otherwise(1.0)
    tall = F.when(F.col("geographic"), 110540.0).otherwise(1.0)
    p, q = F.get("coords", F.lit(0)), F.get("coords", F.size("coords") - 1)
    ends = {"x0": p["x"] * wide, "y0": p["y"] * tall, "x1": q["x"] * wide, "y1": q["y"] * tall}
    segments = at.select(*keys, "line_id", *[v.alias(c) for c, v in ends.items()], line_length(F.col("coords"), F.col("geographic")).alias("length"))
    report = topology_report(segments, keys, snap)
    zero = [c for c in report.columns if c not in (*keys, "verdict")]
    out = nets.select(*keys).distinct().join(frame.select(*keys, "geographic"), keys, "left").join(report, keys, "left")
    out = out.na.fill(0, zero).withColumns({"verdict": F.coalesce("verdict", F.lit("empty")), "geographic": F.coalesce("geographic", F.lit(False))})
    notes = F.array_compact(
        F.array(
            F.when(F.col("n_components") > 1, F.format_string("%d separate parts, the largest with %.0f%% of the length", "n_components", F.col("largest_share") * 100)),
            F.when(F.col("dangle_ratio") > 0.5, F.format_string("%d of %d nodes are dead ends", "n_dangles", "n_nodes")),
            F.when(F.col("short_fragments") > 0, F.format_string("%d lone lines are shorter than 40 m", "short_fragments")),
        )
    )
    notes = F.when(F.col("verdict") == "empty", F.array(F.lit("no lines"))).when(F.size(notes) == 0, F.array(F.lit("nothing found"))).otherwise(notes)
    return out.withColumn("notes", notes)


def tile_report(pred: DataFrame, truth: DataFrame, keys: list[str], tile: str, height: int, width: int, slack: int = 3, tolerance: float = 5.0, clean: tuple[int, int, int] | None = (2, 50, 100)) -> DataFrame:
    """Scores of every tile (``keys`` and ``tile`` name it) and, with a null tile, of all tiles of the keys together.

    Counts are summed over tiles before they are divided. Cells as they are;
    with slack: a cell of one mask counts when the other has one within so many
    steps of four neighbours; centrelines: cells of the thinned masks within
    ``tolerance`` of the other's, the predicted mask being cleaned first by
    (closing radius, hole size, least size), or not at all. ``tile_iou`` and
    ``tile_completeness`` divide by 1 at least. A tile on which both masks are empty has no row.
    """
    by = [*keys, tile]
    at = [*by, "r", "c"]
    inside = (F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)
    masks = [materialise(m.where(inside).select(*at).distinct(), "mask") for m in (pred, truth)]
    lines = [materialise(thin(m, by).select(*at), "centreline") for m in (clean_mask(masks[0], by, height, width, *clean) if clean else masks[0], masks[1])]

    c = F.col
    both = met(*masks, by, {"same": [(0, 0)], "near": offsets(slack, "diamond")})
    both = both.select(*by, c("same0").alias("tp"), c("n0").alias("pred"), c("n1").alias("truth"), c("near0").alias("relaxed_pred"), c("near1").alias("relaxed_truth"))
    near = met(*lines, by, {"near": offsets(tolerance)})
    near = near.select(*by, c("n0").alias("skeleton_pred"), c("near0").alias("matched_pred"), c("n1").alias("skeleton_truth"), c("near1").alias("matched_truth"))
    names = ["tp", "pred", "truth", "relaxed_pred", "relaxed_truth", "skeleton_pred", "matched_pred", "skeleton_truth", "matched_truth"]
    out = materialise(both.join(near, by, "full_outer").na.fill(0).select(*by, *names), "counts")
    every = out.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names], F.count("*").alias("n_tiles")).withColumn(tile, F.lit(None).cast(dict(out.dtypes)[tile]))
    out = out.withColumn("n_tiles", F.lit(1).cast("long")).unionByName(every)
    p, r = ratio(c("tp"), c("pred")), ratio(c("tp"), c("truth"))
    rp, rr = ratio(c("relaxed_pred"), c("pred")), ratio(c("relaxed_truth"), c("truth"))
    corr, comp = ratio(c("matched_pred"), c("skeleton_pred")), ratio(c("matched_truth"), c("skeleton_truth"))
    union = c("pred") + c("truth") - c("tp")
    scores = {
        "iou": ratio(c("tp"), union), "precision": p, "recall": r, "f1": f_beta(p, r, 1.0), "relaxed_f1": f_beta(rp, rr, 1.0), "correctness": corr, "completeness": comp, "centreline_f1": f_beta(corr, comp, 1.0),
        "tile_iou": F.when(c(tile).isNotNull(), c("tp") / F.greatest(union, F.lit(1))), "tile_completeness": F.when(c(tile).isNotNull(), c("matched_truth") / F.greatest("skeleton_truth", F.lit(1))),
    }
    return out.select(*by, "n_tiles", *[F.round(v, 4).alias(k) for k, v in scores.items()])

"""The edited network, suggestions for it, repairs, and candidates of settings.

Lines are straight segments (``polylines`` has the edited network for lines of
many vertices); inputs are ``(keys, line_id, x0, y0, x1, y1)`` in metres; line ids are unique within the keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgrid.operators.cells import clean_mask
from netgrid.operators.evaluate import beta_of, f_beta
from netgrid.operators.lines import close_points, cluster_endpoints, endpoints, line_length, sample_along, share_along, topology_report
from netgrid.operators.network import dead_ends, expected_scores, near_segments, simplify, snap_ends, split_at
from netgrid.operators.polylines import as_lines, merge_lines
from netgrid.operators.vectorise import centrelines, score_network, segments_of, thin, trace
from netgrid.plans.groups import by_groups, least_members
from netgrid.plans.storage import materialise

ENDS = ["x0", "y0", "x1", "y1"]


def snapped(human: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Human lines with their snapped ends, and how many of the two were snapped."""
    at = ends.groupBy(*keys, "line_id").agg(
        *[F.max(F.when(F.col("end") == e, F.col(v))).alias(f"{v}_{e}") for e in (0, 1) for v in "xy"], F.count("*").cast("int").alias("n_snapped")
    )
    j = human.join(at, [*keys, "line_id"], "left")
    new = {f"{v}{e}": F.coalesce(F.col(f"{v}_{e}"), F.col(f"{v}{e}")) for e in (0, 1) for v in "xy"}
    return j.withColumns({**new, "n_snapped": F.coalesce("n_snapped", F.lit(0))}).drop("x_0", "y_0", "x_1", "y_1")


def merge_network(model: DataFrame, human: DataFrame, deleted: DataFrame, keys: list[str], snap: float = 3.0) -> DataFrame:
    """``(keys, line_id, piece, x0, y0, x1, y1, status, n_snapped)``: the model's lines with the person's edits.

    Ends of human lines snap to the nearest other line, which is split there.
    Of the model's pieces those that run along deleted lines (a share of 0.6,
    tested first) or along human ones after snapping (0.7) get the status
    ``deleted`` or ``superseded``; the others are ``model``. Human pieces always stay. Ids must be
    unique over both tables.
    """
    cols = [*keys, "line_id", *ENDS]
    human = human.select(*cols)
    both = model.select(*cols, F.lit("model").alias("status")).unionByName(human.withColumn("status", F.lit("human")))
    ends = materialise(snap_ends(human, both.select(*cols), keys, snap), "snapped")
    new = snapped(human, ends, keys)
    lines = both.where("status = 'model'").withColumn("n_snapped", F.lit(0)).unionByName(new.withColumn("status", F.lit("human")))
    lines = materialise(lines, "lines")
    cuts = ends.where("cut_at IS NOT NULL").select(*keys, F.col("other_id").alias("line_id"), F.col("cut_at").alias("at"))
    pieces = split_at(lines.select(*cols), cuts, keys).join(lines.select(*keys, "line_id", "status", "n_snapped"), [*keys, "line_id"])
    pieces = materialise(pieces.withColumn("n_snapped", F.when(F.col("piece") == 1, F.col("n_snapped")).otherwise(0)), "pieces")
    own = pieces.where("status = 'model'").withColumn("line_id", F.struct("line_id", "piece"))
    d = share_along(own, deleted, keys).withColumnRenamed("share", "in_deleted")
    h = share_along(own, pieces.where("status = 'human'"), keys).withColumnRenamed("share", "in_human")
    share = d.join(h, [*keys, "line_id"]).select(*keys, "line_id.*", "in_deleted", "in_human")
    status = F.when(F.col("in_deleted") >= 0.6, "deleted").when(F.col("in_human") >= 0.7, "superseded").otherwise(F.col("status"))
    return pieces.join(share, [*keys, "line_id", "piece"], "left").withColumn("status", status).drop("in_deleted", "in_human")


def network_stats(merged: DataFrame, keys: list[str], live: DataFrame | None = None) -> DataFrame:
    """Counts and lengths of a merged network, of segments or of lines, by source. ``live``: ``(keys, n_ops, can_redo)`` of the edit log."""
    length = F.col("length") if "length" in merged.columns else F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias("n_" + s)
    m = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, length)), F.lit(0.0))
    out = merged.groupBy(*keys).agg(n("model"), n("human"), n("deleted"), n("superseded"), F.sum("n_snapped").alias("n_snapped_ends"), m("model").alias("_m"), m("human").alias("_h"))
    total = F.col("_m") + F.col("_h")
    out = out.withColumns({
        "n_features": F.col("n_model") + F.col("n_human"), "model_length_m": F.round("_m", 1), "human_length_m": F.round("_h", 1), "total_length_m": F.round(total, 1),
        "total_length_km": F.round(total / 1000, 3), "human_share": F.round(F.when(total > 0, F.col("_h") / total).otherwise(0.0), 4),
    }).drop("_m", "_h")
    if live is None:
        return out
    out = out.join(live, keys, "left").na.fill(0, ["n_ops"]).na.fill(False, ["can_redo"])
    return out.withColumn("can_undo", F.col("n_ops") > 0)


def _heading(other_x: Column, other_y: Column, x: Column, y: Column, to_x: Column, to_y: Column) -> Column:
    """Cosine between the way a line ends at (x, y) and the way from there to another point; -1 where one is a point."""
    hx, hy, vx, vy = x - other_x, y - other_y, to_x - x, to_y - y
    n = F.hypot(hx, hy) * F.hypot(vx, vy)
    return F.when(n > 0, (hx * vx + hy * vy) / n).otherwise(-1.0)


def suggest_gaps(
    segments: DataFrame, conf: DataFrame, dismissed: DataFrame, keys: list[str], size: float, height: int, width: int, max_gap: float = 30.0, join: float = 2.5, angle: float = 40.0,
) -> DataFrame:
    """``(keys, a, b, x0, y0, x1, y1, score)``: connectors of dead ends of different lines, one of which carries on towards the other.

    A connector whose middle, 8 m clear of both ends, runs within 4 m of the
    network for half its length, or of a dismissed line for half of all of it,
    is left out.
    """
    back = segments.select(*keys, "line_id", *ENDS)
    ends = dead_ends(segments, keys, join).join(back, [*keys, "line_id"])
    far = lambda v: F.when(F.col("end") == 0, F.col(v + "1")).otherwise(F.col(v + "0"))
    e = materialise(ends.select(*keys, "line_id", "end", "x", "y", far("x").alias("bx"), far("y").alias("by")), "ends")
    g = lambda x: F.floor(x / max_gap)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = e.withColumns({"gx": g(F.col("x")), "gy": g(F.col("y"))})
    b = e.select(*keys, *[F.col(c).alias("q" + c) for c in ("line_id", "end", "x", "y", "bx", "by")], F.inline(near))
    b = b.withColumns({"gx": g(F.col("qx")) + F.col("i"), "gy": g(F.col("qy")) + F.col("j")}).drop("i", "j")
    d = F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))
    pair = a.join(b, [*keys, "gx", "gy"]).where("line_id < qline_id").where((d > join) & (d <= max_gap))
    align = F.greatest(
        _heading(F.col("bx"), F.col("by"), F.col("x"), F.col("y"), F.col("qx"), F.col("qy")), _heading(F.col("qbx"), F.col("qby"), F.col("qx"), F.col("qy"), F.col("x"), F.col("y"))
    )
    pair = pair.withColumn("align", align).where(F.col("align") >= F.cos(F.radians(F.lit(angle))))
    link = pair.select(*keys, F.struct("line_id", "end", "qline_id", "qend").alias("line_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("qx").alias("x1"), F.col("qy").alias("y1"), "align")
    link = materialise(link, "gaps")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    middle = link.withColumn("k", F.lit(8.0) / length).where("k < 0.5")
    cut = lambda p, q, k: F.col(p) + (F.col(q) - F.col(p)) * k
    middle = middle.select(*keys, "line_id", *[cut(p, q, k).alias(n) for n, p, q, k in (("x0", "x0", "x1", F.col("k")), ("y0", "y0", "y1", F.col("k")), ("x1", "x0", "x1", 1 - F.col("k")), ("y1", "y0", "y1", 1 - F.col("k")))])
    drawn = share_along(middle, segments, keys, 4.0).where("share >= 0.5").select(*keys, "line_id")
    gone = share_along(link, dismissed, keys, 4.0).where("share >= 0.5").select(*keys, "line_id")
    link = link.join(drawn, [*keys, "line_id"], "left_anti").join(gone, [*keys, "line_id"], "left_anti")
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    c = sample_along(link.withColumn("coords", F.array(p("x0", "y0"), p("x1", "y1"))), conf, keys, size, height, width)
    out = link.join(c, [*keys, "line_id"]).withColumn("score", F.col("align") + F.col("confidence"))
    return out.select(*keys, F.col("line_id.line_id").alias("a"), F.col("line_id.qline_id").alias("b"), *ENDS, "confidence", "score")


def suggest_missed(
    conf: DataFrame, segments: DataFrame, dismissed: DataFrame, keys: list[str], size: float, height: int, width: int, threshold: float = 0.25, holes: int = 200, small: int = 200,
    radius: int = 2, min_length: float = 30.0, covered: float = 0.5, value: str = "conf",
) -> DataFrame:
    """``(keys, line_id, coords, length_m, confidence, joined, score)``: uncertain centrelines that nothing drawn covers.

    Fresh lines run within 6 m of the network for less than half their length
    and within 4 m of dismissed lines for less than half; ``joined`` counts ends within 10 m of the network.
    """
    mask = conf.where(F.col(value) > threshold)
    line = simplify(trace(thin(clean_mask(mask, keys, height, width, radius, holes, small), keys), keys, size), 2.0)
    line = materialise(line.withColumn("length_m", line_length(F.col("coords"))).where(F.col("length_m") >= min_length), "missed")
    seg = segments_of(line, keys)
    parts = seg.withColumn("line_id", F.struct("line_id", "seg_no"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))

    def share(zone: DataFrame, buf: float) -> DataFrame:
        s = share_along(parts, zone, keys, buf).join(parts.select(*keys, "line_id", length.alias("m")), [*keys, "line_id"])
        return s.groupBy(*keys, F.col("line_id.line_id").alias("line_id")).agg((F.sum(F.col("share") * F.col("m")) / F.sum("m")).alias("share"))

    old = share(segments, 6.0).where(F.col("share") >= covered).unionByName(share(dismissed, 4.0).where("share >= 0.5"))
    line = line.join(old.select(*keys, "line_id").distinct(), [*keys, "line_id"], "left_anti")
    ends = line.select(*keys, "line_id", F.posexplode(F.array(F.element_at("coords", 1), F.element_at("coords", -1))).alias("end", "p")).select(*keys, "line_id", "end", "p.x", "p.y")
    joined = near_segments(ends, segments, keys, 10.0).select(*keys, "line_id", "end").distinct().groupBy(*keys, "line_id").agg(F.count("*").alias("joined"))
    c = sample_along(line, conf, keys, size, height, width, value)
    out = line.join(c, [*keys, "line_id"]).join(joined, [*keys, "line_id"], "left").na.fill(0, ["joined"])
    return out.withColumn("score", F.col("confidence") * F.log1p("length_m") * (1 + F.col("joined")))


def suggestion_precision(suggestions: DataFrame, truth: DataFrame, keys: list[str], within: float = 5.0, least: float = 0.6, top: int = 20) -> DataFrame:
    """Share of real suggestions by kind, over all and over the ``top`` best: real when so much of the length is near a labelled road."""
    s = share_along(suggestions, truth, keys, within).join(suggestions.select(*keys, "line_id", "kind", "score"), [*keys, "line_id"])
    real = s.withColumn("real", (F.col("share") >= least).cast("int"))
    best = real.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("real"), 4).alias("precision"))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), *keys, "line_id")
    first = real.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).groupBy("kind").agg(F.round(F.avg("real"), 4).alias("precision_top"))
    return best.join(first, "kind")


def repair(segments: DataFrame, keys: list[str], operation: str, tolerance: float = 5.0) -> DataFrame:
    """The repaired segments. Operations on straight lines:

    snap: ends go to the mean of their cluster at ``tolerance``; rmdangle: lines
    shorter than it with an end of degree one go, again and again until none
    does; prune: lines shorter than it go; extend: both ends move out by it.
    """
    cols = [*keys, "line_id", *ENDS]
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    s = segments.select(*cols)
    if operation == "prune":
        return s.where(length >= tolerance)
    if operation == "extend":
        ux, uy = (F.coalesce((F.col(v + "1") - F.col(v + "0")) / F.nullif(length, F.lit(0.0)), F.lit(0.0)) * tolerance for v in "xy")
        return s.select(*keys, "line_id", (F.col("x0") - ux).alias("x0"), (F.col("y0") - uy).alias("y0"), (F.col("x1") + ux).alias("x1"), (F.col("y1") + uy).alias("y1"))
    if operation == "snap":
        at = materialise(cluster_endpoints(endpoints(s, keys), keys, tolerance), "clusters")
        mean = at.groupBy(*keys, "node").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        new = at.join(mean, [*keys, "node"]).select(*keys, "line_id", "end", F.col("mx").alias("x"), F.col("my").alias("y"))
        return snapped(s, new, keys).select(*cols)
    if operation != "rmdangle":
        raise ValueError(f"unknown operation {operation!r}")
    found = materialise(_dangles(s, keys, tolerance), "dangles")
    s = materialise(s.join(found.where("line_id IS NOT NULL").select(*keys, "line_id"), [*keys, "line_id"], "left_anti"), "lines")
    large = found.where("line_id IS NULL").select(*keys).distinct()
    if large.isEmpty():
        return s
    small, s = s.join(large, keys, "left_anti"), s.join(large, keys, "left_semi")
    while True:
        node = cluster_endpoints(endpoints(s, keys), keys)
        node = node.groupBy(*keys, "node").agg(F.count_distinct("line_id").alias("degree"), F.min("line_id").alias("line_id")).where("degree = 1")
        gone = materialise(s.where(length < tolerance).join(node, [*keys, "line_id"], "left_semi").select(*keys, "line_id"), "dangles")
        if gone.isEmpty():
            return small.unionByName(s)
        s = materialise(s.join(gone, [*keys, "line_id"], "left_anti"), "lines")


def _dangles(segments: DataFrame, keys: list[str], tolerance: float, snap: float = 2.5, most: int = 200_000) -> DataFrame:
    """``(keys, line_id)`` of the lines that ``rmdangle`` takes, of networks of up to ``most`` lines and pairs of near ends; without ``line_id``, the others' keys."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    pid = lambda e: F.xxhash64(*keys, f"x{e}", f"y{e}")
    line = segments.select(*keys, "line_id", pid(0).alias("u"), pid(1).alias("v"), (length < tolerance).alias("short"))
    ends = endpoints(segments, keys).withColumn("pid", F.xxhash64(*keys, "x", "y"))
    rows = line.unionByName(close_points(ends, keys, snap).withColumn("short", F.lit(False)), allowMissingColumns=True).withColumn("line", F.col("line_id").isNotNull())
    schema, n = segments.select(*keys, "line_id").schema, len(keys)

    def run(b: pa.RecordBatch, starts: np.ndarray, complete: np.ndarray) -> pa.RecordBatch:
        ok = np.repeat(complete, np.diff(np.r_[starts, b.num_rows]))
        flag = lambda i: b.column(n + i).fill_null(False).to_numpy(zero_copy_only=False)
        points, at = np.unique(np.concatenate([b.column(n + i).to_numpy() for i in (1, 2)]), return_inverse=True)
        u, v = at[: b.num_rows], at[b.num_rows :]
        short, line = flag(3), flag(4)
        alive, pair = np.flatnonzero(line & ok), np.flatnonzero(~line & ok)
        gone = []
        while len(alive):
            there = np.zeros(len(points), bool)
            there[u[alive]] = there[v[alive]] = True
            pair = pair[there[u[pair]] & there[v[pair]]]
            node = least_members(len(points), u[pair], v[pair])
            p, q = node[u[alive]], node[v[alive]]
            degree = np.bincount(p, minlength=len(points)) + np.bincount(q[p != q], minlength=len(points))
            drop = short[alive] & ((degree[p] == 1) | (degree[q] == 1))
            if not drop.any():
                break
            gone.append(alive[drop])
            alive = alive[~drop]
        large = starts[~complete]
        gone = np.concatenate([*gone, large]).astype(np.int64)
        ids = b.column(n).take(pa.array(gone, mask=np.arange(len(gone)) >= len(gone) - len(large)))
        return pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(gone)) for i in range(n)], ids], names=schema.names)

    return by_groups(rows, keys, [], run, schema, most, whole=False)


def repair_report(segments: DataFrame, keys: list[str], operation: str, tolerance: float = 5.0) -> DataFrame:
    """Features, components, dangles and score before and after a repair, and whether the score rose. A network left empty has nulls after."""
    names = ["n_lines", "n_components", "n_dangles", "score"]
    a = topology_report(segments, keys).select(*keys, *[F.col(n).alias("before_" + n) for n in names])
    b = topology_report(materialise(repair(segments, keys, operation, tolerance), "repaired"), keys).select(*keys, *[F.col(n).alias("after_" + n) for n in names])
    return a.join(b, keys, "left").withColumn("improved", F.coalesce(F.col("after_score") > F.col("before_score"), F.lit(False)))


# ---- candidates of settings, and the measure of a change ----


def try_candidates(
    conf: DataFrame, truth_skeleton: DataFrame | None, variants: DataFrame, keys: list[str], size: float, height: int, width: int, objective: str = "balanced",
    radius: int = 2, holes: int = 200, small: int = 400, tolerance: float = 2.0, min_length: float = 25.0, human: DataFrame | None = None, deleted: DataFrame | None = None,
) -> DataFrame:
    """``(keys, variant_id, threshold, precision, recall, score, rank)``: every variant's network, judged.

    All variants run in one job, the variant's id being one more key. The mask
    is conf > threshold; edits (lines or straight segments) are merged over each network, whole line by whole line. With truth the
    judge is correctness and completeness, else their expected values; a network without lines has zeros.
    """
    own = [*keys, "variant_id"]
    each = conf.join(F.broadcast(variants.select("variant_id", "threshold")), F.col("conf") > F.col("threshold"))
    drawn = centrelines(each, own, height, width, size, radius, holes, small, tolerance, min_length).select(*own, "line_id", "coords")
    if human is not None:
        several = lambda df: as_lines(df, keys).crossJoin(F.broadcast(variants.select("variant_id")))
        gone = several(deleted if deleted is not None else human.limit(0))
        merged = merge_lines(drawn, several(human), gone, own).where("status IN ('model', 'human')")
        drawn = merged.select(*own, F.struct("line_id", "piece").alias("line_id"), "coords")
    seg = segments_of(drawn, own).select(*own, F.xxhash64("line_id", "seg_no").alias("line_id"), *ENDS)
    seg = materialise(seg, "candidates")
    scores = _judged(seg, conf, truth_skeleton, variants, own, size, height, width)
    empty = conf.select(*keys).distinct().crossJoin(F.broadcast(variants.select("variant_id"))).withColumns({"precision": F.lit(0.0), "recall": F.lit(0.0)})
    scores = scores.unionByName(empty).groupBy(*own).agg(*[F.max(v).alias(v) for v in ("precision", "recall")])
    return _ranked(scores, variants, keys, objective)


def try_thresholds(cells: DataFrame, variants: DataFrame, keys: list[str], objective: str = "balanced") -> DataFrame:
    """As ``try_candidates`` with thresholds only, judged by cells against ``truth``; no line is drawn."""
    each = cells.crossJoin(F.broadcast(variants.select("variant_id", "threshold")))
    p, y = F.col("conf") > F.col("threshold"), F.col("truth") == 1
    n = lambda x: F.count(F.when(x, 1))
    c = each.groupBy(*keys, "variant_id").agg(n(p & y).alias("tp"), n(p).alias("p"), n(y).alias("t"))
    c = c.withColumns({"precision": F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0), "recall": F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)})
    return _ranked(c.select(*keys, "variant_id", "precision", "recall"), variants, keys, objective)


def _judged(seg, conf, truth, variants, own, size, height, width) -> DataFrame:
    if truth is None:
        every = conf.crossJoin(F.broadcast(variants.select("variant_id")))  # a few settings
        return expected_scores(seg, every, own, size).select(*own, "precision", "recall")
    t = truth.crossJoin(F.broadcast(variants.select("variant_id")))
    s = score_network(seg, t, own, size, height, width)
    return s.select(*own, F.col("correctness").alias("precision"), F.col("completeness").alias("recall"))


def _ranked(scores: DataFrame, variants: DataFrame, keys: list[str], objective: str) -> DataFrame:
    s = scores.join(F.broadcast(variants), "variant_id")
    s = s.withColumn("score", F.round(f_beta(F.col("precision"), F.col("recall"), beta_of(F.lit(objective))), 4))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "variant_id"))
    return s.select(*keys, "variant_id", "threshold", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), "score", rank.alias("rank"))


def apply_candidate(live: DataFrame, candidates: DataFrame, chosen: str, key: str = "raster_id", id_col: str = "variant_id") -> DataFrame:
    """The live rows with those of one candidate in place of all rows of its keys; an unknown id is an error that lists the ids.

    Both tables have the same columns but for the id; candidates hold whole rasters.
    """
    picked = candidates.where(F.col(id_col) == chosen)
    if picked.isEmpty():
        known = [r[0] for r in candidates.select(id_col).distinct().orderBy(id_col).limit(20).collect()]
        raise ValueError(f"no candidate {chosen!r}; there are {known}")
    rows = picked.drop(id_col)
    return live.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def measure(
    segments: DataFrame, nets: DataFrame, truth: DataFrame, conf: DataFrame, keys: list[str], size: float, height: int, width: int, objective: str = "balanced",
    tolerance: float = 5.0, half_width: float = 3.5,
) -> DataFrame:
    """One row a network of ``nets``: scores against truth where there is some, else expected ones, else zeros on the basis ``empty``.

    A network without lines is empty whatever there is to judge it; one without truth and confidence has no row.
    """
    s = score_network(segments, truth, keys, size, height, width, tolerance)
    s = s.join(truth.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("correctness").alias("tp"), F.col("completeness").alias("tr"))
    e = expected_scores(segments, conf, keys, size, half_width).select(*keys, F.col("precision").alias("ep"), F.col("recall").alias("er"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    n = segments.groupBy(*keys).agg(F.count("*").alias("n_features"), F.round(F.sum(length) / 1000, 3).alias("km"))
    topo = topology_report(segments, keys).select(*keys, F.col("score").alias("topology"))
    out = nets.select(*keys).distinct()
    for other in (n, s, e, topo):
        out = out.join(other, keys, "left")
    out = out.na.fill(0, ["n_features"]).na.fill(0.0, ["km", "topology"])
    basis = F.when(F.col("n_features") == 0, "empty").when(F.col("tp").isNotNull(), "ground truth").when(F.col("ep").isNotNull(), "expected")
    pick = lambda t, x: F.round(F.when(F.col("basis") == "empty", 0.0).otherwise(F.coalesce(t, x)), 4)
    out = out.withColumn("basis", basis).where("basis IS NOT NULL")
    out = out.withColumns({"precision": pick("tp", "ep"), "recall": pick("tr", "er")})
    score = F.round(f_beta(F.col("precision"), F.col("recall"), beta_of(F.lit(objective))), 4)
    return out.select(*keys, "basis", "precision", "recall", score.alias("score"), "km", "n_features", "topology")

"""Linear referencing, and the edited network over lines of many vertices.

Lines are ``(keys, line_id, coords ARRAY<STRUCT<x, y>>)`` in metres. A place on
a line is a measure: its distance along the line from the first vertex. Shares
and cuts are those of whole lines; pieces keep the vertices between their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgrid.operators.lines import inside_buffers, line_length, united
from netgrid.operators.network import near_segments, root_of_squares, thinned
from netgrid.operators.projection import frames, from_frame, to_frame
from netgrid.plans.storage import materialise

POINTS = "array<struct<x:double,y:double>>"
#: Side of the cells in which lines meet: wide against a segment, so that most lie in one cell.
CELL = 250.0
#: Measures of a line are summed up in parts of so many, as an array is copied with every sum that is added to it.
PART = 64


def as_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, line_id, coords)`` of lines, or of straight segments ``(x0, y0, x1, y1)``."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    coords = F.col("coords").cast(POINTS) if "coords" in rows.columns else F.array(p("x0", "y0"), p("x1", "y1"))
    return rows.select(*keys, "line_id", coords.alias("coords"))


def measured(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The segments of lines with measures: ``(keys, line_id, seg_no, x0, y0, x1, y1, m0, m1, length, first, last)``.

    ``length`` is the whole line's, ``first`` and ``last`` are its end points.
    A line of fewer than two vertices has no segment.
    """
    p = lambda k: F.get("coords", k)
    n = F.greatest(F.size("coords") - 1, F.lit(0))
    steps = F.zip_with(F.slice("coords", 1, n), F.slice("coords", 2, n), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    start = lambda m, kind: F.struct(m.alias("m"), F.array().cast(kind).alias("all"))

    def add(s, x):
        m = s["m"] + F.coalesce(x, F.lit(0.0))
        return F.struct(m.alias("m"), F.concat(s["all"], F.array(m)).alias("all"))

    def add_part(s, k):
        part = F.aggregate(F.slice("steps", k, PART), start(s["m"], "array<double>"), add, lambda t: t["all"])
        return F.struct(F.element_at(part, -1).alias("m"), F.concat(s["all"], F.array(part)).alias("all"))

    sums = F.flatten(F.aggregate(F.sequence(F.lit(1), F.size("steps"), F.lit(PART)), start(F.lit(0.0), "array<array<double>>"), add_part, lambda s: s["all"]))
    seg = lambda m, i: F.struct(
        i.alias("seg_no"), p(i)["x"].alias("x0"), p(i)["y"].alias("y0"), p(i + 1)["x"].alias("x1"), p(i + 1)["y"].alias("y1"), (m - F.get("steps", i)).alias("m0"), m.alias("m1"), p(i + 1).isNotNull().alias("there")
    )
    of = lines.where(F.size("coords") > 1).withColumn("steps", steps).withColumn("sums", F.when(F.size("steps") > 0, sums))
    of = of.select(*keys, "line_id", F.inline(F.transform("sums", seg)), line_length(F.col("coords")).alias("length"), p(F.lit(0)).alias("first"), p(F.size("coords") - 1).alias("last"))
    return of.where("there").drop("there")


def along(segments: DataFrame, zone: DataFrame, keys: list[str], buf: float = 4.0) -> DataFrame:
    """``(keys, line_id, m0, m1)``: the stretches of measured lines inside the buffers of ``zone`` segments, apart from each other."""
    part = segments.select(*keys, F.struct("line_id", "m0", "m1").alias("line_id"), "x0", "y0", "x1", "y1")
    at = lambda t: F.col("line_id.m0") + F.col(t) * (F.col("line_id.m1") - F.col("line_id.m0"))
    found = inside_buffers(part, zone, keys, buf, CELL).select(*keys, F.col("line_id.line_id").alias("line_id"), at("t0").alias("m0"), at("t1").alias("m1"))
    return united(found, [*keys, "line_id"], "m0", "m1")


def line_shares(segments: DataFrame, zone: DataFrame, keys: list[str], buf: float = 4.0) -> DataFrame:
    """``share`` of each measured line's length inside the union of the buffers; 0 for a line without length."""
    inside = along(segments, zone, keys, buf).groupBy(*keys, "line_id").agg(F.sum(F.col("m1") - F.col("m0")).alias("inside"))
    length = segments.groupBy(*keys, "line_id").agg(F.max("m1").alias("length"))
    share = F.when(F.col("length") > 0, F.coalesce("inside", F.lit(0.0)) / F.nullif("length", F.lit(0.0))).otherwise(0.0)
    return length.join(inside, [*keys, "line_id"], "left").select(*keys, "line_id", share.alias("share"))


def end_points(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, line_id, end, x, y)``: end 0 is the first vertex, end 1 the last; lines of fewer than two vertices have none."""
    two = F.array(F.struct(F.lit(0).alias("end"), F.get("coords", F.lit(0)).alias("p")), F.struct(F.lit(1).alias("end"), F.get("coords", F.size("coords") - 1).alias("p")))
    return lines.where(F.size("coords") > 1).select(*keys, "line_id", F.inline(two)).select(*keys, "line_id", "end", "p.x", "p.y")


def snap_line_ends(human: DataFrame, segments: DataFrame, keys: list[str], snap: float = 3.0) -> DataFrame:
    """``(keys, line_id, end, other_id, x, y, cut_at)``: each human end within ``snap`` of another line, of which ``segments`` are measured.

    It goes to the foot on the nearest line, or to that line's own end (the
    first one is tried first) where that is within ``snap`` of the foot; else
    the line is to be cut at the foot's measure. All ends are snapped against
    the lines as they were; ties go to the least line id, then to the least measure.
    """
    near = near_segments(end_points(human, keys), segments, keys, snap, CELL, ["seg_no", "m0", "m1", "first", "last"]).where("line_id <> other_id")
    kept = F.struct("other_id", "sx0", "sy0", "sx1", "sy1", "t", "sm0", "sm1", "sfirst", "slast")
    best = near.groupBy(*keys, "line_id", "end").agg(F.min_by(kept, F.struct("d", "other_id", "sseg_no")).alias("b")).select(*keys, "line_id", "end", "b.*")
    foot = best.withColumns({"fx": F.col("sx0") + F.col("t") * (F.col("sx1") - F.col("sx0")), "fy": F.col("sy0") + F.col("t") * (F.col("sy1") - F.col("sy0"))})
    close = lambda p: root_of_squares(F.col(p + ".x") - F.col("fx"), F.col(p + ".y") - F.col("fy")) <= snap
    foot = foot.withColumns({"own": F.when(close("sfirst"), F.col("sfirst")).when(close("slast"), F.col("slast"))})
    cut = F.when(F.col("own").isNull(), F.col("sm0") + F.col("t") * (F.col("sm1") - F.col("sm0")))
    return foot.select(*keys, "line_id", "end", "other_id", F.coalesce("own.x", "fx").alias("x"), F.coalesce("own.y", "fy").alias("y"), cut.alias("cut_at"))


def with_ends(lines: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with their snapped ends in place, and ``n_snapped``, how many there are."""
    at = lambda e: F.max(F.when(F.col("end") == e, F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    new = ends.groupBy(*keys, "line_id").agg(at(0).alias("_a"), at(1).alias("_b"), F.count("*").cast("int").alias("n_snapped"))
    n = F.size("coords")
    inner = F.slice("coords", 2, F.greatest(n - 2, F.lit(0)))
    moved = F.concat(F.array(F.coalesce("_a", F.get("coords", F.lit(0)))), inner, F.array(F.coalesce("_b", F.get("coords", n - 1))))
    out = lines.join(new, [*keys, "line_id"], "left").withColumn("coords", F.when(F.col("n_snapped") > 0, moved).otherwise(F.col("coords")))
    return out.withColumn("n_snapped", F.coalesce("n_snapped", F.lit(0))).drop("_a", "_b")


def split_lines(lines: DataFrame, cuts: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """``(keys, line_id, piece, coords, m0, m1)``: lines split at the measures ``at`` of ``cuts``, pieces numbered from 1.

    Cuts nearer than ``least`` to an end or to the cut before are left out.
    Both pieces at a cut hold its point. A line that is not cut is one piece,
    as it was.
    """
    by = [*keys, "line_id"]
    some = lines.join(cuts.select(*by).distinct(), by, "left_semi")
    seg = measured(some, keys)
    at = cuts.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("at").cast("double"))).alias("cuts"))
    seg = seg.join(at, by)
    kept = thinned(F.filter("cuts", lambda x: (x >= least) & (x <= F.col("length") - least)), least)
    seg = seg.withColumn("marks", F.concat(F.array(F.lit(0.0)), kept, F.array("length")))
    mark = lambda k: F.get("marks", k)
    # a segment of no length belongs to the piece that begins there, or to the last one
    last = F.size("marks") - 1
    meets = F.filter(F.sequence(F.lit(1), last), lambda k: ((mark(k - 1) < F.col("m1")) & (mark(k) > F.col("m0"))) | ((F.col("m0") == F.col("m1")) & (mark(k - 1) <= F.col("m0")) & ((F.col("m0") < mark(k)) | (k == last))))
    part = seg.select(*by, "seg_no", "x0", "y0", "x1", "y1", "m0", "m1", "marks", F.explode(meets).alias("piece"))
    part = part.withColumns({"lo": F.greatest("m0", mark(F.col("piece") - 1)), "hi": F.least("m1", mark(F.col("piece")))})

    def point(m: Column) -> Column:
        t = F.coalesce((m - F.col("m0")) / F.nullif(F.col("m1") - F.col("m0"), F.lit(0.0)), F.lit(0.0))
        on = lambda a, b: F.when(m == F.col("m1"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
        return F.struct(on("x0", "x1").alias("x"), on("y0", "y1").alias("y"))

    part = part.select(*by, "piece", "seg_no", "lo", "hi", point(F.col("lo")).alias("p"), point(F.col("hi")).alias("q"))
    rows = part.groupBy(*by, "piece").agg(F.array_sort(F.collect_list(F.struct("seg_no", "p", "q"))).alias("s"), F.min("lo").alias("m0"), F.max("hi").alias("m1"))
    coords = F.concat(F.array(F.get("s", F.lit(0))["p"]), F.transform("s", lambda x: x["q"]))
    whole = lines.join(some.join(seg.select(*by).distinct(), by, "left_semi").select(*by), by, "left_anti")
    whole = whole.select(*by, F.lit(1).alias("piece"), F.col("coords").cast(POINTS).alias("coords"), F.lit(0.0).alias("m0"), line_length(F.col("coords")).alias("m1"))
    return rows.select(*by, "piece", coords.alias("coords"), "m0", "m1").unionByName(whole)


def merge_lines(model: DataFrame, human: DataFrame, deleted: DataFrame, keys: list[str], snap: float = 3.0, buf: float = 4.0) -> DataFrame:
    """``(keys, line_id, piece, coords, length, status, n_snapped)``: the model's lines with a person's edits.

    Ends of human lines snap to the nearest other line, which is split there.
    Of the model's pieces those that run along deleted lines (0.6 of their
    whole length within ``buf``, tested first) or along human lines after
    snapping (0.7) get the status ``deleted`` or ``superseded``; the others
    are ``model``. Human pieces always stay. The three tables hold lines with
    ``coords`` or straight segments; ids must be unique over model and human
    lines of a key. Lines of fewer than two vertices are passed over.
    """
    by = [*keys, "line_id"]
    role = lambda df, name: as_lines(df, keys).where(F.size("coords") > 1).withColumn("status", F.lit(name))
    both = materialise(role(model, "model").unionByName(role(human, "human")), "lines")
    drawn = both.where("status = 'human'").drop("status")
    ends = materialise(snap_line_ends(drawn, measured(both.drop("status"), keys), keys, snap), "snapped")
    lines = both.where("status = 'model'").withColumn("n_snapped", F.lit(0)).unionByName(with_ends(drawn, ends, keys).withColumn("status", F.lit("human")))
    lines = materialise(lines, "lines")
    cuts = ends.where("cut_at IS NOT NULL").select(*keys, F.col("other_id").alias("line_id"), F.col("cut_at").alias("at"))
    pieces = split_lines(lines.select(*by, "coords"), cuts, keys).join(lines.select(*by, "status", "n_snapped"), by)
    pieces = pieces.withColumn("n_snapped", F.when(F.col("piece") == 1, F.col("n_snapped")).otherwise(0))
    pieces = materialise(pieces.select(*by, "piece", "coords", (F.col("m1") - F.col("m0")).alias("length"), "status", "n_snapped"), "pieces")
    named = pieces.select(*keys, F.struct("line_id", "piece").alias("line_id"), "coords", "status")
    seg = materialise(measured(named.where("status = 'model'").drop("status"), keys), "segments")
    gone = measured(as_lines(deleted, keys), keys)
    d = line_shares(seg, gone, keys, buf).withColumnRenamed("share", "in_deleted")
    h = line_shares(seg, measured(named.where("status = 'human'").drop("status"), keys), keys, buf).withColumnRenamed("share", "in_human")
    share = d.join(h, by).select(*keys, "line_id.*", "in_deleted", "in_human")
    status = F.when(F.col("in_deleted") >= 0.6, "deleted").when(F.col("in_human") >= 0.7, "superseded").otherwise(F.col("status"))
    return pieces.join(share, [*by, "piece"], "left").withColumn("status", status).drop("in_deleted", "in_human")


def merge_geographic(model: DataFrame, human: DataFrame, deleted: DataFrame, keys: list[str], snap: float = 3.0, buf: float = 4.0, epsg: int | None = None) -> DataFrame:
    """``merge_lines`` for lines in degrees, with ``epsg``: worked on in metres of the given frame, else of each network's UTM zone, and taken back."""
    three = [as_lines(df, keys) for df in (model, human, deleted)]
    every = three[0].unionByName(three[1]).unionByName(three[2])
    frame = every.select(*keys).distinct().withColumn("epsg", F.lit(epsg)) if epsg else frames(every, keys)
    frame = materialise(frame, "frames")
    flat = [df.join(frame, keys).select(*keys, "line_id", to_frame(F.col("coords"), F.col("epsg")).alias("coords")) for df in three]
    return merge_lines(*flat, keys, snap, buf).join(frame, keys).withColumn("coords", from_frame(F.col("coords"), F.col("epsg")))

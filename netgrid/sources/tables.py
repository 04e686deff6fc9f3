"""Reading, pairing and checking of inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgrid.plans.order import ranked

POINTS = "array<array<double>>"


def list_links(pages: DataFrame, pattern: str, text: str = "html", key: str = "page_id") -> DataFrame:
    """``(page_id, name, pos)``: first group of every match, each name at its first place."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("pos", "name"))
    return each.groupBy(key, "name").agg(F.min("pos").alias("pos"))


def _features(feat: DataFrame) -> DataFrame:
    """Lines of ``(i, f)``: the number of a feature, or null, and its text."""
    g, kind = F.get_json_object("f", "$.geometry.coordinates"), F.get_json_object("f", "$.geometry.type")
    parts = F.when(kind == "LineString", F.array(F.from_json(g, POINTS))).when(kind == "MultiLineString", F.from_json(g, f"array<{POINTS}>"))
    given = F.get_json_object("f", "$.properties.feature_id")
    own = F.coalesce(given, F.format_string("m-%d", "i"))
    out = feat.select(own.alias("own"), F.get_json_object("f", "$.properties").alias("properties"), F.posexplode(parts).alias("j", "p")).where(F.size("p") >= 2)
    name = F.when(F.col("j") == 0, F.col("own")).otherwise(F.format_string("%s.%d", "own", "j"))
    return out.select(name.alias("feature_id"), F.transform("p", lambda x: F.struct(x[0].alias("x"), x[1].alias("y"))).alias("coords"), "properties")


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(feature_id, coords, properties)`` of the lines of GeoJSON; parts of multi-lines get a suffix.

    lines: one feature a line of text, as ``write_features`` writes them, read in splits of any size; else whole feature
    collections, which are as large as one row may be. Features are named by
    their property ``feature_id``, else by their number in the collection.
    """
    if lines:
        feat = spark.read.text(path).where(F.get_json_object("value", "$.type") == "Feature").select(F.lit(None).cast("int").alias("i"), F.col("value").alias("f"))
        return _features(feat)
    doc = spark.read.text(path, wholetext=True)
    return _features(doc.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("i", "f")))


def write_features(features: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """One GeoJSON feature a line of text; Spark's commit makes the folder appear whole. An empty network is an empty, valid file.

    stats: rows that are written beside them, as lines of the type ``Stats``, which readers of features pass over.
    """
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("coords", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    row = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c for c in features.columns if c != "coords"]).alias("properties")))
    out = features.select(row.alias("value"))
    if stats is not None:
        out = out.unionByName(stats.select(F.to_json(F.struct(F.lit("Stats").alias("type"), F.struct(*stats.columns).alias("stats"))).alias("value")))
    out.write.mode("overwrite").text(path)


def write_graph(graph: DataFrame, path: str, region: str = "region_id") -> None:
    """An adjacency as one JSON record a node: region, node and its neighbours."""
    near = F.array_sort(F.collect_list(F.struct(F.col("mr").alias("r"), F.col("mc").alias("c")))).alias("nbrs")
    nodes = graph.groupBy(region, F.struct(F.col("nr").alias("r"), F.col("nc").alias("c")).alias("node")).agg(near)
    nodes.write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str, region: str = "region_id") -> DataFrame:
    """``(region, nr, nc, mr, mc)`` from adjacency records; records that cannot be read are left out."""
    at = "struct<r:bigint,c:bigint>"
    rows = spark.read.schema(f"{region} bigint, node {at}, nbrs array<{at}>").option("mode", "DROPMALFORMED").json(path)
    return rows.select(region, F.col("node.r").alias("nr"), F.col("node.c").alias("nc"), F.inline("nbrs").alias("mr", "mc"))


def write_chips(chips: DataFrame, path: str, by: str = "mosaic_id") -> None:
    """Chips in one folder a mosaic, so that a mosaic is read alone."""
    chips.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def pair_tiles(images: DataFrame, labels: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """Images and labels of the same name, of some names only if given."""
    out = images.join(labels, key)
    return out if only is None else out.join(only, key, "left_semi")


def file_index(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    return files.select(*keys, F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("length"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("set").agg(F.count("*").alias("n"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One folder a set."""
    manifest.write.mode("overwrite").partitionBy("set").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, only: str | None = None) -> DataFrame:
    """The rows of a manifest, of one set if given: the other folders are not read."""
    out = spark.read.schema(f"{schema}, set string").json(path)
    return out if only is None else out.where(F.col("set") == only)


def refresh_cache(refs: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Rows for all of ``refs``: cached ones without error, and newly computed ones for the rest."""
    kept = cache.where("error = ''").join(refs.select(key), key, "left_semi")
    return kept.unionByName(compute(refs.join(kept.select(key), key, "left_anti")))


def copy_grid(labels: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Labels with the frame of the image of the same name, and what came of it.

    Where both tables have an origin and cell size (x0, y0, px), labels that get the frame get these too.
    """
    place = [c for c in ("x0", "y0", "px") if c in labels.columns and c in images.columns]
    i = images.select(key, *[F.col(c).alias("i_" + c) for c in ("width", "height", "crs", *place)])
    same = (F.col("width") == F.col("i_width")) & (F.col("height") == F.col("i_height"))
    status = F.when(F.col("i_width").isNull(), "no match").when(~same | F.col("i_crs").isNull(), "failed").when(F.col("crs").isNotNull(), "already").otherwise("done")
    copied = {c: F.when(status == "done", F.col("i_" + c)).otherwise(F.col(c)) for c in ("crs", *place)}
    return labels.join(i, key, "left").withColumns({"status": status, **copied}).drop("i_width", "i_height", "i_crs", *["i_" + c for c in place])


def validate_rasters(rasters: DataFrame) -> DataFrame:
    """``ok`` and ``reason``: a raster needs a frame and at least one cell."""
    reason = F.when(F.col("crs").isNull(), "no coordinate reference system").when((F.col("width") < 1) | (F.col("height") < 1), "empty raster")
    return rasters.withColumns({"reason": reason, "ok": reason.isNull()})


def read_job_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that cannot be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_stage(log: DataFrame, job: str = "job_id", order: str = "seq") -> DataFrame:
    """The last stage of every job, and how many there were."""
    last = log.groupBy(job).agg(F.max_by(F.struct("stage", "at"), order).alias("s"), F.count("*").alias("n_stages"))
    return last.select(job, "s.stage", "s.at", "n_stages")


def list_jobs(log: DataFrame, artefacts: dict[str, str], metrics: list[str] = (), job: str = "job_id", order: str = "seq") -> DataFrame:
    """Jobs with their latest stage, ``rank`` (1: the newest, by the time of the last stage, ties by the greater job), flags and metrics.

    ``artefacts`` names a flag for a stage that makes something: ``has_<name>`` tells whether the job went
    through it. ``metrics`` are columns of the log, of which the last value that is not null counts.
    """
    last = log.groupBy(job).agg(
        F.max_by(F.struct("stage", "at"), order).alias("s"), F.count("*").alias("n_stages"),
        *[F.coalesce(F.bool_or(F.col("stage") == stage), F.lit(False)).alias("has_" + name) for name, stage in artefacts.items()],
        *[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(order))).alias(m) for m in metrics],
    )
    told = last.select(job, "s.stage", "s.at", *[c for c in last.columns if c not in (job, "s")])
    return ranked(told, [F.desc("at"), F.desc(job)], "rank").withColumn("rank", F.col("rank") + 1)

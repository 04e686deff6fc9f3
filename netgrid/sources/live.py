"""Live tables, replaced raster by raster, in a fixed number of folders however many rasters there are."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgrid.operators.edits import apply_candidate
from netgrid.operators.ledger import restore_best
from netgrid.plans.storage import materialise

GONE = "_gone"  # marks a raster whose rows were all taken away
BUCKET, BUCKETS = "live_bucket", 256  # a raster's folder


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int"))


def _held(like: DataFrame, path: str) -> DataFrame | None:
    """The rows of the table in ``path``, if there is one."""
    try:
        return like.sparkSession.read.schema(like.schema).parquet(path).where(~F.col(GONE))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_live(rows: DataFrame, path: str, key: str = "raster_id", keys: DataFrame | None = None) -> None:
    """Replace the rows of the rasters in ``rows``, and of those in ``keys`` that have none left; all others stay as they are.

    Rasters share folders by a hash of their key; the rows of others in a
    folder that is touched are written again. Spark writes beside the table and
    moves the folders when all tasks have ended, so tasks that are tried again,
    or a job that fails, change nothing. All rows are written elsewhere first,
    so they may come from the table itself.
    """
    rows = materialise(rows.withColumn(GONE, F.lit(False)), "live")
    given = rows.select(key).distinct()
    if keys is not None:
        empty = keys.select(key).distinct().join(given, key, "left_anti").withColumn(GONE, F.lit(True))
        rows = rows.unionByName(empty, allowMissingColumns=True)
    rows = _bucketed(rows, key)
    old = _held(rows, path)
    if old is not None:
        given = materialise(_bucketed(rows.select(F.col(key).alias("_key")).distinct(), "_key"), "live")
        kept = old.join(given.select(BUCKET).distinct(), BUCKET, "left_semi").join(given, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        rows = rows.unionByName(materialise(kept, "live"))
    out = rows.repartition(BUCKET).sortWithinPartitions(BUCKET, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(BUCKET).parquet(path)


def read_live(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a live table; they lie in order of its key, so that a filter on it skips most."""
    return spark.read.schema(f"{schema}, {GONE} boolean").parquet(path).where(~F.col(GONE)).drop(GONE, BUCKET)


def refresh_chips(spark: SparkSession, path: str, schema: str, fresh: DataFrame, keys: list[str]) -> None:
    """Put the re-scored chips ``fresh`` in place of those of the same ids; other chips of their mosaics stay."""
    live = read_live(spark, path, schema)
    touched = fresh.select(keys[0]).distinct()
    old = live.join(touched, keys[0], "left_semi").join(fresh.select(*keys), keys, "left_anti")
    write_live(old.unionByName(fresh), path, keys[0])


def make_live(spark: SparkSession, path: str, schema: str, candidates: DataFrame, chosen: str, key: str = "raster_id", id_col: str = "variant_id") -> None:
    """Make a candidate's rows the live ones of all rasters for which candidates were tried; an unknown id changes nothing and is an error."""
    apply_candidate(read_live(spark, path, schema), candidates, chosen, key, id_col)
    write_live(candidates.where(F.col(id_col) == chosen).drop(id_col), path, key, candidates)


def restore_live(path: str, versions: DataFrame, measured: DataFrame, task: str = "task_id", step: str = "step") -> None:
    """Make the rows of each task's best measurement live; without any measurement it is an error, and nothing changes."""
    if measured.where("is_best").isEmpty():
        raise ValueError("nothing was measured, so there is no best map to restore")
    write_live(restore_best(versions, measured, task, step).drop(step), path, task)

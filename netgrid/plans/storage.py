"""Where intermediate tables go: one shared folder named by the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows in memory against their files.
WIDER = 10.0
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where a session on one machine names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="netgrid-"))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs only the tasks that were running: the written
    table is on storage that every executor reads. Spark takes the size of
    files for that of their rows, and these pack well: it is told of WIDER times
    as much, so that it does not bring large tables to the driver to broadcast them.
    """
    spark = df.sparkSession
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < WIDER:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(WIDER))
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

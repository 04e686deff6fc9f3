"""Ranks over whole tables, and folds over ordered groups, without one task that holds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from netgrid.plans.storage import materialise


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``name``: each row's place, from 0, in an order over the whole table; the order should tell all rows apart.

    Rows are dealt by ranges of the order and ranked within their part; one count a part is added up before it.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(start), "_part").withColumn(name, F.col("_own") + F.col("_start")).drop("_part", "_own", "_start")


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """For each new name of ``sums``: the sum of a column over all rows before, in an order over the whole table.

    Dealt and added up like ``ranked``. Null values count as 0; the order should tell all rows apart.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(*[F.sum(c).alias("_" + name) for name, c in sums.items()])  # one row a part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_part", *[F.coalesce(F.sum("_" + name).over(before), F.lit(0)).alias("_" + name) for name in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({"_own_" + name: F.coalesce(F.sum(c).over(own), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(start), "_part")
    return out.withColumns({name: F.col("_own_" + name) + F.col("_" + name) for name in sums}).drop("_part", *["_own_" + n for n in sums], *["_" + n for n in sums])


def fold(df: DataFrame, key: str, order: str, columns: list[str], out_fields: list[StructField], start: Callable, step: Callable, finish: Callable | None = None) -> DataFrame:
    """A fold over the rows of each key in order, where every step needs the one before.

    ``start()`` makes a state, ``step(state, *columns)`` returns an output row
    or None, ``finish(state)`` the rows at a key's end. Output rows have the key
    and ``out_fields``. A task streams over its keys and holds one state, never a key's rows.
    """
    schema = StructType([df.schema[key], *out_fields])
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, None, []

        def end():
            if finish and held is not None:
                out.extend((held[0], *r) for r in finish(state))

        def batch():
            cols = zip(*out, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return made

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is None or held[0] != k:
                    end()
                    held, state = (k,), start()
                got = step(state, *row)
                if got is not None:
                    out.append((k, *got))
            if out:
                yield batch()
        end()
        if out:
            yield batch()

    dealt = df.select(key, *columns).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, schema)

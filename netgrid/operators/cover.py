"""Grid cells along segments: rows for a proximity join that grow with length, not with the area of a box."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = 1 << 32  # cells lie within 2^31 of the origin in each direction
SURE = 1e-6  # on top of every padding, for rounding where pieces meet


def cell_at(x: Column, y: Column, size: float) -> Column:
    """The cell of a point, as one number."""
    return F.floor(x / size) * F.lit(WIDE) + F.floor(y / size)


def cells_along(x0: Column, y0: Column, x1: Column, y1: Column, pad: float, size: float) -> Column:
    """All cells within ``pad`` of a segment, each once, and few others.

    The segment is walked in pieces no longer than a cell either way, each of
    which takes the cells of its padded box: four or so, and more where
    ``pad`` is large against the cell.
    """
    n = F.greatest(F.ceil(F.greatest(F.abs(x1 - x0), F.abs(y1 - y0)) / size), F.lit(1)).cast("int")
    floor = lambda v: F.floor(v / size)

    def box(k: Column) -> Column:
        a, b = k / n, (k + 1) / n
        xa, xb, ya, yb = x0 + (x1 - x0) * a, x0 + (x1 - x0) * b, y0 + (y1 - y0) * a, y0 + (y1 - y0) * b
        rows = F.sequence(floor(F.least(ya, yb) - pad - SURE), floor(F.greatest(ya, yb) + pad + SURE))
        columns = F.sequence(floor(F.least(xa, xb) - pad - SURE), floor(F.greatest(xa, xb) + pad + SURE))
        return F.flatten(F.transform(columns, lambda i: F.transform(rows, lambda j: i * F.lit(WIDE) + j)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), box)))

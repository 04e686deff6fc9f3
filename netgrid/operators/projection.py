"""Frames in metres: transverse Mercator (UTM zones) by Krueger's series, and web Mercator.

Coordinates are ``ARRAY<STRUCT<x, y>>``, in degrees (x: longitude) or metres. A
frame is an EPSG code: 32601-32660 and 32701-32760 for the zones north and
south, 3857 for web Mercator, 4326 for degrees. All of it is Spark expressions.
"""

from __future__ import annotations

import math
from fractions import Fraction as Q

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the WGS 84 ellipsoid, the UTM scale and offsets, the sphere of web Mercator
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)  # third flattening
E = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)

# fixed values: coefficients of n, n^2 ... n^6 of each term of Krueger's series (Karney, 2011)
FORWARD = [
    [Q(1, 2), Q(-2, 3), Q(5, 16), Q(41, 180), Q(-127, 288), Q(7891, 37800)],
    [0, Q(13, 48), Q(-3, 5), Q(557, 1440), Q(281, 630), Q(-1983433, 1935360)],
    [0, 0, Q(61, 240), Q(-103, 140), Q(15061, 26880), Q(167603, 181440)],
    [0, 0, 0, Q(49561, 161280), Q(-179, 168), Q(6601661, 7257600)],
    [0, 0, 0, 0, Q(34729, 80640), Q(-3418889, 1995840)],
    [0, 0, 0, 0, 0, Q(212378941, 319334400)],
]
INVERSE = [
    [Q(1, 2), Q(-2, 3), Q(37, 96), Q(-1, 360), Q(-81, 512), Q(96199, 604800)],
    [0, Q(1, 48), Q(1, 15), Q(-437, 1440), Q(46, 105), Q(-1118711, 3870720)],
    [0, 0, Q(17, 480), Q(-37, 840), Q(-209, 4480), Q(5569, 90720)],
    [0, 0, 0, Q(4397, 161280), Q(-11, 504), Q(-830251, 7257600)],
    [0, 0, 0, 0, Q(4583, 161280), Q(-108847, 3991680)],
    [0, 0, 0, 0, 0, Q(20648693, 638668800)],
]
LATITUDE = [
    [2, Q(-2, 3), -2, Q(116, 45), Q(26, 45), Q(-2854, 675)],
    [0, Q(7, 3), Q(-8, 5), Q(-227, 45), Q(2704, 315), Q(2323, 945)],
    [0, 0, Q(56, 15), Q(-136, 35), Q(-1262, 105), Q(73814, 2835)],
    [0, 0, 0, Q(4279, 630), Q(-332, 35), Q(-399572, 14175)],
    [0, 0, 0, 0, Q(4174, 315), Q(-144838, 6237)],
    [0, 0, 0, 0, 0, Q(601676, 22275)],
]


def terms(table: list[list]) -> list[float]:
    """The factor of each term of a series, for the ellipsoid's flattening."""
    return [sum(float(c) * N ** (k + 1) for k, c in enumerate(row)) for row in table]


def frame_of(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone of a place."""
    zone = F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))
    return F.when(lat >= 0, 32600).otherwise(32700) + zone


def frames(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, epsg)``: for every network in degrees the UTM zone of the mean of its vertices; those of networks without vertices are at 0, 0."""
    points = lines.select(*keys, F.explode_outer("coords").alias("p"))
    mean = points.groupBy(*keys).agg(F.coalesce(F.avg("p.x"), F.lit(0.0)).alias("lon"), F.coalesce(F.avg("p.y"), F.lit(0.0)).alias("lat"))
    return mean.select(*keys, frame_of(F.col("lon"), F.col("lat")).alias("epsg"))


def _each(coords: Column, *steps) -> Column:
    """Steps on every point, one pass over the array each, so that what a step uses several times is computed once."""
    for step in steps:
        coords = F.transform(coords, step)
    return coords


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def _meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6.0 - 183.0


def _shift(epsg: Column) -> Column:
    return F.when(epsg > 32700, SOUTH).otherwise(0.0)


def _series(p: Column, factors: list[float], sign: int) -> Column:
    x = p["x"] + sum(sign * f * F.sin(2 * k * p["x"]) * F.cosh(2 * k * p["y"]) for k, f in enumerate(factors, 1))
    y = p["y"] + sum(sign * f * F.cos(2 * k * p["x"]) * F.sinh(2 * k * p["y"]) for k, f in enumerate(factors, 1))
    return _point(x, y)


def utm(coords: Column, epsg: Column) -> Column:
    """Degrees to metres of a UTM zone. Steps: the tangent of the conformal latitude; the sphere's transverse Mercator; the series."""

    def conformal(p: Column) -> Column:
        t = F.tan(F.radians(p["y"]))
        sec = F.sqrt(1 + t * t)
        s = F.sinh(E * F.atanh(E * t / sec))
        return _point(F.radians(p["x"] - _meridian(epsg)), t * F.sqrt(1 + s * s) - s * sec)

    def sphere(p: Column) -> Column:
        return _point(F.atan2(p["y"], F.cos(p["x"])), F.asinh(F.sin(p["x"]) / F.sqrt(p["y"] * p["y"] + F.pow(F.cos(p["x"]), F.lit(2.0)))))

    def metres(p: Column) -> Column:
        return _point(EAST + SCALE * RADIUS * p["y"], _shift(epsg) + SCALE * RADIUS * p["x"])

    return _each(coords, conformal, sphere, lambda p: _series(p, terms(FORWARD), 1), metres)


def utm_back(coords: Column, epsg: Column) -> Column:
    """Metres of a UTM zone to degrees."""

    def unit(p: Column) -> Column:
        return _point((p["y"] - _shift(epsg)) / (SCALE * RADIUS), (p["x"] - EAST) / (SCALE * RADIUS))

    def sphere(p: Column) -> Column:
        return _point(F.atan2(F.sinh(p["y"]), F.cos(p["x"])), F.asin(F.sin(p["x"]) / F.cosh(p["y"])))

    def degrees(p: Column) -> Column:
        lat = p["y"] + sum(f * F.sin(2 * k * p["y"]) for k, f in enumerate(terms(LATITUDE), 1))
        return _point(F.degrees(p["x"]) + _meridian(epsg), F.degrees(lat))

    return _each(coords, unit, lambda p: _series(p, terms(INVERSE), -1), sphere, degrees)


def web_mercator(coords: Column) -> Column:
    return _each(coords, lambda p: _point(MAJOR * F.radians(p["x"]), MAJOR * F.asinh(F.tan(F.radians(p["y"])))))


def web_mercator_back(coords: Column) -> Column:
    return _each(coords, lambda p: _point(F.degrees(p["x"] / MAJOR), F.degrees(F.atan(F.sinh(p["y"] / MAJOR)))))


def _chosen(epsg: Column, coords: Column, zone: Column, web: Column) -> Column:
    known = F.when(_is_utm(epsg), zone).when(epsg == 3857, web).when(epsg == 4326, coords)
    return known.otherwise(F.raise_error(F.concat(F.lit("no such frame: EPSG "), F.coalesce(epsg.cast("string"), F.lit("null")))))


def to_frame(coords: Column, epsg: Column) -> Column:
    """Degrees to the frame; a code of another kind, or null, is an error."""
    return _chosen(epsg, coords, utm(coords, epsg), web_mercator(coords))


def from_frame(coords: Column, epsg: Column) -> Column:
    """Back to degrees."""
    return _chosen(epsg, coords, utm_back(coords, epsg), web_mercator_back(coords))

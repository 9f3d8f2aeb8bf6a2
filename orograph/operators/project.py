"""Grids in one coordinate system onto grids in another.

Coordinate systems go by their EPSG number: 4326 (longitude and latitude), 3857 (Web
Mercator) and 326zz / 327zz (UTM, north and south). The series of the transverse Mercator projection are
column expressions, good to micrometres within a zone; a target pixel looks up the four
source pixels about it by one equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.operators import resample

#: The ellipsoid (WGS 84) and UTM's scale and false easting and northing.
MAJOR, FLAT = 6378137.0, 1 / 298.257223563
SCALE, EAST, NORTH = 0.9996, 500_000.0, 10_000_000.0
_N = FLAT / (2 - FLAT)
RADIUS = MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
E1 = 2 * math.sqrt(_N) / (1 + _N)


def centre(code: Column) -> Column:
    """Central meridian of a UTM zone, in degrees."""
    return (code % 100) * F.lit(6.0) - F.lit(183.0)


def in_south(code: Column) -> Column:
    return F.when(F.floor(code / 100) == 327, F.lit(NORTH)).otherwise(F.lit(0.0))


def from_lonlat(df: DataFrame, code: Column, lon: Column, lat: Column, x: str, y: str) -> DataFrame:
    """``df`` with ``x`` and ``y``: the place in the coordinate system ``code``.

    What a step uses more than once is a column of the step before, so it is computed once.
    """
    t = df.withColumns({"_code": code, "_lon": lon, "_lat": lat}).withColumns({"_phi": F.radians("_lat"), "_lam": F.radians(F.col("_lon") - centre(F.col("_code")))})
    t = t.withColumn("_t", F.sinh(F.atanh(F.sin("_phi")) - F.lit(E1) * F.atanh(F.lit(E1) * F.sin("_phi"))))
    t = t.withColumns({"_xi": F.atan2("_t", F.cos("_lam")), "_eta": F.atanh(F.sin("_lam") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    u, v = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(ALPHA, 1):
        turn, swell = 2 * j * F.col("_xi"), 2 * j * F.col("_eta")
        u, v = u + F.lit(a) * F.cos(turn) * F.sinh(swell), v + F.lit(a) * F.sin(turn) * F.cosh(swell)
    k, c = F.lit(SCALE * RADIUS), F.col("_code")
    mx, my = F.radians("_lon") * MAJOR, F.log(F.tan(F.lit(math.pi / 4) + F.col("_phi") / 2)) * MAJOR
    t = t.withColumns({x: F.when(c == 4326, F.col("_lon")).when(c == 3857, mx).otherwise(F.lit(EAST) + k * u), y: F.when(c == 4326, F.col("_lat")).when(c == 3857, my).otherwise(in_south(c) + k * v)})
    return t.drop("_code", "_lon", "_lat", "_phi", "_lam", "_t", "_xi", "_eta")


def to_lonlat(df: DataFrame, code: Column, x: Column, y: Column, lon: str, lat: str) -> DataFrame:
    """``df`` with ``lon`` and ``lat`` in degrees of x and y in the coordinate system ``code``."""
    k, c = F.lit(SCALE * RADIUS), F.col("_code")
    t = df.withColumns({"_code": code, "_x": x, "_y": y}).withColumns({"_xi": (F.col("_y") - in_south(c)) / k, "_eta": (F.col("_x") - EAST) / k})
    u, v = F.col("_xi"), F.col("_eta")
    for j, b in enumerate(BETA, 1):
        turn, swell = 2 * j * F.col("_xi"), 2 * j * F.col("_eta")
        u, v = u - F.lit(b) * F.sin(turn) * F.cosh(swell), v - F.lit(b) * F.cos(turn) * F.sinh(swell)
    t = t.withColumns({"_u": u, "_v": v}).withColumn("_chi", F.asin(F.sin("_u") / F.cosh("_v")))
    phi = F.col("_chi")
    for j, d in enumerate(DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * F.col("_chi"))
    east = centre(c) + F.degrees(F.atan2(F.sinh("_v"), F.cos("_u")))
    my = F.degrees(2 * F.atan(F.exp(F.col("_y") / MAJOR))) - 90
    t = t.withColumns({lon: F.when(c == 4326, F.col("_x")).when(c == 3857, F.degrees(F.col("_x") / MAJOR)).otherwise(east), lat: F.when(c == 4326, F.col("_y")).when(c == 3857, my).otherwise(F.degrees(phi))})
    return t.drop("_code", "_x", "_y", "_xi", "_eta", "_u", "_v", "_chi")


def transformed(df: DataFrame, source: Column, target: Column, x: Column, y: Column, to_x: str, to_y: str) -> DataFrame:
    """``df`` with ``to_x`` and ``to_y``: x and y of the system ``source`` in the system ``target``."""
    t = df.withColumns({"_sx": x, "_sy": y, "_same": source == target, "_to": target})
    t = from_lonlat(to_lonlat(t, source, F.col("_sx"), F.col("_sy"), "_east", "_north"), F.col("_to"), F.col("_east"), F.col("_north"), to_x, to_y)
    t = t.withColumns({to_x: F.when(F.col("_same"), F.col("_sx")).otherwise(F.col(to_x)), to_y: F.when(F.col("_same"), F.col("_sy")).otherwise(F.col(to_y))})
    return t.drop("_sx", "_sy", "_same", "_to", "_east", "_north")


def reprojected(px: DataFrame, grids: DataFrame, targets: DataFrame) -> DataFrame:
    """(scene, r, c, z) on the grids ``targets`` (scene, crs, x0, y0, size, h, w), bilinear.

    ``grids`` says where the pixels ``px`` lie (scene, crs, x0, y0, size): (x0, y0) is the
    upper left corner, ``size`` a pixel's side. A target pixel whose centre lies outside its source, or
    over half of whose weight is missing, is null.
    """
    s = grids.select("scene", F.col("crs").alias("_crs"), F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.col("size").alias("_size"))
    dims = resample.dims_of(px)
    t = targets.select("scene", "crs", "x0", "y0", "size", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("_r"))
    t = t.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).drop("w").join(s, "scene").join(dims, "scene")
    t = transformed(t, F.col("crs"), F.col("_crs"), F.col("x0") + (F.col("_c") + 0.5) * F.col("size"), F.col("y0") - (F.col("_r") + 0.5) * F.col("size"), "x", "y")
    t = t.withColumn("x", (F.col("x") - F.col("_x0")) / F.col("_size") - 0.5).withColumn("y", (F.col("_y0") - F.col("y")) / F.col("_size") - 0.5)
    inside = F.col("x").between(-0.5, F.col("w") - 0.5) & F.col("y").between(-0.5, F.col("h") - 0.5)
    points = t.select("scene", F.col("_r").alias("row"), F.col("_c").alias("col"), F.when(inside, F.col("y")).alias("y"), F.when(inside, F.col("x")).alias("x"), inside.alias("inside"))
    found = resample.bilinear(px, points, dims)
    return found.select("scene", F.col("row").alias("r"), F.col("col").alias("c"), F.when(F.col("inside"), F.col("z")).alias("z"))

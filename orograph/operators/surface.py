"""Surfaces made clean: smoothing that keeps edges, and holes filled smoothly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside, materialize
from orograph.operators import focal, zonal

AT = ["scene", "r", "c"]


def bilateral(a: np.ndarray, radius: int, sigma_value: float, sigma_space: float) -> np.ndarray:
    """Means over a disc, weighted by distance and by how near the values are; the outer ``radius`` pixels are not to be used."""
    total, weight = np.zeros_like(a), np.zeros_like(a)
    for i in range(-radius, radius + 1):
        for j in range(-radius, radius + 1):
            if i * i + j * j <= radius * radius:
                b = np.roll(a, (-i, -j), (0, 1))
                w = np.exp(-0.5 * (i * i + j * j) / sigma_space**2 - 0.5 * ((b - a) / sigma_value) ** 2)
                total += w * b
                weight += w
    return total / weight


def edge_preserved(px: DataFrame, *, radius: int = 4, sigma_value: float = 0.08, sigma_space: float = 9.0, column: str = "z", out: str = "clean") -> DataFrame:
    """``px`` with ``out``: the surface smoothed within edges; holes stay.

    The surface is scaled to 0..1 between its 0.5 and 99.5 percentiles and clipped, holes
    are the median for the neighbours' sake, and each pixel becomes the mean of a disc about it, in which
    values count the less the further they are apart.
    """
    t = beside(px, quantiles(px, ["scene"], _q=(column, 0.005, 0.995)), "scene")
    wide = F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-9))
    scaled = F.least(F.greatest((F.col(column) - F.col("_q")[0]) / wide, F.lit(0.0)), F.lit(1.0))
    t = t.withColumn("_x", F.when(F.col(column).isNotNull(), scaled))
    t = materialize(beside(t, quantiles(t, ["scene"], _mid=("_x", 0.5)), "scene").withColumn("_x", F.coalesce("_x", "_mid")), "scaled")
    low = focal.tiled(t, ["_x"], radius, lambda a: {"_y": bilateral(a, radius, sigma_value, sigma_space)}, ["_y"], pad="reflect")
    t = t.join(low, AT).withColumn(out, F.when(F.col(column).isNotNull(), F.col("_y") * wide + F.col("_q")[0]))
    return t.drop("_q", "_x", "_mid", "_y")


def filled_smoothly(px: DataFrame, *, sigma: float = 3.0, radius: int = 3) -> DataFrame:
    """Holes of z filled from the nearest pixels, however far, and smoothed where they were; a scene without data stays as it is."""
    t = zonal.nearest_fill(px.select(*AT, "z"), radius).withColumnRenamed("z", "_full")
    t = materialize(t, "filled")
    low = focal.gaussian(t, sigma, "_full", "_low")
    return px.join(low, AT).withColumn("z", F.coalesce("z", "_low")).drop("_low")

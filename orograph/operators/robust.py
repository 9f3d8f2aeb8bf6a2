"""Robust fits by iteratively reweighted least squares, one fit per group.

A round is a few grouped aggregates: sums for the normal equations, then the median
and the median deviation of the residuals, from which a row's weight follows. The
coefficients (a row per group) are written after each round, so plans stay short and
a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.ranks import MOST, largest_group, quantiles
from orograph.functions.tables import beside, materialize

MAD = 1.4826


def _solve2(s: dict[str, str]) -> dict[str, Column]:
    c = {k: F.col(v) for k, v in s.items()}
    det = c["xx"] * c["n"] - c["x"] * c["x"]
    ok = F.abs(det) > 1e-18
    return {"a": F.when(ok, (c["xy"] * c["n"] - c["x"] * c["y"]) / det), "b": F.when(ok, (c["xx"] * c["y"] - c["x"] * c["xy"]) / det)}


def medians(t: DataFrame, by: list[str], value: Column | str, name: str, small: bool) -> DataFrame:
    """A row per group; ``small``: the groups are known to fit a task each."""
    return t.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias(name)) if small else quantiles(t, by, most=0, **{name: (value, 0.5)})


def weighted(t: DataFrame, coef: DataFrame, by: list[str], residual: Column, small: bool) -> DataFrame:
    """``t`` with residuals of the group's coefficients and the weights they lead to (w2, squared)."""
    t = beside(t, coef, by).withColumn("_r", residual)
    t = beside(t, medians(t, by, "_r", "_m", small), by)
    mad = medians(t, by, F.abs(F.col("_r") - F.col("_m")), "_d", small).select(*by, (F.lit(MAD) * F.col("_d") + F.lit(1e-9)).alias("_s"))
    z = F.col("_r") / (F.lit(2.0) * F.col("_s"))
    return beside(t, mad, by).withColumn("w2", F.lit(1.0) / (F.lit(1.0) + z * z))


def affine(points: DataFrame, by: list[str], *, rounds: int = 5, least: int = 10) -> DataFrame:
    """(by, a, b): y = a x + b, robust against outliers; (1, 0) for groups of under ``least`` points or without spread."""
    t = materialize(points.select(*by, "x", "y").filter("x is not null and y is not null"), "affine-points")
    small = largest_group(t, by) <= MOST
    enough = materialize(t.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sd")).select(*by, ((F.col("n") >= least) & (F.col("sd") > 1e-9)).alias("ok")), "affine-groups")
    w, coef = t.withColumn("w2", F.lit(1.0)), None
    for _ in range(rounds):
        x, y, k = F.col("x"), F.col("y"), F.col("w2")
        sums = w.groupBy(*by).agg(F.sum(k).alias("sn"), F.sum(k * x).alias("sx"), F.sum(k * y).alias("sy"), F.sum(k * x * x).alias("sxx"), F.sum(k * x * y).alias("sxy"))
        fit = _solve2({"n": "sn", "x": "sx", "y": "sy", "xx": "sxx", "xy": "sxy"})
        coef = materialize(sums.select(*by, *[v.alias(k) for k, v in fit.items()]), "affine-fit")
        w = weighted(t, coef, by, F.col("y") - F.col("a") * F.col("x") - F.col("b"), small)
    out = enough.join(coef, by)
    return out.select(*by, F.when(F.col("ok"), F.coalesce("a", F.lit(1.0))).otherwise(F.lit(1.0)).alias("a"), F.when(F.col("ok"), F.coalesce("b", F.lit(0.0))).otherwise(F.lit(0.0)).alias("b"))


def affine_scores(px: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, n, rmse_raw, rmse_affine): ref against pred as it is and against a pred + b of the group's robust fit."""
    t = px.filter("pred is not null and ref is not null")
    fit = affine(t.select(*by, F.col("pred").alias("x"), F.col("ref").alias("y")), by)
    rmse = lambda x: F.sqrt(F.avg((x - F.col("ref")) ** 2))
    scores = [F.count(F.lit(1)).alias("n"), rmse(F.col("pred")).alias("rmse_raw"), rmse(F.col("a") * F.col("pred") + F.col("b")).alias("rmse_affine")]
    return beside(t, fit, by).groupBy(*by, "a", "b").agg(*scores)


def plane(px: DataFrame, *, rounds: int = 3) -> DataFrame:
    """(scene, p, q, o): z = p x + q y + o with x, y the column and row scaled to -1..1 of the scene."""
    dims = px.groupBy("scene").agg(F.max("r").alias("_h"), F.max("c").alias("_w"))
    half = lambda n: F.col(n) / F.lit(2.0)
    t = beside(px.filter("z is not null"), dims, "scene")
    t = t.select("scene", "r", "c", "z", ((F.col("c") - half("_w")) / F.greatest(half("_w"), F.lit(1.0))).alias("x"), ((F.col("r") - half("_h")) / F.greatest(half("_h"), F.lit(1.0))).alias("y"))
    t = materialize(t, "plane-points")
    small = largest_group(t, ["scene"]) <= MOST
    w, coef = t.withColumn("w2", F.lit(1.0)), None
    for _ in range(rounds):
        x, y, z, k = F.col("x"), F.col("y"), F.col("z"), F.col("w2")
        s = w.groupBy("scene").agg(*[F.sum(k * v).alias(n) for n, v in {"n": F.lit(1.0), "sx": x, "sy": y, "sz": z, "xx": x * x, "yy": y * y, "xy": x * y, "xz": x * z, "yz": y * z}.items()])
        c = {n: F.col(n) for n in s.columns}

        def det(a):
            return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])

        m = [c["xx"], c["xy"], c["sx"], c["xy"], c["yy"], c["sy"], c["sx"], c["sy"], c["n"]]
        v = [c["xz"], c["yz"], c["sz"]]
        d = det(m)
        cols = []
        for j, name in enumerate(("p", "q", "o")):
            mj = [v[i // 3] if i % 3 == j else m[i] for i in range(9)]
            cols.append(F.when(F.abs(d) > 1e-18, det(mj) / d).otherwise(F.lit(0.0)).alias(name))
        coef = materialize(s.select("scene", *cols), "plane-fit")
        w = weighted(t, coef, ["scene"], F.col("z") - F.col("p") * F.col("x") - F.col("q") * F.col("y") - F.col("o"), small)
    return coef


def detrend(px: DataFrame, **options) -> DataFrame:
    """``px`` with ``plane`` and ``flat`` = z - plane."""
    coef = plane(px, **options)
    dims = px.groupBy("scene").agg(F.max("r").alias("_h"), F.max("c").alias("_w"))
    half = lambda n: F.col(n) / F.lit(2.0)
    t = beside(px, dims.join(coef, "scene", "left"), "scene")
    x, y = (F.col("c") - half("_w")) / F.greatest(half("_w"), F.lit(1.0)), (F.col("r") - half("_h")) / F.greatest(half("_h"), F.lit(1.0))
    t = t.withColumn("plane", F.coalesce(F.col("p") * x + F.col("q") * y + F.col("o"), F.lit(0.0)))
    return t.withColumn("flat", F.col("z") - F.col("plane")).drop("_h", "_w", "p", "q", "o")

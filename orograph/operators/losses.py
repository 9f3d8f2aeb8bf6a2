"""The combined loss of a height prediction: heights, bins, gradients, scale-free shape and classes, weighted together.

Each part is a row per scene from grouped aggregates over its pixels; arrays of a pixel
(scores of bins or classes) are folded by expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside, materialize
from orograph.operators import focal

#: The share of each part.
WEIGHTS = {"l1": 1.0, "ce": 0.3, "grad": 0.5, "chamfer": 0.1, "seg": 0.3, "ssi": 0.5, "ssi_grad": 0.25}


def log_height(h: Column, h0: float) -> Column:
    return F.log1p(F.greatest(h, F.lit(0.0)) / F.lit(h0))


def log_sum_exp(xs: Column) -> Column:
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def soft_cross_entropy(scores: Column, targets: Column) -> Column:
    """-sum of softmax(targets) times log softmax(scores)."""
    norm = log_sum_exp(targets)
    both = F.zip_with(targets, scores, lambda t, s: F.exp(t - norm) * s)
    return log_sum_exp(scores) - F.aggregate(both, F.lit(0.0), lambda a, x: a + x)


def band_weights(px: DataFrame, *, bands: int, top: float, power: float, low: float = 0.2, high: float = 10.0) -> DataFrame:
    """``px`` with ``band`` and ``weight`` by how rare a scene's heights (``u``, logarithmic) are."""
    t = px.withColumn("band", F.least(F.greatest(F.floor(F.col("u") / F.lit(top) * bands), F.lit(0)), F.lit(bands - 1)).cast("int"))
    n = t.groupBy("scene", "band").count()
    every = F.sum("count").over(W.partitionBy("scene"))
    n = n.withColumn("_f", F.pow(F.greatest(F.col("count") / every, F.lit(1e-4)), F.lit(-power)))
    mean = F.sum(F.col("_f") * F.col("count")).over(W.partitionBy("scene")) / every
    n = n.select("scene", "band", F.least(F.greatest(F.col("_f") / F.greatest(mean, F.lit(1e-6)), F.lit(low)), F.lit(high)).alias("weight"))
    return beside(t, n, ["scene", "band"])


def gradients(px: DataFrame, error: Column, name: str, scales: int = 4) -> DataFrame:
    """(scene, name): mean over strides 1, 2, 4, ... of the absolute steps of ``error`` between valid neighbours, per valid pixel."""
    parts = None
    for k in range(scales):
        s = 1 << k
        t = px.filter((F.col("r") % s == 0) & (F.col("c") % s == 0)).withColumn("e", error)
        dx, dy = F.abs(F.lead("e").over(focal.rows_of()) - F.col("e")), F.abs(F.lead("e").over(focal.columns_of()) - F.col("e"))
        one = t.select("scene", "e", dx.alias("dx"), dy.alias("dy")).groupBy("scene")
        one = one.agg(((F.coalesce(F.sum("dx"), F.lit(0.0)) + F.coalesce(F.sum("dy"), F.lit(0.0))) / F.greatest(F.count("e"), F.lit(1))).alias("g"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("scene").agg((F.sum("g") / scales).alias(name))


def combined(px: DataFrame, centers: DataFrame, *, weights: dict[str, float] | None = None, h0: float = 2.0, h_max: float = 200.0, power: float = 0.5, bands: int = 16, least: int = 256, least_spread: float = 0.3) -> DataFrame:
    """A row per scene of ``px`` (scene, r, c, pred, ref, logits[, rel, seg, cls]): each part, and ``total``, their weighted sum.

    ``centers`` has each scene's bin centres (an array as long as ``logits``). Pixels without ref take part in
    nothing but classes. Heights and bins weigh by how rare a pixel's height is. Shape (``rel``) needs ``least`` pixels
    and a spread of ``least_spread``; classes (``seg`` scores of classes 0, 1, ...) ignore class
    0. A part that a scene can't have is null and adds nothing.
    """
    share = WEIGHTS | (weights or {})
    top = math.log1p(h_max / h0)
    t = beside(px, centers, "scene")
    k = F.size("logits")
    t = t.withColumn("u", F.when(F.col("ref").isNotNull(), log_height(F.col("ref"), h0))).withColumn("uc", F.transform("centers", lambda x: log_height(x, h0)))
    t = materialize(t, "losses")
    ok = band_weights(t.filter("ref is not null"), bands=bands, top=top, power=power)
    width = F.lit(top) / k
    target = F.transform("uc", lambda x: -((F.col("u") - x) ** 2) / (2 * width * width))
    near = F.array_min(F.transform("uc", lambda x: (F.col("u") - x) ** 2))
    total = F.greatest(F.sum("weight"), F.lit(1.0))
    out = ok.groupBy("scene").agg((F.sum(F.abs(F.col("pred") - F.col("ref")) * F.col("weight")) / total).alias("l1"), (F.sum(soft_cross_entropy(F.col("logits"), target) * F.col("weight")) / total).alias("ce"), F.avg(near).alias("_near"), F.count(F.lit(1)).alias("n"))
    far = ok.select("scene", "u", F.posexplode("uc").alias("k", "x")).groupBy("scene", "k").agg(F.min((F.col("u") - F.col("x")) ** 2).alias("d")).groupBy("scene").agg(F.avg("d").alias("_far"))
    out = out.join(far, "scene").withColumn("chamfer", F.when(F.col("n") >= 16, F.col("_near") + F.col("_far"))).drop("_near", "_far")
    out = out.join(gradients(t, F.col("pred") - F.col("ref"), "grad"), "scene")
    if "rel" in px.columns:
        q = quantiles(ok, ["scene"], mt=("ref", 0.5), mp=("rel", 0.5))
        s = beside(ok, q, "scene").groupBy("scene").agg(F.first("mt").alias("mt"), F.first("mp").alias("mp"), F.avg(F.abs(F.col("ref") - F.col("mt"))).alias("st"), F.greatest(F.avg(F.abs(F.col("rel") - F.col("mp"))), F.lit(1e-4)).alias("sp"), F.count(F.lit(1)).alias("_n"))
        s = s.filter((F.col("_n") >= least) & (F.col("st") >= least_spread))
        e = (F.col("rel") - F.col("mp")) / F.col("sp") - (F.col("ref") - F.col("mt")) / F.col("st")
        shaped = beside(t, s, "scene")
        out = out.join(shaped.groupBy("scene").agg(F.avg(F.abs(e)).alias("ssi")), "scene", "left").join(gradients(shaped, e, "ssi_grad"), "scene", "left")
    if "seg" in px.columns:
        own = log_sum_exp(F.col("seg")) - F.element_at("seg", F.col("cls") + 1)
        out = out.join(t.filter("cls > 0").groupBy("scene").agg(F.avg(own).alias("seg")), "scene", "left")
    names = [c for c in WEIGHTS if c in out.columns]
    return out.select("scene", "n", *names, sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(share[c]) for c in names), F.lit(0.0)).alias("total"))

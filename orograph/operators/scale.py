"""From relative depth to metres: calibrators, their agreement and their fusion.

Each calibrator gives a row (alpha, sigma, reason); a refusal is a row with a reason
and no alpha. Evidence rows of a scene are then compared and fused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside, materialize

#: The percentile that a known height refers to.
REFERENCE = {"tallest": 0.99, "tall": 0.95, "typical": 0.60}


def ground_level(px: DataFrame, bins: int = 256, sigma: float = 3.0) -> DataFrame:
    """Per scene: the first clear peak of the smoothed height histogram, or the 10th percentile where there is none."""
    q = quantiles(px, ["scene"], q=("z", 0.005, 0.995, 0.1))
    q = q.select("scene", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.col("q")[2].alias("p10"))
    t = beside(px, q, "scene").filter((F.col("z") >= F.col("lo")) & (F.col("z") <= F.col("hi")))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12))
    t = t.groupBy("scene", F.least(F.floor((F.col("z") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")).count()
    spine = q.select("scene", "lo", "hi", "p10", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    t = spine.join(t, ["scene", "bin"], "left").withColumn("n", F.coalesce("count", F.lit(0)).cast("double"))
    k = int(4 * sigma + 0.5)
    rows = t.groupBy("scene", "lo", "hi", "p10").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("n"))
    weights = [2.718281828459045 ** (-0.5 * (d / sigma) ** 2) for d in range(-k, k + 1)]
    total = sum(weights)

    def smooth(i):
        out = F.lit(0.0)
        for d, w in zip(range(-k, k + 1), weights, strict=True):
            j = i + d
            j = F.when(j < 0, -1 - j).when(j >= bins, 2 * bins - 1 - j).otherwise(j)
            out = out + F.lit(w / total) * F.element_at("n", (j + 1).cast("int"))
        return out

    rows = rows.withColumn("s", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), smooth))
    s = lambda i: F.element_at("s", (i + 1).cast("int"))
    peak = F.filter(F.sequence(F.lit(1), F.lit(bins - 2)), lambda i: (s(i) > s(i - 1)) & (s(i) >= s(i + 1)) & (s(i) > F.lit(0.2) * F.array_max("s")))
    first = F.element_at(peak, 1)
    return rows.select("scene", F.when(F.size(peak) > 0, F.col("lo") + (first + F.lit(0.5)) * (F.col("hi") - F.col("lo")) / bins).otherwise(F.col("p10")).alias("ground"))


def known_height(px: DataFrame, height: float, reference: str) -> DataFrame:
    """alpha from one known height: the median of the detail above the percentile that the reference names."""
    thr = quantiles(px, ["scene"], thr=("z", REFERENCE[reference]))
    top = quantiles(beside(px, thr, "scene").filter(F.col("z") >= F.col("thr")), ["scene"], top=("z", 0.5))
    return top.select("scene", (F.lit(height) / F.greatest("top", F.lit(1e-9))).alias("alpha"))


def from_points(px: DataFrame, points: DataFrame) -> DataFrame:
    """alpha and its relative error from control points (scene, r, c, h), through the ground level."""
    x = F.col("z") - F.col("ground")
    t = points.join(px.select("scene", "r", "c", "z"), ["scene", "r", "c"]).join(ground_level(px), "scene").withColumn("x", x).filter((F.abs("x") > 1e-9) & F.col("h").isNotNull())
    s = t.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("h")).alias("sxy"), F.sum(F.col("h") * F.col("h")).alias("syy"))
    a = F.col("sxy") / F.greatest("sxx", F.lit(1e-12))
    reason = F.when((F.col("n") < 2) | (F.col("sxx") < 1e-12), "too few control points").when(a <= 0, "control points imply a scale that is not positive")
    sse = F.greatest(F.col("syy") - 2 * a * F.col("sxy") + a * a * F.col("sxx"), F.lit(0.0))
    sigma = F.sqrt(sse / F.greatest(F.col("n") - 1, F.lit(1))) / F.sqrt(F.greatest("sxx", F.lit(1e-12))) / a
    return s.select("scene", "n", reason.alias("reason"), F.when(reason.isNull(), a).alias("alpha"), F.when(reason.isNull(), F.least(F.greatest(sigma, F.lit(0.05)), F.lit(2.0))).alias("sigma_rel"))


def learned(px: DataFrame, detail: str, metric: str) -> DataFrame:
    """Median of the ratios of high percentiles of metric heights and detail."""
    qs = (0.90, 0.95, 0.98, 0.99, 0.995)
    t = quantiles(px.filter(F.col(detail).isNotNull() & F.col(metric).isNotNull()), ["scene"], beside=[F.count(F.lit(1)).alias("n")], d=(detail, *qs), m=(metric, *qs))
    one = t.select("scene", "n", F.explode(F.arrays_zip("d", "m")).alias("p")).filter((F.col("p.d") > 1e-9) & (F.col("p.m") > 1.0) & (F.col("n") >= 100))
    return one.groupBy("scene").agg(F.count(F.lit(1)).alias("used"), F.percentile(F.col("p.m") / F.col("p.d"), F.lit(0.5)).alias("alpha"))


def built_prior(cells: DataFrame, by: list[str], *, pct: float = 0.95, min_height: float = 3.0) -> DataFrame:
    """Prior height of a region from coarse cells (h): p95 of built ones to one decimal, or why not."""
    built = F.col("h") >= min_height
    sums = [F.count("h").alias("n_cells"), F.count_if(built).alias("n_built"), F.avg(F.when(built, F.col("h"))).alias("built_mean"), F.max("h").alias("built_max")]
    t = quantiles(cells, by, beside=sums, p=(F.when(built, F.col("h")), pct))
    reason = F.when(F.col("n_cells") == 0, "no cells").when(F.col("n_built") == 0, "nothing built")
    return t.select(*by, "n_cells", "n_built", F.when(reason.isNull(), F.floor(F.col("p") * 10 + 0.5) / 10).alias("prior"), "built_mean", "built_max", reason.alias("reason"))


def cross_check(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Spread and agreement of the sources (by, source, alpha) and their median, from two sources on."""
    t = evidence.filter("alpha > 0").groupBy(*by).agg(F.count(F.lit(1)).alias("sources"), F.min("alpha").alias("lo"), F.max("alpha").alias("hi"), F.percentile("alpha", F.lit(0.5)).alias("mid"))
    two = F.col("sources") >= 2
    return t.select(*by, "sources", F.when(two, F.col("hi") / F.col("lo")).alias("spread"), F.when(two, 100.0 * F.col("lo") / F.col("hi")).alias("agreement_pct"), F.when(two, F.col("mid")).alias("alpha"))


def fuse(evidence: DataFrame, by: list[str], *, max_z: float = 3.0) -> DataFrame:
    """Inverse-variance mean of the logarithms of (by, source, alpha, sigma_rel), refused if two sources disagree beyond ``max_z``."""
    e = evidence.filter("alpha > 0").withColumn("s", F.greatest(F.coalesce("sigma_rel", F.lit(0.25)), F.lit(1e-3)))
    one = e.groupBy(*by).agg(F.count(F.lit(1)).alias("sources"), F.sum(F.log("alpha") / (F.col("s") * F.col("s"))).alias("wl"), F.sum(F.lit(1.0) / (F.col("s") * F.col("s"))).alias("w"), F.min_by("source", F.struct("s", "source")).alias("tightest"))
    a, b = e.alias("a"), e.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by] + [F.col("a.source") < F.col("b.source")]
    z = F.abs(F.log("a.alpha") - F.log("b.alpha")) / F.sqrt(F.col("a.s") ** 2 + F.col("b.s") ** 2)
    worst = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("a.source").alias("s1"), F.col("b.source").alias("s2"), z.alias("z"))
    worst = worst.groupBy(*by).agg(F.max(F.struct("z", "s1", "s2")).alias("m")).select(*by, F.col("m.z").alias("worst_z"), F.concat_ws("/", "m.s1", "m.s2").alias("worst_pair"))
    t = one.join(worst, by, "left")
    ok = (F.col("sources") >= 2) & (F.col("worst_z") <= max_z)
    return t.select(*by, "sources", "worst_z", "worst_pair", "tightest", F.when(ok, F.exp(F.col("wl") / F.col("w"))).alias("alpha"), F.when(ok, F.lit(1.0) / F.sqrt("w")).alias("sigma_rel"), F.when(F.col("sources") < 2, "one source").when(~ok, "sources disagree").alias("reason"))


def kfold_ratio(points: DataFrame, by: list[str], order: str, folds: int = 5) -> DataFrame:
    """Cross-validated ratio y / x: each fold's residuals under the others' median ratio, pooled."""
    t = points.withColumn("ratio", F.col("y") / F.col("x")).withColumn("fold", (F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1) % folds)
    train = t.select(*by, "ratio", "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")).filter("fold <> held")
    train = quantiles(train, [*by, "held"], a=("ratio", 0.5))
    e = t.join(train.withColumnRenamed("held", "fold"), [*by, "fold"]).withColumn("e", F.col("a") * F.col("x") - F.col("y"))
    means = [F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias")]
    out = materialize(quantiles(materialize(e, "held-out"), by, beside=means, p90_abs=(F.abs("e"), 0.9), q=("ratio", 0.25, 0.5, 0.75)), "held-out-errors")
    mad = quantiles(t.join(out.select(*by, F.col("q")[1].alias("mid")), by), by, mad=(F.abs(F.col("ratio") - F.col("mid")), 0.5))
    sigma = F.lit(1.253) * F.lit(1.4826) * F.col("mad") / F.greatest(F.abs(F.col("q")[1]), F.lit(1e-9)) / F.sqrt("n")
    return out.join(mad, by).filter("n >= 10").select(*by, "n", "rmse", "mae", "bias", "p90_abs", (F.col("q")[2] / F.greatest(F.col("q")[0], F.lit(1e-9))).alias("iqr_ratio"), F.least(F.greatest(sigma, F.lit(0.01)), F.lit(2.0)).alias("sigma_rel"))

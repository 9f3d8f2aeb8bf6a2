"""Per-pixel fusion of two height estimates with their uncertainties, and what can be said about a prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside

BANDS = (0.0, 2.0, 10.0, 30.0)


def band_weight(h: Column, weights: list[float]) -> Column:
    """The weight of the band that a height falls in: from 0, 2, 10 and 30 m up."""
    out = F.lit(weights[0])
    for lo, w in list(zip(BANDS, weights, strict=True))[1:]:
        out = F.when(h >= lo, F.lit(w)).otherwise(out)
    return out


def variance(sigma: Column, honesty: float, floor: float) -> Column:
    s = F.lit(honesty) * F.greatest(F.coalesce(sigma, F.lit(1e3)), F.lit(floor))
    return s * s


def inverse_variance(px: DataFrame, honesty: tuple[float, float], floor: float = 0.3) -> DataFrame:
    """Heights a_h, b_h with uncertainties a_sig, b_sig to (h, sigma), by inverse variance."""
    va, vb = variance(F.col("a_sig"), honesty[0], floor), variance(F.col("b_sig"), honesty[1], floor)
    wb = va / (va + vb)
    return px.withColumn("h", (1 - wb) * F.col("a_h") + wb * F.col("b_h")).withColumn("sigma", F.sqrt(va * vb / (va + vb)))


def stacked(px: DataFrame, weights: list[float], honesty: tuple[float, float], floor: float = 0.3) -> DataFrame:
    """The same with fixed weights of a by the band of b's height."""
    va, vb = variance(F.col("a_sig"), honesty[0], floor), variance(F.col("b_sig"), honesty[1], floor)
    wa = band_weight(F.col("b_h"), weights)
    return px.withColumn("h", wa * F.col("a_h") + (1 - wa) * F.col("b_h")).withColumn("sigma", F.sqrt(wa * wa * va + (1 - wa) * (1 - wa) * vb))


def calibrate(px: DataFrame, floor: float = 0.3) -> DataFrame:
    """Honesty of each estimate against the truth y, and each band's best weight of a, in one row per band."""
    honest = lambda h, s: (F.abs(F.col(h) - F.col("y")) / F.greatest(F.col(s), F.lit(floor)), 0.5)
    band = F.when(F.col("b_h") >= 30, 3).when(F.col("b_h") >= 10, 2).when(F.col("b_h") >= 2, 1).otherwise(0)
    d = F.col("b_h") - F.col("a_h")
    sums = [F.count(F.lit(1)).alias("n"), F.sum((F.col("b_h") - F.col("y")) * d).alias("num"), F.sum(d * d).alias("den")]
    t = quantiles(px.withColumn("band", band), ["band"], beside=sums, c_a=honest("a_h", "a_sig"), c_b=honest("b_h", "b_sig"))
    return t.select("band", "n", (F.col("c_a") / 0.6745).alias("c_a"), (F.col("c_b") / 0.6745).alias("c_b"), F.when(F.col("n") > 500, F.least(F.greatest(F.col("num") / F.greatest("den", F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))).alias("w_a"))


def ensemble(passes: DataFrame) -> DataFrame:
    """Mean and spread per pixel of several passes (pass, z), each standardised by its median and MAD and put on the first pass's scale."""
    mid = quantiles(passes, ["scene", "pass"], _m=("z", 0.5))
    t = beside(passes.select("scene", "r", "c", "pass", "z"), mid, ["scene", "pass"])
    mad = quantiles(t, ["scene", "pass"], _mad=(F.abs(F.col("z") - F.col("_m")), 0.5)).select("scene", "pass", (F.lit(1.4826) * F.col("_mad")).alias("_s"))
    first = mid.join(mad, ["scene", "pass"]).filter("pass = 0").select("scene", F.col("_m").alias("_m0"), F.col("_s").alias("_s0"))
    t = beside(t, mad.join(first, "scene"), ["scene", "pass"])
    return t.groupBy("scene", "r", "c").agg(*_mean_spread((F.col("z") - F.col("_m")) / F.greatest("_s", F.lit(1e-9)) * F.col("_s0") + F.col("_m0")))


def _mean_spread(z: Column):
    return F.avg(z).alias("mean"), F.stddev_pop(z).alias("spread")


def merged_uncertainty(passes: DataFrame) -> DataFrame:
    """Passes with own uncertainty (z, s) to a mean and the root of mean variance plus variance of means."""
    return passes.groupBy("scene", "r", "c").agg(F.avg("z").alias("mean"), F.sqrt(F.avg(F.col("s") * F.col("s")) + F.var_pop("z")).alias("sigma"))


def confidence(px: DataFrame) -> DataFrame:
    """Median and p90 of positive spreads, and the median as a share of the height range."""
    s = F.when(F.col("spread") > 0, F.col("spread"))
    q = quantiles(px, ["scene"], q=(s, 0.5, 0.9), h=("z", 0.01, 0.99))
    return q.select("scene", F.col("q")[0].alias("median_spread"), F.col("q")[1].alias("p90_spread"), (100.0 * F.col("q")[0] / F.greatest(F.col("h")[1] - F.col("h")[0], F.lit(1e-9))).alias("pct_of_range"))


def sanity(px: DataFrame, stride: int) -> DataFrame:
    """Whether a depth map is finite, varied and the right way up against luma (r < -0.3 means inverted)."""
    sample = F.when((F.col("r") * 64 + F.col("c")) % stride == 0, F.col("z"))
    luma = F.when(sample.isNotNull(), F.col("luma"))
    spread = F.stddev_pop(luma) * F.stddev_pop(sample)
    r = F.when(spread > 1e-12, F.covar_pop(luma, sample) / spread)
    return px.groupBy("scene").agg(F.avg(F.col("z").isNotNull().cast("double")).alias("finite"), (F.var_pop("z") < 1e-12).alias("flat"), r.alias("r"), (F.coalesce(r, F.lit(0.0)) < -0.3).alias("inverted"))


def informative(px: DataFrame) -> DataFrame:
    sd = F.stddev_pop("z")
    return px.groupBy("scene").agg(F.count("z").alias("n"), sd.alias("sd"), ((F.count("z") >= 100) & (sd > 1e-4) & (sd > 1e-3 * F.abs(F.avg("z")))).alias("informative"))


def ground_consistency(px: DataFrame, *, cells: int = 4, pct: float = 0.15, least: int = 50) -> DataFrame:
    """Unevenness of the ground: range of the cells' low percentiles over the scene's range."""
    dims = quantiles(px, ["scene"], beside=[(F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")], q=("z", 0.01, 0.99))
    t = beside(px, dims, "scene").withColumn("i", F.floor(F.col("r") * cells / F.col("h"))).withColumn("j", F.floor(F.col("c") * cells / F.col("w")))
    t = quantiles(t, ["scene", "i", "j"], beside=[F.count("z").alias("n"), F.max("q").alias("q")], p=("z", pct))
    return t.filter(F.col("n") > least).groupBy("scene").agg(F.count(F.lit(1)).alias("cells"), ((F.max("p") - F.min("p")) / F.greatest(F.max(F.col("q")[1]) - F.max(F.col("q")[0]), F.lit(1e-9))).alias("unevenness"))

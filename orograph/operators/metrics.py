"""Accuracy metrics of predicted against reference heights, by any strata.

Everything is a grouped aggregate; quantiles of large groups are found by ranks. The only second pass is the median absolute
deviation, which needs each group's median first; the medians (a row per stratum)
are joined back to the errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside, materialize

#: Height bands in metres.
BANDS = [(-1e9, 2.0), (2.0, 10.0), (10.0, 30.0), (30.0, 1e9)]
MAD = 1.4826


def height_band(h: Column) -> Column:
    """The number of the band of a height: below 2 m, to 10 m, to 30 m, above."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(BANDS))):
        out = F.when((h >= lo) & (h < hi), i).otherwise(out)
    return out


def finite_pairs(px: DataFrame) -> DataFrame:
    return px.filter(F.col("pred").isNotNull() & F.col("ref").isNotNull())


def metrics(px: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per stratum of (pred, ref): n, coverage, errors, robust spread, correlation, skill.

    Strata with fewer than 10 pairs have a note and no metrics.
    """
    by = by or []
    on = by or ["_all"]
    t = px.withColumn("_all", F.lit(1)) if not by else px
    e = F.col("pred") - F.col("ref")
    t = materialize(t.select(*on, "pred", "ref").withColumn("e", e), "errors")
    pair = F.col("e").isNotNull()
    sums = t.groupBy(*on).agg(
        F.count_if(pair).alias("n"), (F.lit(100.0) * F.count_if(pair) / F.count(F.lit(1))).alias("coverage_pct"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.stddev_pop("e").alias("std"), F.stddev_pop(F.when(pair, F.col("pred"))).alias("_sp"), F.stddev_pop(F.when(pair, F.col("ref"))).alias("_sr"),
        F.covar_pop(F.when(pair, F.col("pred")), F.when(pair, F.col("ref"))).alias("_c"), F.sum(F.col("e") * F.col("e")).alias("_sse"), F.var_pop(F.when(pair, F.col("ref"))).alias("_vr"),
    )
    off = F.abs("e")
    ranks = quantiles(t, on, medae=(off, 0.5), le90=(off, 0.9), _mid=("e", 0.5), _q=(F.when(pair, F.col("ref")), 0.01, 0.99))
    ranks = materialize(ranks, "quantiles")
    same = beside(t.filter(pair), ranks.select(*on, "_mid"), on)
    spread = quantiles(same, on, _mad=(F.abs(F.col("e") - F.col("_mid")), 0.5)).select(*on, (F.lit(MAD) * F.col("_mad")).alias("nmad"))
    out = sums.join(ranks, on).join(spread, on, "left")
    r = F.when((F.col("_sp") > 1e-9) & (F.col("_sr") > 1e-9), F.col("_c") / (F.col("_sp") * F.col("_sr")))
    wide = F.col("_q")[1] - F.col("_q")[0]
    cols = {
        "rmse": F.col("rmse"), "mae": F.col("mae"), "medae": F.col("medae"), "bias": F.col("bias"), "std": F.col("std"), "nmad": F.col("nmad"), "le90": F.col("le90"), "ref_range": wide, "r": r, "r2": r * r,
        "nash_sutcliffe": F.when(F.col("_sr") > 1e-9, F.lit(1.0) - F.col("_sse") / F.greatest(F.col("n") * F.col("_vr"), F.lit(1e-12))), "rmse_pct_of_range": F.lit(100.0) * F.col("rmse") / F.greatest(wide, F.lit(1e-9)),
    }
    enough = F.col("n") >= 10
    return out.select(*by, "n", "coverage_pct", *[F.when(enough, v).alias(k) for k, v in cols.items()], F.when(~enough, "too few valid pixels").alias("note"))


def shifted(px: DataFrame, by: list[str]) -> DataFrame:
    """``px`` with the median of ref - pred of its stratum added to pred."""
    off = quantiles(finite_pairs(px), by, offset=(F.col("ref") - F.col("pred"), 0.5))
    return beside(px, off, by, "left").withColumn("pred", F.col("pred") + F.col("offset"))


def alignments(px: DataFrame, by: list[str]) -> DataFrame:
    """RMSE raw and after a constant shift, and which is the headline: shift unless raw is better."""
    raw = finite_pairs(px).groupBy(*by).agg(F.sqrt(F.avg((F.col("pred") - F.col("ref")) ** 2)).alias("rmse_raw"))
    sh = finite_pairs(shifted(px, by)).groupBy(*by).agg(F.max("offset").alias("offset"), F.sqrt(F.avg((F.col("pred") - F.col("ref")) ** 2)).alias("rmse_shift"))
    return raw.join(sh, by).withColumn("headline", F.when(F.col("rmse_shift") <= F.col("rmse_raw"), "shift").otherwise("raw"))


def attenuation(px: DataFrame, by: list[str], *, materiality: float = 0.01, min_h: float = 2.0) -> DataFrame:
    """The gain that fits ref = gain * pred best, RMSE before and after, and whether it matters."""
    p, r = F.col("pred"), F.col("ref")
    tall = (p > min_h) & (r > min_h)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(p * r).alias("spr"), F.sum(p * p).alias("spp"), F.sum(r * r).alias("srr"), F.count_if(tall).alias("n_tall")]
    pairs = materialize(finite_pairs(px).select(*by, "pred", "ref"), "pairs")
    t = quantiles(pairs, by, beside=sums, p99p=(F.when(tall, p), 0.99), p99r=(F.when(tall, r), 0.99))
    t = t.withColumn("gain", F.col("spr") / F.greatest("spp", F.lit(1e-9)))
    rmse = lambda g: F.sqrt(F.greatest((g * g * F.col("spp") - 2.0 * g * F.col("spr") + F.col("srr")) / F.col("n"), F.lit(0.0)))
    t = t.withColumn("rmse_as_is", rmse(F.lit(1.0))).withColumn("rmse_at_gain", rmse(F.col("gain")))
    ok = F.col("n") >= 50
    return t.select(*by, "n", F.when(ok, F.col("gain")).alias("gain"), F.when(ok, F.col("rmse_as_is")).alias("rmse_as_is"), F.when(ok, F.col("rmse_at_gain")).alias("rmse_at_gain"),
                    F.when(ok, F.col("rmse_at_gain") < F.col("rmse_as_is") * (1 - materiality)).alias("improves"), F.when(ok & (F.col("n_tall") >= 50), F.col("p99r") / F.greatest("p99p", F.lit(1e-9))).alias("tall_ratio"))


def pooled(scores: DataFrame, by: list[str], others: list[str]) -> DataFrame:
    """Scenes pooled by their pixels: root mean square of rmse; other metrics by weight, nulls skipped without renormalising."""
    n = F.col("n")
    return scores.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scenes"), F.sqrt(F.sum(n * F.col("rmse") ** 2) / F.sum("n")).alias("rmse"), *[(F.sum(n * F.col(c)) / F.sum("n")).alias(c) for c in others])


def class_spread(scores: DataFrame, by: list[str], cls: str) -> DataFrame:
    """Best and worst class of each group by rmse, their difference and ratio."""
    key = F.struct("rmse", cls)
    t = scores.groupBy(*by).agg(F.min(key).alias("b"), F.max(key).alias("w"), F.count(F.lit(1)).alias("classes"))
    return t.select(*by, "classes", F.col(f"b.{cls}").alias("best"), F.col("b.rmse").alias("best_rmse"), F.col(f"w.{cls}").alias("worst"), F.col("w.rmse").alias("worst_rmse"), (F.col("w.rmse") - F.col("b.rmse")).alias("spread"), (F.col("w.rmse") / F.greatest("b.rmse", F.lit(1e-9))).alias("ratio"))


def loso_gain(px: DataFrame, pool: str, scene: str) -> DataFrame:
    """Leave one scene out: each scene's gain from the sums of the others of its pool; null under three scenes."""
    s = finite_pairs(px).groupBy(pool, scene).agg(F.sum(F.col("pred") * F.col("ref")).alias("sxy"), F.sum(F.col("pred") * F.col("pred")).alias("sxx"))
    w = W.partitionBy(pool)
    rest = lambda c: F.sum(c).over(w) - F.col(c)
    return s.select(pool, scene, F.when(F.count(F.lit(1)).over(w) >= 3, rest("sxy") / F.greatest(rest("sxx"), F.lit(1e-9))).alias("gain"))


def gain_vote(gains: DataFrame) -> DataFrame:
    """Median gain of the scenes that a gain improves; recommended if at least half of all scenes do."""
    n = F.count_if("improves")
    return gains.agg(F.count(F.lit(1)).alias("scenes"), n.alias("improving"), F.percentile(F.when(F.col("improves"), F.col("gain")), F.lit(0.5)).alias("gain"), (n >= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2))).alias("recommended"))


def class_scores(px: DataFrame, pred: str, ref: str) -> DataFrame:
    """Intersection over union of each class, from one aggregate of the pairs."""
    pairs = px.groupBy(F.col(pred).alias("p"), F.col(ref).alias("q")).count()
    one = pairs.select(F.explode(F.array_distinct(F.array("p", "q"))).alias("cls"), "p", "q", "count")
    inter = F.sum(F.when(F.col("p") == F.col("q"), F.col("count")).otherwise(0))
    return one.groupBy("cls").agg(inter.alias("intersection"), F.sum("count").alias("union"), (inter / F.sum("count")).alias("iou"))


def validation(px: DataFrame, by: list[str], *, tall: float = 10.0) -> DataFrame:
    """Scores of a model's heights and classes (pred, ref, cls_pred, cls) by group, each from one aggregate.

    n, rmse, mae, r over pixels with both heights; rmse_tall, bias_tall where ref is ``tall`` or more; miou:
    the mean over classes 1, 2, ... of intersection over union among pixels labelled so.
    """
    ok = finite_pairs(px).withColumn("e", F.col("pred") - F.col("ref"))
    high = F.when(F.col("ref") >= tall, F.col("e"))
    r = F.covar_pop("pred", "ref") / F.sqrt(F.greatest(F.var_pop("pred") * F.var_pop("ref"), F.lit(1e-12)))
    heights = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg(F.abs("e")).alias("mae"), r.alias("r"), F.sqrt(F.avg(high**2)).alias("rmse_tall"), F.avg(high).alias("bias_tall"))
    pairs = px.filter("cls >= 1").groupBy(*by, F.col("cls_pred").alias("p"), F.col("cls").alias("q")).count()
    one = pairs.select(*by, "p", "q", "count", F.explode(F.array_distinct(F.array("p", "q"))).alias("k")).filter("k >= 1")
    one = one.groupBy(*by, "k").agg((F.sum(F.when(F.col("p") == F.col("q"), F.col("count")).otherwise(0)) / F.sum("count")).alias("iou"))
    return heights.join(one.groupBy(*by).agg(F.avg("iou").alias("miou")), by, "left")

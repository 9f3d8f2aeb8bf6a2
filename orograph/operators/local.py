"""Local map algebra: each pixel by itself, given a few statistics of its scene.

Statistics (percentiles, extremes) are one aggregate row per scene, joined back;
everything else is column arithmetic inside one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside


def luma709(red: Column, green: Column, blue: Column) -> Column:
    return F.lit(0.2126) * red + F.lit(0.7152) * green + F.lit(0.0722) * blue


def luma601(red: Column, green: Column, blue: Column) -> Column:
    return F.lit(0.299) * red + F.lit(0.587) * green + F.lit(0.114) * blue


def saturation(red: Column, green: Column, blue: Column) -> Column:
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    return (top - low) / F.greatest(top.cast("double"), F.lit(1e-9))


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    return (F.lit(2.0) * green - red - blue) / (red + green + blue + F.lit(1e-6))


def with_scene(px: DataFrame, **stats: Column | tuple) -> DataFrame:
    """``px`` with aggregates of its scene as columns, quantiles as (column, p, ...); a row per scene is joined back."""
    plain = [v.alias(k) for k, v in stats.items() if not isinstance(v, tuple)]
    ranks = {k: v for k, v in stats.items() if isinstance(v, tuple)}
    for rows in ([px.groupBy("scene").agg(*plain)] if plain else []) + ([quantiles(px, ["scene"], **ranks)] if ranks else []):
        px = beside(px, rows, "scene")
    return px


def percentile(c: str | Column, *ps: float) -> tuple:
    """A quantile, or several, as ``with_scene`` and ``quantiles`` take it."""
    return (c, *ps)


def cloud_shadow_mask(px: DataFrame, *, reach: float = 2.5, max_sat: float = 0.15, max_bad: float = 0.35) -> DataFrame:
    """``valid``: neither bright and grey (cloud) nor dark (shadow); all valid if the scene is flat or more would go than ``max_bad``."""
    bands = [F.col(b) for b in ("red", "green", "blue")]
    t = px.withColumn("luma", luma709(*bands)).withColumn("sat", saturation(*bands))
    t = with_scene(t, q=percentile("luma", 0.25, 0.5, 0.75))
    iqr, mid = F.col("q")[2] - F.col("q")[0], F.col("q")[1]
    cloud = (F.col("luma") > mid + reach * iqr) & (F.col("sat") < max_sat)
    shadow = F.col("luma") < mid - reach * iqr
    t = t.withColumn("bad", (cloud | shadow) & (iqr >= 1e-9))
    t = with_scene(t, share=F.avg(F.col("bad").cast("double")))
    return t.withColumn("valid", ~F.col("bad") | (F.col("share") > max_bad)).drop("q", "bad", "share")


def needs_stretch(px: DataFrame, band: str) -> DataFrame:
    """Per scene: whether the middle 96 % of a band spans at least 1 but under 90 levels."""
    t = quantiles(px, ["scene"], q=(band, 0.02, 0.98))
    span = F.col("q")[1] - F.col("q")[0]
    return t.select("scene", span.alias("span"), F.when(span < 1, False).otherwise(span < 90).alias("needed"))


def stretch_per_band(px: DataFrame, *, lo: float = 0.02, hi: float = 0.98, least: int = 16) -> DataFrame:
    """Each band to 0..255 between its percentiles over valid pixels (over all, where fewer than ``least`` are valid)."""
    long = px.select("scene", "r", "c", "valid", F.explode(F.create_map(*[x for b in ("red", "green", "blue") for x in (F.lit(b), F.col(b).cast("double"))])).alias("band", "v"))
    by = ["scene", "band"]
    stats = long.groupBy(*by).agg(F.count_if("valid").alias("n")).join(quantiles(long, by, q=(F.when(F.col("valid"), F.col("v")), lo, hi), qa=("v", lo, hi)), by)
    stats = stats.withColumn("q", F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("qa")))
    a, b = F.col("q")[0], F.col("q")[1]
    x = F.least(F.greatest((F.col("v") - a) / F.greatest(b - a, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    return beside(long, stats, by).groupBy("scene", "r", "c").pivot("band", ["red", "green", "blue"]).agg(F.first(F.floor(x * 255.0).cast("int")))


def otsu(px: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """Per scene: the level of 0..bins-1 that splits the histogram with most variance between the sides."""
    hist = px.groupBy("scene", F.col(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    run = W.partitionBy("scene").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("scene")
    m = F.col("n") * F.col("bin")
    t = hist.select("scene", "bin", F.sum("n").over(run).alias("w0"), F.sum(m).over(run).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(m).over(every).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    t = t.withColumn("between", F.floor(F.col("w0") * w1 * gap * gap / F.col("w")))
    return t.filter("between is not null").groupBy("scene").agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold"))


def quantise16(px: DataFrame) -> DataFrame:
    """Heights to 0..65535 of the scene's range, cut off."""
    t = with_scene(px, lo=F.min("z"), hi=F.max("z"))
    return t.withColumn("q", F.floor((F.col("z") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 65535.0).cast("int")).drop("lo", "hi")


def surfaces(px: DataFrame, alpha: float) -> DataFrame:
    """From terrain and detail: height, height above ground and ground, which add up."""
    h = F.col("terrain") + F.lit(alpha) * F.col("detail")
    nd = F.greatest(h - F.col("terrain"), F.lit(0.0))
    return px.withColumns({"height": h, "ndsm": nd, "dtm": h - nd})


def clip_below_ground(px: DataFrame) -> DataFrame:
    """Heights below zero set to zero, with the scene's share of such pixels."""
    t = with_scene(px, below=F.avg((F.col("z") < 0).cast("double")))
    return t.withColumn("z", F.greatest("z", F.lit(0.0)))


def ndsm_from(dsm: Column, dtm: Column) -> Column:
    """Height above ground: 0 on water (both missing), nothing below -1.5 m, else within 0..400 m."""
    h = dsm - dtm
    return F.when(dsm.isNull() & dtm.isNull(), F.lit(0.0)).when(h < -1.5, F.lit(None)).otherwise(F.least(F.greatest(h, F.lit(0.0)), F.lit(400.0)))


def fill_median(px: DataFrame) -> DataFrame:
    t = with_scene(px, mid=percentile("z", 0.5))
    return t.withColumn("z", F.coalesce("z", "mid", F.lit(0.0))).drop("mid")


def log_height(h: Column) -> Column:
    return F.log1p(F.greatest(h, F.lit(0.0)) / 2.0)


def snap(z: Column, step: float) -> Column:
    """To multiples of a step, halves to even."""
    return F.rint(z / step) * step


def colour(z: Column, lo: Column, hi: Column, stops: list[str], missing: str = "#9a9aa3") -> Column:
    """A struct of red, green, blue on a ramp of hex colours, linear between neighbours."""
    parts = {b: F.array(*[F.lit(float(int(s[1 + 2 * i : 3 + 2 * i], 16))) for s in stops]) for i, b in enumerate(("red", "green", "blue"))}
    t = F.least(F.greatest((z - lo) / F.greatest(hi - lo, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    i = F.least(F.floor(t), F.lit(len(stops) - 2))
    at = lambda a, k: F.element_at(a, (i + k).cast("int"))
    out = {b: F.floor(F.least(F.greatest(at(a, 1) + (at(a, 2) - at(a, 1)) * (t - i), F.lit(0.0)), F.lit(255.0))).cast("int") for b, a in parts.items()}
    none = {b: int(missing[1 + 2 * k : 3 + 2 * k], 16) for k, b in enumerate(out)}
    return F.struct(*[F.when(z.isNull(), none[b]).otherwise(v).alias(b) for b, v in out.items()])


def layer_ranges(px: DataFrame) -> DataFrame:
    """Display range of each scene's height layer (p1 to p99) and slope layer (0 to its p99 within 10..60 degrees)."""
    t = quantiles(px, ["scene"], height_min=("z", 0.01), height_max=("z", 0.99), slope_max=("slope", 0.99))
    return t.select("scene", "height_min", "height_max", F.lit(0.0).alias("slope_min"), F.least(F.greatest("slope_max", F.lit(10.0)), F.lit(60.0)).alias("slope_max"))


def normalised(column: str) -> Column:
    """A column of ``with_scene`` data to 0..1 between two of the scene's quantiles, held in the array q, cut off."""
    a, b = F.col("q")[0], F.col("q")[1]
    return F.when(F.col(column).isNotNull(), F.least(F.greatest((F.col(column) - a) / F.greatest(b - a, F.lit(1e-9)), F.lit(0.0)), F.lit(1.0)))

"""Column functions of parsing, geometry and reporting: small rules that other operators and queries share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.tables import beside


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a position."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def pixel_metres(a: Column, mid_lat: Column, projected: Column) -> Column:
    """Pixel size in metres: as it is for projected grids, by the length of a degree at the latitude otherwise."""
    return F.when(projected, F.abs(a)).otherwise(F.abs(a) * F.lit(111320.0) * F.cos(F.radians(mid_lat)))


def ground_points(text: Column) -> Column:
    """Control points (r, c, h) from "r,c,h;r,c,h"; incomplete ones are dropped."""
    parts = F.transform(F.split(text, ";"), lambda p: F.split(F.trim(p), ","))
    full = F.filter(parts, lambda p: (F.size(p) == 3) & p[0].try_cast("int").isNotNull() & p[1].try_cast("int").isNotNull() & p[2].try_cast("double").isNotNull())
    return F.transform(full, lambda p: F.struct(p[0].try_cast("int").alias("r"), p[1].try_cast("int").alias("c"), p[2].try_cast("double").alias("h")))


def mix_share(text: Column, key: str) -> Column:
    """A share from "a=.6,b=.4"."""
    return F.try_element_at(F.str_to_map(text, F.lit(","), F.lit("=")), F.lit(key)).try_cast("double")


def pick_format(formats: Column) -> Column:
    """PNG before TIFF before JPEG before whatever comes first."""
    first = lambda p: F.try_element_at(F.filter(formats, lambda x: x.rlike(f"(?i){p}")), F.lit(1))
    return F.coalesce(first("png"), first("tiff?"), first("jpe?g"), F.try_element_at(formats, F.lit(1)))


def datum(mode: Column, has_dem: Column) -> Column:
    return F.when(mode == "relative", "relative").when(has_dem, "sea level").otherwise("local ground")


def engine(asked: Column, has_model: Column) -> Column:
    """The engine that runs: aliases resolved, "auto" by what is there; null where one that is missing is asked for."""
    name = F.lower(F.trim(asked))
    name = F.when(name.isin("fast", "a"), "zeroshot").when(name.isin("learned", "b"), "metric").otherwise(name)
    return F.when(name == "auto", F.when(has_model, "hybrid").otherwise("zeroshot")).when(name.isin("metric", "hybrid") & ~has_model, F.lit(None)).otherwise(name)


def reject_reason(blank: Column, valid: Column, water: Column) -> Column:
    """The first rule that a tile breaks, or null."""
    return F.when(blank > 0.15, "blank").when(valid < 0.8, "too few valid pixels").when(water > 0.5, "water")


def normalised(v: Column, mean: float, std: float) -> Column:
    return (v / 255.0 - mean) / std


def bands(order: Column, names: Column, nir: Column) -> Column:
    """Which three bands show red, green and blue: declared colours, else named ones, else a false colour of near infrared, else the first three."""
    return F.when(order.isNotNull(), "declared").when(names.isNotNull(), "named").when(nir, "false colour").otherwise("first three")


def true_slope(apparent_deg: Column, exaggeration: Column) -> Column:
    return F.degrees(F.atan(F.tan(F.radians(apparent_deg)) / F.greatest(exaggeration, F.lit(1e-9))))


def measured(dx: Column, dy: Column, dh: Column) -> dict[str, Column]:
    """Ground distance and grade between two pins."""
    ground = F.hypot(dx, dy)
    return {"ground": ground, "grade_deg": F.degrees(F.atan2(dh, F.greatest(ground, F.lit(1e-9))))}


def tick_step(lo: Column, hi: Column, n: int) -> Column:
    """A round step (1, 2, 2.5 or 5 times a power of ten) for about ``n`` ticks."""
    raw = F.greatest((hi - lo) / n, F.lit(1e-9))
    p = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / p
    return p * F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 2.5, 2.5).when(m <= 5, 5.0).otherwise(10.0)


def cosine_rate(step: Column, warm: int, total: int, low: float) -> Column:
    """Learning rate factor: linear warm-up, then a cosine down to ``low``."""
    t = F.least(F.greatest((step - warm) / F.lit(float(total - warm)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warm, (step + 1) / F.lit(float(warm))).otherwise(F.lit(low) + F.lit(1 - low) * F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * t)))


def smoothed(t: DataFrame, by: list[str], order: str, value: str, keep: float) -> DataFrame:
    """Exponential moving average of a group in its order, whole: values so old that their weight is under 2 ** -70 change no double."""
    most = max(1, math.ceil(-70 * math.log(2) / math.log(keep)))
    w = W.partitionBy(*by).orderBy(order)
    xs = F.collect_list(value).over(w.rowsBetween(-most, 0))
    return t.withColumn("ema", F.aggregate(F.slice(xs, 2, most), xs[0], lambda acc, x: acc * keep + x * (1 - keep)))


def rotated(px: DataFrame, k: int) -> DataFrame:
    """The scene turned by ``k`` quarter turns, by index arithmetic."""
    d = px.groupBy("scene").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    t = beside(px, d, "scene")
    r, c, h, w = F.col("r"), F.col("c"), F.col("_h"), F.col("_w")
    to = [(r, c), (w - 1 - c, r), (h - 1 - r, w - 1 - c), (c, h - 1 - r)][k % 4]
    return t.withColumns({"r": to[0], "c": to[1]}).drop("_h", "_w")


def equalised(px: DataFrame, tile: int, clip: float, bins: int = 64) -> DataFrame:
    """Contrast-limited equalisation of v (0..1) by tiles: each tile's clipped histogram as a running share, blended between tile centres.

    The tables (tiles x bins rows) join pixels four times on (tile, bin): equi-joins of a bounded side.
    """
    b = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int")
    t = px.withColumn("bin", b).withColumn("tr", F.floor(F.col("r") / tile).cast("int")).withColumn("tc", F.floor(F.col("c") / tile).cast("int"))
    n = t.groupBy("scene", "tr", "tc", "bin").count()
    size = n.groupBy("scene", "tr", "tc").agg(F.sum("count").alias("size"))
    spine = size.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = spine.join(n, ["scene", "tr", "tc", "bin"], "left").withColumn("n", F.coalesce("count", F.lit(0)).cast("double"))
    limit = F.lit(clip) * F.col("size") / bins
    every = W.partitionBy("scene", "tr", "tc")
    over = F.sum(F.greatest(F.col("n") - limit, F.lit(0.0))).over(every) / bins
    n = n.withColumn("m", F.least(F.col("n"), limit) + over)
    lut = n.withColumn("share", F.sum("m").over(every.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.col("size")).select("scene", "tr", "tc", "bin", "share")
    last = size.groupBy("scene").agg(F.max("tr").alias("_tr"), F.max("tc").alias("_tc"))
    t = beside(t, last, "scene")
    at = lambda i, top: F.least(F.greatest((F.col(i) - (tile - 1) / 2) / tile, F.lit(0.0)), F.col(top).cast("double"))
    t = t.withColumn("_y", at("r", "_tr")).withColumn("_x", at("c", "_tc"))
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = t.select("scene", "r", "c", "bin", "_y", "_x", "_tr", "_tc", k.alias("k"))
    y0, x0 = F.floor("_y"), F.floor("_x")
    wy, wx = F.when(F.col("k.i") == 1, F.col("_y") - y0).otherwise(1 - (F.col("_y") - y0)), F.when(F.col("k.j") == 1, F.col("_x") - x0).otherwise(1 - (F.col("_x") - x0))
    t = t.withColumn("tr", F.least(y0 + F.col("k.i"), F.col("_tr")).cast("int")).withColumn("tc", F.least(x0 + F.col("k.j"), F.col("_tc")).cast("int")).withColumn("w", wy * wx)
    return t.join(lut, ["scene", "tr", "tc", "bin"]).groupBy("scene", "r", "c").agg(F.sum(F.col("w") * F.col("share")).alias("v"))


def cropped(px: DataFrame, picks: DataFrame, size: int) -> DataFrame:
    """(scene, r, c, z, level): a square of ``size`` pixels of each scene, turned and mirrored as ``picks`` (scene, y, x, turns, mirror) say.

    The square starts at (y, x), is turned by quarter turns against the clock and then mirrored left to right. Beyond the
    scene's far edges ``level`` repeats in mirror image without the edge itself, z is null.
    """
    d = px.groupBy("scene").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    t = picks.join(d, "scene").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    n, i = size - 1, F.col("_r")
    j = F.when(F.col("mirror"), n - F.col("_c")).otherwise(F.col("_c"))
    k = F.col("turns") % 4
    t = t.withColumn("_i", F.when(k == 0, i).when(k == 1, j).when(k == 2, n - i).otherwise(n - j) + F.col("y"))
    t = t.withColumn("_j", F.when(k == 0, j).when(k == 1, n - i).when(k == 2, n - j).otherwise(i) + F.col("x"))

    def folded(at: str, size: str):
        m = F.greatest(2 * (F.col(size) - 1), F.lit(1))
        return F.least(F.col(at) % m, m - F.col(at) % m).cast("int")

    t = t.withColumn("r", F.least(folded("_i", "_h"), F.col("_h") - 1)).withColumn("c", F.least(folded("_j", "_w"), F.col("_w") - 1))
    t = t.join(px.select("scene", "r", "c", "z", "level"), ["scene", "r", "c"])
    inside = (F.col("_i") < F.col("_h")) & (F.col("_j") < F.col("_w"))
    return t.select("scene", F.col("_r").alias("r"), F.col("_c").alias("c"), F.when(inside, F.col("z")).alias("z"), "level")

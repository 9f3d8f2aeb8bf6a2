"""Conditioning of images before they are read: what to mask and whether to stretch is decided per scene from its own pixels.

Decisions are a row per scene, joined back to its pixels; scenes that need nothing pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside, materialize
from orograph.operators import local, scalars

BANDS = ["red", "green", "blue"]


def decisions(px: DataFrame, *, reach: float = 2.5, max_sat: float = 0.15, max_bad: float = 0.35, narrow: float = 90.0) -> DataFrame:
    """A row per scene of ``px`` (scene, r, c, red, green, blue[, deep]): what its masks hold, and whether it is stretched and why.

    Cloud is bright and grey, shadow dark, by ``reach`` interquartile ranges of luminance; pixels without a
    band are masked. Where more than ``max_bad`` of the scene would go, nothing does. A scene that is ``deep``
    (more than 8 bits) is stretched, another where the middle 96 % of all its bands span 1
    to ``narrow`` levels.
    """
    t = px.withColumn("deep", F.coalesce("deep", F.lit(False)) if "deep" in px.columns else F.lit(False))
    bands = [F.col(b).cast("double") for b in BANDS]
    t = t.select("scene", "deep", local.luma709(*bands).alias("luma"), local.saturation(*bands).alias("sat"), *BANDS)
    t = materialize(t, "bands")
    q = quantiles(t, ["scene"], q=("luma", 0.25, 0.5, 0.75))
    level = t.select("scene", F.explode(F.array(*bands)).alias("v"))
    span = quantiles(level, ["scene"], s=("v", 0.02, 0.98))
    t = beside(t, q, "scene")
    iqr, mid = F.col("q")[2] - F.col("q")[0], F.col("q")[1]
    uneven = iqr >= 1e-9
    cloud = uneven & (F.col("luma") > mid + reach * iqr) & (F.col("sat") < max_sat)
    shadow = uneven & (F.col("luma") < mid - reach * iqr)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    one = t.groupBy("scene").agg(F.max("deep").alias("deep"), F.first(mid + reach * iqr).alias("bright"), F.first(mid - reach * iqr).alias("dark"), F.first(uneven).alias("uneven"), share(cloud).alias("cloud"), share(shadow).alias("shadow"), share(cloud | shadow | F.col("luma").isNull()).alias("masked"))
    t = one.join(span, "scene").withColumn("span", F.col("s")[1] - F.col("s")[0]).drop("s")
    why = F.when(F.col("deep"), "more than 8 bits").when((F.col("span") >= 1) & (F.col("span") < narrow), F.concat(F.lit("only "), F.floor(F.col("span") + 0.5).cast("string"), F.lit(" levels of range")))
    return materialize(t.withColumn("rejected", F.col("masked") > max_bad).withColumn("stretch", why), "conditioning")


def conditioned(px: DataFrame, *, contrast: bool = False, decided: DataFrame | None = None, max_sat: float = 0.15, **how) -> DataFrame:
    """(scene, r, c, red, green, blue, valid): masked, stretched where the scene needs it, in 0..255.

    With ``contrast`` the luminance of what comes out is equalised by tiles (eight across the longest
    side of a 512-pixel scene), colours scaled along. Missing bands become 0.
    """
    d = decided if decided is not None else decisions(px, max_sat=max_sat, **how)
    t = beside(px, d.select("scene", "bright", "dark", "uneven", "rejected", "stretch"), "scene")
    bands = [F.col(b).cast("double") for b in BANDS]
    luma = local.luma709(*bands)
    bad = luma.isNull() | (F.col("uneven") & (((luma > F.col("bright")) & (local.saturation(*bands) < max_sat)) | (luma < F.col("dark"))))
    t = t.withColumn("valid", F.col("rejected") | ~bad)
    todo, rest = t.filter("stretch is not null"), t.filter("stretch is null")
    done = local.stretch_per_band(todo.select("scene", "r", "c", "valid", *BANDS)).join(todo.select("scene", "r", "c", "valid"), ["scene", "r", "c"])
    level = lambda b: F.least(F.greatest(F.col(b), F.lit(0)), F.lit(255)).cast("int")
    out = done.select("scene", "r", "c", *BANDS, "valid").unionByName(rest.select("scene", "r", "c", *[level(b).alias(b) for b in BANDS], "valid"))
    out = out.select("scene", "r", "c", *[F.coalesce(b, F.lit(0)).alias(b) for b in BANDS], "valid")
    return contrasted(out) if contrast else out


def contrasted(px: DataFrame, *, tile: int = 64, clip: float = 2.0) -> DataFrame:
    """Luminance equalised by tiles, the bands scaled by what it changes."""
    luma = local.luma601(*[F.col(b).cast("double") for b in BANDS])
    t = materialize(px.withColumn("v", luma / 255.0), "luminance")
    new = scalars.equalised(t.select("scene", "r", "c", "v"), tile, clip, 256).withColumnRenamed("v", "_v")
    gain = F.col("_v") / F.greatest("v", F.lit(1 / 255))
    scaled: list[Column] = [F.least(F.floor(F.col(b) * gain + 0.5), F.lit(255)).cast("int").alias(b) for b in BANDS]
    return t.join(new, ["scene", "r", "c"]).select("scene", "r", "c", *scaled, *[c for c in px.columns if c not in {"scene", "r", "c", *BANDS}])


def summary(decided: DataFrame) -> DataFrame:
    """One line per scene about what was done to it, null where nothing was."""
    pct = lambda c: F.concat(F.floor(F.col(c) * 1000 + 0.5).cast("int").cast("string"), F.lit("/1000"))
    parts = [
        F.concat(F.lit("stretched ("), "stretch", F.lit(")")),
        F.when(F.col("masked") > 0.001, F.concat(F.lit("masked "), pct("masked"), F.lit(" (cloud "), pct("cloud"), F.lit(", shadow "), pct("shadow"), F.lit(")"))),
        F.when(F.col("rejected"), "too much to mask, all is valid"),
    ]
    return decided.select("scene", F.nullif(F.concat_ws(" | ", *parts), F.lit("")).alias("line"))

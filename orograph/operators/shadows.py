"""Scale from shadows: each shadow is traced back along the sun's direction to the roof that casts it.

A shadow is a connected region of dark pixels, cut into rays along the sun's azimuth. Its
median ray is the shadow's length, which with the sun's elevation gives a height in
metres; the roof is looked for a few steps from the rays' near ends towards the sun. The
ratio of both is one estimate of the scale. What can't be used is counted by its reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import materialize
from orograph.operators import resample, scale, zonal

#: Metres from the end of a shadow at which its roof is looked for.
PROBES_M = (1.0, 2.0, 4.0, 7.0, 11.0)
REASONS = ["speck", "truncated", "thin", "length", "no_roof", "flat"]


def regions8(px: DataFrame) -> DataFrame:
    """(scene, r, c, label): 8-connected components; the label is the smallest pixel number of the region."""
    t = materialize(zonal.components(px), "regions")
    step = F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(1).alias("j")), F.struct(F.lit(1).alias("i"), F.lit(-1).alias("j"))))
    near = t.select("scene", F.col("label").alias("a"), "r", "c", step.alias("k"))
    near = near.select("scene", "a", (F.col("r") + F.col("k.i")).alias("r"), (F.col("c") + F.col("k.j")).alias("c"))
    pairs = near.join(t.withColumnRenamed("label", "b"), ["scene", "r", "c"]).filter("a <> b").select("scene", "a", "b").distinct()
    return t.join(zonal.joined(pairs), ["scene", "label"], "left").select("scene", "r", "c", F.coalesce("group", "label").alias("label"))


def pairs(px: DataFrame, sun: DataFrame, ground: DataFrame | None = None, *, pixel: float = 1.0, least_px: int = 6, ray_px: int = 3, least_rays: int = 3, reach: tuple[float, float] = (1.0, 300.0), least_h: float = 1.5) -> DataFrame:
    """(scene, label, outcome, length, roof, h) of each shadow of ``px`` (scene, r, c, dark, detail).

    ``sun`` has azimuth and elevation in degrees of each scene, ``ground`` the detail at
    ground level (else it is found by ``ground_level``). ``outcome`` is "pair" where
    ``roof`` (detail above ground) and ``h`` (metres) are one, or the first reason why not: too few
    pixels, cut by the scene's border, too few rays, a length out of ``reach``, no lit
    pixel with detail at any probe, or no roof above ground. Scenes without a sun have no shadows.
    """
    dims = resample.dims_of(px)
    ground = scale.ground_level(px.select("scene", "r", "c", F.col("detail").alias("z"))) if ground is None else ground
    s, c = F.sin(F.radians("azimuth")), F.cos(F.radians("azimuth"))
    t = regions8(px.filter("dark")).join(sun, "scene").join(dims, "scene")
    t = t.withColumn("along", F.col("r") * c - F.col("c") * s).withColumn("ray", F.rint(-F.col("c") * c - F.col("r") * s))
    border = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("h") - 1) | (F.col("c") == F.col("w") - 1)
    ray = t.groupBy("scene", "label", "ray").agg(F.count(F.lit(1)).alias("n"), F.max(border.cast("int")).alias("cut"), (F.max("along") - F.min("along") + 1).alias("run"), F.min(F.struct("along", "r", "c")).alias("end"))
    ray = materialize(ray, "shadow-rays")
    whole = ray.groupBy("scene", "label").agg(F.sum("n").alias("n"), F.max("cut").alias("cut"), F.count_if(F.col("n") >= ray_px).alias("rays"))
    good = ray.filter(F.col("n") >= ray_px)
    length = quantiles(good, ["scene", "label"], length=("run", 0.5)).withColumn("length", F.col("length") * F.lit(float(pixel)))
    whole = whole.join(length, ["scene", "label"], "left").join(sun.select("scene", "elevation"), "scene").join(ground, "scene")
    early = F.when(F.col("n") < least_px, "speck").when(F.col("cut") == 1, "truncated").when(F.col("rays") < least_rays, "thin").when(~F.col("length").between(*reach), "length")
    whole = materialize(whole.withColumn("early", early), "shadows")
    steps = sorted({max(1, round(m / max(pixel, 1e-6))) for m in PROBES_M})
    probe = good.join(whole.filter("early is null").select("scene", "label"), ["scene", "label"]).join(sun, "scene").join(dims, "scene")
    probe = probe.withColumn("d", F.explode(F.array(*[F.lit(d) for d in steps])))
    inside = lambda v, n: F.least(F.greatest(F.rint(v).cast("int"), F.lit(0)), F.col(n) - 1)
    probe = probe.select("scene", "label", "d", inside(F.col("end.r") - c * F.col("d"), "h").alias("r"), inside(F.col("end.c") + s * F.col("d"), "w").alias("c"))
    lit = probe.join(px.filter("not dark and detail is not null").select("scene", "r", "c", "detail"), ["scene", "r", "c"])
    roof = quantiles(lit, ["scene", "label", "d"], v=("detail", 0.5)).groupBy("scene", "label").agg(F.max("v").alias("top"))
    t = whole.join(roof, ["scene", "label"], "left").withColumn("roof", F.col("top") - F.col("ground")).withColumn("h", F.col("length") * F.tan(F.radians("elevation")))
    late = F.when(F.col("top").isNull(), "no_roof").when(~((F.col("roof") > 1e-6) & (F.col("h") > least_h)), "flat").otherwise("pair")
    t = t.withColumn("outcome", F.coalesce("early", late))
    return t.select("scene", "label", "outcome", "length", *[F.when(F.col("outcome") == "pair", F.col(k)).alias(k) for k in ("roof", "h")])


def scale_from(found: DataFrame, sun: DataFrame, *, least: int = 8) -> DataFrame:
    """A scene's scale from its shadows (``pairs``): alpha, its relative error, pairs, and shadows rejected by reason.

    alpha is the median ratio of ``least`` pairs or more; its error is that of the
    cross-validated ratio, widened by the sun's (``sigma`` in degrees, where ``sun`` has it).
    """
    counts = found.groupBy("scene").pivot("outcome", ["pair", *REASONS]).count().na.fill(0)
    ok = found.filter("outcome = 'pair'").select("scene", "label", F.col("roof").alias("x"), F.col("h").alias("y"))
    alpha = quantiles(ok.withColumn("ratio", F.col("y") / F.col("x")), ["scene"], alpha=("ratio", 0.5))
    held = scale.kfold_ratio(ok, ["scene"], "label").select("scene", "rmse", "bias", "sigma_rel")
    t = sun.join(counts, "scene", "left").join(alpha, "scene", "left").join(held, "scene", "left")
    enough = F.coalesce("pair", F.lit(0)) >= least
    e = F.radians("elevation")
    own = F.radians("sigma") / F.greatest(F.abs(F.sin(e) * F.cos(e)), F.lit(1e-6)) if "sigma" in sun.columns else F.lit(0.0)
    sigma = F.least(F.greatest(F.hypot(F.coalesce("sigma_rel", F.lit(0.1)), own), F.lit(0.01)), F.lit(2.0))
    cols = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ["pair", *REASONS]]
    return t.select("scene", *cols, *[F.when(enough, v).alias(k) for k, v in {"alpha": F.col("alpha"), "sigma_rel": sigma, "rmse": F.col("rmse"), "bias": F.col("bias")}.items()], F.when(~enough, "too few shadow pairs").alias("reason"))

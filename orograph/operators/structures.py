"""Buildings and terrain as whole structures: envelopes, footprints, shadows, outlines; losses between surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside, materialize
from orograph.operators import focal, resample


def ground_envelope(px: DataFrame, f: int, k: int, pct: float) -> DataFrame:
    """A ground surface under all objects: block means, a low rank in k x k cells, its maximum, smoothed, and brought back to the grid.

    Cells keep their corners: pixel i lies at i (n_cells - 1) / (n - 1).
    """
    cells = resample.block_reduce(px, f, F.avg("z"))
    low = focal.percentile_filter(cells, k, pct)
    top = focal.moving(low, F.max, "rank", k // 2, k // 2, "top")
    smooth = focal.gaussian(top, k / 4, "top", "z")
    small = resample.dims_of(smooth).select("scene", F.col("h").alias("sh"), F.col("w").alias("sw"))
    at = beside(px.select("scene", "r", "c"), resample.dims_of(px).join(small, "scene"), "scene")
    scale = lambda i, a, b: F.col(i) * ((F.col(a) - 1) / F.greatest(F.col(b) - 1, F.lit(1)))
    at = at.select("scene", F.col("r").alias("pr"), F.col("c").alias("pc"), scale("r", "sh", "h").alias("y"), scale("c", "sw", "w").alias("x"))
    out = resample.bilinear(smooth, at, resample.dims_of(smooth))
    return out.select("scene", F.col("pr").alias("r"), F.col("pc").alias("c"), F.col("z").alias("ground"))


def ground_surface(px: DataFrame, k: int, sigma: float) -> DataFrame:
    """Morphological ground: opening, median of max(3, k // 8), smoothing; never over the surface itself."""
    t = focal.opening(px, k)
    m = max(3, k // 8)
    t = focal.tiled(t, ["opened"], m // 2, lambda a: {"opened": focal.ranked(a, m, m * m // 2)}, ["opened"])
    low = focal.gaussian(t, sigma, "opened", "ground")
    return px.join(low, ["scene", "r", "c"]).withColumn("ground", F.least("ground", "z"))


def refine_gate(px: DataFrame, sigma: float, least: float = 0.98) -> DataFrame:
    """Crispness before and after sharpening, and whether the sharpened surface is taken."""
    t = materialize(focal.sharpen(px, sigma).select("scene", "r", "c", "z", "sharp"), "sharpened")
    before = focal.crispness(focal.slope_deg(t, 1.0)).withColumnRenamed("crispness", "before")
    after = focal.crispness(focal.slope_deg(t, 1.0, "sharp")).withColumnRenamed("crispness", "after")
    gain = F.col("after") / F.greatest("before", F.lit(1e-12))
    return before.join(after, "scene").withColumn("gain", gain).withColumn("accepted", gain >= least)


def shadow_lengths(px: DataFrame, azimuth: float, *, least_px: int = 3, least_rays: int = 3) -> DataFrame:
    """Length of each shadow (label): median run along the sun's direction over its rays of ``least_px`` pixels or more."""
    s, c = F.sin(F.radians(F.lit(azimuth))), F.cos(F.radians(F.lit(azimuth)))
    along, across = F.col("c") * -s + F.col("r") * c, -F.col("c") * c - F.col("r") * s
    rays = px.groupBy("scene", "label", F.rint(across).alias("ray")).agg(F.count(F.lit(1)).alias("n"), (F.max(along) - F.min(along) + 1).alias("run"))
    rays = quantiles(rays.filter(F.col("n") >= least_px), ["scene", "label"], beside=[F.count(F.lit(1)).alias("rays")], length=("run", 0.5))
    return rays.filter(F.col("rays") >= least_rays)


def footprints(px: DataFrame, *, least_px: int, least_h: float, most: int = 2000) -> DataFrame:
    """Regions as buildings, the largest of each scene: area, p75 height, box, share of vegetation; too small, low or green ones go."""
    mid = quantiles(px, ["scene"], _v=("veg", 0.5))
    box = [F.count(F.lit(1)).alias("area"), F.avg("veg").alias("veg"), F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right")]
    t = quantiles(px, ["scene", "label"], beside=box, height=("z", 0.75))
    t = t.join(mid, "scene").filter((F.col("area") >= least_px) & (F.col("height") >= least_h) & (F.col("veg") <= F.col("_v") + 0.3)).drop("_v")
    place = F.row_number().over(W.partitionBy("scene").orderBy(F.col("area").desc(), "label"))
    return t.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def overlap_fits(tiled: DataFrame) -> DataFrame:
    """For tiles (scene, r0, c0, r, c, z) side by side: gain and offset that bring each onto its left neighbour, taken only if 0.1 < gain < 5."""
    w = W.partitionBy("scene", "r0", "r", "c").orderBy("c0")
    t = tiled.withColumn("left", F.lag("z").over(w)).withColumn("left_c0", F.lag("c0").over(w)).filter("left is not null")
    t = t.groupBy("scene", "r0", "left_c0", "c0").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("left", "z").alias("gain"), F.regr_intercept("left", "z").alias("offset"))
    return t.filter(F.col("n") > 50).withColumn("accepted", (F.col("gain") > 0.1) & (F.col("gain") < 5))


def gradient_loss(px: DataFrame, scales: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Mean absolute gradient of pred - ref on grids of ever wider stride."""
    out = None
    for s in scales:
        t = px.filter((F.col("r") % s == 0) & (F.col("c") % s == 0)).withColumn("e", F.col("pred") - F.col("ref"))
        dx, dy = F.lead("e").over(focal.rows_of()) - F.col("e"), F.lead("e").over(focal.columns_of()) - F.col("e")
        one = t.select("scene", dx.alias("dx"), dy.alias("dy")).groupBy("scene").agg(F.lit(s).alias("stride"), F.avg(F.abs("dx")).alias("x"), F.avg(F.abs("dy")).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def scale_free_loss(px: DataFrame) -> DataFrame:
    """Mean absolute difference after both surfaces are freed of median and mean deviation."""
    t = px.filter("pred is not null and ref is not null")
    m = quantiles(t, ["scene"], mp=("pred", 0.5), mr=("ref", 0.5))
    t = beside(t, m, "scene")
    d = t.groupBy("scene").agg(F.greatest(F.avg(F.abs(F.col("pred") - F.col("mp"))), F.lit(1e-6)).alias("dp"), F.greatest(F.avg(F.abs(F.col("ref") - F.col("mr"))), F.lit(1e-6)).alias("dr"))
    return beside(t, d, "scene").groupBy("scene").agg(F.avg(F.abs((F.col("pred") - F.col("mp")) / F.col("dp") - (F.col("ref") - F.col("mr")) / F.col("dr"))).alias("loss"))


def chamfer(px: DataFrame, centers: list[float]) -> DataFrame:
    """Mean distance of heights to their nearest bin centre and of centres to their nearest height; the centres are a literal of the plan."""
    c = F.array(*[F.lit(x) for x in centers])
    near = F.array_min(F.transform(c, lambda x: F.abs(x - F.col("z"))))
    per = [F.min(F.abs(F.col("z") - F.lit(x))).alias(f"_{i}") for i, x in enumerate(centers)]
    t = px.filter("z is not null").groupBy("scene").agg(F.avg(near).alias("to_centers"), *per)
    return t.select("scene", "to_centers", (sum(F.col(f"_{i}") for i in range(len(centers))) / len(centers)).alias("to_heights"))


def plain_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def doubled_area(a: tuple, b: tuple, c: tuple) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


def halved(ring: list[tuple[float, float]], part: list[int]) -> tuple[list[int], list[int]] | None:
    """Two parts of a counter-clockwise part, along a diagonal from its lowest corner or across it; None where there is none."""
    n = len(part)
    k = min(range(n), key=lambda i: ring[part[i]][::-1])
    part = part[k:] + part[:k]
    # the lowest corner is convex: a diagonal leads to the corner deepest within it, or joins its neighbours
    low, after, before = (ring[part[i]] for i in (0, 1, -1))
    if doubled_area(before, low, after) <= 0:
        return None
    within = [i for i in range(2, n - 1) if doubled_area(low, after, ring[part[i]]) >= 0 and doubled_area(after, before, ring[part[i]]) >= 0 and doubled_area(before, low, ring[part[i]]) >= 0]
    if not within:
        return part[1:], [part[-1], part[0], part[1]]
    deep = max(within, key=lambda i: doubled_area(after, before, ring[part[i]]))
    return part[: deep + 1], [part[0], *part[deep:]]


def triangulated(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles (vertex numbers) of a simple polygon, by cutting parts in two along diagonals.

    Corners that repeat the one before are left out. A ring of under three corners, or one
    with a part that has no diagonal (no area, or sides that cross), has no triangles.
    """
    whole = [i for i, p in enumerate(ring) if p != ring[i - 1]] if len(ring) > 1 else []
    if plain_area([ring[i] for i in whole]) < 0:
        whole.reverse()
    out, todo = [], [whole] if len(whole) > 2 else []
    while todo:
        part = todo.pop()
        if len(part) == 3:
            if doubled_area(*(ring[i] for i in part)) > 0:
                out.append(tuple(part))
            continue
        cut = halved(ring, part)
        if cut is None:
            return []
        todo += cut
    return out


def triangles(polygons: DataFrame) -> DataFrame:
    """(id, a, b, c) of polygons (id, ring); a polygon is a record, so this is a map over batches of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, *t) for i, ring in zip(pdf["id"], pdf["ring"], strict=True) for t in triangulated([(p["x"], p["y"]) for p in ring])]
            yield pd.DataFrame(rows, columns=["id", "a", "b", "c"])

    return polygons.select("id", "ring").mapInPandas(run, "id string, a int, b int, c int")


def extruded_walls(polygons: DataFrame, top: Column, base: Column) -> DataFrame:
    """A quad per polygon edge with the running length before it, for textures in metres."""
    n = F.size("ring")
    t = polygons.withColumn("top", top).withColumn("base", base).select("id", "ring", "top", "base", F.posexplode("ring").alias("i", "p"))
    q = F.element_at("ring", ((F.col("i") + 1) % n + 1).cast("int"))
    t = t.select("id", "i", "top", "base", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))
    t = t.withColumn("edge", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    w = W.partitionBy("id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return t.filter(F.col("top") - F.col("base") >= 2).withColumn("u", F.coalesce(F.sum("edge").over(w), F.lit(0.0)))

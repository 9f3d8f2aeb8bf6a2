"""Regions of pixels: components, their statistics, planes and neighbours; polygons and meshes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside, materialize


def components(px: DataFrame) -> DataFrame:
    """(scene, r, c, label) of the pixels of ``px``, 4-connected; the label is the smallest pixel number of the component.

    Labels spread along whole runs of a row, then of a column, at a time, and then
    through the pixel that a label names, until none moves. Each round is written.
    """
    n = px.groupBy("scene").agg((F.max("c") + 1).cast("long").alias("_w"))
    t = beside(px.select("scene", "r", "c"), n, "scene").withColumn("id", F.col("r") * F.col("_w") + F.col("c")).drop("_w")

    def runs(along: str, across: str, name: str):
        w = W.partitionBy("scene", across).orderBy(along)
        return (F.col(along) - F.row_number().over(w)).alias(name)

    t = materialize(t.select("*", runs("c", "r", "hr"), runs("r", "c", "vr"), F.col("id").alias("label")), "runs")
    before = None
    while True:
        t2 = t.withColumn("label", F.min("label").over(W.partitionBy("scene", "r", "hr")))
        t2 = t2.withColumn("label", F.min("label").over(W.partitionBy("scene", "c", "vr")))
        t = materialize(t2, "labels")
        now = t.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return t.select("scene", "r", "c", "label")
        before = now
        named = t.select("scene", F.col("id").alias("label"), F.col("label").alias("_to"))
        t = t.join(named, ["scene", "label"]).withColumn("label", F.least("label", "_to")).drop("_to").select("scene", "r", "c", "id", "hr", "vr", "label")


def distance(px: DataFrame, radius: int = 3) -> DataFrame:
    """``px`` (scene, r, c, inside) with ``distance``, exact and Euclidean, of each inside pixel to the nearest one outside; 0 outside, null where the scene has none."""
    n = px.groupBy("scene").agg((F.max("c") + 1).cast("long").alias("_w"))
    at = (F.col("r") * F.col("_w") + F.col("c")).cast("double")
    t = beside(px, n, "scene").withColumn("z", F.when(~F.col("inside"), at))
    t = nearest_fill(t, radius)
    near_r, near_c = F.floor(F.col("z") / F.col("_w")), F.pmod(F.col("z"), F.col("_w").cast("double"))
    return t.withColumn("distance", F.sqrt((F.col("r") - near_r) ** 2 + (F.col("c") - near_c) ** 2)).drop("z", "_w")


def structure_width(px: DataFrame, *, least_px: int = 40, share: float = 0.9, pixel: float = 1.0) -> DataFrame:
    """Per scene the area-weighted quantile of structure widths: twice a component's largest distance to the outside, of components of ``least_px`` pixels and more."""
    inside = px.filter("inside")
    t = components(inside).join(distance(px).select("scene", "r", "c", "distance"), ["scene", "r", "c"])
    t = t.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("area"), (F.lit(2.0 * pixel) * F.max("distance")).alias("width"))
    return weighted_quantile(t.filter(F.col("area") >= least_px), "width", "area", share)


def planes(px: DataFrame, *, least: int = 30, keep: int = 20, strength: float = 0.8) -> DataFrame:
    """Flatten regions (label, r, c, z) towards a robust plane: fitted, refitted without residuals over 2.5 deviations, blended in; small regions towards their median."""
    by = ["scene", "label"]

    def fit(t: DataFrame) -> DataFrame:
        x, y, z = F.col("c").cast("double") - F.col("_cx"), F.col("r").cast("double") - F.col("_cy"), F.col("z")
        s = t.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(k) for k, v in {"sx": x, "sy": y, "sz": z, "xx": x * x, "yy": y * y, "xy": x * y, "xz": x * z, "yz": y * z}.items()])
        n = F.col("_n").cast("double")
        # normal equations about the group's means
        cxx, cyy, cxy = F.col("xx") - F.col("sx") ** 2 / n, F.col("yy") - F.col("sy") ** 2 / n, F.col("xy") - F.col("sx") * F.col("sy") / n
        cxz, cyz = F.col("xz") - F.col("sx") * F.col("sz") / n, F.col("yz") - F.col("sy") * F.col("sz") / n
        d = cxx * cyy - cxy * cxy
        ok = d > 1e-9
        p, q = F.when(ok, (cxz * cyy - cyz * cxy) / d).otherwise(F.lit(0.0)), F.when(ok, (cyz * cxx - cxz * cxy) / d).otherwise(F.lit(0.0))
        return s.select(*by, "_n", p.alias("_p"), q.alias("_q"), (F.col("sz") / n - p * F.col("sx") / n - q * F.col("sy") / n).alias("_o"))

    centre = quantiles(px, by, beside=[F.avg(F.col("c").cast("double")).alias("_cx"), F.avg(F.col("r").cast("double")).alias("_cy"), F.count(F.lit(1)).alias("_size")], _med=("z", 0.5))
    t = beside(px, centre, by)
    at = F.col("_p") * (F.col("c") - F.col("_cx")) + F.col("_q") * (F.col("r") - F.col("_cy")) + F.col("_o")
    one = beside(t, fit(t), by).withColumn("_fit", at).withColumn("_res", F.col("z") - F.col("_fit"))
    one = materialize(one, "residuals")
    one = beside(one, quantiles(one, by, _m=("_res", 0.5)), by)
    mad = quantiles(one, by, _mad=(F.abs(F.col("_res") - F.col("_m")), 0.5)).select(*by, (F.lit(1.4826) * F.col("_mad") + F.lit(1e-6)).alias("_s"))
    kept = beside(one, mad, by).filter(F.abs("_res") < F.lit(2.5) * F.col("_s")).select(*by, "r", "c", "z", "_cx", "_cy")
    again = fit(kept).select(*by, F.col("_n").alias("_n2"), F.col("_p").alias("_p2"), F.col("_q").alias("_q2"), F.col("_o").alias("_o2"))
    t = beside(one, again, by, "left")
    second = F.col("_p2") * (F.col("c") - F.col("_cx")) + F.col("_q2") * (F.col("r") - F.col("_cy")) + F.col("_o2")
    target = F.when(F.col("_size") < least, F.col("_med")).when(F.col("_n2") >= keep, second).otherwise(F.col("_fit"))
    return t.select(*by, "r", "c", ((1 - strength) * F.col("z") + F.lit(strength) * target).alias("z"))


def touching(px: DataFrame) -> DataFrame:
    """Distinct pairs (scene, a, b) of different labels whose pixels are neighbours."""
    out = None
    for part, order in (("r", "c"), ("c", "r")):
        w = W.partitionBy("scene", part).orderBy(order)
        t = px.select("scene", "label", F.lead("label").over(w).alias("other"), (F.lead(order).over(w) - F.col(order)).alias("step"))
        t = t.filter((F.col("step") == 1) & (F.col("label") != F.col("other"))).select("scene", F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b"))
        out = t if out is None else out.unionByName(t)
    return out.distinct()


def merge_candidates(px: DataFrame, tolerance: float, pct: float = 0.75) -> DataFrame:
    """Touching regions whose roof heights (a percentile) differ by at most ``tolerance``."""
    h = quantiles(px, ["scene", "label"], h=("z", pct))
    t = touching(px).join(h.select("scene", F.col("label").alias("a"), F.col("h").alias("ha")), ["scene", "a"]).join(h.select("scene", F.col("label").alias("b"), F.col("h").alias("hb")), ["scene", "b"])
    return t.withColumn("gap", F.abs(F.col("ha") - F.col("hb"))).filter(F.col("gap") <= tolerance).select("scene", "a", "b", "gap")


def joined(pairs: DataFrame) -> DataFrame:
    """(scene, label, group) of the labels in ``pairs`` (scene, a, b): group is the smallest label that pairs reach.

    Labels take the smallest group of their neighbours, then the group of the label
    that it names, until none moves; each round is written.
    """
    both = pairs.select("scene", F.col("a").alias("label"), F.col("b").alias("other")).unionByName(pairs.select("scene", F.col("b").alias("label"), F.col("a").alias("other")))
    both = materialize(both.distinct(), "pairs")
    t, before = materialize(both.select("scene", "label", F.col("label").alias("group")).distinct(), "groups"), None
    while True:
        near = both.join(t.select("scene", F.col("label").alias("other"), "group"), ["scene", "other"]).groupBy("scene", "label").agg(F.min("group").alias("_g"))
        t = t.join(near, ["scene", "label"]).select("scene", "label", F.least("group", "_g").alias("group"))
        named = t.select("scene", F.col("label").alias("group"), F.col("group").alias("_to"))
        t = materialize(t.join(named, ["scene", "group"]).select("scene", "label", F.least("group", "_to").alias("group")), "groups")
        now = t.agg(F.sum(F.col("group").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return t
        before = now


def merged(px: DataFrame, tolerance: float, pct: float = 0.75) -> DataFrame:
    """Regions (scene, label, region): those that touch at like roof heights become one, numbered densely from 1."""
    to = joined(merge_candidates(px, tolerance, pct).select("scene", "a", "b"))
    t = px.select("scene", "label").distinct().join(to, ["scene", "label"], "left").withColumn("group", F.coalesce("group", "label"))
    return t.select("scene", "label", F.dense_rank().over(W.partitionBy("scene").orderBy("group")).alias("region"))


def weighted_quantile(regions: DataFrame, value: str, weight: str, share: float) -> DataFrame:
    """Smallest value up to which at least ``share`` of the weight lies."""
    w = W.partitionBy("scene").orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    t = regions.withColumn("_s", F.sum(weight).over(w) / F.sum(weight).over(W.partitionBy("scene")))
    return t.filter(F.col("_s") >= share).groupBy("scene").agg(F.min(value).alias(value))


def shoelace(ring: Column) -> Column:
    """Signed area of a ring of (x, y) structs."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n + 1).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"]) / 2.0


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring: odd number of edges crossed to the right."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n + 1).cast("int"))

    def crosses(i):
        a, b = at(i), at(i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def walls(px: DataFrame, step: float) -> DataFrame:
    """Vertical faces of the stepped surface: neighbours whose snapped heights differ by over half a step."""
    t = px.withColumn("z", F.rint(F.col("z") / step) * step)
    out = None
    for axis, w in (("right", W.partitionBy("scene", "r").orderBy("c")), ("below", W.partitionBy("scene", "c").orderBy("r"))):
        one = t.select("scene", "r", "c", F.lit(axis).alias("side"), "z", F.lead("z").over(w).alias("other")).filter(F.abs(F.col("other") - F.col("z")) > step / 2)
        out = one if out is None else out.unionByName(one)
    return out.select("scene", "r", "c", "side", F.least("z", "other").alias("bottom"), F.greatest("z", "other").alias("top"))


def faces(px: DataFrame, width: str = "w") -> DataFrame:
    """Two triangles of vertex numbers for each cell of a smooth mesh of (scene, r, c, h, w)."""
    v = F.col("r") * F.col(width) + F.col("c")
    t = px.filter((F.col("r") < F.col("h") - 1) & (F.col("c") < F.col(width) - 1))
    w = F.col(width)
    tri = F.explode(F.array(F.struct(v.alias("a"), (v + w).alias("b"), (v + 1).alias("c2")), F.struct((v + 1).alias("a"), (v + w).alias("b"), (v + w + 1).alias("c2"))))
    return t.select("scene", tri.alias("t")).select("scene", "t.a", "t.b", F.col("t.c2").alias("c"))


def nearest_fill(px: DataFrame, radius: int) -> DataFrame:
    """Holes filled from the nearest valid pixel, however far; ties to the smaller row, then column.

    Each hole looks up the offsets of the disc of ``radius`` by an equi-join, so only
    pixels near a hole travel; holes that this leaves open go through ``farther``.
    """
    disc = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d2")) for i, j in disc]))
    every = px.filter("z is null").select("scene", "r", "c")
    holes = every.select("scene", F.col("r").alias("hr"), F.col("c").alias("hc")).withColumn("k", k)
    holes = holes.select("scene", "hr", "hc", (F.col("hr") + F.col("k.i")).alias("r"), (F.col("hc") + F.col("k.j")).alias("c"), F.col("k.d2").alias("d2"))
    valid = px.filter("z is not null").select("scene", "r", "c", "z")
    hit = holes.join(valid, ["scene", "r", "c"])
    best = hit.groupBy("scene", F.col("hr").alias("r"), F.col("hc").alias("c")).agg(F.min_by("z", F.struct("d2", F.col("r"), F.col("c"))).alias("_f"))
    best = materialize(best, "filled")
    rest = materialize(every.join(best, ["scene", "r", "c"], "left_anti"), "open-holes")
    if rest.limit(1).count():
        best = best.unionByName(farther(rest, valid))
    return px.join(best, ["scene", "r", "c"], "left").withColumn("z", F.coalesce("z", "_f")).drop("_f")


#: Rows that are looked up together.
BAND = 64


def farther(holes: DataFrame, valid: DataFrame) -> DataFrame:
    """(scene, r, c, _f) of ``holes``: z of the nearest pixel of ``valid``, if the scene has any.

    Along each row with a valid pixel the nearest one to every column with a hole,
    then along each of these columns the nearest of those. A hole's own row says how far
    it is at most, and so which rows a column needs, in bands of ``BAND`` rows.
    """
    own = valid.select("scene", "r", "c", F.col("c").alias("at")).join(holes.select("scene", "r").distinct(), ["scene", "r"], "left_semi")
    own = own.unionByName(holes.select("scene", "r", "c", F.lit(None).cast(own.schema["at"].dataType).alias("at")))
    o = W.partitionBy("scene", "r").orderBy("c")
    most = F.least(F.col("c") - F.last("at", ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, 0)), F.first("at", ignorenulls=True).over(o.rowsBetween(0, W.unboundedFollowing)) - F.col("c"))
    height = valid.groupBy("scene").agg(F.max("r").alias("_h"))
    need = own.withColumn("_d", most).filter("at is null")
    need = beside(need, height, "scene").withColumn("_d", F.coalesce("_d", F.greatest("_h", "r")))
    band = lambda x: F.floor(x / BAND)
    need = need.select("scene", "c", F.explode(F.sequence(band(F.greatest(F.col("r") - F.col("_d"), F.lit(0))), band(F.least(F.col("r") + F.col("_d"), F.col("_h") + BAND)))).alias("_b")).distinct()
    grid = valid.select("scene", "r").distinct().withColumn("_b", band(F.col("r"))).join(need, ["scene", "_b"]).select("scene", "r", "c")
    v = F.struct("c", F.col("z").cast("double").alias("z"))
    t = valid.select("scene", "r", "c", v.alias("v"), F.lit(False).alias("probe"))
    t = t.unionByName(grid.select("scene", "r", "c", F.lit(None).cast(t.schema["v"].dataType).alias("v"), F.lit(True).alias("probe")))
    w = W.partitionBy("scene", "r").orderBy("c")
    left = F.last("v", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    right = F.first("v", ignorenulls=True).over(w.rangeBetween(W.currentRow, W.unboundedFollowing))
    t = t.withColumn("a", left).withColumn("b", right).filter("probe")
    far_a, far_b = F.col("c") - F.col("a.c"), F.col("b.c") - F.col("c")
    near_a = F.col("b").isNull() | (far_a <= far_b)
    t = t.select("scene", "r", "c", F.when(near_a, far_a).otherwise(far_b).cast("long").alias("g"), F.when(near_a, F.col("a.z")).otherwise(F.col("b.z")).alias("f"))
    t = t.unionByName(holes.select("scene", "r", "c", F.lit(None).cast("long").alias("g"), F.lit(None).cast("double").alias("f")))

    def column(group: pa.Table) -> pa.Table:
        group = group.sort_by("r")
        hole = pc.is_null(group.column("g")).to_numpy()
        out, source = group.filter(pa.array(hole)), group.filter(pa.array(~hole))
        at, r = out.column("r").to_numpy().astype(np.int64), source.column("r").to_numpy().astype(np.int64)
        g, f = source.column("g").to_numpy(), source.column("f").to_numpy()
        best, pick = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), -1)
        # the k-th source above (at the hole's row, too), then the k-th below, until none can be nearer
        for step, first in ((-1, np.searchsorted(r, at, "right") - 1), (1, np.searchsorted(r, at, "right"))):
            i, x = np.arange(len(at)), first
            while True:
                ok = (x >= 0) & (x < len(r))
                i, x = i[ok], x[ok]
                across = (r[x] - at[i]) ** 2
                ok = across <= best[i]
                i, x, across = i[ok], x[ok], across[ok]
                if not len(i):
                    break
                d2 = across + g[x] ** 2
                up = (d2 < best[i]) | ((d2 == best[i]) & (r[x] < r[pick[i]]))
                best[i[up]], pick[i[up]] = d2[up], x[up]
                x = x + step
        value = pa.array(f[pick] if len(r) else np.full(len(at), np.nan), pa.float64(), mask=pick < 0)
        return pa.table({"scene": out.column("scene"), "r": out.column("r"), "c": out.column("c"), "_f": value})

    kinds = ", ".join(f"{k} {holes.schema[k].dataType.simpleString()}" for k in ("scene", "r", "c"))
    return t.groupBy("scene", "c").applyInArrow(column, f"{kinds}, _f double")

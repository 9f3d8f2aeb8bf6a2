"""Focal map algebra: each pixel with its neighbourhood.

Minima, maxima and slopes are exact with frames cut at the border, so they are two
window passes, by row and by column. Everything else needs a padded border or a
whole two-dimensional neighbourhood: ``tiled`` deals pixels to square tiles with a
halo, once, and runs an array kernel on each tile; a task holds one tile, whatever
the size of a scene, and a chain of kernels costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import at_ranks, quantiles
from orograph.functions.tables import beside, materialize

TILE = 256
#: Values of neighbourhoods that a task copies at once (64 MB).
WINDOWED = 1 << 23


def rows_of(scene: str = "scene"):
    return W.partitionBy(scene, "r").orderBy("c")


def columns_of(scene: str = "scene"):
    return W.partitionBy(scene, "c").orderBy("r")


def moving(px: DataFrame, agg: Callable[[Column], Column], column: str, before: int, after: int, out: str | None = None) -> DataFrame:
    """A separable aggregate (min or max) over ``before`` .. ``after`` neighbours in both directions."""
    out = out or column
    t = px.withColumn(out, agg(F.col(column)).over(rows_of().rowsBetween(-before, after)))
    return t.withColumn(out, agg(F.col(out)).over(columns_of().rowsBetween(-before, after)))


def opening(px: DataFrame, k: int, column: str = "z", out: str = "opened") -> DataFrame:
    """Grey opening with a k x k footprint; for even k the dilation mirrors the erosion's."""
    a, b = k // 2, k - 1 - k // 2
    return moving(moving(px, F.min, column, a, b, out), F.max, out, b, a)


def slope_deg(px: DataFrame, size: float, column: str = "z", out: str = "slope") -> DataFrame:
    """Steepest slope in degrees: central differences inside, one-sided at the border."""

    def gradient(w):
        left, right = F.lag(column).over(w), F.lead(column).over(w)
        here = F.col(column)
        first, last = F.lag("r").over(w).isNull(), F.lead("r").over(w).isNull()
        return F.when(first, right - here).when(last, here - left).otherwise((right - left) / 2.0) / F.lit(size)

    t = px.withColumn("_gx", gradient(rows_of())).withColumn("_gy", gradient(columns_of()))
    return t.withColumn(out, F.degrees(F.atan(F.hypot("_gx", "_gy")))).drop("_gx", "_gy")


def binary(px: DataFrame, grow: bool, column: str, out: str) -> DataFrame:
    """3 x 3 dilation or erosion of a 0/1 column; outside the scene counts as 0."""
    agg = F.max if grow else F.min
    t = px
    for k, w in enumerate((rows_of(), columns_of())):
        src = F.col(column if k == 0 else out)
        v = agg(src).over(w.rowsBetween(-1, 1))
        if not grow:
            v = F.when(F.lag("r").over(w).isNull() | F.lead("r").over(w).isNull(), 0).otherwise(v)
        t = t.withColumn(out, v)
    return t


def binary_open_close(px: DataFrame, column: str) -> DataFrame:
    t = binary(binary(px, False, column, "opened"), True, "opened", "opened")
    return binary(binary(t, True, "opened", "closed"), False, "closed", "closed")


def tiled(px: DataFrame, values: list[str], halo: int, kernel: Callable[..., dict[str, np.ndarray]], out: list[str], *, pad: str = "symmetric", tile: int = TILE) -> DataFrame:
    """Run ``kernel`` on tiles of ``tile`` pixels with ``halo`` more on every side.

    The kernel gets one array per value column (missing pixels are NaN; beyond the
    scene's border the array is padded: "symmetric" repeats the edge in mirror image,
    "edge" repeats it) and returns arrays of the same shape, of which the inner part
    is kept. Returns (scene, r, c, *out) for every pixel of the input.
    """
    dims = px.groupBy("scene").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    t = beside(px.select("scene", "r", "c", *values), dims, "scene")
    span = lambda x, n: F.sequence(F.greatest(F.floor((F.col(x) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(x) + halo) / tile), F.floor((F.col(n) - 1) / tile)))
    t = t.withColumn("_tr", F.explode(span("r", "_h"))).withColumn("_tc", F.explode(span("c", "_w")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, tr, tc = key
        h, w = int(pdf["_h"].iloc[0]), int(pdf["_w"].iloc[0])
        r0, c0 = tr * tile, tc * tile
        top, left = max(r0 - halo, 0), max(c0 - halo, 0)
        bottom, right = min(r0 + tile + halo, h), min(c0 + tile + halo, w)
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        arrays = []
        for v in values:
            a = np.full((bottom - top, right - left), np.nan)
            a[r - top, c - left] = pdf[v].to_numpy(dtype=float)
            edge = ((halo if top == 0 else 0, halo if bottom == h else 0), (halo if left == 0 else 0, halo if right == w else 0))
            arrays.append(np.pad(a, edge, mode=pad))
        got = kernel(*arrays)
        dr, dc = (halo if top == 0 else 0) - top, (halo if left == 0 else 0) - left
        own = (r >= r0) & (r < r0 + tile) & (c >= c0) & (c < c0 + tile)
        r, c = r[own], c[own]
        return pd.DataFrame({"scene": pdf["scene"].to_numpy()[own], "r": r, "c": c} | {k: got[k][r + dr, c + dc] for k in out})

    done = t.groupBy("scene", "_tr", "_tc").applyInPandas(run, f"scene string, r int, c int, {', '.join(f'{k} double' for k in out)}")
    return done.select("scene", "r", "c", *[F.when(~F.isnan(k), F.col(k)).alias(k) for k in out])


def gauss_weights(sigma: float) -> np.ndarray:
    k = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    return w / w.sum()


def correlate(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Separable weighted sums; the outer ``len(w) // 2`` pixels are not to be used."""
    for axis in (0, 1):
        out = np.zeros_like(a)
        for i, x in enumerate(w):
            out += x * np.roll(a, len(w) // 2 - i, axis)
        a = out
    return a


def gauss(a: np.ndarray, sigma: float) -> np.ndarray:
    return correlate(a, gauss_weights(sigma))


def box(a: np.ndarray, radius: int) -> np.ndarray:
    return correlate(a, np.full(2 * radius + 1, 1 / (2 * radius + 1)))


def ranked(a: np.ndarray, k: int, index: int) -> np.ndarray:
    """The element of a rank among each k x k neighbourhood."""
    half = k // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(a, ((half, k - 1 - half),) * 2, mode="edge"), (k, k))
    out, rows = np.empty_like(a), max(1, WINDOWED // (a.shape[1] * k * k))
    for s in range(0, len(a), rows):
        some = view[s : s + rows]
        out[s : s + rows] = np.partition(some.reshape(*some.shape[:2], k * k), index, axis=-1)[..., index]
    return out


def gaussian(px: DataFrame, sigma: float, column: str = "z", out: str = "low") -> DataFrame:
    return tiled(px, [column], int(4 * sigma + 0.5), lambda a: {out: gauss(a, sigma)}, [out])


def box_mean(px: DataFrame, radius: int, column: str = "z", out: str = "mean") -> DataFrame:
    return tiled(px, [column], radius, lambda a: {out: box(a, radius)}, [out], pad="edge")


def median3(px: DataFrame, column: str = "z", out: str = "median") -> DataFrame:
    return tiled(px, [column], 1, lambda a: {out: ranked(a, 3, 4)}, [out], pad="edge")


def percentile_filter(px: DataFrame, k: int, pct: float, column: str = "z", out: str = "rank") -> DataFrame:
    return tiled(px, [column], k // 2, lambda a: {out: ranked(a, k, int(k * k * pct / 100))}, [out], pad="edge")


def guided(px: DataFrame, source: str, guide: str, radius: int, eps: float, out: str = "guided") -> DataFrame:
    """Edge-preserving smoothing of ``source`` along ``guide``: local linear fits, averaged."""

    def fit(s, g):
        mg, ms = box(g, radius), box(s, radius)
        a = (box(g * s, radius) - mg * ms) / (box(g * g, radius) - mg * mg + eps)
        return {"_a": a, "_b": ms - a * mg}

    fits = tiled(px, [source, guide], radius, fit, ["_a", "_b"], pad="edge")
    means = tiled(fits, ["_a", "_b"], radius, lambda a, b: {"_a": box(a, radius), "_b": box(b, radius)}, ["_a", "_b"], pad="edge")
    return px.join(means, ["scene", "r", "c"]).withColumn(out, F.col("_a") * F.col(guide) + F.col("_b")).drop("_a", "_b")


def object_band(px: DataFrame, sigma: float, column: str = "z", out: str = "object") -> DataFrame:
    """Height over the low-passed surface; holes are filled with the scene's median for it and stay holes."""
    mid = quantiles(px, ["scene"], _mid=(column, 0.5))
    t = beside(px, mid, "scene").withColumn("_full", F.coalesce(column, "_mid", F.lit(0.0)))
    low = gaussian(t, sigma, "_full", "_low")
    return t.join(low, ["scene", "r", "c"]).withColumn(out, F.when(F.col(column).isNotNull(), F.col("_full") - F.col("_low"))).drop("_mid", "_full", "_low")


def roughness(px: DataFrame, radius: int, column: str = "z", out: str = "rough") -> DataFrame:
    """Local standard deviation."""

    def kernel(a):
        m = box(a, radius)
        return {out: np.sqrt(np.maximum(box(a * a, radius) - m * m, 0.0))}

    return tiled(px, [column], radius, kernel, [out])


def debias(px: DataFrame, k: int, *, deadband: float = 0.75, most: float = 5.0, column: str = "z") -> DataFrame:
    """Take objects off a coarse surface: what stands over the smoothed opening by more than the dead band, up to ``most``."""
    low = gaussian(opening(px, k, column), max(1.0, k / 6), "opened", "ground")
    t = px.join(low, ["scene", "r", "c"])
    corr = F.least(F.greatest(F.col(column) - F.col("ground") - deadband, F.lit(0.0)), F.lit(most))
    return t.withColumn("correction", corr).withColumn("debiased", F.col(column) - F.col("correction"))


def sharpen(px: DataFrame, sigma: float, amount: float = 0.5) -> DataFrame:
    """Unsharp mask on the object band only."""
    t = object_band(px, sigma)
    low = gaussian(t, max(1.0, sigma / 8), "object", "_soft")
    return t.join(low, ["scene", "r", "c"]).withColumn("sharp", F.col("z") + F.lit(amount) * (F.col("object") - F.col("_soft"))).drop("_soft")


def crispness(px: DataFrame, slope: str = "slope") -> DataFrame:
    """Share of all gradient magnitude that the steepest 1 % of pixels hold.

    The magnitude at the cut is found by its rank; what lies above it is summed and
    the pixels that tie with it fill up the 1 %.
    """
    t = materialize(px.filter(F.col(slope).isNotNull()).select("scene", F.tan(F.radians(slope)).alias("v")), "slopes")
    n = t.groupBy("scene").agg(F.count(F.lit(1)).alias("_n"), F.sum("v").alias("_all"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    n = materialize(n.withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(0.01)))), "gradients")
    cut = at_ranks(t, ["scene"], n.select("scene", (F.col("_n") - F.col("_k")).cast("long").alias("rank")), n.select("scene", "_lo", "_hi"))
    over = beside(t, cut.select("scene", F.col("v").alias("_cut")), "scene").groupBy("scene").agg(F.max("_cut").alias("_cut"), F.count_if(F.col("v") > F.col("_cut")).alias("_m"), F.coalesce(F.sum(F.when(F.col("v") > F.col("_cut"), F.col("v"))), F.lit(0.0)).alias("_top"))
    return over.join(n, "scene").select("scene", ((F.col("_top") + (F.col("_k") - F.col("_m")) * F.col("_cut")) / F.greatest("_all", F.lit(1e-12))).alias("crispness"))

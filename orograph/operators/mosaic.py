"""Tiles brought onto one surface, in order: each is fitted to the mosaic of those before it.

What a fit needs from the pixels does not depend on the gains before it: the mosaic under a
tile is a weighted sum of the tiles before, each times its gain plus its offset. So one pass over pixels
gives sums for each pair of overlapping tiles, and the gains follow one another over
that small table, a scene in a task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import beside, materialize
from orograph.operators.resample import feather

TILE = ["scene", "r0", "c0"]


def pair_sums(tiled: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Sums over the pixels of a tile that tiles before it cover, by earlier tile (s0, t0), and of the tile alone (s0 null).

    Tiles go by (r0, c0). A pixel's tiles are collected: as many as overlap there.
    """
    w = feather(F.col("r") - F.col("r0"), F.lit(tile), overlap) * feather(F.col("c") - F.col("c0"), F.lit(tile), overlap)
    t = tiled.filter("z is not null").groupBy("scene", "r", "c").agg(F.array_sort(F.collect_list(F.struct("r0", "c0", "z", w.alias("w")))).alias("s"))
    t = t.filter(F.size("s") > 1).select("scene", "s", F.posexplode("s").alias("k", "own")).filter("k > 0")
    before = F.slice("s", 1, F.col("k"))
    t = t.select("scene", "own", before.alias("s"), F.aggregate(before, F.lit(0.0), lambda a, x: a + x["w"]).alias("all"))
    t = t.select("scene", "own", "all", F.explode(F.concat(F.array(F.lit(None).cast(t.schema["own"].dataType)), F.col("s"))).alias("e"))
    share, p = F.col("e.w") / F.col("all"), F.col("own.z")
    sums = {"n": F.count(F.lit(1)), "p": F.sum(p), "pp": F.sum(p * p), "a": F.sum(share * F.col("e.z")), "b": F.sum(share), "pa": F.sum(p * share * F.col("e.z")), "pb": F.sum(p * share)}
    return t.groupBy("scene", F.col("own.r0").alias("r0"), F.col("own.c0").alias("c0"), F.col("e.r0").alias("s0"), F.col("e.c0").alias("t0")).agg(*[v.alias(k) for k, v in sums.items()])


def gains(tiled: DataFrame, tile: int, overlap: int, *, least: int = 50, low: float = 0.1, high: float = 5.0) -> DataFrame:
    """(scene, r0, c0, n, gain, offset, accepted) of tiles (scene, r0, c0, r, c, z).

    A tile that shares over ``least`` pixels with those before it is fitted to their
    mosaic by least squares; a gain outside (``low``, ``high``) is not taken, and the tile stays as it
    is (gain 1, offset 0), as does the first. Nulls take no part.
    """
    sums = materialize(pair_sums(tiled, tile, overlap), "tile-sums")
    every = tiled.select(*TILE).distinct()
    alone = every.select(*TILE, *[F.lit(None).cast(sums.schema[k].dataType).alias(k) for k in sums.columns if k not in TILE])
    kinds = ", ".join(f"{k} {every.schema[k].dataType.simpleString()}" for k in TILE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, by = {}, defaultdict(list)
        for x in pdf.itertuples():
            if np.isnan(x.n):
                own.setdefault((x.r0, x.c0), None)
            elif np.isnan(x.s0):
                own[x.r0, x.c0] = x
            else:
                by[x.r0, x.c0].append(x)
        fit: dict[tuple, tuple[float, float]] = {}
        rows = []
        for at in sorted(own):
            x, g, o, n, ok = own[at], 1.0, 0.0, 0, False
            if x is not None:
                n = int(x.n)
                spread = x.pp - x.p * x.p / x.n
                if n > least and spread / n > 1e-18:
                    ref = sum(fit[e.s0, e.t0][0] * e.a + fit[e.s0, e.t0][1] * e.b for e in by[at])
                    both = sum(fit[e.s0, e.t0][0] * e.pa + fit[e.s0, e.t0][1] * e.pb for e in by[at])
                    slope = (both - x.p * ref / x.n) / spread
                    if low < slope < high:
                        g, o, ok = slope, (ref - slope * x.p) / x.n, True
            fit[at] = (g, o)
            rows.append((pdf["scene"].iloc[0], *at, n, g, o, ok))
        return pd.DataFrame(rows, columns=[*TILE, "n", "gain", "offset", "accepted"])

    return sums.unionByName(alone).groupBy("scene").applyInPandas(run, f"{kinds}, n long, gain double, offset double, accepted boolean")


def aligned(tiled: DataFrame, tile: int, overlap: int, **how) -> DataFrame:
    """(scene, r, c, z): the mosaic of the tiles after their gains, blended by their feathers."""
    g = gains(tiled, tile, overlap, **how).select(*TILE, "gain", "offset")
    w = feather(F.col("r") - F.col("r0"), F.lit(tile), overlap) * feather(F.col("c") - F.col("c0"), F.lit(tile), overlap)
    t = beside(tiled, g, TILE).withColumn("_z", F.col("z") * F.col("gain") + F.col("offset")).withColumn("_w", F.when(F.col("z").isNotNull(), w))
    return t.groupBy("scene", "r", "c").agg((F.sum(F.col("_z") * F.col("_w")) / F.sum("_w")).alias("z"))

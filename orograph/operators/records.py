"""Catalogue, configuration and log records: latest per key, first of a priority, merges, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside

#: Members of a class that travel as one array, about.
CHUNK = 1024


def latest(t: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; the rest is cut before the shuffle where Spark can."""
    w = W.partitionBy(*key).orderBy(*order)
    return t.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_n(t: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return t.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def priority_pick(names: DataFrame, by: list[str], name: str, patterns: list[str]) -> DataFrame:
    """Per group the first name that matches the earliest pattern."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col(name).rlike(f"(?i){p}"), i).otherwise(rank)
    t = names.withColumn("_rank", rank).filter("_rank is not null")
    return t.groupBy(*by).agg(F.min(F.struct("_rank", name)).alias("_m")).select(*by, F.col("_m._rank").alias("pattern"), F.col(f"_m.{name}").alias(name))


def evict(files: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Newest files whose running size stays within the budget; the newest always stays."""
    w = W.partitionBy(*by).orderBy(F.col("mtime").desc(), F.col("id").desc())
    t = files.withColumn("_sum", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return t.filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in the new ones, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_protected(old: DataFrame, new: DataFrame, key: str, protected: list[str]) -> DataFrame:
    """Full outer merge: the new value, but the old one of protected columns where there is one."""
    a, b = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c != key]
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in protected else F.coalesce(f"n.{c}", f"o.{c}")
    return a.join(b, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[pick(c).alias(c) for c in cols])


def chunked(t: DataFrame, alike: list[str], name: str) -> DataFrame:
    """A row of ``alike`` and ``{name}_ids``, an array of some ``CHUNK`` ids of rows that agree in all of them; none where one is null."""
    t = beside(t, t.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n")), alike)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / CHUNK))
    return t.groupBy(*alike, part.alias("_part")).agg(F.collect_list("id").alias(f"{name}_ids")).drop("_part")


def contained(boxes: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """(box, area) pairs where the area contains the box; both carry left, bottom, right, top.

    Boxes that are alike are a class, and so are areas. Classes of areas are dealt to the grid cells
    they touch; a class of boxes is looked up in the cell of its lower left corner, so the range condition
    is checked within an equi-join, once for all members. Members travel in arrays of some ``CHUNK``; pairs
    of arrays are dealt over all tasks before they are written out as rows.
    """
    side = ["left", "bottom", "right", "top"]
    at = lambda c: F.floor(F.col(c) / cell)
    b = chunked(boxes, side, "box").select("box_ids", *side, at("left").alias("_x"), at("bottom").alias("_y"))
    a = chunked(areas, side, "area").select("area_ids", *[F.col(k).alias(f"a_{k}") for k in side])
    a = a.withColumn("_x", F.explode(F.sequence(at("a_left"), at("a_right")))).withColumn("_y", F.explode(F.sequence(at("a_bottom"), at("a_top"))))
    inside = (F.col("left") >= F.col("a_left")) & (F.col("right") <= F.col("a_right")) & (F.col("bottom") >= F.col("a_bottom")) & (F.col("top") <= F.col("a_top"))
    pairs = b.join(a, ["_x", "_y"]).filter(inside).select("box_ids", "area_ids")
    pairs = pairs.repartition(8 * boxes.sparkSession.sparkContext.defaultParallelism)
    return pairs.select(F.explode("box_ids").alias("box"), "area_ids").select("box", F.explode("area_ids").alias("area"))


def near_anti(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Points (x, y, kind) farther than ``radius`` from every other point of the same kind, by the cells around."""
    at = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    o = others.select("kind", F.col("x").alias("ox"), F.col("y").alias("oy"), around.alias("k"))
    o = o.select("kind", "ox", "oy", (F.floor(F.col("ox") / radius) + F.col("k.i")).alias("_x"), (F.floor(F.col("oy") / radius) + F.col("k.j")).alias("_y")).alias("o")
    p = points.withColumn("_x", at("x")).withColumn("_y", at("y")).alias("p")
    near = (F.col("p.kind") == F.col("o.kind")) & (F.col("p._x") == F.col("o._x")) & (F.col("p._y") == F.col("o._y")) & ((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 <= radius * radius)
    return p.join(o, near, "left_anti").drop("_x", "_y")


def tile_ids(boxes: DataFrame, x0: float, y0: float, side: float, cols: int, rows: int) -> DataFrame:
    """(id, tile) of all tiles R{r}_C{c} that each box overlaps, half-open at its far edges, clamped to the grid."""
    eps = 1e-6
    col = lambda x: F.greatest(F.least(F.floor((x - F.lit(x0)) / side) + 1, F.lit(cols)), F.lit(1))
    row = lambda y: F.greatest(F.least(F.floor((F.lit(y0) - y) / side) + 1, F.lit(rows)), F.lit(1))
    t = boxes.withColumn("_r", F.explode(F.sequence(row(F.col("top") - eps), row(F.col("bottom") + eps)))).withColumn("_c", F.explode(F.sequence(col(F.col("left") + eps), col(F.col("right") - eps))))
    return t.select("id", F.concat(F.lit("R"), F.col("_r").cast("string"), F.lit("_C"), F.col("_c").cast("string")).alias("tile"))


def sampling_weights(tiles: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Weight of each (source, landscape) tile: the source's share over its landscapes and their tiles, summing to one."""
    pairs = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    n = tiles.groupBy("source", "landscape").count()
    n = n.withColumn("_k", F.count(F.lit(1)).over(W.partitionBy("source"))).withColumn("_w", F.coalesce(F.element_at(pairs, F.col("source")), F.lit(0.0)) / F.col("_k") / F.col("count"))
    total = F.sum(F.col("_w") * F.col("count")).over(W.partitionBy())
    return n.select("source", "landscape", "count", (F.col("_w") / F.greatest(total, F.lit(1e-12))).alias("weight"))


def hash_order(key: Column) -> Column:
    """A fixed pseudo-random order of whole numbers."""
    return (key % F.lit(2147483648)) * F.lit(2654435761) % F.lit(4294967296)


def stratified_points(px: DataFrame, cells: int, pct: float) -> DataFrame:
    """One pixel of each grid cell among those over the cell's percentile, by hash order."""
    dims = px.groupBy("scene").agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    t = beside(px, dims, "scene").withColumn("i", F.floor(F.col("r") * cells / F.col("_h"))).withColumn("j", F.floor(F.col("c") * cells / F.col("_w")))
    q = quantiles(t, ["scene", "i", "j"], _q=("z", pct))
    t = t.join(q, ["scene", "i", "j"]).filter(F.col("z") >= F.col("_q"))
    key = hash_order(F.col("r").cast("long") * F.col("_w") + F.col("c"))
    return t.groupBy("scene", "i", "j").agg(F.min(F.struct(key.alias("k"), F.col("r"), F.col("c"), F.col("z"))).alias("m")).select("scene", "i", "j", "m.r", "m.c", "m.z")


def longtail_weights(px: DataFrame, bands: int, top: float, power: float = 0.5) -> DataFrame:
    """Weight of each height band: its frequency to the minus ``power``, mean one over pixels, within 0.2..10."""
    b = F.least(F.floor(F.log1p(F.greatest("z", F.lit(0.0)) / 2.0) / F.lit(top) * bands), F.lit(bands - 1)).cast("int")
    n = px.filter("z is not null").groupBy(b.alias("band")).count()
    every = F.sum("count").over(W.partitionBy())
    f = F.greatest(F.col("count") / every, F.lit(1e-4))
    n = n.withColumn("_f", F.pow(f, F.lit(-power)))
    mean = F.sum(F.col("_f") * F.col("count")).over(W.partitionBy()) / every
    return n.select("band", "count", F.least(F.greatest(F.col("_f") / mean, F.lit(0.2)), F.lit(10.0)).alias("weight"))

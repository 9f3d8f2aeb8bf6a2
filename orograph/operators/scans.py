"""Scan rules, value scaling, listings and score summaries: small column rules and single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.tables import beside
from orograph.operators.records import contained


def decimated(px: DataFrame, budget: int) -> DataFrame:
    """Block means by the smallest whole factor that brings a scene within ``budget`` pixels; incomplete blocks at the edge go."""
    d = px.groupBy("scene").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    # the factor is at most the root of the excess, rounded up
    most = F.ceil(F.sqrt(F.col("h") * F.col("w") / F.lit(float(budget)))) + 1
    fits = F.filter(F.sequence(F.lit(1), most.cast("int")), lambda k: F.floor(F.col("h") / k) * F.floor(F.col("w") / k) <= budget)
    t = beside(px, d.withColumn("dec", F.array_min(fits)), "scene").withColumn("r", F.floor(F.col("r") / F.col("dec"))).withColumn("c", F.floor(F.col("c") / F.col("dec")))
    t = t.filter((F.col("r") < F.floor(F.col("h") / F.col("dec"))) & (F.col("c") < F.floor(F.col("w") / F.col("dec"))))
    return t.groupBy("scene", "r", "c", "dec").agg(F.avg("z").alias("z"))


def colour_bands(n: Column, declared: Column, names: Column) -> Column:
    """(red, green, blue, rule) of a file: one band is grey; declared roles come first, then names, then a false colour of near infrared, then the first three."""
    role = lambda k: F.array_position(declared, k).cast("int")
    low = F.transform(names, lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))

    def named(*starts: str) -> Column:
        hit = lambda x: F.exists(F.array(*[F.lit(k) for k in starts]), lambda k: F.startswith(x, k))
        return F.array_position(F.transform(low, hit), True).cast("int")

    r, g, b, nir = named("r"), named("g"), named("b"), named("nir", "near")
    out = lambda x, y, z, rule: F.struct(x.cast("int").alias("red"), y.cast("int").alias("green"), z.cast("int").alias("blue"), F.lit(rule).alias("rule"))
    return (
        F.when(n == 1, out(F.lit(1), F.lit(1), F.lit(1), "grey"))
        .when((role("red") > 0) & (role("green") > 0) & (role("blue") > 0), out(role("red"), role("green"), role("blue"), "declared"))
        .when((r > 0) & (g > 0) & (b > 0), out(r, g, b, "named"))
        .when((nir > 0) & (r > 0) & (g > 0), out(r, g, g, "false colour"))
        .otherwise(out(F.lit(1), F.lit(2), F.lit(3), "first three"))
    )


def cell_window(cells: DataFrame, box: tuple[float, float, float, float], size: float, *, scale: float, offset: float, most: float = 500.0) -> DataFrame:
    """Scaled values of the cells (r, c, v) that a box (left, top, right, bottom) touches; implausible ones go."""
    left, top, right, bottom = (x / size for x in box)
    inside = (F.col("c") >= F.floor(F.lit(left + 1e-9))) & (F.col("c") < F.ceil(F.lit(right - 1e-9))) & (F.col("r") >= F.floor(F.lit(top + 1e-9))) & (F.col("r") < F.ceil(F.lit(bottom - 1e-9)))
    return cells.filter(inside).withColumn("v", F.col("v") * F.lit(scale) + F.lit(offset)).filter(F.col("v").between(0.0, most))


def local_file(tiles: DataFrame, files: DataFrame, mark: str, cell: float = 1.0) -> DataFrame:
    """For each tile (id, left, bottom, right, top) the file (path and its box) named after it, else the first that covers it; only files whose name holds ``mark``.

    Files are dealt to the cells that they touch (``cell``: about a file's side), so a tile meets only those about it.
    """
    f = files.filter(F.upper("path").contains(mark.upper())).withColumnsRenamed({k: f"f_{k}" for k in ("left", "bottom", "right", "top")})
    named = tiles.join(f.withColumn("id", F.regexp_extract("path", r"_([A-Za-z0-9]+)\.tif$", 1)), "id").select("id", F.lit(0).alias("rank"), "path")
    covers = contained(tiles, files.filter(F.upper("path").contains(mark.upper())).withColumn("id", F.col("path")), cell)
    covers = covers.select(F.col("box").alias("id"), F.lit(1).alias("rank"), F.col("area").alias("path"))
    best = named.unionByName(covers).groupBy("id").agg(F.min(F.struct("rank", "path")).alias("m"))
    return tiles.select("id").join(best, "id", "left").select("id", F.col("m.path").alias("path"), (F.col("m.rank") == 0).alias("by_name"))


def box_around(cx: Column, cy: Column, size: Column) -> dict[str, Column]:
    return {"left": cx - size / 2, "bottom": cy - size / 2, "right": cx + size / 2, "top": cy + size / 2}


def padded(left: Column, bottom: Column, right: Column, top: Column, pad: float = 0.01) -> dict[str, Column]:
    return {"west": left - pad, "south": bottom - pad, "east": right + pad, "north": top + pad}


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a place."""
    return (F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6) + 1).cast("int")


def capability_names(xml: Column, tag: str) -> Column:
    """Names listed under a tag of a capabilities document, whatever the namespace prefixes."""
    bare = F.regexp_replace(F.regexp_replace(xml, r"<(/?)[A-Za-z0-9]+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    return F.xpath(bare, F.lit(f"//{tag}/Name/text()"))


def settings(lines: DataFrame, given: DataFrame) -> DataFrame:
    """(key, value) of KEY=VALUE lines (file, i, line): blanks, comments and lines without "=" go, quotes are stripped, the first line of a key wins, a given one above all."""
    line = F.trim("line")
    t = lines.filter((F.length(line) > 0) & ~line.startswith("#") & line.contains("=")).withColumn("line", line)
    value = F.regexp_replace(F.trim(F.expr("substring(line, instr(line, '=') + 1)")), "^['\"]+|['\"]+$", "")
    t = t.select("file", "i", F.trim(F.expr("substring(line, 1, instr(line, '=') - 1)")).alias("key"), value.alias("value"))
    first = t.groupBy("key").agg(F.min_by("value", F.struct("file", "i")).alias("value"))
    return first.join(given.select("key", F.col("value").alias("_g")), "key", "full").select("key", F.coalesce("_g", "value").alias("value"))


def tile_listing(images: DataFrame, heights: DataFrame, classes: DataFrame) -> DataFrame:
    """(split, id, image, height, class): images (path) that have a height; a class file where there is one."""
    parts = lambda df, name: df.select(F.regexp_extract("path", r"^([a-z]+)/", 1).alias("split"), F.regexp_extract("path", r"([A-Za-z0-9]+)_[A-Z]+\.[a-z0-9]+$", 1).alias("id"), F.col("path").alias(name))
    return parts(images, "image").join(parts(heights, "height"), ["split", "id"]).join(parts(classes, "cls"), ["split", "id"], "left")


def density(px: DataFrame, lo: Column, hi: Column, bins: int) -> DataFrame:
    """Counts of (pred, ref) over square bins between lo and hi (columns of ``px``), with their logarithms; pairs outside go."""
    at = lambda c: F.floor((F.col(c) - lo) / F.greatest(hi - lo, F.lit(1e-12)) * bins).cast("int")
    t = px.withColumn("bx", at("ref")).withColumn("by", at("pred")).filter(F.col("bx").between(0, bins - 1) & F.col("by").between(0, bins - 1))
    return t.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10("n"))


def tile_reason(blank: Column, valid: Column, water: Column) -> Column:
    """Why a training tile is refused, or null: the first reason that holds."""
    return F.when(blank > 0.15, "blank image").when(valid < 0.8, "missing height").when(water > 0.5, "mostly water")


def prior_gain(reference: Column, source: Column, *, tallest: float, cells: float = 1.0) -> Column:
    return F.when(F.lower(source) == "ghsl", cells).when(F.lower(reference) == "tallest", tallest).otherwise(1.0)


def control_gain(px: DataFrame, points: DataFrame, least: float = 0.5) -> DataFrame:
    """Per scene the gain through the origin of control points (r, c, h) on what the surface shows above ``least``; null for under two points or a gain that is not positive."""
    d = px.groupBy("scene").agg(F.max("r").alias("_h"), F.max("c").alias("_w"))
    clip = lambda x, top: F.least(F.greatest(x, F.lit(0)), top).cast("int")
    p = points.join(d, "scene").select("scene", clip(F.col("r"), F.col("_h")).alias("r"), clip(F.col("c"), F.col("_w")).alias("c"), "h")
    t = p.join(px.select("scene", "r", "c", "z"), ["scene", "r", "c"])
    ok = (F.col("z") > least) & F.col("h").isNotNull()
    t = t.groupBy("scene").agg(F.count_if(ok).alias("n"), (F.sum(F.when(ok, F.col("z") * F.col("h"))) / F.sum(F.when(ok, F.col("z") * F.col("z")))).alias("gain"))
    return t.select("scene", "n", F.when((F.col("n") >= 2) & (F.col("gain") > 0), F.col("gain")).alias("gain"))


def stability(scores: DataFrame, by: list[str], cls: str) -> DataFrame:
    """Worst class, and spread and ratio of rmse over the classes of each group that has two or more."""
    t = scores.filter("rmse is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.max_by(cls, F.struct("rmse", cls)).alias("worst_class"), F.min("rmse").alias("lo"), F.max("rmse").alias("hi"))
    return t.filter("k >= 2").select(*by, "worst_class", (F.col("hi") - F.col("lo")).alias("rmse_spread"), (F.col("hi") / F.greatest("lo", F.lit(1e-9))).alias("rmse_ratio"))


def before_after(rows: DataFrame, pairs: list[str]) -> DataFrame:
    """Root mean squares, weighted by n, of each ``x_before`` and ``x_after``, and how many rows got better; nulls count as nothing."""
    n = F.coalesce("n", F.lit(0)).cast("double")
    pooled = lambda c: F.sqrt(F.coalesce(F.sum(n * F.col(c) ** 2), F.lit(0.0)) / F.greatest(F.sum(n), F.lit(1e-9))).alias(c)
    better = [F.count_if(F.coalesce(f"{p}_after", F.lit(9e9)) < F.coalesce(f"{p}_before", F.lit(0.0))).alias(f"{p}_better") for p in pairs]
    return rows.agg(*[pooled(f"{p}_{w}") for p in pairs for w in ("before", "after")], *better)


def unit_check(tiles: DataFrame, first: int = 20, most: float = 300.0) -> DataFrame:
    """Median p99 and largest height of the first tiles by id; a median over ``most`` hints at another unit than metres."""
    t = tiles.orderBy("id").limit(first).filter("p99 is not null")
    return t.agg(F.count(F.lit(1)).alias("tiles"), F.percentile("p99", F.lit(0.5)).alias("p99_median"), F.max("h_max").alias("h_max")).withColumn("suspicious", F.col("p99_median") > most)


def run_starts(t: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The first row of every run of equal values, with the run's number and length."""
    w = W.partitionBy(*by).orderBy(order)
    new = F.coalesce(~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1), F.lit(True))
    t = t.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return t.groupBy(*by, "run").agg(F.min(order).alias("start"), F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def disc_places(discs: DataFrame, sites: DataFrame, *, tries: int, step: float, apart: float) -> DataFrame:
    """``tries`` hash-random places (area, k, x, y) in each disc (area, cx, cy, radius), on a lattice of ``step``, but for those nearer than ``apart`` to a site (sx, sy)."""
    unit = lambda tag: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(tag), "area", "k").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    t = discs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    rho, phi = F.col("radius") * F.sqrt(unit("r")), unit("a") * F.lit(2 * 3.141592653589793)
    snap = lambda v: F.floor(v / step + F.lit(0.5)) * step
    t = t.select("area", "k", snap(F.col("cx") + rho * F.cos(phi)).alias("x"), snap(F.col("cy") + rho * F.sin(phi)).alias("y"))
    # a site rules out the places of its own and the eight neighbouring cells
    cell = lambda v: F.floor(F.col(v) / apart).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = sites.withColumn("o", F.explode(around)).select("sx", "sy", (cell("sx") + F.col("o.i")).alias("gx"), (cell("sy") + F.col("o.j")).alias("gy"))
    near = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) < apart
    t = t.withColumn("gx", cell("x")).withColumn("gy", cell("y"))
    bad = t.join(s, ["gx", "gy"]).filter(near).select("area", "k").distinct()
    return t.join(bad, ["area", "k"], "left_anti").select("area", "k", "x", "y")


def hashed_subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a hash of their key: the same in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def run_results(configs: DataFrame, results: DataFrame, have_model: bool) -> DataFrame:
    """Each configuration (key, label, needs_model) with its scores, or why it has none."""
    t = configs.join(results.groupBy("key").agg(F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("error").isNull()).alias("good"), F.min("error").alias("error"), F.avg("rmse").alias("rmse")), "key", "left")
    why = F.when(F.col("needs_model") & F.lit(not have_model), "no trained model").when(F.col("scenes").isNull(), "benchmark run failed").when(F.col("good") == 0, F.concat(F.lit("every scene failed - "), F.substring(F.translate("error", "|", "/"), 1, 90)))
    return t.select("key", "label", why.alias("skipped"), F.when(why.isNull(), F.col("good")).alias("scenes"), F.when(why.isNull(), F.col("rmse")).alias("rmse"))


def grids_differ(one: DataFrame, other: DataFrame) -> DataFrame:
    """Per scene of either grid both shapes, and whether they differ or one is missing."""
    d = lambda px, p: px.groupBy("scene").agg((F.max("r") + 1).alias(f"{p}_h"), (F.max("c") + 1).alias(f"{p}_w"))
    t = d(one, "a").join(d(other, "b"), "scene", "full")
    return t.withColumn("differ", ~(F.col("a_h").eqNullSafe(F.col("b_h")) & F.col("a_w").eqNullSafe(F.col("b_w"))))

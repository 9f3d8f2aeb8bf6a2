"""What grows with the tables: joins that may not go through the driver, products of rows, quantiles by rank."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from orograph.functions import ranks
from orograph.functions.ranks import quantiles
from orograph.functions.tables import beside
from orograph.operators import buildings, colour, condition, focal, landscape, losses, structures
from orograph.plans import city
from orograph.plans.base import six
from orograph.sources import adapters

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_pixels_wait_for_measured_sizes(spark):
    """Estimates of exploded vectors are too low, so no join of pixels may be planned as a broadcast by them."""
    for name in ("feather_blend", "tile_overlap_fits"):
        plan = plan_of(__spark_entry__.queries()[name](spark, SF))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name


def test_rows_beside_pixels_are_the_broadcast_side(spark):
    px = spark.range(3000).select((F.col("id") % 3).cast("string").alias("scene"), F.col("id").alias("v"))
    t = beside(px, px.groupBy("scene").agg(F.collect_list("v").alias("vs")), "scene")
    assert "BuildRight" in plan_of(t)
    assert t.count() == 3000


def test_working_size_of_a_long_scene(spark):
    """Rows times new rows pass 2^31 here, which was an overflow."""
    px = spark.createDataFrame([("s", 0, 0, 1.0), ("s", 69_999, 0, 3.0), ("s", 69_999, 11, 5.0)], "scene string, r int, c int, z double")
    got = {(x.r, x.c): x.z for x in colour.at_working_size(px, spark.createDataFrame([("s", 0.2)], "scene string, size double")).collect()}
    assert [round(got[k], 3) for k in ((0, 0), (46_666, 0), (46_666, 7))] == [1.0, 3.0, 5.0]


def test_quantiles_of_several_columns_by_rank(spark):
    """By rank as by the built-in aggregate, a group without values included; all columns go through one sort."""
    t = spark.range(200).select((F.col("id") % 4).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("a"), F.when(F.col("id") % 4 < 3, F.col("id")).cast("double").alias("b"))
    wanted = {"x": ("a", 0.1), "y": ("a", 0.5, 0.93), "z": (F.col("a") * F.col("b"), 0.25), "w": ("b", 0.3, 0.7)}
    key = lambda r: r.g
    few, many = sorted(quantiles(t, ["g"], **wanted).collect(), key=key), sorted(quantiles(t, ["g"], 0, **wanted).collect(), key=key)
    flat = lambda r: [x for k in "xyzw" for x in (r[k] if isinstance(r[k], list) else [r[k]])]
    for p, q in zip(few, many, strict=True):
        assert len(flat(p)) == len(flat(q))
        assert all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(flat(p), flat(q), strict=True))


def test_ranks_of_uneven_values_sort_few_rows(spark, monkeypatch):
    """Values over 600 powers of ten, many alike, not finite: each rank is the sorted one's, and of plain values few are sorted."""
    odd = [0.0] * 500 + [7.5] * 300 + [10.0**k * s for k in range(-300, 300, 3) for s in (1, -1)]
    rows = [(g, v) for g, vs in (("odd", odd), (None, odd[490:]), ("ends", [float("-inf"), 1.0, 2.0, 3.0, float("inf")])) for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    exact = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(i / 4) for i in range(5)])).alias("q")).collect()}
    for few in (0, 2_000_000):
        monkeypatch.setattr(ranks, "MOST", few)
        got = {r.g: r.q for r in quantiles(df, ["g"], 0, q=("v", *[i / 4 for i in range(5)])).collect()}
        assert got.keys() == exact.keys() and all(pytest.approx(exact[g]) == got[g] for g in got)
    sizes = []
    kept = ranks._sorted_ranks
    monkeypatch.setattr(ranks, "_sorted_ranks", lambda values, by, wanted: sizes.append(values.count()) or kept(values, by, wanted))
    t = spark.range(50_000).select(F.lit("a").alias("g"), F.sqrt(F.col("id").cast("double")).alias("v"))
    assert quantiles(t, ["g"], 0, q=("v", 0.5)).first().q == pytest.approx((24_999**0.5 + 25_000**0.5) / 2)
    assert sum(sizes) < 500


def test_parts_of_a_loss_over_one_scene(spark):
    """The bins of a scene reach its pixels by the scene alone, whatever their estimate."""
    px = spark.range(400).select(F.lit("s").alias("scene"), (F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.lit(2.0).alias("pred"), F.lit(3.0).alias("ref"), F.array(F.lit(0.0), F.lit(0.0)).alias("logits"))
    row = losses.combined(px, spark.createDataFrame([("s", [0.0, 3.0])], "scene string, centers array<double>")).collect()
    assert len(row) == 1 and row[0].n == 400 and row[0].grad == 0.0


def test_a_roof_along_a_line_has_no_plane(spark):
    """As in the SQL, where its deviation is 0 / 0; it was the deviation from the mean."""
    px = spark.range(10).select(F.lit("s").alias("scene"), F.lit(1).alias("region"), F.lit(3).alias("r"), F.col("id").cast("int").alias("c"), F.col("id").cast("double").alias("z"))
    row = six(buildings.roofs(px)).first()
    assert row.n == 10 and row.height == 6.75 and row.uneven != row.uneven


def test_vectors_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    """A table of one row group was written out as pixels by one task."""
    spark.range(10_000).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("embedding")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for px in (adapters.grid(spark, str(tmp_path)), adapters.scenes(spark, str(tmp_path))):
        tasks = px.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("c") == 0, F.col("z"))).alias("s")).collect()
        assert sum(t.n for t in tasks) == 20_000 and sum(t.s or 0 for t in tasks) == sum(range(10_000))
        assert len(tasks) >= 4 and max(t.n for t in tasks) < 10_000


def test_size_says_how_many_tasks_read_a_shuffle(spark):
    """The session of the tests deals to 4, so 48 MB were read by 4 tasks, and six times as much by 4 as well."""
    __spark_entry__.queries()["excess_green"](spark, SF)
    t = spark.range(6_000_000).select(F.xxhash64("id").alias("k")).repartition("k")
    assert t.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_what_is_used_again_is_written_once(spark, monkeypatch):
    """Quantiles, joins and both sides of a comparison read a written table, not the work before it."""
    px = spark.range(400).select(F.lit("s").alias("scene"), (F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.sin("id").alias("z"))
    rgb = px.select("*", *[(F.col("r") + F.col("c") * k).alias(b) for k, b in enumerate(("red", "green", "blue"), 1)])
    assert "Exchange" not in plan_of(condition.decisions(rgb))
    assert "Window" not in plan_of(landscape.landscape_classes(rgb, 0.05, 2))
    seen = []
    slope = focal.slope_deg
    monkeypatch.setattr(focal, "slope_deg", lambda t, *a: seen.append(plan_of(t)) or slope(t, *a))
    structures.refine_gate(px, 2.0)
    assert len(seen) == 2 and not any("Exchange" in p for p in seen)


def test_a_city_is_built_once_for_its_meshes(spark, monkeypatch):
    built = []
    one = adapters.city
    monkeypatch.setattr(adapters, "city", lambda *a: built.append(1) or one(*a))
    city.city_meshes(spark, "/root/testdata/sf0.001")
    assert len(built) == 1

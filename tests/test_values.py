"""Exact values and invariants of the raster operators, and array kernels against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import focal, fusion, local, metrics, records, resample, robust, scalars, scale, zonal


def pixels(spark, a, name="z"):
    rows = [("s", r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"scene string, r int, c int, {name} double")


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["r"], r["c"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def hills():
    rng = np.random.default_rng(2)
    return rng.normal(0, 1, (37, 41)).cumsum(0).cumsum(1) / 20


@pytest.mark.parametrize(("h", "w", "n"), [(600, 600, 4), (700, 700, 4), (519, 519, 4), (2352, 1222, 28), (518, 518, 1)])
def test_tile_counts(spark, h, w, n):
    got = [(r.r0, r.c0) for r in resample.tile_grid(spark.createDataFrame([("s", h, w)], "scene string, h int, w int"), 518, 180).collect()]
    assert len(got) == len(set(got)) == n
    assert max(r for r, _ in got) == max(0, h - 518) and max(c for _, c in got) == max(0, w - 518)


@pytest.mark.parametrize("tile", [8, 256])
def test_gaussian_is_the_same_on_tiles_of_any_size(spark, hills, tile):
    sigma, k = 1.5, 6
    got = dense(focal.tiled(pixels(spark, hills), ["z"], k, lambda a: {"low": focal.gauss(a, sigma)}, ["low"], tile=tile), "low", hills.shape)
    w = focal.gauss_weights(sigma)
    pad = np.pad(hills, k, mode="symmetric")
    rows = sum(w[i] * pad[i : i + hills.shape[0], :] for i in range(2 * k + 1))
    want = sum(w[i] * rows[:, i : i + hills.shape[1]] for i in range(2 * k + 1))
    assert np.allclose(got, want, atol=1e-12)


def test_rank_filters(spark, hills):
    pad = np.pad(hills, 1, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(pad, (3, 3)).reshape(*hills.shape, 9)
    assert np.array_equal(dense(focal.median3(pixels(spark, hills)), "median", hills.shape), np.sort(view, -1)[..., 4])
    assert np.array_equal(dense(focal.percentile_filter(pixels(spark, hills), 3, 20), "rank", hills.shape), np.sort(view, -1)[..., 1])


def test_slope_of_a_plane(spark):
    a = np.add.outer(np.arange(9) * 1.0, np.arange(7) * 1.0)
    got = dense(focal.slope_deg(pixels(spark, a), 1.0), "slope", a.shape)
    assert np.allclose(got, math.degrees(math.atan(math.sqrt(2))))


def test_opening_takes_towers_and_keeps_blocks(spark):
    a = np.zeros((30, 30))
    a[4:6, 4:6], a[12:24, 12:24] = 9, 5
    got = dense(focal.opening(pixels(spark, a), 5), "opened", a.shape)
    assert got[4:6, 4:6].max() == 0 and got[12:24, 12:24].min() == 5


def test_debias_leaves_hills_and_takes_roofs(spark):
    y, x = np.mgrid[0:60, 0:60]
    hill = 60 * np.exp(-((y - 30) ** 2 + (x - 30) ** 2) / 800)
    roofs = hill.copy()
    roofs[10:13, 10:13] += 3
    t = focal.debias(pixels(spark, roofs), 7)
    assert dense(t, "correction", hill.shape)[11, 11] > 1.0
    assert dense(focal.debias(pixels(spark, hill), 7), "correction", hill.shape).max() <= 5


def test_surfaces_add_up(spark, hills):
    t = local.surfaces(pixels(spark, hills, "terrain").withColumn("detail", F.col("r") - F.lit(18.0)), 2.0)
    assert t.filter((F.abs(F.col("dtm") + F.col("ndsm") - F.col("height")) > 1e-9) | (F.col("ndsm") < 0)).count() == 0


def test_a_uniform_frame_masks_nothing(spark):
    t = spark.range(100).select(F.lit("s").alias("scene"), (F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"), F.lit(90).alias("red"), F.lit(90).alias("green"), F.lit(90).alias("blue"))
    assert local.cloud_shadow_mask(t).filter("valid").count() == 100


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_pixels_at_the_limit_of_a_mask(spark, monkeypatch, most):
    """The quarters of these greys lie between two of them, and the upper limit is 112 but for rounding: the same by rank as in the built-in percentile and in SQL."""
    kept = local.quantiles
    monkeypatch.setattr(local, "quantiles", lambda df, by, **wanted: kept(df, by, most, **wanted))
    grey = [72, 63, 53, 52, 123, 153, 112, 46, 53, 63]
    t = spark.createDataFrame([("s", 0, i, v, v, v) for i, v in enumerate(grey)], "scene string, r int, c int, red int, green int, blue int")
    got = local.cloud_shadow_mask(t, reach=1.0, max_sat=0.4).filter("not valid")
    assert sorted(x.red for x in got.collect()) == [112, 123, 153]


def test_best_gain(spark):
    t = spark.range(2000).select(F.lit("s").alias("scene"), (F.col("id") % 40 + 1).cast("double").alias("ref")).withColumn("pred", F.col("ref") * 0.7)
    r = metrics.attenuation(t, ["scene"]).first()
    assert r.gain == pytest.approx(1 / 0.7) and r.improves and r.rmse_at_gain == pytest.approx(0, abs=1e-5)


def test_metrics_of_few_and_of_flat(spark):
    few = spark.createDataFrame([("a", 1.0, 2.0)] * 9 + [("b", 1.0, 1.0)] * 20, "k string, pred double, ref double")
    got = {r.k: r for r in metrics.metrics(few, ["k"]).collect()}
    assert got["a"].rmse is None and got["a"].note
    assert got["b"].rmse == 0 and got["b"].r is None


def test_metrics_do_not_depend_on_partitions(spark):
    t = spark.range(500).select((F.col("id") % 3).alias("k"), F.sin(F.col("id")).alias("pred"), F.cos(F.col("id") * 0.9).alias("ref"))
    a, b = ({r.k: r for r in metrics.metrics(x, ["k"]).collect()} for x in (t.repartition(1), t.repartition(7)))
    assert all(a[k][c] == pytest.approx(b[k][c], rel=1e-9) for k in a for c in ("rmse", "nmad", "le90", "r"))


def test_robust_affine_ignores_outliers(spark):
    t = spark.range(400).select(F.lit("s").alias("k"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 20 == 0, 5000.0).otherwise(F.col("id") * 2.0 + 7).alias("y"))
    r = robust.affine(t, ["k"], rounds=30).first()
    assert r.a == pytest.approx(2, abs=0.02) and r.b == pytest.approx(7, abs=3)


def test_affine_scores_by_group(spark):
    rows = [(k, float(x), None if x == 3 else g * x + o) for k, g, o in (("s", 2.0, 7.0), ("t", 0.5, -1.0)) for x in range(40)] + [("few", 1.0, 4.0)]
    got = {r.k: r for r in robust.affine_scores(spark.createDataFrame(rows, "k string, pred double, ref double"), ["k"]).collect()}
    assert {k: r.n for k, r in got.items()} == {"s": 39, "t": 39, "few": 1}
    assert got["s"].rmse_affine == pytest.approx(0, abs=1e-6) and got["t"].rmse_affine == pytest.approx(0, abs=1e-6)
    assert got["s"].rmse_raw > 7 and got["few"].rmse_affine == got["few"].rmse_raw == 3


@pytest.mark.parametrize("y", [0.0, 3.0])
def test_degenerate_fits_are_refused(spark, y):
    t = spark.createDataFrame([("s", 1.0, y)] * 30, "k string, x double, y double")
    assert tuple(robust.affine(t, ["k"]).first()) == ("s", 1.0, 0.0)


def test_detrend_takes_a_tilt_off(spark):
    a = np.add.outer(np.arange(20) * 0.5, np.arange(30) * -0.2) + 3
    got = dense(robust.detrend(pixels(spark, a)), "flat", a.shape)
    assert np.abs(got).max() < 1e-9


def evidence(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], "scene string, source string, alpha double, sigma_rel double")


def test_scale_fusion(spark):
    f = lambda *rows: scale.fuse(evidence(spark, *rows), ["scene"]).first()
    assert f(("a", 2.0, 0.5), ("b", 0.5, 0.5)).alpha == pytest.approx(1.0)
    assert f(("a", 2.0, 0.1), ("b", 1.8, 0.1)).alpha == pytest.approx(math.sqrt(3.6))
    assert abs(f(("a", 2.0, 0.02), ("b", 2.5, 0.25)).alpha - 2.0) < 0.01
    bad = f(("a", 3.0, 0.05), ("b", 9.0, 0.10))
    assert bad.alpha is None and bad.reason == "sources disagree" and bad.worst_pair == "a/b"
    one = f(("a", 3.0, 0.05), ("b", -1.0, 0.10))
    assert one.sources == 1 and one.alpha is None


def test_scale_from_points(spark):
    a = np.zeros((64, 64))
    a[10:20, 10:20], a[40:50, 40:50] = 0.4, 0.2
    ground = pixels(spark, a)
    p = lambda *rows: scale.from_points(ground, spark.createDataFrame([("s", *r) for r in rows], "scene string, r int, c int, h double")).first()
    assert p((15, 15, 40.0), (45, 45, 20.0)).alpha == pytest.approx(100, abs=1)
    assert p((15, 15, -40.0), (45, 45, -20.0)).alpha is None


def test_pixel_fusion(spark):
    t = spark.createDataFrame([(10.0, 1.0, 20.0, 3.0)], "a_h double, a_sig double, b_h double, b_sig double")
    assert fusion.inverse_variance(t, (1.0, 1.0)).first().h == pytest.approx(11.0)
    assert fusion.inverse_variance(t, (3.0, 1.0)).first().h == pytest.approx(15.0)


def test_linear_data_has_no_cross_validation_error(spark):
    t = spark.range(50).select(F.lit("s").alias("g"), F.col("id").alias("k"), (F.col("id") + 1.0).alias("x"), ((F.col("id") + 1.0) * 3).alias("y"))
    assert scale.kfold_ratio(t, ["g"], "k").first().rmse == pytest.approx(0, abs=1e-9)


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((40, 64)) < 0.55
    px = pixels(spark, np.where(mask, 1.0, np.nan)).filter("z is not null")
    got = {(r.r, r.c): r.label for r in zonal.components(px).collect()}
    seen, n = {}, 0
    for start in got:
        if start in seen:
            continue
        n += 1
        stack = [start]
        while stack:
            p = stack.pop()
            if p in seen or p not in got:
                continue
            seen[p] = n
            stack += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    assert len({(seen[p], got[p]) for p in got}) == n == len(set(got.values()))


def test_profile_of_a_ramp(spark):
    a = np.tile(np.arange(40) * 1.0, (10, 1))
    px = pixels(spark, a)
    line = spark.createDataFrame([("l", "s", 5, 0, 5, 20)], "line string, scene string, r0 int, c0 int, r1 int, c1 int")
    z = {r.i: r.z for r in resample.bilinear(px, resample.line(line, 41), resample.dims_of(px)).collect()}
    assert z[40] - z[0] == pytest.approx(20) and z[1] == pytest.approx(0.5)


def test_tile_ids(spark):
    t = spark.createDataFrame([("edge", 10.0, 999.0, 8999000.0, 9000000.0 - 1)], "id string, left double, right double, bottom double, top double")
    assert {r.tile for r in records.tile_ids(t, -18041000.0, 9000000.0, 1e6, 36, 18).collect()} == {"R1_C19"}


def test_alike_boxes_spread_over_tasks(spark):
    box = lambda n, *at: spark.range(n).select("id", *[F.lit(x).cast("int").alias(k) for k, x in zip(("left", "bottom", "right", "top"), at)])
    boxes = box(3000, 1, 1, 3, 4).unionByName(box(1, 0, 9, 30, 12).withColumn("id", F.lit(5000).cast("long"))).unionByName(box(1, None, 1, 3, 4).withColumn("id", F.lit(6000).cast("long")))
    areas = box(3000, 0, 0, 9, 11).unionByName(box(1, -25, -3, 31, 13).withColumn("id", F.lit(7000).cast("long")))
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in kept:
        spark.conf.set(k, "-1")
    t = records.contained(boxes, areas, 10.0)
    parts = [n for (n,) in t.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(parts) == 3000 * 3001 + 1 and max(parts) < sum(parts) / 2
    assert t.filter("box >= 3000").collect() == [(5000, 7000)]
    assert t.distinct().count() == sum(parts)


def test_protected_values_survive(spark):
    old = spark.createDataFrame([("a", 15, "by hand"), ("b", None, "by hand")], "scene string, height int, note string")
    new = spark.createDataFrame([("a", 9, "fetched"), ("b", 8, "fetched"), ("c", 7, "fetched")], "scene string, height int, note string")
    got = {r.scene: (r.height, r.note) for r in records.merge_protected(old, new, "scene", ["height"]).collect()}
    assert got == {"a": (15, "fetched"), "b": (8, "fetched"), "c": (7, "fetched")}


def test_four_quarter_turns_are_none(spark, hills):
    t = pixels(spark, hills)
    for _ in range(4):
        t = scalars.rotated(t, 1)
    assert np.array_equal(dense(t, "z", hills.shape), hills)


def test_holes_are_filled_from_the_nearest(spark):
    a = np.arange(25.0).reshape(5, 5)
    a[2, 2] = np.nan
    assert dense(zonal.nearest_fill(pixels(spark, a), 2), "z", a.shape)[2, 2] == a[1, 2]


def test_wide_holes_are_filled_from_the_nearest_however_far(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(0, 1, (23, 31))
    a[3:19, 4:25] = np.nan
    a[20:, 28:] = np.nan
    a[10, 14] = 9.0
    rows, cols = np.nonzero(~np.isnan(a))
    want = a.copy()
    for r, c in zip(*np.nonzero(np.isnan(a)), strict=True):
        k = np.lexsort((cols, rows, (rows - r) ** 2 + (cols - c) ** 2))[0]
        want[r, c] = a[rows[k], cols[k]]
    t = pixels(spark, a)
    assert np.array_equal(dense(zonal.nearest_fill(t, 2), "z", a.shape), want)
    sparse = t.filter("z is not null or (r = 9 and c = 8) or (r = 12 and c = 13)").filter("r > 11 or z is null")
    got = {(x.r, x.c): x.z for x in zonal.nearest_fill(sparse, 2).collect()}
    for r, c in ((9, 8), (12, 13)):
        k = min((int((i - r) ** 2 + (j - c) ** 2), int(i), int(j)) for i, j in zip(rows, cols, strict=True) if i > 11)
        assert got[r, c] == a[k[1], k[2]]
    none = zonal.nearest_fill(pixels(spark, np.full((3, 9), np.nan)), 2)
    assert none.filter("z is null").count() == 27


def test_quantiles_by_rank_are_the_built_in_ones(spark):
    from orograph.functions.ranks import quantiles

    rows = [(s, None if i % 17 == 3 else float((i * 7919) % 101)) for s, n in (("a", 500), ("b", 1), ("c", 333), (None, 40)) for i in range(n)] + [("d", None)]
    df = spark.createDataFrame(rows, "scene string, z double").repartition(5)
    one = {r.scene: (r.m, r.q) for r in quantiles(df, ["scene"], m=("z", 0.5), q=("z", 0.01, 0.9)).collect()}
    two = {r.scene: (r.m, r.q) for r in quantiles(df, ["scene"], most=0, m=("z", 0.5), q=("z", 0.01, 0.9)).collect()}
    assert set(one) == set(two) == {"a", "b", "c", "d", None}
    for k, (m, q) in one.items():
        assert two[k][0] == (None if m is None else pytest.approx(m))
        assert (two[k][1] or []) == pytest.approx(q or [])


def test_structure_width_of_blocks(spark):
    from orograph.operators import zonal

    inside = lambda r, c: 5 <= r < 14 and 5 <= c < 30 or 20 <= r < 23 and 3 <= c < 60
    rows = [(s, r, c, inside(r, c)) for s in ("x", "y") for r in range(40) for c in range(64)]
    df = spark.createDataFrame(rows, "scene string, r int, c int, inside boolean")
    far = {(r.r, r.c): r.distance for r in zonal.distance(df.filter("scene = 'x'")).collect()}
    assert far[9, 17] == 5.0 and far[5, 5] == 1.0 and far[21, 30] == 2.0 and far[0, 0] == 0.0
    got = {r.scene: r.width for r in zonal.structure_width(df).collect()}
    assert got == {"x": 10.0, "y": 10.0}


def test_triangulation_of_awkward_rings():
    from orograph.operators.structures import doubled_area, triangulated

    comb = [(0, 0), (9, 0), (9, 5), (8, 1), (7, 5), (6, 1), (5, 5), (4, 1), (3, 5), (2, 1), (0, 5)]
    for ring in (comb, comb[::-1], [(0, 0), (0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 0), (2, 0), (4, 0), (4, 3), (0, 3)]):
        whole = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])))
        assert sum(doubled_area(*(ring[i] for i in t)) for t in triangulated(ring)) == pytest.approx(whole)
    assert triangulated([]) == triangulated([(1, 1)]) == triangulated([(0, 0), (1, 1), (2, 2), (3, 3)]) == []

"""Queries of robust fits, scale calibration and fusion, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.tables import load
from orograph.operators import fusion, local, robust, scale
from orograph.plans.base import G, HOLED, PR, RGB, six, sql6
from orograph.plans.rasters import LUMA601
from orograph.sources import adapters as a

HONESTY, WEIGHTS = (1.1, 0.9), [0.8, 0.6, 0.4, 0.2]


def robust_affine_irls(spark, d):
    t = a.pred_ref(a.holed(a.grid(spark, d)))
    return six(robust.affine(t.select("scene", F.col("pred").alias("x"), F.col("ref").alias("y")), ["scene"]))


def alignment_affine(spark, d):
    return six(robust.affine_scores(a.pred_ref(a.holed(a.grid(spark, d))), ["scene"]))


def detrend_plane_irls(spark, d):
    return six(robust.plane(a.grid(spark, d)))


def ground_level_histogram(spark, d):
    return six(scale.ground_level(a.grid(spark, d)))


def scale_known_height(spark, d):
    t = a.grid(spark, d)
    out = None
    for ref in scale.REFERENCE:
        one = scale.known_height(t, 40.0, ref).withColumn("reference", F.lit(ref))
        out = one if out is None else out.unionByName(one)
    return six(out)


def scale_gcps(spark, d):
    t = a.grid(spark, d)
    k = F.col("r") * 64 + F.col("c")
    points = t.filter(k % 37 == 0).select("scene", "r", "c", (F.lit(80.0) * F.col("z") + F.lit(3.0) + (k % 5).cast("double")).alias("h"))
    return six(scale.from_points(t, points))


def scale_learned_prior(spark, d):
    t = a.grid(spark, d).withColumn("metric", F.lit(60.0) * F.col("z") + F.lit(0.5))
    return six(scale.learned(t, "z", "metric"))


def ghsl_prior(spark, d):
    p = load(spark, d, "part")
    return six(scale.built_prior(p.select(F.col("p_brand").alias("region"), ((F.col("p_retailprice") - F.lit(1000.0)) / F.lit(50.0)).alias("h")), ["region"]))


def _evidence(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("scene"))
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.lit(1.0) + F.avg("s_acctbal") / F.lit(10000.0)).alias("alpha"))
    c = load(spark, d, "customer")
    g = c.groupBy(F.col("c_nationkey").alias("k")).agg((F.lit(1.0) + F.avg("c_acctbal") / F.lit(10000.0)).alias("alpha"))
    o = load(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg((F.avg("o_totalprice") / F.lit(100000.0)).alias("alpha"))
    out = None
    for name, t, sigma in (("prior", s, 0.25), ("gcp", g, 0.05), ("shadow", o, 0.2)):
        one = n.join(t, n["n_nationkey"] == t["k"]).select("scene", F.lit(name).alias("source"), "alpha", F.lit(sigma).alias("sigma_rel"))
        out = one if out is None else out.unionByName(one)
    return out


def scale_cross_check(spark, d):
    return six(scale.cross_check(_evidence(spark, d), ["scene"]))


def scale_fusion(spark, d):
    return six(scale.fuse(_evidence(spark, d), ["scene"]))


def kfold_ratio_cv(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("y"), (F.lit(1000.0) + F.col("o_custkey") % 97).alias("x"))
    return six(scale.kfold_ratio(t, ["g"], "k"))


def _two(spark, d):
    t = a.grid(spark, d)
    k = F.col("r") * 64 + F.col("c")
    return t.select("scene", "r", "c", (F.lit(60.0) * F.abs("z")).alias("y"), (F.lit(60.0) * F.abs("z") + ((k % 7) - 3).cast("double")).alias("a_h"), F.when(k % 10 != 0, F.lit(0.2) + (k % 4).cast("double")).alias("a_sig"), (F.lit(55.0) * F.abs("z") + ((k % 5) - 2).cast("double")).alias("b_h"), (F.lit(0.1) + (k % 3).cast("double")).alias("b_sig"))


def pixel_fusion_ivw(spark, d):
    return six(fusion.inverse_variance(_two(spark, d), HONESTY).select("scene", "r", "c", "h", "sigma"))


def pixel_fusion_stacked(spark, d):
    return six(fusion.stacked(_two(spark, d), WEIGHTS, HONESTY).select("scene", "r", "c", "h", "sigma"))


def fusion_calibration(spark, d):
    return six(fusion.calibrate(_two(spark, d)))


def _passes(spark, d):
    t = a.grid(spark, d)
    k = F.col("r") * 64 + F.col("c")
    one = t.select("scene", "r", "c", "z", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("pass"))
    return one.withColumn("z", F.col("z") * (F.col("pass") + 1) + F.col("pass") * F.lit(0.5) + ((k * (F.col("pass") + 3)) % 11).cast("double") * F.lit(0.01)).withColumn("s", F.lit(0.1) + (k % 3).cast("double") * F.lit(0.05))


def rotation_ensemble(spark, d):
    return six(fusion.ensemble(_passes(spark, d)))


def welford_uncertainty(spark, d):
    return six(fusion.merged_uncertainty(_passes(spark, d)))


def confidence_report(spark, d):
    t = a.grid(spark, d)
    return six(fusion.confidence(t.withColumn("spread", F.when((F.col("r") + F.col("c")) % 5 != 0, F.abs("z")).otherwise(F.lit(0.0)))))


def depth_sanity(spark, d):
    t = a.grid(spark, d)
    rgb = a.rgb(t).select("scene", "r", "c", local.luma601(F.col("red"), F.col("green"), F.col("blue")).alias("luma"))
    return six(fusion.sanity(a.holed(t).join(rgb, ["scene", "r", "c"]), 3))


def informative_test(spark, d):
    return six(fusion.informative(a.grid(spark, d).withColumn("scene", F.col("label").cast("string"))))


def ground_consistency(spark, d):
    return six(fusion.ground_consistency(a.grid(spark, d)))


QUERIES = [robust_affine_irls, alignment_affine, detrend_plane_irls, ground_level_histogram, scale_known_height, scale_gcps, scale_learned_prior, ghsl_prior, scale_cross_check, scale_fusion, kfold_ratio_cv,
           pixel_fusion_ivw, pixel_fusion_stacked, fusion_calibration, rotation_ensemble, welford_uncertainty, confidence_report, depth_sanity, informative_test, ground_consistency]


def _irls_rounds(first: str, fit, residual: str, rounds: int) -> str:
    """A chain of CTEs: w0 has weights of one; round i fits c{i} and weighs w{i}."""
    out = [f"w0 AS (SELECT *, 1.0::DOUBLE AS k FROM {first})"]
    for i in range(1, rounds + 1):
        out += [fit(i), f"r{i} AS (SELECT w.* EXCLUDE (k), {residual} AS res FROM w{i - 1} w, c{i} f)", f"m{i} AS (SELECT quantile_cont(res, 0.5) AS m FROM r{i})",
                f"s{i} AS (SELECT 1.4826::DOUBLE * quantile_cont(abs(res - m), 0.5) + 1e-9 AS s FROM r{i}, m{i})", f"w{i} AS (SELECT r{i}.* EXCLUDE (res), 1 / (1 + (res / (2 * s)) * (res / (2 * s))) AS k FROM r{i}, s{i})"]
    return ", ".join(out)


def _affine(i: int) -> str:
    return f"""n{i} AS (SELECT sum(k) AS n, sum(k * x) AS x, sum(k * y) AS y, sum(k * x * x) AS xx, sum(k * x * y) AS xy FROM w{i - 1}),
c{i} AS (SELECT (xy * n - x * y) / (xx * n - x * x) AS a, (xx * y - x * xy) / (xx * n - x * x) AS b FROM n{i})"""


def _plane(i: int) -> str:
    d = "(xx * (yy * n - sy * sy) - xy * (xy * n - sy * sx) + sx * (xy * sy - yy * sx))"
    return f"""n{i} AS (SELECT sum(k) AS n, sum(k * x) AS sx, sum(k * y) AS sy, sum(k * z) AS sz, sum(k * x * x) AS xx, sum(k * y * y) AS yy, sum(k * x * y) AS xy, sum(k * x * z) AS xz, sum(k * y * z) AS yz FROM w{i - 1}),
c{i} AS (SELECT (xz * (yy * n - sy * sy) - xy * (yz * n - sy * sz) + sx * (yz * sy - yy * sz)) / {d} AS p, (xx * (yz * n - sy * sz) - xz * (xy * n - sy * sx) + sx * (xy * sz - yz * sx)) / {d} AS q,
 (xx * (yy * sz - yz * sy) - xy * (xy * sz - yz * sx) + xz * (xy * sy - yy * sx)) / {d} AS o FROM n{i})"""


GROUND = """q AS (SELECT quantile_cont(z, 0.005) AS lo, quantile_cont(z, 0.995) AS hi, quantile_cont(z, 0.1) AS p10 FROM g),
hb AS (SELECT least(floor((z - lo) / greatest((hi - lo) / 256, 1e-12)), 255)::INT AS bin, count(*) AS n FROM g, q WHERE z >= lo AND z <= hi GROUP BY 1),
sp AS (SELECT b AS bin, coalesce(n, 0)::DOUBLE AS n FROM (SELECT unnest(range(256))::INT AS b) x LEFT JOIN hb ON b = bin),
kw AS (SELECT d::INT AS d, exp(-0.5::DOUBLE * (d / 3.0::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (d / 3.0::DOUBLE) ** 2)) OVER () AS w FROM (SELECT unnest(range(-12, 13)) AS d)),
sm AS (SELECT a.bin, sum(w * b.n) AS s FROM sp a CROSS JOIN kw JOIN sp b ON b.bin = CASE WHEN a.bin + d < 0 THEN -1 - (a.bin + d) WHEN a.bin + d >= 256 THEN 511 - (a.bin + d) ELSE a.bin + d END GROUP BY a.bin),
pk AS (SELECT *, lag(s) OVER (ORDER BY bin) AS l, lead(s) OVER (ORDER BY bin) AS n, max(s) OVER () AS m FROM sm),
fp AS (SELECT min(bin) AS i FROM pk WHERE s > l AND s >= n AND s > 0.2::DOUBLE * m),
gl AS (SELECT coalesce(lo + (i + 0.5::DOUBLE) * (hi - lo) / 256, p10) AS ground FROM q, fp)"""
EVIDENCE = """ev AS (SELECT n_name AS scene, 'prior' AS source, 1.0 + avg(s_acctbal) / 10000.0::DOUBLE AS alpha, 0.25::DOUBLE AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT n_name, 'gcp', 1.0 + avg(c_acctbal) / 10000.0::DOUBLE, 0.05::DOUBLE FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT n_name, 'shadow', avg(o_totalprice) / 100000.0::DOUBLE, 0.2::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
e AS (SELECT * FROM ev WHERE alpha > 0)"""
TWO = """two AS (SELECT scene, r, c, 60.0::DOUBLE * abs(z) AS y, 60.0::DOUBLE * abs(z) + ((r * 64 + c) % 7 - 3)::DOUBLE AS a_h, CASE WHEN (r * 64 + c) % 10 <> 0 THEN 0.2::DOUBLE + ((r * 64 + c) % 4)::DOUBLE END AS a_sig,
 55.0::DOUBLE * abs(z) + ((r * 64 + c) % 5 - 2)::DOUBLE AS b_h, 0.1::DOUBLE + ((r * 64 + c) % 3)::DOUBLE AS b_sig FROM g),
 tv AS (SELECT *, (1.1::DOUBLE * greatest(coalesce(a_sig, 1e3), 0.3)) ** 2 AS va, (0.9::DOUBLE * greatest(coalesce(b_sig, 1e3), 0.3)) ** 2 AS vb, CASE WHEN b_h >= 30 THEN 0.2::DOUBLE WHEN b_h >= 10 THEN 0.4::DOUBLE WHEN b_h >= 2 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS wa FROM two)"""
PASSES = """ps AS (SELECT scene, r, c, pass, z * (pass + 1) + pass * 0.5::DOUBLE + (((r * 64 + c) * (pass + 3)) % 11)::DOUBLE * 0.01::DOUBLE AS z, 0.1::DOUBLE + ((r * 64 + c) % 3)::DOUBLE * 0.05::DOUBLE AS s FROM g CROSS JOIN (SELECT unnest(range(4))::INT AS pass))"""
PX = "scene r c"
ORACLE = {
    "robust_affine_irls": sql6(f"WITH {G}, {HOLED}, {PR}, p0 AS (SELECT pred AS x, ref AS y FROM pr WHERE pred IS NOT NULL), {_irls_rounds('p0', _affine, 'y - a * x - b', 5)} SELECT 'g' AS scene, a, b FROM c5", "a b", "scene"),
    "alignment_affine": sql6(f"WITH {G}, {HOLED}, {PR}, p0 AS (SELECT pred AS x, ref AS y FROM pr WHERE pred IS NOT NULL), {_irls_rounds('p0', _affine, 'y - a * x - b', 5)} SELECT 'g' AS scene, a, b, count(*) AS n, sqrt(avg((x - y) ** 2)) AS rmse_raw, sqrt(avg((a * x + b - y) ** 2)) AS rmse_affine FROM p0 CROSS JOIN c5 GROUP BY a, b", "a b rmse_raw rmse_affine", "scene n"),
    "detrend_plane_irls": sql6(f"WITH {G}, d AS (SELECT max(r) / 2.0::DOUBLE AS h, max(c) / 2.0::DOUBLE AS w FROM g), p0 AS (SELECT (c - w) / greatest(w, 1) AS x, (r - h) / greatest(h, 1) AS y, z FROM g, d), {_irls_rounds('p0', _plane, 'z - p * x - q * y - o', 3)} SELECT 'g' AS scene, p, q, o FROM c3", "p q o", "scene"),
    "ground_level_histogram": sql6(f"WITH {G}, {GROUND} SELECT 'g' AS scene, ground FROM gl", "ground", "scene"),
    "scale_known_height": sql6(f"WITH {G}, t AS (SELECT unnest(['tallest', 'tall', 'typical']) AS reference, unnest([0.99, 0.95, 0.60]) AS p), q AS (SELECT 'tallest' AS reference, quantile_cont(z, 0.99) AS q FROM g UNION ALL SELECT 'tall', quantile_cont(z, 0.95) FROM g UNION ALL SELECT 'typical', quantile_cont(z, 0.60) FROM g) SELECT 'g' AS scene, reference, 40.0::DOUBLE / greatest(quantile_cont(z, 0.5), 1e-9) AS alpha FROM g JOIN q ON z >= q GROUP BY reference", "alpha", "scene reference"),
    "scale_gcps": sql6(f"WITH {G}, {GROUND}, p AS (SELECT z - ground AS x, 80.0::DOUBLE * z + 3.0::DOUBLE + ((r * 64 + c) % 5)::DOUBLE AS h FROM g, gl WHERE (r * 64 + c) % 37 = 0 AND abs(z - ground) > 1e-9), s AS (SELECT count(*) AS n, sum(x * x) AS sxx, sum(x * h) AS sxy, sum(h * h) AS syy FROM p), a AS (SELECT *, sxy / greatest(sxx, 1e-12) AS a FROM s), e AS (SELECT *, CASE WHEN n < 2 OR sxx < 1e-12 THEN 'too few control points' WHEN a <= 0 THEN 'control points imply a scale that is not positive' END AS reason FROM a) SELECT 'g' AS scene, n, reason, CASE WHEN reason IS NULL THEN a END AS alpha, CASE WHEN reason IS NULL THEN least(greatest(sqrt(greatest(syy - 2 * a * sxy + a * a * sxx, 0) / greatest(n - 1, 1)) / sqrt(greatest(sxx, 1e-12)) / a, 0.05), 2) END AS sigma_rel FROM e", "alpha sigma_rel", "scene n reason"),
    "scale_learned_prior": sql6(f"WITH {G}, m AS (SELECT quantile_cont(z, [0.9, 0.95, 0.98, 0.99, 0.995]) AS d, quantile_cont(60.0::DOUBLE * z + 0.5::DOUBLE, [0.9, 0.95, 0.98, 0.99, 0.995]) AS m FROM g), p AS (SELECT unnest(d) AS d, unnest(m) AS m FROM m) SELECT 'g' AS scene, count(*) AS used, quantile_cont(m / d, 0.5) AS alpha FROM p WHERE d > 1e-9 AND m > 1", "alpha", "scene used"),
    "ghsl_prior": sql6("WITH c AS (SELECT p_brand AS region, (p_retailprice - 1000.0::DOUBLE) / 50.0::DOUBLE AS h FROM part) SELECT region, count(h) AS n_cells, count(*) FILTER (h >= 3) AS n_built, CASE WHEN count(*) FILTER (h >= 3) > 0 THEN floor(quantile_cont(h, 0.95) FILTER (h >= 3) * 10 + 0.5) / 10 END AS prior, avg(h) FILTER (h >= 3) AS built_mean, max(h) AS built_max, CASE WHEN count(h) = 0 THEN 'no cells' WHEN count(*) FILTER (h >= 3) = 0 THEN 'nothing built' END AS reason FROM c GROUP BY region", "prior built_mean built_max", "region n_cells n_built reason"),
    "scale_cross_check": sql6(f"WITH {EVIDENCE}, t AS (SELECT scene, count(*) AS sources, min(alpha) AS lo, max(alpha) AS hi, quantile_cont(alpha, 0.5) AS mid FROM e GROUP BY scene) SELECT scene, sources, CASE WHEN sources >= 2 THEN hi / lo END AS spread, CASE WHEN sources >= 2 THEN 100.0 * lo / hi END AS agreement_pct, CASE WHEN sources >= 2 THEN mid END AS alpha FROM t", "spread agreement_pct alpha", "scene sources"),
    "scale_fusion": sql6(f"WITH {EVIDENCE}, o AS (SELECT scene, count(*) AS sources, sum(ln(alpha) / (s * s)) AS wl, sum(1 / (s * s)) AS w, arg_min(source, s) AS tightest FROM e GROUP BY scene), p AS (SELECT a.scene, abs(ln(a.alpha) - ln(b.alpha)) / sqrt(a.s ** 2 + b.s ** 2) AS z, a.source || '/' || b.source AS pair FROM e a JOIN e b ON a.scene = b.scene AND a.source < b.source), w AS (SELECT scene, max(z) AS worst_z, arg_max(pair, z) AS worst_pair FROM p GROUP BY scene), t AS (SELECT *, sources >= 2 AND worst_z <= 3 AS ok FROM o LEFT JOIN w USING (scene)) SELECT scene, sources, worst_z, coalesce(worst_pair, '') AS worst_pair, tightest, CASE WHEN ok THEN exp(wl / w) END AS alpha, CASE WHEN ok THEN 1 / sqrt(w) END AS sigma_rel, CASE WHEN sources < 2 THEN 'one source' WHEN NOT ok THEN 'sources disagree' END AS reason FROM t", "worst_z alpha sigma_rel", "scene sources worst_pair tightest reason"),
    "kfold_ratio_cv": sql6("WITH t AS (SELECT o_orderpriority AS g, o_totalprice AS y, 1000.0::DOUBLE + o_custkey % 97 AS x, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 5 AS fold FROM orders), f AS (SELECT unnest(range(5)) AS held), tr AS (SELECT g, held, quantile_cont(y / x, 0.5) AS a FROM t JOIN f ON fold <> held GROUP BY ALL), e AS (SELECT t.g, a * x - y AS e, y / x AS ratio FROM t JOIN tr ON t.g = tr.g AND fold = held), q AS (SELECT g, count(*) AS n, sqrt(avg(e ** 2)) AS rmse, avg(abs(e)) AS mae, avg(e) AS bias, quantile_cont(abs(e), 0.9) AS p90_abs, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.5) AS q2, quantile_cont(ratio, 0.75) AS q3 FROM e GROUP BY g), m AS (SELECT e.g, quantile_cont(abs(ratio - q2), 0.5) AS mad FROM e JOIN q USING (g) GROUP BY e.g) SELECT g, n, rmse, mae, bias, p90_abs, q3 / greatest(q1, 1e-9) AS iqr_ratio, least(greatest(1.253::DOUBLE * 1.4826::DOUBLE * mad / greatest(abs(q2), 1e-9) / sqrt(n), 0.01), 2) AS sigma_rel FROM q JOIN m USING (g) WHERE n >= 10", "rmse mae bias p90_abs iqr_ratio sigma_rel", "g n"),
    "pixel_fusion_ivw": sql6(f"WITH {G}, {TWO} SELECT scene, r, c, (1 - va / (va + vb)) * a_h + va / (va + vb) * b_h AS h, sqrt(va * vb / (va + vb)) AS sigma FROM tv", "h sigma", PX),
    "pixel_fusion_stacked": sql6(f"WITH {G}, {TWO} SELECT scene, r, c, wa * a_h + (1 - wa) * b_h AS h, sqrt(wa * wa * va + (1 - wa) * (1 - wa) * vb) AS sigma FROM tv", "h sigma", PX),
    "fusion_calibration": sql6(f"WITH {G}, {TWO}, t AS (SELECT CASE WHEN b_h >= 30 THEN 3 WHEN b_h >= 10 THEN 2 WHEN b_h >= 2 THEN 1 ELSE 0 END AS band, * FROM two) SELECT band, count(*) AS n, quantile_cont(abs(a_h - y) / greatest(coalesce(a_sig, 0.3), 0.3), 0.5) / 0.6745::DOUBLE AS c_a, quantile_cont(abs(b_h - y) / greatest(b_sig, 0.3), 0.5) / 0.6745::DOUBLE AS c_b, CASE WHEN count(*) > 500 THEN least(greatest(sum((b_h - y) * (b_h - a_h)) / greatest(sum((b_h - a_h) * (b_h - a_h)), 1e-9), 0), 1) END AS w_a FROM t GROUP BY band", "c_a c_b w_a", "band n"),
    "rotation_ensemble": sql6(f"WITH {G}, {PASSES}, m AS (SELECT pass, quantile_cont(z, 0.5) AS m FROM ps GROUP BY pass), d AS (SELECT pass, m, 1.4826::DOUBLE * quantile_cont(abs(z - m), 0.5) AS s FROM ps JOIN m USING (pass) GROUP BY ALL), f AS (SELECT m AS m0, s AS s0 FROM d WHERE pass = 0), x AS (SELECT scene, r, c, (z - m) / greatest(d.s, 1e-9) * s0 + m0 AS z FROM ps JOIN d USING (pass), f) SELECT scene, r, c, avg(z) AS mean, stddev_pop(z) AS spread FROM x GROUP BY ALL", "mean spread", PX),
    "welford_uncertainty": sql6(f"WITH {G}, {PASSES} SELECT scene, r, c, avg(z) AS mean, sqrt(avg(s * s) + var_pop(z)) AS sigma FROM ps GROUP BY ALL", "mean sigma", PX),
    "confidence_report": sql6(f"WITH {G}, t AS (SELECT z, CASE WHEN (r + c) % 5 <> 0 AND abs(z) > 0 THEN abs(z) END AS s FROM g) SELECT 'g' AS scene, quantile_cont(s, 0.5) AS median_spread, quantile_cont(s, 0.9) AS p90_spread, 100.0 * quantile_cont(s, 0.5) / greatest(quantile_cont(z, 0.99) - quantile_cont(z, 0.01), 1e-9) AS pct_of_range FROM t", "median_spread p90_spread pct_of_range", "scene"),
    "depth_sanity": sql6(f"WITH {G}, {HOLED}, {RGB}, t AS (SELECT h.z, CASE WHEN (h.r * 64 + h.c) % 3 = 0 THEN h.z END AS q, {LUMA601} AS l FROM h JOIN rgb USING (scene, r, c)) SELECT 'g' AS scene, avg((z IS NOT NULL)::INT) AS finite, var_pop(z) < 1e-12 AS flat, corr(l, q) AS r, coalesce(corr(l, q), 0) < -0.3 AS inverted FROM t", "finite r", "scene flat inverted"),
    "informative_test": sql6(f"WITH {G} SELECT label::VARCHAR AS scene, count(z) AS n, stddev_pop(z) AS sd, count(z) >= 100 AND stddev_pop(z) > 1e-4 AND stddev_pop(z) > 1e-3 * abs(avg(z)) AS informative FROM g GROUP BY label", "sd", "scene n informative"),
    "ground_consistency": sql6(f"WITH {G}, d AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w, quantile_cont(z, 0.01) AS a, quantile_cont(z, 0.99) AS b FROM g), t AS (SELECT floor(r * 4 / h) AS i, floor(c * 4 / w) AS j, quantile_cont(z, 0.15) AS p, count(*) AS n FROM g, d GROUP BY ALL) SELECT 'g' AS scene, count(*) AS cells, (max(p) - min(p)) / greatest((SELECT b - a FROM d), 1e-9) AS unevenness FROM t WHERE n > 50", "unevenness", "scene cells"),
}

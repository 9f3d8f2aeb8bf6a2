"""Queries of structures, shadows, tile fits and losses, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.operators import local, resample, structures, zonal
from orograph.plans.base import G, HOLED, PR, RGB, six, sql6
from orograph.plans.rasters import VEG, conv, extreme, gauss_table, mirrored, rank_of, slope
from orograph.plans.regions import MASKED, REACH, _mask, _origins, _rings
from orograph.sources import adapters as a

AT = ["scene", "r", "c"]
CENTERS = [-0.3, -0.1, 0.0, 0.1, 0.3]


def ground_envelope(spark, d):
    return six(structures.ground_envelope(a.grid(spark, d), 2, 5, 20))


def ground_surface(spark, d):
    return six(structures.ground_surface(a.grid(spark, d), 8, 1.0).select(*AT, "ground"))


def refine_gate(spark, d):
    return six(structures.refine_gate(a.grid(spark, d), 2.0))


def shadow_ray_lengths(spark, d):
    return six(structures.shadow_lengths(zonal.components(_mask(spark, d)), 30.0, least_px=2, least_rays=2))


def footprint_table(spark, d):
    t = a.grid(spark, d)
    rgb = a.rgb(t)
    veg = rgb.select(*AT, local.excess_green(F.col("red"), F.col("green"), F.col("blue")).alias("veg"))
    parts = zonal.components(_mask(spark, d)).join(t.select(*AT, "z"), AT).join(veg, AT)
    return six(structures.footprints(parts, least_px=3, least_h=0.15))


def tile_overlap_fits(spark, d):
    t = a.grid(spark, d)
    tiles = resample.tile_grid(resample.dims_of(t), 40, 10)
    rc = tiles.select("scene", "r0", "c0", F.explode(F.sequence(F.col("r0"), F.col("r0") + 39)).alias("r"))
    rc = rc.select("scene", "r0", "c0", "r", F.explode(F.sequence(F.col("c0"), F.col("c0") + 39)).alias("c"))
    noisy = F.col("z") * (1 + F.col("c0") * F.lit(0.05)) + ((F.col("r") * 7 + F.col("c") * 3 + F.col("c0")) % 11).cast("double") * F.lit(0.01)
    return six(structures.overlap_fits(rc.join(t, AT).withColumn("z", noisy)))


def gradient_matching(spark, d):
    return six(structures.gradient_loss(a.pred_ref(a.holed(a.grid(spark, d)))))


def scale_free_loss(spark, d):
    return six(structures.scale_free_loss(a.pred_ref(a.holed(a.grid(spark, d)))))


def chamfer_distance(spark, d):
    return six(structures.chamfer(a.grid(spark, d), CENTERS))


def earclip(spark, d):
    return structures.triangles(_rings(spark, d))


def extruded_walls(spark, d):
    return six(structures.extruded_walls(_rings(spark, d), F.element_at("ring", 1)["x"] + F.lit(1.0), F.lit(0.0)))


QUERIES = [ground_envelope, ground_surface, refine_gate, shadow_ray_lengths, footprint_table, tile_overlap_fits, gradient_matching, scale_free_loss, chamfer_distance, earclip, extruded_walls]

HS, WS = "(SELECT max(r) + 1 FROM cl)", "32"
_SHARP = f"{gauss_table('k', 2.0)}, {gauss_table('k1', 1.0)}, {conv('l', 'g', 'z', 'k', mirrored)}, o AS (SELECT r, c, z, z - v AS o FROM g JOIN l USING (r, c)), {conv('s', 'o', 'o', 'k1', mirrored)}, sh AS (SELECT r, c, z, z + 0.5::DOUBLE * (o - v) AS sharp FROM o JOIN s USING (r, c))"


def _crisp(name: str, value: str) -> str:
    return f"{name} AS (SELECT sum(g) FILTER (i <= greatest(1, floor(n * 0.01::DOUBLE))) / greatest(sum(g), 1e-12) AS v FROM (SELECT *, row_number() OVER (ORDER BY g DESC) AS i, count(*) OVER () AS n FROM (SELECT tan(radians(slope)) AS g FROM ({slope('sh', 1.0, value)}))))"


def _grad(s: int) -> str:
    return f"SELECT 'g' AS scene, {s} AS stride, avg(abs(dx)) AS x, avg(abs(dy)) AS y FROM (SELECT lead(e) OVER (PARTITION BY r ORDER BY c) - e AS dx, lead(e) OVER (PARTITION BY c ORDER BY r) - e AS dy FROM (SELECT r, c, pred - ref AS e FROM pr WHERE r % {s} = 0 AND c % {s} = 0))"


ORACLE = {
    "ground_envelope": sql6(f"""WITH {G}, cl AS (SELECT 'g' AS scene, r // 2 AS r, c // 2 AS c, avg(z) AS z FROM g WHERE r < ((SELECT max(r) + 1 FROM g) // 2) * 2 GROUP BY ALL), rk AS ({rank_of('cl', 'z', 5, 5, WS, HS)}), {extreme('mx', 'rk', 'v', 'max', 2, 2)}, {gauss_table('k', 1.25)}, {conv('sm', 'mx', 'v', 'k', mirrored, WS, HS)},
 p AS (SELECT g.r, g.c, g.r * (({HS} - 1) / greatest((SELECT max(r) FROM g), 1)) AS y, g.c * (31 / 63) AS x FROM g), q AS (SELECT r, c, y, x, floor(y)::INT AS fr, floor(x)::INT AS fc FROM p)
 SELECT 'g' AS scene, q.r, q.c, (1 - (y - fr)) * (1 - (x - fc)) * a.v + (1 - (y - fr)) * (x - fc) * b.v + (y - fr) * (1 - (x - fc)) * d.v + (y - fr) * (x - fc) * e.v AS ground FROM q JOIN sm a ON a.r = fr AND a.c = fc JOIN sm b ON b.r = fr AND b.c = least(fc + 1, 31) JOIN sm d ON d.r = least(fr + 1, {HS} - 1) AND d.c = fc JOIN sm e ON e.r = least(fr + 1, {HS} - 1) AND e.c = least(fc + 1, 31)""", "ground", "scene r c"),
    "ground_surface": sql6(f"WITH {G}, {extreme('e', 'g', 'z', 'min', 4, 3)}, {extreme('o', 'e', 'v', 'max', 3, 4)}, os AS (SELECT 'g' AS scene, r, c, v AS z FROM o), md AS ({rank_of('os', 'z', 3, 4)}), {gauss_table('k', 1.0)}, {conv('l', 'md', 'v', 'k', mirrored)} SELECT g.scene, r, c, least(l.v, g.z) AS ground FROM g JOIN l USING (r, c)", "ground", "scene r c"),
    "refine_gate": sql6(f"WITH {G}, {_SHARP}, {_crisp('b', 'z')}, {_crisp('a', 'sharp')} SELECT 'g' AS scene, b.v AS before, a.v AS after, a.v / greatest(b.v, 1e-12) AS gain, a.v / greatest(b.v, 1e-12) >= 0.98 AS accepted FROM a, b", "before after gain", "scene accepted"),
    "shadow_ray_lengths": sql6(f"WITH RECURSIVE {G}, {MASKED}, {REACH}, t AS (SELECT label, c * -sin(radians(30.0::DOUBLE)) + r * cos(radians(30.0::DOUBLE)) AS a, round_even(-c * cos(radians(30.0::DOUBLE)) - r * sin(radians(30.0::DOUBLE)), 0) AS ray FROM mi JOIN lb USING (id)), y AS (SELECT label, ray, max(a) - min(a) + 1 AS run FROM t GROUP BY ALL HAVING count(*) >= 2) SELECT 'g' AS scene, label, count(*) AS rays, quantile_cont(run, 0.5) AS length FROM y GROUP BY label HAVING count(*) >= 2", "length", "scene label rays"),
    "footprint_table": sql6(f"WITH RECURSIVE {G}, {RGB}, {MASKED}, {REACH}, v AS (SELECT r, c, {VEG} AS veg FROM rgb), t AS (SELECT lb.label, mi.r, mi.c, g.z, veg FROM mi JOIN lb USING (id) JOIN g ON g.r = mi.r AND g.c = mi.c JOIN v ON v.r = mi.r AND v.c = mi.c), m AS (SELECT quantile_cont(veg, 0.5) AS m FROM t), f AS (SELECT 'g' AS scene, label, count(*) AS area, quantile_cont(z, 0.75) AS height, avg(veg) AS veg, min(r) AS top, max(r) AS bottom, min(c) AS \"left\", max(c) AS \"right\" FROM t GROUP BY label) SELECT f.* FROM f, m WHERE area >= 3 AND height >= 0.15 AND veg <= m + 0.3 ORDER BY area DESC, label LIMIT 2000", "height veg", "scene label area top bottom \"left\" \"right\""),
    "tile_overlap_fits": sql6(f"WITH {G}, hh AS (SELECT max(r) + 1 AS h FROM g), o AS (SELECT unnest({_origins('h', 40, 10)}) AS r0 FROM hh), p AS (SELECT unnest({_origins('64', 40, 10)}) AS c0), t AS (SELECT r0, c0, r, c, z * (1 + c0 * 0.05::DOUBLE) + ((r * 7 + c * 3 + c0) % 11)::DOUBLE * 0.01::DOUBLE AS z FROM g JOIN o ON r BETWEEN r0 AND r0 + 39 JOIN p ON c BETWEEN c0 AND c0 + 39), l AS (SELECT *, lag(z) OVER w AS lz, lag(c0) OVER w AS left_c0 FROM t WINDOW w AS (PARTITION BY r0, r, c ORDER BY c0)), f AS (SELECT r0, left_c0, c0, count(*) AS n, regr_slope(lz, z) AS gain, regr_intercept(lz, z) AS \"offset\" FROM l WHERE lz IS NOT NULL GROUP BY ALL) SELECT 'g' AS scene, r0, left_c0, c0, n, gain, \"offset\", gain > 0.1 AND gain < 5 AS accepted FROM f WHERE n > 50", 'gain "offset"', "scene r0 left_c0 c0 n accepted"),
    "gradient_matching": sql6(f"WITH {G}, {HOLED}, {PR} {' UNION ALL '.join(map(_grad, (1, 2, 4, 8)))}", "x y", "scene stride"),
    "scale_free_loss": sql6(f"WITH {G}, {HOLED}, {PR}, t AS (SELECT * FROM pr WHERE pred IS NOT NULL), m AS (SELECT quantile_cont(pred, 0.5) AS mp, quantile_cont(ref, 0.5) AS mr FROM t), d AS (SELECT greatest(avg(abs(pred - mp)), 1e-6) AS dp, greatest(avg(abs(ref - mr)), 1e-6) AS dr FROM t, m) SELECT 'g' AS scene, avg(abs((pred - mp) / dp - (ref - mr) / dr)) AS loss FROM t, m, d", "loss", "scene"),
    "chamfer_distance": sql6(f"WITH {G}, k AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in CENTERS)}]) AS k), a AS (SELECT r, c, min(abs(z - k)) AS d FROM g CROSS JOIN k GROUP BY ALL), b AS (SELECT k, min(abs(z - k)) AS d FROM g CROSS JOIN k GROUP BY k) SELECT 'g' AS scene, (SELECT avg(d) FROM a) AS to_centers, (SELECT avg(d) FROM b) AS to_heights", "to_centers to_heights", "scene"),
    "extruded_walls": sql6("WITH p AS (SELECT n_name AS id, n_nationkey::DOUBLE AS k, 6.5::DOUBLE + n_nationkey AS s FROM nation), v AS (SELECT id, k, [k, k + s, k + s, k + s / 2, k + s / 2, k] AS xs, [k, k, k + s / 2, k + s / 2, k + s, k + s] AS ys FROM p), e AS (SELECT id, i, k + 1 AS top, 0.0::DOUBLE AS base, xs[i + 1] AS x0, ys[i + 1] AS y0, xs[(i + 1) % 6 + 1] AS x1, ys[(i + 1) % 6 + 1] AS y1 FROM v CROSS JOIN (SELECT unnest(range(6))::INT AS i)), l AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS edge FROM e WHERE top - base >= 2) SELECT *, coalesce(sum(edge) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM l", "top base x0 y0 x1 y1 edge u", "id i"),
}

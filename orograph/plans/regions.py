"""Queries of resampling, line and point sampling, regions and meshes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.tables import load
from orograph.operators import metrics, resample, zonal
from orograph.plans.base import G, HOLED, PR, six, sql6
from orograph.sources import adapters as a


def block_reduce_median(spark, d):
    return six(resample.block_reduce(a.grid(spark, d), 4, F.percentile("z", F.lit(0.5))))


def decimate_avg(spark, d):
    return six(resample.block_reduce(a.grid(spark, d), 3, F.avg("z"), whole=False))


def validity_downsample(spark, d):
    return six(resample.valid_average(a.holed(a.grid(spark, d)), 4, 0.95))


def tile_grid(spark, d):
    n = load(spark, d, "nation")
    k = F.col("n_nationkey")
    return resample.tile_grid(n.select(F.col("n_name").alias("scene"), (k * 37 + 60).alias("h"), (k * 53 + 90).alias("w")), 128, 32)


def feather_blend(spark, d):
    t = a.grid(spark, d)
    tiles = resample.tile_grid(resample.dims_of(t), 40, 10)
    rc = tiles.select("scene", "r0", "c0", F.explode(F.sequence(F.col("r0"), F.col("r0") + 39)).alias("r"))
    rc = rc.select("scene", "r0", "c0", "r", F.explode(F.sequence(F.col("c0"), F.col("c0") + 39)).alias("c"))
    one = rc.join(t, ["scene", "r", "c"]).withColumn("z", F.col("z") + F.lit(0.01) * (F.col("r0") + F.col("c0")))
    return six(resample.blend(one, 40, 10))


def first_wins_mosaic(spark, d):
    t = a.grid(spark, d)
    r, c, z = F.col("r"), F.col("c"), F.col("z")
    layers = t.select("scene", "r", "c", F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), v.alias("z")) for i, v in enumerate((F.when((r + c) % 3 == 0, z), F.when(r % 2 == 0, z + 1), F.when(c % 5 != 0, z + 2)))])).alias("l"))
    return six(resample.first_wins(layers.select("scene", "r", "c", "l.priority", "l.z")))


def _points(spark, d):
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(F.lit("g").alias("scene"), k.alias("id"), (((k * 73) % 5000) / F.lit(10.0)).alias("y"), (((k * 37) % 640) / F.lit(10.0)).alias("x"))


def bilinear_probe(spark, d):
    t = a.grid(spark, d)
    return six(resample.bilinear(a.holed(t), _points(spark, d), resample.dims_of(t)))


def _lines(spark, d):
    k = F.col("n_nationkey")
    t = load(spark, d, "nation").select(F.lit("g").alias("scene"), F.col("n_name").alias("line"), ((k * 7) % 400).alias("r0"), ((k * 3) % 60).alias("c0"), ((k * 13 + 50) % 480).alias("r1"), ((k * 11 + 20) % 64).alias("c1"))
    return resample.line(t, 64)


def line_profile(spark, d):
    t = a.grid(spark, d)
    p = resample.bilinear(a.holed(t), _lines(spark, d), resample.dims_of(t))
    first, last = F.min_by("z", "i"), F.max_by("z", "i")
    return six(p.groupBy("line").agg(F.count("z").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), (last - first).alias("dh")))


def profile_vs_reference(spark, d):
    t = a.pred_ref(a.grid(spark, d))
    dims, lines = resample.dims_of(t), _lines(spark, d)
    p = resample.bilinear(t.withColumnRenamed("pred", "z"), lines, dims).withColumnRenamed("z", "pred")
    r = resample.bilinear(t.withColumnRenamed("ref", "z"), lines, dims).select("line", "i", F.col("z").alias("ref"))
    return six(metrics.alignments(p.join(r, ["line", "i"]), ["line"]).drop("headline"))


def _mask(spark, d):
    return a.grid(spark, d).filter(F.col("z") > F.lit(0.12))


def connected_components(spark, d):
    return zonal.components(_mask(spark, d))


def distance_transform(spark, d):
    t = a.grid(spark, d).select("scene", "r", "c", (F.col("z") > F.lit(-0.12)).alias("inside"))
    return six(zonal.distance(t).filter("inside").select("scene", "r", "c", "distance"))


def structure_width_p90(spark, d):
    t = a.grid(spark, d).select("scene", "r", "c", (F.col("z") > F.lit(0.08)).alias("inside"))
    w = zonal.structure_width(t, least_px=5)
    return six(w.select("scene", "width", F.least(F.greatest(F.col("width") * 2.5, F.lit(15.0)), F.lit(60.0)).alias("scale")))


def zonal_plane_flatten(spark, d):
    return six(zonal.planes(a.grid(spark, d).select("scene", "label", "r", "c", "z")))


def merge_touching(spark, d):
    return six(zonal.merge_candidates(a.grid(spark, d).select("scene", "label", "r", "c", "z"), 0.01))


def merged_regions(spark, d):
    return zonal.merged(a.grid(spark, d).select("scene", "label", "r", "c", "z"), 0.004)


def nearest_fill(spark, d):
    t = a.grid(spark, d).withColumn("z", F.when((F.col("r") * 64 + F.col("c")) % 3 == 0, F.col("z")))
    return six(zonal.nearest_fill(t, 3).select("scene", "r", "c", "z"))


def mesh_walls(spark, d):
    return six(zonal.walls(a.grid(spark, d).select("scene", "r", "c", (F.col("z") * F.lit(10.0)).alias("z")), 0.25))


def mesh_smooth_faces(spark, d):
    t = resample.block_reduce(a.grid(spark, d), 4, F.percentile("z", F.lit(0.5)))
    return zonal.faces(t.join(resample.dims_of(t), "scene"))


def mesh_relief(spark, d):
    t = resample.block_reduce(a.grid(spark, d), 4, F.percentile("z", F.lit(0.5)))
    return six(t.groupBy("scene").agg(F.min("z").alias("base"), (F.max("z") - F.min("z")).alias("relief"), F.count(F.lit(1)).alias("vertices")))


def _rings(spark, d):
    k = F.col("n_nationkey").cast("double")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s = F.lit(6.5) + k
    ell = F.array(p(k, k), p(k + s, k), p(k + s, k + s / 2), p(k + s / 2, k + s / 2), p(k + s / 2, k + s), p(k, k + s))
    return load(spark, d, "nation").select(F.col("n_name").alias("id"), ell.alias("ring"))


def polygon_area(spark, d):
    return six(_rings(spark, d).select("id", zonal.shoelace(F.col("ring")).alias("area")))


def polygon_rasterise(spark, d):
    t = _rings(spark, d)
    lo, hi = lambda k: F.floor(F.array_min(F.transform("ring", lambda p: p[k]))).cast("int"), lambda k: F.ceil(F.array_max(F.transform("ring", lambda p: p[k]))).cast("int")
    t = t.withColumn("r", F.explode(F.sequence(lo("y"), hi("y")))).withColumn("c", F.explode(F.sequence(lo("x"), hi("x"))))
    return t.filter(zonal.inside(F.col("ring"), F.col("c") + F.lit(0.25), F.col("r") + F.lit(0.25))).select("id", "r", "c")


QUERIES = [block_reduce_median, decimate_avg, validity_downsample, tile_grid, feather_blend, first_wins_mosaic, bilinear_probe, line_profile, profile_vs_reference, connected_components, distance_transform, structure_width_p90, merged_regions, zonal_plane_flatten, merge_touching, nearest_fill, mesh_walls, mesh_smooth_faces, mesh_relief, polygon_area, polygon_rasterise]

PX = "scene r c"
H = "(SELECT max(r) + 1 FROM g)"


def _bilinear(src: str, points: str, keys: str, z: str = "z") -> str:
    return f"""SELECT {keys}, CASE WHEN have >= 0.5 THEN s / greatest(have, 1e-12) END AS z FROM (SELECT {', '.join('p.' + k for k in keys.split(', '))}, sum(CASE WHEN g.{z} IS NOT NULL THEN w ELSE 0 END) AS have, sum(coalesce(g.{z}, 0) * w) AS s
 FROM (SELECT *, least(fr + ci, {H} - 1) AS r, least(fc + cj, 63) AS c, CASE WHEN ci = 1 THEN yy - fr ELSE 1 - (yy - fr) END * CASE WHEN cj = 1 THEN xx - fc ELSE 1 - (xx - fc) END AS w
  FROM (SELECT *, floor(yy)::INT AS fr, floor(xx)::INT AS fc FROM (SELECT *, least(greatest(y, 0), {H} - 1)::DOUBLE AS yy, least(greatest(x, 0), 63)::DOUBLE AS xx FROM {points})) CROSS JOIN (SELECT unnest([0, 1]) AS ci) CROSS JOIN (SELECT unnest([0, 1]) AS cj)) p
 LEFT JOIN {src} g ON g.r = p.r AND g.c = p.c GROUP BY ALL)"""


def _origins(n: str, tile: int, overlap: int) -> str:
    return f"list_sort(list_distinct(list_append(list_transform(range(0, greatest({n} - {overlap}, 1), {tile - overlap}), lambda x: least(x, greatest({n} - {tile}, 0))), greatest({n} - {tile}, 0))))"


LINES = "ln AS (SELECT n_name AS line, (n_nationkey * 7) % 400 AS r0, (n_nationkey * 3) % 60 AS c0, (n_nationkey * 13 + 50) % 480 AS r1, (n_nationkey * 11 + 20) % 64 AS c1 FROM nation), lp AS (SELECT line, i, r0 + (r1 - r0) * (i / 63.0::DOUBLE) AS y, c0 + (c1 - c0) * (i / 63.0::DOUBLE) AS x FROM ln CROSS JOIN (SELECT unnest(range(64)) AS i))"
MASKED = "mk AS (SELECT scene, r, c FROM g WHERE z > 0.12::DOUBLE), mw AS (SELECT max(c) + 1 AS w FROM mk), mi AS (SELECT r, c, r * w + c AS id FROM mk, mw), ed AS (SELECT a.id AS a, b.id AS b FROM mi a JOIN mi b ON (a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1))"
REACH = "reach(a, b) AS (SELECT id, id FROM mi UNION SELECT reach.a, ed.b FROM reach JOIN ed ON reach.b = ed.a), lb AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a)"
MED4 = "b4 AS (SELECT scene, r // 4 AS r, c // 4 AS c, quantile_cont(z, 0.5) AS z FROM g WHERE r < ((SELECT max(r) + 1 FROM g) // 4) * 4 GROUP BY ALL)"


def _edt(over: float) -> str:
    """dt: the distance of each pixel of z over a limit to the nearest other one, which is within 12 rows and columns."""
    return f"""fg AS (SELECT r, c FROM g WHERE z > {over}::DOUBLE), bg AS (SELECT r, c FROM g WHERE NOT z > {over}::DOUBLE), of AS (SELECT i, j, i * i + j * j AS d2 FROM (SELECT unnest(range(-12, 13)) AS i) CROSS JOIN (SELECT unnest(range(-12, 13)) AS j)),
 dt AS (SELECT fg.r, fg.c, sqrt(min(d2)::DOUBLE) AS distance FROM fg CROSS JOIN of JOIN bg ON bg.r = fg.r + i AND bg.c = fg.c + j GROUP BY ALL)"""


def _feather(i: str) -> str:
    return f"CASE WHEN least({i}, 39 - {i}) < 10 THEN (1 - cos(3.141592653589793::DOUBLE * (least({i}, 39 - {i}) + 1) / 21)) / 2 ELSE 1 END"


def _fit(out: str, src: str) -> str:
    return f"""{out}_s AS (SELECT label, count(*) AS n, sum(c - cx) AS sx, sum(r - cy) AS sy, sum(z) AS sz, sum((c - cx) ** 2) AS xx, sum((r - cy) ** 2) AS yy, sum((c - cx) * (r - cy)) AS xy, sum((c - cx) * z) AS xz, sum((r - cy) * z) AS yz FROM {src} GROUP BY label),
{out}_c AS (SELECT label, n, sx, sy, sz, xx - sx * sx / n AS cxx, yy - sy * sy / n AS cyy, xy - sx * sy / n AS cxy, xz - sx * sz / n AS cxz, yz - sy * sz / n AS cyz FROM {out}_s),
{out} AS (SELECT label, n, p, q, sz / n - p * sx / n - q * sy / n AS o FROM (SELECT *, (cxz * cyy - cyz * cxy) / (cxx * cyy - cxy * cxy) AS p, (cyz * cxx - cxz * cxy) / (cxx * cyy - cxy * cxy) AS q FROM {out}_c))"""


ORACLE = {
    "block_reduce_median": sql6(f"WITH {G}, {MED4} SELECT * FROM b4", "z", PX),
    "decimate_avg": sql6(f"WITH {G} SELECT scene, r // 3 AS r, c // 3 AS c, avg(z) AS z FROM g GROUP BY ALL", "z", PX),
    "validity_downsample": sql6(f"WITH {G}, {HOLED}, t AS (SELECT scene, r // 4 AS r, c // 4 AS c, avg(z) AS z, count(z) / count(*) AS coverage FROM h GROUP BY ALL) SELECT scene, r, c, CASE WHEN coverage >= 0.95 THEN z END AS z, coverage FROM t", "z coverage", PX),
    "tile_grid": f"WITH d AS (SELECT n_name AS scene, n_nationkey * 37 + 60 AS h, n_nationkey * 53 + 90 AS w FROM nation), o AS (SELECT scene, unnest({_origins('h', 128, 32)}) AS r0, w FROM d) SELECT scene, r0, unnest({_origins('w', 128, 32)}) AS c0 FROM o",
    "feather_blend": sql6(f"WITH {G}, hh AS (SELECT max(r) + 1 AS h FROM g), o AS (SELECT unnest({_origins('h', 40, 10)}) AS r0 FROM hh), p AS (SELECT unnest({_origins('64', 40, 10)}) AS c0), t AS (SELECT scene, r, c, z + 0.01::DOUBLE * (r0 + c0) AS z, {_feather('(r - r0)')} * {_feather('(c - c0)')} AS w FROM g JOIN o ON r BETWEEN r0 AND r0 + 39 JOIN p ON c BETWEEN c0 AND c0 + 39) SELECT scene, r, c, sum(z * w) / sum(w) AS z FROM t GROUP BY ALL", "z", PX),
    "first_wins_mosaic": sql6(f"WITH {G} SELECT scene, r, c, CASE WHEN (r + c) % 3 = 0 THEN z WHEN r % 2 = 0 THEN z + 1 WHEN c % 5 <> 0 THEN z + 2 END AS z FROM g", "z", PX),
    "bilinear_probe": sql6(f"WITH {G}, {HOLED}, pt AS (SELECT 'g' AS scene, c_custkey AS id, ((c_custkey * 73) % 5000) / 10.0::DOUBLE AS y, ((c_custkey * 37) % 640) / 10.0::DOUBLE AS x FROM customer) {_bilinear('h', 'pt', 'scene, id, y, x')}", "y x z", "scene id"),
    "line_profile": sql6(f"WITH {G}, {HOLED}, {LINES}, s AS ({_bilinear('h', 'lp', 'line, i')}) SELECT line, count(z) AS n, min(z) AS lo, max(z) AS hi, arg_max_null(z, i) - arg_min_null(z, i) AS dh FROM s GROUP BY line", "lo hi dh", "line n"),
    "profile_vs_reference": sql6(f"WITH {G}, {HOLED}, gp AS (SELECT * FROM ({PR[len('pr AS ('):-1].replace('FROM h', 'FROM g')})), {LINES}, p AS ({_bilinear('gp', 'lp', 'line, i', 'pred')}), q AS ({_bilinear('gp', 'lp', 'line, i', 'ref')}), e AS (SELECT p.line, p.z AS pred, q.z AS ref FROM p JOIN q USING (line, i)), o AS (SELECT line, quantile_cont(ref - pred, 0.5) AS \"offset\" FROM e GROUP BY line) SELECT e.line, sqrt(avg((pred - ref) ** 2)) AS rmse_raw, max(\"offset\") AS \"offset\", sqrt(avg((pred + \"offset\" - ref) ** 2)) AS rmse_shift FROM e JOIN o USING (line) GROUP BY e.line", 'rmse_raw "offset" rmse_shift', "line"),
    "connected_components": f"WITH RECURSIVE {G}, {MASKED}, {REACH} SELECT 'g' AS scene, r, c, label FROM mi JOIN lb USING (id)",
    "distance_transform": sql6(f"WITH {G}, {_edt(-0.12)} SELECT 'g' AS scene, r, c, distance FROM dt", "distance", PX),
    "structure_width_p90": sql6(f"WITH RECURSIVE {G}, {MASKED.replace('0.12', '0.08')}, {REACH}, {_edt(0.08)}, a AS (SELECT label, count(*) AS area, 2.0 * max(distance) AS width FROM mi JOIN lb USING (id) JOIN dt USING (r, c) GROUP BY label HAVING count(*) >= 5), s AS (SELECT width, sum(area) OVER (ORDER BY width) / sum(area) OVER () AS s FROM a), m AS (SELECT min(width) AS width FROM s WHERE s >= 0.9) SELECT 'g' AS scene, width, least(greatest(width * 2.5, 15.0), 60.0) AS scale FROM m", "width scale", "scene"),
    "merged_regions": "WITH RECURSIVE " + G + """, h AS (SELECT label, quantile_cont(z, 0.75) AS h FROM g GROUP BY label), t AS (SELECT DISTINCT a.label AS a, b.label AS b FROM g a JOIN g b ON ((a.r = b.r AND abs(b.c - a.c) = 1) OR (a.c = b.c AND abs(b.r - a.r) = 1)) AND a.label <> b.label JOIN h x ON x.label = a.label JOIN h y ON y.label = b.label WHERE abs(x.h - y.h) <= 0.004),
 reach(a, b) AS (SELECT label, label FROM h UNION SELECT reach.a, t.b FROM reach JOIN t ON reach.b = t.a), m AS (SELECT a AS label, min(b) AS m FROM reach GROUP BY a) SELECT 'g' AS scene, label, dense_rank() OVER (ORDER BY m)::INT AS region FROM m""",
    "zonal_plane_flatten": sql6(f"""WITH {G}, ct AS (SELECT label, avg(c::DOUBLE) AS cx, avg(r::DOUBLE) AS cy, quantile_cont(z, 0.5) AS med, count(*) AS size FROM g GROUP BY label), t AS (SELECT * FROM g JOIN ct USING (label)), {_fit('f', 't')},
 o1 AS (SELECT t.*, p * (c - cx) + q * (r - cy) + o AS fit, z - (p * (c - cx) + q * (r - cy) + o) AS res FROM t JOIN f USING (label)), m AS (SELECT label, quantile_cont(res, 0.5) AS m FROM o1 GROUP BY label), sd AS (SELECT label, 1.4826::DOUBLE * quantile_cont(abs(res - m), 0.5) + 1e-6 AS s FROM o1 JOIN m USING (label) GROUP BY label),
 k AS (SELECT o1.* FROM o1 JOIN sd USING (label) WHERE abs(res) < 2.5 * s), {_fit('f2', 'k')}
 SELECT scene, label, r, c, (1 - 0.8::DOUBLE) * z + 0.8::DOUBLE * CASE WHEN size < 30 THEN med WHEN n >= 20 THEN p * (c - cx) + q * (r - cy) + o ELSE fit END AS z FROM o1 LEFT JOIN f2 USING (label)""", "z", "scene label r c"),
    "merge_touching": sql6(f"WITH {G}, h AS (SELECT label, quantile_cont(z, 0.75) AS h FROM g GROUP BY label), t AS (SELECT DISTINCT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b FROM g a JOIN g b ON ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)) AND a.label <> b.label) SELECT 'g' AS scene, t.a, t.b, abs(x.h - y.h) AS gap FROM t JOIN h x ON x.label = t.a JOIN h y ON y.label = t.b WHERE abs(x.h - y.h) <= 0.01", "gap", "scene a b"),
    "nearest_fill": sql6(f"WITH {G}, t AS (SELECT r, c, CASE WHEN (r * 64 + c) % 3 = 0 THEN z END AS z FROM g), o AS (SELECT i, j, i * i + j * j AS d2 FROM (SELECT unnest(range(-3, 4)) AS i) CROSS JOIN (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j BETWEEN 1 AND 9), f AS (SELECT a.r, a.c, arg_min(b.z, b.r * 1000 + b.c + d2 * 10000000000) AS f FROM t a CROSS JOIN o JOIN t b ON b.r = a.r + i AND b.c = a.c + j WHERE a.z IS NULL AND b.z IS NOT NULL GROUP BY ALL) SELECT 'g' AS scene, t.r, t.c, coalesce(z, f) AS z FROM t LEFT JOIN f USING (r, c)", "z", PX),
    "mesh_walls": sql6(f"WITH {G}, t AS (SELECT scene, r, c, round_even(z * 10.0::DOUBLE / 0.25, 0) * 0.25 AS z FROM g), w AS (SELECT scene, r, c, 'right' AS side, z, lead(z) OVER (PARTITION BY r ORDER BY c) AS o FROM t UNION ALL SELECT scene, r, c, 'below', z, lead(z) OVER (PARTITION BY c ORDER BY r) FROM t) SELECT scene, r, c, side, least(z, o) AS bottom, greatest(z, o) AS top FROM w WHERE abs(o - z) > 0.125", "bottom top", "scene r c side"),
    "mesh_smooth_faces": f"WITH {G}, {MED4}, d AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM b4), v AS (SELECT r * w + c AS v, w FROM b4, d WHERE r < h - 1 AND c < w - 1) SELECT 'g' AS scene, v AS a, v + w AS b, v + 1 AS c FROM v UNION ALL SELECT 'g', v + 1, v + w, v + w + 1 FROM v",
    "mesh_relief": sql6(f"WITH {G}, {MED4} SELECT scene, min(z) AS base, max(z) - min(z) AS relief, count(*) AS vertices FROM b4 GROUP BY scene", "base relief", "scene vertices"),
    "polygon_area": sql6("SELECT n_name AS id, (6.5 + n_nationkey)::DOUBLE * (6.5 + n_nationkey) * 0.75 AS area FROM nation", "area", "id"),
    "polygon_rasterise": "WITH p AS (SELECT n_name AS id, n_nationkey::DOUBLE AS k, 6.5::DOUBLE + n_nationkey AS s FROM nation), q AS (SELECT id, k, s, r::INT AS r, c::INT AS c, r + 0.25 - k AS y, c + 0.25 - k AS x FROM p CROSS JOIN (SELECT unnest(range(80)) AS r) CROSS JOIN (SELECT unnest(range(80)) AS c)) SELECT id, r, c FROM q WHERE x >= 0 AND y >= 0 AND ((x < s AND y < s / 2) OR (x < s / 2 AND y < s))",
}

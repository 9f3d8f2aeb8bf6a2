"""Queries of plateaus, outlines, flattened ground and city meshes, on several scenes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.tables import materialize
from orograph.operators import buildings as b
from orograph.operators import resample
from orograph.plans.base import CITY, six, sql6
from orograph.plans.rasters import gauss_table
from orograph.sources import adapters as a

AT = ["scene", "r", "c"]


def roof_plateaus(spark, d):
    return six(b.plateaus(a.city(spark, d).select(*AT, F.col("height").alias("z")), least_px=20, window=9))


def _blocks(spark, d, city=None):
    return (a.city(spark, d) if city is None else city).filter("height > 0").select("scene", F.col("block").alias("region"), "r", "c", F.col("height").alias("z"))


def cleaned_regions(spark, d):
    t = _blocks(spark, d)
    frayed = t.filter((F.col("r") * 7 + F.col("c") * 3) % 31 != 0)
    return b.cleaned(frayed, resample.dims_of(a.city(spark, d))).select("scene", "region", "r", "c")


def region_outlines(spark, d):
    rings = b.outlines(_blocks(spark, d)).withColumn("corners", F.size("ring"))
    return rings.groupBy("scene", "region").agg(F.count(F.lit(1)).alias("rings"), F.sum("corners").alias("corners"), F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("area"), F.sum("perimeter").alias("perimeter"))


def _regular(spark, d, city=None):
    return b.largest_rings(b.regularised(b.outlines(_blocks(spark, d, city)), eps=1.0))


def regular_outlines(spark, d):
    from orograph.operators.zonal import shoelace

    t = _regular(spark, d)
    return six(t.select("scene", "region", F.size("ring").alias("corners"), F.abs(shoelace(F.col("ring"))).alias("covers"), "area"))


def roof_planes(spark, d):
    t = _blocks(spark, d).withColumn("z", F.col("z") + F.lit(0.25) * F.col("c") - F.lit(0.5) * F.col("r") + ((F.col("r") * 5 + F.col("c") * 3) % 4).cast("double") * F.lit(0.1))
    return six(b.roofs(t))


def _surface(spark, d, city=None):
    return (a.city(spark, d) if city is None else city).select(*AT, (F.col("ground") + F.col("height")).alias("z"))


def flattened_ground(spark, d):
    return six(b.flattened(_surface(spark, d), _blocks(spark, d)))


def city_meshes(spark, d):
    city = materialize(a.city(spark, d), "city")
    ground = materialize(b.flattened(_surface(spark, d, city), _blocks(spark, d, city)), "ground")
    stood = b.bases(_regular(spark, d, city).join(b.roofs(_blocks(spark, d, city)), ["scene", "region"]), ground).join(resample.dims_of(ground), "scene")
    gv, gf = b.ground_mesh(ground, pixel=0.5, step=2)
    bv, bf = b.solids(stood, pixel=0.5)
    return six(b.mesh_counts(gv.unionByName(bv), gf.unionByName(bf)))


QUERIES = [roof_plateaus, cleaned_regions, region_outlines, regular_outlines, roof_planes, flattened_ground, city_meshes]

BLOCKS = CITY + ", rg AS (SELECT scene, block AS region, r, c, height AS z FROM ct WHERE height > 0)"
#: Reached ids of pixels (scene, id), by pairs of neighbours.
PLATEAUS = CITY + """,
o3 AS (SELECT i - 1 AS i, j - 1 AS j FROM range(3) x(i), range(3) y(j)),
md AS (SELECT p.scene, p.r, p.c, list_sort(list(q.height))[5] AS n FROM ct p JOIN dm USING (scene) CROSS JOIN o3 JOIN ct q ON q.scene = p.scene AND q.r = least(greatest(p.r + i, 0), h - 1) AND q.c = least(greatest(p.c + j, 0), w - 1) GROUP BY ALL),
p1 AS (SELECT *, max(n) OVER (PARTITION BY scene, r ORDER BY c ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM md),
rf AS (SELECT scene, r, c, n, max(m) OVER (PARTITION BY scene, c ORDER BY r ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS peak FROM p1 QUALIFY n > 2.5),
mk AS (SELECT scene, r, c, r * 64 + c AS id FROM rf WHERE n > peak - 3),
ed AS (SELECT x.scene, x.id AS a, y.id AS b FROM mk x JOIN mk y ON x.scene = y.scene AND ((x.r = y.r AND y.c IN (x.c - 1, x.c + 1)) OR (x.c = y.c AND y.r IN (x.r - 1, x.r + 1)))),
re(scene, a, b) AS (SELECT scene, id, id FROM mk UNION SELECT re.scene, re.a, ed.b FROM re JOIN ed ON re.scene = ed.scene AND re.b = ed.a),
lb AS (SELECT scene, a AS id, min(b) AS label FROM re GROUP BY ALL),
sz AS (SELECT scene, r, c, label FROM mk JOIN lb USING (scene, id) QUALIFY count(*) OVER (PARTITION BY scene, label) >= 4),
gn AS (SELECT f.scene, f.r, f.c, f.n, arg_min(s.label, struct_pack(d := (f.r - s.r) ** 2 + (f.c - s.c) ** 2, r := s.r, c := s.c)) AS label FROM rf f JOIN sz s ON s.scene = f.scene AND s.r BETWEEN f.r - 12 AND f.r + 12 AND s.c BETWEEN f.c - 12 AND f.c + 12 GROUP BY ALL),
ht AS (SELECT scene, label, quantile_cont(n, 0.75) AS h FROM gn GROUP BY ALL),
tp AS (SELECT DISTINCT x.scene, x.label AS a, y.label AS b FROM gn x JOIN gn y ON x.scene = y.scene AND x.label <> y.label AND ((x.r = y.r AND y.c IN (x.c - 1, x.c + 1)) OR (x.c = y.c AND y.r IN (x.r - 1, x.r + 1)))
  JOIN ht u ON u.scene = x.scene AND u.label = x.label JOIN ht v ON v.scene = y.scene AND v.label = y.label WHERE abs(u.h - v.h) <= 2.5),
rj(scene, a, b) AS (SELECT scene, label, label FROM ht UNION SELECT rj.scene, rj.a, tp.b FROM rj JOIN tp ON rj.scene = tp.scene AND rj.b = tp.a),
gp AS (SELECT scene, a AS label, min(b) AS grp FROM rj GROUP BY ALL),
al AS (SELECT gn.scene, gn.r, gn.c, gn.n AS z, grp FROM gn JOIN gp USING (scene, label)),
ok AS (SELECT scene, grp, row_number() OVER (PARTITION BY scene ORDER BY grp) AS region FROM al GROUP BY scene, grp HAVING count(*) >= 20)"""


def _around(src: str, out: str, whole: bool) -> str:
    grow = f"{out} AS (SELECT DISTINCT p.scene, region, p.r + i AS r, p.c + j AS c FROM {src} p JOIN dm USING (scene) CROSS JOIN o3 WHERE p.r + i BETWEEN 0 AND h - 1 AND p.c + j BETWEEN 0 AND w - 1)"
    return f"{out} AS (SELECT p.scene, region, p.r + i AS r, p.c + j AS c FROM {src} p CROSS JOIN o3 GROUP BY ALL HAVING count(*) = 9)" if whole else grow


CORNERS = """lt AS (SELECT scene, region, r + i AS y, c + j AS x, sum(CASE WHEN i = 1 AND j = 1 THEN 1 WHEN i = 1 THEN 2 WHEN j = 1 THEN 4 ELSE 8 END) AS m FROM rg CROSS JOIN (SELECT i, j FROM range(2) u(i), range(2) v(j)) GROUP BY ALL),
cn AS (SELECT scene, region, y, x FROM lt WHERE m IN (1, 2, 4, 8, 7, 11, 13, 14)),
sd AS (SELECT a.scene, a.region, count(*) AS sides FROM rg a CROSS JOIN (SELECT * FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(i, j)) LEFT JOIN rg b ON b.scene = a.scene AND b.region = a.region AND b.r = a.r + i AND b.c = a.c + j WHERE b.r IS NULL GROUP BY ALL),
ar AS (SELECT scene, region, count(*)::DOUBLE AS area, min(r) AS r0, max(r) + 1 AS r1, min(c) AS c0, max(c) + 1 AS c1 FROM rg GROUP BY ALL)"""
#: A ring's corners after it was made regular: those of its box, or its own.
REGULAR = """fl AS (SELECT *, area / ((r1 - r0) * (c1 - c0)) >= 0.72 AS box FROM ar),
rc AS (SELECT scene, region, y, x FROM cn JOIN fl USING (scene, region) WHERE NOT box UNION ALL SELECT scene, region, unnest([r0, r0, r1, r1]) AS y, unnest([c0, c1, c0, c1]) AS x FROM fl WHERE box)"""


def _smooth(out: str, src: str, along: str, across: str, size: str) -> str:
    n = f"dm.{size}"
    i = f"(p.{along} + k.i)"
    place = f"CASE WHEN {i} < 0 THEN -1 - {i} WHEN {i} >= {n} THEN 2 * {n} - 1 - {i} ELSE {i} END"
    return f"{out} AS (SELECT p.scene, p.r, p.c, sum(k.wt * q.v) AS v FROM {src} p JOIN dm USING (scene) CROSS JOIN gk k JOIN {src} q ON q.scene = p.scene AND q.{across} = p.{across} AND q.{along} = {place} GROUP BY ALL)"


FLAT = f"""gw AS (SELECT (i - 16)::INT AS i, exp(-0.5::DOUBLE * ((i - 16) / 4.0::DOUBLE) ** 2) AS wt FROM range(33) t(i)), gk AS (SELECT i, wt / sum(wt) OVER () AS wt FROM gw), o3 AS (SELECT i - 1 AS i, j - 1 AS j FROM range(3) x(i), range(3) y(j)),
gone AS (SELECT DISTINCT p.scene, p.r + i AS r, p.c + j AS c, true AS g FROM rg p CROSS JOIN o3),
sf AS (SELECT ct.scene, ct.r, ct.c, ground + height AS z, coalesce(g, false) AS g FROM ct LEFT JOIN gone USING (scene, r, c)),
sm AS (SELECT scene, quantile_cont(z, 0.5) AS mid FROM sf WHERE NOT g GROUP BY scene),
so AS (SELECT scene, r, c, CASE WHEN g THEN mid ELSE z END AS v FROM sf JOIN sm USING (scene)),
{_smooth('s1', 'so', 'r', 'c', 'h')}, {_smooth('s2', 's1', 'c', 'r', 'w')},
fg AS (SELECT sf.scene, r, c, CASE WHEN g THEN v ELSE z END AS z FROM sf JOIN s2 USING (scene, r, c))"""
MESHES = """bs AS (SELECT rc.scene, rc.region, quantile_cont(fg.z, 0.5) AS base FROM rc JOIN dm USING (scene) JOIN fg ON fg.scene = rc.scene AND fg.r = least(y, h - 1) AND fg.c = least(x, w - 1) GROUP BY ALL),
bd AS (SELECT scene, region, base, quantile_cont(z, 0.75) AS height FROM rg JOIN bs USING (scene, region) GROUP BY ALL),
bn AS (SELECT scene, region, count(*) AS n, min(x) * 0.5 AS x0, max(x) * 0.5 AS x1, min(h - y) * 0.5 AS y0, max(h - y) * 0.5 AS y1 FROM rc JOIN dm USING (scene) GROUP BY ALL),
gm AS (SELECT fg.scene, r // 2 AS r, c // 2 AS c, avg(z) AS z FROM fg JOIN dm USING (scene) WHERE r < h // 2 * 2 AND c < w // 2 * 2 GROUP BY ALL),
me AS (SELECT scene, 'ground' AS mesh, count(*) AS vertices, min(c) + 0.5 AS min_x, max(c) + 0.5 AS max_x, 0.5 AS min_y, max(r) + 0.5 AS max_y, min(z) AS min_z, max(z) AS max_z, max(r) * max(c) * 2 AS faces, 2 * (max(r) + max(c)) AS open_sides FROM gm GROUP BY scene
UNION ALL SELECT scene, 'roofs', sum(n), min(x0), max(x1), min(y0), max(y1), min(base + height), max(base + height), sum(n - 2), sum(n) FROM bn JOIN bd USING (scene, region) GROUP BY scene
UNION ALL SELECT scene, 'walls', sum(4 * n), min(x0), max(x1), min(y0), max(y1), min(base), max(base + height), sum(2 * n), sum(4 * n) FROM bn JOIN bd USING (scene, region) GROUP BY scene)"""
_ROOF = "z + 0.25::DOUBLE * c - 0.5::DOUBLE * r + ((r * 5 + c * 3) % 4)::DOUBLE * 0.1::DOUBLE"

ORACLE = {
    "roof_plateaus": sql6(f"WITH RECURSIVE {PLATEAUS} SELECT al.scene, r, c, region, z FROM al JOIN ok USING (scene, grp)", "z", "scene r c region"),
    "cleaned_regions": f"WITH {BLOCKS}, o3 AS (SELECT i - 1 AS i, j - 1 AS j FROM range(3) x(i), range(3) y(j)), f AS (SELECT * FROM rg WHERE (r * 7 + c * 3) % 31 <> 0), {_around('f', 'e1', True)}, {_around('e1', 'g1', False)}, {_around('g1', 'g2', False)}, {_around('g2', 'e2', True)} SELECT scene, region, r, c FROM e2",
    "region_outlines": f"WITH {BLOCKS}, {CORNERS} SELECT scene, region, 1::BIGINT AS rings, count(*) AS corners, any_value(area) AS area, any_value(sides)::DOUBLE AS perimeter FROM cn JOIN ar USING (scene, region) JOIN sd USING (scene, region) GROUP BY scene, region",
    "regular_outlines": sql6(f"WITH {BLOCKS}, {CORNERS}, {REGULAR} SELECT scene, region, count(*) AS corners, any_value(CASE WHEN box THEN ((r1 - r0) * (c1 - c0))::DOUBLE ELSE area END) AS covers, any_value(area) AS area FROM rc JOIN fl USING (scene, region) GROUP BY scene, region", "covers area", "scene region corners"),
    "roof_planes": sql6(f"WITH {BLOCKS}, t AS (SELECT scene, region, r::DOUBLE AS y, c::DOUBLE AS x, {_ROOF} AS z FROM rg), s AS (SELECT scene, region, count(*) AS n, quantile_cont(z, 0.75) AS height, var_pop(z) AS zz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM t GROUP BY ALL) SELECT scene, region, n, height, sqrt(greatest(zz - (xz * yy - yz * xy) / (xx * yy - xy * xy) * xz - (yz * xx - xz * xy) / (xx * yy - xy * xy) * yz, 0)) AS uneven FROM s", "height uneven", "scene region n"),
    "flattened_ground": sql6(f"WITH {BLOCKS}, {FLAT} SELECT * FROM fg", "z", "scene r c"),
    "city_meshes": sql6(f"WITH {BLOCKS}, {CORNERS}, {REGULAR}, {FLAT}, {MESHES} SELECT scene, mesh, vertices::BIGINT AS vertices, faces::BIGINT AS faces, open_sides::BIGINT AS open_sides, min_x, max_x, min_y, max_y, min_z, max_z FROM me", "min_x max_x min_y max_y min_z max_z", "scene mesh vertices faces open_sides"),
}

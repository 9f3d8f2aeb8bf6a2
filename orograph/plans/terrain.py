"""Queries of shadow scale, aligned mosaics, reprojection, cleaning, conditioning and losses on several scenes, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orograph.functions.tables import load, materialize
from orograph.operators import condition, losses, mosaic, project, resample, shadows, surface
from orograph.plans.base import CITY, SCENES, six, sql6
from orograph.plans.regions import _origins
from orograph.sources import adapters as a

AT = ["scene", "r", "c"]
TILES = (40, 12)
BINS = [0.0, 1.0, 3.0, 6.0, 10.0, 15.0, 21.0, 28.0]


# shadows: buildings in blocks of 32 pixels, the sun in the east at 45 degrees
def _sunlit(spark, d):
    t = a.scenes(spark, d).withColumn("br", F.floor(F.col("r") / 32).cast("int")).withColumn("bc", F.floor(F.col("c") / 32).cast("int"))
    at = lambda j: F.max(F.when(F.col("c") % 32 == j, F.col("z")))
    t = t.join(t.filter((F.col("r") % 32 == 0) & (F.col("c") % 32 < 2)).groupBy("scene", "br", "bc").agg(at(0).alias("e0"), at(1).alias("e1")), ["scene", "br", "bc"])
    y, x, h = F.col("r") % 32, F.col("c") % 32, F.lit(4) + F.floor(F.abs("e0") * 1000) % 14
    rows = y.between(6, 17)
    dark = (rows & (x < 20) & (x >= 20 - h)) | ((y == 25) & x.isin(3, 4)) | ((y >= 28) & (y < 30) & x.between(3, 12)) | ((F.col("bc") == 0) & y.between(21, 23) & (x < 5))
    detail = F.lit(0.5) + F.lit(0.02) * F.col("z") + F.when(rows & x.between(20, 27) & (F.col("e1") > -0.15), h / 3.0).otherwise(0.0)
    return t.select(*AT, dark.alias("dark"), detail.alias("detail"))


def _sun(spark):
    return spark.createDataFrame([(s, 90.0, 45.0, 0.5) for s in "abc"], "scene string, azimuth double, elevation double, sigma double")


def _found(spark, d):
    t = materialize(_sunlit(spark, d), "sunlit")
    low = t.groupBy("scene").agg(F.percentile("detail", F.lit(0.1)).alias("ground"))
    return shadows.pairs(t, _sun(spark), low)


def shadow_pairs(spark, d):
    return six(_found(spark, d))


def shadow_scale(spark, d):
    return six(shadows.scale_from(materialize(_found(spark, d), "shadow-pairs"), _sun(spark)))


# tiles of a surface, each with a gain and an offset of its own
def _tiles(spark, d):
    t = a.city(spark, d).select(*AT, (F.col("height") + F.col("z")).alias("z"))
    tiles = resample.tile_grid(resample.dims_of(t), *TILES)
    rc = tiles.select("scene", "r0", "c0", F.explode(F.sequence(F.col("r0"), F.col("r0") + TILES[0] - 1)).alias("r"))
    rc = rc.select("scene", "r0", "c0", "r", F.explode(F.sequence(F.col("c0"), F.col("c0") + TILES[0] - 1)).alias("c"))
    k = (F.col("r0") * 3 + F.col("c0")) % 7
    return rc.join(t, AT).withColumn("z", F.col("z") * (1 + k.cast("double") * F.lit(0.1)) + k * F.lit(0.5) + ((F.col("r") * 7 + F.col("c") * 3 + F.col("c0")) % 11).cast("double") * F.lit(0.01))


def tile_gains(spark, d):
    return six(mosaic.gains(_tiles(spark, d), TILES[0], TILES[1] // 2))


def aligned_mosaic(spark, d):
    return six(mosaic.aligned(_tiles(spark, d), TILES[0], TILES[1] // 2))


# coordinates: each order is a place on earth, in a zone of UTM
def _places(spark, d):
    k = F.col("o_orderkey")
    lon, lat = ((k * 7919) % 36000 / F.lit(100.0) - 180.0), ((k * 104729) % 16000 / F.lit(100.0) - 80.0)
    zone = F.least(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(60))
    return load(spark, d, "orders").select(k.alias("id"), lon.alias("lon"), lat.alias("lat"), (F.when(lat < 0, 32700).otherwise(32600) + zone).alias("crs"))


def projected_places(spark, d):
    t = project.from_lonlat(_places(spark, d), F.col("crs"), F.col("lon"), F.col("lat"), "x", "y")
    t = project.from_lonlat(t, F.lit(3857), F.col("lon"), F.col("lat"), "mx", "my")
    t = project.to_lonlat(t, F.col("crs"), F.col("x"), F.col("y"), "_e", "_n")
    back = F.greatest(F.abs(F.col("_e") - F.col("lon")), F.abs(F.col("_n") - F.col("lat"))) < 1e-9
    metres = lambda c: (F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c)
    return t.select("id", "crs", *[metres(c) for c in ("x", "y", "mx", "my")], back.alias("returns"))


def _grids(spark):
    rows = [("a", 32633, 500_000.0, 5_400_000.0, 10.0), ("b", 32733, 480_000.0, 6_000_000.0, 10.0), ("c", 4326, 12.0, 48.0, 0.0001)]
    return spark.createDataFrame(rows, "scene string, crs int, x0 double, y0 double, size double")


def _targets(spark, d):
    """Grids about each scene's middle in another system: zone 32 for zone 33, degrees for zone 33 south, Mercator for degrees."""
    dims = resample.dims_of(a.scenes(spark, d))
    g = _grids(spark).join(dims, "scene")
    to = F.when(F.col("scene") == "a", 32632).when(F.col("scene") == "b", 4326).otherwise(3857)
    g = project.transformed(g, F.col("crs"), to, F.col("x0") + 16 * F.col("size"), F.col("y0") - 16 * F.col("size"), "x", "y")
    x, y = F.col("x"), F.col("y")
    size = F.when(F.col("scene") == "a", 7.0).when(F.col("scene") == "b", 0.0001).otherwise(9.0)
    return g.select("scene", to.alias("crs"), (x - 16 * size).alias("x0"), (y + 16 * size).alias("y0"), size.alias("size"), F.lit(48).alias("h"), F.lit(40).alias("w"))


def reprojected_grid(spark, d):
    return six(project.reprojected(a.holed(a.scenes(spark, d)), _grids(spark), _targets(spark, d)))


def edge_preserved(spark, d):
    t = a.holed(a.city(spark, d)).withColumn("z", F.when(F.col("z").isNotNull(), F.col("height") + F.col("z")))
    return six(surface.edge_preserved(t.select(*AT, "z")).select(*AT, "clean"))


def smooth_fill(spark, d):
    t = a.city(spark, d).select(*AT, F.when(F.col("height") == 0, F.col("ground") + F.col("z")).alias("z"))
    return six(surface.filled_smoothly(t, sigma=1.5))


def _bands(spark, d):
    v = F.least(F.greatest(F.floor(F.lit(127.5) + F.lit(240.0) * F.col("z")), F.lit(0)), F.lit(255))
    t = a.scenes(spark, d).withColumn("v", v.cast("int"))
    bright = (F.col("r") % 16 < 3) & (F.col("c") % 16 < 3)
    one = {"red": F.when(bright, 255).otherwise(F.col("v")), "green": F.when(bright, 255).otherwise(F.floor(F.col("v") * 4 / 5) + 20), "blue": F.when(bright, 252).otherwise(F.floor(F.col("v") / 2) + 40)}
    put = lambda x: F.when(F.col("scene") == "a", x).when(F.col("scene") == "b", F.floor(x / 6) + 100).otherwise(x * 200).cast("int")
    return t.select(*AT, *[put(x).alias(k) for k, x in one.items()], (F.col("scene") == "c").alias("deep"))


def conditioned_scene(spark, d):
    return condition.conditioned(_bands(spark, d), reach=1.5)


def conditioning_report(spark, d):
    t = condition.decisions(_bands(spark, d), reach=1.5)
    return six(t.join(condition.summary(t), "scene").select("scene", "cloud", "shadow", "masked", "rejected", "span", "stretch", "line"))


def combined_loss(spark, d):
    t = a.holed(a.city(spark, d)).withColumn("ref", F.when(F.col("z").isNotNull(), F.col("height")))
    noise = ((F.col("r") * 31 + F.col("c") * 17) % 7 - 3).cast("double")
    t = t.withColumn("pred", F.lit(0.8) * F.col("height") + F.lit(0.5) + F.lit(0.2) * noise).withColumn("rel", F.col("height") * F.lit(0.05) + F.lit(0.01) * noise)
    t = t.withColumn("logits", F.transform(F.array(*[F.lit(x) for x in BINS]), lambda x: F.lit(-0.3) * F.abs(F.col("pred") - x))).withColumn("cls", (F.col("block") % 4).cast("int"))
    t = t.withColumn("seg", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.lit(0.1) * noise * k))
    centers = t.select("scene").distinct().withColumn("centers", F.array(*[F.lit(x) for x in BINS]))
    return six(losses.combined(t.select(*AT, "pred", "ref", "logits", "rel", "seg", "cls"), centers))


QUERIES = [shadow_pairs, shadow_scale, tile_gains, aligned_mosaic, projected_places, reprojected_grid, edge_preserved, smooth_fill, conditioned_scene, conditioning_report, combined_loss]

SUNLIT = SCENES + """,
bl AS (SELECT scene, r // 32 AS br, c // 32 AS bc, max(CASE WHEN c % 32 = 0 THEN z END) AS e0, max(CASE WHEN c % 32 = 1 THEN z END) AS e1 FROM ms WHERE r % 32 = 0 AND c % 32 < 2 GROUP BY ALL),
s0 AS (SELECT ms.scene, r, c, z, bc, e1, r % 32 AS y, c % 32 AS x, 4 + floor(abs(e0) * 1000)::BIGINT % 14 AS hh FROM ms JOIN bl ON bl.scene = ms.scene AND br = r // 32 AND bc = c // 32),
sl AS (SELECT scene, r, c, (y BETWEEN 6 AND 17 AND x < 20 AND x >= 20 - hh) OR (y = 25 AND x IN (3, 4)) OR (y >= 28 AND y < 30 AND x BETWEEN 3 AND 12) OR (bc = 0 AND y BETWEEN 21 AND 23 AND x < 5) AS dark,
  0.5::DOUBLE + 0.02::DOUBLE * z + CASE WHEN y BETWEEN 6 AND 17 AND x BETWEEN 20 AND 27 AND e1 > -0.15::DOUBLE THEN hh / 3.0::DOUBLE ELSE 0.0::DOUBLE END AS detail FROM s0),
dw AS (SELECT scene, max(c) + 1 AS w FROM sl WHERE dark GROUP BY scene), gr AS (SELECT scene, quantile_cont(detail, 0.1) AS ground FROM sl GROUP BY scene),
dk AS (SELECT scene, r, c, r * w + c AS id FROM sl JOIN dw USING (scene) WHERE dark),
ed AS (SELECT x.scene, x.id AS a, y.id AS b FROM dk x JOIN dk y ON x.scene = y.scene AND y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1 AND x.id <> y.id),
re(scene, a, b) AS (SELECT scene, id, id FROM dk UNION SELECT re.scene, re.a, ed.b FROM re JOIN ed ON re.scene = ed.scene AND re.b = ed.a),
lb AS (SELECT scene, a AS id, min(b) AS label FROM re GROUP BY ALL),
px AS (SELECT scene, label, r, c, r * cos(radians(90.0::DOUBLE)) - c * sin(radians(90.0::DOUBLE)) AS along, round_even(-c * cos(radians(90.0::DOUBLE)) - r * sin(radians(90.0::DOUBLE)), 0) AS ray, (r = 0 OR c = 0 OR r = h - 1 OR c = dm.w - 1)::INT AS cut FROM dk JOIN lb USING (scene, id) JOIN dm USING (scene)),
ry AS (SELECT scene, label, ray, count(*) AS n, max(cut) AS cut, max(along) - min(along) + 1 AS run, arg_min(r, struct_pack(a := along, r := r, c := c)) AS er, arg_min(c, struct_pack(a := along, r := r, c := c)) AS ec FROM px GROUP BY ALL),
wl AS (SELECT scene, label, sum(n) AS n, max(cut) AS cut, count(*) FILTER (n >= 3) AS rays, quantile_cont(run, 0.5) FILTER (n >= 3) AS length FROM ry GROUP BY ALL),
ea AS (SELECT *, CASE WHEN n < 6 THEN 'speck' WHEN cut = 1 THEN 'truncated' WHEN rays < 3 THEN 'thin' WHEN NOT length BETWEEN 1 AND 300 THEN 'length' END AS early FROM wl),
pb AS (SELECT scene, label, d, least(greatest(round_even(er - cos(radians(90.0::DOUBLE)) * d, 0), 0), h - 1)::INT AS r, least(greatest(round_even(ec + sin(radians(90.0::DOUBLE)) * d, 0), 0), w - 1)::INT AS c FROM ry JOIN ea USING (scene, label) JOIN dm USING (scene) CROSS JOIN (SELECT unnest([1, 2, 4, 7, 11]) AS d) WHERE ry.n >= 3 AND early IS NULL),
rv AS (SELECT scene, label, d, quantile_cont(detail, 0.5) AS v FROM pb JOIN sl USING (scene, r, c) WHERE NOT dark GROUP BY ALL), rt AS (SELECT scene, label, max(v) AS top FROM rv GROUP BY ALL),
fin AS (SELECT scene, label, length, top - ground AS roof, length * tan(radians(45.0::DOUBLE)) AS h, early, top FROM ea JOIN gr USING (scene) LEFT JOIN rt USING (scene, label)),
sp AS (SELECT scene, label, length, coalesce(early, CASE WHEN top IS NULL THEN 'no_roof' WHEN roof > 1e-6 AND h > 1.5 THEN 'pair' ELSE 'flat' END) AS outcome, roof, h FROM fin)"""
SCALE = """pr AS (SELECT scene, label, roof AS x, h AS y, h / roof AS ratio, (row_number() OVER (PARTITION BY scene ORDER BY label) - 1) % 5 AS fold FROM sp WHERE outcome = 'pair'),
tr AS (SELECT a.scene, held, quantile_cont(ratio, 0.5) AS a FROM pr a CROSS JOIN range(5) t(held) WHERE fold <> held GROUP BY ALL),
ee AS (SELECT pr.scene, a * x - y AS e, ratio FROM pr JOIN tr ON tr.scene = pr.scene AND held = fold),
kf AS (SELECT scene, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(e) AS bias, quantile_cont(ratio, 0.5) AS mid FROM ee GROUP BY scene),
md AS (SELECT scene, quantile_cont(abs(ratio - mid), 0.5) AS mad FROM ee JOIN kf USING (scene) GROUP BY scene),
kk AS (SELECT scene, rmse, bias, least(greatest(1.253 * 1.4826 * mad / greatest(abs(mid), 1e-9) / sqrt(n), 0.01), 2.0) AS sr FROM kf JOIN md USING (scene) WHERE n >= 10),
ct AS (SELECT scene, """ + ", ".join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in ["pair", *shadows.REASONS]) + """ FROM sp GROUP BY scene),
al AS (SELECT scene, quantile_cont(ratio, 0.5) AS alpha FROM pr GROUP BY scene),
sn AS (SELECT unnest(['a', 'b', 'c']) AS scene)"""
_SIGMA = "least(greatest(sqrt(coalesce(sr, 0.1) ** 2 + (radians(0.5::DOUBLE) / (sin(radians(45.0::DOUBLE)) * cos(radians(45.0::DOUBLE)))) ** 2), 0.01), 2.0)"

TILED = f"""{CITY}, tc AS (SELECT scene, unnest({_origins('h', *TILES)}) AS r0, w FROM dm), tt AS (SELECT scene, r0, unnest({_origins('w', *TILES)}) AS c0 FROM tc),
tz AS (SELECT scene, r0, c0, r, c, (height + z) * (1 + ((r0 * 3 + c0) % 7)::DOUBLE * 0.1::DOUBLE) + ((r0 * 3 + c0) % 7) * 0.5::DOUBLE + ((r * 7 + c * 3 + c0) % 11)::DOUBLE * 0.01::DOUBLE AS z FROM tt JOIN ct USING (scene) WHERE r BETWEEN r0 AND r0 + 39 AND c BETWEEN c0 AND c0 + 39),
tw AS (SELECT scene, r0, c0, r, c, z, {' * '.join(f"(CASE WHEN least({i} - {i}0, 39 - {i} + {i}0) < 6 THEN (1 - cos(pi() * (least({i} - {i}0, 39 - {i} + {i}0) + 1) / 13)) / 2 ELSE 1.0 END)" for i in 'rc')} AS wt FROM tz),
kn AS (SELECT scene, r0, c0, row_number() OVER (PARTITION BY scene ORDER BY r0, c0) AS k FROM tt), tk AS (SELECT tw.*, k FROM tw JOIN kn USING (scene, r0, c0)),
pa AS (SELECT a.scene, a.r, a.c, a.k, b.k AS j, a.z AS p, b.z AS q, b.wt AS wt, sum(b.wt) OVER (PARTITION BY a.scene, a.r, a.c, a.k) AS al FROM tk a JOIN tk b ON a.scene = b.scene AND a.r = b.r AND a.c = b.c AND b.k < a.k),
ps AS (SELECT scene, k, j, sum(wt / al * q) AS sa, sum(wt / al) AS sb, sum(p * wt / al * q) AS pa, sum(p * wt / al) AS pb FROM pa GROUP BY ALL),
pn AS (SELECT scene, k, count(*) AS n, sum(p) AS p, sum(p * p) AS pp FROM (SELECT DISTINCT scene, k, r, c, p FROM pa) GROUP BY ALL),
pl AS (SELECT kn.scene, kn.k, n, p, pp, list(j ORDER BY j) AS js, list(sa ORDER BY j) AS las, list(sb ORDER BY j) AS lbs, list(pa ORDER BY j) AS lpa, list(pb ORDER BY j) AS lpb FROM kn LEFT JOIN pn USING (scene, k) LEFT JOIN ps USING (scene, k) GROUP BY ALL),
sq(scene, k, g, o, ok) AS (SELECT scene, 0::BIGINT, []::DOUBLE[], []::DOUBLE[], []::BOOLEAN[] FROM dm UNION ALL
  SELECT scene, k, list_append(g, CASE WHEN good THEN slope ELSE 1.0 END), list_append(o, CASE WHEN good THEN (rf - slope * p) / n ELSE 0.0 END), list_append(ok, good) FROM (
    SELECT *, coalesce(n > 50 AND slope > 0.1 AND slope < 5, false) AS good FROM (
      SELECT *, (bo - p * rf / n) / (pp - p * p / n) AS slope FROM (
        SELECT pl.scene, pl.k, sq.g, sq.o, sq.ok, n, p, pp, list_sum(list_transform(range(1, len(js) + 1), lambda i: sq.g[js[i]] * las[i] + sq.o[js[i]] * lbs[i])) AS rf,
          list_sum(list_transform(range(1, len(js) + 1), lambda i: sq.g[js[i]] * lpa[i] + sq.o[js[i]] * lpb[i])) AS bo FROM sq JOIN pl ON pl.scene = sq.scene AND pl.k = sq.k + 1)))),
fg AS (SELECT scene, arg_max(g, k) AS g, arg_max(o, k) AS o, arg_max(ok, k) AS ok FROM sq GROUP BY scene),
tg AS (SELECT kn.scene, r0, c0, kn.k, coalesce(n, 0) AS n, g[kn.k] AS gain, o[kn.k] AS "offset", ok[kn.k] AS accepted FROM kn JOIN fg USING (scene) LEFT JOIN pn ON pn.scene = kn.scene AND pn.k = kn.k)"""


# the projections, as SQL expressions
def _forward(crs: str, lon: str, lat: str) -> tuple[str, str]:
    e1 = repr(project.E1)
    cm = f"(({crs} % 100) * 6.0::DOUBLE - 183.0::DOUBLE)"
    t = f"sinh(atanh(sin(radians({lat}))) - {e1}::DOUBLE * atanh({e1}::DOUBLE * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos(radians({lon} - {cm})))", f"atanh(sin(radians({lon} - {cm})) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *[f"{b!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(project.ALPHA, 1)]])
    y = " + ".join([xi, *[f"{b!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(project.ALPHA, 1)]])
    k = f"{project.SCALE * project.RADIUS!r}::DOUBLE"
    mx, my = f"radians({lon}) * 6378137.0::DOUBLE", f"ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137.0::DOUBLE"
    pick = lambda deg, web, utm: f"(CASE WHEN {crs} = 4326 THEN {deg} WHEN {crs} = 3857 THEN {web} ELSE {utm} END)"
    return pick(lon, mx, f"500000.0::DOUBLE + {k} * ({x})"), pick(lat, my, f"(CASE WHEN {crs} // 100 = 327 THEN 10000000.0::DOUBLE ELSE 0.0::DOUBLE END) + {k} * ({y})")


def _inverse(crs: str, x: str, y: str) -> tuple[str, str]:
    k = f"{project.SCALE * project.RADIUS!r}::DOUBLE"
    xi, eta = f"(({y} - (CASE WHEN {crs} // 100 = 327 THEN 10000000.0::DOUBLE ELSE 0.0::DOUBLE END)) / {k})", f"(({x} - 500000.0::DOUBLE) / {k})"
    u = "(" + " - ".join([xi, *[f"{b!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(project.BETA, 1)]]) + ")"
    v = "(" + " - ".join([eta, *[f"{b!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(project.BETA, 1)]]) + ")"
    chi = f"asin(sin({u}) / cosh({v}))"
    phi = " + ".join([chi, *[f"{b!r}::DOUBLE * sin({2 * j} * {chi})" for j, b in enumerate(project.DELTA, 1)]])
    pick = lambda deg, web, utm: f"(CASE WHEN {crs} = 4326 THEN {deg} WHEN {crs} = 3857 THEN {web} ELSE {utm} END)"
    lon = f"(({crs} % 100) * 6.0::DOUBLE - 183.0::DOUBLE) + degrees(atan2(sinh({v}), cos({u})))"
    return pick(x, f"degrees({x} / 6378137.0::DOUBLE)", lon), pick(y, f"degrees(2 * atan(exp({y} / 6378137.0::DOUBLE))) - 90", f"degrees({phi})")


_PLACES = "pl AS (SELECT o_orderkey AS id, (o_orderkey * 7919) % 36000 / 100.0::DOUBLE - 180.0::DOUBLE AS lon, (o_orderkey * 104729) % 16000 / 100.0::DOUBLE - 80.0::DOUBLE AS lat FROM orders), pz AS (SELECT *, ((CASE WHEN lat < 0 THEN 32700 ELSE 32600 END) + least(floor((lon + 180) / 6)::INT + 1, 60))::INT AS crs FROM pl)"
_XY, _WEB = _forward("crs", "lon", "lat"), _forward("3857", "lon", "lat")
_GRID = "gs AS (SELECT * FROM (VALUES ('a', 32633, 500000.0::DOUBLE, 5400000.0::DOUBLE, 10.0::DOUBLE), ('b', 32733, 480000.0::DOUBLE, 6000000.0::DOUBLE, 10.0::DOUBLE), ('c', 4326, 12.0::DOUBLE, 48.0::DOUBLE, 0.0001::DOUBLE)) v(scene, crs, x0, y0, size))"


def _steps(rows: list[tuple[str, str, str]], last: str) -> str:
    """CTEs name AS (SELECT *, x, y FROM the one before) for a chain of conversions."""
    out, before = [], last
    for name, x, y in rows:
        out.append(f"{name} AS (SELECT *, {x}, {y} FROM {before})")
        before = name
    return ", ".join(out)


_MID = _inverse("crs", "mx", "my")
_MIDTO = _forward("tcrs", "lon", "lat")
_BACK = _inverse("tcrs", "tx", "ty")
_BACKTO = _forward("crs", "blon", "blat")
REGRID = f"""{SCENES}, {_GRID}, hs AS (SELECT scene, r, c, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS z FROM ms),
g0 AS (SELECT *, CASE scene WHEN 'a' THEN 32632 WHEN 'b' THEN 4326 ELSE 3857 END AS tcrs, CASE scene WHEN 'a' THEN 7.0::DOUBLE WHEN 'b' THEN 0.0001::DOUBLE ELSE 9.0::DOUBLE END AS tsize, x0 + 16 * size AS mx, y0 - 16 * size AS my FROM gs JOIN dm USING (scene)),
{_steps([('g1', f'{_MID[0]} AS lon', f'{_MID[1]} AS lat'), ('g2', f'{_MIDTO[0]} AS cx', f'{_MIDTO[1]} AS cy')], 'g0')},
t0 AS (SELECT *, cx - 16 * tsize + (tc + 0.5::DOUBLE) * tsize AS tx, cy + 16 * tsize - (tr + 0.5::DOUBLE) * tsize AS ty FROM g2 CROSS JOIN (SELECT unnest(range(48))::INT AS tr) CROSS JOIN (SELECT unnest(range(40))::INT AS tc)),
{_steps([('t1', f'{_BACK[0]} AS blon', f'{_BACK[1]} AS blat'), ('t2', f'{_BACKTO[0]} AS sx', f'{_BACKTO[1]} AS sy')], 't0')},
t3 AS (SELECT scene, tr, tc, h, w, (sx - x0) / size - 0.5::DOUBLE AS x, (y0 - sy) / size - 0.5::DOUBLE AS y FROM t2),
t4 AS (SELECT *, floor(least(greatest(y, 0), h - 1))::INT AS fr, floor(least(greatest(x, 0), w - 1))::INT AS fc, least(greatest(y, 0), h - 1) AS yy, least(greatest(x, 0), w - 1) AS xx FROM t3 WHERE x BETWEEN -0.5 AND w - 0.5 AND y BETWEEN -0.5 AND h - 0.5),
t5 AS (SELECT t4.scene, tr, tc, (CASE WHEN i = 1 THEN yy - fr ELSE 1 - (yy - fr) END) * (CASE WHEN j = 1 THEN xx - fc ELSE 1 - (xx - fc) END) AS wt, z FROM t4 CROSS JOIN (SELECT i, j FROM range(2) u(i), range(2) v(j)) LEFT JOIN hs ON hs.scene = t4.scene AND hs.r = least(fr + i, h - 1) AND hs.c = least(fc + j, w - 1)),
t6 AS (SELECT scene, tr, tc, sum(CASE WHEN z IS NOT NULL THEN wt ELSE 0 END) AS have, sum(coalesce(z, 0) * wt) AS s FROM t5 GROUP BY ALL)"""

BILATERAL = f"""{CITY}, hz AS (SELECT scene, r, c, CASE WHEN (r * 64 + c) % 97 <> 0 THEN height + z END AS z FROM ct),
qz AS (SELECT scene, quantile_cont(z, 0.005) AS lo, quantile_cont(z, 0.995) AS hi FROM hz GROUP BY scene),
xz AS (SELECT scene, r, c, z, lo, greatest(hi - lo, 1e-9) AS wide, CASE WHEN z IS NOT NULL THEN least(greatest((z - lo) / greatest(hi - lo, 1e-9), 0), 1) END AS x FROM hz JOIN qz USING (scene)),
mz AS (SELECT scene, quantile_cont(x, 0.5) AS mid FROM xz GROUP BY scene), fz AS (SELECT xz.scene, r, c, z, lo, wide, coalesce(x, mid) AS x, h, w FROM xz JOIN mz USING (scene) JOIN dm USING (scene)),
oz AS (SELECT i - 4 AS i, j - 4 AS j FROM range(9) u(i), range(9) v(j) WHERE (i - 4) ** 2 + (j - 4) ** 2 <= 16),
np AS MATERIALIZED (SELECT p.*, i * i + j * j AS d, CASE WHEN p.r + i < 0 THEN -(p.r + i) WHEN p.r + i >= p.h THEN 2 * p.h - 2 - p.r - i ELSE p.r + i END AS rr, CASE WHEN p.c + j < 0 THEN -(p.c + j) WHEN p.c + j >= p.w THEN 2 * p.w - 2 - p.c - j ELSE p.c + j END AS cc FROM fz p CROSS JOIN oz),
nz AS (SELECT np.scene, np.r, np.c, np.z, np.lo, np.wide, q.x AS v, exp(-0.5::DOUBLE * d / 81.0::DOUBLE - 0.5::DOUBLE * ((q.x - np.x) / 0.08::DOUBLE) ** 2) AS wt FROM np JOIN fz q ON q.scene = np.scene AND q.r = rr AND q.c = cc)"""


def _gauss(out: str, src: str, along: str, across: str, size: str) -> str:
    i = f"(p.{along} + k.i)"
    place = f"CASE WHEN {i} < 0 THEN -1 - {i} WHEN {i} >= dm.{size} THEN 2 * dm.{size} - 1 - {i} ELSE {i} END"
    return f"{out} AS (SELECT p.scene, p.r, p.c, sum(k.wt * q.v) AS v FROM {src} p JOIN dm USING (scene) CROSS JOIN gk k JOIN {src} q ON q.scene = p.scene AND q.{across} = p.{across} AND q.{along} = {place} GROUP BY ALL)"


FILL = f"""{CITY}, hz AS (SELECT scene, r, c, CASE WHEN height = 0 THEN ground + z END AS z FROM ct),
nf AS (SELECT p.scene, p.r, p.c, arg_min(q.z, struct_pack(d := (p.r - q.r) ** 2 + (p.c - q.c) ** 2, r := q.r, c := q.c)) AS v FROM hz p JOIN hz q ON q.scene = p.scene AND q.z IS NOT NULL AND q.r BETWEEN p.r - 7 AND p.r + 7 AND q.c BETWEEN p.c - 7 AND p.c + 7 WHERE p.z IS NULL GROUP BY ALL),
fu AS (SELECT hz.scene, hz.r, hz.c, coalesce(z, v) AS v FROM hz LEFT JOIN nf USING (scene, r, c)),
gw AS (SELECT (i - 6)::INT AS i, exp(-0.5::DOUBLE * ((i - 6) / 1.5::DOUBLE) ** 2) AS wt FROM range(13) t(i)), gk AS (SELECT i, wt / sum(wt) OVER () AS wt FROM gw), {_gauss('s1', 'fu', 'r', 'c', 'h')}, {_gauss('s2', 's1', 'c', 'r', 'w')}"""

BANDED = f"""{SCENES}, v0 AS (SELECT scene, r, c, least(greatest(floor(127.5::DOUBLE + 240.0::DOUBLE * z), 0), 255)::INT AS v, r % 16 < 3 AND c % 16 < 3 AS b FROM ms),
v1 AS (SELECT scene, r, c, CASE WHEN b THEN 255 ELSE v END AS red, CASE WHEN b THEN 255 ELSE v * 4 // 5 + 20 END AS green, CASE WHEN b THEN 252 ELSE v // 2 + 40 END AS blue FROM v0),
bd AS (SELECT scene, r, c, {', '.join(f"(CASE scene WHEN 'a' THEN {k} WHEN 'b' THEN {k} // 6 + 100 ELSE {k} * 200 END)::INT AS {k}" for k in ('red', 'green', 'blue'))} FROM v1),
lu AS (SELECT *, 0.2126::DOUBLE * red + 0.7152::DOUBLE * green + 0.0722::DOUBLE * blue AS luma, (greatest(red, green, blue) - least(red, green, blue)) / greatest(greatest(red, green, blue)::DOUBLE, 1e-9) AS sat FROM bd),
lq AS (SELECT scene, quantile_cont(luma, 0.5) AS mid, quantile_cont(luma, 0.75) - quantile_cont(luma, 0.25) AS iqr FROM lu GROUP BY scene),
lm AS (SELECT lu.*, luma > mid + 1.5 * iqr AND sat < 0.15 AS cloud, luma < mid - 1.5 * iqr AS shadow FROM lu JOIN lq USING (scene)),
ls AS (SELECT scene, avg(cloud::INT) AS cloud, avg(shadow::INT) AS shadow, avg((cloud OR shadow)::INT) AS masked FROM lm GROUP BY scene),
lo AS (SELECT scene, unnest([red, green, blue])::DOUBLE AS v FROM bd), sn AS (SELECT scene, quantile_cont(v, 0.98) - quantile_cont(v, 0.02) AS span FROM lo GROUP BY scene),
dc AS (SELECT *, masked > 0.35 AS rejected, CASE WHEN scene = 'c' THEN 'more than 8 bits' WHEN span >= 1 AND span < 90 THEN 'only ' || floor(span + 0.5)::INT || ' levels of range' END AS stretch FROM ls JOIN sn USING (scene)),
va AS (SELECT lm.scene, r, c, red, green, blue, stretch, rejected OR NOT (lm.cloud OR lm.shadow) AS valid FROM lm JOIN dc USING (scene))"""
_LIMITS = ", ".join(f"CASE WHEN count(*) FILTER (valid) >= 16 THEN quantile_cont({b}, {p}) FILTER (valid) ELSE quantile_cont({b}, {p}) END AS {b}_{n}" for b in ("red", "green", "blue") for n, p in (("lo", 0.02), ("hi", 0.98)))
_STRETCHED = ", ".join(f"CASE WHEN stretch IS NOT NULL THEN floor(least(greatest(({b} - {b}_lo) / greatest({b}_hi - {b}_lo, 1e-9), 0), 1) * 255)::INT ELSE least(greatest({b}, 0), 255)::INT END AS {b}" for b in ("red", "green", "blue"))
_PM = "floor({0} * 1000 + 0.5)::INT || '/1000'"

_TOP = repr(math.log1p(100.0))


def _loss_gradient(name: str, src: str) -> str:
    one = "SELECT scene, (coalesce(sum(abs(dx)), 0) + coalesce(sum(abs(dy)), 0)) / greatest(count(e), 1) AS g FROM (SELECT scene, e, lead(e) OVER (PARTITION BY scene, r ORDER BY c) - e AS dx, lead(e) OVER (PARTITION BY scene, c ORDER BY r) - e AS dy FROM {0} WHERE r % {1} = 0 AND c % {1} = 0) GROUP BY scene"
    return f"{name} AS (SELECT scene, sum(g) / 4 AS {name} FROM ({' UNION ALL '.join(one.format(src, s) for s in (1, 2, 4, 8))}) GROUP BY scene)"


LOSS = f"""{CITY}, l0 AS (SELECT scene, r, c, block, CASE WHEN (r * 64 + c) % 97 <> 0 THEN height END AS ref, ((r * 31 + c * 17) % 7 - 3)::DOUBLE AS noise, height FROM ct),
l1 AS (SELECT *, 0.8::DOUBLE * height + 0.5::DOUBLE + 0.2::DOUBLE * noise AS pred, height * 0.05::DOUBLE + 0.01::DOUBLE * noise AS rel, (block % 4)::INT AS cls, ln(1 + greatest(ref, 0) / 2.0::DOUBLE) AS u FROM l0),
bn AS (SELECT unnest(range(8)) AS k, unnest([{', '.join(f'{x}::DOUBLE' for x in BINS)}]) AS x), bu AS (SELECT k, x, ln(1 + x / 2.0::DOUBLE) AS uc FROM bn),
lk AS (SELECT *, least(greatest(floor(u / {_TOP}::DOUBLE * 16), 0), 15)::INT AS band FROM l1 WHERE ref IS NOT NULL),
nb AS (SELECT scene, band, count(*) AS n FROM lk GROUP BY ALL), fb AS (SELECT *, greatest(n / sum(n) OVER (PARTITION BY scene), 1e-4) ** -0.5 AS f FROM nb),
wb AS (SELECT scene, band, least(greatest(f / greatest(sum(f * n) OVER (PARTITION BY scene) / sum(n) OVER (PARTITION BY scene), 1e-6), 0.2), 10.0) AS weight FROM fb),
ok AS (SELECT * FROM lk JOIN wb USING (scene, band)),
tk AS (SELECT scene, r, c, k, uc, u, weight, -0.3::DOUBLE * abs(pred - x) AS lg, -((u - uc) ** 2) / (2 * ({_TOP}::DOUBLE / 8) ** 2) AS tg FROM ok CROSS JOIN bu),
ce AS (SELECT scene, r, c, any_value(weight) AS weight, ln(sum(exp(lg))) - sum(exp(tg) * lg) / sum(exp(tg)) AS ce, min((u - uc) ** 2) AS near FROM tk GROUP BY ALL),
cs AS (SELECT scene, sum(ce * weight) / greatest(sum(weight), 1) AS ce, avg(near) AS near FROM ce GROUP BY scene),
fa AS (SELECT scene, avg(d) AS far FROM (SELECT scene, k, min((u - uc) ** 2) AS d FROM tk GROUP BY ALL) GROUP BY scene),
ll AS (SELECT scene, count(*) AS n, sum(abs(pred - ref) * weight) / greatest(sum(weight), 1) AS l1 FROM ok GROUP BY scene),
ge AS (SELECT scene, r, c, pred - ref AS e FROM l1), {_loss_gradient('grad', 'ge')},
sm AS (SELECT scene, quantile_cont(ref, 0.5) AS mt, quantile_cont(rel, 0.5) AS mp FROM ok GROUP BY scene), sd AS (SELECT scene, mt, mp, avg(abs(ref - mt)) AS st, greatest(avg(abs(rel - mp)), 1e-4) AS sp, count(*) AS n FROM ok JOIN sm USING (scene) GROUP BY scene, mt, mp HAVING count(*) >= 256 AND avg(abs(ref - mt)) >= 0.3),
se AS (SELECT l1.scene, r, c, (rel - mp) / sp - (ref - mt) / st AS e FROM l1 JOIN sd USING (scene)), ss AS (SELECT scene, avg(abs(e)) AS ssi FROM se GROUP BY scene), {_loss_gradient('ssi_grad', 'se')},
sg AS (SELECT scene, avg(ln(exp(0) + exp(0.1::DOUBLE * noise) + exp(0.2::DOUBLE * noise) + exp(0.3::DOUBLE * noise)) - 0.1::DOUBLE * noise * cls) AS seg FROM l1 WHERE cls > 0 GROUP BY scene),
fin AS (SELECT scene, n, l1, ce, grad, CASE WHEN n >= 16 THEN near + far END AS chamfer, seg, ssi, ssi_grad FROM ll JOIN cs USING (scene) JOIN fa USING (scene) JOIN grad USING (scene) LEFT JOIN ss USING (scene) LEFT JOIN ssi_grad USING (scene) LEFT JOIN sg USING (scene))"""

ORACLE = {
    "shadow_pairs": sql6(f"WITH RECURSIVE {SUNLIT} SELECT scene, label, outcome, length, CASE WHEN outcome = 'pair' THEN roof END AS roof, CASE WHEN outcome = 'pair' THEN h END AS h FROM sp", "length roof h", "scene label outcome"),
    "shadow_scale": sql6(f"WITH RECURSIVE {SUNLIT}, {SCALE} SELECT scene, {', '.join(f'coalesce({k}, 0)::BIGINT AS {k}' for k in ['pair', *shadows.REASONS])}, CASE WHEN pair >= 8 THEN alpha END AS alpha, CASE WHEN pair >= 8 THEN {_SIGMA} END AS sigma_rel, CASE WHEN pair >= 8 THEN rmse END AS rmse, CASE WHEN pair >= 8 THEN bias END AS bias, CASE WHEN coalesce(pair, 0) < 8 THEN 'too few shadow pairs' END AS reason FROM sn LEFT JOIN ct USING (scene) LEFT JOIN al USING (scene) LEFT JOIN kk USING (scene)", "alpha sigma_rel rmse bias", f"scene pair {' '.join(shadows.REASONS)} reason"),
    "tile_gains": sql6(f"WITH RECURSIVE {TILED} SELECT scene, r0, c0, n, gain, \"offset\", accepted FROM tg", 'gain "offset"', "scene r0 c0 n accepted"),
    "aligned_mosaic": sql6(f"WITH RECURSIVE {TILED} SELECT tw.scene, r, c, sum((z * gain + \"offset\") * wt) / sum(wt) AS z FROM tw JOIN tg USING (scene, r0, c0) GROUP BY ALL", "z", "scene r c"),
    "projected_places": f"WITH {_PLACES}, xy AS (SELECT id, crs, {_XY[0]} AS x, {_XY[1]} AS y, {_WEB[0]} AS mx, {_WEB[1]} AS my FROM pz) SELECT id, crs, {', '.join(f'floor({c} * 1000 + 0.5) / 1000 AS {c}' for c in ('x', 'y', 'mx', 'my'))}, true AS returns FROM xy",
    "reprojected_grid": sql6(f"WITH {REGRID} SELECT t0.scene, t0.tr AS r, t0.tc AS c, CASE WHEN have >= 0.5 THEN s / greatest(have, 1e-12) END AS z FROM t0 LEFT JOIN t6 USING (scene, tr, tc)", "z", "scene r c"),
    "edge_preserved": sql6(f"WITH {BILATERAL} SELECT scene, r, c, CASE WHEN any_value(z) IS NOT NULL THEN sum(wt * v) / sum(wt) * any_value(wide) + any_value(lo) END AS clean FROM nz GROUP BY scene, r, c", "clean", "scene r c"),
    "smooth_fill": sql6(f"WITH {FILL} SELECT hz.scene, hz.r, hz.c, coalesce(hz.z, s2.v) AS z FROM hz JOIN s2 USING (scene, r, c)", "z", "scene r c"),
    "conditioned_scene": f"WITH {BANDED}, li AS (SELECT scene, {_LIMITS} FROM va GROUP BY scene) SELECT va.scene, r, c, {_STRETCHED}, valid FROM va JOIN li USING (scene)",
    "conditioning_report": sql6(f"WITH {BANDED} SELECT scene, cloud, shadow, masked, rejected, span, stretch, nullif(concat_ws(' | ', 'stretched (' || stretch || ')', CASE WHEN masked > 0.001 THEN 'masked ' || {_PM.format('masked')} || ' (cloud ' || {_PM.format('cloud')} || ', shadow ' || {_PM.format('shadow')} || ')' END, CASE WHEN rejected THEN 'too much to mask, all is valid' END), '') AS line FROM dc", "cloud shadow masked span", "scene rejected stretch line"),
    "combined_loss": sql6(f"WITH {LOSS} SELECT *, {' + '.join(f'coalesce({k}, 0) * {v}' for k, v in losses.WEIGHTS.items())} AS total FROM fin", "l1 ce grad chamfer seg ssi ssi_grad total", "scene n"),
}

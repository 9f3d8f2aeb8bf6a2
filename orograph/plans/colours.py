"""Queries of colour spaces, content keys, working sizes and unions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.tables import load
from orograph.operators import colour, metrics, scalars
from orograph.plans.base import CITY, SCENES, six, sql6
from orograph.sources import adapters as a
from orograph.sources import sinks


def _levels(spark, d):
    v = F.least(F.greatest(F.floor(F.lit(127.5) + F.lit(240.0) * F.col("z")), F.lit(0)), F.lit(255)).cast("int")
    t = a.scenes(spark, d).withColumn("red", v)
    return t.select("scene", "r", "c", "red", F.floor((F.col("red") * 7 + F.col("c")) % 256).cast("int").alias("green"), (F.lit(255) - F.col("red")).alias("blue"))


def colour_spaces(spark, d):
    s, v = colour.saturation_value(F.col("red"), F.col("green"), F.col("blue"))
    t = colour.lab(_levels(spark, d).withColumns({"saturation": s, "value": v}))
    return six(t.drop("red", "green", "blue"))


def content_keys(spark, d):
    t = a.holed(a.scenes(spark, d)).withColumn("z", F.floor(F.col("z") * 1e6) / 1e6)
    return colour.content_keys(t, 32, F.lit("v1"))


def working_sizes(spark, d):
    sizes = spark.createDataFrame([("a", 0.2), ("b", 1.19), ("c", 2.0)], "scene string, size double")
    return six(colour.at_working_size(a.holed(a.scenes(spark, d)), sizes))


def source_union(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    t = colour.tagged_union(customers=c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), suppliers=s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))
    return six(t)


def reference_on_grid(spark, d):
    t = a.scenes(spark, d)
    return six(sinks.on_grid(t.filter((F.col("r") + F.col("c")) % 5 != 0).withColumn("z", F.col("z") * 2), t))


def validation_scores(spark, d):
    t = a.holed(a.city(spark, d)).withColumn("ref", F.when(F.col("z").isNotNull(), F.col("height")))
    noise = ((F.col("r") * 31 + F.col("c") * 17) % 7 - 3).cast("double")
    t = t.withColumn("pred", F.lit(0.9) * F.col("height") + F.lit(0.3) * noise).withColumn("cls", F.col("block") % 4).withColumn("cls_pred", F.when((F.col("r") + F.col("c")) % 6 == 0, 1).otherwise(F.col("block") % 4))
    return six(metrics.validation(t, ["scene"]))


def training_crops(spark, d):
    t = a.city(spark, d).select("scene", "r", "c", F.col("height").alias("z"), (F.floor(F.col("z") * 1000) / 1000).alias("level"))
    picks = spark.createDataFrame([("a", 11, 7, 1, True), ("b", 3, 2, 2, False), ("c", 5, 0, 3, True)], "scene string, y int, x int, turns int, mirror boolean")
    return six(scalars.cropped(t, picks, 44))


QUERIES = [colour_spaces, content_keys, working_sizes, source_union, reference_on_grid, validation_scores, training_crops]

_HOLED = SCENES + ", hs AS (SELECT scene, r, c, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS z FROM ms)"
_LIN = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92::DOUBLE ELSE (({0} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE END"
_XYZ = ", ".join(f"({m[0]}::DOUBLE * lr + {m[1]}::DOUBLE * lg + {m[2]}::DOUBLE * lb) / {w}::DOUBLE AS {k}" for k, m, w in zip("xyz", colour.XYZ, colour.WHITE, strict=True))
_F = ", ".join(f"CASE WHEN {k} > 0.008856 THEN {k} ** (1 / 3.0::DOUBLE) ELSE 7.787::DOUBLE * {k} + 16 / 116.0::DOUBLE END AS f{k}" for k in "xyz")
SIZED = _HOLED + """, sz AS (SELECT dm.*, CASE scene WHEN 'a' THEN 0.2::DOUBLE / 0.3::DOUBLE WHEN 'b' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 1.2::DOUBLE END AS s FROM dm),
nd AS (SELECT *, greatest(8, round_even(h * s, 0)::INT) AS nh, greatest(8, round_even(w * s, 0)::INT) AS nw FROM sz),
dn AS (SELECT hs.scene, i AS r, j AS c, z, (least((hs.r + 1) * nh / h::DOUBLE, i + 1) - greatest(hs.r * nh / h::DOUBLE, i)) * (least((hs.c + 1) * nw / w::DOUBLE, j + 1) - greatest(hs.c * nw / w::DOUBLE, j)) AS wt
  FROM hs JOIN nd USING (scene), LATERAL (SELECT unnest(range(floor(hs.r * nh / h::DOUBLE + 1e-9)::INT, least(ceil((hs.r + 1) * nh / h::DOUBLE - 1e-9)::INT, nh))) AS i) u, LATERAL (SELECT unnest(range(floor(hs.c * nw / w::DOUBLE + 1e-9)::INT, least(ceil((hs.c + 1) * nw / w::DOUBLE - 1e-9)::INT, nw))) AS j) v WHERE s < 1),
up AS (SELECT scene, row_, col_, h, w, least(greatest((row_ + 0.5::DOUBLE) * h / nh - 0.5::DOUBLE, 0), h - 1) AS y, least(greatest((col_ + 0.5::DOUBLE) * w / nw - 0.5::DOUBLE, 0), w - 1) AS x FROM (SELECT *, unnest(range(nw))::INT AS col_ FROM (SELECT *, unnest(range(nh))::INT AS row_ FROM nd WHERE s > 1))),
u2 AS (SELECT up.scene, row_, col_, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS wt, z FROM up CROSS JOIN (SELECT i, j FROM range(2) a(i), range(2) b(j)) JOIN hs ON hs.scene = up.scene AND hs.r = least(floor(y)::INT + i, h - 1) AND hs.c = least(floor(x)::INT + j, w - 1))"""

ORACLE = {
    "colour_spaces": sql6(f"WITH {SCENES}, v AS (SELECT scene, r, c, least(greatest(floor(127.5::DOUBLE + 240.0::DOUBLE * z), 0), 255)::INT AS red FROM ms), b AS (SELECT *, (red * 7 + c) % 256 AS green, 255 - red AS blue FROM v), l AS (SELECT *, {_LIN.format('red')} AS lr, {_LIN.format('green')} AS lg, {_LIN.format('blue')} AS lb FROM b), x AS (SELECT *, {_XYZ} FROM l), f AS (SELECT *, {_F} FROM x) SELECT scene, r, c, CASE WHEN greatest(red, green, blue) > 0 THEN (greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue)::DOUBLE ELSE 0.0::DOUBLE END AS saturation, greatest(red, green, blue) / 255.0::DOUBLE AS value, 116.0::DOUBLE * fy - 16 AS lightness, 500.0::DOUBLE * (fx - fy) AS green_red, 200.0::DOUBLE * (fy - fz) AS blue_yellow FROM f", "saturation value lightness green_red blue_yellow", "scene r c"),
    "content_keys": f"WITH {_HOLED} SELECT scene, r // 32 AS tr, c // 32 AS tc, sha1('v1|' || string_agg(coalesce(printf('%.9f', floor(z * 1e6) / 1e6 + 0.0), ''), ',' ORDER BY r, c)) AS key FROM hs GROUP BY ALL",
    "working_sizes": sql6(f"WITH {SIZED} SELECT scene, r, c, z FROM hs WHERE scene = 'b' UNION ALL SELECT scene, r, c, sum(z * wt) / sum(CASE WHEN z IS NOT NULL THEN wt END) FROM dn GROUP BY ALL UNION ALL SELECT scene, row_, col_, CASE WHEN coalesce(sum(wt) FILTER (z IS NOT NULL), 0) >= 0.5 THEN sum(wt * z) / sum(wt) FILTER (z IS NOT NULL) END FROM u2 GROUP BY ALL", "z", "scene r c"),
    "source_union": sql6("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'suppliers' FROM supplier", "balance", "id segment source"),
    "reference_on_grid": sql6(f"WITH {SCENES} SELECT scene, r, c, CASE WHEN (r + c) % 5 <> 0 THEN z * 2 END AS z FROM ms", "z", "scene r c"),
    "validation_scores": sql6(f"WITH {CITY}, t AS (SELECT scene, 0.9::DOUBLE * height + 0.3::DOUBLE * ((r * 31 + c * 17) % 7 - 3)::DOUBLE AS pred, CASE WHEN (r * 64 + c) % 97 <> 0 THEN height END AS ref, block % 4 AS q, CASE WHEN (r + c) % 6 = 0 THEN 1 ELSE block % 4 END AS p FROM ct), o AS (SELECT *, pred - ref AS e FROM t WHERE ref IS NOT NULL), h AS (SELECT scene, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, covar_pop(pred, ref) / sqrt(greatest(var_pop(pred) * var_pop(ref), 1e-12)) AS r, sqrt(avg(e * e) FILTER (ref >= 10)) AS rmse_tall, avg(e) FILTER (ref >= 10) AS bias_tall FROM o GROUP BY scene), k AS (SELECT unnest([1, 2, 3]) AS k), i AS (SELECT scene, k, count(*) FILTER (p = k AND q = k) / count(*)::DOUBLE AS iou FROM t CROSS JOIN k WHERE q >= 1 AND (p = k OR q = k) GROUP BY ALL), m AS (SELECT scene, avg(iou) AS miou FROM i GROUP BY scene) SELECT * FROM h LEFT JOIN m USING (scene)", "rmse mae r rmse_tall bias_tall miou", "scene n"),
    "training_crops": sql6(f"WITH {CITY}, pk AS (SELECT * FROM (VALUES ('a', 11, 7, 1, true), ('b', 3, 2, 2, false), ('c', 5, 0, 3, true)) v(scene, y, x, turns, mirror)), g AS (SELECT pk.*, h, w, i, CASE WHEN mirror THEN 43 - j ELSE j END AS j, j AS oj FROM pk JOIN dm USING (scene) CROSS JOIN range(44) a(i) CROSS JOIN range(44) b(j)), s AS (SELECT scene, h, w, i, oj, y + CASE turns WHEN 0 THEN i WHEN 1 THEN j WHEN 2 THEN 43 - i ELSE 43 - j END AS si, x + CASE turns WHEN 0 THEN j WHEN 1 THEN 43 - i WHEN 2 THEN 43 - j ELSE i END AS sj FROM g), f AS (SELECT *, least(si % (2 * (h - 1)), 2 * (h - 1) - si % (2 * (h - 1))) AS fr, least(sj % (2 * (w - 1)), 2 * (w - 1) - sj % (2 * (w - 1))) AS fc FROM s) SELECT f.scene, i::INT AS r, oj::INT AS c, CASE WHEN si < h AND sj < w THEN height END AS z, floor(ct.z * 1000) / 1000 AS level FROM f JOIN ct ON ct.scene = f.scene AND ct.r = fr AND ct.c = fc", "z level", "scene r c"),
}

"""Queries of parsing, geometry, reporting and listing rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.functions.tables import load
from orograph.operators import scalars as s
from orograph.operators import zonal
from orograph.plans.base import G, RGB, ROWS, six, sql6
from orograph.sources import adapters as a

AT = ["scene", "r", "c"]


def utm_zones(spark, d):
    k = F.col("c_custkey").cast("double")
    return load(spark, d, "customer").select("c_custkey", s.utm_epsg(k * F.lit(7.3) % 360 - 180, k % 140 - 70).alias("epsg"))


def pixel_size(spark, d):
    k = F.col("c_custkey")
    return six(load(spark, d, "customer").select("c_custkey", s.pixel_metres(F.lit(0.0001) * (k % 9 + 1), (k % 80).cast("double"), k % 3 == 0).alias("px")))


def parse_gcps(spark, d):
    k = F.col("c_custkey").cast("string")
    text = F.concat(k, F.lit(",5,1.5;x,2,3; 7,"), k, F.lit(",2;9,9"))
    t = load(spark, d, "customer").select("c_custkey", F.explode(s.ground_points(text)).alias("p"))
    return six(t.select("c_custkey", "p.r", "p.c", "p.h"))


def parse_mix(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(F.lit("a=."), (k % 9 + 1).cast("string"), F.when(k % 2 == 0, F.lit(",b=.4")).otherwise(F.lit("")))
    return six(load(spark, d, "nation").select("n_name", s.mix_share(text, "a").alias("a"), s.mix_share(text, "b").alias("b")))


def format_pick(spark, d):
    k = F.col("n_nationkey")
    f = F.array_compact(F.array(F.when(k % 2 == 0, "image/jpeg"), F.when(k % 3 == 0, "image/tiff"), F.when(k % 5 == 0, "image/png"), F.when(k % 7 != 0, "application/x")))
    return load(spark, d, "nation").select("n_name", s.pick_format(f).alias("format"))


def engine_choice(spark, d):
    k = F.col("c_custkey")
    asked = F.element_at(F.array(*[F.lit(x) for x in ("auto", " A", "learned", "hybrid", "zeroshot")]), (k % 5 + 1).cast("int"))
    return load(spark, d, "customer").select("c_custkey", s.engine(asked, k % 2 == 0).alias("engine"), s.datum(F.when(k % 4 == 0, "relative").otherwise("absolute"), k % 3 == 0).alias("datum"))


def tile_rejects(spark, d):
    t = load(spark, d, "lineitem")
    why = F.coalesce(s.reject_reason(F.col("l_discount") * 2, F.lit(1.0) - F.col("l_tax") * 3, F.col("l_quantity") / 60), F.lit("kept"))
    return t.groupBy(why.alias("reason"), "l_returnflag").count()


def channel_normalise(spark, d):
    rgb = a.rgb(a.grid(spark, d))
    return six(rgb.select(*AT, s.normalised(F.col("red"), 0.485, 0.229).alias("red"), s.normalised(F.col("green"), 0.456, 0.224).alias("green"), s.normalised(F.col("blue"), 0.406, 0.225).alias("blue")))


def viewer_slope(spark, d):
    k = F.col("c_custkey")
    return six(load(spark, d, "customer").select("c_custkey", s.true_slope((k % 85).cast("double"), (k % 4 + 1).cast("double")).alias("slope"), *[v.alias(n) for n, v in s.measured((k % 13).cast("double"), (k % 7).cast("double"), (k % 5 - 2).cast("double")).items()]))


def axis_ticks(spark, d):
    k = F.col("c_custkey").cast("double")
    return six(load(spark, d, "customer").select("c_custkey", s.tick_step(F.lit(0.0), k * F.lit(1.7), 5).alias("step")))


def rate_schedule(spark, d):
    return six(load(spark, d, "customer").select("c_custkey", s.cosine_rate(F.col("c_custkey"), 100, 1000, 0.01).alias("rate")))


def smoothed_progress(spark, d):
    t = load(spark, d, "events").select("user_id", "event_id", "value")
    return six(s.smoothed(t, ["user_id"], "event_id", "value", 0.5).select("event_id", "ema"))


def quarter_turn(spark, d):
    return six(s.rotated(a.grid(spark, d).select(*AT, "z"), 1).select(*AT, "z"))


def label_downsample(spark, d):
    t = a.grid(spark, d).filter((F.col("r") % 4 == 0) & (F.col("c") % 4 == 0))
    return t.select("scene", F.floor(F.col("r") / 4).cast("int").alias("r"), F.floor(F.col("c") / 4).cast("int").alias("c"), "label")


def reference_ndsm(spark, d):
    t = a.grid(spark, d).withColumn("k", F.col("r") * 64 + F.col("c"))
    dtm = zonal.nearest_fill(t.select(*AT, F.when(F.col("k") % 5 != 0, F.col("z") - F.lit(0.2)).alias("z")), 2)
    both = t.select(*AT, F.when(F.col("k") % 11 != 0, F.col("z")).alias("dsm")).join(dtm.select(*AT, F.col("z").alias("dtm")), AT)
    return six(both.select(*AT, F.greatest(F.coalesce(F.col("dsm") - F.col("dtm"), F.lit(0.0)), F.lit(0.0)).alias("ndsm")))


def scene_listing(spark, d):
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag")
    rgb, ref, cls = t.filter("l_linestatus = 'O'").select("l_orderkey").distinct(), t.filter("l_returnflag = 'N'").select("l_orderkey").distinct(), t.filter("l_returnflag = 'R'").groupBy("l_orderkey").count()
    out = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(rgb, "l_orderkey", "left_semi").join(ref, "l_orderkey", "left_semi").join(cls, "l_orderkey", "left")
    return out.select("l_orderkey", F.coalesce("count", F.lit(255)).alias("cls"))


def split_counts(spark, d):
    t = load(spark, d, "part").select(F.element_at(F.split("p_type", " "), 1).alias("source"), "p_brand")
    return t.rollup("source", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def mergeable_accumulator(spark, d):
    t = a.scored_rows(spark, d).withColumn("e", F.col("pred") - F.col("ref"))
    part = t.groupBy("region", "scene").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in {"se": F.col("e"), "see": F.col("e") * F.col("e"), "sae": F.abs("e")}.items()])
    out = part.groupBy("region").agg(F.sum("n").alias("n"), F.sum("se").alias("se"), F.sum("see").alias("see"), F.sum("sae").alias("sae"))
    return six(out.select("region", "n", F.sqrt(F.col("see") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"), (F.col("se") / F.col("n")).alias("bias")))


def report_rows(spark, d):
    t = a.scored_rows(spark, d).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("pred") - F.col("ref")) ** 2)).alias("rmse"))
    w = W.orderBy(F.col("rmse").desc())
    return t.select(F.row_number().over(w).alias("place"), F.concat(F.lit("| "), "region", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("row"))


def map_equalise(spark, d):
    v = F.least(F.greatest(F.col("z") + F.lit(0.5), F.lit(0.0)), F.lit(1.0))
    return six(s.equalised(a.grid(spark, d).select(*AT, v.alias("v")), 16, 2.0))


QUERIES = [utm_zones, pixel_size, parse_gcps, parse_mix, format_pick, engine_choice, tile_rejects, channel_normalise, viewer_slope, axis_ticks, rate_schedule, smoothed_progress, quarter_turn, label_downsample, reference_ndsm, scene_listing, split_counts, mergeable_accumulator, report_rows, map_equalise]

C = "FROM customer"
ORACLE = {
    "utm_zones": f"SELECT c_custkey, (CASE WHEN c_custkey::DOUBLE % 140 - 70 >= 0 THEN 32600 ELSE 32700 END + floor((c_custkey::DOUBLE * 7.3::DOUBLE % 360 - 180 + 180) / 6)::INT + 1)::INT AS epsg {C}",
    "pixel_size": sql6(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0001::DOUBLE * (c_custkey % 9 + 1) ELSE 0.0001::DOUBLE * (c_custkey % 9 + 1) * 111320.0::DOUBLE * cos(radians((c_custkey % 80)::DOUBLE)) END AS px {C}", "px", "c_custkey"),
    "parse_gcps": sql6(f"SELECT c_custkey, c_custkey::INT AS r, 5 AS c, 1.5 AS h {C} UNION ALL SELECT c_custkey, 7, c_custkey::INT, 2 {C}", "h", "c_custkey r c"),
    "parse_mix": sql6("SELECT n_name, (n_nationkey % 9 + 1) / 10.0::DOUBLE AS a, CASE WHEN n_nationkey % 2 = 0 THEN 0.4::DOUBLE END AS b FROM nation", "a b", "n_name"),
    "format_pick": "SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'image/png' WHEN n_nationkey % 3 = 0 THEN 'image/tiff' WHEN n_nationkey % 2 = 0 THEN 'image/jpeg' WHEN n_nationkey % 7 <> 0 THEN 'application/x' END AS format FROM nation",
    "engine_choice": f"SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'hybrid' ELSE 'zeroshot' END WHEN 1 THEN 'zeroshot' WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'metric' END WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'hybrid' END ELSE 'zeroshot' END AS engine, CASE WHEN c_custkey % 4 = 0 THEN 'relative' WHEN c_custkey % 3 = 0 THEN 'sea level' ELSE 'local ground' END AS datum {C}",
    "tile_rejects": "SELECT CASE WHEN l_discount * 2 > 0.15 THEN 'blank' WHEN 1.0::DOUBLE - l_tax * 3 < 0.8::DOUBLE THEN 'too few valid pixels' WHEN l_quantity / 60 > 0.5 THEN 'water' ELSE 'kept' END AS reason, l_returnflag, count(*) AS count FROM lineitem GROUP BY ALL",
    "channel_normalise": sql6(f"WITH {G}, {RGB} SELECT scene, r, c, (red / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE AS red, (green / 255.0::DOUBLE - 0.456::DOUBLE) / 0.224::DOUBLE AS green, (blue / 255.0::DOUBLE - 0.406::DOUBLE) / 0.225::DOUBLE AS blue FROM rgb", "red green blue", "scene r c"),
    "viewer_slope": sql6(f"SELECT c_custkey, degrees(atan(tan(radians((c_custkey % 85)::DOUBLE)) / (c_custkey % 4 + 1))) AS slope, sqrt((c_custkey % 13) ** 2 + (c_custkey % 7) ** 2) AS ground, degrees(atan2((c_custkey % 5 - 2)::DOUBLE, greatest(sqrt((c_custkey % 13) ** 2 + (c_custkey % 7) ** 2), 1e-9))) AS grade_deg {C}", "slope ground grade_deg", "c_custkey"),
    "axis_ticks": sql6(f"WITH t AS (SELECT c_custkey, greatest(c_custkey::DOUBLE * 1.7::DOUBLE / 5, 1e-9) AS raw {C}), p AS (SELECT *, 10.0::DOUBLE ** floor(log10(raw)) AS p FROM t) SELECT c_custkey, p * CASE WHEN raw / p <= 1 THEN 1 WHEN raw / p <= 2 THEN 2 WHEN raw / p <= 2.5 THEN 2.5 WHEN raw / p <= 5 THEN 5 ELSE 10 END AS step FROM p", "step", "c_custkey"),
    "rate_schedule": sql6(f"SELECT c_custkey, CASE WHEN c_custkey < 100 THEN (c_custkey + 1) / 100.0::DOUBLE ELSE 0.01::DOUBLE + 0.99::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(greatest((c_custkey - 100) / 900.0::DOUBLE, 0), 1))) END AS rate {C}", "rate", "c_custkey"),
    "smoothed_progress": sql6("WITH t AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM events) SELECT event_id, list_reduce(xs, lambda acc, x: acc * 0.5::DOUBLE + x * 0.5::DOUBLE) AS ema FROM t", "ema", "event_id"),
    "quarter_turn": sql6(f"WITH {G} SELECT scene, 63 - c AS r, r AS c, z FROM g", "z", "scene r c"),
    "label_downsample": f"WITH {G} SELECT scene, r // 4 AS r, c // 4 AS c, label FROM g WHERE r % 4 = 0 AND c % 4 = 0",
    "reference_ndsm": sql6(f"WITH {G}, t AS (SELECT r, c, CASE WHEN (r * 64 + c) % 5 <> 0 THEN z - 0.2::DOUBLE END AS z FROM g), o AS (SELECT i, j, i * i + j * j AS d2 FROM (SELECT unnest(range(-2, 3)) AS i) CROSS JOIN (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j BETWEEN 1 AND 4), f AS (SELECT a.r, a.c, arg_min(b.z, b.r * 1000 + b.c + d2 * 10000000000) AS f FROM t a CROSS JOIN o JOIN t b ON b.r = a.r + i AND b.c = a.c + j WHERE a.z IS NULL AND b.z IS NOT NULL GROUP BY ALL) SELECT 'g' AS scene, g.r, g.c, greatest(coalesce(CASE WHEN (g.r * 64 + g.c) % 11 <> 0 THEN g.z END - coalesce(t.z, f), 0), 0) AS ndsm FROM g JOIN t ON t.r = g.r AND t.c = g.c LEFT JOIN f ON f.r = g.r AND f.c = g.c", "ndsm", "scene r c"),
    "scene_listing": "SELECT o_orderkey AS l_orderkey, coalesce(n, 255) AS cls FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON k = o_orderkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')",
    "split_counts": "SELECT split_part(p_type, ' ', 1) AS source, p_brand, count(*) AS n, grouping_id(split_part(p_type, ' ', 1), p_brand) AS level FROM part GROUP BY ROLLUP (split_part(p_type, ' ', 1), p_brand)",
    "mergeable_accumulator": sql6(f"WITH {ROWS} SELECT region, count(*) AS n, sqrt(avg((pred - ref) ** 2)) AS rmse, avg(abs(pred - ref)) AS mae, avg(pred - ref) AS bias FROM rw GROUP BY region", "rmse mae bias", "region n"),
    "report_rows": f"WITH {ROWS}, t AS (SELECT region, count(*) AS n, sqrt(avg((pred - ref) ** 2)) AS rmse FROM rw GROUP BY region) SELECT row_number() OVER (ORDER BY rmse DESC) AS place, '| ' || region || ' | ' || n || ' |' AS row FROM t",
    "map_equalise": sql6(f"""WITH {G}, t AS (SELECT r, c, least(floor(least(greatest(z + 0.5::DOUBLE, 0), 1) * 64), 63)::INT AS bin, r // 16 AS tr, c // 16 AS tc FROM g), n AS (SELECT tr, tc, bin, count(*) AS n FROM t GROUP BY ALL), sz AS (SELECT tr, tc, sum(n) AS size FROM n GROUP BY ALL),
 sp AS (SELECT tr, tc, size, b AS bin FROM sz CROSS JOIN (SELECT unnest(range(64))::INT AS b)), m AS (SELECT sp.tr, sp.tc, sp.bin, size, coalesce(n, 0)::DOUBLE AS n, 2.0::DOUBLE * size / 64 AS lim FROM sp LEFT JOIN n ON n.tr = sp.tr AND n.tc = sp.tc AND n.bin = sp.bin),
 q AS (SELECT *, least(n, lim) + sum(greatest(n - lim, 0)) OVER (PARTITION BY tr, tc) / 64 AS m FROM m), lut AS (SELECT tr, tc, bin, sum(m) OVER (PARTITION BY tr, tc ORDER BY bin) / size AS share FROM q), la AS (SELECT max(tr) AS mr, max(tc) AS mc FROM sz),
 p AS (SELECT r, c, bin, mr, mc, least(greatest((r - 7.5::DOUBLE) / 16, 0), mr) AS y, least(greatest((c - 7.5::DOUBLE) / 16, 0), mc) AS x FROM t, la),
 k AS (SELECT *, least(floor(y) + i, mr)::INT AS tr, least(floor(x) + j, mc)::INT AS tc, CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM p CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j))
 SELECT 'g' AS scene, r, c, sum(w * share) AS v FROM k JOIN lut ON lut.tr = k.tr AND lut.tc = k.tc AND lut.bin = k.bin GROUP BY ALL""", "v", "scene r c"),
}

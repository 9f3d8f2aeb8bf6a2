"""Queries of scan rules, value scaling, listings and score summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import load
from orograph.operators import focal, local, metrics, scans
from orograph.plans.base import G, PR, RGB, ROWS, six, sql6
from orograph.plans.rasters import slope as slope_sql
from orograph.sources import adapters as a


def _nations(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))


def decimate_budget(spark, d):
    return six(scans.decimated(a.grid(spark, d), 3000))


def colour_bands(spark, d):
    names = F.array(*[F.array(*[F.lit(x).cast("string") for x in row]) for row in NAMES])
    roles = F.array(*[F.array(*[F.lit(x).cast("string") for x in row]) for row in ROLES])
    t = _nations(spark, d).withColumn("i", (F.col("k") % len(NAMES) + 1).cast("int"))
    t = t.withColumn("names", F.element_at(names, F.col("i"))).withColumn("roles", F.element_at(roles, F.col("i")))
    return t.select("name", scans.colour_bands(F.size("names"), F.col("roles"), F.col("names")).alias("b")).select("name", "b.*")


def cell_window(spark, d):
    t = a.grid(spark, d).select("r", "c", (F.col("z") * 1000.0).alias("v"))
    return six(scans.cell_window(t, (500.0, 1200.0, 3050.0, 9999.5), 100.0, scale=0.5, offset=2.0))


def local_file_pick(spark, d):
    k = F.col("k")
    tiles = load(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("id"), (F.col("r_regionkey") * 10.0).alias("left"), F.lit(0.0).alias("bottom"), (F.col("r_regionkey") * 10.0 + 10.0).alias("right"), F.lit(10.0).alias("top"))
    path = F.concat(F.when(k % 4 == 0, "other_").otherwise("ghs_built_h_"), F.col("name"), F.lit("_R"), (k % 7).cast("string"), F.lit(".tif"))
    files = _nations(spark, d).filter("k % 7 <> 2").select(path.alias("path"), ((k % 9) * 5.0).alias("left"), F.lit(-1.0).alias("bottom"), ((k % 9) * 5.0 + 20.0).alias("right"), F.lit(11.0).alias("top"))
    return scans.local_file(tiles, files, "BUILT_H")


def scene_boxes(spark, d):
    k = F.col("c_custkey").cast("double")
    t = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (k * 7 % 360 - 180).alias("lon"), (k * 11 % 160 - 80).alias("lat"))
    box = scans.box_around(F.col("lon"), F.col("lat"), F.lit(0.5))
    return six(t.select("id", *[v.alias(n) for n, v in scans.padded(*box.values()).items()], scans.utm_zone(F.col("lon"), F.col("lat")).alias("epsg")))


def capability_layers(spark, d):
    one = lambda s: F.concat(F.lit("<ns:Layer><ns:Title>t</ns:Title><ns:Name>"), F.translate("name", " ", "_"), F.lit(f"_{s}</ns:Name></ns:Layer>"))
    xml = F.concat(F.lit('<w:Caps xmlns:w="http://a" xmlns:ns="http://b"><ns:Name>root</ns:Name>'), one("dsm"), one("dtm"), F.lit("</w:Caps>"))
    return _nations(spark, d).select("k", F.explode(scans.capability_names(xml, "Layer")).alias("layer"))


def largest_dataset(spark, d):
    t = load(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("dataset"), (F.col("p_partkey") % 4).alias("dims"), (F.col("p_size") * F.col("p_partkey")).cast("long").alias("size"))
    return t.filter("dims >= 2").groupBy("file").agg(F.max_by("dataset", F.struct("size", "dataset")).alias("dataset"), F.max("size").alias("size"))


def tile_listing(spark, d):
    k = F.col("c_custkey")
    t = load(spark, d, "customer").select(k, F.when(k % 5 == 0, "val").otherwise("train").alias("s"))
    path = lambda kind: F.concat("s", F.lit(f"/{kind.lower()}/t"), k.cast("string"), F.lit(f"_{kind}.tif")).alias("path")
    return scans.tile_listing(t.select(path("RGB")), t.filter(k % 3 != 0).select(path("AGL")), t.filter(k % 4 == 0).select(path("CLS")))


def gathered_index(spark, d):
    split = lambda k: F.when(k % 10 == 0, "test").when(k % 10 == 1, "val").otherwise("train").alias("split")
    one = load(spark, d, "customer").select(F.lit("one").alias("root"), F.col("c_custkey").alias("id"), split(F.col("c_custkey")))
    two = load(spark, d, "supplier").select(F.lit("two").alias("root"), F.col("s_suppkey").alias("id"), split(F.col("s_suppkey")))
    return one.unionByName(two).filter(F.col("split").isin("val", "test")).orderBy("id")


def training_minus_test(spark, d):
    every = load(spark, d, "customer").select(F.col("c_nationkey").alias("tile"))
    return every.subtract(load(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("tile")))


def env_settings(spark, d):
    k, n = F.col("k"), F.translate("name", " ", "_")
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), n)).when(k % 5 == 1, F.concat(n, F.lit(" = 'v="), k.cast("string"), F.lit("' "))).when(k % 5 == 2, F.lit("  SHARED=\"first\" ")).when(k % 5 == 3, F.lit("")).otherwise(F.concat(n, F.lit("="), k.cast("string")))
    lines = _nations(spark, d).select(F.lit("f").alias("file"), k.alias("i"), line.alias("line"))
    given = _nations(spark, d).filter("k IN (1, 4, 20)").select(n.alias("key"), F.lit("given").alias("value"))
    return scans.settings(lines, given)


def error_density(spark, d):
    t = a.scored_rows(spark, d).select("pred", "ref").withColumn("all", F.lit(1))
    q = quantiles(t, ["all"], p=("pred", 0.005, 0.995), r=("ref", 0.005, 0.995))
    lo, hi = F.least(F.col("p")[0], F.col("r")[0]), F.greatest(F.col("p")[1], F.col("r")[1])
    return six(scans.density(t.join(q, "all"), lo, hi, 20))


def evaluation_pivot(spark, d):
    t = metrics.metrics(a.scored_rows(spark, d), ["region", "cls"])
    return six(t.groupBy("region").pivot("cls", ["A", "N", "R"]).agg(F.first("rmse")))


def profile_lines(spark, d):
    t = a.pred_ref(a.holed(a.grid(spark, d))).filter("r = 5")
    n = lambda c: F.coalesce(F.when(F.col(c) >= 0, F.floor(F.col(c) * 1000 + 0.5)).otherwise(-F.floor(-F.col(c) * 1000 + 0.5)).cast("long").cast("string"), F.lit(""))
    return t.select("c", F.concat_ws(",", F.col("c").cast("string"), n("pred"), n("ref")).alias("line"))


def luma_normalised(spark, d):
    t = a.rgb(a.grid(spark, d)).withColumn("g", local.luma601(*[F.col(b).cast("double") for b in ("red", "green", "blue")]))
    t = local.with_scene(t, lo=F.min("g"), hi=F.max("g"))
    return six(t.select("scene", "r", "c", ((F.col("g") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))).alias("luma")))


def relative_height(spark, d):
    return six(local.with_scene(a.holed(a.grid(spark, d)), q=("z", 0.005, 0.998)).select("scene", "r", "c", local.normalised("z").alias("z")))


def quantise8(spark, d):
    return local.with_scene(a.grid(spark, d), q=("z", 0.02, 0.98)).select("scene", "r", "c", F.floor(local.normalised("z") * 255).cast("int").alias("v"))


def tile_refusals(spark, d):
    t = a.holed(a.grid(spark, d)).groupBy("scene", F.floor(F.col("r") / 16).alias("i")).agg(F.avg((F.col("z") < -0.1).cast("double")).alias("blank"), F.avg(F.col("z").isNotNull().cast("double")).alias("valid"), F.avg((F.col("z") > 0.0).cast("double")).alias("water"))
    return six(t.withColumn("reason", scans.tile_reason(F.col("blank"), F.col("valid"), F.col("water"))))


def prior_gains(spark, d):
    return _nations(spark, d).select("k", scans.prior_gain(F.when(F.col("k") % 2 == 0, "Tallest").otherwise("median"), F.when(F.col("k") % 3 == 0, "GHSL").otherwise("person"), tallest=0.85).alias("gain"))


def click_readout(spark, d):
    k = F.col("c_custkey")
    p = load(spark, d, "customer").select(k.alias("id"), (k * 7 % 500).cast("int").alias("r"), (k * 13 % 64).cast("int").alias("c"))
    return six(p.join(a.holed(a.grid(spark, d)), ["r", "c"]).select("id", F.col("z").alias("height"), F.lit("m").alias("unit")))


def reexported_ndsm(spark, d):
    t = a.pred_ref(a.grid(spark, d))
    return six(t.select("scene", "r", "c", F.greatest(F.col("pred") - F.col("ref"), F.lit(0.0)).alias("ndsm")))


def control_gain(spark, d):
    k = F.col("k")
    p = _nations(spark, d).select(F.lit("g").alias("scene"), (k * 37 - 20).alias("r"), (k * 5 - 10).alias("c"), (k * 0.25 + 1).cast("double").alias("h"))
    return six(scans.control_gain(a.grid(spark, d), p, least=0.02))


def class_stability(spark, d):
    return six(scans.stability(metrics.metrics(a.scored_rows(spark, d), ["region", "cls"]), ["region"], "cls"))


def pooled_before_after(spark, d):
    t = a.scored_rows(spark, d).groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("pred") - F.col("ref")) ** 2)).alias("rmse_before"), F.sqrt(F.avg((F.col("pred") * 0.8 - F.col("ref")) ** 2)).alias("rmse_after"), F.avg("ref").alias("obj_before"), F.max(F.when(F.col("cls") == "A", F.col("ref"))).alias("obj_after"))
    return six(scans.before_after(t, ["rmse", "obj"]))


def tile_statistics(spark, d):
    t = a.holed(a.grid(spark, d)).withColumn("i", F.floor(F.col("r") / 16))
    by = ["scene", "i"]
    q = quantiles(t, by, p50=("z", 0.5), p99=("z", 0.99))
    return six(q.join(t.groupBy(*by).agg(F.max("z").alias("h_max"), F.avg(F.col("z").isNotNull().cast("double")).alias("valid")), by))


def unit_check(spark, d):
    t = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.percentile("o_totalprice", F.lit(0.99)).alias("p99"), F.max("o_totalprice").alias("h_max"))
    return six(scans.unit_check(t))


def result_summary(spark, d):
    t = focal.slope_deg(a.grid(spark, d), 1.0)
    q = quantiles(t, ["scene"], s=("slope", 0.5, 0.99))
    e = t.groupBy("scene").agg(F.min("z").alias("min_m"), F.max("z").alias("max_m"), (F.max("z") - F.min("z")).alias("relief_m"), (F.max("r") * F.max("c") * 2).cast("long").alias("triangles"))
    return six(e.join(q, "scene").select("scene", "min_m", "max_m", "relief_m", F.col("s")[0].alias("median_slope_deg"), F.col("s")[1].alias("p99_slope_deg"), "triangles"))


def value_runs(spark, d):
    t = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.col("o_orderstatus").alias("v"))
    return scans.run_starts(t, ["k"], "i", "v")


def scene_subset(spark, d):
    t = load(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return t.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).orderBy("id").limit(25)


def disc_places(spark, d):
    k = F.col("k")
    discs = _nations(spark, d).select(F.col("name").alias("area"), (k * 20000.0).alias("cx"), (k * 10000.0).alias("cy"), (F.lit(4000.0) + k * 100).alias("radius"))
    sites = _nations(spark, d).filter("k % 2 = 0").select((k * 20000.0 + 1000).alias("sx"), (k * 10000.0 - 500).alias("sy"))
    return six(scans.disc_places(discs, sites, tries=12, step=50.0, apart=2500.0))


def random_subset(spark, d):
    return scans.hashed_subset(load(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", 40, 3)


def job_layers(spark, d):
    k = F.col("k")
    layers = spark.createDataFrame([("height", True), ("slope", True), ("uncertainty", False)], "layer string, always boolean")
    jobs = _nations(spark, d).select(k, (k % 3 == 0).alias("spread"), F.when(k % 4 == 0, "m*").otherwise("m").alias("unit"))
    # three layers a job
    return jobs.join(F.broadcast(layers), F.col("always") | F.col("spread")).select("k", "layer", F.when(F.col("layer") == "slope", "deg").otherwise(F.col("unit")).alias("unit"))


def engine_results(spark, d):
    k = F.col("k")
    configs = _nations(spark, d).select(k.alias("key"), F.col("name").alias("label"), (k % 6 == 0).alias("needs_model"))
    s = F.col("s_suppkey")
    results = load(spark, d, "supplier").filter("s_nationkey % 5 <> 1").select(F.col("s_nationkey").cast("long").alias("key"), F.when((F.col("s_nationkey") % 7 == 3) | (s % 3 == 0), F.concat(F.lit("bad|"), F.lpad(s.cast("string"), 6, "0"))).alias("error"), F.when(s % 3 != 0, F.col("s_acctbal")).alias("rmse"))
    return six(scans.run_results(configs, results, have_model=False))


def grid_mismatch(spark, d):
    t = a.grid(spark, d)
    named = lambda s: t.withColumn("scene", F.lit(s))
    one = named("same").unionByName(named("cut")).unionByName(named("alone"))
    return scans.grids_differ(one, named("same").unionByName(named("cut").filter("c < 60")))


QUERIES = [decimate_budget, colour_bands, cell_window, local_file_pick, scene_boxes, capability_layers, largest_dataset, tile_listing, gathered_index, training_minus_test, env_settings, error_density, evaluation_pivot, profile_lines, luma_normalised, relative_height, quantise8, tile_refusals, prior_gains, click_readout, reexported_ndsm, control_gain,
           class_stability, pooled_before_after, tile_statistics, unit_check, result_summary, value_runs, scene_subset, disc_places, random_subset, job_layers, engine_results, grid_mismatch]

#: Band names and declared roles of seven kinds of files.
NAMES = [["a"], ["b1", "b2", "b3"], ["Blue", "Green", "Red", "NIR"], ["nir", "red", "green"], [None, None, None], [" R ", "G", "B"], ["near ir", "x", "red", "grn"]]
ROLES = [["gray"], ["blue", "green", "red"], [None, None, None, None], [None, None, None], [None, None, None], ["red", None, "blue"], [None, "red", "green", None]]

PX = "scene r c"
N = "n AS (SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation)"


def _list(rows) -> str:
    return "[" + ", ".join("[" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + "]" for row in rows) + "]"


def _scaled(src: str, v: str, lo: float, hi: float) -> str:
    return f"q AS (SELECT quantile_cont({v}, {lo}) AS a, quantile_cont({v}, {hi}) AS b FROM {src}), x AS (SELECT scene, r, c, least(greatest(({v} - a) / greatest(b - a, 1e-9::DOUBLE), 0), 1) AS x, {v} IS NULL AS no FROM {src}, q)"


RMSE = "m AS (SELECT region, cls, sqrt(avg((pred - ref) ** 2)) AS rmse FROM rw GROUP BY ALL HAVING count(*) >= 10)"
ORACLE = {
    "decimate_budget": sql6(f"WITH {G}, d AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM g), f AS (SELECT h, w, min(k) AS dec FROM d CROSS JOIN (SELECT unnest(range(1, 65)) AS k) WHERE (h // k) * (w // k) <= 3000 GROUP BY ALL) SELECT scene, r // dec AS r, c // dec AS c, dec, avg(z) AS z FROM g, f WHERE r // dec < h // dec AND c // dec < w // dec GROUP BY ALL", "z", PX + " dec"),
    "colour_bands": f"""WITH {N}, t AS (SELECT name, ({_list(NAMES)})[k % 7 + 1] AS nm, ({_list(ROLES)})[k % 7 + 1] AS ro FROM n),
 p AS (SELECT *, list_transform(nm, lambda x: lower(trim(coalesce(x, '')))) AS l FROM t),
 i AS (SELECT *, list_position(ro, 'red') AS dr, list_position(ro, 'green') AS dg, list_position(ro, 'blue') AS db, list_position(list_transform(l, lambda x: starts_with(x, 'r')), true) AS r, list_position(list_transform(l, lambda x: starts_with(x, 'g')), true) AS g, list_position(list_transform(l, lambda x: starts_with(x, 'b')), true) AS b, list_position(list_transform(l, lambda x: starts_with(x, 'nir') OR starts_with(x, 'near')), true) AS i FROM p),
 k AS (SELECT *, CASE WHEN len(nm) = 1 THEN 'grey' WHEN dr > 0 AND dg > 0 AND db > 0 THEN 'declared' WHEN r > 0 AND g > 0 AND b > 0 THEN 'named' WHEN i > 0 AND r > 0 AND g > 0 THEN 'false colour' ELSE 'first three' END AS rule FROM i)
 SELECT name, (CASE rule WHEN 'declared' THEN dr WHEN 'named' THEN r WHEN 'false colour' THEN r ELSE 1 END)::INT AS red, (CASE rule WHEN 'grey' THEN 1 WHEN 'declared' THEN dg WHEN 'named' THEN g WHEN 'false colour' THEN g ELSE 2 END)::INT AS green, (CASE rule WHEN 'grey' THEN 1 WHEN 'declared' THEN db WHEN 'named' THEN b WHEN 'false colour' THEN g ELSE 3 END)::INT AS blue, rule FROM k""",
    "cell_window": sql6(f"WITH {G} SELECT r, c, z * 1000.0::DOUBLE * 0.5::DOUBLE + 2.0::DOUBLE AS v FROM g WHERE c BETWEEN 5 AND 30 AND r BETWEEN 12 AND 99 AND z * 1000.0::DOUBLE * 0.5::DOUBLE + 2.0::DOUBLE BETWEEN 0 AND 500", "v", "r c"),
    "local_file_pick": f"""WITH {N}, t AS (SELECT 'R' || r_regionkey AS id, r_regionkey * 10.0 AS l FROM region), f AS (SELECT CASE WHEN k % 4 = 0 THEN 'other_' ELSE 'ghs_built_h_' END || name || '_R' || (k % 7) || '.tif' AS path, 'R' || (k % 7) AS fid, (k % 9) * 5.0 AS fl FROM n WHERE k % 7 <> 2 AND k % 4 <> 0),
 a AS (SELECT id, min(path) AS p FROM t JOIN f ON id = fid GROUP BY id), b AS (SELECT id, min(path) AS p FROM t JOIN f ON l >= fl AND l + 10 <= fl + 20 GROUP BY id) SELECT id, coalesce(a.p, b.p) AS path, CASE WHEN coalesce(a.p, b.p) IS NOT NULL THEN a.p IS NOT NULL END AS by_name FROM t LEFT JOIN a USING (id) LEFT JOIN b USING (id)""",
    "scene_boxes": sql6("WITH t AS (SELECT c_custkey AS id, (c_custkey * 7 % 360 - 180)::DOUBLE AS lon, (c_custkey * 11 % 160 - 80)::DOUBLE AS lat FROM customer) SELECT id, lon - 0.26::DOUBLE AS west, lat - 0.26::DOUBLE AS south, lon + 0.26::DOUBLE AS east, lat + 0.26::DOUBLE AS north, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::INT AS epsg FROM t", "west south east north", "id epsg"),
    "capability_layers": f"WITH {N} SELECT k, unnest([translate(name, ' ', '_') || '_dsm', translate(name, ' ', '_') || '_dtm']) AS layer FROM n",
    "largest_dataset": "SELECT p_brand AS file, arg_max(p_name, (p_size * p_partkey, p_name)) AS dataset, max((p_size * p_partkey)::BIGINT) AS size FROM part WHERE p_partkey % 4 >= 2 GROUP BY p_brand",
    "tile_listing": "WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM customer) SELECT split, 't' || k AS id, split || '/rgb/t' || k || '_RGB.tif' AS image, split || '/agl/t' || k || '_AGL.tif' AS height, CASE WHEN k % 4 = 0 THEN split || '/cls/t' || k || '_CLS.tif' END AS cls FROM t WHERE k % 3 <> 0",
    "gathered_index": "WITH t AS (SELECT 'one' AS root, c_custkey AS id FROM customer UNION ALL SELECT 'two', s_suppkey FROM supplier) SELECT root, id, CASE WHEN id % 10 = 0 THEN 'test' ELSE 'val' END AS split FROM t WHERE id % 10 < 2",
    "training_minus_test": "SELECT c_nationkey AS tile FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0",
    "env_settings": f"""WITH {N}, t AS (SELECT k, translate(name, ' ', '_') AS n FROM n), e AS (SELECT n AS key, CASE WHEN k % 5 = 1 THEN 'v=' || k ELSE k::VARCHAR END AS value FROM t WHERE k % 5 IN (1, 4) UNION ALL SELECT 'SHARED', 'first'), v AS (SELECT n AS key FROM t WHERE k IN (1, 4, 20))
 SELECT key, CASE WHEN v.key IS NOT NULL THEN 'given' ELSE value END AS value FROM e FULL JOIN v USING (key)""",
    "error_density": sql6(f"WITH {ROWS}, q AS (SELECT least(quantile_cont(pred, 0.005), quantile_cont(ref, 0.005)) AS lo, greatest(quantile_cont(pred, 0.995), quantile_cont(ref, 0.995)) AS hi FROM rw), b AS (SELECT floor((ref - lo) / greatest(hi - lo, 1e-12::DOUBLE) * 20)::INT AS bx, floor((pred - lo) / greatest(hi - lo, 1e-12::DOUBLE) * 20)::INT AS by FROM rw, q) SELECT bx, \"by\", count(*) AS n, log10(count(*)) AS log_n FROM b WHERE bx BETWEEN 0 AND 19 AND \"by\" BETWEEN 0 AND 19 GROUP BY ALL", "log_n", 'bx "by" n'),
    "evaluation_pivot": sql6(f"WITH {ROWS}, {RMSE} SELECT region, max(rmse) FILTER (cls = 'A') AS \"A\", max(rmse) FILTER (cls = 'N') AS \"N\", max(rmse) FILTER (cls = 'R') AS \"R\" FROM m GROUP BY region", '"A" "N" "R"', "region"),
    "profile_lines": f"WITH {G}, h AS (SELECT scene, r, c, label, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS z FROM g), {PR} SELECT c, c || ',' || coalesce((sign(pred) * floor(abs(pred) * 1000 + 0.5))::BIGINT::VARCHAR, '') || ',' || coalesce((sign(ref) * floor(abs(ref) * 1000 + 0.5))::BIGINT::VARCHAR, '') AS line FROM pr WHERE r = 5",
    "luma_normalised": sql6(f"WITH {G}, {RGB}, t AS (SELECT scene, r, c, 0.299::DOUBLE * red + 0.587::DOUBLE * green + 0.114::DOUBLE * blue AS g FROM rgb) SELECT scene, r, c, (g - min(g) OVER ()) / greatest(max(g) OVER () - min(g) OVER (), 1e-9::DOUBLE) AS luma FROM t", "luma", PX),
    "relative_height": sql6(f"WITH {G}, h AS (SELECT scene, r, c, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS z FROM g), {_scaled('h', 'z', 0.005, 0.998)} SELECT scene, r, c, CASE WHEN NOT no THEN x END AS z FROM x", "z", PX),
    "quantise8": f"WITH {G}, {_scaled('g', 'z', 0.02, 0.98)} SELECT scene, r, c, floor(x * 255)::INT AS v FROM x",
    "tile_refusals": sql6(f"WITH {G}, h AS (SELECT scene, r, c, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS z FROM g), t AS (SELECT scene, r // 16 AS i, avg((z < -0.1::DOUBLE)::INT) AS blank, count(z) / count(*) AS valid, avg((z > 0)::INT) AS water FROM h GROUP BY ALL) SELECT *, CASE WHEN blank > 0.15 THEN 'blank image' WHEN valid < 0.8 THEN 'missing height' WHEN water > 0.5 THEN 'mostly water' END AS reason FROM t", "blank valid water", "scene i reason"),
    "prior_gains": f"WITH {N} SELECT k, (CASE WHEN k % 3 = 0 THEN 1.0 WHEN k % 2 = 0 THEN 0.85 ELSE 1.0 END)::DOUBLE AS gain FROM n",
    "click_readout": sql6(f"WITH {G} SELECT c_custkey AS id, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS height, 'm' AS unit FROM customer JOIN g ON r = c_custkey * 7 % 500 AND c = c_custkey * 13 % 64", "height", "id unit"),
    "reexported_ndsm": sql6(f"WITH {G}, h AS (SELECT * FROM g), {PR} SELECT scene, r, c, greatest(pred - ref, 0) AS ndsm FROM pr", "ndsm", PX),
    "control_gain": sql6(f"WITH {G}, {N}, d AS (SELECT max(r) AS h, max(c) AS w FROM g), p AS (SELECT least(greatest(k * 37 - 20, 0), h) AS r, least(greatest(k * 5 - 10, 0), w) AS c, k * 0.25::DOUBLE + 1 AS y FROM n, d), t AS (SELECT count(*) FILTER (z > 0.02::DOUBLE) AS n, sum(z * y) FILTER (z > 0.02::DOUBLE) / sum(z * z) FILTER (z > 0.02::DOUBLE) AS gain FROM p JOIN g USING (r, c)) SELECT 'g' AS scene, n, CASE WHEN n >= 2 AND gain > 0 THEN gain END AS gain FROM t", "gain", "scene n"),
    "class_stability": sql6(f"WITH {ROWS}, {RMSE} SELECT region, arg_max(cls, rmse) AS worst_class, max(rmse) - min(rmse) AS rmse_spread, max(rmse) / greatest(min(rmse), 1e-9::DOUBLE) AS rmse_ratio FROM m GROUP BY region HAVING count(*) >= 2", "rmse_spread rmse_ratio", "region worst_class"),
    "pooled_before_after": sql6(f"WITH {ROWS}, t AS (SELECT scene, count(*)::DOUBLE AS n, sqrt(avg((pred - ref) ** 2)) AS rb, sqrt(avg((pred * 0.8::DOUBLE - ref) ** 2)) AS ra, avg(ref) AS ob, max(ref) FILTER (cls = 'A') AS oa FROM rw GROUP BY scene) SELECT sqrt(sum(n * rb ** 2) / sum(n)) AS rmse_before, sqrt(sum(n * ra ** 2) / sum(n)) AS rmse_after, sqrt(sum(n * ob ** 2) / sum(n)) AS obj_before, sqrt(coalesce(sum(n * oa ** 2), 0) / sum(n)) AS obj_after, count(*) FILTER (ra < rb) AS rmse_better, count(*) FILTER (coalesce(oa, 9e9) < ob) AS obj_better FROM t", "rmse_before rmse_after obj_before obj_after", "rmse_better obj_better"),
    "tile_statistics": sql6(f"WITH {G}, h AS (SELECT scene, r, c, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS z FROM g) SELECT scene, r // 16 AS i, quantile_cont(z, 0.5) AS p50, quantile_cont(z, 0.99) AS p99, max(z) AS h_max, count(z) / count(*) AS valid FROM h GROUP BY ALL", "p50 p99 h_max valid", "scene i"),
    "unit_check": sql6("WITH t AS (SELECT o_custkey AS id, quantile_cont(o_totalprice, 0.99) AS p99, max(o_totalprice) AS h FROM orders GROUP BY ALL ORDER BY id LIMIT 20) SELECT count(*) AS tiles, quantile_cont(p99, 0.5) AS p99_median, max(h) AS h_max, quantile_cont(p99, 0.5) > 300 AS suspicious FROM t", "p99_median h_max", "tiles suspicious"),
    "result_summary": sql6(f"WITH {G}, s AS ({slope_sql('g', 1.0)}), q AS (SELECT quantile_cont(slope, 0.5) AS m, quantile_cont(slope, 0.99) AS p FROM s) SELECT scene, min(z) AS min_m, max(z) AS max_m, max(z) - min(z) AS relief_m, m AS median_slope_deg, p AS p99_slope_deg, (max(r) * max(c) * 2)::BIGINT AS triangles FROM g, q GROUP BY scene, m, p", "min_m max_m relief_m median_slope_deg p99_slope_deg", "scene triangles"),
    "value_runs": "WITH t AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS grp FROM orders), u AS (SELECT k, v, min(i) AS start, count(*) AS n FROM t GROUP BY k, v, grp) SELECT k, row_number() OVER (PARTITION BY k ORDER BY start) AS run, start, v, n FROM u",
    "scene_subset": "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY id LIMIT 25",
    "disc_places": sql6(f"""WITH {N}, t AS (SELECT name AS area, i AS k, k * 20000.0::DOUBLE AS cx, k * 10000.0::DOUBLE AS cy, 4000.0::DOUBLE + k * 100 AS rad, ('0x' || substr(md5('r:' || name || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5('a:' || name || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM n CROSS JOIN (SELECT unnest(range(12)) AS i)),
 p AS (SELECT area, k::INT AS k, floor((cx + rad * sqrt(u) * cos(v * (2 * 3.141592653589793::DOUBLE))) / 50.0 + 0.5) * 50.0 AS x, floor((cy + rad * sqrt(u) * sin(v * (2 * 3.141592653589793::DOUBLE))) / 50.0 + 0.5) * 50.0 AS y FROM t) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k % 2 = 0 AND sqrt((x - (n.k * 20000.0 + 1000)) ** 2 + (y - (n.k * 10000.0 - 500)) ** 2) < 2500)""", "x y", "area k"),
    "random_subset": "SELECT c_custkey AS id FROM customer ORDER BY md5('3:' || c_custkey), id LIMIT 40",
    "job_layers": f"WITH {N} SELECT k, layer, CASE WHEN layer = 'slope' THEN 'deg' WHEN k % 4 = 0 THEN 'm*' ELSE 'm' END AS unit FROM n CROSS JOIN (SELECT unnest(['height', 'slope', 'uncertainty']) AS layer) WHERE layer <> 'uncertainty' OR k % 3 = 0",
    "engine_results": sql6(f"""WITH {N}, r AS (SELECT s_nationkey AS key, CASE WHEN s_nationkey % 7 = 3 OR s_suppkey % 3 = 0 THEN 'bad|' || lpad(s_suppkey::VARCHAR, 6, '0') END AS error, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS rmse FROM supplier WHERE s_nationkey % 5 <> 1), a AS (SELECT key, count(*) AS scenes, count(*) - count(error) AS good, min(error) AS error, avg(rmse) AS rmse FROM r GROUP BY key),
 t AS (SELECT k AS key, name AS label, CASE WHEN k % 6 = 0 THEN 'no trained model' WHEN scenes IS NULL THEN 'benchmark run failed' WHEN good = 0 THEN 'every scene failed - ' || replace(error, '|', '/') END AS skipped, good, rmse FROM n LEFT JOIN a ON a.key = k) SELECT key, label, skipped, CASE WHEN skipped IS NULL THEN good END AS scenes, CASE WHEN skipped IS NULL THEN rmse END AS rmse FROM t""", "rmse", "key label skipped scenes"),
    "grid_mismatch": f"WITH {G}, d AS (SELECT max(r) + 1 AS h FROM g) SELECT 'same' AS scene, h AS a_h, 64 AS a_w, h AS b_h, 64 AS b_w, false AS differ FROM d UNION ALL SELECT 'cut', h, 64, h, 60, true FROM d UNION ALL SELECT 'alone', h, 64, NULL, NULL, true FROM d",
}

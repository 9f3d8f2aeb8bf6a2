"""Queries of catalogue, configuration, sampling and log records, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.tables import load
from orograph.operators import records as rec
from orograph.plans.base import G, six, sql6
from orograph.sources import adapters as a

PATTERNS = ["gold", "steel|ivory", "^a", "e"]


def latest_revision(spark, d):
    t = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rec.latest(t, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def first_n_per_split(spark, d):
    t = load(spark, d, "part").select("p_partkey", "p_brand")
    return rec.first_n(t, ["p_brand"], [F.col("p_partkey")], 5)


def regex_priority_pick(spark, d):
    return rec.priority_pick(load(spark, d, "part"), ["p_brand"], "p_name", PATTERNS)


def tag_coalesce(spark, d):
    t = load(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    azimuth = F.coalesce(F.when(F.col("event_id") % 3 == 0, k.try_cast("double")), F.when(F.col("event_id") % 3 == 1, F.lit(90.0) - k.try_cast("double")))
    return six(t.select("event_id", azimuth.alias("azimuth"), F.when(azimuth.isNull(), "no usable tag").alias("note")))


def json_meta(spark, d):
    t = load(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    return t.select("event_id", F.concat_ws(" | ", F.when(k > 50, F.concat(F.lit("high "), k.cast("string"))), F.upper("event_type"), F.when(k % 2 == 0, F.lit("even"))).alias("summary"), F.sha1(F.concat("event_type", F.lit(":"), "props").cast("binary")).alias("cache_key"))


def cache_eviction(spark, d):
    t = load(spark, d, "events").select(F.col("user_id").alias("cache"), F.col("event_id").alias("id"), F.col("ts").alias("mtime"), (F.col("event_id") % 50 + 1).alias("size"))
    return rec.evict(t, ["cache"], 100).select("cache", "id", "size")


def landcover_shares(spark, d):
    t = a.grid(spark, d).groupBy("label").count()
    total = t.agg(F.sum("count").alias("n"))
    return six(t.crossJoin(F.broadcast(total)).select("label", "count", (F.floor(F.col("count") / F.col("n") * 10000 + 0.5) / 10000).alias("share")))


def upsert_layers(spark, d):
    t = load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return rec.upsert(t, t.filter("id % 4 = 0").select("id", F.concat(F.lit("new "), "name").alias("name")), "id")


def config_merge(spark, d):
    n = load(spark, d, "nation")
    old = n.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("scene"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("height"), F.lit("person").alias("note"))
    new = n.filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("scene"), F.col("n_nationkey").alias("height"), F.lit("fetch").alias("note"))
    return rec.merge_protected(old, new, "scene", ["height"])


def bbox_containment(spark, d):
    k = F.col("c_custkey")
    boxes = load(spark, d, "customer").select(k.alias("id"), (k % 60).alias("left"), (k % 47).alias("bottom"), (k % 60 + 2).alias("right"), (k % 47 + 3).alias("top"))
    s = F.col("s_suppkey")
    areas = load(spark, d, "supplier").select(s.alias("id"), (s % 50).alias("left"), (s % 40).alias("bottom"), (s % 50 + 9).alias("right"), (s % 40 + 11).alias("top"))
    return rec.contained(boxes, areas, 10.0)


def distance_anti_join(spark, d):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    p = load(spark, d, "customer").select(k.alias("id"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 1000).cast("double").alias("y"), (k % 3).alias("kind"))
    o = load(spark, d, "supplier").select(((s * 53) % 1000).cast("double").alias("x"), ((s * 71) % 1000).cast("double").alias("y"), (s % 3).alias("kind"))
    return rec.near_anti(p, o, 60.0).select("id")


def tile_ids_for_bounds(spark, d):
    k = F.col("s_suppkey").cast("double")
    t = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.lit(-18000000.0) + k * 31000).alias("left"), (F.lit(-17500000.0) + k * 31000).alias("right"), (F.lit(8000000.0) - k * 15000).alias("bottom"), (F.lit(8900000.0) - k * 15000).alias("top"))
    return rec.tile_ids(t, -18041000.0, 9000000.0, 1e6, 36, 18)


def sampling_weights(spark, d):
    t = load(spark, d, "part").select(F.element_at(F.split("p_type", " "), 1).alias("source"), F.col("p_brand").alias("landscape"))
    return six(rec.sampling_weights(t, {"STANDARD": 0.4, "SMALL": 0.3, "PROMO": 0.2, "ECONOMY": 0.1}))


def sample_points_stratified(spark, d):
    return six(rec.stratified_points(a.grid(spark, d), 8, 0.95))


def longtail_weights(spark, d):
    return six(rec.longtail_weights(a.grid(spark, d).withColumn("z", F.abs("z") * F.lit(60.0)), 16, 3.0))


def job_log_tail(spark, d):
    t = load(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return rec.first_n(t, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 200).select("user_id", "event_id", "event_type")


def job_status_latest(spark, d):
    t = load(spark, d, "events")
    return t.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col("event_type") == "error").alias("errors"))


def extension_counts(spark, d):
    t = load(spark, d, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return t.groupBy(F.lower(F.substring_index(host, ".", -1)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").startswith("https")).alias("secure"))


QUERIES = [latest_revision, first_n_per_split, regex_priority_pick, tag_coalesce, json_meta, cache_eviction, landcover_shares, upsert_layers, config_merge, bbox_containment, distance_anti_join, tile_ids_for_bounds, sampling_weights, sample_points_stratified, longtail_weights, job_log_tail, job_status_latest, extension_counts]

K = "(props::JSON->>'$.k')"
ORACLE = {
    "latest_revision": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "first_n_per_split": "SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5",
    "regex_priority_pick": "WITH t AS (SELECT p_brand, p_name, CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}', 'i') THEN {i}" for i, p in enumerate(PATTERNS)) + " END AS pattern FROM part) SELECT p_brand, pattern, min(p_name) AS p_name FROM t WHERE pattern IS NOT NULL GROUP BY p_brand, pattern QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY pattern) = 1",
    "tag_coalesce": sql6(f"WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN try_cast({K} AS DOUBLE) WHEN event_id % 3 = 1 THEN 90 - try_cast({K} AS DOUBLE) END AS azimuth FROM events) SELECT event_id, azimuth, CASE WHEN azimuth IS NULL THEN 'no usable tag' END AS note FROM t", "azimuth", "event_id note"),
    "json_meta": f"WITH t AS (SELECT *, {K}::BIGINT AS k FROM events) SELECT event_id, concat_ws(' | ', CASE WHEN k > 50 THEN 'high ' || k END, upper(event_type), CASE WHEN k % 2 = 0 THEN 'even' END) AS summary, sha1(event_type || ':' || props) AS cache_key FROM t",
    "cache_eviction": "WITH t AS (SELECT user_id AS cache, event_id AS id, event_id % 50 + 1 AS size, sum(event_id % 50 + 1) OVER w AS s, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) SELECT cache, id, size FROM t WHERE s <= 100 OR n = 1",
    "landcover_shares": sql6(f"WITH {G}, t AS (SELECT label, count(*) AS count FROM g GROUP BY label) SELECT label, count, floor(count / sum(count) OVER () * 10000 + 0.5) / 10000 AS share FROM t", "share", "label count"),
    "upsert_layers": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'new ' || n_name ELSE n_name END AS name FROM nation",
    "config_merge": "WITH o AS (SELECT n_name AS scene, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS height, 'person' AS note FROM nation WHERE n_nationkey % 3 <> 0), n AS (SELECT n_name AS scene, n_nationkey AS height, 'fetch' AS note FROM nation WHERE n_nationkey % 5 <> 0) SELECT coalesce(o.scene, n.scene) AS scene, coalesce(o.height, n.height) AS height, coalesce(n.note, o.note) AS note FROM o FULL JOIN n ON o.scene = n.scene",
    "bbox_containment": "SELECT c_custkey AS box, s_suppkey AS area FROM customer JOIN supplier ON c_custkey % 60 >= s_suppkey % 50 AND c_custkey % 60 + 2 <= s_suppkey % 50 + 9 AND c_custkey % 47 >= s_suppkey % 40 AND c_custkey % 47 + 3 <= s_suppkey % 40 + 11",
    "distance_anti_join": "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE c_custkey % 3 = s_suppkey % 3 AND ((c_custkey * 37) % 1000 - (s_suppkey * 53) % 1000) ** 2 + ((c_custkey * 91) % 1000 - (s_suppkey * 71) % 1000) ** 2 <= 3600)",
    "tile_ids_for_bounds": "WITH b AS (SELECT s_suppkey AS id, -18000000.0::DOUBLE + s_suppkey * 31000 AS l, -17500000.0::DOUBLE + s_suppkey * 31000 AS r, 8000000.0::DOUBLE - s_suppkey * 15000 AS b, 8900000.0::DOUBLE - s_suppkey * 15000 AS t FROM supplier), q AS (SELECT id, greatest(least(floor((9000000.0::DOUBLE - (t - 1e-6)) / 1e6) + 1, 18), 1)::INT AS r0, greatest(least(floor((9000000.0::DOUBLE - (b + 1e-6)) / 1e6) + 1, 18), 1)::INT AS r1, greatest(least(floor((l + 1e-6 + 18041000.0::DOUBLE) / 1e6) + 1, 36), 1)::INT AS c0, greatest(least(floor((r - 1e-6 + 18041000.0::DOUBLE) / 1e6) + 1, 36), 1)::INT AS c1 FROM b), x AS (SELECT id, unnest(range(r0, r1 + 1)) AS r, c0, c1 FROM q), y AS (SELECT id, r, unnest(range(c0, c1 + 1)) AS c FROM x) SELECT id, 'R' || r || '_C' || c AS tile FROM y",
    "sampling_weights": sql6("WITH n AS (SELECT split_part(p_type, ' ', 1) AS source, p_brand AS landscape, count(*) AS count FROM part GROUP BY ALL), w AS (SELECT *, CASE source WHEN 'STANDARD' THEN 0.4 WHEN 'SMALL' THEN 0.3 WHEN 'PROMO' THEN 0.2 WHEN 'ECONOMY' THEN 0.1 ELSE 0 END::DOUBLE / count(*) OVER (PARTITION BY source) / count AS w FROM n) SELECT source, landscape, count, w / greatest(sum(w * count) OVER (), 1e-12) AS weight FROM w", "weight", "source landscape count"),
    "sample_points_stratified": sql6(f"WITH {G}, d AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM g), t AS (SELECT scene, r, c, z, r * 8 // h AS i, c * 8 // w AS j, ((r::BIGINT * w + c) * 2654435761) % 4294967296 AS k FROM g, d), q AS (SELECT i, j, quantile_cont(z, 0.95) AS q FROM t GROUP BY ALL) SELECT scene, i, j, arg_min(r, k) AS r, arg_min(c, k) AS c, arg_min(z, k) AS z FROM t JOIN q USING (i, j) WHERE z >= q GROUP BY ALL", "z", "scene i j r c"),
    "longtail_weights": sql6(f"WITH {G}, n AS (SELECT least(floor(ln(1 + abs(z) * 60.0::DOUBLE / 2) / 3.0::DOUBLE * 16), 15)::INT AS band, count(*) AS count FROM g GROUP BY 1), f AS (SELECT *, greatest(count / sum(count) OVER (), 1e-4) ** -0.5 AS f, sum(count) OVER () AS total FROM n) SELECT band, count, least(greatest(f / (sum(f * count) OVER () / total), 0.2), 10) AS weight FROM f", "weight", "band count"),
    "job_log_tail": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 200",
    "job_status_latest": "WITH s AS (SELECT user_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), c AS (SELECT user_id, count(*) AS lines, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id) SELECT user_id, status, lines, errors FROM s JOIN c USING (user_id)",
    "extension_counts": "WITH h AS (SELECT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) SELECT lower(split_part(host, '.', -1)) AS suffix, count(*) AS n, count(*) FILTER (starts_with(url, 'https')) AS secure FROM h GROUP BY 1",
}

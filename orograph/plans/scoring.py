"""Queries about accuracy, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.operators import metrics as m
from orograph.plans.base import G, HOLED, PR, ROWS, six, sql6
from orograph.sources.adapters import grid, holed, pred_ref, scored_rows

METRICS = "coverage_pct rmse mae medae bias std nmad le90 ref_range r r2 nash_sutcliffe rmse_pct_of_range"


def surface(spark, d):
    return pred_ref(holed(grid(spark, d)))


def metrics_overall(spark, d):
    return six(m.metrics(surface(spark, d)))


def metrics_by_class(spark, d):
    return six(m.metrics(surface(spark, d), ["label"]))


def metrics_by_height_band(spark, d):
    t = scored_rows(spark, d).withColumn("band", m.height_band(F.col("ref") - F.lit(20.0)))
    return six(m.metrics(t, ["band"]))


def metrics_grouping_sets(spark, d):
    t = scored_rows(spark, d).withColumn("e", F.col("pred") - F.col("ref"))
    t.createOrReplaceTempView("_scored")
    return six(spark.sql("""
        SELECT cls, region, scene, grouping_id(cls, region, scene) AS level, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(e) AS bias
        FROM _scored GROUP BY GROUPING SETS ((), (cls), (region), (region, scene))"""))


def alignment_raw_shift(spark, d):
    return six(m.alignments(surface(spark, d), ["label"]).drop("headline"))


def headline_choice(spark, d):
    return m.alignments(surface(spark, d), ["label"]).select("label", "headline")


def attenuation_gain(spark, d):
    return six(m.attenuation(scored_rows(spark, d), ["cls"]))


def _scene_scores(spark, d):
    t = m.finite_pairs(scored_rows(spark, d)).withColumn("e", F.col("pred") - F.col("ref"))
    return t.groupBy("region", "scene").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"))


def pool_scenes(spark, d):
    return six(m.pooled(_scene_scores(spark, d), ["region"], ["mae", "bias"]))


def class_spread(spark, d):
    return six(m.class_spread(_scene_scores(spark, d), ["region"], "scene"))


def loso_gain(spark, d):
    return six(m.loso_gain(scored_rows(spark, d), "region", "scene"))


def gain_vote(spark, d):
    return six(m.gain_vote(m.attenuation(scored_rows(spark, d), ["scene"], materiality=0.05)))


def class_iou(spark, d):
    t = surface(spark, d).select(m.height_band(F.col("pred") * F.lit(60.0)).alias("p"), m.height_band(F.col("ref") * F.lit(60.0)).alias("q"))
    return six(m.class_scores(t.filter("p is not null and q is not null"), "p", "q"))


QUERIES = [metrics_overall, metrics_by_class, metrics_by_height_band, metrics_grouping_sets, alignment_raw_shift, headline_choice, attenuation_gain, pool_scenes, class_spread, loso_gain, gain_vote, class_iou]


def _metrics_sql(source: str, rel: str, by: str) -> str:
    key = f"{by}, " if by else ""
    on = f"t.{by} IS NOT DISTINCT FROM s.{by}" if by else "true"
    group = f"GROUP BY t.{by}" if by else ""
    return sql6(f"""
WITH {source}, t AS (SELECT *, pred - ref AS e FROM {rel}),
s AS (SELECT {key}quantile_cont(e, 0.5) AS mid FROM t {'GROUP BY ' + by if by else ''}),
a AS (SELECT {'t.' + by + ' AS ' + by + ', ' if by else ''}count(e) AS n, 100.0 * count(e) / count(*) AS coverage_pct, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, quantile_cont(abs(e), 0.5) AS medae, avg(e) AS bias,
  stddev_pop(e) AS std, 1.4826::DOUBLE * quantile_cont(abs(e - mid), 0.5) AS nmad, quantile_cont(abs(e), 0.9) AS le90, quantile_cont(ref, 0.99) FILTER (e IS NOT NULL) - quantile_cont(ref, 0.01) FILTER (e IS NOT NULL) AS ref_range,
  CASE WHEN stddev_pop(pred) FILTER (e IS NOT NULL) > 1e-9 AND stddev_pop(ref) FILTER (e IS NOT NULL) > 1e-9 THEN corr(pred, ref) END AS r,
  CASE WHEN stddev_pop(ref) FILTER (e IS NOT NULL) > 1e-9 THEN 1 - sum(e * e) / greatest(count(e) * var_pop(ref) FILTER (e IS NOT NULL), 1e-12) END AS nash_sutcliffe
  FROM t JOIN s ON {on} {group}),
b AS (SELECT *, r * r AS r2, 100.0 * rmse / greatest(ref_range, 1e-9) AS rmse_pct_of_range FROM a)
SELECT {key}n, coverage_pct, {', '.join(f'CASE WHEN n >= 10 THEN {x} END AS {x}' for x in METRICS.split()[1:])}, CASE WHEN n < 10 THEN 'too few valid pixels' END AS note FROM b""", METRICS, f"{by} n note")


BAND = "CASE WHEN {0} < -1e9 THEN NULL WHEN {0} < 2 THEN 0 WHEN {0} < 10 THEN 1 WHEN {0} < 30 THEN 2 WHEN {0} < 1e9 THEN 3 END::INT"
SURFACE = f"{G}, {HOLED}, {PR}"
SCENES = f"{ROWS}, sc AS (SELECT region, scene, count(*) AS n, sqrt(avg((pred - ref) * (pred - ref))) AS rmse, avg(abs(pred - ref)) AS mae, avg(pred - ref) AS bias FROM rw GROUP BY ALL)"
_ATT = """a AS (SELECT {by}, count(*) AS n, sum(pred * ref) AS spr, sum(pred * pred) AS spp, sum(ref * ref) AS srr, count(*) FILTER (pred > 2 AND ref > 2) AS nt,
  quantile_cont(pred, 0.99) FILTER (pred > 2 AND ref > 2) AS pp, quantile_cont(ref, 0.99) FILTER (pred > 2 AND ref > 2) AS pq FROM rw GROUP BY {by}),
b AS (SELECT *, spr / greatest(spp, 1e-9) AS gain FROM a),
e AS (SELECT *, sqrt(greatest((spp - 2 * spr + srr) / n, 0)) AS rmse_as_is, sqrt(greatest((gain * gain * spp - 2 * gain * spr + srr) / n, 0)) AS rmse_at_gain FROM b)"""

ORACLE = {
    "metrics_overall": _metrics_sql(SURFACE, "pr", ""),
    "metrics_by_class": _metrics_sql(SURFACE, "pr", "label"),
    "metrics_by_height_band": _metrics_sql(f"{ROWS}, rb AS (SELECT *, {BAND.format('(ref - 20.0::DOUBLE)')} AS band FROM rw)", "rb", "band"),
    "metrics_grouping_sets": sql6(f"WITH {ROWS} SELECT cls, region, scene, grouping_id(cls, region, scene) AS level, count(*) AS n, sqrt(avg((pred - ref) * (pred - ref))) AS rmse, avg(abs(pred - ref)) AS mae, avg(pred - ref) AS bias FROM rw GROUP BY GROUPING SETS ((), (cls), (region), (region, scene))", "rmse mae bias", "cls region scene level n"),
    "alignment_raw_shift": sql6(f"WITH {SURFACE}, o AS (SELECT label, quantile_cont(ref - pred, 0.5) AS o FROM pr GROUP BY label) SELECT pr.label, sqrt(avg((pred - ref) ** 2)) AS rmse_raw, max(o) AS \"offset\", sqrt(avg((pred + o - ref) ** 2)) AS rmse_shift FROM pr JOIN o USING (label) GROUP BY pr.label", 'rmse_raw "offset" rmse_shift', "label"),
    "headline_choice": f"WITH {SURFACE}, o AS (SELECT label, quantile_cont(ref - pred, 0.5) AS o FROM pr GROUP BY label) SELECT pr.label, CASE WHEN sqrt(avg((pred + o - ref) ** 2)) <= sqrt(avg((pred - ref) ** 2)) THEN 'shift' ELSE 'raw' END AS headline FROM pr JOIN o USING (label) GROUP BY pr.label",
    "attenuation_gain": sql6(f"WITH {ROWS}, {_ATT.format(by='cls')} SELECT cls, n, CASE WHEN n >= 50 THEN gain END AS gain, CASE WHEN n >= 50 THEN rmse_as_is END AS rmse_as_is, CASE WHEN n >= 50 THEN rmse_at_gain END AS rmse_at_gain, CASE WHEN n >= 50 THEN rmse_at_gain < rmse_as_is * 0.99 END AS improves, CASE WHEN n >= 50 AND nt >= 50 THEN pq / greatest(pp, 1e-9) END AS tall_ratio FROM e", "gain rmse_as_is rmse_at_gain tall_ratio", "cls n improves"),
    "pool_scenes": sql6(f"WITH {SCENES} SELECT region, sum(n)::BIGINT AS n, count(*) AS scenes, sqrt(sum(n * rmse * rmse) / sum(n)) AS rmse, sum(n * mae) / sum(n) AS mae, sum(n * bias) / sum(n) AS bias FROM sc GROUP BY region", "rmse mae bias", "region n scenes"),
    "class_spread": sql6(f"WITH {SCENES} SELECT region, count(*) AS classes, arg_min(scene, rmse) AS best, min(rmse) AS best_rmse, arg_max(scene, rmse) AS worst, max(rmse) AS worst_rmse, max(rmse) - min(rmse) AS spread, max(rmse) / greatest(min(rmse), 1e-9) AS ratio FROM sc GROUP BY region", "best_rmse worst_rmse spread ratio", "region classes best worst"),
    "loso_gain": sql6(f"WITH {ROWS}, s AS (SELECT region, scene, sum(pred * ref) AS sxy, sum(pred * pred) AS sxx FROM rw GROUP BY ALL) SELECT a.region, a.scene, CASE WHEN count(*) >= 2 THEN sum(b.sxy) / greatest(sum(b.sxx), 1e-9) END AS gain FROM s a LEFT JOIN s b ON a.region = b.region AND a.scene <> b.scene GROUP BY ALL", "gain", "region scene"),
    "gain_vote": sql6(f"WITH {ROWS}, {_ATT.format(by='scene')} SELECT count(*) AS scenes, count(*) FILTER (n >= 50 AND rmse_at_gain < rmse_as_is * 0.95) AS improving, quantile_cont(gain, 0.5) FILTER (n >= 50 AND rmse_at_gain < rmse_as_is * 0.95) AS gain, count(*) FILTER (n >= 50 AND rmse_at_gain < rmse_as_is * 0.95) >= greatest(1, floor(count(*) / 2)) AS recommended FROM e", "gain", "scenes improving recommended"),
    "class_iou": sql6(f"WITH {SURFACE}, k AS (SELECT {BAND.format('(pred * 60.0::DOUBLE)')} AS p, {BAND.format('(ref * 60.0::DOUBLE)')} AS q FROM pr WHERE pred IS NOT NULL), x AS (SELECT p AS cls, p, q FROM k UNION ALL SELECT q, p, q FROM k WHERE p <> q) SELECT cls, count(*) FILTER (p = q) AS intersection, count(*) AS \"union\", count(*) FILTER (p = q) / count(*) AS iou FROM x GROUP BY cls", "iou", "cls intersection \"union\""),
}

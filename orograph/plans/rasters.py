"""Queries of local and focal map algebra, and their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from orograph.operators import focal, landscape, local
from orograph.plans.base import G, HOLED, RGB, six, sql6
from orograph.sources import adapters as a

AT = ["scene", "r", "c"]
#: A ramp of hex colours, low to high.
RAMP = ["#0b3c5d", "#328cc1", "#a3d5d3", "#f2efe8", "#d9b310", "#b85c38", "#5c1a1b"]
SIGMA = 2.0


def _rgb(spark, d):
    return a.rgb(a.grid(spark, d))


def _bands():
    return F.col("red"), F.col("green"), F.col("blue")


def luma_saturation(spark, d):
    t = _rgb(spark, d)
    return six(t.select(*AT, local.luma709(*_bands()).alias("luma"), local.saturation(*_bands()).alias("sat"), local.luma601(*_bands()).alias("luma601")))


def excess_green(spark, d):
    return six(_rgb(spark, d).select(*AT, local.excess_green(*_bands()).alias("veg")))


def cloud_shadow_mask(spark, d):
    return local.cloud_shadow_mask(_rgb(spark, d), reach=1.0, max_sat=0.4).select(*AT, "valid")


def needs_stretch(spark, d):
    return six(local.needs_stretch(_rgb(spark, d), "red"))


def percentile_stretch(spark, d):
    return local.stretch_per_band(local.cloud_shadow_mask(_rgb(spark, d), reach=1.0, max_sat=0.4)).select(*AT, "red", "green", "blue")


def otsu_threshold(spark, d):
    return local.otsu(_rgb(spark, d), "red")


def quantise16(spark, d):
    return local.quantise16(a.grid(spark, d)).select(*AT, "q")


def colorize_layer(spark, d):
    t = a.holed(a.grid(spark, d))
    return t.select(*AT, local.colour(F.col("z"), F.lit(-0.3), F.lit(0.3), RAMP).alias("k")).select(*AT, "k.red", "k.green", "k.blue")


def layer_ranges(spark, d):
    return six(local.layer_ranges(focal.slope_deg(a.grid(spark, d), 1.0)))


def surface_algebra(spark, d):
    t = a.grid(spark, d).select(*AT, (F.col("r") * F.lit(0.05) + F.col("c") * F.lit(0.02)).alias("terrain"), F.col("z").alias("detail"))
    return six(local.surfaces(t, 30.0).select(*AT, "height", "ndsm", "dtm"))


def clip_below_ground(spark, d):
    return six(local.clip_below_ground(a.grid(spark, d)).select(*AT, "z", "below"))


def ndsm_from_dsm_dtm(spark, d):
    t = a.grid(spark, d).withColumn("k", F.col("r") * 64 + F.col("c"))
    dsm, dtm = F.when(F.col("k") % 13 != 0, F.col("z") * F.lit(20.0)), F.when((F.col("k") % 13 != 0) & (F.col("k") % 7 != 0), F.lit(1.0))
    return six(t.select(*AT, local.ndsm_from(dsm, dtm).alias("h")))


def nodata_clean(spark, d):
    t = a.grid(spark, d)
    raw = F.when((F.col("r") + F.col("c")) % 11 == 0, F.lit(-9999.0004)).when((F.col("r") + F.col("c")) % 11 == 1, F.lit(-32768.0)).otherwise(F.col("z"))
    return six(t.select(*AT, a.clean(raw).alias("z")))


def median_fill(spark, d):
    return six(local.fill_median(a.holed(a.grid(spark, d))).select(*AT, "z"))


def log_height(spark, d):
    return six(a.grid(spark, d).select(*AT, local.log_height(F.col("z") * F.lit(30.0)).alias("u"), local.snap(F.col("z") * F.lit(30.0), 0.25).alias("snapped")))


def slope_deg(spark, d):
    return six(focal.slope_deg(a.grid(spark, d), 0.5).select(*AT, "slope"))


def steepest_stretch(spark, d):
    t = a.grid(spark, d)
    up = F.degrees(F.atan(F.abs(F.lead("z", 4).over(focal.rows_of()) - F.col("z")) / F.lit(4 * 0.5)))
    return six(t.withColumn("s", up).groupBy("scene", "r").agg(F.max("s").alias("max_slope")))


def top1pct_crispness(spark, d):
    return six(focal.crispness(focal.slope_deg(a.grid(spark, d), 1.0)))


def morph_opening(spark, d):
    t = focal.opening(a.grid(spark, d), 5)
    return six(focal.opening(t, 4, out="opened_even").select(*AT, "opened", "opened_even"))


def debias_dem(spark, d):
    t = a.grid(spark, d).withColumn("z", F.col("z") * F.lit(30.0))
    return six(focal.debias(t, 7).select(*AT, "ground", "correction", "debiased"))


def binary_open_close(spark, d):
    t = a.grid(spark, d).withColumn("m", (F.col("z") > F.lit(-0.05)).cast("int"))
    return focal.binary_open_close(t, "m").select(*AT, "opened", "closed")


def gaussian_lowpass(spark, d):
    return six(focal.gaussian(a.grid(spark, d), SIGMA))


def box_mean(spark, d):
    return six(focal.box_mean(a.grid(spark, d), 3))


def local_roughness(spark, d):
    return six(focal.roughness(a.grid(spark, d), 2))


def median3x3(spark, d):
    return six(focal.median3(a.grid(spark, d)))


def percentile_filter(spark, d):
    return six(focal.percentile_filter(a.grid(spark, d), 5, 20))


def object_band(spark, d):
    return six(focal.object_band(a.holed(a.grid(spark, d)), SIGMA).select(*AT, "object"))


def unsharp_object(spark, d):
    return six(focal.sharpen(a.grid(spark, d), SIGMA).select(*AT, "sharp"))


def guided_filter(spark, d):
    t = a.grid(spark, d)
    t = t.join(a.rgb(t), AT).withColumn("luma", local.luma601(*_bands()) / F.lit(255.0))
    return six(focal.guided(t, "z", "luma", 2, 1e-3).select(*AT, "guided"))


def landscape_classes(spark, d):
    t = a.grid(spark, d)
    return landscape.landscape_classes(t.join(a.rgb(t), AT), 0.05, 2).groupBy("landscape").count()


QUERIES = [luma_saturation, excess_green, cloud_shadow_mask, needs_stretch, percentile_stretch, otsu_threshold, quantise16, colorize_layer, layer_ranges, surface_algebra, clip_below_ground, ndsm_from_dsm_dtm, nodata_clean, median_fill, log_height,
           slope_deg, steepest_stretch, top1pct_crispness, morph_opening, debias_dem, binary_open_close, gaussian_lowpass, box_mean, local_roughness, median3x3, percentile_filter, object_band, unsharp_object, guided_filter, landscape_classes]

WIDTH, HEIGHT = "64", "(SELECT max(r) + 1 FROM g)"


def mirrored(i: str, n: str) -> str:
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END)"


def clamped(i: str, n: str) -> str:
    return f"least(greatest({i}, 0), {n} - 1)"


def gauss_table(name: str, sigma: float) -> str:
    k = int(4 * sigma + 0.5)
    return f"{name} AS (SELECT d, exp(-0.5::DOUBLE * (d / {sigma}::DOUBLE) ** 2) / sum(exp(-0.5::DOUBLE * (d / {sigma}::DOUBLE) ** 2)) OVER () AS w FROM (SELECT unnest(range({-k}, {k + 1})) AS d))"


def box_table(name: str, radius: int) -> str:
    return f"{name} AS (SELECT d, 1.0::DOUBLE / {2 * radius + 1} AS w FROM (SELECT unnest(range({-radius}, {radius + 1})) AS d))"


def conv(out: str, src: str, value: str, table: str, index, width: str = WIDTH, height: str = HEIGHT) -> str:
    return f"""{out}_x AS (SELECT a.r, a.c, sum(k.w * b.v) AS v FROM (SELECT r, c FROM {src}) a CROSS JOIN {table} k JOIN (SELECT r, c, {value} AS v FROM {src}) b ON b.r = a.r AND b.c = {index('a.c + k.d', width)} GROUP BY ALL),
{out} AS (SELECT a.r, a.c, sum(k.w * b.v) AS v FROM (SELECT r, c FROM {out}_x) a CROSS JOIN {table} k JOIN {out}_x b ON b.c = a.c AND b.r = {index('a.r + k.d', height)} GROUP BY ALL)"""


def extreme(out: str, src: str, value: str, f: str, a: int, b: int) -> str:
    return f"""{out}_x AS (SELECT r, c, {f}({value}) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS v FROM {src}),
{out} AS (SELECT r, c, {f}(v) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) AS v FROM {out}_x)"""


def rank_of(src: str, value: str, k: int, index: int, width: str = WIDTH, height: str = HEIGHT) -> str:
    h = k // 2
    return f"""SELECT a.scene, a.r, a.c, list_sort(list(b.v))[{index + 1}] AS v FROM {src} a CROSS JOIN (SELECT unnest(range({-h}, {k - h})) AS dr) x CROSS JOIN (SELECT unnest(range({-h}, {k - h})) AS dc) y
JOIN (SELECT r, c, {value} AS v FROM {src}) b ON b.r = {clamped('a.r + dr', height)} AND b.c = {clamped('a.c + dc', width)} GROUP BY ALL"""


LUMA = "(0.2126::DOUBLE * red + 0.7152::DOUBLE * green + 0.0722::DOUBLE * blue)"
LUMA601 = "(0.299::DOUBLE * red + 0.587::DOUBLE * green + 0.114::DOUBLE * blue)"
SAT = "((greatest(red, green, blue) - least(red, green, blue)) / greatest(greatest(red, green, blue)::DOUBLE, 1e-9))"
VEG = "((2.0::DOUBLE * green - red - blue) / (red + green + blue + 1e-6::DOUBLE))"
MASK = f"""m0 AS (SELECT *, {LUMA} AS luma, {SAT} AS sat FROM rgb), m1 AS (SELECT quantile_cont(luma, 0.25) AS a, quantile_cont(luma, 0.5) AS b, quantile_cont(luma, 0.75) AS c_ FROM m0),
m2 AS (SELECT m0.*, ((luma > b + 1.0::DOUBLE * (c_ - a) AND sat < 0.4) OR luma < b - 1.0::DOUBLE * (c_ - a)) AND c_ - a >= 1e-9 AS bad FROM m0, m1), mk AS (SELECT *, NOT bad OR avg(bad::INT) OVER () > 0.35 AS valid FROM m2)"""


def slope(src: str, size: float, value: str = "z") -> str:
    def g(p, o):
        w = f"OVER (PARTITION BY {p} ORDER BY {o})"
        return f"CASE WHEN lag(r) {w} IS NULL THEN lead({value}) {w} - {value} WHEN lead(r) {w} IS NULL THEN {value} - lag({value}) {w} ELSE (lead({value}) {w} - lag({value}) {w}) / 2.0 END / {size}::DOUBLE"

    return f"SELECT *, degrees(atan(sqrt(({g('r', 'c')}) ** 2 + ({g('c', 'r')}) ** 2))) AS slope FROM {src}"


def _ramp(i: int) -> str:
    stops = "[" + ", ".join(f"{int(s[1 + 2 * i : 3 + 2 * i], 16)}.0::DOUBLE" for s in RAMP) + "]"
    return f"CASE WHEN z IS NULL THEN {int('9a9aa3'[2 * i : 2 * i + 2], 16)} ELSE floor(least(greatest({stops}[i + 1] + ({stops}[i + 2] - {stops}[i + 1]) * (t - i), 0), 255))::INT END"


def _stretch(b: str) -> str:
    return f"floor(least(greatest(({b} - q.{b}0) / greatest(q.{b}1 - q.{b}0, 1e-9), 0), 1) * 255)::INT AS {b}"


PX = "scene r c"
ROUGH = f"{box_table('k', 2)}, {conv('ra', 'g', 'z', 'k', mirrored)}, {conv('rb', 'g', 'z * z', 'k', mirrored)}, rough AS (SELECT ra.r, ra.c, sqrt(greatest(rb.v - ra.v * ra.v, 0)) AS rough FROM ra JOIN rb USING (r, c))"
ORACLE = {
    "luma_saturation": sql6(f"WITH {G}, {RGB} SELECT scene, r, c, {LUMA} AS luma, {SAT} AS sat, {LUMA601} AS luma601 FROM rgb", "luma sat luma601", PX),
    "excess_green": sql6(f"WITH {G}, {RGB} SELECT scene, r, c, {VEG} AS veg FROM rgb", "veg", PX),
    "cloud_shadow_mask": f"WITH {G}, {RGB}, {MASK} SELECT scene, r, c, valid FROM mk",
    "needs_stretch": sql6(f"WITH {G}, {RGB}, q AS (SELECT scene, quantile_cont(red, 0.98) - quantile_cont(red, 0.02) AS span FROM rgb GROUP BY scene) SELECT scene, span, CASE WHEN span < 1 THEN false ELSE span < 90 END AS needed FROM q", "span", "scene needed"),
    "percentile_stretch": f"WITH {G}, {RGB}, {MASK}, q AS (SELECT {', '.join(f'quantile_cont({b}::DOUBLE, {p}) FILTER (valid) AS {b}{i}' for b in ('red', 'green', 'blue') for i, p in enumerate((0.02, 0.98)))} FROM mk) SELECT scene, r, c, {', '.join(map(_stretch, ('red', 'green', 'blue')))} FROM mk, q",
    "otsu_threshold": f"WITH {G}, {RGB}, h AS (SELECT scene, red AS bin, count(*)::DOUBLE AS n FROM rgb GROUP BY ALL), t AS (SELECT scene, bin, sum(n) OVER o AS w0, sum(n * bin) OVER o AS s0, sum(n) OVER () AS w, sum(n * bin) OVER () AS s FROM h WINDOW o AS (ORDER BY bin)), b AS (SELECT scene, bin, floor(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) / w) AS between_ FROM t WHERE w > w0) SELECT scene, bin AS threshold FROM b ORDER BY between_ DESC, bin LIMIT 1",
    "quantise16": f"WITH {G} SELECT scene, r, c, floor((z - min(z) OVER ()) / greatest(max(z) OVER () - min(z) OVER (), 1e-9) * 65535.0::DOUBLE)::INT AS q FROM g",
    "colorize_layer": f"WITH {G}, {HOLED}, t AS (SELECT *, least(greatest((z - -0.3::DOUBLE) / greatest(0.3::DOUBLE - -0.3::DOUBLE, 1e-9), 0), 1) * {len(RAMP) - 1} AS t FROM h), i AS (SELECT *, least(floor(t), {len(RAMP) - 2})::INT AS i FROM t) SELECT scene, r, c, {_ramp(0)} AS red, {_ramp(1)} AS green, {_ramp(2)} AS blue FROM i",
    "layer_ranges": sql6(f"WITH {G}, s AS ({slope('g', 1.0)}) SELECT scene, quantile_cont(z, 0.01) AS height_min, quantile_cont(z, 0.99) AS height_max, 0.0 AS slope_min, least(greatest(quantile_cont(slope, 0.99), 10), 60) AS slope_max FROM s GROUP BY scene", "height_min height_max slope_min slope_max", "scene"),
    "surface_algebra": sql6(f"WITH {G}, t AS (SELECT scene, r, c, r * 0.05::DOUBLE + c * 0.02::DOUBLE AS terrain, z FROM g), h AS (SELECT *, terrain + 30.0::DOUBLE * z AS height FROM t) SELECT scene, r, c, height, greatest(height - terrain, 0) AS ndsm, height - greatest(height - terrain, 0) AS dtm FROM h", "height ndsm dtm", PX),
    "clip_below_ground": sql6(f"WITH {G} SELECT scene, r, c, greatest(z, 0) AS z, avg((z < 0)::INT) OVER () AS below FROM g", "z below", PX),
    "ndsm_from_dsm_dtm": sql6(f"WITH {G}, t AS (SELECT scene, r, c, CASE WHEN (r * 64 + c) % 13 <> 0 THEN z * 20.0::DOUBLE END AS dsm, CASE WHEN (r * 64 + c) % 13 <> 0 AND (r * 64 + c) % 7 <> 0 THEN 1.0::DOUBLE END AS dtm FROM g) SELECT scene, r, c, CASE WHEN dsm IS NULL AND dtm IS NULL THEN 0 WHEN dsm - dtm < -1.5 THEN NULL WHEN dsm - dtm IS NULL THEN 0 ELSE least(greatest(dsm - dtm, 0), 400) END AS h FROM t", "h", PX),
    "nodata_clean": sql6(f"WITH {G} SELECT scene, r, c, CASE WHEN (r + c) % 11 < 2 THEN NULL ELSE z END AS z FROM g", "z", PX),
    "median_fill": sql6(f"WITH {G}, {HOLED} SELECT scene, r, c, coalesce(z, (SELECT quantile_cont(z, 0.5) FROM h)) AS z FROM h", "z", PX),
    "log_height": sql6(f"WITH {G} SELECT scene, r, c, ln(1 + greatest(z * 30.0::DOUBLE, 0) / 2) AS u, round_even(z * 30.0::DOUBLE / 0.25, 0) * 0.25 AS snapped FROM g", "u snapped", PX),
    "slope_deg": sql6(f"WITH {G} SELECT scene, r, c, slope FROM ({slope('g', 0.5)})", "slope", PX),
    "steepest_stretch": sql6(f"WITH {G}, s AS (SELECT scene, r, degrees(atan(abs(lead(z, 4) OVER (PARTITION BY r ORDER BY c) - z) / 2.0::DOUBLE)) AS s FROM g) SELECT scene, r, max(s) AS max_slope FROM s GROUP BY ALL", "max_slope", "scene r"),
    "top1pct_crispness": sql6(f"WITH {G}, s AS ({slope('g', 1.0)}), t AS (SELECT scene, tan(radians(slope)) AS g FROM s), n AS (SELECT *, row_number() OVER (ORDER BY g DESC) AS i, count(*) OVER () AS n FROM t) SELECT scene, sum(g) FILTER (i <= greatest(1, floor(n * 0.01::DOUBLE))) / greatest(sum(g), 1e-12) AS crispness FROM n GROUP BY scene", "crispness", "scene"),
    "morph_opening": sql6(f"WITH {G}, {extreme('e', 'g', 'z', 'min', 2, 2)}, {extreme('o', 'e', 'v', 'max', 2, 2)}, {extreme('e4', 'g', 'z', 'min', 2, 1)}, {extreme('o4', 'e4', 'v', 'max', 1, 2)} SELECT 'g' AS scene, r, c, o.v AS opened, o4.v AS opened_even FROM o JOIN o4 USING (r, c)", "opened opened_even", PX),
    "debias_dem": sql6(f"WITH {G}, b AS (SELECT r, c, z * 30.0::DOUBLE AS z FROM g), {extreme('e', 'b', 'z', 'min', 3, 3)}, {extreme('o', 'e', 'v', 'max', 3, 3)}, {gauss_table('k', max(1.0, 7 / 6))}, {conv('l', 'o', 'v', 'k', mirrored)} SELECT 'g' AS scene, r, c, l.v AS ground, least(greatest(z - l.v - 0.75, 0), 5) AS correction, z - least(greatest(z - l.v - 0.75, 0), 5) AS debiased FROM b JOIN l USING (r, c)", "ground correction debiased", PX),
    "gaussian_lowpass": sql6(f"WITH {G}, {gauss_table('k', SIGMA)}, {conv('l', 'g', 'z', 'k', mirrored)} SELECT 'g' AS scene, r, c, v AS low FROM l", "low", PX),
    "box_mean": sql6(f"WITH {G}, {box_table('k', 3)}, {conv('l', 'g', 'z', 'k', clamped)} SELECT 'g' AS scene, r, c, v AS mean FROM l", "mean", PX),
    "local_roughness": sql6(f"WITH {G}, {ROUGH} SELECT 'g' AS scene, r, c, rough FROM rough", "rough", PX),
    "median3x3": sql6(f"WITH {G} SELECT scene, r, c, v AS median FROM ({rank_of('g', 'z', 3, 4)})", "median", PX),
    "percentile_filter": sql6(f"WITH {G} SELECT scene, r, c, v AS rank FROM ({rank_of('g', 'z', 5, 5)})", "rank", PX),
    "object_band": sql6(f"WITH {G}, {HOLED}, f AS (SELECT r, c, z, coalesce(z, (SELECT quantile_cont(z, 0.5) FROM h)) AS f FROM h), {gauss_table('k', SIGMA)}, {conv('l', 'f', 'f', 'k', mirrored)} SELECT 'g' AS scene, r, c, CASE WHEN z IS NOT NULL THEN z - v END AS object FROM f JOIN l USING (r, c)", "object", PX),
    "unsharp_object": sql6(f"WITH {G}, {gauss_table('k', SIGMA)}, {gauss_table('k1', 1.0)}, {conv('l', 'g', 'z', 'k', mirrored)}, o AS (SELECT r, c, z, z - v AS o FROM g JOIN l USING (r, c)), {conv('s', 'o', 'o', 'k1', mirrored)} SELECT 'g' AS scene, r, c, z + 0.5::DOUBLE * (o - v) AS sharp FROM o JOIN s USING (r, c)", "sharp", PX),
    "guided_filter": sql6(f"""WITH {G}, {RGB}, gg AS (SELECT g.r, g.c, g.z AS s, {LUMA601} / 255.0::DOUBLE AS y FROM g JOIN rgb USING (scene, r, c)), {box_table('k', 2)},
 {conv('mg', 'gg', 'y', 'k', clamped)}, {conv('ms', 'gg', 's', 'k', clamped)}, {conv('gs', 'gg', 'y * s', 'k', clamped)}, {conv('g2', 'gg', 'y * y', 'k', clamped)},
 ab AS (SELECT r, c, (gs.v - mg.v * ms.v) / (g2.v - mg.v * mg.v + 1e-3::DOUBLE) AS a, ms.v - (gs.v - mg.v * ms.v) / (g2.v - mg.v * mg.v + 1e-3::DOUBLE) * mg.v AS b FROM mg JOIN ms USING (r, c) JOIN gs USING (r, c) JOIN g2 USING (r, c)),
 {conv('ma', 'ab', 'a', 'k', clamped)}, {conv('mb', 'ab', 'b', 'k', clamped)} SELECT 'g' AS scene, r, c, ma.v * y + mb.v AS guided FROM gg JOIN ma USING (r, c) JOIN mb USING (r, c)""", "guided", PX),
    "landscape_classes": f"WITH {G}, {RGB}, {ROUGH}, s AS ({slope('g', 0.05)}), t AS (SELECT s.slope, rough.rough, {VEG} AS veg FROM s JOIN rough USING (r, c) JOIN rgb USING (scene, r, c)), q AS (SELECT quantile_cont(slope, 0.75) AS s75, quantile_cont(rough, 0.6) AS r60, quantile_cont(veg, 0.7) AS v70 FROM t) SELECT CASE WHEN rough > r60 AND veg > v70 THEN 'forest' WHEN rough > r60 THEN 'urban' WHEN slope > greatest(s75, 5) THEN 'hilly' ELSE 'sparse' END AS landscape, count(*) AS count FROM t, q GROUP BY ALL",
}


def _binary(out: str, src: str, value: str, grow: bool) -> str:
    f = "max" if grow else "min"

    def v(col, p, o):
        w = f"PARTITION BY {p} ORDER BY {o}"
        x = f"{f}({col}) OVER ({w} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
        return x if grow else f"CASE WHEN lag(r) OVER ({w}) IS NULL OR lead(r) OVER ({w}) IS NULL THEN 0 ELSE {x} END"

    return f"{out}_x AS (SELECT r, c, {v(value, 'r', 'c')} AS v FROM {src}), {out} AS (SELECT r, c, {v('v', 'c', 'r')} AS v FROM {out}_x)"


ORACLE["binary_open_close"] = f"WITH {G}, b AS (SELECT r, c, (z > -0.05::DOUBLE)::INT AS m FROM g), {_binary('e', 'b', 'm', False)}, {_binary('o', 'e', 'v', True)}, {_binary('d', 'o', 'v', True)}, {_binary('cl', 'd', 'v', False)} SELECT 'g' AS scene, r, c, o.v AS opened, cl.v AS closed FROM o JOIN cl USING (r, c)"

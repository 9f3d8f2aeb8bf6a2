"""Shared pieces of the query catalogue and of the SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def six(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, the same way on both engines (-0.0 becomes 0.0, NaN stays)."""
    cut = lambda c: F.floor(F.col(c) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6) + F.lit(0.0)
    cols = [F.when(F.isnan(c), F.col(c)).otherwise(cut(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    return df.select(*cols)


def sql6(select: str, doubles: str, keep: str = "") -> str:
    """SQL around ``select`` that rounds the named doubles as ``six`` does."""
    parts = [k for k in keep.split() if k] + [f"floor({d}::DOUBLE * 1e6 + 0.5) / 1e6 + 0.0 AS {d}" for d in doubles.split()]
    return f"WITH _all AS ({select}) SELECT {', '.join(parts)} FROM _all"


G = "g AS (SELECT 'g' AS scene, vec_id::INT AS r, (unnest(range(len(embedding))))::INT AS c, unnest(embedding)::DOUBLE AS z, label FROM embeddings)"
HOLED = "h AS (SELECT scene, r, c, label, CASE WHEN (r * 64 + c) % 97 <> 0 THEN z END AS z FROM g)"
PR = "pr AS (SELECT scene, r, c, label, 0.7::DOUBLE * z + 0.1::DOUBLE + 0.02::DOUBLE * (((r * 31 + c * 17) % 7) - 3)::DOUBLE / 3.0::DOUBLE AS pred, z AS ref FROM h)"
RGB = """lv AS (SELECT scene, r, c, least(greatest(floor(127.5::DOUBLE + 240.0::DOUBLE * z), 0), 255)::INT AS v FROM g),
rgb AS (SELECT a.scene, a.r, a.c, a.v AS red, b.v AS green, d.v AS blue FROM lv a JOIN lv b ON a.r = b.r AND b.c = (a.c + 1) % 64 JOIN lv d ON a.r = d.r AND d.c = (a.c + 2) % 64)"""
ROWS = """rw AS (SELECT l_extendedprice / 1000.0::DOUBLE AS pred, l_quantity * p_retailprice / 500.0::DOUBLE AS ref, l_returnflag AS cls, r_name AS region, n_name AS scene
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SCENES = """sc AS (SELECT CASE WHEN vec_id % 7 < 4 THEN 'a' WHEN vec_id % 7 < 6 THEN 'b' ELSE 'c' END AS scene,
  (CASE WHEN vec_id % 7 < 4 THEN vec_id // 7 * 4 + vec_id % 7 WHEN vec_id % 7 < 6 THEN vec_id // 7 * 2 + vec_id % 7 - 4 ELSE vec_id // 7 END)::INT AS r,
  (unnest(range(len(embedding))))::INT AS c, unnest(embedding)::DOUBLE AS z FROM embeddings),
ms AS (SELECT * FROM sc WHERE c < CASE scene WHEN 'a' THEN 64 WHEN 'b' THEN 48 ELSE 32 END),
dm AS (SELECT scene, max(r) + 1 AS h, max(c) + 1 AS w FROM ms GROUP BY scene)"""
CITY = SCENES + """,
bl AS (SELECT scene, r // 16 AS br, c // 16 AS bc, max(CASE WHEN c % 16 = 0 THEN z END) AS e0, max(CASE WHEN c % 16 = 1 THEN z END) AS e1 FROM ms WHERE r % 16 = 0 AND c % 16 < 2 GROUP BY ALL),
ct AS (SELECT ms.scene, r, c, z, 100.0::DOUBLE + 0.05::DOUBLE * c + 0.02::DOUBLE * r AS ground, br * 8 + bc AS block,
  CASE WHEN e0 > -0.1::DOUBLE AND r % 16 BETWEEN 3 AND 12 AND c % 16 BETWEEN 2 AND 11 AND NOT (e1 < 0 AND r % 16 > 5 AND c % 16 > 5)
  THEN 6.0::DOUBLE + floor(abs(e0) * 1000)::BIGINT % 13 + CASE WHEN e1 > 0 AND r % 16 < 8 AND c % 16 < 7 THEN 9.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS height
  FROM ms JOIN bl ON bl.scene = ms.scene AND br = r // 16 AND bc = c // 16)"""

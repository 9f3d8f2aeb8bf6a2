"""Landscape classes of pixels from slope, roughness and vegetation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import materialize
from orograph.operators import focal, local


def landscape_classes(px: DataFrame, size: float, radius: int) -> DataFrame:
    """sparse, hilly, urban or forest; a later rule overrides an earlier one.

    ``px``: z, red, green, blue. Hilly: slope over its p75 (5 degrees at least);
    urban: roughness over its p60, forest: that, and greener than its p70.
    """
    t = focal.slope_deg(px, size)
    t = t.join(focal.roughness(px, radius), ["scene", "r", "c"]).withColumn("veg", local.excess_green(F.col("red"), F.col("green"), F.col("blue")))
    t = materialize(t, "landscape")
    t = local.with_scene(t, s75=local.percentile("slope", 0.75), r60=local.percentile("rough", 0.6), v70=local.percentile("veg", 0.7))
    rough = F.col("rough") > F.col("r60")
    cls = F.when(rough & (F.col("veg") > F.col("v70")), "forest").when(rough, "urban").when(F.col("slope") > F.greatest("s75", F.lit(5.0)), "hilly").otherwise("sparse")
    return t.withColumn("landscape", cls)

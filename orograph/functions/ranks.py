"""Exact quantiles of groups of any size.

The built-in exact percentile keeps a group's distinct values in one task. It serves
groups of up to ``MOST`` rows; for larger ones the values are counted in cells between
their group's extremes, and only those in a cell that holds a wanted rank go on. Few are
left to sort, and a wanted rank is found by how many of its group's rows each partition holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.tables import FEW, materialize

#: Rows of a group whose distinct values a task may hold (some 100 MB).
MOST = 2_000_000
#: Cells between a group's extremes, and how often a cell may be divided again before its rows are sorted.
CELLS, DEEPEST = 2048, 6


def largest_group(df: DataFrame, by: list[str]) -> int:
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _joined(t: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``t`` with the columns of ``rows``, written, one of each group; null is a group too."""
    rows = rows.withColumnsRenamed({b: f"_of_{b}" for b in by})
    small = F.broadcast(rows) if rows.count() <= FEW else rows
    return t.join(small, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]).drop(*[f"_of_{b}" for b in by])


def _holding(parts: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` beside the one of its group's ``parts`` (by, _before, _n, ...) that holds its rank."""
    of = wanted.withColumnsRenamed({b: f"_of_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
    return parts.join(of, [*same, (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))]).drop(*[f"_of_{b}" for b in by])


def _sorted_ranks(values: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """``at_ranks`` by a sort over all tasks.

    Partitions of the sorted table number their rows in order, so the place of a rank
    follows from a count for each group and partition.
    """
    order = values.select(*by, "v").repartitionByRange(*by, "v").sortWithinPartitions(*by, "v")
    t = materialize(order.withColumn("_i", F.monotonically_increasing_id()), "ranked")
    parts = t.groupBy(*by, F.shiftright("_i", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n")
    hit = _holding(materialize(parts.withColumn("_before", before), "rank-counts"), by, wanted)
    at = hit.withColumn("_i", F.col("_first") + F.col("rank") - F.col("_before")).select(*wanted.columns, "_i")
    return at.join(t.select("_i", "v"), "_i").select(*wanted.columns, "v")


def at_ranks(values: DataFrame, by: list[str], wanted: DataFrame, ranges: DataFrame, deep: int = 0) -> DataFrame:
    """``wanted`` (by, rank from 0, ...) and ``v``, the value of that rank among the group's rows of ``values`` (by, v).

    ``ranges`` (by, _lo, _hi) has the extremes of each group. The cell of a value never falls as the
    value rises, so counts of cells tell which one holds a rank, whatever the rounding.
    """
    cell, outer = f"_cell{deep}", f"_rank{deep}"
    half = lambda c: F.col(c) / 2.0 - F.col("_lo") / 2.0
    t = _joined(values, ranges.select(*by, "_lo", "_hi"), by)
    t = t.select(*by, "v", F.when(half("_hi") > 0, F.floor(half("v") / half("_hi") * CELLS)).otherwise(F.lit(0)).cast("long").alias(cell))
    cells = t.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    cells = cells.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy(cell)) - F.col("_n"))
    hit = materialize(_holding(cells, by, wanted), "rank-cells")
    settled = hit.filter("_lo = _hi").select(*wanted.columns, F.col("_lo").alias("v"))
    more = materialize(hit.filter("_lo <> _hi").select(*by, cell, "_n", "_lo", "_hi").distinct(), "rank-open")
    left = more.agg(F.sum("_n")).first()[0]
    if not left:
        return settled
    on = [*by, cell]
    rest = materialize(_joined(t, more.select(*on), on), "rank-rows")
    lower = hit.filter("_lo <> _hi").withColumns({outer: F.col("rank"), "rank": F.col("rank") - F.col("_before")}).select(*wanted.columns, cell, outer)
    found = _sorted_ranks(rest, on, lower) if left <= MOST or deep == DEEPEST else at_ranks(rest, on, lower, more, deep + 1)
    return settled.unionByName(found.withColumn("rank", F.col(outer)).select(*wanted.columns, "v"))


def quantiles(df: DataFrame, by: list[str], most: int = MOST, beside: Sequence[Column] = (), **wanted: tuple) -> DataFrame:
    """A row per group with the aggregates ``beside`` and each named quantile: name=(column, p), or (column, p, q, ...) for an array; nulls don't count.

    Quantiles lie between two rows as in the built-in one.
    """
    if largest_group(df, by) <= most:
        shape = lambda ps: F.lit(ps[0]) if len(ps) == 1 else F.array(*[F.lit(float(p)) for p in ps])
        return df.groupBy(*by).agg(*beside, *[F.percentile(c, shape(ps)).alias(k) for k, (c, *ps) in wanted.items()])
    columns: list = []
    for c, *_ in wanted.values():
        if not any(c is k or (isinstance(c, str) and isinstance(k, str) and c == k) for k in columns):
            columns.append(c)
    place = lambda c: next(i for i, k in enumerate(columns) if c is k or (isinstance(c, str) and isinstance(k, str) and c == k))
    out = df.groupBy(*by).agg(*beside) if beside else df.select(*by).distinct()
    # all columns are ranked together, by their numbers
    each = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])
    values = materialize(df.select(*by, each.alias("_v")), "quantile-rows").select(*by, F.posexplode("_v").alias("_c", "v")).filter("v is not null")
    every = F.array(*[F.struct(F.lit(place(c)).alias("c"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for j, (c, *ps) in enumerate(wanted.values()) for k, p in enumerate(ps)])
    on = [*by, "_c"]
    ranges = materialize(values.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("_lo"), F.max("v").alias("_hi")), "quantile-ranges")
    n = ranges.withColumn("_w", F.explode(every)).filter("_w.c = _c").select(*on, "_w.j", "_w.k", (F.col("_w.p") * (F.col("n") - 1)).alias("at"))
    n = n.select("*", F.posexplode(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long"))).alias("side", "rank"))
    v = at_ranks(values, on, n, ranges)
    of = lambda i: F.max(F.when(F.col("side") == i, F.col("v")))
    n = v.groupBy(*on, "j", "k", "at").agg(of(0).alias("v_low"), of(1).alias("v_high")).withColumn("low", F.floor("at"))
    # each neighbour by its share, as in the built-in one and in SQL: the last digit decides on pixels at a limit
    share = F.col("at") - F.col("low")
    between = F.when(share == 0, F.col("v_low")).otherwise(F.col("v_low") * (F.lit(1.0) - share) + F.col("v_high") * share)
    found = lambda j: F.transform(F.array_sort(F.collect_list(F.when(F.col("j") == j, F.struct("k", between.alias("v"))))), lambda x: x["v"])
    shaped = lambda a, ps: F.get(a, F.lit(0)) if len(ps) == 1 else F.when(F.size(a) > 0, a)
    rows = n.groupBy(*by).agg(*[shaped(found(j), ps).alias(name) for j, (name, (_, *ps)) in enumerate(wanted.items())])
    rows = rows.withColumnsRenamed({b: f"_{b}" for b in by})
    return out.join(rows, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], "left").drop(*[f"_{b}" for b in by])

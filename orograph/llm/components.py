"""Connected components of a link table: local contraction, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import materialize

#: Links that one task contracts at a time, some 10 MB as Python numbers.
PER_TASK = 200_000


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The same components as stars (hi, lo) within each of ``tasks`` parts of the links, centres with themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.setdefault(x, x)) != x:
                root[x] = root[p] if p in root else p
                x = root[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        star = [(x, find(x)) for x in root]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in star], pa.int64()), pa.array([r for _, r in star], pa.int64())], names=["hi", "lo"])

    return edges.repartition(tasks).mapInArrow(run, "hi long, lo long")


def stars(edges: DataFrame) -> DataFrame:
    """Alternate large-star (greater neighbours join the smallest) and small-star (smaller ones do) until nothing moves."""
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.distinct(), "large-star")
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")


def components(links: DataFrame, n_links: int, per_task: int = PER_TASK) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b longs): comp is the smallest node reachable.

    Parts of at most ``per_task`` links are first contracted where they are; with more
    than one part the stars are joined in a logarithmic number of rounds. Each round
    is written, so a lost executor costs one round.
    """
    tasks = max(1, -(-n_links // per_task))
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    one = materialize(contracted(edges, tasks), "contracted")
    if tasks > 1:
        edges = stars(one.filter("hi <> lo"))
        one = edges.unionByName(edges.select(F.col("lo").alias("hi"), "lo").distinct())
    return one.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))

"""Exact top-k inner products by tiles (operator 5).

Vectors are packed into shards and queries into blocks, matrices of a bounded number
of rows. Every query block meets every shard in a tile: one matrix product, of which
only each query's k best leave the task. Lists of the same query are merged by a
tree: in each level a few shards' lists become one, until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.tables import materialize

SHARD, BLOCK, FAN_IN = 8192, 1024, 16
FOUND = "query_id long, shard long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of each component as longs; vectors that are null or hold null, NaN or infinity are left out."""
    v = F.col("embedding").cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(ok & F.col("vec_id").isNotNull()).select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(number, ids, matrix, width) of at most ``rows`` vectors each, packed where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(width: int, ids: list, values: list) -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(values).reshape(-1, width)
            order = np.argsort(i, kind="stable")
            return pa.RecordBatch.from_pydict({"ids": [i[order].astype("<i8").tobytes()], "matrix": [np.ascontiguousarray(v[order], "<i8").tobytes()], "width": pa.array([width], pa.int32())})

        for batch in batches:
            ids, n = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            flat, cut = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])
            for width in np.unique(n[n > 0]).tolist():
                at = np.flatnonzero(n == width)
                v = flat[cut[at][:, None] + np.arange(width)]
                for s in range(0, len(at), rows):
                    part = held.setdefault(width, [[], [], 0])
                    room = rows - part[2]
                    for a, b in ((s, min(s + room, s + rows, len(at))), (min(s + room, s + rows, len(at)), min(s + rows, len(at)))):
                        if b > a:
                            part[0].append(ids[at[a:b]])
                            part[1].append(v[a:b].ravel())
                            part[2] += b - a
                        if part[2] == rows:
                            yield out(width, *part[:2])
                            part[:] = [[], [], 0]
        for width, (ids, values, n) in held.items():
            if n:
                yield out(width, ids, values)

    t = vectors.mapInArrow(run, "ids binary, matrix binary, width int")
    return materialize(t.withColumn("number", F.monotonically_increasing_id()), name)


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best in a tile, ties to smaller ids (``ids`` ascend)."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    exact = most(q) * most(v) * q.shape[1] < 1 << 53
    scores = (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if exact else q @ v.T
    own = q_ids[:, None] == ids[None, :]
    take = min(k + int(own.sum(1).max(initial=0)), len(ids))
    if most(scores) < (1 << 62) // len(ids):
        key = scores * len(ids) + np.arange(len(ids) - 1, -1, -1)
        key[own] = np.iinfo(np.int64).min
        at = np.argpartition(key, len(ids) - take, axis=1)[:, len(ids) - take :]
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :take]
    row = np.repeat(np.arange(len(q_ids)), take)
    at = at.ravel()
    ok = ~own[row, at]
    row, at = row[ok], at[ok]
    return q_ids[row], ids[at], scores[row, at]


def merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each list's k best: cut within partitions before it is shuffled."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query, ties to smaller vec_id.

    Queries are the rows whose vec_id is a multiple of ``every``; all rows but those
    of the query's own id are candidates. Vectors that are null, empty or hold null or
    non-finite components, and rows without vec_id, take no part; only vectors of the same width
    are compared. Repeated rows are candidates each; a query id that repeats is
    answered once, by its first vector. An empty table gives no rows; further columns are
    ignored. Vectors of any width are taken whole. Scores are longs: exact where they fit one.
    """
    t = whole_vectors(vectors)
    shards = packed(t, shard, "shards")
    queries = t.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = packed(queries, block, "query-blocks").select(F.col("number").alias("block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q"), "width")
    n_shards = shards.count()
    numbers = materialize(shards.select("number", "width", (F.row_number().over(W.orderBy("number")) - 1).cast("long").alias("shard")), "shard-numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, number = batch.column("width")[i].as_py(), batch.column("shard")[i].as_py()
                q_ids, q, ids, v = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("q_ids", "q", "ids", "matrix"))
                q, v = q.reshape(-1, width), v.reshape(-1, width)
                query, vec, score = best_of_tile(q_ids, q, ids, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.full(len(query), number)), pa.array(vec), pa.array(score)], names=["query_id", "shard", "vec_id", "score"])

    # the smaller side, the queries, goes to every shard: a row per tile, dealt by shard
    tiles = blocks.join(numbers, "width").repartition(max(1, n_shards), "number").drop("width")
    tiles = tiles.join(shards, "number").select("shard", "width", "q_ids", "q", "ids", "matrix")
    found = materialize(tiles.mapInArrow(run, FOUND), "tile-lists")
    left = n_shards
    while left > FAN_IN:
        found = materialize(merged(found.withColumn("shard", F.floor(F.col("shard") / FAN_IN)), ["query_id", "shard"], k).drop("rank"), "merged-lists")
        left = -(-left // FAN_IN)
    return merged(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")

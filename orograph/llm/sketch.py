"""Count-min sketches of 64-bit hashes: a part per partition, merged by shuffling chunks.

A sketch answers "was this hash seen ``least`` times or more?". It may say yes
wrongly, never no. Its size is fixed by ``bits`` (two rows of 2**bits one-bit cells,
64 MB at the largest), so the merged one is small enough for the driver and for a
broadcast whatever the input; a full one only lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orograph.llm.textnp import U, mix64

ROWS = 2
MOST_BITS = 28
SEED = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)]
PARTS = "chunk int, cells binary"


def bits_for(n: int, per: int = 4) -> int:
    return int(min(MOST_BITS, max(20, np.ceil(np.log2(max(n, 1) * per)))))


def chunk_bits(bits: int) -> int:
    return min(16, bits - 9)


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix64(h ^ SEED[row]) >> U(64 - bits)


class Part:
    """One partition's share of a sketch: the hashes it saw, each counted up to ``least``."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least, self.seen = bits, least, []

    def add(self, h: np.ndarray) -> None:
        self.seen.append(h)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Rows (chunk, cells): each cell's place in its chunk, as often as it counts."""
        if not self.seen:
            return
        h, low = np.concatenate(self.seen), chunk_bits(self.bits)
        for row in range(ROWS):
            c = np.sort(cells(h, row, self.bits))
            if self.least > 1:
                c = c[np.append(np.ones(min(len(c), self.least), bool), c[self.least :] != c[: -self.least])]
            else:
                c = np.unique(c)
            chunk = (c >> U(low)).astype(np.int64)
            at = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(c) else np.zeros(0, np.int64)
            place = (c & U((1 << low) - 1)).astype(np.uint16)
            ids = (chunk[at] + (row << (self.bits - low))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in np.split(place, at[1:])] if len(c) else [], pa.binary())], names=["chunk", "cells"])


def merge(parts: DataFrame, bits: int, least: int, tasks: int) -> list[np.ndarray]:
    """Sum the parts chunk by chunk; the sketch as one bitmap a row."""
    low = chunk_bits(bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, places in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if chunk not in total:
                    total[chunk] = np.zeros(1 << low, np.uint8)
                more = np.bincount(np.frombuffer(places, np.uint16), minlength=1 << low)
                total[chunk] = np.minimum(total[chunk] + more, least).astype(np.uint8)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in total.values()], pa.binary())], names=["chunk", "cells"])

    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    size = 1 << (low - 3)
    for r in parts.repartition(tasks, "chunk").mapInArrow(add, PARTS).collect():
        row, chunk = divmod(r["chunk"], 1 << (bits - low))
        out[row][chunk * size : (chunk + 1) * size] = np.frombuffer(r["cells"], np.uint8)
    return out


def holds(sketch: list[np.ndarray], bits: int, h: np.ndarray) -> np.ndarray:
    """Whether each hash may have been seen often enough."""
    yes = np.ones(len(h), bool)
    for row in range(ROWS):
        c = cells(h, row, bits).astype(np.int64)
        yes &= (sketch[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return yes


def of_column(keys: DataFrame, column: str, n: int, tasks: int) -> tuple[list[np.ndarray], int]:
    """A sketch of membership of the ``n`` values of a long column."""
    bits = bits_for(n, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Part(bits, 1)
        for batch in batches:
            part.add(batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(U))
        yield from part.batches()

    return merge(keys.select(column).mapInArrow(run, PARTS), bits, 1, tasks), bits

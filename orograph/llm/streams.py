"""Rows of one sorted partition as a stream, and rows gathered into batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters and rows of one batch.
MOST_CHARS, MOST_ROWS = 1 << 22, 4096


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


class Gatherer:
    """Collects rows of a schema; ``add`` gives a batch whenever enough of them are held."""

    def __init__(self, schema: StructType):
        self.schema = to_arrow_schema(schema)
        self.held: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.held.append(row)
        self.chars += chars
        if self.chars >= MOST_CHARS or len(self.held) >= MOST_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.held), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.held, self.chars = [], 0

"""Byte strings of 400 that start twice or more anywhere: suffix buckets refined by later offsets (operator 6).

Suffixes are taken at the places that 400-byte windows choose by content, about one
byte in 170; equal windows choose equal places. The initial buckets are those of
suffixes with an equal q-gram. A round refines each bucket that still has differing
members: its windows are cut into smaller blocks, and a block's new bucket is named
by the bucket it was in and by the identifiers of the stretches that it gains at
later and at earlier offsets, so no round looks at what the ones before have
compared. Members alike in all they cover share one pointer and go on as one; buckets
of one member end. The last buckets are of single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orograph.llm.textnp import buffers, chunks
from orograph.llm.windows import Plan, cover, hashed, repeated, with_stretches

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def drop_repeated_bytes(docs: DataFrame, *, window: int = 400, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, concatenated).

    A byte goes if a window over it also starts anywhere else, in the same
    document or another row, repeated rows included; strings that tie all go. Null and empty
    texts have no bytes; a text of any length is one document. An empty table gives no rows; further columns are ignored.
    """
    plan = Plan("byte", window, min(gram, window), (1 << 10, 32, 1), refine=True)
    t = hashed(docs)
    found = repeated(t, plan, earlier=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                rows = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                (buf, offs), cut = buffers(piece.column("text")), piece.column("cut")
                for d in range(piece.num_rows):
                    own = buf[offs[d] : offs[d + 1]]
                    gone = cover(cut[d].values, len(own)) if cut[d].is_valid else np.zeros(len(own), bool)
                    kept = own[~gone].tobytes()
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    for c, v in zip(rows, (len(own), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        rows[c].append(v)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(v, kind) for v, kind in zip(rows.values(), kinds, strict=True))], names=["doc_id", *rows])

    return with_stretches(t, found).mapInArrow(run, OUT)

"""Passages of 50 words that an earlier document has: substring dedup with a count-min prefilter (operator 10).

Partition sketches of the words' grams are merged; a window's count is at most its
gram's estimate. The passes after it key and group exactly only windows that are
estimated repeated, so none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orograph.llm.textnp import Words, chunks
from orograph.llm.windows import Plan, cover, hashed, repeated, with_stretches

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def drop_repeated_passages(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space).

    A word goes if a window over it also starts in a document of smaller doc_id.
    Null and empty texts have no words; a text of any length is one document. A row without doc_id is no one's earlier
    document and keeps its words; rows of equal doc_id don't count as earlier for
    each other. An empty table gives no rows; further columns are ignored.
    """
    plan = Plan("word", window, (window + 1) // 2, (1 << 10, 1))
    t = hashed(docs)
    found = repeated(t, plan, earlier=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                rows = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept")}
                w, cut = Words(piece.column("text")), piece.column("cut")
                for d in range(w.n_docs):
                    lo, n = int(w.bounds[d]), int(w.bounds[d + 1] - w.bounds[d])
                    gone = cover(cut[d].values, n) if cut[d].is_valid else np.zeros(n, bool)
                    kept = b" ".join([w.text(lo + i) for i in np.flatnonzero(~gone)])
                    for c, v in zip(rows, (n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")), strict=True):
                        rows[c].append(v)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept"], pa.string())], names=["doc_id", *rows])

    return with_stretches(t, found).mapInArrow(run, OUT)

"""Greedy word-piece lengths by a linear longest-match automaton (operator 3).

A trie of word starts and one of continuations get failure links. A node's link says
where matching goes on once the longest pieces of its string are taken off, and how
many those are, so a word's length in pieces comes from one walk over its characters
without building a piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orograph.llm.textnp import Words, chunks, sums
from orograph.llm.vocab import SPACE, VOCABULARY, Trie, code_points, pieces, step

START, GO_ON = 0, 1
OUT = "doc_id long, n_words long, n_tokens long, n_unknown long"


def word_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that continue one) of a SentencePiece vocabulary."""
    texts = [p for p, _ in pieces(path) if p.strip(SPACE)]
    return [p[1:] for p in texts if p[0] == SPACE], [p for p in texts if p[0] != SPACE]


def automaton(first: list[str], later: list[str]) -> dict[str, np.ndarray]:
    """The tries with failure links (``link``, -1: no match) and the pieces each takes off (``popped``)."""
    trie = Trie([(p, i, START) for i, p in enumerate(first)] + [(p, i, GO_ON) for i, p in enumerate(later)], roots=2)
    n = len(trie.kids)
    link, popped = [-1] * n, [0] * n
    queue = deque([START, GO_ON])
    while queue:
        parent = queue.popleft()
        for ch, node in trie.kids[parent].items():
            queue.append(node)
            if trie.token[node] >= 0:
                link[node], popped[node] = GO_ON, 1
                continue
            z, taken = link[parent], popped[parent]
            while z >= 0 and ch not in trie.kids[z]:
                taken += popped[z]
                z = link[z]
            if z >= 0:
                link[node], popped[node] = trie.kids[z][ch], taken
    return trie.arrays() | {"link": np.array(link, np.int64), "popped": np.array(popped, np.int64)}


def lengths(auto: dict[str, np.ndarray], words: list[str]) -> np.ndarray:
    """Pieces of each word; -1 where greedy matching gets stuck."""
    cp, bounds = code_points(words)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    node, count = np.full(len(words), START), np.zeros(len(words), np.int64)
    live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for t, n in enumerate(live):
        at = order[:n]
        at = at[node[at] >= 0]
        ch = cp[bounds[at] + t]
        while len(at):
            to = step(auto, node[at], ch)
            ok = to >= 0
            node[at[ok]] = to[ok]
            at, ch = at[~ok], ch[~ok]
            count[at] += auto["popped"][node[at]]
            node[at] = auto["link"][node[at]]
            on = node[at] >= 0
            at, ch = at[on], ch[on]
    at = np.flatnonzero((node >= 0) & (node != GO_ON) & (size > 0))
    while len(at):
        count[at] += auto["popped"][node[at]]
        node[at] = auto["link"][node[at]]
        at = at[(node[at] >= 0) & (node[at] != GO_ON)]
    return np.where(node < 0, -1, count)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every row.

    Words are split at the six ASCII white spaces. A word that greedy matching can't
    finish is one unknown token. Null, empty and blank texts have no words; texts and words of any length
    are walked whole; the longest piece has no tie; equal
    rows get equal counts; an empty table gives no rows; further columns are ignored.
    """
    auto = docs.sparkSession.sparkContext.broadcast(automaton(*word_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                w = Words(piece.column("text"))
                place, code = w.codes()
                n = lengths(auto.value, [w.text(i).decode("utf-8", "replace") for i in place])
                n = n[code] if len(code) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x) for x in (np.diff(w.bounds), sums(np.abs(n), w.bounds), sums((n < 0).astype(np.int64), w.bounds)))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)

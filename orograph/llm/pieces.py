"""SentencePiece encoding by forward filtering and backward sampling, and decoding (operator 1).

A text is spread over the lattice of all vocabulary pieces that cover it. The
forward pass sums the weights of all ways to each place; the backward pass draws a
way from the end, each edge by its share. The draws are hashes of the row's key and
the place, so a row is always segmented alike, on whatever machine. Pieces hold the
space mark only at their front, so the lattice falls apart at every space; a batch
builds each distinct part once and samples all its uses with arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orograph.llm.textnp import U, buffers, chunks, distinct_stretches, mix64
from orograph.llm.vocab import SPACE, VOCABULARY, Trie, byte_ids, code_points, pieces, step, uniform

#: Stands for a space mark that the text itself has: no piece holds it, so its bytes are encoded.
LITERAL = 0x110000
ALPHA, LEAST = 5e-4, -40.0
#: Bytes of text that a task spreads over lattices at a time.
CHUNK = 1 << 20
#: Ids decoded at once, about.
IDS_AT_ONCE = 1 << 18


class Model:
    """What tasks need of a vocabulary: a trie, log-weights by id, byte pieces, and each id's bytes."""

    def __init__(self, path: str, alpha: float):
        found = pieces(path)
        self.trie = Trie([(p, i) for i, (p, _) in enumerate(found) if p]).arrays()
        self.weight = np.maximum(alpha * np.array([s for _, s in found]), LEAST)
        self.bytes = byte_ids(path)
        raw = [p.replace(SPACE, " ").encode() for p, _ in found]
        for b, i in enumerate(self.bytes):
            if i >= 0:
                raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)


class Lattice:
    """Edges of the parts' lattices, with each edge's share among those that end at its node."""

    def __init__(self, model: Model, cp: np.ndarray, bounds: np.ndarray):
        """``cp``, ``bounds``: the code points of all parts, and where each begins and ends."""
        n_parts = len(bounds) - 1
        cp = np.where(cp == ord(SPACE), LITERAL, np.where(cp == ord(" "), ord(SPACE), cp))
        self.bounds = bounds
        n_nodes = len(cp) + n_parts
        part = np.repeat(np.arange(n_parts), np.diff(bounds))
        at = np.arange(len(cp))
        node = at + part
        stop = bounds[1:][part]
        state, alive, length = np.zeros(len(cp), np.int64), at, 0
        starts, ends, tokens = [], [], []
        covered = np.zeros(len(cp), bool)
        while len(alive):
            alive = alive[alive + length < stop[alive]]
            state[alive] = step(model.trie, state[alive], cp[alive + length])
            alive = alive[state[alive] >= 0]
            length += 1
            hit = alive[model.trie["token"][state[alive]] >= 0]
            starts.append(node[hit])
            ends.append(node[hit] + length)
            tokens.append(model.trie["token"][state[hit]])
            if length == 1:
                covered[hit] = True
        bare = np.flatnonzero(~covered)
        starts.append(node[bare])
        ends.append(node[bare] + 1)
        tokens.append(-1 - cp[bare])
        start, end, token = np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens)
        order = np.argsort(end, kind="stable")
        self.start, self.end, self.token = start[order], end[order], token[order]
        weight = np.where(self.token >= 0, model.weight[np.maximum(self.token, 0)], LEAST)
        self.last = bounds[1:] + np.arange(n_parts)
        self._filter(weight, n_nodes, node, at - bounds[:-1][part])

    def _filter(self, weight, n_nodes, node, depth) -> None:
        """Forward sums node by node, all parts at once by depth."""
        total = np.zeros(n_nodes)
        first = np.searchsorted(self.end, np.arange(n_nodes + 1))
        share = np.empty(len(self.end))
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
        for d in range(len(cut) - 1):
            to = node[order[cut[d] : cut[d + 1]]] + 1
            n = first[to + 1] - first[to]
            begin = np.cumsum(n) - n
            e = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(first[to], n)
            x = total[self.start[e]] + weight[e]
            top = np.maximum.reduceat(x, begin)
            y = np.exp(x - np.repeat(top, n))
            z = np.add.reduceat(y, begin)
            total[to] = top + np.log(z)
            share[e] = y / np.repeat(z, n)
        # running shares within each node, so that a draw depends on its own part alone
        self.until, self.first = share, first
        size = np.diff(first)
        at = first[:-1][size > 1] + 1
        stop = first[1:][size > 1]
        while len(at):
            self.until[at] += self.until[at - 1]
            at, stop = at[at + 1 < stop] + 1, stop[at + 1 < stop]

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge that ends at each node, by the numbers ``u`` in [0, 1)."""
        e, last, x = self.first[node], self.first[node + 1] - 1, u
        on = np.flatnonzero((self.until[e] <= x) & (e < last))
        while len(on):
            e[on] += 1
            on = on[(self.until[e[on]] <= x[on]) & (e[on] < last[on])]
        return e


def units(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes with a space before each text, offsets, start and end of each part, bounds): a part is spaces and what follows."""
    buf, offs = buffers(texts)
    n = len(offs) - 1
    size = np.diff(offs)
    full = size > 0
    out = np.full(len(buf) + int(full.sum()), 0x20, np.uint8)
    shift = np.cumsum(full)
    out[np.arange(len(buf)) + np.repeat(shift, size)] = buf
    offs = np.concatenate([[0], np.cumsum(size + full)])
    space = out == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offs[:-1][full]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(out)) if len(start) else start
    return out, offs, start, end, np.searchsorted(start, offs) if n else np.zeros(1, np.int64)


def part_points(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of stretches of UTF-8, bounds)."""
    n = end - start
    stop = np.cumsum(n)
    raw = buf[np.arange(int(n.sum())) + np.repeat(start - stop + n, n)]
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    try:
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    except UnicodeDecodeError:  # bytes that are not UTF-8 are replaced, part by part
        return code_points([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start, end, strict=True)])
    return points, lead[np.concatenate([[0], stop])]


def sample(model: Model, texts: pa.Array, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds): one segmentation of each text, drawn by its key."""
    buf, offs, start, end, bounds = units(texts)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    place, code = distinct_stretches(buf, np.append(start, end[-1]))
    lattice = Lattice(model, *part_points(buf, start[place], end[place]))
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    salt = mix64(mix64(keys[doc] + U(seed)) + (np.arange(len(start)) - bounds[doc]).astype(U))
    node, base = lattice.last[code], (lattice.bounds[:-1] + np.arange(len(place)))[code]
    alive, turn, uses, edges = np.arange(len(start)), 0, [], []
    while len(alive):
        e = lattice.draw(node[alive], uniform(mix64(salt[alive] + U(turn))))
        uses.append(alive)
        edges.append(e)
        node[alive] = lattice.start[e]
        alive = alive[node[alive] > base[alive]]
        turn += 1
    turns = np.concatenate([np.full(len(x), t) for t, x in enumerate(uses)])
    use, edge = np.concatenate(uses), np.concatenate(edges)
    order = np.lexsort((-turns, use))
    use, token = use[order], lattice.token[edge[order]]
    width = np.ones(len(token), np.int64)
    bare = np.flatnonzero(token < 0)
    spelled = [SPACE.encode() if c == LITERAL else chr(c).encode("utf-8", "surrogatepass") for c in (-1 - token[bare]).tolist()]
    width[bare] = [len(x) for x in spelled]
    ids = np.repeat(token, width)
    if len(bare):
        at = (np.cumsum(width) - width)[bare]
        n = width[bare]
        ids[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)] = model.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
    each = np.bincount(doc[use], width, minlength=len(offs) - 1).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(each)])


def spell(model: Model, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The texts of id sequences, without the space that encoding puts before each."""
    size = model.size[ids]
    begin = np.cumsum(size) - size
    raw = model.raw[np.arange(int(size.sum())) - np.repeat(begin - model.start[ids], size)]
    cut = np.concatenate([begin, [size.sum()]])[bounds]
    return [raw[a + (b > a) : b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def row_keys(piece: pa.RecordBatch) -> np.ndarray:
    return mix64(piece.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U))


def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, alpha: float = ALPHA, seed: int = 1) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), a sampled segmentation of ``text`` drawn by ``doc_id``.

    A way's weight is the product of its pieces' exp(alpha * score). Null and empty
    texts have no ids; texts of any length are encoded whole; a tie of draw and share goes
    to the next piece; rows of equal id and text get equal ids; rows without doc_id
    share one key; an empty table gives no rows; other columns pass through (one
    named ids is replaced).
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(vocabulary, alpha))
    base = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, most=CHUNK):
                ids, bounds = sample(model.value, piece.column("text"), row_keys(piece), seed)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], names=[*piece.schema.names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, ids array<int>")


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``decoded``: the text of ``ids``.

    Null and empty ids give an empty text, long ones are decoded whole, repeated rows
    fare alike; an empty table gives no rows; other columns pass through (one named
    decoded is replaced).
    """
    model = encoded.sparkSession.sparkContext.broadcast(Model(vocabulary, ALPHA))
    base = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offs, at = np.concatenate([[0], np.cumsum(n)]), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offs, offs[at] + IDS_AT_ONCE, "right")) - 1)
                piece, bounds, at = batch.slice(at, end - at), offs[at : end + 1] - offs[at], end
                flat = piece.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = spell(model.value, flat, bounds)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], names=[*piece.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, *, vocabulary: str = VOCABULARY, alpha: float = ALPHA, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, digests of ids (comma-joined), text and decoded text, and lossless: each text encoded and decoded again.

    Rows are as those of ``encode`` and ``decode``, one after the other in a task, so
    neither ids nor texts are shuffled or written; a null text counts as empty.
    """
    t = decode(encode(docs.select("doc_id", "text"), vocabulary=vocabulary, alpha=alpha, seed=seed), vocabulary=vocabulary)
    text = F.coalesce("text", F.lit(""))
    digests = [
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(text, 256).alias("text_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
    return t.select("doc_id", *digests, (text == F.col("decoded")).alias("lossless"))

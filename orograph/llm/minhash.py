"""Near-duplicate documents by an LSH forest of MinHash signatures (operator 9).

Documents with the same shingle set form a class and go on as one. A class's
signature is cut into trees; each tree sorts all classes by its part of the
signature, and direct neighbours in that order that share a prefix become
candidates. Those whose whole signatures agree too little for a link go; the others
are confirmed on full sets: first the neighbours in one tree, then the best pair of
any two components, then all that are left. What confirmed links connect already
needs no confirming.

The depth adapts to each region: where a prefix has more members than neighbours
were looked at, and they are not yet one component, its rows are searched again one
level deeper and eight times as wide, once. There a row's
candidate in a tree is the one of another component whose signature agrees best.
These rounds only join quickly what is easily joined. Last, in every region of the
least depth that is still not one component, all pairs of rows of different
components are compared, block by block; those that agree enough are confirmed on full
sets where they are found, and only the links that connect leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import materialize
from orograph.llm.components import components
from orograph.llm.textnp import BYTE, U, Prefix, Words, chunks, mix64

TREES, DEPTH, LEAST_DEPTH, NEAR = 16, 8, 3, 1
#: Beyond so many neighbours a row's region is left to the comparison of all that is apart in it.
MOST_NEAR = 8
#: Minima beside those of the trees, of which one byte each is kept.
MORE = 64
THRESHOLD = (80, 100)
#: A link's signatures agree in 80 % of 192 places, give or take 2.9 %; 3.5 deviations below is 70 %.
LEAST_AGREEMENT = 0.70
LOWER = BYTE.copy()
LOWER[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
SIGNED = "doc_id long, th long, n_shingles long, c long, c2 long, sig binary"


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, their bounds)."""
    w = Words(texts)
    h = w.hashes(LOWER)
    n = np.diff(w.bounds)
    each = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(w.n_docs), each)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + w.bounds[:-1][doc]
    key = Prefix(h).of(start, start + np.minimum(n, size)[doc])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(w.n_docs + 1))


def class_ids(key: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's set."""
    out = []
    for seed in (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)):
        run = np.concatenate([[U(0)], np.cumsum(mix64(key ^ seed), dtype=U)])
        out.append(mix64(run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


_rng = np.random.default_rng(9)
MULTIPLY = _rng.integers(0, 1 << 63, TREES * DEPTH + MORE, dtype=U) * U(2) + U(1)
ADD = _rng.integers(0, 1 << 63, TREES * DEPTH + MORE, dtype=U)


def signatures(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document TREES * DEPTH big-endian 32-bit minima, and a byte of each of MORE others (zeros without shingles)."""
    n = TREES * DEPTH
    out = np.zeros((len(bounds) - 1, 4 * n + MORE), np.uint8)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for t in range(n + MORE):
            v = np.minimum.reduceat(((key * MULTIPLY[t] + ADD[t]) >> U(32)).astype(np.uint32), bounds[full])
            if t < n:
                out[full, 4 * t : 4 * t + 4] = v.astype(">u4").view(np.uint8).reshape(-1, 4)
            else:
                out[full, 3 * n + t] = v & 0xFF
    return out


def signed(docs: DataFrame, size: int) -> DataFrame:
    """Set size, class hashes and signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                key, bounds = shingles(piece.column("text"), size)
                c, c2 = class_ids(key, bounds)
                sig = signatures(key, bounds)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("th"), pa.array(np.diff(bounds)), pa.array(c), pa.array(c2), pa.array([x.tobytes() for x in sig], pa.binary())], names=["doc_id", "th", "n_shingles", "c", "c2", "sig"]
                )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, SIGNED)


def forest(classes: DataFrame) -> DataFrame:
    """(tree, key, c) of every class in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, c = batch.column("sig").to_pylist(), batch.column("c")
            for t in range(TREES):
                part = [s[t * DEPTH * 4 : (t + 1) * DEPTH * 4] for s in sig]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(part, pa.binary()), c], names=["tree", "key", "c"])

    return classes.select("c", "sig").mapInArrow(run, "tree int, key binary, c long")


PAIRS = "a long, b long, score int, chain boolean, part int, place int, tree int, key binary, c long, comp long"
KINDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.int32()), ("chain", pa.bool_()), ("part", pa.int32()), ("place", pa.int32()), ("tree", pa.int32()), ("key", pa.binary()), ("c", pa.int64()), ("comp", pa.int64())])


def near_pairs(rows, near: int, depth: int, split: int | None = None) -> pa.RecordBatch:
    """Candidates among sorted rows (tree, key, c, comp) at most ``near`` apart with a common prefix of ``depth`` values.

    Without sketches (keys of the tree's part alone) every such pair; with the sketch
    after the key, for each row the best agreeing one of another component. With
    ``split`` only pairs across it.
    """
    tree, c, comp = (rows.column(k).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(k).to_numpy() for k in ("tree", "c", "comp"))
    keys = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(len(c), -1)
    key, sketch = keys[:, : 4 * DEPTH].copy().view(">u4"), keys[:, 4 * DEPTH :]
    found = []
    best, partner = np.full(len(c), LEAST_AGREEMENT), np.full(len(c), -1)
    for d in range(1, min(near, len(c) - 1) + 1):
        same = (tree[:-d] == tree[d:]) & (key[:-d, depth - 1] == key[d:, depth - 1]) & (comp[:-d] != comp[d:])
        at = np.flatnonzero(same)
        if split is not None:
            at = at[(at < split) & (at + d >= split)]
        at = at[(key[at, :depth] == key[at + d, :depth]).all(1)]
        if sketch.shape[1]:
            agree = (sketch[at] == sketch[at + d]).mean(1)
            for me, other in ((at, at + d), (at + d, at)):
                up = agree > best[me]
                best[me[up]], partner[me[up]] = agree[up], other[up]
        else:
            lcp = np.logical_and.accumulate(key[at] == key[at + d], axis=1).sum(1)
            found.append((c[at], c[at + d], lcp, tree[at] == 0))
    if sketch.shape[1]:
        at = np.flatnonzero(partner >= 0)
        found.append((c[at], c[partner[at]], (best[at] * 1000).astype(np.int64), tree[at] == 0))
    a, b, score, chain = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    n = len(a)
    nulls = [pa.nulls(n, f.type) for f in list(KINDS)[4:]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score.astype(np.int32)), pa.array(chain.astype(bool)), *nulls], schema=KINDS)


def neighbours(rows: DataFrame, near: int, depth: int, tasks: int) -> DataFrame:
    """Candidate pairs (a, b, score, chain) of forest rows (tree, key, c, comp); chain: of the first tree.

    A range partition holds a stretch of the order. Its last rows also meet the rows
    that follow them, in a group of at most twice ``near`` rows for each partition's end;
    those may lie several short partitions on, which the partitions' row counts tell.
    """

    def edge(part: int, places: np.ndarray, rows: pa.Table | None) -> pa.RecordBatch:
        n = len(places)
        own = [rows.column(k).combine_chunks() for k in ("tree", "key", "c", "comp")] if rows is not None else [pa.nulls(n, f.type) for f in list(KINDS)[6:]]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, part, np.int32)), pa.array(places.astype(np.int32)), *own], schema=KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        tail, head = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            n += batch.num_rows
            if sum(x.num_rows for x in head) < near:
                head.append(batch.slice(0, near))
            for at in range(0, batch.num_rows, 1 << 16):
                piece = batch.slice(at, 1 << 16)
                table = piece if tail is None else pa.Table.from_batches([tail, piece]).combine_chunks().to_batches()[0]
                yield near_pairs(table, near, depth)
                tail = table.slice(max(0, table.num_rows - near))
        if tail is None:
            return
        first = pa.Table.from_batches(head).slice(0, near)
        yield edge(part, np.arange(first.num_rows), first)
        yield edge(part, np.arange(-tail.num_rows, 0), pa.Table.from_batches([tail]))
        yield edge(part, np.array([n]), None)

    def across(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        split = int(np.searchsorted(group.column("place").to_numpy(), 0))
        return pa.Table.from_batches([near_pairs(group, near, depth, split)]).select(["a", "b", "score", "chain"])

    order = rows.repartitionByRange(tasks, "tree", "key", "c").sortWithinPartitions("tree", "key", "c")
    both = materialize(order.mapInArrow(run, PAIRS), "neighbours")
    inner = both.filter("a is not null").select("a", "b", "score", "chain")
    # a row a partition: which ends of partitions before it its first rows are near to, and how far on
    sizes = sorted((r["part"], r["place"]) for r in both.filter("part is not null and c is null").select("part", "place").collect())
    reach = []
    for i, (part, _) in enumerate(sizes):
        back, j = 0, i - 1
        while j >= 0 and back < near:
            reach.append((part, sizes[j][0], back))
            back, j = back + sizes[j][1], j - 1
    columns = ["tree", "key", "c", "comp"]
    tails = both.filter("c is not null and place < 0").select(F.col("part").alias("after"), "place", *columns)
    heads = both.filter("c is not null and place >= 0").join(F.broadcast(rows.sparkSession.createDataFrame(reach, "part int, after int, back int")), "part")
    heads = heads.withColumn("place", F.col("place") + F.col("back")).filter(F.col("place") < near).select("after", "place", *columns)
    edges = tails.unionByName(heads).groupBy("after").applyInArrow(across, "a long, b long, score int, chain boolean")
    every = inner.unionByName(edges).filter("a <> b")
    return every.groupBy("a", "b").agg(F.sum("score").alias("score"), F.max("chain").alias("chain"))


#: Rows and shingles of a block of a region, about; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Sketches compared at once, and candidates that are confirmed together.
AT_ONCE = 1 << 16
#: Lowest bits of two documents of similarity 0.8 agree in 90 % of 192 places, give or take 2.2 %; four deviations below is 81 %.
LEAST_BITS = 0.81


def bounds_of(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where the groups (g, h) of sorted rows begin, and where the last ends."""
    new = np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1
    return np.concatenate([[0], new, [len(g)]]) if len(g) else np.zeros(1, np.int64)


def alike(sketch: np.ndarray, comp: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) of different components whose sketches agree enough for a link; in two blocks, only those across."""
    n = len(comp)
    two = bool(side.any())
    bits = np.packbits(sketch & 1, axis=1).view(np.uint64) if sketch.shape[1] % 64 == 0 else None
    for d in range(1, n):
        at = np.flatnonzero(comp[:-d] != comp[d:])
        if two:
            at = at[side[at] != side[at + d]]
        for k in range(0, len(at), AT_ONCE):
            x = at[k : k + AT_ONCE]
            if bits is not None:
                x = x[np.bitwise_count(bits[x] ^ bits[x + d]).sum(1) <= (1 - LEAST_BITS) * sketch.shape[1]]
            x = x[(sketch[x] == sketch[x + d]).mean(1) >= LEAST_AGREEMENT]
            if len(x):
                yield x, x + d


def with_partner(rows: pa.Table) -> np.ndarray:
    """The classes of sorted rows (g, h, side, c, comp, sketch) that agree enough with one of another component of their group."""
    g, h, side, c, comp = (rows.column(k).to_numpy() for k in ("g", "h", "side", "c", "comp"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(c), -1)
    hit, cut = np.zeros(len(c), bool), bounds_of(g, h)
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        for i, j in alike(sketch[s:e], comp[s:e], side[s:e]):
            hit[s + i] = hit[s + j] = True
    return c[hit]


def linked(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """Links between classes of sorted rows (g, h, side, c, comp, sketch, shingles), confirmed on their full sets: enough to connect what is linked within each group."""
    g, h, side, c, comp = (rows.column(k).to_numpy() for k in ("g", "h", "side", "c", "comp"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(c), -1)
    sets = rows.column("shingles").combine_chunks()
    values, offs = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    cut = bounds_of(g, h)
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        codes = np.unique(values[offs[s] : offs[e]], return_inverse=True)[1]
        yield from ((int(c[s + x]), int(c[s + y])) for x, y in linked_sets(codes, offs[s : e + 1] - offs[s], comp[s:e].copy(), alike(sketch[s:e], comp[s:e], side[s:e])))


def linked_sets(codes: np.ndarray, at: np.ndarray, comp: np.ndarray, candidates: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Rows of sets ``codes[at[i] : at[i + 1]]`` that are similar and connect components (``comp`` is kept up to date)."""
    least, whole = THRESHOLD
    size, mark = np.diff(at), np.zeros(int(codes.max(initial=0)) + 1, bool)

    def confirm(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for js in [] if not len(i) else np.split(j, np.flatnonzero(i[1:] != i[:-1]) + 1):
            x, i = int(i[0]), i[len(js) :]
            js = js[comp[js] != comp[x]]
            if not len(js):
                continue
            mark[codes[at[x] : at[x + 1]]] = True
            hits = mark[np.concatenate([codes[at[y] : at[y + 1]] for y in js])]
            both = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(size[js])[:-1]]), dtype=np.int64)
            mark[codes[at[x] : at[x + 1]]] = False
            for y in js[whole * both >= least * (size[x] + size[js] - both)].tolist():
                if comp[x] != comp[y]:
                    comp[comp == comp[y]] = comp[x]
                    yield x, y

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in candidates:
        near = (whole * np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])) & (comp[i] != comp[j])
        held.append((i[near], j[near]))
        if sum(len(x) for x, _ in held) >= AT_ONCE:
            yield from confirm(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
    if held:
        yield from confirm(*(np.concatenate(x) for x in zip(*held, strict=True)))


def blocked(rows: DataFrame) -> DataFrame:
    """Rows (region, nb, c, ...) as (g, h, side, c, ...): each pair of a region's ``nb`` blocks (by a hash of the class) is a group, each block with itself too."""
    rest = [k for k in rows.columns if k not in ("region", "nb")]
    t = rows.withColumn("i", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    i, j = F.least("i", "j"), F.greatest("i", "j")
    t = t.select(F.col("region").alias("g"), (i.cast("long") * F.lit(1 << 31) + j).alias("h"), (F.col("i") > F.col("j")).cast("int").alias("side"), *rest)
    return t.repartition("g", "h").sortWithinPartitions("g", "h")


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (g, h) of sorted batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        g, h = table.column("g").to_numpy(), table.column("h").to_numpy()
        last = int(np.argmax((g == g[-1]) & (h == h[-1])))
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None:
        yield rest


def partners(rows: DataFrame) -> DataFrame:
    """Distinct ``c`` of blocked rows that agree enough with one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(with_partner(table)))], names=["c"])

    return rows.mapInArrow(run, "c long").distinct()


def confirmed(rows: DataFrame) -> DataFrame:
    """Links (a, b) of blocked rows with their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches):
            found = np.array(list(linked(table)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def sketches(classes: DataFrame) -> DataFrame:
    """(c, sketch): a byte of each of a class's minima."""
    n = TREES * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, 4 * n + MORE)
            low = np.concatenate([sig[:, 3 : 4 * n : 4], sig[:, 4 * n :]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([x.tobytes() for x in low], pa.binary())], names=["c", "sketch"])

    return classes.select("c", "sig").mapInArrow(run, "c long, sketch binary")


def plausible(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough for a link."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("x", "y"))
            yield batch.select(columns).filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT))

    t = pairs.join(sketch.select(F.col("c").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("c").alias("b"), F.col("sketch").alias("y")), "b")
    return t.select(*columns, "x", "y").mapInArrow(run, pairs.schema)


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int, few: bool, repeats: bool) -> DataFrame:
    """(c, shingles) of the wanted classes (c, first_doc), from the texts of their first documents.

    ``few``: the ids are known to fit a broadcast; else texts are shuffled to them.
    ``repeats``: some row may be there twice, which must not double a class.
    """
    wanted = F.broadcast(ids) if few else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                key, bounds = shingles(piece.column("text"), size)
                c, _ = class_ids(key, bounds)
                want = piece.column("c").to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(c), lists], names=["c", "shingles"]).filter(pa.array(c == want))

    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("first_doc")).select("text", "c").mapInArrow(run, "c long, shingles array<long>")
    return materialize(found.dropDuplicates(["c"]) if repeats else found, "shingle-sets")


#: Rows of two longs that may be broadcast (16 MB).
MOST_BROADCAST = 1_000_000


def relabelled(pairs: DataFrame, comp: DataFrame, few: bool) -> DataFrame:
    """The pairs whose classes are in different components, with those (ca, cb); ``few``: the components fit a broadcast."""
    for side in "ab":
        to = comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
        pairs = pairs.join(F.broadcast(to) if few else to, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs.filter("ca <> cb")


class Linker:
    """Confirms candidate pairs on full sets and keeps the components of what is linked so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, repeats: bool):
        self.docs, self.classes, self.size, self.repeats = docs, classes, size, repeats
        self.links: DataFrame | None = None
        self.comp: DataFrame | None = None
        self.n = 0

    @property
    def few(self) -> bool:
        return 2 * self.n <= MOST_BROADCAST

    def apart(self, pairs: DataFrame) -> DataFrame:
        if self.comp is None:
            return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
        return relabelled(pairs, self.comp, self.few)

    def confirm(self, pairs: DataFrame) -> None:
        """``pairs`` (a, b) is a written table; the similar ones become links."""
        n = pairs.count()
        if not n:
            return
        ids = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        ids = ids.join(self.classes.select("c", "first_doc"), "c")
        sets = shingle_sets(self.docs, ids, self.size, 2 * n <= MOST_BROADCAST, self.repeats)
        t = pairs.select("a", "b").join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a")
        t = t.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
        least, whole = THRESHOLD
        nx, ny = F.size("x"), F.size("y")
        common = F.when(whole * F.least(nx, ny) >= least * F.greatest(nx, ny), F.size(F.array_intersect("x", "y"))).otherwise(0)
        self.add(materialize(t.withColumn("common", common).filter(whole * F.col("common") >= least * (nx + ny - F.col("common"))).select("a", "b"), "confirmed"))

    def add(self, more: DataFrame) -> None:
        """``more`` (a, b) is a written table of links."""
        found = more.count()
        if found:
            self.n += found
            self.links = more if self.links is None else self.links.unionByName(more)
            self.comp = components(self.links, self.n)


def class_components(docs: DataFrame, classes: DataFrame, size: int, repeats: bool, near: int = NEAR, depth: int = LEAST_DEPTH) -> DataFrame | None:
    """(node, comp) of classes that are linked with others, or None where no two are."""
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, classes.count() * TREES // 20_000))
    rows, sketch, dense = forest(classes).withColumn("comp", F.col("c")), sketches(classes), False
    linker, least = Linker(docs, classes, size, repeats), depth
    while near <= MOST_NEAR:
        pairs = neighbours(rows, near, depth, tasks)
        pairs = materialize(pairs if dense else plausible(pairs, sketch), "candidates")
        n = pairs.count()
        if n:
            # a row's best in a crowded region is as good in any tree, so one pass does for all of them
            if not dense:
                linker.confirm(pairs.filter("chain"))
            rest = materialize(linker.apart(pairs if dense else pairs.filter("not chain")), "rest")
            first = rest.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max(F.struct("score", "a", "b")).alias("m")).select("m.a", "m.b")
            first = materialize(first, "best")
            n = first.count()
            linker.confirm(first)
            if n and n < rest.count():
                linker.confirm(materialize(linker.apart(rest.select("a", "b").join(first, ["a", "b"], "left_anti")).select("a", "b"), "rest"))
        # regions with more rows than neighbours reach, not yet one component, go one level deeper
        near, depth = near * 8, min(depth + 1, DEPTH)
        named = rows.drop("comp").withColumn("region", F.xxhash64("tree", F.substring("key", 1, 4 * depth)))
        if linker.comp is not None:
            to = linker.comp.select(F.col("node").alias("c"), "comp")
            named = named.join(F.broadcast(to) if linker.few else to, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        else:
            named = named.withColumn("comp", F.col("c"))
        crowded = named.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        crowded = materialize(crowded.filter((F.col("n") > near // 8 + 1) & (F.col("c1") < F.col("c2"))).select("region"), "dense")
        n = crowded.count()
        if not n:
            break
        rows = named.join(F.broadcast(crowded) if n <= MOST_BROADCAST else crowded, "region", "left_semi")
        rows = rows if dense else rows.join(sketch, "c").withColumn("key", F.concat("key", "sketch"))
        rows, dense = materialize(rows.select("tree", "key", "c", "comp"), "dense-rows"), True
        tasks = max(1, min(most, rows.count() // 20_000))
    close(linker, forest(classes).withColumn("region", F.xxhash64("tree", F.substring("key", 1, 4 * least))).select("region", "c"), sketch)
    return linker.comp


def close(linker: Linker, rows: DataFrame, sketch: DataFrame) -> None:
    """Compare all that is still apart within a region (rows: region, c) and link what is similar.

    First the sketches alone: which classes have a candidate at all. Those get their full
    sets, and the same comparison confirms its candidates where it finds them, so
    candidates, of which a crowded region has many, are never rows.
    """
    named = rows.withColumn("comp", F.col("c"))
    if linker.comp is not None:
        to = linker.comp.select(F.col("node").alias("c"), "comp")
        named = rows.join(F.broadcast(to) if linker.few else to, "c", "left").withColumn("comp", F.coalesce("comp", "c"))

    def split(t: DataFrame, blocks: Column, name: str) -> DataFrame | None:
        """The regions of ``t`` with two components and more, their rows with the number of ``blocks``."""
        found = t.groupBy("region").agg(blocks.cast("int").alias("nb"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        found = materialize(found.filter("c1 < c2").select("region", "nb"), name)
        n = found.count()
        return t.join(F.broadcast(found) if n <= MOST_BROADCAST // 4 else found, "region") if n else None

    by_rows = F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK)))
    apart = split(named, by_rows, "split-regions")
    if apart is None:
        return
    some = materialize(partners(blocked(apart.join(sketch, "c"))), "partners")
    n = some.count()
    if not n:
        return
    few = n <= MOST_BROADCAST // 2
    sets = shingle_sets(linker.docs, some.join(linker.classes.select("c", "first_doc"), "c"), linker.size, few, linker.repeats)
    left = named.join(F.broadcast(some) if few else some, "c", "left_semi").join(sets.select("c", F.size("shingles").alias("_n")), "c")
    apart = split(left, F.greatest(by_rows, F.ceil(F.sum("_n") / F.lit(float(BLOCK_SHINGLES)))), "open-regions")
    if apart is not None:
        linker.add(materialize(confirmed(blocked(apart.drop("_n").join(sketch, "c").join(sets, "c"))), "links"))


def grouped(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles and component_id of every row."""
    found = materialize(signed(docs, shingle), "signatures")
    full = found.filter("n_shingles > 0")
    classes = materialize(full.filter("doc_id is not null").groupBy("c", "c2").agg(F.min("doc_id").alias("first_doc"), F.first("sig").alias("sig")), "classes")
    repeats = found.count() > found.select("doc_id", "th").distinct().count()
    comp = class_components(docs, classes, shingle, repeats)
    named = classes.select("c", "c2", F.col("first_doc").alias("least"))
    if comp is not None:
        named = classes.select("c", "c2", "first_doc").join(comp.select(F.col("node").alias("c"), "comp"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        least = materialize(named.groupBy("comp").agg(F.min("first_doc").alias("least")), "least")
        named = named.join(least, "comp").select("c", "c2", "least")
    named = materialize(named, "class-components")
    t = found.select("doc_id", "th", "n_shingles", "c", "c2").join(named, ["c", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return t.select("doc_id", "th", "n_shingles", component.alias("component_id"))


KEPT = "component_id IS NULL OR doc_id <=> component_id"


def near_duplicates(docs: DataFrame, *, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    component_id is the smallest doc_id that confirmed links reach, so ties of equal
    texts go to the smallest; texts of any length are taken whole; a document of
    fewer words than a shingle has its whole sequence as the only one. Null, empty
    and blank texts have no shingles and no links. Rows without doc_id link others
    only through their class and get their component's id; one without any is kept
    and has none. An empty table gives no rows; further columns are ignored.
    """
    return grouped(docs, shingle).select("doc_id", "n_shingles", "component_id", F.expr(KEPT).alias("kept"))


def distinct_documents(docs: DataFrame, *, shingle: int = 5, most_broadcast: int = 1_000_000) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns, whatever their names: the one of the smallest doc_id.

    Null, empty and long texts and an empty table are as in ``near_duplicates``. Rows that repeat a doc_id and its text leave one. The rows to drop (16 bytes
    each) are broadcast up to ``most_broadcast``, beyond that texts are shuffled to them.
    """
    found = materialize(grouped(docs, shingle), "near-groups")
    drop = materialize(found.filter(f"NOT ({KEPT})").select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("n"), F.col("th").alias("t")).distinct(), "near-drop")
    drop = F.broadcast(drop) if drop.count() <= most_broadcast else drop
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    doc, text = F.col("_row.doc_id"), F.col("_row.text")
    on = (F.coalesce(doc, F.lit(0)) == F.col("d")) & (doc.isNull() == F.col("n")) & (F.xxhash64(text) == F.col("t"))
    left = rows.join(drop, on, "left_anti")
    twice = found.filter(KEPT).filter("n_shingles > 0").groupBy("doc_id", "th").count().filter("count > 1 and doc_id is not null").limit(1).count()
    if twice:
        left = left.select("_row", doc.alias("d"), text.alias("t")).dropDuplicates(["d", "t"])
    return left.select("_row.*")

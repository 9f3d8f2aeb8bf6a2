"""Repeated windows of byte or word sequences, shared by operators 6 and 10.

A window's *anchor* is the gram of smallest hash in it. Anchors depend on a
window's own content only, so equal windows have equal anchors at equal places, and
consecutive windows mostly share one: a *run*. Grouping starts with runs by their
gram. Members of a group that extend alike to both sides for all their windows are
settled together and one goes on for them; where members differ, they are cut into
blocks of fewer windows and grouped again by what all windows of a block have in
common, down to single windows. Each round
reads the texts once more and keys only what the round before left open (a merged
sketch tells, which may let too much through but loses nothing).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import materialize
from orograph.llm import sketch as sk
from orograph.llm.textnp import BYTE, Prefix, U, Words, buffers, chunks, mix64

#: Windows handled at once: few enough for the processor's cache.
SEGMENT = 1 << 18
#: Runs whose anchors are looked up at once.
LOOKUP = 1 << 12
#: Of the hash by which anchors are chosen: any collision there chooses alike in equal windows.
CHOICE = 0xFA88FD93
#: Rows of four longs that may be broadcast (6 MB).
MOST_BROADCAST = 200_000
ITEMS = "doc_id long, th long, k long, u long, r long, p1 long, p2 long"


@dataclass(frozen=True)
class Plan:
    """What a window is: its length and that of a gram, in bytes or words, and the block sizes of the rounds.

    ``refine``: buckets are named by the bucket before and what they gain, not by all that they hold.
    """

    unit: str
    window: int
    gram: int
    blocks: tuple[int, ...]
    refine: bool = False

    @property
    def places(self) -> int:
        return self.window - self.gram + 1


def sequence(texts: pa.Array, unit: str):
    """(values of a stretch, offsets of the documents)."""
    if unit == "byte":
        buf, offs = buffers(texts)
        return lambda s, e: BYTE[buf[s:e]], offs
    w = Words(texts)
    h = w.hashes()
    return lambda s, e: h[s:e], w.bounds


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    out, step = v, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def rolling(values: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of each gram, good enough to choose by."""
    values = values.astype(np.uint32)
    out, done, power = values, 1, CHOICE
    for bit in bin(gram)[3:]:
        more = out[: len(out) - done] * np.uint32(power)
        more += out[done:]
        out, done, power = more, 2 * done, power * power % (1 << 32)
        if bit == "1":
            out = out[:-1] * np.uint32(CHOICE) + values[done : done + len(out) - 1]
            done, power = done + 1, power * CHOICE % (1 << 32)
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x7FEB352D)
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x846CA68B)
    return out ^ (out >> np.uint32(16))


def runs(grams: np.ndarray, valid: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of valid windows with one anchor: the first of a window's least grams."""
    least = sliding_min(grams, places)[: len(valid)]
    new = np.ones(len(valid), bool)
    # the anchor moves if the least value does, or if it was the gram that the next window has left behind
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    first, last = first[valid[first]], last[valid[first]]
    inside = np.lib.stride_tricks.sliding_window_view(grams, places)
    anchor = first.copy()
    for s in range(0, len(first), LOOKUP):
        at = first[s : s + LOOKUP]
        anchor[s : s + LOOKUP] += (inside[at] == least[at, None]).argmax(1)
    return anchor, first, last


class Segment:
    """Runs of windows with one anchor in a stretch of the concatenated documents."""

    def __init__(self, values: np.ndarray, valid: np.ndarray, plan: Plan):
        self.values, self.plan = values, plan
        self.hash = Prefix(values)
        self.anchor, self.p1, self.p2 = runs(rolling(values, plan.gram), valid, plan.places)

    def gram_keys(self) -> np.ndarray:
        return self.hash.of(self.anchor, self.anchor + self.plan.gram)

    def split(self, a: np.ndarray, p1: np.ndarray, p2: np.ndarray, size: int, key: np.ndarray, near: np.ndarray, far: np.ndarray):
        """Cut stretches of windows into blocks of ``size`` places relative to the anchor; with each block's key.

        ``near``, ``far``: the places of the stretch before, whose windows have the bytes from a - near to a - far + window in common.
        A refined key is made of the key before and of the identifiers of what a block gains at later and at earlier offsets.
        """
        lo, hi = (a - p2) // size, (a - p1) // size
        n = hi - lo + 1
        of = np.repeat(np.arange(len(a)), n)
        block = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
        a, key, near_0, far_0 = a[of], key[of], near[of], far[of]
        near, far = block * size, np.minimum(block * size + size - 1, self.plan.places - 1)
        if self.plan.refine:
            later = self.hash.of(a - far_0 + self.plan.window, a - far + self.plan.window)
            earlier = self.hash.of(a - near, a - near_0)
            key = mix64(mix64(mix64(key + later) + earlier) + mix64(block + (size << 32)))
        else:
            key = mix64(self.hash.of(a - near, a - far + self.plan.window) + mix64(block + (size << 32)))
        return a, np.maximum(p1[of], a - far), np.minimum(p2[of], a - near), key, near, far

    def extents(self, a: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """A second hash, of all that the windows p1..p2 cover and where they lie."""
        if not hasattr(self, "hash_2"):
            self.hash_2 = Prefix(self.values, 1)
        return mix64(self.hash_2.of(p1, p2 + self.plan.window) + mix64((a - p1) * (1 << 20) + (a - p2)))


def segments(texts: pa.Array, plan: Plan) -> Iterator[tuple[int, np.ndarray, Segment]]:
    values, offs = sequence(texts, plan.unit)
    total = int(offs[-1])
    edge = np.zeros(total + 2, np.int8)
    size = np.diff(offs)
    begin, stop = offs[:-1][size >= plan.window], (offs[1:] - plan.window + 1)[size >= plan.window]
    np.add.at(edge, begin, 1)
    np.add.at(edge, stop, -1)
    valid = np.cumsum(edge, dtype=np.int8) > 0
    for s in range(0, max(total - plan.window + 1, 0), SEGMENT):
        ok = valid[s : min(s + SEGMENT, total - plan.window + 1)]
        if ok.any():
            yield s, offs, Segment(values(s, min(total, s + SEGMENT + plan.window - 1)), ok, plan)


def count_grams(docs: DataFrame, plan: Plan, bits: int, tasks: int) -> list[np.ndarray]:
    """The merged sketch of how often each run's gram occurs: what a window's count can't exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sk.Part(bits, 2)
        for batch in batches:
            for piece in chunks(batch):
                for _, _, seg in segments(piece.column("text"), plan):
                    part.add(seg.gram_keys())
        yield from part.batches()

    return sk.merge(docs.select("text").mapInArrow(run, sk.PARTS), bits, 2, tasks)


def open_items(docs: DataFrame, plan: Plan, level: int, filters: list) -> DataFrame:
    """Blocks of round ``level``: document, key (k), extent hash (u), own hash (r), first and last window start in the document.

    ``filters``: broadcast (sketch, bits) of the grams, then of the own hashes that each round before sends on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                own = np.zeros(piece.num_rows, U)
                for c in ("doc_id", "th"):
                    own = mix64(own + piece.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U))
                for s, offs, seg in segments(piece.column("text"), plan):
                    # the initial bucket: all windows of a run have its gram in common
                    key = seg.gram_keys()
                    yes = sk.holds(*filters[0].value, key)
                    a, p1, p2, key = (x[yes] for x in (seg.anchor, seg.p1, seg.p2, key))
                    near, far = np.zeros(len(a), np.int64), np.full(len(a), plan.places - 1)
                    for i in range(level + 1):
                        if not len(a):
                            break
                        a, p1, p2, key, near, far = seg.split(a, p1, p2, plan.blocks[i], key, near, far)
                        u = seg.extents(a, p1, p2)
                        doc = np.searchsorted(offs, p1 + s, "right") - 1
                        base = offs[doc] - s
                        r = mix64(key + mix64(u + mix64(own[doc] + (p1 - base).astype(U))))
                        if i < level:
                            yes = sk.holds(*filters[i + 1].value, r)
                            a, p1, p2, key, near, far = (x[yes] for x in (a, p1, p2, key, near, far))
                    if not len(a):
                        continue
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id").take(rows), piece.column("th").take(rows), *(pa.array(x.view(np.int64)) for x in (key, u, r)), pa.array(p1 - base), pa.array(p2 - base)],
                        names=["doc_id", "th", "k", "u", "r", "p1", "p2"],
                    )

    return docs.select("doc_id", "th", "text").mapInArrow(run, ITEMS)


def repeated(docs: DataFrame, plan: Plan, *, earlier: bool) -> DataFrame:
    """Covered stretches (doc_id, th, p1, p2 exclusive) of all repeated windows.

    A window is repeated if its content starts anywhere else, or, with ``earlier``,
    in a document of smaller doc_id. Blocks with an equal key and extent are alike:
    all but their first are settled as they are (without ``earlier`` the first too),
    and only the first goes on to the next round, where it stands for the others.
    With ``earlier`` the first one's equals in doc_id are not settled and go on too.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size / (1 if plan.unit == "byte" else 6) * 2 / (plan.places + 1)
    bits = sk.bits_for(int(expected))
    filters = [spark.sparkContext.broadcast((count_grams(docs, plan, bits, tasks), bits))]
    found = None
    for level, n in enumerate(plan.blocks):
        items = materialize(open_items(docs, plan, level, filters), f"windows-{n}")
        d = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d")
        alike = items.groupBy("k", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(d, "r")).alias("first"), F.min(F.struct(d, F.bitwise_not("r").alias("r"))).alias("last"), F.max("doc_id").alias("d2"))
        alike = alike.select("k", "u", "n", F.col("first.d").alias("d1"), "d2", F.col("first.r").alias("r"), (F.col("first.r") != F.bitwise_not("last.r")).alias("twice"))
        alike = materialize(alike, f"window-groups-{n}")
        settled = alike.filter(F.col("d1") < F.col("d2")) if earlier else alike.filter("n > 1")
        hit = items.select("doc_id", "th", "k", "u", "p1", "p2").join(settled.select("k", "u", "d1"), ["k", "u"])
        hit = (hit.filter(F.col("doc_id") > F.col("d1")) if earlier else hit).select("doc_id", "th", "p1", (F.col("p2") + plan.window).alias("p2"))
        found = hit if found is None else found.unionByName(hit)
        if level == len(plan.blocks) - 1:
            break
        left = alike.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("d1").alias("d1"), F.max("d2").alias("d2"))
        left = left.filter((F.col("m") > 1) & (F.col("d1") < F.col("d2")) if earlier else F.col("m") > 1)
        left = materialize(left.select("k", F.col("d1").alias("least")), f"window-open-{n}")
        rest = alike.select("k", "r").join(left, "k", "left_semi").select("r")
        if earlier:
            # what an earlier document of the bucket removes from the first it also removes from its equals in doc_id
            twice = alike.filter("twice").join(left, "k").filter("d1 > least").select("k", "u", F.col("d1").alias("doc_id"), F.col("r").alias("first"))
            twice = materialize(twice, f"window-twice-{n}")
            few = twice.count()
            if few:
                more = items.select("k", "u", "doc_id", "r").join(F.broadcast(twice) if few <= MOST_BROADCAST else twice, ["k", "u", "doc_id"])
                rest = rest.unionByName(more.filter("r <> first").select("r"))
        rest = materialize(rest, f"window-rest-{n}")
        count = rest.count()
        if not count:
            break
        filters.append(spark.sparkContext.broadcast(sk.of_column(rest, "r", count, tasks)))
    return found


def with_stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, th, text) with ``cut``, the stretches of each document, or null."""
    per = found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("p1", "p2")).alias("cut")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    on = docs["doc_id"].eqNullSafe(per["_d"]) & docs["th"].eqNullSafe(per["_t"])
    return docs.join(per.hint("shuffle_hash"), on, "left").select("doc_id", "text", "cut")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and th, a hash of the text that tells rows of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def cover(cut, n: int) -> np.ndarray:
    """Which of ``n`` units the stretches cover."""
    edge = np.zeros(n + 1, np.int64)
    for name, sign in (("p1", 1), ("p2", -1)):
        np.add.at(edge, cut.field(name).to_numpy(zero_copy_only=False), sign)
    return np.cumsum(edge)[:n] > 0

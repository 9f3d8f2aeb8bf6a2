"""Spelling variants by two-dimensional range reporting (operator 11).

Words are sorted by length and letters, forwards and backwards, and cut into blocks of a
bounded number of words. A word that differs from another at one place shares what is
before it (an interval of the forward order) and what is after it (an interval of the
reverse order). A block holds its words as points of both ranks in a wavelet tree and
reports the rectangle of each edit position. A position is asked where its interval lies
in one block: forwards from the depth at which the word's prefix leaves both neighbours'
first words, backwards for the places before; the few places between go to each block that
their shorter interval meets. So no block, however common its prefix, holds more words.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import materialize
from orograph.llm.wavelet import Grid, letters

#: Words of a block, and asked words of one look-up in it.
BLOCK, ASKED = 16_384, 16_384
#: A task hands on what it counted whenever it holds so many distinct words.
HELD = 400_000
#: Bytes of a text searched at once; the cut moves on to the end of a run.
SLICE = 1 << 22
LAST = "\U0010ffff"
#: À to ÿ in UTF-8 are 0xC3 and a byte from 0x80 to 0xBF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
NOT_RUN = re.compile(rb"[^a-z\x80-\xbf\xc3]")
ROUTES = "side int, block int, kind int, length int, word string, n long, first int, last int"
PARTS = "word string, n_near long, other_n long, other string"


def runs(text: bytes) -> Counter[bytes]:
    """How often each run of letters of the lower-cased text occurs, counted in slices that end between runs."""
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        gap = NOT_RUN.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = gap.start() if gap else len(text)
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def misspelt(word: bytes, h: int) -> str:
    """The word without the letter that the hash names."""
    w = word.decode()
    return w[: (k := h % len(w))] + w[k + 1 :]


def word_counts(docs: DataFrame, *, typo: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): words of ``least_length`` letters that occur ``least`` times in all.

    A run whose hash with its document's id is a multiple of ``typo`` loses a letter. Null
    texts have no words; a null doc_id counts as the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, doc in enumerate(ids):
                if not texts[i].is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in runs(texts[i].as_buffer().to_pybytes().lower()).items():
                    h = zlib.crc32(w, start)
                    word = misspelt(w, h) if h % typo == 0 else w.decode()
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def blocks(words: DataFrame, size: int) -> tuple[DataFrame, list[list[tuple[int, str]]]]:
    """(side, block, word, n) with words as each side reads them, and each side's first words by block.

    The first words are one for ``size`` words: the driver and each task hold that list.
    """
    n = max(1, -(-words.count() // size))
    sides, firsts = [], []
    for side in (0, 1):
        as_read = F.reverse("word") if side else F.col("word")
        t = words.select(as_read.alias("word"), "n", F.char_length("word").alias("length"))
        t = t.repartitionByRange(n, "length", "word").select(F.lit(side).alias("side"), F.spark_partition_id().alias("block"), "length", "word", "n")
        t = materialize(t, f"word-blocks-{side}")
        first = t.groupBy("block").agg(F.min(F.struct("length", "word")).alias("first")).orderBy("block").collect()
        names = [r.block for r in first]
        firsts.append([names, [(r.first.length, r.first.word) for r in first]])
        sides.append(t)
    return sides[0].unionByName(sides[1]), firsts


def shared(a: str, b: str) -> int:
    """How many letters two words share from the start."""
    if a == b:
        return len(a)
    n, step = 0, max(1, min(len(a), len(b)))
    while step:  # by halves, so that long words are compared at memory speed
        while a[n : n + step] == b[n : n + step] and n + step <= min(len(a), len(b)):
            n += step
        step >>= 1
    return n


def alone(first: list[tuple[int, str]], length: int, word: str) -> tuple[int, int]:
    """(block, depth): from that depth on, words of ``length`` that begin like ``word`` lie in that block alone."""
    b = max(bisect_right(first, (length, word)) - 1, 0)
    depth = 0
    for k in (b, b + 1):
        if k < len(first) and first[k][0] == length:
            depth = max(depth, shared(first[k][1], word) + 1)
    return b, depth


def spanned(first: list[tuple[int, str]], length: int, start: str) -> range:
    """The blocks that may hold words of ``length`` beginning with ``start``."""
    return range(max(bisect_left(first, (length, start)) - 1, 0), max(bisect_right(first, (length, start + LAST)), 1))


def routes(word: str, length: int, firsts: list) -> Iterator[tuple[int, int, int, int]]:
    """(side, block, first, last): which places of ``word`` are asked for words of ``length`` in which block, as that side reads them."""
    own, back = len(word), word[::-1]
    after = 1 if length == own else 0
    places = own + 1 - after
    (b0, d0), (b1, d1) = alone(firsts[0][1], length, word), alone(firsts[1][1], length, back)
    d0, d1 = min(d0, places), min(d1, places)
    if d0 < places:
        yield 0, firsts[0][0][b0], d0, places
    # place p read forwards is place places - 1 - p read backwards
    start = max(d1, places - d0)
    if start < places:
        yield 1, firsts[1][0][b1], start, places
    for p in range(max(0, places - d1), d0):
        ways = [(0, p, spanned(firsts[0][1], length, word[:p])), (1, places - 1 - p, spanned(firsts[1][1], length, back[: places - 1 - p]))]
        side, at, reach = min(ways, key=lambda w: len(w[2]))
        for b in reach:
            yield side, firsts[side][0][b], at, at + 1


def routed(words: DataFrame, firsts: list) -> DataFrame:
    """Each word with the places to ask of each block: for words of its own length, and for those one longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for length in (len(word), len(word) + 1):
                    rows += [(side, block, 1, length, word[::-1] if side else word, n, first, last) for side, block, first, last in routes(word, length, firsts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema([(k, t) for k, t in zip("side block kind length word n first last".split(), [pa.int32()] * 4 + [pa.string(), pa.int64()] + [pa.int32()] * 2)]))

    return words.select("word", "n").mapInArrow(run, ROUTES)


def best(of: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, how many, row of the best) by ``of``: the largest ``n``, ties to the least ``order``."""
    at = np.lexsort((order, -n, of))
    keys, start, many = np.unique(of[at], return_index=True, return_counts=True)
    return keys, many, at[start]


def answers(side: int, grid: Grid, n: np.ndarray, order: np.ndarray, asked: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Counts and best near words of the asked words, and of the grid's words that an insertion reached."""
    asked_words, asked_n, first, last = (list(c) for c in zip(*asked))
    length = len(asked_words[0])
    codes = letters(asked_words, length)
    row, at, found = grid.near(codes, np.array(first, np.int64), np.array(last, np.int64))
    own_n = np.array(asked_n, np.int64)
    if length < grid.length:
        # in a run of equal letters an insertion counts at the run's end, read forwards
        beside = at - 1 if side else at
        inside = (beside >= 0) & (beside < length)
        again = inside & (grid.grid[found, at] == codes[row, np.clip(beside, 0, length - 1)])
        row, found = row[~again], found[~again]
    if not len(row):
        return
    spelt = lambda words: [w[::-1] if side else w for w in words]

    def out(words: list, many: np.ndarray, other_n: np.ndarray, others: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(many.astype(np.int64)), pa.array(other_n), pa.array(others, pa.string())], names=["word", "n_near", "other_n", "other"])

    k, many, top = best(row, n[found], order[found])
    yield out(spelt([asked_words[i] for i in k]), many, n[found[top]], spelt(grid.words[found[top]]))
    if length < grid.length:
        rank = np.empty(len(asked_words), np.int64)
        rank[np.array(sorted(range(len(asked_words)), key=spelt(asked_words).__getitem__))] = np.arange(len(asked_words))
        k, many, top = best(found, own_n[row], rank[row])
        yield out(spelt(grid.words[k]), many, own_n[row[top]], spelt([asked_words[i] for i in row[top]]))


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of words with near ones: how many, and the most frequent (ties to the least), whatever its n.

    ``words`` has a row for each word, with its n. Two words are near if they differ by
    one inserted, deleted or replaced code point.
    """
    points, firsts = blocks(words, block)
    n_blocks = max(1, sum(len(f[0]) for f in firsts))
    points = points.select("side", "block", F.lit(0).alias("kind"), "length", "word", "n", F.lit(0).alias("first"), F.lit(0).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, grids, asked = None, {}, {}, {}

        def ready(length: int) -> tuple | None:
            if length not in grids and length in held:
                w, n = zip(*sorted(held.pop(length)))
                order = np.empty(len(w), np.int64)
                order[np.array(sorted(range(len(w)), key=[x[::-1] for x in w].__getitem__) if here[0] else range(len(w)))] = np.arange(len(w))
                grids[length] = (Grid(list(w)), np.array(n, np.int64), order)
            return grids.get(length)

        def settle(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            some, to = asked.pop(key), ready(key[0])
            if to:
                yield from answers(here[0], *to, some)

        for batch in batches:
            for side, b, kind, length, word, n, first, last in zip(*[c.to_pylist() for c in batch.columns]):
                if (side, b) != here:
                    for key in list(asked):
                        yield from settle(key)
                    here, held, grids, asked = (side, b), {}, {}, {}
                if kind == 0:
                    held.setdefault(length, []).append((word, n))
                    continue
                key = (length, len(word))
                asked.setdefault(key, []).append((word, n, first, last))
                if len(asked[key]) * (len(word) + 8) >= ASKED * 16:
                    yield from settle(key)
        for key in list(asked):
            yield from settle(key)

    dealt = points.unionByName(routed(words, firsts)).repartition(n_blocks, "side", "block").sortWithinPartitions("side", "block", "kind")
    parts = dealt.mapInArrow(run, PARTS)
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("top"))
    return found.select("word", "n_near", F.col("top.other").alias("form"), (-F.col("top.n")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, form) with ``root``, the last of the forms that follow one another.

    Each round doubles what a word has followed; as forms grow twofold in n, seven rounds
    reach the end of any chain.
    """
    t = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = t.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        t = materialize(t.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not t.filter("moved").limit(1).count():
            return t.drop("moved")
        t = t.drop("moved")


def variants(docs: DataFrame, *, typo: int = 97, least_length: int = 5, least: int = 3, times: int = 2, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word (see ``word_counts``).

    A word's form is the most frequent of its near words (ties to the least in code-point
    order) where that one occurs ``times`` as often, else null; its root is the last form of
    the chain, the word itself without one. Null and empty texts add nothing, repeated rows
    count each, an empty table gives no rows, further columns are ignored. Texts and words
    of any length are taken whole.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its word, or chains need not end")
    words = materialize(word_counts(docs, typo=typo, least_length=least_length, least=least), "words")
    near = materialize(near_words(words, block=block), "near-words")
    t = words.join(near, "word", "left")
    far = F.col("form_n") >= times * F.col("n")
    t = materialize(t.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")), "variants")
    roots = rooted(t.filter("form is not null"))
    return t.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

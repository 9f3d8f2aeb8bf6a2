"""Repair of conversations by lazy weighted determinisation (operator 13).

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Four states say
what has been said (nothing; a system turn; last a user; last an assistant), and each row
leaves the least cost that is still to pay from each state. Such vectors, less their least
entry, are few: each becomes a state of an automaton whose transitions by a row's kind are
found once and kept in a table. Rows are scanned from the last to the first by that table,
which gives the costs; then, back from the first to the last, each row takes the tight arc
whose edits read least. The arcs of a row are kept in the table as well.

A row travels as a byte (role and fault), 4,096 of them to a chunk, however long the
conversation; texts are read once more, in order, to write the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from orograph.functions.tables import materialize
from orograph.llm.streams import Gatherer, rows

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Rows of a chunk.
CHUNK = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = "sua"
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only turn that may be said next, besides an opening system turn.
NEXT = (USER, USER, ASSISTANT, USER)
CLOSING = ("", "II", "I", "")
SOUND, CUT, OUT = range(3)
WHITE = " \t\n\x0b\x0c\r"


class Automaton:
    """Cost vectors as states, found when they are first met."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self.arcs: dict[int, tuple[str, int]] = {}
        self.end, self.end_cost = self.state([INSERT * len(c) for c in CLOSING])

    def state(self, vector: list[int]) -> tuple[int, int]:
        """(state, what the vector has above its state's)."""
        least = min(vector)
        key = tuple(v - least for v in vector)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], least

    @staticmethod
    def options(after: tuple[int, ...], kind: int, q: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost to go, next state) of a row, edits in the order of their letters."""
        fault, role = divmod(kind, 4)
        yield "D", DELETE + after[q], q
        if fault != OUT:
            more = TRUNCATED * (fault == CUT)
            kept = KEPT.get((q, ROLES[role])) if role < 3 else None
            if kept is not None:
                yield "K", more + after[kept], kept
            yield "R", more + REROLE + after[NEXT[q]], NEXT[q]

    def costs(self, after: tuple[int, ...], kind: int) -> list[int]:
        """Costs to go before a row, turns inserted before it included; more than two in a row only come back."""
        w = [min(c for _, c, _ in self.options(after, kind, q)) for q in range(4)]
        return [min(w[q], INSERT + w[NEXT[q]], 2 * INSERT + w[NEXT[NEXT[q]]]) for q in range(4)]

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """(state before a row of this kind, cost added)."""
        key = state * 12 + kind
        if key not in self.steps:
            self.steps[key] = self.state(self.costs(self.vectors[state], kind))
        return self.steps[key]

    def arc(self, state: int, kind: int, q: int) -> tuple[str, int]:
        """(edits, next q): the tight way over a row whose letters read least, from ``q`` to the vector of ``state``."""
        key = (state * 12 + kind) * 4 + q
        if key not in self.arcs:
            after, edits, at = self.vectors[state], "", q
            v = self.costs(after, kind)
            while True:
                ways = [(e, to) for e, c, to in self.options(after, kind, at) if c == v[at]]
                if v[NEXT[at]] + INSERT == v[at]:
                    ways.append(("I", NEXT[at]))
                edit, to = min(ways)
                edits, at = edits + edit, to
                if edit != "I":
                    break
            self.arcs[key] = (edits, at)
        return self.arcs[key]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with the faults that the hash of their conversation and turn names.

    Of twenty, 0 loses the row (``gone``), 1 empties its text, 2 takes out its ``.!?``, 3
    doubles the row, 4 makes it the user's. Nulls are one space, but for a turn's place.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"))
    t = t.withColumn("_kind", F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "utf-8")) % 20)
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.withColumn("_copy", F.explode(copies)).select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"))


def keyed(conversations: DataFrame) -> DataFrame:
    """Rows with ``digest``, of role and text; their order is (conv_id, turn, digest)."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in conversations.columns else F.lit(False)
    t = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), gone.alias("gone"))
    return t.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", F.char_length("role"), "role", "text"))))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct")
CHUNKS = StructType().add("conv_id", "long").add("chunk", "long").add("turn", "long").add("digest", "binary").add("kinds", "binary")
CHUNKS = CHUNKS.add("first_initial", "string").add("last_initial", "string").add("first_turn", "long").add("last_turn", "long")
for _name in COUNTS:
    CHUNKS = CHUNKS.add(_name, "long")
SCANNED = StructType(CHUNKS.fields + StructType().add("to_go", ArrayType(LongType())).fields)
TRACED = StructType().add("conv_id", "long").add("chunk", "long").add("turn", "long").add("digest", "binary").add("edits", "string").add("cost", "long").add("first_turn", "long").add("last_turn", "long")
for _name in COUNTS:
    TRACED = TRACED.add(_name, "long")


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def chunks(t: DataFrame, most: int) -> DataFrame:
    """CHUNKS of keyed rows: a byte per row, and what is counted within a chunk."""
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "").otherwise("t")
    light = materialize(t.select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "gone"), "rows")
    first = light.filter(~F.col("gone")).groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), F.col("first.turn").alias("_t"))
    r = light.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    r = r.withColumn("later", F.col("_d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_t"))).drop("_c", "_d", "_t")
    r = r.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chunk = Gatherer(CHUNKS), TaskContext.get().partitionId() << 33
        here: object = rows
        kinds, key, initials, turns, counts, before = bytearray(), (None, b""), ["", ""], [None, None], dict.fromkeys(COUNTS, 0), None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, kinds, key, turns, counts, initials
            yield from out.add((here, chunk, *key, bytes(kinds), *initials, *turns, *counts.values()), len(kinds))
            chunk, kinds, key, initials, turns, counts = chunk + 1, bytearray(), (None, b""), ["", ""], [None, None], dict.fromkeys(COUNTS, 0)

        for conv, turn, digest, initial, fault, gone, later in rows(batches):
            if conv != here or len(kinds) == most:
                if here is not rows:
                    yield from close()
                if conv != here:
                    here, before = conv, None
            if gone:
                continue
            again, before = later or (turn, digest) == before, (turn, digest)
            if not kinds:
                key, initials[0] = (turn, digest), initial
            elif not legal(initials[1], initial):
                counts["illegal"] += 1
            initials[1] = initial
            if turn is not None and turn != turns[1]:
                turns = [turn if turns[0] is None else turns[0], turn]
                counts["distinct"] += 1
            now = "blank" if fault == "b" else "duplicate" if again else "truncated" if fault == "t" else None
            if now:
                counts[now] += 1
            kinds.append({None: SOUND, "truncated": CUT}.get(now, OUT) * 4 + (ROLES.find(initial) if initial and initial in ROLES else 3))
        if here is not rows:
            yield from close()
        yield from out.rest()

    return r.mapInArrow(run, CHUNKS)


def scanned(parts: DataFrame) -> DataFrame:
    """Chunks, each with the costs to go from its end: a conversation's are scanned from the last to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, out, here = Automaton(), Gatherer(SCANNED), rows
        state = cost = 0
        for row in rows(batches):
            if row[0] != here:
                here, state, cost = row[0], auto.end, auto.end_cost
            yield from out.add((*row, [cost + v for v in auto.vectors[state]]), len(row[4]))
            for kind in reversed(row[4]):
                state, more = auto.step(state, kind)
                cost += more
        yield from out.rest()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(run, SCANNED)


def traced(parts: DataFrame) -> DataFrame:
    """Chunks with their edits: a conversation's are traced from the first to the last, each row along its tight arc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, out, here = Automaton(), Gatherer(TRACED), rows
        held: list | None = None
        q, initial, last_turn = START, "", None

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                held[4] += CLOSING[q]
                yield from out.add(tuple(held), len(held[4]))

        for conv, chunk, turn, digest, kinds, first_initial, last_initial, first_turn, chunk_last, *counts, to_go in rows(batches):
            counts = dict(zip(COUNTS, counts))
            if conv != here:
                yield from end()
                here, q, initial, last_turn = conv, START, None, None
                opening = True
            else:
                opening = False
                if not kinds:  # rows that are gone, amid others
                    yield from out.add((conv, chunk, turn, digest, "", 0, None, None, *counts.values()))
                    continue
                yield from out.add(tuple(held), len(held[4]))
            state, cost = auto.state(to_go)
            states = []
            for kind in reversed(kinds):
                states.append(state)
                state, more = auto.step(state, kind)
                cost += more
            cost = cost + auto.vectors[state][START] if opening else 0
            edits = []
            for kind, after in zip(kinds, reversed(states)):
                some, q = auto.arc(after, kind, q)
                edits.append(some)
            if kinds:
                counts["illegal"] += initial is not None and not legal(initial, first_initial)
                initial = last_initial
            if first_turn is not None:
                counts["distinct"] -= first_turn == last_turn
                last_turn = chunk_last
            held = [conv, chunk, turn, digest, "".join(edits), cost, first_turn, chunk_last, *counts.values()]
        yield from end()
        yield from out.rest()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, TRACED)


def edits(t: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """TRACED of keyed rows: the cheapest edits by chunks of conversations, written once."""
    return materialize(traced(scanned(chunks(t, chunk))), "edits")


REPAIRED = StructType().add("conv_id", "long").add("place", "long").add("role", "string").add("text", "string").add("edit", "string")


def applied(t: DataFrame, found: DataFrame) -> DataFrame:
    """REPAIRED: keyed rows after their edits, a conversation's in order within a partition.

    A chunk's edits lie before its first row, so a task holds one chunk's at a time.
    """
    t = t.filter(~F.col("gone")).select("conv_id", "turn", "digest", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("chunk"), "role", "text")
    e = found.select("conv_id", "turn", "digest", F.lit(0).alias("kind"), "chunk", F.col("edits").alias("role"), F.lit(None).cast("string").alias("text"))
    both = t.union(e).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "kind", "chunk").select("conv_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, left, place, last = Gatherer(REPAIRED), rows, "", 0, ""

        def said(role: str, text: str, edit: str) -> Iterator[pa.RecordBatch]:
            nonlocal place, last
            yield from out.add((here, place, role, text, edit), len(text))
            place, last = place + 1, role[:1]

        def inserted() -> Iterator[pa.RecordBatch]:
            nonlocal left
            while left.startswith("I"):
                left = left[1:]
                yield from said(other(), "", "I")

        def other() -> str:
            return "assistant" if last == "u" else "user"

        for conv, kind, role, text in rows(batches):
            if conv != here:
                yield from inserted()
                here, left, place, last = conv, "", 0, ""
            if kind == 0:
                left += role
                continue
            yield from inserted()
            edit, left = left[0], left[1:]
            if edit != "D":
                yield from said(role if edit == "K" else other(), text, edit)
        yield from inserted()
        yield from out.rest()

    return both.mapInArrow(run, REPAIRED)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit of rows (conv_id, turn, role, text[, gone]) after the cheapest repair.

    Rows go by turn (nulls first), those of one turn by a digest of role and text; null
    roles and texts are one space; rows that are ``gone`` only name their conversation.
    Kept (K) costs nothing, a role made the one that is due (R) and an empty turn put in
    (I) 3, a row left out (D) 4, which blank rows and those said before must be; a row
    whose text breaks off adds 3 unless left out. Of cheapest repairs the one whose edits
    read least is taken. An empty table gives no rows; further columns are ignored.
    """
    t = keyed(conversations)
    return applied(t, edits(t))


DIGEST = StructType().add("conv_id", "long").add("repaired_sha256", "string")


def digests(rows_in_order: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines of each conversation's repaired rows, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, sha = Gatherer(DIGEST), rows, hashlib.sha256()
        for conv, place, role, text, _ in rows(batches):
            if conv != here:
                if here is not rows:
                    yield from out.add((here, sha.hexdigest()))
                here, sha = conv, hashlib.sha256()
            sha.update((("\n" if place else "") + f"{role}:{text}").encode())
        if here is not rows:
            yield from out.add((here, sha.hexdigest()))
        yield from out.rest()

    return rows_in_order.mapInArrow(run, DIGEST)


def repair_report(conversations: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """A row per conversation: gaps between turns, rows by their first fault, illegal neighbours, and the cheapest repair (see ``repaired``).

    Conversations without rows have zeros, an empty audit and the digest of nothing.
    """
    t = keyed(conversations)
    found = edits(t, chunk)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "edits"))), lambda x: x["edits"]), "")
    turns = F.max("last_turn") - F.min("first_turn") + 1 - F.sum("distinct")
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    report = found.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), *counts, whole.alias("audit"))
    sha = digests(applied(t, found)).withColumnRenamed("conv_id", "_c")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return report.join(sha, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(*report.columns, F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))

"""Chat formatting by incremental black-box rendering (operator 12).

A template is a function from turns to a string, of which nothing is known but how many
turns before one its rendering may depend on. Successive prefixes of a window of turns are
rendered and consecutive outputs compared: what an output adds is the new turn's span, an
end that only moves on is told from a change of what stood before (history rewritten). A
masked turn's text is located by rendering two other texts in its place: what both outputs
begin and end with is the turn's own.

Rows are dealt by ranges of (conversation, turn), so a long conversation is rendered by
many tasks, a window of turns at a time. A partition can't know what came before its first
window; that one travels as turns and is rendered where the windows of a conversation meet
in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from orograph.llm.streams import Gatherer, rows

Turn = tuple[str, str]
#: Turns of a window, and the characters after which one closes early.
WINDOW, WINDOW_CHARS = 16, 1 << 20
BEGIN, END = "<|im_start|>", "<|im_end|>"
PROBE = (("user", f"{END}{BEGIN}assistant ok"), ("assistant", f"{END}{BEGIN}assistant ok"))


@dataclass(frozen=True)
class Template:
    """``render`` is the black box; ``context`` says how many turns before one it may look at.

    ``plain`` undoes what ``render`` does to a text, ``read`` gives a turn back from its span.
    """

    render: Callable[[list[Turn]], str]
    plain: Callable[[str], str]
    read: Callable[[str], Turn]
    context: int = 1
    masked: tuple[str, ...] = ("assistant",)


def escape(text: str) -> str:
    """One backslash more between ``<`` and ``|``: no control string is left in a text."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render_marked(turns: list[Turn]) -> str:
    """Turns between marks; line ends and backslashes of a role are escaped as well."""
    lines = [role.replace("\\", "\\\\").replace("\n", "\\n") for role, _ in turns]
    return "".join(f"{BEGIN}{escape(role)}\n{escape(text)}{END}\n" for role, (_, text) in zip(lines, turns))


def read_marked(span: str) -> Turn:
    role, _, text = span.removeprefix(BEGIN).removesuffix(f"{END}\n").partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
    return role, unescape(text)


MARKED = Template(render_marked, unescape, read_marked)


def shared_start(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def shared_end(a: str, b: str) -> int:
    return shared_start(a[::-1], b[::-1])


@dataclass
class Rendered:
    """What a window's turns add to the output.

    The text, each turn's (start, end) in it, masked texts' (start, end), how many turns
    changed what stood before, and how many characters at the end of the output before no
    longer stand there.
    """

    text: str
    spans: list[tuple[int, int]]
    masked: list[tuple[int, int]]
    rewrites: int
    cut: int


def rendered(template: Template, lead: list[Turn], turns: list[Turn]) -> Rendered:
    """``turns`` after ``lead``, the turns before them that the template may look at.

    Where an end that moves on begins with the letters of the next turn, the span begins
    behind these.
    """
    start = before = template.render(lead) if lead else ""
    spans: list[tuple[int, int]] = []
    rewrites = moved = 0
    for k in range(len(turns)):
        after = template.render([*lead, *turns[: k + 1]])
        same = shared_start(before, after)
        if before[same:] and not after[same:].endswith(before[same:]):
            rewrites, moved = rewrites + 1, 0
        else:
            moved = len(before) - same
        if spans:
            spans[-1] = (spans[-1][0], max(spans[-1][0], min(spans[-1][1], same)))
        spans.append((same, len(after) - moved))
        before = after
    own = shared_start(start, before)
    spans = [(max(a - own, 0), max(b - own, 0)) for a, b in spans]
    masked = [located(template, [*lead, *turns[:k]], turn, span[0]) for k, (turn, span) in enumerate(zip(turns, spans)) if turn[0] in template.masked]
    return Rendered(before[own:], spans, masked, rewrites, len(start) - own)


def located(template: Template, before: list[Turn], turn: Turn, start: int) -> tuple[int, int]:
    """Where the text of a turn that starts at ``start`` lies: all but what two other texts in its place begin and end with."""
    before = before[len(before) - template.context :] if template.context < len(before) else before
    lead = template.render(before) if before else ""
    one, two, own = (template.render([*before, (turn[0], t)]) for t in ("x", "y", turn[1]))
    same = shared_start(lead, one)
    head = shared_start(one, two)
    foot = shared_end(one[head:], two[head:])
    return start + head - same, start + max(len(own) - foot, head) - same


SPANS = ArrayType(ArrayType(LongType()))
TURNS = ArrayType(ArrayType(StringType()))
FORMATTED = StructType().add("conv_id", "long").add("part", "long").add("formatted", "string").add("spans", SPANS).add("masked", SPANS).add("rewrites", "long")
WINDOWS = StructType(FORMATTED.fields + StructType().add("cut", "long").add("turns", TURNS).fields)


def windows(ordered: DataFrame, template: Template, window: int) -> DataFrame:
    """WINDOWS of rows (conv_id, role, text) that lie in order. ``turns`` holds the last turns of a window, for the next one;
    or, where ``formatted`` is null, all of the partition's first window, which is not rendered yet."""
    context = template.context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = Gatherer(WINDOWS), TaskContext.get().partitionId() << 33
        here: object = rows  # no conversation yet
        first, lead, turns, chars = True, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal part, lead, turns, chars, first
            if turns:
                if first:
                    row = (here, part, None, None, None, None, None, turns)
                else:
                    r = rendered(template, lead, turns)
                    row = (here, part, r.text, r.spans, r.masked, r.rewrites, r.cut, [*lead, *turns][-context:] if context else [])
                yield from out.add(row, chars)
                lead = [*lead, *turns][-context:] if context else []
                part, turns, chars, first = part + 1, [], 0, False

        for conv, role, text in rows(batches):
            if conv != here:
                yield from close()
                first = here is rows
                here, lead = conv, []
            turns.append((role, text))
            chars += len(text)
            if len(turns) >= window or chars >= WINDOW_CHARS and len(turns) >= context:
                yield from close()
        yield from close()
        yield from out.rest()

    return ordered.mapInArrow(run, WINDOWS)


def joined(parts: DataFrame, template: Template) -> DataFrame:
    """FORMATTED of windows that lie in order: those that were not rendered get their turns before them."""
    context = template.context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, lead, held = Gatherer(FORMATTED), rows, [], None
        for conv, part, formatted, spans, masked, rewrites, cut, turns in rows(batches):
            if conv != here:
                if held:
                    yield from out.add(held, len(held[2]))
                here, lead, held = conv, [], None
            turns = [tuple(t) for t in turns]
            if formatted is None:
                r = rendered(template, lead, turns)
                formatted, spans, masked, rewrites, cut = r.text, r.spans, r.masked, r.rewrites, r.cut
            if held:
                yield from out.add((*held[:2], held[2][: len(held[2]) - cut], *held[3:]), len(held[2]))
            held = (conv, part, formatted, spans, masked, rewrites)
            lead = [*lead, *turns][-context:] if context else []
        if held:
            yield from out.add(held, len(held[2]))
        yield from out.rest()

    return parts.mapInArrow(run, FORMATTED)


def format_conversations(conversations: DataFrame, template: Template = MARKED, *, window: int = WINDOW) -> DataFrame:
    """conv_id, part, formatted, spans, masked, rewrites: conversations as the template renders them.

    A conversation's output is its parts' ``formatted`` in the order of ``part``; ``spans``
    are [start, end) of each turn in it, ``masked`` of each text under the loss mask, in
    code points; ``rewrites`` counts turns at which the template changed what it had
    rendered before (their spans begin at the change). Rows go by turn, nulls first, then role and text; null roles
    and texts are empty, a null conv_id is a conversation of its own, repeated rows are
    turns each. An empty table gives no rows, further columns are ignored. A window
    holds ``window`` turns at most; its texts are taken whole, however long.
    """
    if window < max(1, template.context):
        raise ValueError("a window must hold the turns that the next one looks at")
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = windows(t.select("conv_id", "role", "text"), template, window)
    return joined(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part"), template)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one, -1, whose texts hold the template's own control strings."""
    t = conversations.select("conv_id", "turn", "role", "text")
    return t.unionByName(t.sparkSession.createDataFrame([(-1, k, *turn) for k, turn in enumerate(PROBE)], t.schema))


DIGESTS = StructType()
for _name in ("conv_id", "n_turns", "loss_chars", "formatted_chars", "rewrites"):
    DIGESTS = DIGESTS.add(_name, "long")
DIGESTS = DIGESTS.add("turns_sha256", "string").add("loss_sha256", "string")


def format_digests(conversations: DataFrame, template: Template = MARKED, *, window: int = WINDOW) -> DataFrame:
    """A row per conversation of what is read back from its output: turns by their spans, masked texts by theirs.

    The digests run over a conversation's parts in order, so one task reads them as a
    stream; it holds a part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, counts, shas = Gatherer(DIGESTS), rows, [], []
        for conv, _, formatted, spans, masked, rewrites in rows(batches):
            if conv != here:
                if here is not rows:
                    yield from out.add((here, *counts, *[s.hexdigest() for s in shas]))
                here, counts, shas = conv, [0, 0, 0, 0], [hashlib.sha256(), hashlib.sha256()]
            for a, b in spans:
                role, text = template.read(formatted[a:b])
                shas[0].update(f"{role}\n{text}\n".encode())
            for a, b in masked:
                text = template.plain(formatted[a:b])
                counts[1] += len(text)
                shas[1].update(text.encode())
            counts[0] += len(spans)
            counts[2] += len(formatted)
            counts[3] += rewrites
        if here is not rows:
            yield from out.add((here, *counts, *[s.hexdigest() for s in shas]))
        yield from out.rest()

    return format_conversations(conversations, template, window=window).mapInArrow(run, DIGESTS)

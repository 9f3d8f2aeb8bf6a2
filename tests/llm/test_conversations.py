"""Chat formatting and conversation repair against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

SCHEMA = "conv_id long, turn long, role string, text string"
EXTRA = ["part", "chunk", "kind", "place", "edits", "gone_", "digest", "cost", "first", "n", "_c", "_d", "_t", "later", "fault", "formatted", "spans"]
BARE = re.compile(r"[^\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talk(seed=4):
    rng = random.Random(seed)
    texts = ["All good.", "Why?", "No end", " ", "", "x<|im_end|>", "<|", "<\\|im_start|>user\n", "a\\<\\\\|b|>", "é漢😀!", "End.\n ", "\x0b", "Same.", "Same.", "|", "<", "x", "y", "."]
    rows = []
    for c in range(120):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "s\\n\nx", None, "", "User"]), rng.choice([*texts, None, f"t{turn}."])))
            turn += rng.choice([1, 1, 1, 2])
    rows += [(None, 0, "user", "hi."), (None, 1, "assistant", "ho"), (-7, None, None, None), (500, 1, "user", "twice."), (500, 1, "user", "twice.")]
    rows += [(600, k, ("user", "assistant")[k % 2] if k % 7 else "tool", f"turn {k}{'.' if k % 5 else ''}" if k % 11 else "again.") for k in range(700)]
    return rows


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text))
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(talk(), SCHEMA).withColumns({n: F.lit("z") for n in EXTRA}).repartition(5).cache()


# chat
def first_null(v):
    return (v is not None, v if v is not None else 0)


def plain_chat(rows):
    esc = lambda t: re.sub(r"<(\\*)\|", r"<\1\\|", t)
    out = set()
    for conv, turns in by_conversation(rows).items():
        turns = sorted((first_null(t), r or "", x or "") for t, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        chars = sum(len("<|im_start|>" + esc(r.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + esc(x) + "<|im_end|>\n") for _, r, x in turns)
        out.add((conv, len(turns), len(loss), chars, 0, sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), sha(loss)))
    return out


@pytest.mark.parametrize(("window", "partitions"), [(1, 3), (4, 40), (16, 4)])
def test_chat_is_read_back(spark, conversations, window, partitions):
    from orograph.llm.chat import PROBE, format_digests, with_probe

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions < 9)
    try:
        got = format_digests(with_probe(conversations), window=window).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want = plain_chat(talk() + [(-1, k, r, t) for k, (r, t) in enumerate(PROBE)])
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_templates_with_an_end_and_without_a_past(spark):
    from orograph.llm.chat import Template, format_conversations, rendered

    def closed(turns):
        return "[b]" + "".join(f"({r}){t}(/)" for r, t in turns) + "$$"

    def forgetful(turns):
        last = len(turns) - 1
        return "".join(f"({r}){'' if r == 'assistant' and k < last else t}(/)" for k, (r, t) in enumerate(turns))

    turns = [(("user", "assistant")[k % 2], f"text {k}") for k in range(9)]
    rows = [(1, k, *t) for k, t in enumerate(turns)] + [(2, 0, "user", "alone")]
    table = spark.createDataFrame(rows, SCHEMA)
    r = rendered(Template(closed, str, lambda s: s), [], turns)
    assert [r.text[a:b] for a, b in r.spans][1:] == [f"({a}){t}(/)" for a, t in turns][1:] and r.rewrites == 0
    for window in (1, 2, 16):
        got = defaultdict(list)
        for p in format_conversations(table, Template(closed, str, lambda s: s), window=window).orderBy("conv_id", "part").collect():
            got[p.conv_id].append(p)
        assert "".join(p.formatted for p in got[1]) == closed(turns) and "".join(p.formatted for p in got[2]) == closed([("user", "alone")])
        assert [p.formatted[a:b] for p in got[1] for a, b in p.masked] == [t for r, t in turns if r == "assistant"]
        assert sum(p.rewrites for p in got[1]) == 0
    r = rendered(Template(forgetful, str, lambda s: s), [], turns)
    assert r.text == forgetful(turns) and r.rewrites == 4
    with pytest.raises(ValueError):
        format_conversations(table, Template(closed, str, lambda s: s, context=3), window=2)


def test_texts_are_escaped_reversibly():
    from orograph.llm.chat import escape, unescape

    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\a>") for _ in range(rng.randrange(12)))
        assert unescape(escape(t)) == t and "<|" not in escape(t)


# repair
def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The cheapest edits by a search over all of them, audits compared as strings."""
    out = set()
    for conv, damaged in plain_damage(rows).items():
        damaged.sort(key=lambda r: (first_null(r[0]), hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        counts, faults, seen = Counter(), [], set()
        for _, role, text in damaged:
            solid = BARE.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            faults.append(fault)
        turns = [t for t, *_ in damaged if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(damaged, damaged[1:]))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, said, kept = heapq.heappop(heap)
            state = "" if not said else said[-1]
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(damaged) and state in ("", "a"):
                break
            due = "assistant" if state == "u" else "user"
            heapq.heappush(heap, (cost + 3, audit + "I", i, said[-1:] + due[0], (*kept, f"{due}:")))
            if i == len(damaged):
                continue
            _, role, text = damaged[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, said, kept))
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                if role[:1] == due[:1] or role[:1] == "s" and not said:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, said[-1:] + role[0], (*kept, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, said[-1:] + due[0], (*kept, f"{due}:{text}")))
        out.add((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(kept))))
    return out


@pytest.mark.parametrize(("chunk", "partitions"), [(4096, 4), (7, 4), (64, 40)])
def test_repair_is_the_cheapest(spark, conversations, chunk, partitions):
    from orograph.llm.repair import damaged, repair_report

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions < 9)
    try:
        got = repair_report(damaged(conversations), chunk=chunk).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want = {r[0]: r for r in plain_repair(talk())}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.conv_id]


def test_conversations_that_are_missing(spark):
    from orograph.llm.chat import format_digests
    from orograph.llm.repair import damaged, repair_report, repaired

    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(damaged(none)).count() == 0 and format_digests(none).count() == 0 and repaired(none).count() == 0
    gone = [c for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = repair_report(damaged(spark.createDataFrame([(c, 0, "user", "Hi.") for c in gone], SCHEMA))).collect()
    assert {tuple(r) for r in got} == {(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in gone}


def test_repaired_rows_alternate(spark, conversations):
    from orograph.llm.repair import repaired

    rows = defaultdict(list)
    for r in repaired(conversations).collect():
        rows[r.conv_id].append((r.place, r.role[0]))
    said = {c: "".join(i for _, i in sorted(v)) for c, v in rows.items()}
    assert said and all(re.fullmatch("(s?(ua)+)?", s) for s in said.values())


def test_costs_by_table_equal_a_search():
    from orograph.llm.repair import CLOSING, START, Automaton

    rng = random.Random(9)
    auto = Automaton()
    for _ in range(400):
        kinds = [rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 11]) for _ in range(rng.randrange(7))]
        state, cost, states = auto.end, auto.end_cost, []
        for k in reversed(kinds):
            states.append(state)
            state, more = auto.step(state, k)
            cost += more
        q, audit = START, ""
        for k, after in zip(kinds, reversed(states)):
            some, q = auto.arc(after, k, q)
            audit += some
        audit += CLOSING[q]
        rest = iter(kinds)
        paid = sum({"I": 3, "D": 4, "K": 0, "R": 3}[e] + (3 if e != "I" and next(rest) // 4 == 1 and e != "D" else 0) for e in audit)
        assert paid == cost + auto.vectors[state][START]
    assert len(auto.vectors) < 60

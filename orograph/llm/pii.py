"""Personal data in texts by weak supervision, with DataFrame functions only (operator 4).

Base spans (email, ip, card, phone) come from their patterns and always stay. Wider
patterns give candidates of further kinds (addresses with a spelled-out at sign,
phones without country code, social security numbers, credentials, access keys).
Five labelers - strict shape, gazetteer, cue words near by, isolation, variety of
characters - vote yes, no or nothing on every span. Expectation-maximisation over
the counts of vote patterns estimates what each labeler's votes are worth, and a
logistic classifier of shape and votes, trained on the estimated labels, decides
about the candidates.

Only counts by kind, votes and feature bins reach the driver: at most as many rows
as there are such combinations, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions.tables import materialize
from orograph.llm.mixing import with_text

MARK, OTHER = "\x01", "\x02"
BASE = ["email", "ip", "card", "phone"]
ADDED = ["at_email", "local_phone", "ssn", "credential", "access_key"]
KINDS = BASE + ADDED
#: Each pattern finds what the plain one finds, in time linear in the text: runs are
#: taken whole (++), and a match starts at a run's first character or where the last ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "at_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    "credential": r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|Password|Token|Secret)[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.-]{6,128}+[\"']?",
    "local_phone": r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "access_key": r"(?<![A-Za-z0-9])(?=[A-Z]{0,39}[0-9])(?=[0-9]{0,39}[A-Z])[A-Z0-9]{16,40}+(?![A-Za-z0-9])",
}
NEAR = 32
CUES = {
    "email": r"(?i)mail|contact|write|@", "at_email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|server|host|address|login", "card": r"(?i)card|visa|pay|account|credit",
    "phone": r"(?i)phone|call|tel\b|mobile|fax|contact", "local_phone": r"(?i)phone|call|tel\b|mobile|fax|contact", "ssn": r"(?i)ssn|social|security|tax", "credential": r"(?i)user|login|config|auth|env", "access_key": r"(?i)aws|key|secret|access|token",
}
AGAINST = r"(?i)version|release|chapter|figure|isbn|section|page\b|licen[sc]e|example|order|serial"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|us|ca)$", "at_email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$", "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", "local_phone": r"^\(?[2-9][0-9]{2}", "ssn": r"^(?!000|666|9)", "credential": r"(?i)^(?:password|passwd|pwd|secret|token|api)", "access_key": r"^(?:AKIA|ASIA|AIDA|AROA|AIZA)",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$", "at_email": r"^[A-Za-z0-9].*[A-Za-z]{2,}$", "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$", "card": r"^[0-9]{4}([\x20-]?)[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,5}){1,4}$", "local_phone": r"^(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[.-][0-9]{4}$", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "credential": r"[=:]\x20?[\"']?(?=[A-Za-z]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_.-]{8,}", "access_key": r"^(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,40}$",
}
LABELERS = ["strict", "gazetteer", "cue", "alone", "variety"]
NO, YES, NONE = 0, 1, 2
BINS = {"length": 6, "digits": 5}
FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def pieces(text: Column, pattern: str) -> Column:
    """The text split so that every second piece is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(xs: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running folds of an array by an associative ``join`` (its second argument may be null), in as many passes as its length has binary digits."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(xs))).cast("int") - 1), lambda j: F.pow(F.lit(2.0), j).cast("int"))
    whole = F.aggregate(steps, xs, lambda acc, step: F.transform(acc, lambda x, i: join(x, F.get(acc, i - step))))
    return F.when(F.size(xs) > 1, whole).otherwise(xs)


def located(parts: Column) -> Column:
    """Start, end (code points) and text of every second piece, and what stands right before and after it."""
    empty = F.array().cast(FOUND)
    ends = running(F.transform(parts, F.length), lambda x, y: x + F.coalesce(y, F.lit(0)))
    piece = lambda i: F.coalesce(F.get(parts, i), F.lit(""))

    def one(at: Column, i: Column) -> Column:
        before, after = F.concat(piece(i - 2), piece(i - 1)), F.concat(piece(i + 1), piece(i + 2))
        return F.struct(F.get(at, i - 1).alias("start"), F.get(at, i).alias("end"), piece(i).alias("match"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    found = bound(ends, lambda at: F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: one(at, i)))
    return F.when(F.size(parts) > 1, found).otherwise(empty)


def n_digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def luhn(s: Column) -> Column:
    d = F.reverse(F.regexp_replace(s, "[^0-9]", ""))

    def add(total, i):
        x = F.substring(d, i, 1).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def octet(p: Column) -> Column:
    bare = F.regexp_replace(p, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x["match"], r"\."), octet),
    "card": lambda x: n_digits(x["match"]).between(13, 19) & luhn(x["match"]),
    "phone": lambda x: n_digits(x["match"]).between(9, 15),
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "at_email": None, "credential": None}


def votes(x: Column, kind: str) -> list[Column]:
    """What each labeler says about a span: NO, YES or NONE."""
    m = x["match"]
    around = F.concat(x["before"], F.lit(" "), x["after"])
    left, right = F.right(x["before"], F.lit(1)), F.left(x["after"], F.lit(1))
    kinds = F.size(F.array_distinct(F.split(F.regexp_replace(m, r"[^A-Za-z0-9]", ""), "")))
    return [
        F.when(m.rlike(STRICT[kind]), YES).otherwise(NO),
        F.when(m.rlike(GAZETTEER[kind]), YES).otherwise(NO if kind in ("ip", "ssn") else NONE),
        F.when(around.rlike(CUES[kind]), YES).when(around.rlike(AGAINST), NO).otherwise(NONE),
        F.when((left.rlike(r"^[\p{L}\p{N}_]$")) | (right.rlike(r"^[\p{L}\p{N}_]$")), NO).otherwise(YES),
        F.when(kinds <= 3, NO).when(kinds >= 6, YES).otherwise(NONE),
    ]


def described(found: Column, kind: str) -> Column:
    """Spans as (kind, start, end, votes, length bin, digit bin); the matched text is left behind."""

    def one(x):
        n = F.greatest(F.length(x["match"]), F.lit(1))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*votes(x, kind)).alias("votes"),
            F.least(F.floor(n / 8).cast("int"), F.lit(BINS["length"] - 1)).alias("length"), F.least(F.floor(n_digits(x["match"]) * BINS["digits"] / n).cast("int"), F.lit(BINS["digits"] - 1)).alias("digits"),
        )

    return F.transform(found, one)


SPANS = "array<struct<kind:int,start:int,end:int,votes:array<int>,length:int,digits:int>>"


def clear_of(wide: Column, base: Column) -> Column:
    """The spans of ``wide`` that overlap none of ``base``: in the order of all starts, no base span before reaches in and none after starts within."""
    tag = lambda spans, mine: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(mine).alias("mine"), x.alias("x")))
    later = lambda xs: F.reverse(running(F.reverse(xs), F.least))

    def keep(every: Column) -> Column:
        reach = running(F.transform(every, lambda e: F.when(~e["mine"], e["x"]["end"]).otherwise(-1)), F.greatest)
        begin = later(F.transform(every, lambda e: F.when(~e["mine"], e["start"]).otherwise(2**31 - 1)))
        both = F.struct(reach.alias("reach"), begin.alias("begin"))
        ok = lambda s: lambda e, i: F.struct((e["mine"] & (F.get(s["reach"], i) <= e["start"]) & (F.get(s["begin"], i) >= e["x"]["end"])).alias("ok"), e["x"].alias("x"))
        marked = bound(both, lambda s: F.transform(every, ok(s)))
        return F.transform(F.filter(marked, lambda e: e["ok"]), lambda e: e["x"])

    return bound(F.array_sort(F.concat(tag(wide, True), tag(base, False))), keep)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_wide``: the base spans that hold, and the candidates clear of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.withColumn("_text", F.when(F.instr(text, MARK) > 0, F.translate(text, MARK, OTHER)).otherwise(text))
    patterns = PATTERNS | WIDE
    ready = {k: F.instr("_text", NEEDS[k]) > 0 if NEEDS.get(k) else F.lit(True) for k in patterns}
    ready |= {"at_email": F.col("_text").rlike(r"[\[(](?:at|AT|@)[\])]"), "credential": F.col("_text").rlike("[=:]")}
    t = t.withColumns({f"_p_{k}": F.when(ready[k], pieces(F.col("_text"), p)) for k, p in patterns.items()})
    t = t.withColumns({f"_f_{k}": located(F.col(f"_p_{k}")) for k in patterns})
    valid = {k: F.filter(F.col(f"_f_{k}"), VALID[k]) for k in BASE}
    t = t.withColumns({f"_f_{k}": valid[k] for k in BASE})
    t = t.withColumn("_base", F.concat(*[F.when(F.size(f"_f_{k}") > 0, described(F.col(f"_f_{k}"), k)).otherwise(F.array().cast(SPANS)) for k in BASE]))
    wide = F.concat(*[F.when(F.size(f"_f_{k}") > 0, described(F.col(f"_f_{k}"), k)).otherwise(F.array().cast(SPANS)) for k in ADDED])
    t = t.withColumn("_wide", wide)
    t = t.withColumn("_wide", F.when((F.size("_wide") > 0) & (F.size("_base") > 0), clear_of(F.col("_wide"), F.col("_base"))).otherwise(F.col("_wide")))
    return t.drop("_text", *[f"_{a}_{k}" for a in "pf" for k in patterns])


def counts(spanned: DataFrame) -> list[tuple]:
    """(kind, votes, length bin, digit bin, spans) of all spans."""
    one = spanned.select(F.explode(F.concat("_base", "_wide")).alias("s"))
    rows = one.groupBy(F.col("s.kind").alias("kind"), F.array_join("s.votes", "").alias("votes"), F.col("s.length").alias("length"), F.col("s.digits").alias("digits")).count()
    return sorted((r["kind"], tuple(map(int, r["votes"])), r["length"], r["digits"], r["count"]) for r in rows.collect())


def reliabilities(rows: list[tuple], rounds: int = 40) -> tuple[dict, list, dict]:
    """Expectation-maximisation over vote patterns: prior of each kind, P(vote | truth) of each labeler, posterior of each (kind, votes).

    It starts from the majority of the votes; a vote's chance is smoothed by one
    span, so no labeler is taken for infallible.
    """
    total: dict = {}
    for kind, v, _, _, n in rows:
        total[kind, v] = total.get((kind, v), 0) + n
    post = {k: min(0.95, max(0.05, (sum(x == YES for x in k[1]) + 0.5) / (sum(x != NONE for x in k[1]) + 1))) for k in total}
    prior: dict = {}
    chance: list = []
    for _ in range(rounds):
        prior = {kind: (1 + sum(n * post[k] for k, n in total.items() if k[0] == kind)) / (2 + sum(n for k, n in total.items() if k[0] == kind)) for kind in {k[0] for k in total}}
        chance = []
        for j in range(len(LABELERS)):
            table = []
            for truth in (0, 1):
                mass = [1.0, 1.0, 1.0]
                mass[truth] += 1
                for k, n in total.items():
                    mass[k[1][j]] += n * (post[k] if truth else 1 - post[k])
                table.append([m / sum(mass) for m in mass])
            chance.append(table)
        for k in post:
            odds = math.log(prior[k[0]] / (1 - prior[k[0]])) + sum(math.log(chance[j][1][x] / chance[j][0][x]) for j, x in enumerate(k[1]))
            post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, chance, post


def features(kind: int, v: tuple, length: int, digits: int) -> list[int]:
    """Places of the ones in a span's feature vector."""
    at = [kind]
    base = len(KINDS)
    for j, x in enumerate(v):
        at.append(base + 3 * j + x)
    base += 3 * len(v)
    return [*at, base + length, base + BINS["length"] + digits]


def train(rows: list[tuple], post: dict, *, rounds: int = 300, rate: float = 1.0, shrink: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier of the features, fitted to the posteriors by gradient steps over all counts."""
    size = len(KINDS) + 3 * len(LABELERS) + sum(BINS.values())
    weights = [0.0] * size
    data = [(features(*r[:4]), post[r[0], r[1]], r[4]) for r in rows]
    total = sum(n for *_, n in data) or 1
    for _ in range(rounds):
        grad = [shrink * w for w in weights]
        for at, y, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in at)))))
            for i in at:
                grad[i] += n / total * (p - y)
        weights = [w - rate * g for w, g in zip(weights, grad, strict=True)]
    return weights


def accepted(weights: list[float]) -> Column:
    """The candidates that the classifier takes."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    base = len(KINDS)
    bins = base + 3 * len(LABELERS)

    def score(x):
        total = F.element_at(table, x["kind"] + 1)
        for j in range(len(LABELERS)):
            total = total + F.element_at(table, x["votes"][j] + (base + 3 * j + 1))
        return total + F.element_at(table, x["length"] + (bins + 1)) + F.element_at(table, x["digits"] + (bins + BINS["length"] + 1))

    return F.filter("_wide", lambda x: score(x) > 0)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"], x["start"], x["end"]))), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, digest of base spans, all spans, and the number of added ones.

    Null and empty texts have no spans; a text of any length is read whole; equal rows
    get equal spans; of spans of one kind the leftmost stands, an added span gives way to a base one; an empty table
    gives no rows (and nothing to train on); further columns are ignored. A text
    that holds the mark character (U+0001) is read as if it held U+0002, which no
    pattern matches either.
    """
    spanned = materialize(with_spans(docs.select("doc_id", "text")).drop("text"), "pii")
    rows = counts(spanned)
    _, _, post = reliabilities(rows)
    t = spanned.withColumn("_added", accepted(train(rows, post)))
    n = [F.size(F.filter(F.transform("_base", lambda x: x["kind"]), F.lit(i).__eq__)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return t.select("doc_id", *n, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.concat("_base", "_added")).alias("spans"), F.size("_added").cast("long").alias("n_added"))


#: Characters of a piece in which a text is cut up to replace spans.
PIECE = 256


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of ``spans`` (start, end, kind; sorted) replaced by its kind in brackets, but for those that start before one's end.

    The text is cut into short pieces once, so that a stretch costs its own length.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    before = running(F.transform(spans, lambda x: x["end"]), F.greatest)

    def put(s: Column) -> Column:
        def stretch(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            some = F.array_join(F.slice(s["pieces"], first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(b > a, F.substr(some, a % PIECE + 1, b - a)).otherwise("")

        def one(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(s["before"], i - 1), F.lit(0))
            return F.when(x["start"] >= at, F.concat(stretch(at, x["start"]), F.element_at(names, x["kind"] + 1))).otherwise("")

        rest = stretch(F.coalesce(F.try_element_at(s["before"], F.lit(-1)), F.lit(0)), F.length(text))
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    return bound(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), before.alias("before")), put)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars follows, all other columns are carried as they are.

    Texts without spans, empty and null ones stay as they are; a text of any length is
    read whole; of spans that overlap the one that starts first is replaced; equal rows
    get equal texts; an empty table gives no rows. Rows are written once beside their
    spans, so each text is searched once.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "text")
    spanned = materialize(with_spans(rows).drop("text"), "pii-rows")
    found = counts(spanned)
    _, _, post = reliabilities(found)
    t = spanned.withColumn("_spans", F.array_sort(F.transform(F.concat("_base", accepted(train(found, post))), lambda x: F.struct(x["start"], x["end"], x["kind"]))))
    clean = replaced(F.col("_row.text"), F.col("_spans"))
    return t.withColumn("_row", F.when(F.size("_spans") > 0, with_text(F.col("_row"), clean, docs.columns)).otherwise(F.col("_row"))).select("_row.*")

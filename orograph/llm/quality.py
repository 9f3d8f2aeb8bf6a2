"""Quality rules from tokeniser fertility (operator 8).

A public SentencePiece vocabulary splits every distinct word of a batch once;
per document that gives characters per token, the share of byte-fallback tokens and
the entropy of its tokens. Bands come from the corpus: quartiles of every document's
values per language (per script where no language is given) and length class, widened
by a multiple of their distance. A document outside a band is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions.ranks import quantiles
from orograph.functions.tables import materialize
from orograph.llm.textnp import Words, chunks, distinct, distinct_stretches, sums

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
BYTE_IDS = (3, 259)
LEAST_WORDS = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens"]
MEASURES = ["chars_per_token", "byte_share", "entropy"]
#: The least distance of quartiles that bands are built from.
FLOORS = {"chars_per_token": 0.01, "byte_share": 0.01, "entropy": 0.005}
SCHEMA = "".join(f"{c} long, " for c in COUNTS) + "entropy double, script string"
#: The script that a UTF-8 lead byte mostly begins, as (first, last, name).
LEADS = [(0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xCA, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"), (0xD6, 0xD7, "hebrew"), (0xD8, 0xDB, "arabic"), (0xE0, 0xE1, "indic"), (0xE3, 0xE3, "kana"), (0xE4, 0xE9, "han"), (0xEA, 0xED, "hangul")]
SCRIPTS = ["none", *dict.fromkeys(x[2] for x in LEADS)]
LEAD = np.zeros(256, np.int64)
for _a, _b, _s in LEADS:
    LEAD[_a : _b + 1] = SCRIPTS.index(_s)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def repeated_within(keys: np.ndarray) -> np.ndarray:
    _, codes = distinct(keys)
    return np.bincount(codes, minlength=1)[codes] > 1 if len(codes) else np.zeros(0, bool)


def measure(texts: pa.Array, sp) -> dict:
    """The columns of SCHEMA for a batch of texts."""
    w = Words(texts)
    n, doc = np.diff(w.bounds), w.doc
    out = {"n_words": n, "word_chars": sums(w.chars(), w.bounds), "n_symbols": sums(SYMBOLS[w.buf], w.offs)}

    cut = np.flatnonzero(w.buf == 0x0A)
    first = np.union1d(w.offs[:-1], cut + 1)
    first = first[first < len(w.buf)]
    last = np.append(first[1:], len(w.buf)) if len(first) else first
    owner = np.searchsorted(w.offs, first, "right") - 1
    full = np.searchsorted(w.start, last) > np.searchsorted(w.start, first)
    # a last line may lack the line feed: lines are compared without it
    bare = w.buf != 0x0A
    edge = np.concatenate([[0], np.cumsum(bare)])
    _, line = distinct_stretches(w.buf[bare], edge[np.append(first, len(w.buf))] if len(first) else first)
    line = (line * w.n_docs + owner)[full]
    again = np.ones(len(line), bool)
    again[distinct(line)[0]] = False
    out["n_dup_lines"] = np.bincount(owner[full], again, minlength=w.n_docs).astype(np.int64)

    place, code = w.codes()
    covered = np.zeros(len(code), bool)
    if len(code) > 2:
        same = doc[2:] == doc[:-2]
        _, two = distinct(code[:-1] * len(place) + code[1:])
        _, three = distinct(two[:-1] * len(place) + code[2:])
        twice = np.zeros(len(three), bool)
        twice[same] = repeated_within((three * w.n_docs + doc[:-2])[same])
        for k in range(3):
            covered[k : len(code) - 2 + k] |= twice
    out["n_repeat_words"] = sums(covered.astype(np.int64), w.bounds)

    ids = sp.encode([w.text(i).decode("utf-8", "replace") for i in place]) if len(place) else []
    size = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter((t for x in ids for t in x), np.int64, int(size.sum()))
    begin = np.concatenate([[0], np.cumsum(size)])
    fallback = sums(((flat >= BYTE_IDS[0]) & (flat < BYTE_IDS[1])).astype(np.int64), begin)
    each = size[code] if len(code) else np.zeros(0, np.int64)
    out["n_tokens"] = sums(each, w.bounds)
    out["n_byte_tokens"] = sums(fallback[code] if len(code) else each, w.bounds)
    until = np.cumsum(each)
    token = flat[np.arange(until[-1] if len(until) else 0) - np.repeat(until - each - begin[code], each)] if len(code) else flat
    key = np.sort(np.repeat(doc, each) * len(sp) + token)
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(key)))
    total = np.bincount(key[edge] // len(sp), count * np.log2(count), minlength=w.n_docs)
    tokens = np.maximum(out["n_tokens"], 1)
    out["entropy"] = np.where(out["n_tokens"] > 1, (np.log2(tokens) - total / tokens) / np.log2(np.maximum(tokens, 2)), 0.0)

    score = np.zeros((len(SCRIPTS), w.n_docs), np.int64)
    kind = LEAD[w.buf]
    for k in range(1, len(SCRIPTS)):
        score[k] = sums((kind == k).astype(np.int64), w.offs)
    out["script"] = [SCRIPTS[k] for k in score.argmax(0)]
    return out


def fertility(docs: DataFrame, vocabulary: str = VOCABULARY, inside: str | None = None) -> DataFrame:
    """``docs`` with the columns of SCHEMA added, chars_per_token and byte_share (columns of those names are replaced).

    ``inside``: the struct that holds the text, where it is not a column of its own.
    """
    model = read_model(vocabulary)
    base = docs.drop(*COUNTS, *MEASURES, "script")
    names = [*COUNTS, "entropy", "script"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        text = (lambda b: b.column(inside).field("text")) if inside else (lambda b: b.column("text"))
        for batch in batches:
            for part in chunks(batch, texts=text(batch)):
                found = measure(text(part), sp)
                extra = [pa.array(found[c], pa.string() if c == "script" else pa.float64() if c == "entropy" else pa.int64()) for c in names]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    out = base.mapInArrow(run, f"{fields}, {SCHEMA}")
    some = F.greatest("n_tokens", F.lit(1))
    return out.withColumn("chars_per_token", F.col("word_chars") / some).withColumn("byte_share", F.col("n_byte_tokens") / some)


def with_group(measured: DataFrame) -> DataFrame:
    lang = F.lower(F.trim("lang")) if "lang" in measured.columns else F.lit(None).cast("string")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("length_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double"))).cast("int"))
    return measured.withColumn("band", F.when(F.length(lang) > 0, lang).otherwise(F.concat(F.lit("script:"), F.col("script")))).withColumn("base_failed", base)


def learn_bands(measured: DataFrame, *, reach: float = 2.5, least_docs: int = 100, wide: float = 4.0, noise: float = 1.0) -> DataFrame:
    """One row per band (language or script) and length class (the power of two of a document's tokens): the limits of each measure.

    Limits are the exact quartiles over all documents of the cell that pass the base rules,
    moved out by ``reach`` times their distance (``FLOORS`` at the least). Chance moves
    short texts further than long ones, hence the length classes. A cell of under
    ``least_docs`` documents takes its band's limits over all lengths, moved out by
    ``wide`` distances and by ``noise`` times the median over the root of the shortest length's words.
    """
    good = measured.filter("not base_failed")
    quartiles = (0.25, 0.5, 0.75)
    cells = quantiles(good, ["band", "length_class"], beside=[F.count(F.lit(1)).alias("n")], **{m: (m, *quartiles) for m in MEASURES})
    whole = quantiles(good, ["band"], **{f"all_{m}": (m, *quartiles) for m in MEASURES})
    t, out = cells.join(whole, "band"), ["band", "length_class", "n"]
    for m in MEASURES:
        own = F.col("n") >= least_docs
        q = F.when(own, F.col(m)).otherwise(F.col(f"all_{m}"))
        room = F.when(own, F.lit(reach)).otherwise(F.lit(wide)) * F.greatest(q[2] - q[0], F.lit(FLOORS[m]))
        room = room + F.when(own, F.lit(0.0)).otherwise(F.lit(noise) * F.greatest(F.abs(q[1]), F.lit(0.5)) / F.sqrt(F.greatest(F.pow(F.lit(2.0), "length_class") / 4, F.lit(1.0))))
        out += [(q[0] - room).alias(f"low_{m}"), (q[2] + room).alias(f"high_{m}")]
    return t.select(*out)


def judge(measured: DataFrame, bands: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """Add ``rejected_by`` (the measures outside their bands, or null) and ``kept``: the base rules pass and none is.

    The bands (a row per language and power of two) are broadcast if they are few,
    else joined by a shuffle.
    """
    b = F.broadcast(bands) if bands.count() <= most_broadcast else bands
    by = F.concat_ws(",", *[F.when((F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}")), F.lit(m)) for m in MEASURES])
    by = F.when(by != "", by)
    t = measured.join(b, ["band", "length_class"], "left").withColumn("rejected_by", by)
    return t.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def quality(docs: DataFrame, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """A row per document with its counts, measures and verdict.

    Null and empty texts have no words and fail the base rules; a text of any length
    is measured whole, by the task that holds it; equal rows get equal verdicts, and a
    value on a limit is inside; an empty table gives no rows; further columns are ignored.
    """
    columns = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    measured = materialize(with_group(fertility(docs.select(*columns), vocabulary)).drop("text"), "quality")
    bands = materialize(learn_bands(measured, **options), "quality-bands")
    return judge(measured, bands).select("doc_id", *COUNTS[:5], "base_failed", "kept", *MEASURES, "band", "rejected_by")


def good_documents(docs: DataFrame, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names.

    Rows are written once beside their measures, so texts are measured once and never
    shuffled. Null, empty and long texts, equal rows and an empty table are as in ``quality``.
    """
    columns = [c for c in docs.columns if c == "lang"]
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), *columns)
    measured = materialize(with_group(fertility(own, vocabulary, inside="_row")), "quality-rows")
    bands = materialize(learn_bands(measured, **options), "quality-bands")
    return judge(measured, bands).filter("kept").select("_row.*")

"""Mixing sources to target weights (operator 7).

Every row gets a hash-random key. The keys are uniform, so equal key ranges are
equal shares of a source: sums per (source, key range) are pre-aggregated, their
running totals per source are the distributed prefix sums, and only the one range
that holds a source's cut is divided further, down to a single key. What comes out is a table of one
row per source; a row's share of the mix follows from its own key alone, so texts
are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from orograph.functions.tables import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a key, and of each step by which a cut is closed in on: a source has 2**15 ranges a step.
KEY_BITS, RANGE_BITS = 60, 15
#: Sources (rows of a plan) that may be broadcast.
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """60 random bits of the id; rows without id share one key."""
    tag = F.concat(F.lit(f"mix{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")))
    return F.conv(F.substring(F.md5(tag.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sums: DataFrame, weights: tuple[int, ...], ratio: float, cap: float) -> DataFrame:
    """Targets of one row per source: weights by rank, ``ratio`` of all sizes shared.

    A target stops at ``cap`` times its source's size. With sources in the order of
    cap over weight, those that stop are a prefix; the level of the rest follows
    from running sums of whole numbers. Sources are configuration (one row each),
    so the windows over all of them are small.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    t = sums.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    full = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    t = t.withColumn("level", (F.lit(float(ratio)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    place = F.row_number().over(full)
    t = t.withColumn("open", F.when(F.col("limit") > F.col("level") * F.col("w"), F.struct(place.alias("place"), F.col("level").alias("level"))))
    t = t.withColumn("level", F.min("open").over(every)["level"])
    return t.select("source", "source_size", F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("w")), F.col("limit")).alias("target"))


def plan_mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): sized has doc_id, source, size, key of every row; plan has one row per source.

    plan: source, source_size, target, epochs, cut_key, cut_take. A row takes
    ``epochs`` times its size; below the cut key once more, at the cut key
    ``cut_take`` words at most. Rows of one key share what is left at the cut.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    sized = materialize(sized, "mix-sizes")
    def ranged(rows: DataFrame, level: int) -> DataFrame:
        at = F.shiftright("key", KEY_BITS - RANGE_BITS * (level + 1)).alias("range")
        return rows.groupBy("source", at).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))

    ranges = materialize(ranged(sized, 0), "mix-ranges")
    sums = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = source_targets(sums, weights, ratio, cap)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = materialize(t.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-targets")
    n_sources = t.count()
    # the range that holds a source's cut is cut again, until a range is one key
    order = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows, cut = sized.select("source", "size", "key"), t.select("source", F.col("rest").alias("left"))
    for level in range(KEY_BITS // RANGE_BITS):
        at = (ranged(rows, level) if level else ranges).withColumn("until", F.sum("words").over(order))
        at = at.alias("r").join(cut.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        at = at.filter((F.col("until") > F.col("left")) & (F.col("until") - F.col("words") <= F.col("left")))
        cut = materialize(at.select("r.source", "r.range", "r.rows", (F.col("t.left") - F.col("until") + F.col("words")).alias("left")), f"mix-cut-{level}")
        if level + 1 < KEY_BITS // RANGE_BITS:
            side = F.broadcast(cut) if n_sources <= MOST_BROADCAST else cut
            inside = F.col("d.source").eqNullSafe(F.col("a.source")) & (F.shiftright("d.key", KEY_BITS - RANGE_BITS * (level + 1)) == F.col("a.range"))
            rows = materialize(rows.alias("d").join(side.alias("a"), inside).select("d.*"), f"mix-rows-{level}")
    cut = cut.select("source", F.col("range").alias("cut_key"), F.floor(F.col("left") / F.col("rows")).cast("long").alias("cut_take"))
    plan = t.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    plan = plan.select("t.source", "source_size", "target", "epochs", F.coalesce("cut_key", F.lit(-1)).alias("cut_key"), F.coalesce("cut_take", F.lit(0)).alias("cut_take"))
    return sized, materialize(plan, "mix-plan")


def with_taken(sized: DataFrame, plan: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Join each row's source plan and add ``taken``; the plan is broadcast only if it is short."""
    p = plan.withColumnRenamed("source", "_source")
    p = F.broadcast(p) if plan.count() <= most_broadcast else p
    out = sized.join(p, sized["source"].eqNullSafe(p["_source"])).drop("_source")
    more = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.least("size", "cut_take")).otherwise(F.lit(0))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + more)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``.

    Null and empty texts have size 0; a text of any length is counted whole; null sources are one source, the last; rows
    without doc_id, repeated rows and others of equal id tie: they share a key and divide the cut evenly;
    an empty table gives no rows; further columns are ignored.
    """
    sized, plan = plan_mix(docs, **options)
    return with_taken(sized, plan).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per whole copy taken, and the cut document up to its cut (its words joined by one space).

    A column n_chars follows a cut text; all others, whatever their names, are carried
    as they are. Nulls, ties, long texts, repeated rows and an empty table are as in ``mix``.
    """
    _, plan = plan_mix(docs, **options)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(own, "source", n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), options.get("seed", 7)).alias("key"))
    rows = with_taken(rows, plan).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    text = F.col("_row.text")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, part), " ")
    texts = F.concat(F.array_repeat(text, whole), F.when(part > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    out = rows.select("_row", F.explode(texts).alias("_text")).withColumn("_row", with_text(F.col("_row"), F.col("_text"), docs.columns))
    return out.select("_row.*")


def with_text(row: Column, text: Column, columns: list[str]) -> Column:
    """A struct of a row with another text, and n_chars to match where the text is another and the column is there."""
    out = row.withField("text", text)
    if "n_chars" in columns:
        out = out.withField("n_chars", F.when(row["text"].eqNullSafe(text), row["n_chars"]).otherwise(F.length(text)))
    return out

"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names (capitalised words inside a sentence) and units (after a number) become typed
placeholders; windows of five canonical words are joined by hash with the windows of the
benchmark's items; along each alignment of a document with an item a slot's value must stand for
one value throughout, so the same question with other values is found; windows that contradict
this do not count, unless they hold the item's own values.

A document is contaminated by an item when consistent windows cover 80 % of the item's words, or
RUN words of it.  Windows of mostly placeholders prove nothing unless their values agree too, so
they are joined with their values.

Defined results: null or short texts match nothing; items shorter than a window are one window of
their own length if they have WINDOW - 2 words, else nothing; repeated rows share their doc_id's
result; rows without doc_id are not reported and `drop_contaminated` keeps them; an empty
benchmark matches nothing, and an empty table gives an empty one; a very long text is cut into
windows whole; where an item matches at several places, its words covered at any of them count; of items that match
alike each is reported;
extra columns are ignored by `leaks` and kept by `drop_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm._text import kept_safe, pick

WINDOW = 5
MIN_COVERAGE = 80
RUN = 24
#: Literal words that a window needs.
MIN_LITERALS = 3
#: Benchmark windows up to this count are broadcast (24 bytes each and their slots); more are joined by shuffle.
MAX_BROADCAST_WINDOWS = 200_000
# Unit words that follow a number.
UNITS = "km|m|cm|mm|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|mph|kmh|percent|dollars|euros|cents|miles|feet|inches|degrees|meters|metres|liters|litres|grams|kilograms|kilometers"
_NUM, _NAME, _UNIT, _APART = "\u0001", "\u0002", "\u0003", "\u0004"


def canonical(text: Column) -> Column:
    """Lower-case words without punctuation; a word that fills a slot begins with its slot's mark.

    Every pattern begins with what is rare or fails at once, since it is tried at every character.
    """
    t = F.regexp_replace(text, f"[{_NUM}-{_UNIT}]", " ")
    t = F.regexp_replace(t, r"([\p{Ll},;:])\s+(?=\p{Lu}\p{Ll})", f"$1 {_NAME}")
    t = F.regexp_replace(F.lower(t), rf"(\p{{N}}(?<![\p{{L}}\p{{N}}].)(?:[\p{{N}}.,]*\p{{N}})?)(?![\p{{L}}\p{{N}}])(?:\s?({UNITS})(?![\p{{L}}\p{{N}}]))?", f"{_NUM}$1 {_UNIT}$2")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{_NUM}-{_UNIT}\s]+| ?{_UNIT}(?![\p{{L}}])", "")
    return F.split(F.trim(t, F.lit(" \t\n\r\f\v")), r"\s+")


def template_windows(rows: DataFrame, key: str, text: str = "text", short: tuple[int, ...] = ()) -> DataFrame:
    """key, pos (0-based), width, template, and slots: the values that fill the window's slots, joined; null if none.

    Windows have WINDOW words, and all of them also each width in short.  The template is a hash of
    the words with slots as their kinds; of the words themselves if fewer than MIN_LITERALS are literals.
    Rows carry no words: windows are cut by position and hashed in generated code.
    """
    widths = (WINDOW, *short)
    words = rows.where(F.col(text).isNotNull()).select(F.col(key), canonical(F.col(text).cast("string")).alias("w"))
    # Short texts go by a null, not by a filter: Spark would push that below the words and cut them twice.
    starts = F.when(F.size("w") >= min(widths), F.sequence(F.lit(0), F.size("w") - min(widths)))
    spans = words.select(key, "w", F.explode(starts).alias("pos"))
    if short:
        spans = spans.select("*", F.explode(F.array(*map(F.lit, widths))).alias("width")).where("pos + width <= size(w)")
    else:
        spans = spans.withColumn("width", F.lit(WINDOW))

    def made(width: int) -> tuple[Column, Column]:
        w = [F.get("w", F.col("pos") + k) for k in range(width)]
        slots = sum((F.when(x < "\u0004", 1).otherwise(0) for x in w), F.lit(0))
        template = F.when(slots > width - MIN_LITERALS, F.xxhash64(*w)).otherwise(F.xxhash64(*[F.when(x < "\u0004", F.substring(x, 1, 1)).otherwise(x) for x in w]))
        return template, F.nullif(F.concat_ws(_APART, *[F.when(x < "\u0004", x) for x in w]), F.lit(""))

    template, slots = made(WINDOW)
    for width in short:
        one = made(width)
        template, slots = (F.when(F.col("width") == width, x).otherwise(y) for x, y in zip(one, (template, slots)))
    return spans.select(key, "pos", "width", template.alias("template"), slots.alias("slots"))


def _values(slots: str) -> Column:
    return F.split(slots, _APART)


def _by_value() -> Column:
    return F.coalesce(F.size(_values("slots")) > F.col("width") - MIN_LITERALS, F.lit(False))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered_words, item_words, coverage: every item that a document holds, one row each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.select("item_id", "text", F.size(canonical(F.col("text"))).alias("item_words"))
    length = items.groupBy("item_id").agg(F.max("item_words").alias("item_words"))
    # Windows narrower than WINDOW stand only for items of just that length.
    short = tuple(sorted(r[0] for r in items.select("item_words").where(F.col("item_words").between(WINDOW - 2, WINDOW - 1)).distinct().collect()))
    # In a document, what stands before an item can make its first word a name; so items are read both ways.
    key = F.struct("item_id", "item_words").alias("item")
    alone = template_windows(items.select(key, "text"), "item", short=short)
    after = template_windows(items.select(key, F.concat(F.lit("a "), "text").alias("text")), "item", short=short).withColumn("pos", F.col("pos") - 1).where("pos >= 0")
    known = alone.unionByName(after).where(f"width = {WINDOW} OR width = item.item_words")
    known = known.select("item.item_id", F.col("pos").alias("item_pos"), F.col("width").alias("item_width"), "template", F.col("slots").alias("item_slots")).distinct()
    known = kept_safe(known)
    small = known.count() <= MAX_BROADCAST_WINDOWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    hits = template_windows(rows, "doc_id", short=short).join(F.broadcast(known) if small else known, "template")
    hits = hits.where(F.col("width") == F.col("item_width")).where(~_by_value() | F.col("slots").eqNullSafe(F.col("item_slots")))
    hits = hits.select("doc_id", "item_id", "item_pos", "width", (F.col("pos") - F.col("item_pos")).alias("shift"), _values("slots").alias("slots"), _values("item_slots").alias("item_slots"))
    hits = kept_safe(hits.distinct())
    # Along one alignment, each value of an item's slot must stand for one value.
    one = ["doc_id", "item_id", "shift"]
    values = hits.where("slots IS NOT NULL AND size(slots) = size(item_slots)").select(*one, F.explode(F.arrays_zip("slots", "item_slots")).alias("v")).select(*one, "v.slots", "v.item_slots").distinct()
    bad = values.groupBy(*one, "item_slots").count().where("count > 1").groupBy(*one).agg(F.collect_set("item_slots").alias("bad"))
    fits = F.col("bad").isNull() | F.col("slots").isNull() | F.col("slots").eqNullSafe(F.col("item_slots")) | ~F.coalesce(F.arrays_overlap("item_slots", "bad"), F.lit(False))
    good = hits.join(bad, one, "left").where(fits).select("doc_id", "item_id", "item_pos", "width").distinct()
    reach = F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("item_pos", "width")), lambda x: F.sequence(x["item_pos"], x["item_pos"] + x["width"] - 1))))
    found = good.groupBy("doc_id", "item_id").agg(F.size(reach).alias("covered_words")).join(length, "item_id")
    found = found.where(f"100 * covered_words >= {MIN_COVERAGE} * item_words OR covered_words >= {RUN}")
    return found.select("doc_id", "item_id", "covered_words", "item_words", F.round(F.col("covered_words") / F.col("item_words"), 6).alias("coverage"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids (sorted), best_coverage; one row per contaminated doc_id."""
    found = leaks(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("coverage").alias("best_coverage"))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows, all columns as they were."""
    gone = kept_safe(leaks(docs, benchmark).select("doc_id").distinct())
    return pick(docs, gone, "doc_id", "left_anti")

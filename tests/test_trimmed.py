"""Trims and kinds of words that are looked at as they are first."""

from pyspark.sql import functions as F

from folio.functions.labels import BLOCK_TYPES, block_type
from folio.functions.text import BLANK, js_trim, trimmed


def test_trimmed_as_js_trim(spark):
    texts = [*(f for b in BLANK for f in (b + "a", "a" + b, b, "a" + b + "b")), "", " ", "a", "😀", "　가 ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(trimmed(F.col("t")).alias("a"), js_trim(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_block_type_of_words_as_they_are_and_others(spark):
    words = [(w, kind) for kind, names in BLOCK_TYPES.items() for n in names for w in (n, n.upper(), f" {n}\u3000")] + [(None, "other"), ("", "other"), ("sign", "other"), ("sfx2", "other")]
    rows = spark.createDataFrame(words, "w string, kind string").select("w", "kind", block_type(F.col("w")).alias("got")).collect()
    assert all(r.kind == r.got for r in rows)

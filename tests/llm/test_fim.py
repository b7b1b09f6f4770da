"""Fill-in-middle against plain slicing of strings, and round trips."""

import hashlib
import random

import pytest

from folio.llm import fim


def plain(doc_id, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, FORM string, n int")
    got = fim.restored(fim.fill_in_middle(df)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, plain(i, t)), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.restored) for r in got) == want
    return got


def test_texts_of_all_kinds(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "ab", "<P>", "x<S>y", "<M", "P>", "<", "<P<S<M", "S>M>P>", "é東🚀\u0000\n", "  ", "<<P", ">>"]
    rows = [(k, t) for k, t in enumerate(texts * 12)]
    rows += [(1000 + k, "".join(rng.choice("<PSM>é🚀 ") for _ in range(rng.randrange(12)))) for k in range(400)]
    rows += [(None, "no id"), (None, None), (-5, "minus"), (7, "again"), (7, "again")]
    got = check(spark, rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_very_long_text(spark, monkeypatch):
    check(spark, [(k, ("wörd " * 60_000) + str(k)) for k in range(6)] + [(9, "short")])
    monkeypatch.setattr(fim.tx, "CHUNK_BYTES", 40)
    check(spark, [(k, "é" * (k % 31)) for k in range(200)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restored(fim.fill_in_middle(df)).count() == 0


def test_broken_output_is_an_error(spark):
    df = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="sentinels|reshape"):
        fim.restored(df).collect()

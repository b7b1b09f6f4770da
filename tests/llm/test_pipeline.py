"""The pipeline's stages on a small folder, each held against what its predecessor kept."""

import random

import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    at = str(tmp_path_factory.mktemp("tables"))
    word = lambda: rng.choice(["ba", "ko", "ti", "re", "sun", "mol"]) + rng.choice(["na", "ri", "xo", "du", "vel"]) + rng.choice("abcdefgh")
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for k in range(400):
        t = text(50)
        if k % 8 == 0:
            t += " grumph blarg"
        docs.append((k, t, "en", f"s{k % 4}"))
        labels.append((k, 1, int(k % 8 == 0)))
    item = text(30)
    docs += [(500, docs[1][1], "en", "s0"), (501, docs[2][1] + " end", "en", "s1"), (502, f"{text(20)} {item}", "en", "s1"), (503, None, None, None), (504, "", "en", "s2"), (1, docs[1][1], "en", "s1")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    left = {}
    for name, stage in c.STAGES[:3]:
        docs = stage(spark, docs, folder).checkpoint()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    clean = [k for k in range(400) if k % 8]
    assert left["toxicity"] == sorted([*clean, 1, 500, 501, 502, 503, 504])
    assert left["near_dedup"] == sorted([*clean, 502, 503, 504])
    assert left["decontamination"] == sorted([*clean, 503, 504])


def test_run(spark, folder):
    import corpus_pipeline as c

    out = c.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    n = out.count()
    assert n > 100 and out.select("shard", "slot").distinct().count() == n
    sizes = [r[1] for r in out.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_stages_by_hand(spark, folder):
    """Each stage against a second, slow implementation on what its predecessor kept."""
    import collections

    import corpus_pipeline as c
    from test_brute_force import leaked, linked, place, shingles, words
    from test_operators import filled

    from folio.llm.toxicity import severity

    stages = dict(c.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in severity(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("toxic").collect()}
    kept = stages["toxicity"](spark, docs, folder).checkpoint()
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in docs.collect() if r.doc_id not in toxic)

    rows = {r.doc_id: r.text for r in kept.collect()}
    low, _ = linked({i: shingles(t, 5) for i, t in rows.items()})
    once = stages["near_dedup"](spark, kept, folder).checkpoint()
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i in rows if low[i] == i)

    item = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in once.collect()]
    gone = {i for i, _, _ in leaked([x for x in left if x[1]], item)}
    clean = stages["decontamination"](spark, once, folder).checkpoint()
    assert gone and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in left if i not in gone)

    mixed = stages["mixing"](spark, clean, folder).checkpoint()
    sizes, taken, times = collections.Counter(), collections.Counter(), collections.Counter()
    for r in clean.collect():
        sizes[r.source] += len(words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
        times[r.doc_id] += 1
    goal = filled(sizes)
    assert max(times.values()) <= 3 and all(abs(taken[s] - goal[s]) <= 60 for s in sizes)

    laid = stages["sharding"](spark, mixed, folder).collect()
    assert collections.Counter((r.shard, r.slot) for r in laid) == collections.Counter(divmod(place(k, len(laid)), 24)[::-1] for k in range(len(laid)))
    assert collections.Counter(r.doc_id for r in laid) == times


def test_odd_tables(spark, tmp_path):
    """Null, empty, very long and unspaced texts, rows without id, repeats, one id with two texts, and columns that clash with any step's own."""
    import corpus_pipeline as c

    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    clash = ["row", "mark", "_mark", "_id", "_node", "kept", "size", "n", "c", "k", "s", "run", "count", "component_id", "shard", "slot"]
    a, b = text(40), text(40)
    docs = [(1, a, "en", "s"), (2, a, "en", "s"), (3, None, None, None), (4, "", "en", None), (5, "x" * 300_000, "en", "s"), (6, text(40_000), "en", "t"), (7, b, "en", "t"), (7, b, "en", "t"), (8, text(30), "en", "t"), (8, text(30), "en", "t"), (None, a, "en", "s"), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} int" for x in clash)
    spark.createDataFrame([(*d, len(d[1] or ""), *range(len(clash))) for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(20)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in c.STAGES:
        rows = stage(spark, rows, str(tmp_path)).checkpoint()
        left.append((name, sorted(str(r.doc_id) for r in rows.collect())))
        assert sorted(rows.columns) == sorted(x.split()[0] for x in schema.split(", "))
    all_ = sorted(str(d[0]) for d in docs)
    assert left[0][1] == all_ and left[1][1] == left[2][1] == sorted(["1", "3", "4", "5", "6", "7", "8", "8", "None", "None"])
    assert rows.select("shard", "slot").distinct().count() == rows.count() and left[3][1] == left[4][1]
    empty = spark.createDataFrame([], schema)
    for _, stage in c.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

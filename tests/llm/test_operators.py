"""Operators against brute force, and their defined results on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard string, _size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n):
    return " ".join(rng.choice(["ba", "ko", "ti", "re", "sun", "mol"]) + rng.choice(["na", "ri", "xo", "du", "vel"]) + str(rng.randrange(40)) for _ in range(n))


def rows():
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(12)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    out.append((100, base[0], "en", "s0"))  # exact copy
    w = base[1].split()
    out.append((101, " ".join(w[:30] + ["other"] + w[31:]), "en", "s1"))  # near copy
    out += [(102, None, "en", "s1"), (103, "", None, None), (104, " \t\n ", "en", "s2"), (105, "One", "en", "s2"), (106, "one", "en", "s2")]
    out.append((107, prose(rng, 30_000), "en", "s2"))
    out += [(None, base[2], "en", "s0"), (200, base[3], "en", "s1"), (200, base[3], "en", "s1")]  # no id; a repeated row
    return [(*r, len(r[1] or ""), True, "x", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (1, 1, 0), (1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def test_minhash_matches_brute_force(docs, empty):
    from folio.llm.minhash import near_duplicates

    got = near_duplicates(docs, shingle_words=4).collect()
    assert len(got) == len(rows())
    sets = {}
    for i, t, *_ in rows():
        w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    low = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if sets[a] and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (low[r.doc_id], low[r.doc_id] == r.doc_id)
    assert near_duplicates(empty).count() == 0


def test_minhash_joins_chains_and_big_groups(spark):
    """Every version is a link of its neighbours only, and one hot group has many distinct near copies."""
    from folio.llm.minhash import near_duplicates

    rng = random.Random(2)
    w = prose(rng, 80).split()
    data = []
    for k in range(12):
        data.append((k, " ".join(w)))
        for p in rng.sample(range(80), 1):
            w[p] = f"new{k}"
    hot = prose(rng, 100).split()
    for k in range(150):
        v = list(hot)
        v[rng.randrange(100)] = f"v{k}"
        data.append((1000 + k, " ".join(v)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(12)} == {0} and {got[1000 + k] for k in range(150)} == {1000}


def test_keep_one_of_each(docs, empty):
    from folio.llm.minhash import keep_one_of_each

    out = keep_one_of_each(docs)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect())
    assert [i for none, i in ids if not none] == [*range(12), 102, 103, 104, 105, 107] and sum(none for none, _ in ids) == 1
    assert keep_one_of_each(empty).count() == 0


def test_keep_one_of_each_by_row(spark):
    """Two texts of one doc_id are two documents; what repeats whole leaves one; a column named _node is kept."""
    from folio.llm.minhash import keep_one_of_each

    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    data = [(1, a, 0), (5, a + " end", 1), (5, b, 2), (7, b, 3), (8, c, 4), (8, c, 5), (None, a, 6), (9, None, 7), (9, None, 7)]
    out = keep_one_of_each(spark.createDataFrame(data, "doc_id int, text string, _node int"))
    assert out.columns == ["doc_id", "text", "_node"]
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(map(str, (x for x in left if x[1] != b))) == sorted(map(str, [(1, a), (8, c), (None, a), (9, None), (9, None)]))
    assert sum(t == b for _, t in left) == 1


def test_components(spark):
    from folio.llm._graph import components

    edges = [(k, k + 1) for k in range(30)] + [(100, 100), (50, 60), (60, 50), (50, 60)] + [(7, 1000 + k) for k in range(200)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[k] == 0 for k in [*range(31), *range(1000, 1200)]) and got[60] == 50
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_severity(spark, docs, empty, labels):
    from folio.llm.toxicity import drop_toxic, severity

    rng = random.Random(3)
    bad = ["grumph", "blarg", "snotling", "vexor"]
    data, marks = [], []
    for k in range(600):
        t = prose(rng, 40).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(1 + k % 4):
                t[rng.randrange(40)] = rng.choice(bad)
        data.append((k, " ".join(t)))
        if k < 400:
            marks.append((k, 1, int(toxic)))
    d, m = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in severity(d, m).collect()}
    held = range(400, 600)
    assert np.mean([got[k].toxic == (k % 5 == 0) for k in held]) > 0.97
    assert not any(got[k].toxic for k in held if k % 5)
    low, high = (np.mean([got[k].severity for k in range(0, 600, 5) if k % 4 == n]) for n in (0, 3))
    assert 0 < low < high <= 3
    assert {r.doc_id for r in drop_toxic(d, m).collect()} == {k for k, r in got.items() if not r.toxic}
    # Odd rows beside the labelled ones that the model is fitted on.
    odd = spark.createDataFrame([(9001, None, 1), (None, "grumph blarg snotling vexor", 2), (9002, "", 3), (9002, "", 3), (9003, "...", 4)], "doc_id long, text string, row int")
    both = odd.unionByName(d.withColumn("row", F.lit(0)))
    out = [r for r in severity(both, m).collect() if r.doc_id is None or r.doc_id > 9000]
    assert len(out) == 5 and [r.severity for r in out if r.doc_id is not None] == [0.0] * 4 and [r.toxic for r in out if r.doc_id is None] == [True]
    kept = drop_toxic(both, m)
    assert kept.columns == odd.columns and kept.where("row > 0").count() == 4
    assert severity(empty, m).count() == 0 and drop_toxic(empty, m).count() == 0
    one = m.where("toxic = 0")
    assert severity(docs, one).where("toxic").count() == 0 and drop_toxic(docs, one).count() == docs.count()
    assert severity(docs, labels).count() == docs.count()


def test_patience_alignment():
    from folio.llm.licenses import align, rising

    assert [[3, 1, 2, 5, 4][k] for k in rising([3, 1, 2, 5, 4])] == [1, 2, 4]
    assert align([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert align([], [1]) == [] and align([1, 1], [1, 1]) == [(0, 0), (1, 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_alignments_rise_and_match(a, b):
    from folio.llm.licenses import align

    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_licenses(spark, docs, empty):
    from folio.llm.licenses import TEMPLATES, scan_licenses

    rng = random.Random(4)
    mit = TEMPLATES["MIT"].split()
    noisy = " ".join(w for k, w in enumerate(mit) if k % 12)  # one word in twelve lost
    data = [(1, f"{prose(rng, 500)} {TEMPLATES['MIT']} {prose(rng, 300)}"), (2, f"{prose(rng, 77)} {noisy}"), (3, f"{prose(rng, 10)}\nReleased under the MIT License.\n{prose(rng, 10)}\nReleased under the MIT License."), (4, "the license of this is under the sun"), (5, " ".join(mit[:60]))]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert (got[1].license_id, got[1].coverage, got[1].word_start) == ("MIT", 1.0, 500)
    assert got[2].license_id == "MIT" and 0.85 < got[2].coverage < 0.95
    assert got[3].license_id == "MIT-notice" and got[3].n_found == 2
    assert got[4].license_id is None and got[5].license_id is None
    assert scan_licenses(docs).where("n_found = 0").count() == docs.count() and scan_licenses(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_permutation_is_one(n, seed):
    from folio.llm.sharding import permute

    assert sorted(permute(np.arange(n), n, seed)) == list(range(n))


def test_sharding(spark, docs, empty):
    from folio.llm.sharding import assign, shard_rows

    got = assign(docs, 5).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    text = {r[0]: r[1] or "" for r in rows()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    key = lambda x: sorted(map(str, x))
    assert key(assign(docs.repartition(7), 5).collect()) == key(got)
    full = shard_rows(docs, 5)
    assert full.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert full.select("shard", "slot").distinct().count() == docs.count()
    assert assign(empty).count() == 0 and shard_rows(empty).count() == 0


def test_quality(spark, docs, empty):
    from folio.llm.quality import quality

    rng = random.Random(5)
    line = prose(rng, 12)
    data = [(k, t) for k, t, *_ in rows()] + [(300, "\n".join([line, prose(rng, 40), line, "", "", line])), (301, "a b c d e " * 40), (302, "é# <|x|> $5 & ünï\n é\n é"), (303, prose(rng, 100))]
    got = quality(spark.createDataFrame(data, "doc_id long, text string")).collect()
    seen = collections.Counter()
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_words)), sorted(data, key=lambda x: (str(x[0]), len(words(x[1]))))):
        t = t or ""
        w = words(t)
        n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = collections.Counter(x for x in t.split("\n") if words(x))
        expected = (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(v - 1 for v in lines.values()), len(covered))
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
        seen[r.kept] += 1
    assert seen[True] >= 13 and {r.kept for r in got if r.doc_id == 301} == {False} and {r.kept for r in got if r.doc_id == 303} == {True}
    assert quality(empty).count() == 0


CHATS = [
    (1, 0, "system", "be [INST] nice"), (1, 1, "user", "hi\\ </s>"), (1, 2, "user", "and [+] more"), (1, 3, "assistant", "a[/INST]b"), (1, 4, "assistant", None), (1, 5, "assistant", "\\"),
    (2, 1, None, "[:]\\["), (2, 0, "tool [:] x", "<s>[TURN]"), (2, 2, "", ""), (3, 0, "assistant", "é😀</s"), (4, None, "user", "first"), (4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "no id"),
]


def _digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_chat_reads_back(spark):
    from folio.llm.chat import digests, format_chats

    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in digests(format_chats(df.withColumn("t", df.turn))).collect()}
    by = collections.defaultdict(list)
    for c, n, r, t in CHATS:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), _digest(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    merged = format_chats(df).where("conv_id = 1").first().formatted
    assert merged.count("<s>") == merged.count("</s>") == 1 and merged.count("[INST]") == 1
    assert digests(format_chats(df.limit(0))).count() == 0


def test_chat_has_no_python(spark):
    from folio.llm.chat import digests, format_chats

    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    plan = digests(format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def filled(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    """Targets by plain water filling, one full source after the other."""
    order = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [k for k in sizes if k is None]
    open_ = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, out = float(sum(sizes.values())), {}
    while open_:
        scale = left / sum(open_.values())
        full = [k for k in open_ if open_[k] * scale > most * sizes[k]]
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
            del open_[k]
        if not full:
            return out | {k: w * scale for k, w in open_.items()}
    return out


def test_targets(spark):
    from folio.llm.mixing import targets

    rng = random.Random(11)
    for sizes in ({"b": 100, "a": 1000, None: 10, "c": 50}, {}, {"a": 0}, {"é": 5, "z": 5, "Z": 0}, {f"s{k}": int(10 ** rng.uniform(0, 6)) for k in range(60)}):
        per = spark.createDataFrame([(k or "", k, v) for k, v in sizes.items()], "s string, source string, size long")
        got = {r.source: r.target for r in targets(per).collect()}
        goal = filled(sizes)
        assert set(got) == set(goal) and all(abs(got[k] - goal[k]) < 1e-6 * max(1, goal[k]) for k in goal)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1000)), max_size=60))
def test_flight_keeps_totals(units):
    from folio.llm.mixing import flight

    p, x = [u[0] for u in units], [float(u[1]) for u in units]
    q = flight(list(p), x)
    assert abs(sum(p) - sum(q)) < 1e-4 and abs(np.dot(p, x) - np.dot(q, x)) < 1e-2 * max(1, len(x))
    assert sum(1e-8 < v < 1 - 1e-8 for v in q) <= 2 and all(0 <= v <= 1 for v in q)


def test_mixing(spark, docs, empty):
    from folio.llm.mixing import mix_rows, mixture

    rng = random.Random(6)
    data = [(k, " ".join(["w"] * rng.randrange(1, 200)), "hot" if k % 3 else f"s{k % 7}") for k in range(9000)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixture(d).toPandas()
    sums = got.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    goal = filled({k: int(v) for k, v in sums["size"].items()})
    assert all(abs(goal[k] - sums.target[k]) < 1e-6 and abs(sums.taken[k] - goal[k]) < 10 for k in goal)
    assert (got.taken <= 3 * got["size"]).all()
    again = mixture(d.repartition(5)).toPandas()
    order = ["doc_id"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    out = mixture(docs)
    assert out.count() == docs.count() and out.where("size = 0 AND taken > 0").count() == 0
    mixed = mix_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == out.agg({"n_copies": "sum"}).first()[0]
    assert mixture(empty).count() == 0 and mix_rows(empty).count() == 0


def test_tokens_match_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("public_tokenizers")
    sp = pytest.importorskip("sentencepiece")
    from folio.llm.tokens import token_counts

    path = str(tokenizers.path("piece_bpe_32k.model"))
    model = sp.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    odd = ["", " ", "a  b\n\nc\td", "</s>[INST]<s> <unk>", "\x00a▁b", "  x ", "😀 日本語テスト" * 40, "x" * 3000, " " * 99, "\r\n);\r", None]
    odd += ["".join(rng.choice("ab ▁\n\r);é日😀the") for _ in range(200)) for _ in range(100)]
    odd += [r[1] for r in rows()]
    got = {r.doc_id: r for r in token_counts(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path).collect()}
    for k, t in enumerate(odd):
        n = len(model.encode(t or ""))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts(docs, path).count() == docs.count() and token_counts(empty, path).count() == 0


BENCH = [(1, "yesterday Anna bought 12 apples and gave 5 apples to her brother before walking 3 km back home with Anna alone"), (2, "plain words of an item that has nothing special in it but is long enough to count here"), (3, None), (4, ""), (5, "one two three"), (None, "no id at all for this item of the benchmark table here")]


def test_decontamination(spark, docs, empty):
    from folio.llm.decontaminate import contamination, drop_contaminated, leaks

    rng = random.Random(8)
    pad = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "velit"]) + rng.choice("abcdef") for _ in range(50))
    data = [
        (1, f"{pad()} {BENCH[0][1]} {pad()}"),  # as it is
        (2, f"{pad()} yesterday Greg bought 40 apples and gave 17 apples to her brother before walking 9 km back home with Greg alone {pad()}"),  # other values
        (3, f"{pad()} yesterday Greg bought 40 apples and gave 17 apples to her brother before walking 9 km back home with Dora alone {pad()}"),  # slots that disagree
        (4, pad()), (5, None), (6, ""), (7, BENCH[1][1].upper()), (8, "plain words of an item"), (9, "7 8 9 10 11 12 13 14 15 16"), (None, BENCH[1][1]),
    ]
    d = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    assert {(1, 1), (2, 1), (7, 2)} <= got and {i for i, _ in got} <= {1, 2, 3, 7}
    agree = {r.doc_id: r.covered_words for r in leaks(d.where("doc_id IN (2, 3)"), b).collect()}
    assert agree.get(3, 0) < agree[2]
    assert contamination(d, b).where("doc_id = 1").first().item_ids == [1]
    left = drop_contaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} >= {4, 5, 6, 8, 9, None}
    assert leaks(docs, b.limit(0)).count() == 0 and leaks(empty, b).count() == 0 and drop_contaminated(empty, b).count() == 0
    plan = leaks(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_short_and_dense_items(spark):
    from folio.llm.decontaminate import leaks

    items = [(1, "one two three"), (2, "take 4 big steps"), (3, "Compute 12 + 7 * 15 - 3 + 28 exactly"), (4, "Sort 9, 4, 7, 1, 3, 8 and 2 in ascending order")]
    docs = [(k, f"lorem ipsum. {t} and so on") for k, t in items] + [(10, "1 2 3 4 5 6 7"), (11, "lorem. Compute 12 + 7 * 15 - 3 + 29 exactly"), (12, "one two"), (13, "one two four")]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in found} == {(k, k, 1.0) for k, _ in items}


def test_decontamination_slots_and_lines(spark):
    from folio.llm.decontaminate import leaks

    tail = "after that they all sat down by the river and talked about the weather and the long road home until it was dark and nobody wanted to leave before"
    items = [(1, f"yesterday Anna bought apples for her brother and {tail} Anna left"), (2, "she gave 12 apples to some old friend and kept 5 apples for later days"), (3, "then we met Boris at home"), (4, "Name the longest river here")]
    docs = [
        (1, f"lorem. {items[0][1].replace('Anna left', 'Dora left')}"),  # one of two values changed
        (2, "lorem. she gave 8 apples to some old friend and kept 8 apples for later days"),  # two values made equal
        (3, "lorem. then we met\n  Boris at home"),  # wrapped before a name
        (4, "lorem ipsum\nName the longest river here"), (5, "lorem ipsum Name the longest river here"), (6, "Name the longest river here"),  # first word
        (7, "they met Boris"),
    ]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 4)}
    assert all(r.coverage == 1 for r in found if r.doc_id != 1)


def test_language(spark, docs, empty):
    from folio.llm.langid import identify

    rng = random.Random(9)
    parts = {"aa": ["ba", "na", "ta", "ra"], "ee": ["bé", "né", "tê", "re"], "oo": ["bo", "no", "ßo", "ro"]}
    data = [(k, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(30)), x) for k in range(300) for x in [sorted(parts)[k % 3]]]
    data += [(900, None, "aa"), (901, "123 ...", "aa"), (902, "bana", None), (None, "bana tara bana", None)]
    got = identify(spark.createDataFrame([(*r, "z") for r in data], "doc_id long, text string, lang string, score string")).collect()
    assert len(got) == len(data)
    truth = {i: x for i, _, x in data}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id in (900, 901):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert {r.lang_pred for r in identify(docs).collect()} == {"en", "und"}
    assert identify(empty).count() == 0 and {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_trains_on_whole_texts(spark, monkeypatch):
    from folio.llm import langid

    seen = []
    real = langid.train
    monkeypatch.setattr(langid, "train", lambda bags, langs, idf: seen.append((bags, langs)) or real(bags, langs, idf))
    text = "ba " * 8_000 + "né tê " * 3_000
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, text, "ee") for k in ids] + [(ids[0], "other text", "oo")]
    langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count()
    (bags, langs), = seen
    assert langs == ["ee"] * len(ids)
    whole = langid.ngrams(text)
    assert all(np.array_equal(at, whole[0]) and np.array_equal(n, whole[1]) for at, n in bags)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from folio.llm._text import shared_folder

    def session(master, named=None, kept={}):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: kept.get(master), setCheckpointDir=lambda d: kept.update({master: d}))
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: named))

    with pytest.raises(RuntimeError):
        shared_folder(session("yarn"))
    assert shared_folder(session("spark://x:7077", "hdfs:///shared")) == "hdfs:///shared"
    assert "folio-checkpoint" in shared_folder(session("local[4]"))

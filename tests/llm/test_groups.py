"""Links inside groups of versions of one text, against all pairs."""

import random

import pytest

from folio.llm import minhash as mh


def shingles(text, width=4):
    w = text.lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def plain(rows):
    """Smallest doc_id that each document reaches over all pairs that are similar enough."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(df, shingle_words=4, percent=80).collect()}
    assert got == plain(rows)


def not_shorter_than_its_head(rng):
    """A text, six versions of it, and two members that are linked with each other only: one cut to 998 of its 1,000 shingles, one of its length with a tenth of its own."""
    h = words(rng, 1003)
    rows = [h] + [[*h[:k], *words(rng, 1), *h[k + 1 :]] for k in (100, 200, 300, 400, 500, 600)]
    return [" ".join(r) for r in [*rows, h[1:-1], [*h[:0], *h[:891], *words(rng, 112)]]]


def test_members_not_shorter_than_their_head(spark):
    rng, rows = random.Random(4), []
    for g in range(40):
        rows += [(100 * g + k, t) for k, t in enumerate(not_shorter_than_its_head(rng))]
    rng.shuffle(rows)
    check(spark, rows)


def dropped(rng, n, drop, paragraphs=40, size=25):
    parts = [words(rng, size) for _ in range(paragraphs)]
    out = [sum(parts, [])]
    for _ in range(n):
        gone = set(rng.sample(range(paragraphs), drop))
        out.append(sum((p for k, p in enumerate(parts) if k not in gone), []))
    return [" ".join(w) for w in out]


def test_versions_without_paragraphs(spark):
    """Versions near the bound: some pairs are linked, most are not."""
    rng, rows = random.Random(6), []
    for g, (n, drop, paragraphs) in enumerate([(30, 11, 40), (40, 5, 12), (40, 3, 12), (30, 9, 40), (40, 4, 13)]):
        rows += [(1000 * g + k, t) for k, t in enumerate(dropped(rng, n, drop, paragraphs, 1000 // paragraphs))]
    check(spark, rows)


@pytest.mark.parametrize("few", [0, 64])
def test_large_groups_are_signed(spark, monkeypatch, few):
    monkeypatch.setattr(mh, "FEW", few)
    rng, rows = random.Random(7), []
    for g, (n, drop, paragraphs) in enumerate([(60, 5, 12), (60, 4, 12), (50, 6, 15), (40, 3, 12)]):
        texts = dropped(rng, n, drop, paragraphs, 600 // paragraphs)
        rows += [(1000 * g + k, f"{t} {' '.join(words(rng, rng.choice([0, 0, 30])))}") for k, t in enumerate(texts)]
    check(spark, rows)


def test_pairs_grow_with_the_group(spark, monkeypatch):
    """Versions of one text of which hardly two are similar: pairs whose sets are compared do not become all pairs."""
    tried = []
    before = mh.with_sets
    monkeypatch.setattr(mh, "with_sets", lambda pairs, *rest: tried.append(pairs.count()) or before(pairs, *rest))
    counts = []
    for n in (150, 300):
        tried.clear()
        check(spark, list(enumerate(dropped(random.Random(n), n, 12))))
        counts.append(sum(tried))
    assert counts[0] < 8 * 150 and counts[1] < 8 * 300, counts

"""Operators against second, slow implementations in plain Python."""

import collections
import math
import random
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M = (1 << 64) - 1


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, kinds=40):
    return " ".join(rng.choice(["ba", "ko", "ti", "re", "sun", "mol"]) + rng.choice(["na", "ri", "xo", "du", "vel"]) + str(rng.randrange(kinds)) for _ in range(n))


def mixed(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & M
    return h ^ (h >> 31)


def shingles(text, n=4):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(sets, percent=80):
    """Smallest reachable id of each id over links of all pairs."""
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    ids, n = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                n += 1
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: find(i) for i in ids}, n


def test_minhash_around_the_threshold(spark):
    """240 pairs of similarity 0.7 to 0.95, none of which knows another."""
    from folio.llm.minhash import near_duplicates

    rng = random.Random(21)
    data = []
    for k in range(240):
        t = prose(rng, rng.randrange(60, 160), 5000).split()
        v = list(t)
        for p in rng.sample(range(len(v)), max(1, int(len(v) * rng.uniform(0.01, 0.07)))):
            v[p] = f"new{rng.randrange(10**6)}"
        data += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(v))]
    truth = {}
    for k in range(240):
        part, _ = linked({i: shingles(data[i][1]) for i in (2 * k, 2 * k + 1)})
        truth |= part
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(3), shingle_words=4).collect()}
    close = sum(truth[2 * k + 1] == 2 * k for k in range(240))
    assert 60 < close < 200 and got == truth


def test_minhash_in_one_large_group(spark):
    """1,500 versions of one text, near enough and not; of versions that the text does not link some are linked with each other."""
    from folio.llm.minhash import near_duplicates

    rng = random.Random(22)
    base = prose(rng, 120, 5000).split()
    data = [(0, " ".join(base))]
    for k in range(1, 1500):
        v = list(data[rng.randrange(max(0, k - 40), k)][1].split()) if k % 50 == 0 else list(base)
        for p in rng.sample(range(len(v)), rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 12])):
            v[p] = rng.choice(["was", "the", f"new{k}", f"w{k % 7}"])
        data.append((k, " ".join(v)))
    truth, links = linked({i: shingles(t) for i, t in data})
    assert links > 10_000 and 100 < len(set(truth.values())) < 1400
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), shingle_words=4).collect()}
    assert got == truth


def test_minhash_of_cut_copies(spark):
    """800 copies of one text cut to 30 to 100 %, some with a word changed: most share nothing but what the whole text has."""
    from folio.llm import minhash

    rng = random.Random(30)
    base = prose(rng, 300, 5000).split()
    data = [(0, " ".join(base))]
    for k in range(1, 800):
        n = rng.randrange(90, 300)
        at = rng.choice([0, 0, 0, 300 - n, rng.randrange(301 - n)])
        v = base[at : at + n]
        if k % 3 == 0:
            v[rng.randrange(n)] = f"new{k}"
        data.append((k, " ".join(v)))
    truth, links = linked({i: shingles(t) for i, t in data})
    pairs, real = [], minhash.crossing

    def counted(*a):
        out = real(*a)
        pairs.append(out.count())
        return out

    minhash.crossing = counted
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), shingle_words=4).collect()}
    finally:
        minhash.crossing = real
    assert links > 50_000 and got == truth and sum(pairs) < links / 5


def test_severity_by_hand(spark):
    from folio.llm import _text as tx
    from folio.llm import toxicity as t

    rng = random.Random(23)
    data, labels = [], []
    for k in range(500):
        w = prose(rng, 30).split()
        if k % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["Grumph!", "blargish", "BLARG", "vexor"])
        data.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    data += [(600, "x" * 70_000 + " grumph"), (601, "grumph"), (602, "...")]
    d, m = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.train(d, m)

    def feature(word, cut=None):
        import numpy as np

        raw = np.frombuffer(word, np.uint8)
        w = tx.words(raw, np.array([0, len(raw)]))
        h = w.hashes if cut is None else tx.mix(w.spans(w.starts, w.starts + cut) + tx.U64(cut))
        return int(h[0] >> tx.U64(64 - t.BITS))

    def score(text):
        found = set()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode()):
            found |= {feature(w)} | {feature(w, n) for n in t.PREFIXES if len(w) > n}
        s = sum(float(model.weights[f]) for f in found)
        return sum(1 / (1 + math.exp(-(s - b))) for b in model.bounds) if words(re.sub("[^a-z0-9]", " ", text.lower())) else 0.0

    assert (model.bounds[:-1] <= model.bounds[1:]).all()
    for r in t.severity(d, m).collect():
        assert abs(r.severity - score(dict(data)[r.doc_id])) < 1e-5
        assert r.toxic == (r.p_toxic > model.cut)


def test_licenses_wherever_they_lie(spark):
    """Every planted text that an alignment of its own span finds is found in its document, with the same coverage."""
    import numpy as np

    from folio.llm.licenses import GAPS, MIN_COVERAGE, MIN_DENSITY, TEMPLATES, align, scan_licenses
    from folio.llm import _text as tx

    def ids(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return tx.words(raw, np.array([0, len(raw)]), lower=True, gaps=GAPS).hashes.tolist()

    rng = random.Random(24)
    names = [n for n in sorted(TEMPLATES) if not n.endswith("notice") and n not in ("BSD-2-Clause", "BSD-3-Clause", "AGPL-3.0", "GPL-3.0", "LGPL-2.1")]
    data, truth = [], {}
    for k in range(120):
        name = rng.choice(names)
        lost, added = rng.uniform(0, 0.25), rng.uniform(0, 0.6)
        out = []
        for w in TEMPLATES[name].split():
            if rng.random() >= lost:
                out.append(w)
            if rng.random() < added:
                out.append(f"zz{rng.randrange(10**6)}")
        planted = " ".join(out)
        t, p = ids(TEMPLATES[name]), ids(planted)
        pairs = align(t, p)
        good = len(pairs) >= MIN_COVERAGE * len(t) and len(pairs) >= MIN_DENSITY * (pairs[-1][1] + 1 - pairs[0][1])
        truth[k] = (name, len(pairs) / len(t)) if good else None
        data.append((k, f"{prose(rng, rng.randrange(300))} {planted} {prose(rng, rng.randrange(300))}"))
    found = [v for v in truth.values() if v]
    assert 40 < len(found) < 110
    for r in scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect():
        if truth[r.doc_id]:
            assert truth[r.doc_id][0] in r.licenses and r.coverage >= truth[r.doc_id][1] - 1e-9


@pytest.mark.parametrize(("name", "lost"), [("MIT", 14), ("BSD-2-Clause", 11), ("GPL-3.0", 7), ("Apache-2.0", 12)])
def test_licenses_without_rare_words(name, lost):
    """Words that a template has once are lost first; nothing that still covers enough is passed over."""
    import numpy as np

    from folio.llm.licenses import TEMPLATES, Matcher

    w = TEMPLATES[name].split()
    once = [k for k, x in enumerate(w) if w.count(x) == 1][:lost]
    raw = np.frombuffer(("foo bar " * 30 + " ".join(x for k, x in enumerate(w) if k not in once)).encode(), np.uint8)
    matcher = Matcher(TEMPLATES)
    best = matcher.chunk(raw, np.array([0, len(raw)]))[0][0]
    assert matcher.names[best[1]] == name and best[0] > 0.8


def test_licenses_apart_and_together():
    import numpy as np

    from folio.llm.licenses import TEMPLATES, Matcher

    matcher = Matcher(TEMPLATES)

    def found(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return [(matcher.names[x[1]], x[0], *x[3:]) for x in matcher.chunk(raw, np.array([0, len(raw)]))[0]]

    spread = " ".join(w + (" bar" if k % 2 else "") for k, w in enumerate(TEMPLATES["MIT"].split()))
    for offset in (0, 40, 60, 100):
        assert found("foo " * offset + spread)[0][:3] == ("MIT", 1.0, offset)
    for offset in range(8):
        assert found("foo " * offset + "Released under the MIT License. " * 5) == [("MIT-notice", 1.0, offset + 5 * k, offset + 5 * k + 5) for k in range(5)]


def place(number, n, seed=0):
    """Feistel network with cycle walking in plain integers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    keys = [mixed(((r * 0x9E3779B97F4A7C15) + seed) & M) for r in range(1, 7)]
    while True:
        left, right = number >> half, number & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        number = left << half | right
        if number < n:
            return number


def test_sharding_by_hand(spark):
    from folio.llm.sharding import assign, shard_rows

    rng = random.Random(25)
    data = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a", "é", prose(rng, 3)]), k % 3) for k in range(200)] + [(7, "same", 1)] * 9
    df = spark.createDataFrame(data, "doc_id long, text string, slot int")
    row = lambda i, t: (i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8)
    order = sorted(row(i, t) for i, t, _ in data)
    expected = collections.Counter((*r, *divmod(place(k, len(order)), 5)[::-1]) for k, r in enumerate(order))
    got = collections.Counter((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.shard, r.slot) for r in assign(df.repartition(6), 5).collect())
    assert got == expected
    laid = [sorted(map(str, shard_rows(df.repartition(n), 5).collect())) for n in (1, 7)]
    assert laid[0] == laid[1]


def test_quality_by_hand(spark):
    from folio.llm.quality import LINE_LIMIT, REPEAT_LIMITS, quality

    rng = random.Random(26)
    data = []
    for k in range(150):
        parts = [prose(rng, rng.randrange(3, 14)) for _ in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(parts) + rng.choice(["", " x"]))
        data.append((k, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    for k in range(150, 170):  # short lines that repeat make no window of five words
        parts = [prose(rng, 4, 5000) for _ in range(12)]
        for i in range(0, 24, 2):
            parts.insert(i, "one short line")
        data.append((k, "\n".join(parts)))
    verdicts = collections.Counter()
    for r in quality(spark.createDataFrame(data, "doc_id long, text string")).collect():
        t = data[r.doc_id][1]
        w = words(t)
        total, fine = sum(map(len, w)), True
        for n, most in REPEAT_LIMITS.items():
            seen, again = set(), set()
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in seen:
                    again.update(range(k, k + n))
                seen.add(g)
            share = sum(len(w[k]) for k in again) / total
            assert abs(r[f"repeat_share_{n}"] - share) < 1e-12
            fine = fine and share <= most
        seen, chars = set(), 0
        for line in t.split("\n"):
            if words(line) and line in seen:
                chars += sum(map(len, words(line)))
            seen.add(line)
        assert abs(r.line_share - chars / total) < 1e-12
        fine = fine and chars / total <= LINE_LIMIT
        assert r.kept == (fine and not r.base_failed)
        verdicts[r.kept, r.base_failed] += 1
    assert min(verdicts[True, False], verdicts[False, False], verdicts[False, True]) >= 3


def test_long_pretokens(spark):
    """A megabyte without a space, of several kinds, equal to the library and in seconds."""
    import time

    tokenizers = pytest.importorskip("public_tokenizers")
    sp = pytest.importorskip("sentencepiece")
    from folio.llm.tokens import LONG, vocabulary

    path = str(tokenizers.path("piece_bpe_32k.model"))
    model, vocab = sp.SentencePieceProcessor(model_file=path), vocabulary(path)
    rng = random.Random(27)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    some = ["the", "and", "ing", "tion", "er", "un", "##", "--", "日本", "é"]
    texts = [run(a, n) for a in ("ab", "the", "#-=", "xX1", "日本語テスト", "abcdefghijklmnopqrstuvwxyz+/") for n in (LONG - 1, LONG, LONG + 1, 700, 5000)]
    texts += [run(some, 400) for _ in range(60)] + ["x" * 100_000, "-" * 77_777, run(some, 20_000)]
    for t in texts:
        assert vocab.counts([t])[0] == len(model.encode(t))
    long = run("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 1_000_000)
    began = time.time()
    assert vocab.counts([long])[0] == len(model.encode(long))
    assert time.time() - began < 30


def canonical(text):
    from folio.llm.decontaminate import UNITS

    t = re.sub("[\x01-\x03]", " ", text)
    t = re.sub(r"([a-z,;:])\s+(?=[A-Z][a-z])", "\\1 \x02", t).lower()
    t = re.sub(rf"(?<![a-z0-9])([0-9](?:[0-9.,]*[0-9])?)(?![a-z0-9])(?:\s?({UNITS})(?![a-z0-9]))?", lambda m: f"\x01{m[1]} " + (f"\x03{m[2]}" if m[2] else ""), t)
    return re.sub("[^a-z0-9\x01-\x03\\s]+", "", t).split()


def windows(w, width):
    for k in range(len(w) - width + 1):
        part = w[k : k + width]
        slots = tuple(x for x in part if x < "\x04")
        literal = len(slots) <= width - 3
        yield k, tuple(x[0] if x < "\x04" and literal else x for x in part), slots


def leaked(docs, items):
    out = set()
    for i, doc in docs:
        for j, item in items:
            size = len(canonical(item))
            width = min(5, size)
            if width < 3:
                continue
            known = collections.defaultdict(set)
            for shift, w in ((0, canonical(item)), (1, canonical("a " + item))):
                for k, template, slots in windows(w, width):
                    if k >= shift:
                        known[template].add((k - shift, slots))
            hits = {(k - at, at, s, t) for k, template, s in windows(canonical(doc), width) for at, t in known.get(template, ())}
            values = collections.defaultdict(set)
            for shift, _, s, t in hits:
                for x, y in zip(s, t):
                    values[shift, y].add(x)
            good = {at for shift, at, s, t in hits if s == t or not any(len(values[shift, y]) > 1 for y in t)}
            covered = {at + k for at in good for k in range(width)}
            if covered and (100 * len(covered) >= 80 * size or len(covered) >= 24):
                out.add((i, j, len(covered)))
    return out


def test_leaks_by_hand(spark):
    from folio.llm.decontaminate import leaks

    rng = random.Random(28)
    parts = ["Anna", "Boris", "Carla", "12", "7", "3.5 km", "40 kg", "9 days", "gave", "took", "walked", "to", "the", "old", "river", "and", "then", "bread", "apples", "home", "with", "before"]
    items = [(k, " ".join(rng.choice(parts) for _ in range(rng.choice([2, 3, 4, 5, 6, 12, 30, 60])))) for k in range(40)]
    docs = []
    for k in range(160):
        w = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(["Dora", "88", "5", "water", "Anna", "road"])
        text = " ".join(w) if k % 2 else re.sub(r"Anna", "Greta", re.sub(r"\b12\b", "31", " ".join(w)))
        docs.append((k, f"{prose(rng, 8)}{rng.choice([' ', '. ', chr(10), ', '])}{text}{rng.choice(['', '.', ' '])} {prose(rng, 8)}"))
    expected = leaked(docs, items)
    got = {(r.doc_id, r.item_id, r.covered_words) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expected) > 60 and got == expected


def test_language_by_hand(spark, monkeypatch):
    from folio.llm import langid

    rng = random.Random(29)
    parts = {"aa": ["ba", "na", "ta", "ra"], "ee": ["bé", "né", "tê", "re"], "zz": ["漢", "字", "かな", "ナ"]}
    data = [(k, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(20)), x) for k in range(240) for x in [sorted(parts)[k % 3]]]
    data += [(900, "BANA tara 12 né", None), (901, "😀 ok", None), (902, "12 34", "aa"), (903, "ba " * 40_000, None)]
    seen = []
    real = langid._predict
    monkeypatch.setattr(langid, "_predict", lambda *a: seen.append(a) or real(*a))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    (names, weights, temperature, idf), = seen

    def counts(text):
        out = collections.Counter()
        c = [x if (x >= 0x3000 or chr(x).isalpha()) else 32 for x in map(ord, text.lower())]
        for n in (1, 2, 3):
            for k in range(len(c) - n + 1):
                h = sum(x * m for x, m in zip(c[k : k + n], (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) & M
                out[mixed(h) >> (64 - langid.BITS)] += 1
        return out

    for i, t, _ in data:
        if not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = {b: math.log1p(n) * float(idf[b]) for b, n in counts(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        s = [sum(v / norm * float(weights[b, k]) for b, v in x.items()) / temperature for k in range(len(names))]
        p = [math.exp(v - max(s)) for v in s]
        best = max(range(len(p)), key=p.__getitem__)
        assert abs(got[i].score - p[best] / sum(p)) < 1e-4 and (got[i].lang_pred == names[best] or sorted(p)[-1] - sorted(p)[-2] < 1e-4)

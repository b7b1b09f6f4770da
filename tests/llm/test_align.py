"""Alignment of two tokenizers against a plain scan of both sequences."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from folio.llm import align as al  # noqa: E402
from folio.llm._text import kept_safe  # noqa: E402

PATHS = tuple(str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    "Straße naïve 東京 the quick brown fox",
    None,
    "",
    " ",
    "a",
    "a<s> </s> <|endoftext|> <unk> <0x0A>\n\n\ttab",
    "holds ▁ itself",
    "emoji 👩‍🚀 zwj and \u0000 nul",
    "internationalization " * 40,
    "x" * 5000,
    "1234567890 3.14159, e.g. don't",
]


def plain(texts):
    """Per text: A ids, B ids, groups (by walking both), links; the columns of the contract from these."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(PATHS[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = al.byte_alphabet()
    docs, total = [], Counter()
    for t in texts:
        want = f" {t or ''}".encode()
        a = a_tok.encode(want.decode(), add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_bytes = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([i - 3]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        spans = [np.cumsum([0, *map(len, x)]).tolist() for x in (a_bytes, b_bytes)]
        both = sorted(set(spans[0][1:]) & set(spans[1][1:]))
        groups, i, j = [], 0, 0
        for end in both:
            ga, gb = [], []
            while i < len(a) and spans[0][i + 1] <= end:
                ga.append(a[i])
                i += 1
            while j < len(b) and spans[1][j + 1] <= end:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        found = []
        for x in range(len(a)):
            found += [(a[x], b[y]) for y in range(len(b)) if spans[0][x] < spans[1][y + 1] and spans[1][y] < spans[0][x + 1]]
        total.update(found)
        docs.append((len(a), len(b), groups, found))
    most = Counter()
    for (x, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for n_a, n_b, groups, found in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(found), sum(total[p] == most[p[1]] for p in found), sum(total[p] for p in found), digest))
    return out


def op11(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, N_A string")
    aligned = al.align(df, *PATHS).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    out = al.weighed(kept_safe(aligned.drop("groups")))
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha) for r in out.collect()}


def test_texts_of_all_kinds(spark):
    got = op11(spark, [(k, t, "x") for k, t in enumerate(TEXTS)])
    assert got == dict(enumerate(plain(TEXTS)))
    assert got[6][:4] == (0, 0, 0, 0) and got[6][6] == ""


def test_random_texts_in_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "straße", "東京", "é", "<s>", "▁", "\n", "  ", "unbelievable", "0x1F", "🚀", "aaaaaaaaaaaa", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += texts[:7]  # repeated rows count each time
    monkeypatch.setattr(al, "BLOCK_BYTES", 300)
    assert op11(spark, [(k, t, None) for k, t in enumerate(texts)]) == dict(enumerate(plain(texts)))


ALPHABET = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u0085", "\u3000", "\u2003", "\u200b", "\u0000", "a", "Ab", "é", "ñ", "ß", "Ж", "а", "東", "🚀", "\u0301", "▁", "'s", "'ll", ")", "();", "{", "42", "<s>", "<|endoftext|>", "_", "½"]


@pytest.fixture(scope="module")
def encoders():
    return al.Encoders(*PATHS)


@pytest.mark.parametrize("seed", range(25))
def test_stretches_give_the_tokens_of_whole_texts(encoders, monkeypatch, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", " ", "x"]
    monkeypatch.setattr(al, "CALL_BYTES", rng.choice((1, 50, 4096)))
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    sides = encoders.encode(np.frombuffer("".join(texts).encode(), np.uint8), off)
    a = [encoders.a.encode(f" {t}", add_special_tokens=False).ids if t else [] for t in texts]
    b = [encoders.b.encode(t) for t in texts]
    for k, t in enumerate(texts):
        want, whole = f" {t}".encode(), (encoders.a_bytes, encoders.b_bytes)
        good = t and all(b"".join(x[i] for i in r) == want for x, r in zip(whole, (a[k], b[k])))
        for side, ids in zip(sides, (a[k], b[k])):
            assert side.ids[side.ptr[k] : side.ptr[k + 1]].tolist() == (ids if good else []), t


def test_each_different_stretch_is_encoded_once(encoders, monkeypatch):
    seen = []
    real = al.Encoders.together
    monkeypatch.setattr(al.Encoders, "together", lambda self, texts: seen.extend(texts) or real(self, texts))
    text = b"the cat saw the dog and the cat saw \xc3\xa9t\xc3\xa9 the dog"
    encoders.encode(np.frombuffer(text * 3, np.uint8), len(text) * np.arange(4))
    assert sorted(seen) == ["and", "cat", "dog", "saw", "the", "été"]


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    rows = al.weighed(kept_safe(al.align(df, *PATHS).drop("groups"))).collect()
    assert sorted((r.doc_id or -1, r.n_a, r.count_sum) for r in rows) == [(-1, 2, 6), (4, 2, 6), (4, 2, 6)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert al.weighed(kept_safe(al.align(df, *PATHS).drop("groups"))).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_common_ends(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    dense = rng.random() < 0.5
    a, b = ([np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, n + 1) if dense else rng.integers(1, 4))), n)) for _ in range(3)] for _ in "ab")
    base = np.array([0, n, 2 * n])
    ptr = np.cumsum([0, *map(len, a)])
    a_ends, b_ends = (np.concatenate([x + k for x, k in zip(s, base)]) for s in (a, b))
    got = al.cuts(a_ends, b_ends, ptr[:-1], ptr[1:])
    assert got.tolist() == np.flatnonzero(np.isin(a_ends, b_ends)).tolist()


def test_pair_counts_are_of_the_corpus(spark):
    df = spark.createDataFrame([(k, "the cat and the dog") for k in range(5)], "doc_id long, text string")
    aligned = kept_safe(al.align(df, *PATHS))
    assert aligned.select("n_links").groupBy().sum().first()[0] == al.pair_counts(aligned).groupBy().sum("n").first()[0] == 25

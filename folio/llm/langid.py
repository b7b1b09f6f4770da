"""Language prediction by sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of 1 to 3 characters are hashed to buckets; document frequencies come from all training
texts; the weights are trained with follow-the-regularised-leader and an elastic-net penalty on a
bounded sample of training texts, and a temperature fitted on a held-back part of that sample
calibrates the probabilities.

Defined results: text that is null or has no letter gives `und` with score 0; with no training
rows at all every text gives `und`; with one language everything else gives it with score 1; ties
go to the language that sorts first; of a training doc_id's rows the first by language and counts
is learned from; every row is predicted by itself, so repeated rows repeat the result; a very long
text is read whole; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import _text as tx

BITS = 14
#: Training texts that the weights are fitted on (document frequencies use all).
MAX_TRAIN = 3000
EPOCHS = 2
#: Follow-the-regularised-leader: step, offset, and L1 and L2 penalties (the elastic net).
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"
_A, _B, _C = (tx.U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; whatever is no letter counts as one kind of gap."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = c < 0x3000
    c = np.where(low & ~_LETTER[np.where(low, c, 0)], 32, c).astype(tx.U64)
    shift = tx.U64(64 - BITS)
    one = c * _A
    parts = [tx.mix(one) >> shift]
    if len(c) > 1:
        two = one[:-1] + c[1:] * _B
        parts.append(tx.mix(two) >> shift)
    if len(c) > 2:
        parts.append(tx.mix(two[:-1] + c[2:] * _C) >> shift)
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.log1p(n) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket that the task has seen."""
    seen, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen[ngrams(text)[0]] += 1
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and counts of whole texts, as bytes."""
    for batch in batches:
        bags = [ngrams(text) for text in batch.column(2).to_pylist()]
        at, n = (pa.array([x[k].astype(np.int32).tobytes() for x in bags], pa.binary()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, n], ["doc_id", "lang", "buckets", "counts"])


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray) -> tuple[list[str], np.ndarray, float]:
    """Languages, weights (buckets x languages) and temperature, from buckets and counts; every fifth text is held back for the last."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    docs = [vector(at, n, idf) for at, n in bags]
    z = np.zeros((1 << BITS, len(names)))
    g2 = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2))

    fit = [k for k in range(len(docs)) if k % 5 or len(docs) < 50]
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            at, x = docs[k]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] += g * g
    w = weights(slice(None))
    held = [k for k in range(len(docs)) if k % 5 == 0] or fit
    scores = np.array([docs[k][1] @ w[docs[k][0]] for k in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())

    return names, w.astype(np.float32), min(np.geomspace(0.05, 5, 60).tolist(), key=loss)


def _predict(names: list[str], w: np.ndarray, temperature: float, idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column(2).to_pylist():
                if not names or not text or not any(map(str.isalpha, text)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                at, x = vector(*ngrams(text), idf)
                s = (x @ w[at]) / temperature
                p = np.exp(s - s.max())
                k = int(p.argmax())
                lang.append(names[k])
                score.append(min(1.0, float(p[k] / p.sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out_fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of docs (doc_id, text, lang).

    Only the document frequencies (one number per bucket) and the bucket counts of at
    most max_train whole texts reach the driver, and of the weights each task gets buckets x languages numbers.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    total = known.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = int(total.n[total.bucket < 0].sum())
    idf = np.full(1 << BITS, np.log(1.0 + n))
    real = total[total.bucket >= 0]
    idf[real.bucket.to_numpy()] = np.log((1.0 + n) / (1.0 + real.n.to_numpy()))
    picked = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_train)
    counts = tx.pick(known, picked, "doc_id").select("doc_id", "lang", "text").mapInArrow(_counts, "doc_id long, lang string, buckets binary, counts binary")
    sample = counts.groupBy("doc_id").agg(F.min(F.struct("lang", "buckets", "counts")).alias("x")).select("doc_id", "x.*").toPandas()
    sample = sample.sort_values("doc_id", kind="stable", na_position="last")
    sample = sample.iloc[np.random.Generator(np.random.PCG64(3)).permutation(len(sample))]
    bags = [(np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)) for at, n in zip(sample.buckets, sample.counts)]
    model = train(bags, sample.lang.tolist(), idf) if bags else ([], np.zeros((1 << BITS, 0), np.float32), 1.0)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(*model, idf), "doc_id long, held_out boolean, lang_pred string, score double")

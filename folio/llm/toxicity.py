"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features are the presence of hashed words and word beginnings.  All ordered thresholds share one
weight vector: P(grade > k) = sigmoid(w.x - b_k), with b rising in k; the weights carry an L1
penalty, so most are zero.  Labels only say toxic or not; grades 1 to 3 of toxic rows are the
terciles of how many telling features (screened by odds and chi-square on the labels) they hold.  Output is the expected
severity, sum over k of P(grade > k).

Defined results: null or wordless text has severity 0 and is not toxic; without both kinds of
label nothing is toxic; a doc_id labelled more than once is toxic if one label says so; of several
texts of a labelled doc_id the first in byte order is learned from; every row stands alone, so
repeated rows repeat the result; a very long text is read whole, as a chunk of its own; an empty
table gives an empty one; extra columns are ignored by `severity` and kept by `drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _text as tx

BITS = 20
#: Labelled documents that the model is fitted on.
MAX_TRAIN = 8000
GRADES = 3
PREFIXES = (4, 5)
L1, STEPS = 2e-5, 500
#: A feature takes part if toxic rows have it more often, by this log odds ratio and chi-square (one degree of freedom).
MIN_ODDS, MIN_CHI2 = 1.0, 15.0
#: A text is toxic when P(grade > 0) exceeds a cut set on the labelled sample: half as much again as
#: all but this share of clean rows reach, within these bounds.
CLEAN_ABOVE, CUT_BOUNDS = 5e-4, (0.2, 0.5)
GAPS = tx.SPACE.copy()
GAPS[[b for b in range(128) if not chr(b).isalnum()]] = True


class Model(NamedTuple):
    weights: np.ndarray
    bounds: np.ndarray
    cut: float


def features(data: np.ndarray, off: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every different feature of each text of a chunk; with keep, only features it marks."""
    w = tx.words(data, off, lower=True, gaps=GAPS)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(w.ptr))
    hashes, docs = [w.hashes], [doc]
    for n in PREFIXES:
        long = w.ends - w.starts > n
        hashes.append(tx.mix(w.spans(w.starts[long], w.starts[long] + n) + tx.U64(n)))
        docs.append(doc[long])
    f = (np.concatenate(hashes) >> tx.U64(64 - BITS)).astype(np.int64)
    d = np.concatenate(docs)
    if keep is not None:
        hit = keep[f]
        f, d = f[hit], d[hit]
    both = np.unique(d << BITS | f)
    return both >> BITS, both & ((1 << BITS) - 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tx.buffers(batch.column(1))
        rows = []
        for i, j in tx.chunks(off):
            d, f = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            rows += [x.astype(np.int32).tobytes() for x in np.split(f, np.searchsorted(d, np.arange(1, j - i)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["toxic", "features", "doc_id"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def odds(toxic: np.ndarray, row: np.ndarray, col: np.ndarray, n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds ratio and chi-square of each feature's presence in toxic against clean rows."""
    n, t = float(len(toxic)), float(toxic.sum())
    yes, both = np.bincount(col, toxic[row], n_cols), np.bincount(col, minlength=n_cols)
    no = both - yes
    ratio = np.log((yes + 0.5) / (t - yes + 0.5)) - np.log((no + 0.5) / (n - t - no + 0.5))
    chi2 = n * (yes * (n - t - no) - no * (t - yes)) ** 2 / np.maximum(t * (n - t) * both * (n - both), 1)
    return ratio, chi2


def grades(toxic: np.ndarray, row: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic rows by terciles of their number of features that take part."""
    count = np.bincount(row, minlength=len(toxic))
    cuts = np.quantile(count[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    return np.where(toxic == 1, 1 + (count[:, None] > cuts).sum(axis=1), 0)


def fit(toxic: np.ndarray, bags: list[np.ndarray]) -> Model | None:
    """Proximal gradient, scaled by coordinate, on the cumulative-link loss with an L1 penalty; None if a label is missing."""
    toxic = toxic.astype(float)
    if not 0 < toxic.sum() < len(toxic):
        return None
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    ids, col = np.unique(np.concatenate(bags), return_inverse=True)
    ratio, chi2 = odds(toxic, row, col, len(ids))
    telling = (ratio >= MIN_ODDS) & (chi2 >= MIN_CHI2)
    row, col = row[telling[col]], (np.cumsum(telling) - 1)[col[telling[col]]]
    ids = ids[telling]
    y = grades(toxic, row)
    n, k = len(y), GRADES
    above = (y[:, None] > np.arange(k)).astype(float)
    w, b = np.zeros(len(ids)), np.linspace(1.0, 3.0, k)
    gw, gb = np.full(len(ids), 1e-8), np.full(k, 1e-8)
    for _ in range(STEPS):
        s = np.bincount(row, w[col], n)
        err = (_sigmoid(s[:, None] - b) - above) / n
        g = np.bincount(col, err.sum(axis=1)[row], len(ids))
        h = -err.sum(axis=0)
        gw, gb = gw + g * g, gb + h * h
        step = 0.5 / np.sqrt(gw)
        w = w - step * g
        w = np.maximum(w - step * L1, 0)  # telling features only speak for a higher grade
        b = np.sort(b - 0.5 / np.sqrt(gb) * h)
    dense = np.zeros(1 << BITS, np.float32)
    dense[ids] = w
    p = _sigmoid(np.bincount(row, w[col], n) - b[0])
    return Model(dense, b, float(np.clip(1.5 * np.quantile(p[toxic == 0], 1 - CLEAN_ABOVE), *CUT_BOUNDS)))


def _score(model: Model):
    at = np.flatnonzero(model.weights)
    small = (at, model.weights[at], model.bounds, model.cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, bounds, cut = small
        dense = np.zeros(1 << BITS)
        dense[at] = values
        marked = dense != 0
        for batch in batches:
            data, off = tx.buffers(batch.column(1))
            sums, words = [], []
            for i, j in tx.chunks(off):
                part, edge = data[off[i] : off[j]], off[i : j + 1] - off[i]
                d, f = features(part, edge, marked)
                sums.append(np.bincount(d, dense[f], j - i))
                solid = np.concatenate([[0], np.cumsum(~GAPS[part])])
                words.append(np.diff(solid[edge]) > 0)
            s = np.concatenate(sums) if sums else np.zeros(0)
            p = _sigmoid(s[:, None] - bounds) * (np.concatenate(words) if words else np.zeros(0))[:, None]
            cols = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p > cut).sum(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "severity", "p_toxic", "grade"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Model from at most max_train labelled documents, the first in a fixed hash order of their ids."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_train)  # bounded: broadcast below
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    once = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = once.select("toxic", "text", "doc_id").mapInArrow(_extract, "toxic int, features binary, doc_id long").toPandas().sort_values("doc_id")
    return fit(sample.toxic.to_numpy(), [np.frombuffer(x, np.int32) for x in sample.features]) if len(sample) else None


def severity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic, grade, toxic; one row per row of docs."""
    model = train(docs, labels, max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    out = rows.mapInArrow(_score(model), "doc_id long, severity double, p_toxic double, grade int")
    return out.withColumn("toxic", F.col("p_toxic") > model.cut)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs without the rows that the model finds toxic, all columns as they were; only texts go to Python, and nothing is joined."""
    model = train(docs, labels, max_train)
    if model is None:
        return docs
    run = _score(model)

    @F.arrow_udf("double")
    def p_toxic(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = (pa.RecordBatch.from_arrays([pa.nulls(len(t), pa.int64()), t], ["doc_id", "t"]) for t in texts)
        for out in run(rows):
            yield out.column(2)

    p = tx.free("_p_toxic", docs.columns)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.withColumn(p, p_toxic(text)).where(F.col(p) <= model.cut).drop(p)

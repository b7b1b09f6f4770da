"""Repetition coverage and simple counts of whole texts.

Rolling hashes of several window lengths mark the words that lie in a window seen earlier in the
same text; the share of characters in marked words, and in repeated lines, gives the verdict.

Defined results: null text counts as empty; a text without words has zero counts and fails the
base rule (under 10 words); ties and repeated rows need no order, every row stands alone; a very
long text is read whole, as a chunk of its own; an empty table gives an empty one; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _text as tx

#: Words of a window -> largest share of word characters in windows seen before.
REPEAT_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters in lines seen before.
LINE_LIMIT = 0.2
BASE_WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_LONG = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SHARES = [f"repeat_share_{n}" for n in REPEAT_LIMITS]
SCHEMA = ", ".join([*(f"{c} long" for c in _LONG), *(f"{c} double" for c in _SHARES), "line_share double"])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    twice[order[:-1]] = same
    return twice | again, again


def _covered(flags: np.ndarray, at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words (of n) inside a flagged window that begins at word `at`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at[flags], 1)
    np.add.at(step, at[flags] + width, -1)
    return np.cumsum(step[:-1]) > 0


def _starts(ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows inside texts, and the text of each."""
    n = np.maximum(np.diff(ptr) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + ptr[:-1][doc], doc


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of SCHEMA (without doc_id) for a chunk of texts."""
    w, docs = tx.words(data, off), len(off) - 1
    letters = np.concatenate([[0], np.cumsum(tx.char_counts(data))])
    chars = letters[w.ends] - letters[w.starts]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.ptr])
    out = {"n_words": np.diff(w.ptr), "word_chars": total(chars), "n_symbols": np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[data])])[off])}

    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], off[np.searchsorted(off, starts, "right")])
    first = np.searchsorted(w.starts, starts)
    last = np.searchsorted(w.starts, ends)
    real = last > first
    starts, ends, first, last = starts[real], ends[real], first[real], last[real]
    doc = np.searchsorted(off, starts, "right") - 1
    again = _runs(tx.mix(w.spans(starts, ends) + doc.astype(tx.U64) * tx.WEIGHTS[1]))[1]
    out["n_dup_lines"] = np.bincount(doc[again], minlength=docs)
    sums = np.concatenate([[0], np.cumsum(chars)])
    share = lambda x: x / np.maximum(out["word_chars"], 1)
    out["line_share"] = share(np.bincount(doc[again], (sums[last] - sums[first])[again], docs))

    rolled = tx.rolling(w.hashes)
    busy = np.ones(docs, bool)  # a text without a repeated window of 5 words has none of more
    for width in REPEAT_LIMITS:
        at, doc = _starts(w.ptr, width)
        at, doc = at[busy[doc]], doc[busy[doc]]
        twice, again = _runs(tx.mix(rolled(width)[at] + doc.astype(tx.U64) * tx.WEIGHTS[2]))
        if width == BASE_WINDOW:
            out["n_repeat_words"] = total(_covered(twice, at, width, len(w.starts)))
            busy = out["n_repeat_words"] > 0
        out[f"repeat_share_{width}"] = share(total(np.where(_covered(again, at, width, len(w.starts)), chars, 0)))
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = tx.buffers(batch.column(1))
        parts = [measure(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in tx.chunks(off)]
        if parts:
            cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in _LONG[1:]]
            cols += [pa.array(np.concatenate([p[c] for p in parts]).astype(float)) for c in (*_SHARES, "line_share")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [*_LONG, *_SHARES, "line_share"])


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): the counts, base_failed, kept, and the shares behind the verdict."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, SCHEMA)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    fine = F.col("line_share") <= LINE_LIMIT
    for n, most in REPEAT_LIMITS.items():
        fine = fine & (F.col(f"repeat_share_{n}") <= most)
    return out.select(*_LONG, failed.alias("base_failed"), (~failed & fine).alias("kept"), *_SHARES, "line_share")

"""Fill-in-middle transformation by displacement scatter, and its inverse.

Each text is cut at two places into prefix, middle and suffix, and the parts are laid out with
sentinels between them.  A batch of texts is one byte array: difference arrays, written at the
cuts, add up to the shift of every byte, one scatter builds all outputs, and reading back gathers
with the shifts found from the sentinels of the outputs alone.

Cuts depend on doc_id and the text's length only: h1 to h4 are the first four 8-digit groups of
the hex sha256 of "1:" and the decimal doc_id, read as unsigned integers.

Defined results: null text reads as empty; an empty text, or one that holds a sentinel itself, is
plain (the text as it is, null prefix_chars and middle_chars); a null doc_id reads as no digits;
a part may be empty; a very long text is moved whole, as an array of its own; every row stands
alone, so repeated rows repeat the result; an empty table gives an empty one; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from folio.llm import _text as tx

SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of the texts that stay plain, and of the others that begin with the suffix.
PLAIN, SPM = 10, 20
_MARKS = np.array([list(s.encode()) for s in SENTINELS], np.uint8)


def plan_cuts(docs: DataFrame, plain: int = PLAIN, spm: int = SPM, seed: str = "1") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars; expressions only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("n", F.char_length("text").cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.withColumn("digest", digest).withColumns({f"h{k + 1}": c for k, c in enumerate(h)})
    held = F.col("n") == 0
    for s in SENTINELS:
        held = held | F.contains("text", F.lit(s))
    form = F.when(held | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumn("form", form).withColumns({"a": F.col("h1") % (F.col("n") + 1), "b": F.col("h2") % (F.col("n") + 1)})
    cut: Column = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.least("a", "b")).alias("prefix_chars"), F.when(cut, F.abs(F.col("a") - F.col("b"))).alias("middle_chars"))


def _shifts(n: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Shift of each of n bytes where the segment that begins at at[k] (ascending) moves to to[k]."""
    by = to - at
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, np.diff(by, prepend=0))  # an empty segment adds its step at the place of the next one
    return np.cumsum(steps[:n])


def _laid(off: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts at off[k]:off[k + 1], cut at two bytes each: places of all segments in the outputs, outputs' bounds, sentinels' places by number (-1: none)."""
    cuts = np.stack([off[:-1], first, second], 1)
    sizes = np.diff(np.concatenate([cuts, off[1:, None]], 1))  # prefix, middle, suffix
    extra = np.where(form > 0, 3 * len(SENTINELS), 0)
    out = np.concatenate([[0], np.cumsum(np.diff(off) + extra)])
    base, (prefix, middle, suffix) = out[:-1], sizes.T
    psm, spm = form == 1, form == 2
    p = np.where(spm, suffix + 6, np.where(psm, 3, 0))
    m = np.where(form > 0, prefix + suffix + 9, prefix)
    s = np.where(spm, 3, np.where(psm, prefix + 6, prefix + middle))
    to = base[:, None] + np.stack([p, m, s], 1)
    marks = np.where(form[:, None] > 0, to[:, [0, 2, 1]] - 3, -1)
    return to, out, marks


def scatter(data: np.ndarray, off: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the outputs; form: 0 plain, 1 psm, 2 spm."""
    to, out, marks = _laid(off, first, second, form)
    made = np.empty(out[-1], np.uint8)
    at = np.stack([off[:-1], first, second], 1).ravel()
    made[np.arange(len(data)) + _shifts(len(data), at, to.ravel())] = data
    for k in range(len(SENTINELS)):
        place = marks[marks[:, k] >= 0, k]
        made[place[:, None] + np.arange(3)] = _MARKS[k]
    return made, out


def gather(made: np.ndarray, out: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts, from outputs and forms alone.

    A text of another form than plain holds no sentinel, and none can arise where a part meets one,
    so each of its outputs has exactly the three that were set.
    """
    n = len(made)
    hit = np.flatnonzero((made[:-2] == _MARKS[0, 0]) & (made[2:] == _MARKS[0, 2]) & np.isin(made[1:-1], _MARKS[:, 1])) if n > 2 else np.zeros(0, np.int64)
    cut = form > 0
    doc = np.searchsorted(out, hit, "right") - 1
    whole = hit + 3 <= out[doc + 1]  # not over the end of an output
    place = hit[whole & cut[doc]].reshape(-1, 3)  # three to each cut text
    spm = form[cut] == 2
    base, end = out[:-1][cut], out[1:][cut]
    first, second, third = place.T
    if not ((first == base) & (made[third + 1] == _MARKS[2, 1])).all():
        raise ValueError("an output does not have the sentinels of its form")
    p_at, s_at, m_at = np.where(spm, second, first) + 3, np.where(spm, first, second) + 3, third + 3
    p_end, s_end = np.where(spm, third, second), np.where(spm, second, third)
    off = np.concatenate([[0], np.cumsum(np.diff(out) - np.where(cut, 9, 0))])
    starts = off[:-1].copy()
    at, to = np.stack([starts] * 3, 1), np.stack([out[:-1]] * 3, 1)
    at[cut] = starts[cut][:, None] + np.stack([np.zeros_like(p_at), p_end - p_at, p_end - p_at + end - m_at], 1)
    to[cut] = np.stack([p_at, m_at, s_at], 1)
    if (off[:-1][cut] + (p_end - p_at) + (end - m_at) + (s_end - s_at) != off[1:][cut]).any():
        raise ValueError("an output does not have the sentinels of its form")
    return made[np.arange(off[-1]) + _shifts(int(off[-1]), at.ravel(), to.ravel())], off


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _forms(column: pa.Array) -> np.ndarray:
    return np.select([np.array(column.to_pylist()) == k for k in ("psm", "spm")], [1, 2], 0) if len(column) else np.zeros(0, np.int64)


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    for batch in batches:
        data, off = tx.buffers(batch.column("text"))
        form = _forms(batch.column("form"))
        prefix, middle = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("prefix_chars", "middle_chars"))
        for i, j in tx.chunks(off):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            chars = np.append(np.flatnonzero(tx.char_counts(part)), len(part))  # byte at which each code point begins
            begin = np.searchsorted(chars, at[:-1])
            made, out = scatter(part, at, chars[begin + prefix[i:j]], chars[begin + prefix[i:j] + middle[i:j]], form[i:j])
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in names], _strings(made, out).cast(pa.string())], [*names, "output"])


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, spm: int = SPM, seed: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points), output; one row per row of docs (doc_id, text)."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return plan_cuts(docs, plain, spm, seed).mapInArrow(_transform, schema)


def _restore(at: int, kind: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, out = tx.buffers(batch.column(at))
            form = _forms(batch.column(kind))
            for i, j in tx.chunks(out):
                text, off = gather(made[out[i] : out[j]], out[i : j + 1] - out[i], form[i:j])
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, _strings(text, off).cast(pa.string())], names)

    return run


def restored(rows: DataFrame, column: str = "restored") -> DataFrame:
    """rows (output, form, ...) with the text that each output was made of; null output reads as empty."""
    at, kind = rows.columns.index("output"), rows.columns.index("form")
    schema = StructType([*rows.schema.fields, StructField(column, StringType())])
    return rows.mapInArrow(_restore(at, kind, [*rows.columns, column]), schema)

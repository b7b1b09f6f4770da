"""Reproducible shuffle of all rows into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in the order of their ids, the number is sent through a keyed
Feistel network on the next even number of bits, walking the cycle until it is below n again, and
the place found gives shard (place mod shards) and slot (place div shards).  So any row's place
can be computed from its number, and shards differ by one row at most.

Defined results: null text has no bytes; null ids sort first; of one id, rows are ordered by
checksum, size and a hash of the row, so places do not depend on how the table is laid out; repeated
rows get numbers (and so places) of their own; a very long text is one row like any other; an empty
table gives an empty one; extra columns are ignored by `assign` and kept by `shard_rows`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm._text import kept_safe, mix

ROUNDS = 6
OVERHEAD_BYTES = 8
#: Bytes that a partition of rows to be numbered should hold, and bytes of a narrow row.
PARTITION_BYTES, NARROW = 1 << 27, 64


def permute(x: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Image of each number below n under the seed's permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    x = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def numbered(rows: DataFrame, *order: str, row_bytes: Column | None = None) -> DataFrame:
    """rows with row_no, 0 to n - 1 in the given order, and n_rows.

    Sorted by range over as many partitions as the rows fill (row_bytes each, NARROW if not given);
    the row counts of the partitions, one small row each, give every partition's first number.
    Rows equal in all order columns must be alike; a tie number spreads them, so no value has to
    fit one partition.
    """
    spark = rows.sparkSession
    filled = rows.agg(F.sum(F.lit(NARROW) if row_bytes is None else row_bytes)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), filled // PARTITION_BYTES + 1)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    laid = kept_safe(tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    counts = sorted((r[0], r[1]) for r in laid.groupBy("_part").count().collect())
    first, total = [], 0
    for part, n in counts:
        first.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(first, "_part long, _base long"))
    out = laid.join(base, "_part").withColumn("row_no", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.withColumn("n_rows", F.lit(total).cast("long")).drop("_tie", "_at", "_part", "_base")


def _place(seed: int):
    @F.pandas_udf("long")
    def place(row: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), int(n.iloc[0]), seed)) if len(row) else row

    return place


def _measures() -> list:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD_BYTES
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return [F.col("doc_id").cast("long").alias("_id"), size.alias("_size"), crc.alias("_crc")]


def _shard(place: str, shards: int):
    return (F.col(place) % shards).cast("int").alias("shard"), F.floor(F.col(place) / F.lit(shards)).cast("long").alias("slot")


def assign(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard; one row per row of docs.

    The text is read for its size and checksum where it lies and never shuffled.
    """
    at = numbered(docs.select(*_measures()), "_id", "_crc", "_size").withColumn("_place", _place(seed)("row_no", "n_rows"))
    return at.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), *_shard("_place", shards), F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """docs with shard and slot (columns of those names are replaced); every row, repeated ones too, has a slot of its own."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(F.struct(*names)).alias("_mark"), *_measures())
    at = numbered(rows, "_id", "_crc", "_size", "_mark", row_bytes=F.col("_size") + NARROW).withColumn("_place", _place(seed)("row_no", "n_rows"))
    return at.select("row.*", *_shard("_place", shards))

"""Exact top-k search by inner product: columnar branch-and-bound over dimension blocks.

Rows are dealt into cells, and every query is sent to every cell.  In its task a cell is a few
tiles in vertical layout (one array per dimension).  For each tile scores grow by one block of
dimensions at a time; what the dimensions to come can still add is bounded by the remaining mass
(the product of the norms of the rest of both vectors), candidates that can no longer reach the
query's k-th best are compacted away, and the few that are left at the end have their exact score.
Each cell gives its k best of each query, the k best of these are the result.

A vector is floor(1024 * x) of its components, read as doubles; scores are integers.

Defined results: vectors that are null, or hold null or a component that is not finite, and rows
without vec_id take no part; of vectors of different lengths, the missing components are 0 (a vector
without components scores 0); of ties the smaller vec_id comes first; repeated rows of one vec_id and
vector count once, rows of one vec_id with different vectors are each a candidate and each a query
(their lists are told apart by query_no), but not for each other; components and scores beyond 64 bits
are set to the nearest long; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm._text import kept_safe

SCALE = 1024
#: Bytes of vectors (8 a component) that a cell should hold, rows of a tile, queries handled at once, dimensions of a block.
CELL_BYTES, TILE, QUERIES, BLOCK = 1 << 26, 4096, 256, 16
_LOW, _HIGH, _EDGE = -(1 << 63), (1 << 63) - 1, 2.0**63


def quantised(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 * x) as int64, one row each, filled up with zeros to dims."""
    n, flat = np.asarray(column.value_lengths()).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), dims), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * flat)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = np.where(x >= _EDGE, _HIGH, np.where(x >= _EDGE, 0, np.maximum(x, -_EDGE)).astype(np.int64))
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of one vector with the columns of c, set to the nearest long."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (q, c)]
    if most[0] * most[1] * max(1, len(q)) < 2.0**62:
        return q @ c
    return np.array([min(max(sum(a * b for a, b in zip(q.tolist(), x)), _LOW), _HIGH) for x in c.T.tolist()], np.int64)


class Tile:
    """Candidates in vertical layout, with the norm of what is left of each after every block of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.whole = ids, np.ascontiguousarray(vectors.T)
        self.real = self.whole.astype(np.float64)
        self.starts = range(0, len(self.real), BLOCK)
        self.left = _left(self.real, self.starts)


def _left(columns: np.ndarray, starts: range) -> np.ndarray:
    """Row b: norms of the dimensions from block b on; a last row of zeros."""
    mass = np.array([(columns[s : s + BLOCK] ** 2).sum(axis=0) for s in starts]).reshape(len(starts), columns.shape[1])
    return np.sqrt(np.concatenate([np.cumsum(mass[::-1], axis=0)[::-1], np.zeros((1, columns.shape[1]))]))


def search(tile: Tile, ids: np.ndarray, queries: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
    """Brings best, the k best (scores, vec_ids) so far of each query, up to date with a tile."""
    if not len(ids):
        return
    real = queries.T.astype(np.float64)
    q_left, steps = _left(real, tile.starts), list(tile.starts)
    slack = (len(real) + 1) * 1e-15  # of the product of both norms: what sums of doubles can be off by
    first = real[:BLOCK].T @ tile.real[:BLOCK] if steps else np.zeros((len(ids), len(tile.ids)))
    for i in range(len(ids)):
        own, known = tile.ids != ids[i], best[i][0]
        bar = float(known[-1]) if len(known) == k else -np.inf
        at, score = np.flatnonzero(own), first[i][own]
        for b in range(1, len(steps) + 1):
            rest = q_left[b, i] * tile.left[b, at] + slack * q_left[0, i] * tile.left[0, at]
            if len(at) > k:  # the k-th best of what the candidates have for certain
                bar = max(bar, float(np.partition(score - rest, len(at) - k)[len(at) - k]))
            bar = min(bar, _EDGE) if bar > -_EDGE else -np.inf  # scores beyond are equal
            stay = score + rest >= bar - abs(bar) * 1e-15
            at, score = at[stay], score[stay]
            if b < len(steps) and len(at):
                s = steps[b]
                score = score + real[s : s + BLOCK, i] @ tile.real[s : s + BLOCK, at]
        if len(at):
            scores, vec = np.concatenate([known, exact(queries[i], tile.whole[:, at])]), np.concatenate([best[i][1], tile.ids[at]])
            top = np.lexsort((vec, ~scores))[:k]  # ~ turns the order round, and cannot overflow
            best[i] = scores[top], vec[top]


def _cells(k: int):
    """A partition's rows (cell, kind, vec_id, no, vector), each cell's candidates before its queries -> its k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, tiles, dims = None, [], [], 0

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, no = (part.column(c).to_numpy() for c in ("vec_id", "query_no"))
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
            width = max(dims, int(np.max(np.asarray(part.column("vector").value_lengths()), initial=0)))
            queries = quantised(part.column("vector"), width)
            for tile in tiles:
                search(tile, ids, queries[:, :dims], best, k)
            n = [len(s) for s, _ in best]
            arrays = [np.repeat(ids, n), np.repeat(no, n), *(np.concatenate([b[x] for b in best] + [np.zeros(0, np.int64)]) for x in (1, 0))]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["query_id", "query_no", "vec_id", "score"])

        for batch in batches:
            places, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(places) | np.diff(kinds)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(places)]):
                if i == j:
                    continue
                if places[i] != cell:
                    cell, rows, tiles, dims = places[i], [], [], 0
                part = batch.slice(i, j - i)
                if kinds[i] == 0:
                    rows.append(part)
                    continue
                if rows:  # the cell's candidates are complete
                    dims = max(int(np.max(np.asarray(r.column("vector").value_lengths()), initial=0)) for r in rows)
                    tiles = [Tile(r.column("vec_id").to_numpy()[s : s + TILE], quantised(r.column("vector").slice(s, TILE), dims)) for r in rows for s in range(0, len(r), TILE)]
                    rows = []
                for s in range(0, len(part), QUERIES):
                    yield answer(part.slice(s, QUERIES))

    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector: the rows that take part, each once."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    return rows.where("NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))").distinct()  # combines before its shuffle


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, cell_bytes: int = CELL_BYTES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score, query_no: the k highest scores of each row whose vec_id `every` divides, over all other rows.

    Cells hold about cell_bytes of vectors, so memory of a task is bounded and queries are sent
    to as many tasks as the table fills (to every task of the session at least).  Cells are dealt by
    a hash of id and vector, so no vector, however common, fills one.
    """
    spark, order = vectors.sparkSession, Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    rows = kept_safe(usable(vectors, id_column, vector_column).select("vec_id", F.xxhash64("vec_id", "vector").alias("query_no"), "vector"))
    filled = rows.agg(F.sum(8 * F.size("vector").cast("long") + 8)).first()[0] or 0
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), filled // cell_bytes + 1)
    here = F.pmod(F.xxhash64("query_no"), F.lit(cells)).cast("int")
    held = rows.select(here.alias("cell"), F.lit(0).alias("kind"), "vec_id", "query_no", "vector")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "vec_id", "query_no", "vector")
    met = held.unionByName(asked).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "kind", "query_no")
    found = met.mapInArrow(_cells(k), "query_id long, query_no long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_no")

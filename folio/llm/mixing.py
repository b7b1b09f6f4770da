"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is e times its size takes every document floor(e) times and one more time
with inclusion probability e - floor(e).  Which documents get the extra copy is settled by the
cube method: the vector of fractional probabilities moves along a direction that keeps both the
word total and the document total of its block, until at most two documents of a block are
fractional; those meet again in the next, smaller level, and the last few are landed so that the
word total is nearest the target.  Large documents fly first, so what is left to land is small.

Rows that are equal in all that counts are one row with a number of times, told apart by a running
number, so the mix does not depend on how the table is laid out, and equal rows by the million are
spread over all blocks.

Defined results: null text has size 0 (and takes 0 words); null sources come last; a source whose
texts have no word takes nothing; empty tables give an empty mix; repeated rows are documents of
their own; ties are ordered by a hash of the row; a very long text is one document like any other,
so its source can miss the target by its size at most; extra columns are ignored by `mixture` and
kept by `mix_rows`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm._text import kept_safe
from folio.llm.sharding import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3.0
#: Documents of a block in a flight level; a level keeps at most 2 of a block's documents open.
BLOCK = 2000
#: Open documents of one source that are landed together.
FINAL = 4000
#: Documents of a source that are landed with the two that its flight leaves, and about so many that fly last.
LANDED, LATE = 14, 200
#: Sources up to this count are broadcast (about 100 bytes each); more are joined by shuffle.
MAX_BROADCAST_SOURCES = 50_000
#: Running numbers of equal rows that one generated row holds.
RUN = 1 << 16


def targets(per: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """per (s, source, size) with weight and target: shares of the total by weight, none above `most` times its size.

    Weights go round by the sources' code points, null last.  What full sources cannot take raises
    the scale of the others, round by round; only sums of a round reach the driver.
    """
    order = per.withColumn("last", F.col("source").isNull())
    ranked = numbered(order, "last", "source")
    per = kept_safe(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("row_no") % len(weights) + 1).cast("int"))).drop("last", "row_no", "n_rows"))
    scale, total = 0.0, per.agg(F.sum("size")).first()[0] or 0
    while True:
        full = F.col("weight") * F.lit(scale) > F.lit(most) * F.col("size")
        taken, open_ = per.agg(F.sum(F.when(full, F.lit(most) * F.col("size"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (taken or 0.0)) / open_ if open_ else scale
        if new <= scale:
            break
        scale = new
    return per.withColumn("target", F.least(F.col("weight") * F.lit(scale), F.lit(most) * F.col("size")).cast("double"))


def flight(p: list[float], x: list[float]) -> list[float]:
    """Moves probabilities p within [0, 1], keeping sum(p) and sum(p * x), until at most two are fractional."""
    eps, n = 1e-9, len(p)
    open_: list[int] = []
    for nxt in range(n):
        if eps < p[nxt] < 1 - eps:
            open_.append(nxt)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u, v, w = x[c] - x[b], x[a] - x[c], x[b] - x[a]  # in the null space of the rows (1, 1, 1) and x
        if u == v == w == 0:
            u, v, w = 1.0, -1.0, 0.0
        up = down = 1e300
        for q, d in ((p[a], u), (p[b], v), (p[c], w)):
            if d > 0:
                up, down = min(up, (1 - q) / d), min(down, q / d)
            elif d < 0:
                up, down = min(up, -q / d), min(down, -(1 - q) / d)
        # The coin of the method, made of the documents' own numbers so that reruns agree.
        coin = ((a * 2654435761 + b * 40503 + c * 2246822519 + n) % 1000003) / 1000003
        step = up if coin * (up + down) < down else -down
        for k, d in ((a, u), (b, v), (c, w)):
            p[k] += step * d
            if p[k] < eps:
                p[k] = 0.0
            elif p[k] > 1 - eps:
                p[k] = 1.0
        open_ = [k for k in open_ if 0.0 < p[k] < 1.0]
    return p


_UNIT = "doc_id long, source string, size long, mark long, k long, s string, tie long, p double"


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["size", "tie", "doc_id", "k"], ascending=[False, True, True, True], kind="stable")


def _fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = _sorted(rows)
    rows["p"] = flight(rows["p"].tolist(), rows["size"].astype(float).tolist())
    return rows[[c.split()[0] for c in _UNIT.split(", ")]]


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """0 or 1 for each of a few documents, of all ways the one nearest to the expected words and documents."""
    ways = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    off = np.abs(ways @ x - p @ x) + np.abs(ways.sum(axis=1) - p.sum())
    return ways[int(off.argmin())].astype(float)


def _land(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Settles one source's last documents: most fly, a few small ones and a few of every size are landed with what is open then."""
    rows = _sorted(rows)
    p, x, n = rows["p"].to_numpy().copy(), rows["size"].to_numpy(float), len(rows)
    few = LANDED // 2
    late = np.zeros(n, bool)
    late[max(0, n - few) :] = True
    late[np.unique(np.linspace(0, max(0, n - few - 1), few).astype(int))] = True
    p[~late] = flight(p[~late].tolist(), x[~late].tolist())
    open_ = np.flatnonzero((p > 0) & (p < 1))
    p[open_] = land(p[open_], x[open_])
    rows["p"] = p
    return rows[[c.split()[0] for c in _UNIT.split(", ")]]


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _by_source(rows: DataFrame, per: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with one row per source, broadcast where the sources are counted to be few."""
    return rows.join(F.broadcast(per) if per.count() <= MAX_BROADCAST_SOURCES else per, "s", how)


def copies(rows: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """rows (doc_id, source, size, mark) with source_size, target and n_copies; equal rows are alike.

    Documents are dealt to blocks by hash, so a source that holds most rows is flown in as many
    tasks as it has blocks of about BLOCK documents.
    """
    alike = rows.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("m"))
    alike = kept_safe(alike.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))))
    per = alike.groupBy("s").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("m")).alias("size"))
    per = targets(per, weights).select("s", F.col("size").alias("source_size"), "target")
    per = kept_safe(per.withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("times").cast("int")))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN))))
    units = runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("m"), (F.col("run") + 1) * RUN) - 1))).drop("run", "m")
    units = _by_source(units, per.select("s", "times", "whole")).withColumn("tie", F.xxhash64("doc_id", "size", "mark", "k", F.lit(seed)))
    part = F.when(F.col("size") > 0, F.col("times") - F.col("whole")).otherwise(0.0)
    columns = [c.split()[0] for c in _UNIT.split(", ")]
    level = units.withColumn("p", part).select(*columns)
    settled, step = [level.where("p = 0")], 0
    level = kept_safe(level.where("p > 0"))
    of = kept_safe(level.groupBy("s").agg(F.count("*").alias("n")))
    level = _by_source(level, of).withColumn("late", F.pmod(F.xxhash64("tie", F.lit(-1)), "n") < LATE)
    reserve, level = level.where("late").select(*columns), level.where("NOT late").select(*columns)
    while True:
        n = kept_safe(level.groupBy("s").agg(F.count("*").alias("n")))
        if (n.agg(F.max("n")).first()[0] or 0) <= FINAL:
            break
        block = F.pmod(F.xxhash64("tie", F.lit(step)), F.ceil(F.col("n") / BLOCK).cast("long"))
        done = kept_safe(_by_source(level, n).withColumn("block", block).groupBy("s", "block").applyInPandas(_fly, _UNIT))
        settled.append(done.where("p <= 0 OR p >= 1"))
        level, step = done.where("p > 0 AND p < 1"), step + 1
    settled.append(level.unionByName(reserve).groupBy("s").applyInPandas(_land, _UNIT))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return _by_source(out, per).select("doc_id", "source", "size", "mark", "source_size", "target", (F.col("whole") + (F.col("p") >= 1).cast("int")).alias("n_copies"))


def _key(docs: DataFrame, mark: Column) -> list[Column]:
    return [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), _size().alias("size"), mark.alias("mark")]


def mixture(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and source; one row per row of docs."""
    out = copies(docs.select(*_key(docs, F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")))), seed, weights)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).cast("long").alias("taken"), "source", "n_copies")


def mix_rows(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs as often as the mix takes them (not at all, or up to 3 times), same columns.

    A row is known by a hash of all its columns; rows equal in all are one, taken as often as they are together.
    """
    mark = F.xxhash64(F.struct(*docs.columns))
    mix = copies(docs.select(*_key(docs, mark)), seed, weights)
    taken = mix.groupBy("mark", "doc_id").agg(F.sum("n_copies").alias("c"), F.count("*").alias("m")).where("c > 0")
    taken = taken.select(F.col("mark").alias("_mark"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "c", "m")
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("_mark"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("_id"))
    both = rows.join(taken, ["_mark", "_id"])
    again = both.where("m > 1").groupBy("_mark", "_id").agg(F.first("row").alias("row"), F.first("c").alias("c"))
    out = both.where("m = 1").select("row", "c").unionByName(again.select("row", "c"))
    times = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / RUN)))
    out = out.withColumn("run", times).select("row", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("c"), (F.col("run") + 1) * RUN) - 1)))
    return out.select("row.*")

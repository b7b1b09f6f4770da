"""Exact token counts of a byte-pair vocabulary with byte fallback, on ragged numpy arrays.

Texts are cut into pre-tokens (a run of word marks and what follows up to the next), each
different pre-token of a batch is held once as a row of symbol ids in one flat array, and in each
round every sequence merges its best-ranked pair (the leftmost of equals) at the same time.  What
survives is counted; a symbol outside the vocabulary counts its UTF-8 bytes.

A pre-token of over LONG characters (an unspaced script, base64) would need a round for nearly
every merge.  Long ones are swept instead: all their pairs lie in buckets by rank, and the bucket
of the lowest rank is merged at once in all of them, which costs little more than sorting.

Defined results: null counts as empty; empty text has 0 tokens; strings of special tokens inside
a text are ordinary text; nothing is truncated, however long; every row stands alone, so repeated
rows repeat the result; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _text as tx

MARK = "▁"
#: Pre-tokens remembered by a worker, so that memory stays bounded.
MEMO = 400_000
#: Characters from which a pre-token is swept.
LONG = 192
NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks and merges of the pieces of a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        piece = {i: model.id_to_piece(i) for i in plain}
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        self.chars = {p: k for k, p in enumerate(sorted({c for p in piece.values() for c in p}))}
        ids = dict(self.chars)
        for p in piece.values():
            ids.setdefault(p, len(ids))
        self.size = len(ids)
        whole = set(piece.values())
        #: Symbols outside the vocabulary are numbered after it, by code point.
        self.cost = np.array([1 if p in whole else len(p.encode()) for p in ids], np.int64)
        merges = {}
        for i, p in piece.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = (rank_of[model.get_score(i)], ids[p])
        keys = np.array(sorted(merges), np.int64)
        self.keys, self.rank, self.to = keys, np.array([merges[k][0] for k in keys.tolist()], np.int64), np.array([merges[k][1] for k in keys.tolist()], np.int64)
        #: Places this many characters apart cannot meet in one piece, whatever is merged between them.
        self.apart = 3 * max((len(p) for p in ids), default=1)
        self.memo: dict[str, int] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no merge) and place in the merge table."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), at

    def merged(self, rows: list[str]) -> np.ndarray:
        """Token counts of pre-tokens, all of them merged in step."""
        size, chars = self.size, self.chars
        sym = np.fromiter((chars.get(c, size + ord(c)) for r in rows for c in r), np.int64)
        seq = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        done = np.zeros(len(rows), np.int64)

        def settle(ids: np.ndarray, of: np.ndarray) -> None:
            np.add.at(done, of, self.costs(ids))

        def ranked(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank, at = np.full(len(ids), NONE), np.zeros(len(ids), np.int64)
            if len(ids) > 1:
                r, a = self.pair(ids[:-1], ids[1:])
                rank[:-1], at[:-1] = np.where(of[:-1] == of[1:], r, NONE), a
            return rank, at

        rank, at = ranked(sym, seq)
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            spans = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NONE, spans)
            if over.any():  # sequences without a pair left are counted and leave
                settle(sym[over], seq[over])
                sym, seq, rank, at = sym[~over], seq[~over], rank[~over], at[~over]
                continue
            hit = np.flatnonzero(rank == np.repeat(best, spans))
            hit = hit[np.concatenate([[True], seq[hit][1:] != seq[hit][:-1]])]  # the leftmost of each sequence
            sym[hit] = self.to[at[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, seq, rank, at = sym[stay], seq[stay], rank[stay], at[stay]
            touched = place[hit]
            for k in (touched - 1, touched):
                k = k[(k >= 0) & (k < len(sym))]
                inner = k[k + 1 < len(sym)]
                rank[k] = NONE
                r, a = self.pair(sym[inner], sym[inner + 1])
                rank[inner], at[inner] = np.where(seq[inner] == seq[inner + 1], r, NONE), a
        return done

    def costs(self, ids: np.ndarray) -> np.ndarray:
        """Tokens that each symbol stands for: one, or its UTF-8 bytes outside the vocabulary."""
        cp = np.maximum(ids - self.size, 0)
        outside = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        return np.where(ids < self.size, self.cost[np.minimum(ids, self.size - 1)], outside)

    def swept(self, row: str) -> int:
        """Token count of one long pre-token, rank by rank over its linked symbols."""
        sym = np.fromiter((self.chars.get(c, self.size + ord(c)) for c in row), np.int64, len(row))
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NONE)  # of the pair that begins at a symbol
        target = np.zeros(n, np.int64)
        buckets: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def place(at: np.ndarray) -> None:
            """Ranks the pairs that begin at these symbols anew and puts them into their buckets."""
            last = after[at] >= n
            rank[at[last]] = NONE
            at = at[~last]
            r, k = self.pair(sym[at], sym[after[at]])
            rank[at], target[at] = r, self.to[k]
            hit = r < NONE
            at, r = at[hit], r[hit]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            edges = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1], [True]])) if len(r) else np.zeros(1, int)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (key := int(r[i])) not in buckets:
                    buckets[key] = []
                    heapq.heappush(ranks, key)
                buckets[key].append(at[i:j])

        place(np.arange(n))
        while ranks:
            best = heapq.heappop(ranks)
            at = np.unique(np.concatenate(buckets.pop(best)))
            at = at[rank[at] == best]
            if not len(at):
                continue
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            k = np.arange(len(at))
            first = np.maximum.accumulate(np.where(chained, 0, k))
            at, late = self.at_once(at[(k - first) % 2 == 0], best, sym, after, before, target)
            if len(late):
                buckets[best] = [late]
                heapq.heappush(ranks, best)
            gone = after[at]
            sym[at] = target[at]
            sym[gone] = -1
            rank[gone] = NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left = before[at]
            place(np.unique(np.concatenate([at, left[left >= 0]])))
        return int(self.costs(sym[sym >= 0]).sum())

    def at_once(self, at: np.ndarray, best: int, sym: np.ndarray, after: np.ndarray, before: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Splits places of one rank into those that can be merged together and those that must wait.

        A merge may give a neighbour a pair of a better rank, which then goes first.  Up to such a
        merge, from the left, all of its neighbourhood are alike to one after the other.
        """
        n, made = len(sym), target[at]
        left, right = before[at], after[after[at]]
        inner = right < n
        better = np.zeros(len(at), bool)
        better[inner] = self.pair(made[inner], sym[right[inner]])[0] <= best
        inner = left >= 0
        better[inner] |= self.pair(sym[left[inner]], made[inner])[0] <= best
        if len(at) > 1:
            better[1:] |= (right[:-1] == at[1:]) & (self.pair(made[:-1], made[1:])[0] <= best)
        if not better.any():
            return at, at[:0]
        hood = np.cumsum(np.concatenate([[False], at[1:] - at[:-1] > self.apart]))
        before_it = np.cumsum(better) - better
        lead = np.concatenate([[True], hood[1:] != hood[:-1]])
        base = np.maximum.accumulate(np.where(lead, before_it, 0))
        now = before_it == base
        return at[now], at[~now]

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [_PRE.findall(MARK + t.replace(" ", MARK)) if t else () for t in texts]
        memo = self.memo
        new = list({w for ws in cut for w in ws}.difference(memo))
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({w for ws in cut for w in ws})
        memo.update((w, self.swept(w)) for w in new if len(w) > LONG)
        new = [w for w in new if len(w) <= LONG]
        for i in range(0, len(new), 20_000):
            part = sorted(new[i : i + 20_000], key=len)
            memo.update(zip(part, self.merged(part).tolist()))
        return [sum(map(memo.__getitem__, ws)) for ws in cut]


_PRE = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            _, off = tx.buffers(batch.column(1))
            n = [k for i, j in tx.chunks(off) for k in vocab.counts(batch.column(1).slice(i, j - i).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"]).set_column(1, "n_bytes", pa.array(np.diff(off), pa.int64())).append_column("n_tokens", pa.array(n, pa.int64()))

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per row of docs. The model file must be at that path on every executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_count(model_path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

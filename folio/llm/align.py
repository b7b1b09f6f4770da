"""Cross-tokenizer alignment: token sequences of one text cut into groups at the bytes where both end.

Text is encoded by a byte-level vocabulary A (a space and the text) and a piece vocabulary B
(which adds the space itself).  The groups are found by divide and conquer: each interval looks
for a common end near its middle, by bisecting B's ends for A's, outward in rings of doubling
width, and is cut there; an interval without one is a leaf, a group.  All intervals of a block of
texts take each step together.
Before, each different stretch of a block between spaces is encoded once (see `Encoders.encode`).

Every pair of an A and a B token that share bytes is a link.  `align` gives groups and links per
document, `pair_counts` the links of each pair of ids over the corpus, `weighed` what a document's
links count there.  Documents are handled in blocks of about BLOCK_BYTES (which bound the memory of a task), within which a pair is
counted once before anything is shuffled, so a pair that is everywhere is one row per block.

Defined results: a text that is null or empty, or whose tokens of A or of B do not give back its
bytes (one that holds U+2581, say), has no tokens: zeros, and no groups; strings of special
tokens inside a text are ordinary text; a very long text is a block of its own and is read whole;
every row stands alone, so repeated rows repeat the result and count each time; a null doc_id is
kept; an empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import _text as tx

#: Bytes of text to a block, and to one call of a tokenizer, which takes longer a byte for a longer text.
BLOCK_BYTES, CALL_BYTES = 1 << 20, 1 << 12
_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs array<struct<a:int,b:int,n:long>>"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else those from U+0100 on in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokens(NamedTuple):
    """Tokens of a block: ids, ends by byte over all its texts in a row, and each text's first token."""

    ids: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray


class Rows(NamedTuple):
    """Rows of ids, one after another, and how many each has."""

    ids: np.ndarray
    sizes: np.ndarray


class Encoders:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, vocab = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in piece) if alphabet.keys() >= set(piece) else piece.encode()
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # Cuts hold where A's tokens stay within words and the space before them, and no piece of B has a mark after another character.
        kind = json.loads(self.a.to_str())
        before = kind["pre_tokenizer"] or {}
        words_only = kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
        self.apart = words_only and not any("▁" in p.lstrip("▁") for _, p in pieces)
        self.digits = _digits(max(len(self.a_bytes), len(self.b_bytes)))

    def each(self, texts: list[str]) -> list[Rows]:
        """Ids of A and of B for each text; a length of -1 on both sides where one side does not give it back."""
        a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        back = [self._back(x, y, f" {t}".encode()) for x, y, t in zip(a, b, texts)]
        return [Rows(np.array([i for r, ok in zip(side, back) if ok for i in r], np.int64), np.array([len(r) if ok else -1 for r, ok in zip(side, back)], np.int64)) for side in (a, b)]

    def together(self, texts: list[str]) -> list[Rows]:
        """As `each`, of texts that no token can span: encoded as one, and cut at their bounds."""
        whole = " ".join(texts)
        a, b = self.a.encode_batch_fast([f" {whole}"], add_special_tokens=False)[0].ids, self.b.encode(whole)
        bounds = np.cumsum([len(t.encode()) + 1 for t in texts])
        rows, back = [], self._back(a, b, f" {whole}".encode())
        for ids, sizes in ((a, self.a_sizes), (b, self.b_sizes)):
            flat = np.array(ids, np.int64)
            ends = np.cumsum(sizes[flat])
            at = np.searchsorted(ends, bounds)
            back = back and bool((ends[at] == bounds).all())
            rows.append(Rows(flat, np.diff(at, prepend=-1)))
        return rows if back else self.each(texts)

    def _back(self, a: list[int], b: list[int], want: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[Tokens, Tokens]:
        """Tokens of a block's texts, given as bytes and bounds; none on either side for a text that one side does not give back.

        Texts are cut into stretches (see `stretches`) where neither vocabulary has a token across,
        and each different stretch of the block is encoded once, many in one call.
        """
        starts, ends = stretches(data, off, self.apart)
        _, first, of = np.unique(tx.hashed(data, starts, ends), return_index=True, return_inverse=True)
        alone = ~_solid(data)[ends[first] - 1] | (not self.apart)
        order = np.argsort(alone, kind="stable")
        of = np.argsort(order)[of]
        first, n_shared = first[order], int((~alone).sum())
        raw = data.tobytes()
        got = _calls(self.together, raw, starts[first[:n_shared]], ends[first[:n_shared]]) + _calls(self.each, raw, starts[first[n_shared:]], ends[first[n_shared:]])
        ptr = np.searchsorted(starts, off)
        lost = np.concatenate([a.sizes for a, _ in got]) < 0 if got else np.zeros(0, bool)
        if lost.any():  # these texts are encoded whole: that tells, whatever a stretch says
            texts = np.unique(np.searchsorted(ptr, np.flatnonzero(lost[of]), "right") - 1)
            nothing = np.flatnonzero(lost)[0]
            got += _calls(self.each, raw, off[texts], off[texts + 1])
            for n, k in enumerate(texts.tolist()):
                of[ptr[k] : ptr[k + 1]] = nothing
                of[ptr[k]] = len(lost) + n
        return _laid([a for a, _ in got], self.a_sizes, of, ptr), _laid([b for _, b in got], self.b_sizes, of, ptr)


def _calls(encode, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[list[Rows]]:
    """What encode makes of these spans, about CALL_BYTES at a time."""
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    spans = list(zip(starts.tolist(), ends.tolist()))
    return [encode([raw[s:e].decode() for s, e in spans[i:j]]) for i, j in tx.chunks(off, CALL_BYTES)]


#: Bytes of printable ASCII.
_SHOWN = np.isin(np.arange(256), np.arange(0x21, 0x7F))


def _solid(data: np.ndarray) -> np.ndarray:
    """Places of bytes that end a character that is no space for sure: printable ASCII, or two bytes from U+00C0 on."""
    solid = _SHOWN[data]
    solid[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return solid


def stretches(data: np.ndarray, off: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of each text; not apart, texts are one each.

    A stretch ends before a space that follows a character that is none.  Its own bounds leave out
    that space, which begins the next: at a text's start, the one that both vocabularies see there.
    """
    some = off[:-1] < off[1:]
    cut = (data == 32) & apart
    cut[1:] &= _solid(data)[:-1]
    cut[off[:-1][some]] = False
    cut[off[1:][some] - 1] = False  # a stretch holds something
    at = np.flatnonzero(cut)
    return np.sort(np.concatenate([off[:-1][some], at + 1])), np.sort(np.concatenate([at, off[1:][some]]))


def _laid(rows: list[Rows], sizes: np.ndarray, of: np.ndarray, ptr: np.ndarray) -> Tokens:
    """Tokens of a block from rows of ids, the row of each stretch and each text's first stretch."""
    n = np.maximum(np.concatenate([np.zeros(0, np.int64), *(r.sizes for r in rows)]), 0)
    flat = np.concatenate([np.zeros(0, np.int64), *(r.ids for r in rows)])
    begin, long = (np.cumsum(n) - n)[of], n[of]
    total = np.cumsum(np.concatenate([[0], long]))
    ids = flat[np.repeat(begin - total[:-1], long) + np.arange(total[-1])]
    return Tokens(ids, np.cumsum(sizes[ids]), total[ptr])


def cuts(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ends of groups, ascending, as places in a_ends: of intervals first[k]:last[k] of A tokens, both of whose bounds are common ends."""
    if not len(a_ends):
        return np.zeros(0, np.int64)
    common = b_ends[np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)] == a_ends
    full = first < last
    lo, hi = first[full], last[full]
    leaves = [hi - 1]  # the end of each interval is common
    while len(lo):
        middle, width, found = (lo + hi - 1) // 2, 0, np.full(len(lo), -1)
        todo = np.flatnonzero(hi - lo > 1)
        while len(todo):  # rings around the middle, each as wide as all before it
            reach = max(1, width)
            for sign in (-1, 1):
                todo_ = todo[found[todo] < 0] if width else todo
                if sign > 0 and not width:
                    todo_ = todo_[:0]  # the middle itself is looked at once
                near, far = (middle[todo_] + sign * x for x in (width, width + reach - 1))
                a, b = np.minimum(near, far), np.maximum(near, far)
                a, b = np.maximum(a, lo[todo_]), np.minimum(b, hi[todo_] - 2)
                n = np.maximum(b - a + 1, 0)
                place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                of = np.repeat(np.arange(len(todo_)), n)
                hit = common[place]
                place, of = place[hit], of[hit]
                if len(of):  # the one nearest to the middle
                    edge = np.diff(of, prepend=-1) > 0 if sign > 0 else np.diff(of, append=len(todo_)) > 0
                    found[todo_[of[edge]]] = place[edge]
            width += reach
            out = (middle[todo] - width < lo[todo]) & (middle[todo] + width > hi[todo] - 2)
            todo = todo[(found[todo] < 0) & ~out]
        cut = found >= 0
        at = found[cut]
        leaves.append(at)
        lo, hi = np.concatenate([lo[cut], at + 1]), np.concatenate([at + 1, hi[cut]])
    return np.sort(np.concatenate(leaves))


def links(a: Tokens, b: Tokens, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of each link, in order."""
    begin = a.ends - a_sizes[a.ids]
    lo = np.searchsorted(b.ends, begin, "right")
    n = np.searchsorted(b.ends - b_sizes[b.ids], a.ends, "left") - lo
    return np.repeat(np.arange(len(lo)), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each id below size (at most 7) as bytes of one integer, first digit lowest, and how many they are."""
    ids, n = np.arange(size, dtype=np.uint64), np.ones(size, np.uint64)
    for k in range(1, 7):
        n += (ids >= 10**k).astype(np.uint64)
    packed = np.zeros(size, np.uint64)
    for _ in range(7):  # the last digit first, each moved up by the ones before it
        todo = (ids > 0) | (packed == 0)
        packed = np.where(todo, packed << np.uint64(8) | ids % np.uint64(10) + np.uint64(48), packed)
        ids //= np.uint64(10)
    return packed, n * np.uint64(8)


def group_strings(a: Tokens, b: Tokens, ends: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text, from its tokens and the places in a where groups end.

    A token is 8 bytes, its digits and the mark that follows them, put at its place in the output; then the zero bytes go.
    """
    if not len(ends):
        return [b""] * (len(a.ptr) - 1)
    b_ends = np.searchsorted(b.ends, a.ends[ends])
    a_group = np.searchsorted(ends, np.arange(len(a.ids)))
    b_group = np.searchsorted(b_ends, np.arange(len(b.ids)))
    a_mark, b_mark = (np.full(len(t.ids), ord(","), np.uint64) for t in (a, b))
    a_mark[ends], b_mark[b_ends] = ord("|"), ord(";")
    b_mark[b.ptr[1:][np.diff(b.ptr) > 0] - 1] = 0  # nothing after the last group of a text
    at_b_before = np.concatenate([[0], b_ends + 1])[a_group]
    text, bits = digits
    rows = np.empty(len(a.ids) + len(b.ids), "<u8")
    for t, mark, place in ((a, a_mark, at_b_before), (b, b_mark, ends[b_group] + 1)):
        rows[np.arange(len(t.ids)) + place] = text[t.ids] | mark << bits[t.ids]
    rows = rows.view(np.uint8)
    filled = np.flatnonzero(rows)
    size = np.searchsorted(filled, 8 * (a.ptr + b.ptr))
    flat = rows[filled].tobytes()
    return [flat[i:j] for i, j in zip(size[:-1].tolist(), size[1:].tolist())]


_loaded: dict[tuple[str, str], Encoders] = {}


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _loaded:
            _loaded[a_path, b_path] = Encoders(a_path, b_path)
        enc, block = _loaded[a_path, b_path], TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = tx.buffers(batch.column(1))
            for i, j in tx.chunks(off, BLOCK_BYTES):
                yield _block(enc, block, batch.column(0).slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i])
                block += 1

    return run


def packed(places: np.ndarray) -> bytes:
    """Numbers in any order, small: sorted, their steps laid out byte by byte and compressed."""
    steps = np.diff(np.sort(places), prepend=0).astype("<i4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(steps) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<i4").ravel(), dtype=np.int64)


def _block(enc: Encoders, block: int, ids: pa.Array, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    a, b = enc.encode(data, off)
    ends = cuts(a.ends, b.ends, a.ptr[:-1], a.ptr[1:])
    of_a, of_b = links(a, b, enc.a_sizes, enc.b_sizes)
    keys, place, times = np.unique(a.ids[of_a] << 32 | b.ids[of_b], return_inverse=True, return_counts=True)
    ptr = np.searchsorted(of_a, a.ptr)
    pairs = pa.StructArray.from_arrays([pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(times, pa.int64())], ["a", "b", "n"])
    lists = pa.ListArray.from_arrays(pa.array([0, *[len(keys)] * n], pa.int32()), pairs)  # all with the block's first row
    counts = (np.diff(x) for x in (a.ptr, b.ptr, np.searchsorted(ends, a.ptr), ptr))
    strings = pa.array([s.decode() for s in group_strings(a, b, ends, enc.digits)], pa.string())
    places = pa.array([packed(place[s:e]) for s, e in zip(ptr[:-1].tolist(), ptr[1:].tolist())], pa.binary())
    arrays = [pa.array(np.full(n, block)), ids.cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), strings, places, lists]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _SCHEMA.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3` in ids), and its block, links and pairs.

    links packs (see `packed`) the places of the document's links in the block's list of pairs,
    which the first row of the block holds.  Both files must be at their paths on every executor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_align(a_path, b_path), _SCHEMA)


def _block_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.select(F.col("block").alias("of"), F.posexplode("pairs").alias("pos", "pair")).select("of", "pos", "pair.*")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n: links of each pair of ids over the corpus, best: whether no other A id has more with this B id."""
    total = _block_pairs(aligned).groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _weigh(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the counts of their links."""
    count, best = np.zeros(len(pairs) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
    pos = pairs["pos"].to_numpy()
    count[pos], best[pos] = pairs["n"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
    at = [unpacked(x, n) for x, n in zip(docs["links"].to_pylist(), docs["n_links"].to_pylist())]
    for name, value in (("n_best", best), ("count_sum", count)):
        docs = docs.append_column(name, pa.array([int(value[x].sum()) for x in at], pa.int64()))
    return docs.drop_columns(["block", "links"])


def weighed(aligned: DataFrame) -> DataFrame:
    """aligned (written or checkpointed: it is read more than once) with n_best and count_sum, without block, links and pairs.

    The counts of a block's pairs are joined once a block and meet its documents there, so no
    table of all pairs is gathered or broadcast, and no task holds more than a block.
    """
    counts = _block_pairs(aligned).drop("n").join(pair_counts(aligned), ["a", "b"]).select("of", "pos", "n", "best")
    docs = aligned.drop("pairs")
    kept = [f for f in docs.schema.fields if f.name not in ("block", "links")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n_best long, count_sum long"])
    return docs.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_weigh, schema)

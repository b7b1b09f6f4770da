"""Near-duplicate detection with circulant MinHash, banding and exact Jaccard confirmation.

Two permutations make all signature coordinates: the first spreads shingles over a ring, the
second is read at the shingle's place shifted by k for coordinate k.  Documents whose
coordinates agree in a band become candidates; candidates are confirmed on their full shingle
sets.

Defined results: a text that is null or has no word has an empty set and links with nothing;
one with fewer words than a shingle has the whole sequence as its only shingle; exact copies
share a class before any candidate search; repeated rows of one doc_id are one document, with all
its links if the texts differ; rows without doc_id are returned with null component_id and kept =
true; of ties the smallest doc_id counts; a very long text is shingled whole, as a chunk of its
own; an empty table gives an empty one; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import _text as tx
from folio.llm._graph import components

#: 56 bands of 7 rows: a pair at similarity 0.8 is missed with probability (1 - 0.8**7)**56 < 2e-6, one
#: that shares a fifth of its shingles (a passage, say) is a candidate with probability under 0.001.
BANDS, ROWS = 56, 7
#: log2 of the ring's size. Places that two shingles share only cost a needless confirmation.
RING_BITS = 21
#: Sizes up to this ratio apart are about the same.
SIZE_STEP = 1.1
#: Members outside a group's largest component up to which the group is compared by shared differences alone: so many times its size of pairs at most.
FEW = 64
#: Bands at most, and chance to miss a pair, where differences are signed.
DIFF_BANDS, DIFF_MISS = 2048, 1e-6
#: Least ratios of a pair's differences to what a link allows, one signature for each; pairs below the first share so few
#: differences that they are only found one by one.
DIFF_RATIOS = (1.8, 2.2, 2.7, 3.3, 4.0, 5.0, 7.0)

#: Ring entries that a signature looks at together.
_AT_ONCE = 400_000
_ring: dict[tuple[int, int], np.ndarray] = {}


def ring(bits: int, width: int) -> np.ndarray:
    """Row p holds the second permutation at p, p + 1, ..., p + width - 1 (around the ring)."""
    if (bits, width) not in _ring:
        pi = np.random.Generator(np.random.PCG64(7919)).permutation(1 << bits).astype(np.uint32)
        _ring[bits, width] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)
    return _ring[bits, width]


def signature(shingles: np.ndarray, bits: int, width: int) -> np.ndarray:
    view, out = ring(bits, width), np.full(width, 1 << bits, np.uint32)
    place = (tx.mix(shingles) >> tx.U64(64 - bits)).astype(np.int64)
    step = max(1, _AT_ONCE // width)
    for i in range(0, len(place), step):
        np.minimum(out, view[place[i : i + step]].min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = tx.buffers(column)
    for i, j in tx.chunks(off):
        w = tx.words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        g = tx.windows(w.hashes, width)
        for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
            if b - a >= width:
                yield np.unique(g[a : b - width + 1])
            else:
                yield tx.whole(w.hashes[a:b]) if b > a else np.zeros(0, tx.U64)


def _sign(width: int, bands: int, rows: int, bits: int):
    scale = tx.WEIGHTS[:rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, keys = [], [], []
            for s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                fp.append((s.sum(dtype=tx.U64), tx.mix(s ^ tx.U64(0x5DEECE66D)).sum(dtype=tx.U64)))
                keys.append(signature(s, bits, bands * rows))
            sig = np.array(keys, np.uint64).reshape(len(n), bands, rows)
            key = tx.mix((sig * scale).sum(axis=2, dtype=tx.U64) + np.arange(1, bands + 1, dtype=np.uint64) * tx.U64(0x9E3779B97F4A7C15))
            fp = np.array(fp, tx.U64).reshape(len(n), 2).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, (len(n) + 1) * bands, bands, dtype=np.int32), key.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), lists], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), width)], pa.binary())], ["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, good = batch.column(2), batch.column(3), []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x.as_buffer(), tx.U64), np.frombuffer(y.as_buffer(), tx.U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def with_sets(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(u, v) with the full shingle sets of both, read again from the texts."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = tx.kept_safe(tx.pick(docs, ids, "doc_id").mapInArrow(_sets(width), "doc_id long, shingles binary"))
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full shingle sets are similar enough, checkpointed."""
    return tx.narrow(with_sets(pairs, docs, width).mapInArrow(_confirm(percent), "u long, v long"))


def _against(percent: int):
    """(head, doc, sets of both) -> sizes, shared shingles, the doc's own (that the head lacks), and, if the head holds so much of it that it may not need own ones, what the doc lacks of the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_head, shared, own, lacks = [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                head, doc = np.frombuffer(x.as_buffer(), tx.U64), np.frombuffer(y.as_buffer(), tx.U64)
                own.append(np.setdiff1d(doc, head, assume_unique=True).view(np.int64))
                n.append(len(doc))
                n_head.append(len(head))
                shared.append(len(doc) - len(own[-1]))
                inside = 100 * shared[-1] >= percent * n[-1]
                lacks.append(np.setdiff1d(head, doc, assume_unique=True).view(np.int64) if inside else np.zeros(0, np.int64))
            ints = (pa.array(x, pa.int64()) for x in (n, n_head, shared))
            lists = (pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate([*x, np.zeros(0, np.int64)])) for x in (own, lacks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ints, *lists], ["head", "doc", "n", "n_head", "shared", "own", "lacks"])

    return run


def grouped(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of (doc, band) those whose band another document has too: band, doc, n_shingles, weight.

    A document's weight is the size of all its groups together; the text that others are versions
    of has the largest, as each version leaves some groups.
    """
    shared = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    found = tx.narrow(entries.join(shared, "band"))
    weight = found.groupBy("doc").agg(F.sum("size").alias("weight")).join(sizes, "doc")
    return tx.narrow(found.select("band", "doc").join(weight, "doc"))


def first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """One pair (u, v) for each document that is not the heaviest of all its groups: with the heaviest head it meets."""
    best = F.max(F.struct("weight", (-F.col("doc")).alias("d"), "n_shingles"))
    heads = members.groupBy("band").agg(best.alias("h")).select("band", F.col("h.weight").alias("wu"), (-F.col("h.d")).alias("u"), F.col("h.n_shingles").alias("nu"))
    met = members.join(heads, "band").where("doc <> u").where(_fits(percent))
    top = met.groupBy(F.col("doc").alias("v")).agg(F.max(F.struct("wu", (-F.col("u")).alias("d"))).alias("h"))
    return top.select((-F.col("h.d")).alias("u"), "v")


def _fits(percent: int) -> str:
    return f"100 * least(n_shingles, nu) >= {percent} * greatest(n_shingles, nu)"


def labels(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("doc"), "component")


def named(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with doc's component, itself where it has no link."""
    return rows.drop("component").join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def open_rows(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of the groups that hold more than one component."""
    split = rows.groupBy(*group).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(*group)
    return rows.join(split, group)


def still_open(rows: DataFrame, group: list[str]) -> DataFrame:
    return tx.narrow(open_rows(rows, group))


def needed(percent: int, n: str, other: str) -> str:
    """SQL: shingles that sets of these sizes share at least if they are similar enough."""
    return f"({percent} * ({n} + {other}) + {99 + percent}) div {100 + percent}"


def telling(met: DataFrame, shingles: str, least: str) -> DataFrame:
    """met with a row for each of the few shingles of a column by which a member's links can be found, and `most`.

    Of the `most` that others of the group have too, a member shares at least `least` (SQL, from 1) with
    whatever it is linked to; so both have one among the rarest most - least + 1 of each.  Members
    that have too few in common with anyone leave.
    """
    tokens = met.select("head", "doc", F.explode(shingles).alias("shingle"))
    common = tokens.groupBy("head", "shingle").agg(F.count("*").alias("df")).where("df > 1")
    tokens = tx.narrow(tokens.join(common, ["head", "shingle"]))
    most = tokens.groupBy("head", "doc").agg(F.count("*").alias("most"))
    about = met.drop("own", "lacks", "diff").join(most, ["head", "doc"]).withColumn("least", F.expr(f"greatest(1, {least})"))
    about = tx.narrow(about.where("most >= least"))
    place = F.row_number().over(Window.partitionBy("head", "doc").orderBy("df", "shingle"))
    return tx.narrow(tokens.join(about, ["head", "doc"]).withColumn("place", place).where("place <= most - least + 1").drop("df", "place", "least"))


def by_own(met: DataFrame, percent: int) -> DataFrame:
    """Index of members whose links need shingles that the head lacks: of the head's, two members share at most what either shares with it."""
    other = f"greatest(fewest, ({percent} * n + 99) div 100)"
    return telling(met, "own", f"{needed(percent, 'n', other)} - shared")


def partnered(held: DataFrame, percent: int) -> DataFrame:
    """Members for whom their head has one of another component whose size allows a link without own shingles: what a member shares with the head bounds its partner's size."""
    step = lambda n: F.floor(F.log(n) / F.lit(np.log(SIZE_STEP)))
    low = F.expr(f"({percent} * n + 99) div 100")
    high = F.expr(f"least((100 * n) div {percent}, ({100 + percent} * shared) div {percent} - n)")
    sizes = held.groupBy("head", step(F.col("n")).alias("step")).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    asked = held.select("head", "doc", "component", low.alias("low"), high.alias("high")).where("high >= low")
    asked = asked.withColumn("step", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))))
    found = asked.join(sizes, ["head", "step"]).where("most_n >= low AND least_n <= high AND (lo <> component OR hi <> component)").select("head", "doc").distinct()
    return held.join(found, ["head", "doc"], "left_semi")


def inside(met: DataFrame, percent: int) -> DataFrame:
    """Members that the head holds so much of that two of them can be linked without a shingle of their own, with `diff`, d and excess.

    diff is what one of member and head has and the other lacks.  That keeps distances: two members
    differ from each other in what is in one's diff only.  They are linked if that is at most
    (100 - percent) / (100 + percent) of both sizes together, so with d differences each they share
    at least (excess_u + excess_v) / (2 * (100 + percent)) of them, excess being
    (100 + percent) * d - (100 - percent) * n.  If that sum is not above 0 both are linked to the
    head; so for members of different components it is, and they share at least one difference.
    """
    other = f"greatest(fewest, ({percent} * n + 99) div 100)"
    held = met.where(f"shared >= {needed(percent, 'n', other)}").withColumn("diff", F.concat("own", "lacks"))
    held = held.withColumn("d", F.size("diff").cast("long")).withColumn("excess", F.expr(f"{100 + percent} * d - {100 - percent} * n"))
    held = tx.kept_safe(partnered(tx.kept_safe(open_rows(held, ["head"])), percent))
    return held.join(held.groupBy("head").agg(F.min("excess").alias("lowest")), "head")


def least_shared(percent: int, excess: str, other: str) -> str:
    """SQL: differences that members of these excesses share at least if they are linked and of different components."""
    return f"cast(ceil(({excess} + {other}) / {2 * (100 + percent)}D) as bigint)"


def stars(index: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (u, v) that join most of what belongs together before members are compared with each other, linear in them.

    Each member meets the first member of most of its telling shingles' groups; one that the head
    holds most of meets the first of its head and about its size, and that one the first of the
    next sizes.
    """
    first = F.min(F.struct(F.xxhash64("doc").alias("h"), F.col("doc").alias("u"), F.col("component").alias("cu"))).alias("f")
    heads = index.groupBy("head", "shingle").agg(first).select("head", "shingle", "f.u", "f.cu")
    shared = index.join(heads, ["head", "shingle"]).where("component <> cu").groupBy("doc", "u").agg(F.count("*").alias("c"))
    shared = shared.groupBy("doc").agg(F.max(F.struct("c", (-F.col("u")).alias("d"))).alias("b")).select((-F.col("b.d")).alias("u"), F.col("doc").alias("v"))
    sized = held.withColumn("step", F.floor(F.log("n") / F.lit(np.log(SIZE_STEP))))
    heads = tx.narrow(sized.groupBy("head", "step").agg(first).select("head", "step", "f.u", "f.cu"))
    alike = sized.join(heads, ["head", "step"]).where("component <> cu").select("u", F.col("doc").alias("v"))
    shorter = heads.select("head", (F.col("step") + 1).alias("step"), F.col("u").alias("v"), F.col("cu").alias("cv"))
    return shared.unionByName(alike).unionByName(heads.join(shorter, ["head", "step"]).where("cu <> cv").select("u", "v"))


def diff_plans() -> list[tuple[int, int]]:
    """(rows, bands) of each of DIFF_RATIOS: a pair there shares at least (ratio - 1) / (ratio + 1) of its differences."""
    out = []
    for ratio in DIFF_RATIOS:
        share = (ratio - 1) / (ratio + 1)
        rows = max(1, int(np.log(-np.log(DIFF_MISS) / DIFF_BANDS) / np.log(share)))
        out.append((rows, int(np.ceil(np.log(DIFF_MISS) / np.log1p(-(share**rows))))))
    return out


def _sign_diffs(bits: int):
    """(head, doc, low, high, diff) -> (head, doc, plan, key), a row a band of each plan that pairs of ratios low to high fall into."""
    plans, edges = diff_plans(), np.array([*DIFF_RATIOS[1:], np.inf])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, doc, low, high, diff in zip(*(batch.column(k) for k in range(5))):
                shingles = diff.values.to_numpy().view(tx.U64)
                for k, (rows, bands) in enumerate(plans):
                    if high.as_py() < DIFF_RATIOS[k] or low.as_py() >= edges[k]:
                        continue
                    sig = signature(shingles, bits, rows * bands).astype(tx.U64).reshape(bands, rows)
                    key = tx.mix((sig * tx.WEIGHTS[:rows]).sum(axis=1, dtype=tx.U64) + np.arange(1, bands + 1, dtype=np.uint64) * tx.WEIGHTS[-1])
                    arrays = [np.full(bands, x) for x in (head.as_py(), doc.as_py(), k)] + [key.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["head", "doc", "plan", "key"])

    return run


def _sides(rows: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*key, F.col("doc").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "d", "shared", "excess", "most", "component", "top") if c in rows.columns]) for k in "uv")


def ratio_of(percent: int, d: str, n: str) -> str:
    """SQL: differences in relation to what a link allows; of two members by their sums."""
    return f"{100 + percent} * ({d}) / ({100 - percent}D * greatest(1, {n}))"


#: Pairs of different components; pairs of one top head meet under it alone.
_APART = "u < v AND component_u <> component_v AND (top_u <> top_v OR top_u = head)"


def crossing_own(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (u < v) of different components that may be linked, but only by shingles of their own, and share a telling one."""
    left, right = _sides(still_open(index, ["head", "shingle"]), "head", "shingle")
    need = needed(percent, "n_u", "n_v")
    may = f"least(shared_u, shared_v) < {need} AND least(shared_u, shared_v) + least(most_u, most_v) >= {need}"
    return left.join(right, ["head", "shingle"]).where(f"{_APART} AND {may}").select("u", "v")


def crossing(held: DataFrame, percent: int, ring_bits: int) -> DataFrame:
    """Pairs (u < v) of different components among members that their head holds most of (see `inside`), if they may be linked.

    In a group nearly all of which is one component, and where a link needs but few shared
    differences, pairs are those that share a telling difference.  In other groups, where a
    difference can be common to very many members, the others are found by signatures of the differences, made as those of
    whole sets are but with so many rows a band that only pairs near a link agree.
    """
    ratio, first = ratio_of(percent, "d_u + d_v", "n_u + n_v"), DIFF_RATIOS[0]
    apart = f"{_APART} AND least(shared_u, shared_v) >= {needed(percent, 'n_u', 'n_v')}"
    index = telling(tx.kept_safe(partnered(held, percent)), "diff", least_shared(percent, "excess", "lowest"))
    about = tx.narrow(index.groupBy("head", "doc").agg(*[F.first(c).alias(c) for c in ("n", "d", "shared", "component", "top")]))
    parts = about.groupBy("head", "component").agg(F.count("*").alias("c")).groupBy("head").agg((F.sum("c") - F.max("c") <= FEW).alias("few"))
    left, right = _sides(still_open(index, ["head", "shingle"]).join(parts, "head"), "head", "shingle", "few")
    may = f"least(most_u, most_v) >= greatest(1, {least_shared(percent, 'excess_u', 'excess_v')})"
    by_token = left.join(right.drop("few"), ["head", "shingle"]).where(f"{apart} AND {may} AND (few OR {ratio} < {first})").select("u", "v")

    many = tx.narrow(about.join(parts.where("NOT few").select("head"), "head"))
    if many.isEmpty():
        return by_token.distinct()
    own, part = F.expr(ratio_of(percent, "d", "n")), percent / (100 + percent)
    pair_ratio = [(part * own + (1 - part) * F.col(c)).alias(k) for c, k in (("lo", "low"), ("hi", "high"))]  # a member has this part of a pair's size at least
    bounds = many.groupBy("head").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    diffs = held.select("head", "doc", "diff").join(many.join(bounds, "head"), ["head", "doc"]).select("head", "doc", *pair_ratio, "diff")
    signed = tx.kept_safe(diffs.repartition(F.xxhash64("head", "doc")).mapInArrow(_sign_diffs(ring_bits), "head long, doc long, plan long, key long"))
    key = ["head", "plan", "key"]
    both = signed.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").drop("c")
    bands = still_open(signed.join(both, key).join(many, ["head", "doc"]), key)
    left, right = _sides(bands, *key)
    steps = F.array(*map(F.lit, [*DIFF_RATIOS, float("inf")]))
    here = (F.expr(ratio) >= F.get(steps, F.col("plan").cast("int"))) & (F.expr(ratio) < F.get(steps, F.col("plan").cast("int") + 1))
    return by_token.unionByName(left.join(right, key).where(apart).where(here).select("u", "v")).distinct()


def described_by(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v): the heads u from which a member v of open groups is described; and (doc, top): the first of them.

    That is the heaviest text of all its groups, or that one's own heaviest, so versions of one text
    have one description each, whichever of them meet without it; and, in groups whose members
    have different ones, the group's own heaviest.  So whoever shares a group shares a head.
    """
    heads = rest.groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc")).alias("d"))).alias("h"))
    met = rest.select("band", F.col("doc").alias("v")).join(heads, "band")
    top = tx.narrow(met.groupBy("v").agg(F.max("h").alias("t")).select("v", (-F.col("t.d")).alias("u")))
    over = top.select(F.col("v").alias("u"), F.col("u").alias("w"))
    top = tx.narrow(top.join(over, "u").select("v", F.col("w").alias("u")))
    mixed = met.join(top, "v").groupBy("band").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo < hi").select("band")
    pairs = top.select("u", "v").unionByName(met.join(mixed, "band").select((-F.col("h.d")).alias("u"), "v")).distinct()
    return tx.narrow(pairs), top.select(F.col("v").alias("doc"), F.col("u").alias("top"))


def settle(members: DataFrame, links: DataFrame, tried: DataFrame, docs: DataFrame, width: int, percent: int, ring_bits: int) -> DataFrame:
    """links and those among members that connect what was not connected yet.

    Members of candidate groups are described by what they share with a head (the text that the
    others are versions of), so two of them are only looked at together when they share shingles
    that it lacks, or so many of their differences from it as a link needs.
    """
    rest = still_open(named(members, labels(links)), ["band"])
    if rest.isEmpty():
        return links
    pairs, top = described_by(rest)
    schema = "head long, doc long, n long, n_head long, shared long, own array<long>, lacks array<long>"
    met = tx.kept_safe(with_sets(pairs, docs, width).mapInArrow(_against(percent), schema).where("doc <> head"))
    near = met.where(f"100 * shared >= {percent} * (n + n_head - shared)").select(F.least("head", "doc").alias("u"), F.greatest("head", "doc").alias("v"))
    links = tx.narrow(links.unionByName(near).distinct())
    met = open_rows(named(met.join(top, "doc"), labels(links)), ["head"])
    met = tx.kept_safe(met.join(met.groupBy("head").agg(F.min("n").alias("fewest")), "head"))
    index, held = by_own(met, percent), inside(met, percent)
    fresh = stars(index, held.drop("own", "lacks", "diff")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    fresh = tx.narrow(fresh.join(tried, ["u", "v"], "left_anti"))
    if not fresh.isEmpty():
        tried = tried.unionByName(fresh)
        links = tx.narrow(links.unionByName(confirmed(fresh, docs, width, percent)))
        label = labels(links)
        index, held = named(index, label), named(held, label)
    fresh = crossing_own(index, percent).unionByName(crossing(held, percent, ring_bits)).distinct()
    fresh = tx.narrow(fresh.join(tried, ["u", "v"], "left_anti"))
    if fresh.isEmpty():
        return links
    return tx.narrow(links.unionByName(confirmed(fresh, docs, width, percent)))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, ring_bits: int = RING_BITS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, class_id.

    class_id is the smallest doc_id with the same shingle set, component_id the smallest doc_id
    reachable over links of Jaccard similarity of percent/100 or more.

    In a candidate group every member meets its head; two others are only compared when they share
    so many of their differences from it as a link needs (see `crossing`), so a group of versions
    does not become all its pairs.  Groups and classes are found by aggregates that combine before the shuffle; the joins
    back to them are plain sort-merge joins that AQE splits on hot keys.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with tx.small_batches(docs.sparkSession):  # every Python stage is run and checkpointed in here
        return _components(docs, shingle_words, percent, bands, rows, ring_bits)


def _components(docs: DataFrame, shingle_words: int, percent: int, bands: int, rows: int, ring_bits: int) -> DataFrame:
    signed = tx.kept_safe(docs.mapInArrow(_sign(shingle_words, bands, rows, ring_bits), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"))
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = tx.kept_safe(usable.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands")))

    doc = F.col("class_id").alias("doc")
    members = grouped(classes.select(doc, F.explode("bands").alias("band")), classes.select(doc, "n_shingles"))
    pairs = first_pairs(members, percent)
    pairs = tx.narrow(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    links = confirmed(pairs, docs, shingle_words, percent)
    links = settle(members, links, pairs, docs, shingle_words, percent, ring_bits)

    label = components(links).select(F.col("node").alias("class_id"), "component")
    named = classes.select("fp1", "fp2", "n_shingles", "class_id").join(label, "class_id", "left")
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "class_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Rows that share a doc_id but not their text are documents of their own, known by a hash of
    both.  Repeated rows of one doc_id and text leave one, by a hash of the row; rows without
    doc_id or without words all stay.
    """
    node = tx.free("_node", docs.columns)
    id_, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    texts = docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("h")).where("doc_id IS NOT NULL").groupBy("doc_id")
    several = tx.kept_safe(texts.agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("n > 1"))
    mixed, again = several.where("lo <> hi").select("doc_id"), several.where("lo = hi").select("doc_id")
    nodes = docs.withColumn(node, id_)
    if not mixed.isEmpty():
        odd = tx.pick(nodes, mixed, "doc_id").withColumn(node, F.xxhash64(id_, text))
        nodes = tx.pick(nodes, mixed, "doc_id", "left_anti").unionByName(odd)
        more = odd.where(F.col(node).isNotNull()).groupBy(node).count().where("count > 1").select(F.col(node).alias("doc_id"))
        again = tx.kept_safe(again.unionByName(more))
    found = tx.kept_safe(near_duplicates(nodes.select(F.col(node).alias("doc_id"), text.alias("text")), **options))
    gone = tx.kept_safe(found.where("NOT kept").select(F.col("doc_id").alias(node)).distinct())
    rest = tx.pick(nodes, gone, node, "left_anti")
    again = tx.kept_safe(found.where("kept AND n_shingles > 0").join(again, "doc_id", "left_semi").select(F.col("doc_id").alias(node)).distinct())
    if again.isEmpty():
        return rest.drop(node)
    row = F.struct(*docs.columns)
    once = tx.pick(rest, again, node).groupBy(node).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return tx.pick(rest, again, node, "left_anti").drop(node).unionByName(once)

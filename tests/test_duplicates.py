"""Copies of blocks read the blocks once."""

from folio.operators.blocks import duplicate_blocks

BOX = "struct<x:double,y:double,w:double,h:double>"


def test_blocks_are_read_once(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 7, "d"), (None, 1, "e")]

    def seen(r):
        calls.add(1)
        return r

    raw = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "page_id long, block_ord int, block_id string")
    blocks = raw.selectExpr("*", f"CAST(named_struct('x', 990, 'y', 5, 'w', 10, 'h', 20) AS {BOX}) AS bbox", f"CAST(NULL AS {BOX}) AS render_bbox")
    ids = spark.createDataFrame([("b",), ("c",), ("c",), ("d",), ("e",), ("z",)], "block_id string")
    out = duplicate_blocks(blocks, ids)
    assert out.dtypes == blocks.dtypes
    got = sorted(((r.page_id or 0), r.block_ord, r.block_id, r.bbox.x, r.bbox.w) for r in out.collect())
    assert got == [(0, 1, "e", 990, 10), (1, 1, "a", 990, 10), (1, 2, "b", 990, 10), (1, 3, "c", 990, 10), (1, 4, "b-copy-4", 1000, 0), (1, 5, "c-copy-5", 1000, 0), (2, 7, "d", 990, 10), (2, 8, "d-copy-8", 1000, 0)]
    assert calls.value == len(rows)

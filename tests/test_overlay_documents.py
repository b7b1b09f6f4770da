"""Overlay documents: items in order of numbers of any width, those of one number by their contents."""

import json

from folio.sources.attempts import overlay_documents


def test_items_are_in_order_whatever_order_rows_have(spark):
    rows = [(1, n, "sfx", (1.0, 2.0, 3.0, 4.0), "J", k) for n, k in ((10, "a"), (2, "b"), (2, "a"), (3_000_000_000, "c"))]
    kinds = "page_id long, id long, type string, bbox struct<x:double,y:double,w:double,h:double>, jp string, ko string"
    for given in (rows, rows[::-1]):
        out = json.loads(overlay_documents(spark.createDataFrame(given, kinds).coalesce(1)).first().json)
        assert [(i["id"], i["ko"]) for i in out["items"]] == [(2, "a"), (2, "b"), (10, "a"), (3_000_000_000, "c")]

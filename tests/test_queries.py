"""Registered queries against their DuckDB SQL on the small tables, and the entry module's contract."""

from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from folio import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FAST = sorted(n for n in registry.QUERIES if n in registry.ORACLE_SQL and not n.startswith(("n2", "n3", "n4", "n7", "n8")))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    expected = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns) and len(got) > 0
    assert _rows(got) == _rows(expected)


def test_contract():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and registry.FLAGSHIP in q and set(registry.QUERIES) <= set(q)


def test_windows_are_partitioned(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    for name in ("f1_list_library", "f4_reorder_records", "h1_adjacent_pages", "h6_status_feed", "chapter_report"):
        plan = registry.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "SinglePartition" not in plan


WHOLE = {
    "c3_repair_json": "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY item_ord) AS id, type, jp, ko FROM b_items WHERE ko <> ''",
    "c6_parse_errors": "SELECT DISTINCT page_id FROM b_items",
    "f2_locate_chapters": "SELECT chapter_id, work_id FROM b_chapters",
}
WHOLE["c5_normalize_items"] = WHOLE["c3_repair_json"]


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_takes_all_rows(spark, duck, name):
    from folio.plans.bindings import with_views

    expected = duck.execute(with_views(WHOLE[name]).replace("AS STRING)", "AS VARCHAR)")).fetchdf()
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    assert _rows(got[expected.columns]) == _rows(expected)

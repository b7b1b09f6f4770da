"""Views that give the test tables the shape of the data model, in SQL that both engines accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "b_works": "SELECT c_custkey AS work_id, c_name AS title, c_custkey AS work_ord FROM customer",
    "b_chapters": "SELECT o_orderkey AS chapter_id, o_custkey AS work_id, o_orderpriority AS title, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS chapter_ord, o_orderdate AS created_at FROM orders",
    "b_lines": "SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS pos FROM lineitem",
    "b_pages": "SELECT l_orderkey * 1000 + pos AS page_id, l_orderkey AS chapter_id, pos AS page_ord, concat('p', CAST(pos AS STRING), '.png') AS name, 600 + p_size * 20 AS width, 900 + p_size * 20 AS height, CASE WHEN l_quantity <= 3 THEN 'running' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'N' THEN 'idle' ELSE 'completed' END AS analysis_status FROM b_lines JOIN part ON p_partkey = l_partkey",
    "b_items": "SELECT l_orderkey AS page_id, pos AS item_ord, CASE l_partkey % 5 WHEN 0 THEN 'dialogue' WHEN 1 THEN 'narration' WHEN 2 THEN 'name' WHEN 3 THEN 'sfx' ELSE 'sign' END AS type, l_partkey % 1100 AS x, (l_suppkey * 37) % 1100 AS y, CAST(l_quantity AS INT) * 25 AS w, (l_partkey % 97) * 15 AS h, CASE WHEN l_partkey % 13 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN concat('J', CAST(l_partkey AS STRING), '[?]') ELSE concat('J', CAST(l_partkey AS STRING)) END AS jp, CASE WHEN l_partkey % 19 = 0 THEN '' ELSE concat('K', CAST(l_suppkey AS STRING)) END AS ko FROM b_lines",
    "b_sizes": "SELECT o_orderkey AS page_id, CAST(600 + o_orderkey % 50 * 20 AS INT) AS width, CAST(900 + o_orderkey % 50 * 20 AS INT) AS height FROM orders",
    "b_events": "SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, ts, CASE event_type WHEN 'signup' THEN 'booting' WHEN 'view' THEN 'page_running' WHEN 'click' THEN 'page_retry' WHEN 'purchase' THEN 'page_done' ELSE 'page_skipped' END AS phase, CASE WHEN value < 60 THEN NULL ELSE CAST(floor(value) AS INT) END AS progress_current, CASE WHEN event_type = 'signup' THEN NULL ELSE 100 END AS progress_total FROM events",
    "b_attempts": "SELECT user_id * 100 + day(ts) AS page_id, CAST(row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS INT) AS attempt, event_type = 'purchase' AS ok, CASE event_type WHEN 'error' THEN 'Gemma request failed (500).' WHEN 'click' THEN 'Model returned an empty response.' WHEN 'view' THEN 'Gemma response JSON parse failed.' WHEN 'signup' THEN 'Timed out while waiting for server' ELSE NULL END AS message FROM events",
    "b_page_items": "SELECT p.page_id, i.item_ord, i.type, i.x, i.y, i.w, i.h, i.jp, i.ko FROM b_pages p JOIN b_items i ON i.page_id = p.chapter_id AND (i.item_ord + p.page_ord) % 3 = 0",
    "b_local": "SELECT page_id, chapter_id, page_ord + 100 AS page_ord, concat('edited-', name) AS name, width + 7 AS width, height + 9 AS height, CASE WHEN page_id % 4 = 0 THEN 'idle' ELSE 'completed' END AS analysis_status FROM b_pages WHERE page_id % 3 <> 0",
    "b_dirty": "SELECT page_id FROM b_pages WHERE page_id % 7 = 0",
    "b_order": "SELECT chapter_id, page_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY page_id % 11, page_id) AS INT) AS order_pos FROM b_pages WHERE page_id % 5 <> 0",
    "b_results": "SELECT page_id, r AS res_ord, CASE WHEN (page_id + r) % 4 = 0 THEN 'failed' ELSE 'completed' END AS new_status FROM b_pages CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 AS r) v WHERE page_id % 2 = 0 AND (r = 1 OR page_id % 6 = 0)",
    "b_files": "SELECT page_id AS file_id, concat(split_part(url, '?', 1), '_', CAST(page_id AS STRING), CASE page_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.webp' ELSE '.txt' END) AS path, CAST(floor(page_id / 50) AS BIGINT) AS container_id FROM pages",
    "b_drafts": "SELECT p_partkey AS draft_id, p_name AS title, p_size AS page_count FROM part",
    "b_selections": "SELECT p_partkey AS draft_id, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE upper(p_name) END AS title, p_partkey % 4 <> 0 AS enabled FROM part WHERE p_partkey % 9 <> 0",
    "b_edits": "SELECT event_id AS version, user_id AS chapter_id, ts, event_type AS snapshot FROM events",
    "b_snapshots": "SELECT p_brand AS repo, concat('s', CAST(p_partkey AS STRING)) AS snapshot, p_size AS mtime, p_partkey % 2 = 0 AS has_model, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 END AS companion_rank FROM part",
}


def _needed(sql: str) -> list[str]:
    """Views that a query needs, each after those it stands on."""
    out: list[str] = []
    for name in re.findall(r"\bb_\w+", sql):
        if name in VIEWS:
            out += [x for x in [*_needed(VIEWS[name]), name] if x not in out]
    return out


def in_cells(view: str) -> str:
    """The SQL of a view over lineitem or b_lines whose rows lie in cells of whole orders: it passes `cell` on, and its windows stay within."""
    out = VIEWS[view].replace("PARTITION BY l_orderkey", "PARTITION BY cell, l_orderkey")
    return out if "SELECT *" in out else re.sub(r" FROM ", ", cell FROM ", out, count=1)


def with_views(sql: str) -> str:
    """The query with the views it names as common table expressions before it."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in _needed(sql)]
    if not parts:
        return sql
    if sql.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + sql.lstrip()[5:]
    return "WITH " + ", ".join(parts) + " " + sql


class Tables:
    """The tables of a folder: b("SELECT ...") over them and the views, b.b_pages as a shorthand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, sql: str, **frames: DataFrame) -> DataFrame:
        """frames: tables and views by name that are taken from there."""
        full = sql if frames else with_views(sql)
        used = [t for t in TABLES if t not in frames and re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", full, re.I)]
        files = ", ".join([f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in used] + [f"{t} AS (SELECT * FROM {{{t}}})" for t in frames])
        if files:
            full = f"WITH {files}, {full[5:]}" if full.startswith("WITH ") else f"WITH {files} {full}"
        return self.spark.sql(full, **frames)

    def __getattr__(self, view: str) -> DataFrame:
        return self(f"SELECT * FROM {view}")

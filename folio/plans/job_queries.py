"""Registered queries over jobs, logs, texts and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folio.functions import labels as lab
from folio.functions import text as tx
from folio.operators import jobs
from folio.plans.spec import query
from folio.sources.logs import log_rows
from folio.streaming import jobs as streams

_LABEL = "CASE phase WHEN 'booting' THEN '모델 준비 중' WHEN 'page_running' THEN '페이지 번역 중' WHEN 'page_retry' THEN '페이지 재시도 중' WHEN 'page_done' THEN '페이지 완료' ELSE '페이지 건너뜀' END"
_CARRY = "last_value(progress_current IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_STATE = f"SELECT * FROM (SELECT job_id, seq, phase, {_CARRY} AS progress_current, {_CARRY.replace('progress_current', 'progress_total')} AS progress_total, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS k FROM b_events) s WHERE k = 1"
_FEED = f"SELECT job_id, seq, label, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS place FROM (SELECT *, lag(label) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM (SELECT job_id, seq, {_LABEL} AS label FROM b_events) l0) l1 WHERE before IS NULL OR before <> label"
_ERRORS = "CASE message WHEN 'Gemma request failed (500).' THEN 'model-request' WHEN 'Model returned an empty response.' THEN 'empty-model-response' WHEN 'Gemma response JSON parse failed.' THEN 'response-json-parse' WHEN 'Timed out while waiting for server' THEN 'server-startup' ELSE 'unknown' END"
_OUTCOME = "SELECT page_id, CASE WHEN won IS NOT NULL THEN 'completed' WHEN n >= 5 THEN 'failed' ELSE 'open' END AS status, won AS won_at, n AS n_attempts, CASE WHEN won IS NULL THEN msg END AS last_error FROM (SELECT page_id, min(attempt) FILTER (WHERE ok) AS won, count(*) AS n, arg_max(message, attempt) AS msg FROM b_attempts WHERE attempt <= 5 GROUP BY 1) a"


@query("job_id bigint, seq bigint, label string", f"SELECT job_id, seq, {_LABEL} AS label FROM b_events")
def d4_job_labels(b):
    none = F.lit(None).cast("int")
    return b.b_events.select("job_id", "seq", lab.job_label(F.col("phase"), F.lit("running"), none, none, none, none).alias("label"))


@query("page_id bigint, page_text string, chapter_text string", "SELECT page_id, CASE analysis_status WHEN 'completed' THEN '완료' WHEN 'running' THEN '진행' WHEN 'failed' THEN '실패' ELSE '대기' END AS page_text, CASE analysis_status WHEN 'completed' THEN '완료' WHEN 'running' THEN '진행 중' WHEN 'failed' THEN '실패' ELSE '대기' END AS chapter_text FROM b_pages")
def d4_status_labels(b):
    return b.b_pages.select("page_id", lab.page_status_label(F.col("analysis_status")).alias("page_text"), lab.chapter_status_label(F.col("analysis_status")).alias("chapter_text"))


@query("page_id bigint, attempt bigint, category string", f"SELECT page_id, attempt, {_ERRORS} AS category FROM b_attempts WHERE NOT ok")
def e7_classify_failure(b):
    return b("SELECT * FROM b_attempts WHERE NOT ok").select("page_id", "attempt", lab.classify_failure(F.col("message")).alias("category"))


@query("page_id bigint, status string, won_at bigint, n_attempts bigint, last_error string", _OUTCOME)
def g5_attempt_outcome(b):
    return jobs.attempt_outcome(b.b_attempts)


@query("page_id bigint, next_attempt bigint", "SELECT page_id, max(attempt) + 1 AS next_attempt FROM b_attempts GROUP BY 1 HAVING NOT bool_or(ok)")
def g5_retry_pages(b):
    return jobs.retry_pages(b("SELECT DISTINCT page_id FROM b_attempts"), b.b_attempts)


@query("category string, failures bigint, pages bigint, retries bigint", f"SELECT {_ERRORS} AS category, count(*) AS failures, count(DISTINCT page_id) AS pages, count(*) FILTER (WHERE attempt > 1) AS retries FROM b_attempts WHERE NOT ok GROUP BY 1")
def g6_failure_report(b):
    return jobs.failure_report(b.b_attempts)


@query("job_id bigint, result string", "SELECT job_id, CASE arg_max(phase, seq) WHEN 'page_skipped' THEN 'failed' ELSE 'completed' END AS result FROM b_events GROUP BY 1")
def g7_run_result(b):
    return jobs.run_result(b("SELECT job_id, seq, CASE phase WHEN 'page_skipped' THEN 'failed' ELSE phase END AS phase FROM b_events"))


@query("job_id bigint, summary string", "SELECT job_id, CASE WHEN bool_or(phase = 'page_skipped') AND bool_or(phase = 'page_retry') THEN '일부 페이지를 건너뛰었고 OCR 확인이 필요한 블록도 있습니다.' WHEN bool_or(phase = 'page_skipped') THEN '일부 페이지는 건너뛰고 다음 페이지로 진행했습니다.' WHEN bool_or(phase = 'page_retry') THEN '일부 블록은 OCR 확인이 더 필요합니다.' ELSE '중간 경고가 있었지만 작업은 계속 진행되었습니다.' END AS summary FROM b_events GROUP BY 1")
def g4_warning_summary(b):
    return jobs.run_warnings(b("SELECT job_id, CASE phase WHEN 'page_skipped' THEN 'p1: 건너뜁니다.' WHEN 'page_retry' THEN 'p1: 불확실한 OCR 조각이 2개 있습니다.' ELSE 'other' END AS warning FROM b_events"))


@query("job_id bigint, seq bigint, phase string, progress_current bigint, progress_total bigint", _STATE)
def h5_latest_job_state(b):
    return jobs.latest_job_state(b.b_events)


@query("job_id bigint, seq bigint, progress_current bigint", f"SELECT job_id, seq, {_CARRY} AS progress_current FROM b_events")
def h5_job_states(b):
    return jobs.job_states(b.b_events)


@query("job_id bigint, place bigint, seq bigint, label string", f"SELECT * FROM ({_FEED}) f WHERE place <= 16")
def h6_status_feed(b):
    return jobs.status_feed(b.b_events)


@query("job_id bigint, seq bigint", "SELECT job_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS k FROM b_events) x WHERE k <= 16")
def i3_top_recent(b):
    return jobs.most_recent(b.b_events, "job_id", "seq")


@query("job_id bigint, mode string, current bigint, total bigint, ratio double", f"SELECT job_id, mode, CASE WHEN mode = 'determinate' THEN least(t, greatest(0, progress_current)) END AS current, CASE WHEN mode = 'determinate' THEN t END AS total, CASE WHEN mode = 'determinate' THEN least(t, greatest(0, progress_current)) / CAST(t AS DOUBLE) END AS ratio FROM (SELECT *, progress_total AS t, CASE WHEN phase = 'booting' THEN 'indeterminate' WHEN progress_current IS NOT NULL AND progress_total > 0 THEN 'determinate' END AS mode FROM ({_STATE}) s0) s1")
def h7_progress(b):
    return jobs.progress(jobs.latest_job_state(b.b_events))


@query("job_id bigint, seq bigint", "SELECT job_id, seq FROM b_events WHERE phase IN ('page_done', 'page_skipped')")
def n5_refresh_events(b):
    return jobs.refresh_events(b.b_events)


@query("job_id bigint, at bigint, level string, message string, seq bigint", "SELECT job_id, epoch_us(ts) // 1000 AS at, 'INFO' AS level, phase AS message, seq FROM b_events")
def a6_log_lines(b):
    rows = b.b_events
    line = F.concat(F.lit("["), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] [INFO] "), "phase", F.lit(" "), F.to_json(F.struct("job_id", "seq")))
    out = log_rows(rows.select(line.alias("value")))
    v = F.try_parse_json("detail_json")
    return out.select(F.try_variant_get(v, "$.job_id", "bigint").alias("job_id"), F.unix_millis("ts").alias("at"), "level", "message", F.try_variant_get(v, "$.seq", "bigint").alias("seq"))


@query("event_id bigint, at bigint", "SELECT event_id, epoch_us(ts) // 1000 AS at FROM events")
def m1_parse_iso(b):
    rows = b("SELECT event_id, ts FROM events")
    return rows.select("event_id", F.unix_millis(tx.parse_iso(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).alias("at"))


@query("part_id bigint, norm string", "SELECT p_partkey AS part_id, lower(p_name) AS norm FROM part")
def l1_search_norm(b):
    return tx.with_search_text(b("SELECT p_partkey AS part_id, concat('  ', upper(p_name), ' ') AS n FROM part"), "n", "norm")


_WS = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("doc_id bigint, short string, note string", f"SELECT doc_id, CASE WHEN length({_WS}) <= 240 THEN {_WS} ELSE substring({_WS}, 1, 239) || '…' END AS short, CASE WHEN length(text) <= 300 THEN text ELSE substring(text, 1, 300) || '... [truncated ' || CAST(length(text) - 300 AS VARCHAR) || ' chars]' END AS note FROM documents")
def l2_l3_preview_truncate(b):
    return b("SELECT doc_id, text FROM documents").select("doc_id", tx.preview(F.col("text")).alias("short"), tx.truncate_note(F.col("text"), 300).alias("note"))


@query("file_id bigint, mime string, image boolean, ext string, base string, stem string", "SELECT file_id, CASE WHEN file_id % 5 IN (1, 2) THEN 'image/jpeg' WHEN file_id % 5 = 3 THEN 'image/webp' ELSE 'image/png' END AS mime, file_id % 5 <> 4 AS image, CASE file_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'webp' ELSE 'txt' END AS ext, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM b_files")
def l4_path_scalars(b):
    p = F.col("path")
    return b.b_files.select("file_id", tx.mime_of(p).alias("mime"), tx.is_image(p).alias("image"), tx.extension(p).alias("ext"), tx.basename(F.regexp_replace(p, "/", r"\\")).alias("base"), tx.strip_ext(tx.basename(p)).alias("stem"))


@query("draft_id bigint, title string", "SELECT draft_id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title FROM b_selections")
def l5_sanitize_title(b):
    return b.b_selections.select("draft_id", tx.sanitize_title(F.concat(F.lit(" \t"), "title", F.lit("　")), "Untitled").alias("title"))


@query("doc_id bigint, line string", "SELECT doc_id, replace(text, chr(10), '\\n') AS line FROM documents")
def l6_escape_newlines(b):
    return b("SELECT doc_id, text FROM documents").select("doc_id", tx.escape_newlines(F.col("text")).alias("line"))


@query("part_id bigint, v double", "SELECT p_partkey AS part_id, CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN 0 WHEN 2 THEN 16 WHEN 3 THEN NULL ELSE p_size END AS v FROM part")
def l7_js_number(b):
    rows = b("SELECT p_partkey AS part_id, CASE p_partkey % 5 WHEN 0 THEN CAST(p_retailprice AS STRING) WHEN 1 THEN ' ' WHEN 2 THEN '0x10' WHEN 3 THEN '12px' ELSE concat(' ', CAST(p_size AS STRING), ' ') END AS s FROM part")
    return rows.select("part_id", tx.js_number(F.col("s")).alias("v"))


@query("doc_id bigint, url string", "SELECT doc_id, 'data:image/webp;base64,' || to_base64(encode(text)) AS url FROM documents")
def g9_data_url(b):
    return b("SELECT doc_id, text FROM documents").select("doc_id", tx.data_url(F.lit("a/b.WEBP"), F.encode("text", "utf-8")).alias("url"))


_BURST = "SELECT chapter_id, min(ts) AS s, arg_max(snapshot, version) AS snapshot, max(version) AS version, count(*) AS edits FROM (SELECT *, sum(fresh) OVER (PARTITION BY chapter_id ORDER BY ts, version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY chapter_id ORDER BY ts, version) > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM b_edits) e0) e1 GROUP BY chapter_id, burst"


@query("chapter_id bigint, started bigint, snapshot string, version bigint, edits bigint", f"SELECT chapter_id, epoch_us(s) // 1000 AS started, snapshot, version, edits FROM ({_BURST}) x")
def n6_coalesce_edits(b):
    rows = b.b_edits.withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.coalesce_edits(rows, "6 hours").withColumn("started", F.unix_millis("burst_start"))


_JOBS = "SELECT chapter_id, min(ts) + INTERVAL 2 DAY AS started, min(ts) + INTERVAL 6 DAY AS ended FROM b_edits GROUP BY chapter_id"
_HELD = f"SELECT e.version, e.chapter_id, e.snapshot, coalesce(j.ended, e.ts) AS ts FROM b_edits e LEFT JOIN ({_JOBS}) j ON j.chapter_id = e.chapter_id AND e.ts >= j.started AND e.ts < j.ended"


@query("chapter_id bigint, started bigint, snapshot string, version bigint, edits bigint", f"SELECT chapter_id, epoch_us(s) // 1000 AS started, snapshot, version, edits FROM ({_BURST.replace('FROM b_edits', f'FROM ({_HELD}) h')}) x")
def n6_held_edits(b):
    """Edits made while a chapter's job runs are saved at its end."""
    rows = b.b_edits.withColumn("ts", F.col("ts").cast("timestamp"))
    jobs = b(_JOBS).withColumns({k: F.col(k).cast("timestamp") for k in ("started", "ended")})
    return streams.coalesce_edits(rows, "6 hours", jobs).withColumn("started", F.unix_millis("burst_start"))


@query("chapter_id bigint, started bigint, snapshot string, version bigint, edits bigint", f"SELECT chapter_id, epoch_us(s) // 1000 AS started, snapshot, version, edits FROM ({_BURST}) x")
def n6_stream_edits(b):
    """The same bursts from a stream; a row far ahead of the others, left out again, lets the last ones end."""
    rows = b("SELECT version, chapter_id, ts, snapshot FROM b_edits UNION ALL SELECT -1, -1, max(ts) + INTERVAL 2 DAY, '' FROM b_edits").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _streamed(b, [_by_time(rows)], lambda edits: streams.coalesce_edits(edits, "6 hours")).where("chapter_id >= 0")
    return out.withColumn("started", F.unix_millis("burst_start"))


@query("chapter_id bigint, started bigint, snapshot string, version bigint, edits bigint", f"SELECT chapter_id, epoch_us(s) // 1000 AS started, snapshot, version, edits FROM ({_BURST.replace('FROM b_edits', f'FROM ({_HELD}) h')}) x")
def n6_stream_held_edits(b):
    """Held edits where jobs come as a stream of their own, beside the edits."""
    far = "max(ts) + INTERVAL 12 DAY"
    edits = b(f"SELECT version, chapter_id, ts, snapshot FROM b_edits UNION ALL SELECT -1, -1, {far}, '' FROM b_edits")
    marks = b(f"SELECT chapter_id, started AS ts, true AS running FROM ({_JOBS}) x UNION ALL SELECT chapter_id, ended, false FROM ({_JOBS}) y UNION ALL SELECT -1, {far}, false FROM b_edits")
    low, high = edits.agg(F.min("ts"), F.max("ts")).first()
    rows = [_by_time(r.withColumn("ts", F.col("ts").cast("timestamp")), (low, high)) for r in (edits, marks)]
    out = _streamed(b, rows, lambda e, m: streams.coalesce_edits(e, "6 hours", m)).where("chapter_id >= 0")
    return out.withColumn("started", F.unix_millis("burst_start"))


#: Files, and so micro-batches, that a streamed query's rows come in.
_FILES = 3


def _by_time(rows, bounds=None):
    """rows with the number of their file, which follow one another in time."""
    low, high = bounds or rows.agg(F.min("ts"), F.max("ts")).first()
    span = F.unix_micros(F.lit(high).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp")) + 1
    place = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low).cast("timestamp"))) * _FILES / span)
    return rows.withColumn("_file", F.greatest(F.lit(0), F.least(F.lit(_FILES - 1), place)))


def _mixed_up(rows, *key: str):
    """rows dealt to files without order, every third of them delivered again with a later or an earlier one."""
    n = F.pmod(F.xxhash64(*key), F.lit(3 * _FILES))
    return rows.withColumn("_file", F.floor(n / 3)).unionByName(rows.where(n % 3 == 0).withColumn("_file", F.pmod(F.floor(n / 3) + 1 + n % 2, F.lit(_FILES))))


def _streamed(b, rows: list, transform, key: list[str] | None = None):
    """Runs a stream over written copies of the rows, which arrive file by file, and goes on from its checkpoint for each; with a key, what its last micro-batch said of it.

    A file has as many parts as Spark's tasks write, and all of them make one micro-batch, so none is read or written by one task.
    """
    from folio.streaming.session import shared_folder, state_store

    at, schemas = f"{shared_folder(b.spark)}/stream-{uuid.uuid4().hex}", [r.schema for r in rows]
    for k, r in enumerate(rows):
        r.write.partitionBy("_file").parquet(f"{at}/all{k}")

    def arrive(file: int) -> None:
        for k, schema in enumerate(schemas):
            b.spark.read.schema(schema).parquet(f"{at}/all{k}").where(F.col("_file") == file).drop("_file").write.mode("append").parquet(f"{at}/in{k}")

    def keep(batch, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    for file in range(_FILES):
        arrive(file)
        sources = [b.spark.readStream.schema(r.drop("_file").schema).parquet(f"{at}/in{k}") for k, r in enumerate(rows)]
        writer = transform(*sources).writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").outputMode("update" if key else "append")
        with state_store(b.spark):
            writer.trigger(availableNow=True).start().awaitTermination()
    out = b.spark.read.parquet(f"{at}/out")
    return out.join(out.groupBy(*key).agg(F.max("batch").alias("batch")), [*key, "batch"]) if key else out


@query("job_id bigint, seq bigint, phase string, progress_current bigint, progress_total bigint", _STATE)
def n2_stream_job_state(b):
    rows = b.b_events.withColumn("ts", F.col("ts").cast("timestamp"))
    return _streamed(b, [_by_time(rows)], streams.stream_job_state, ["job_id"])


@query("job_id bigint, place bigint, seq bigint, label string", f"SELECT * FROM ({_FEED}) f WHERE place <= 16")
def n3_stream_status_feed(b):
    rows = b.b_events.withColumn("ts", F.col("ts").cast("timestamp"))
    return _streamed(b, [_by_time(rows)], streams.stream_status_feed, ["job_id"])


@query("page_id bigint, status string, last_error string", f"SELECT page_id, status, last_error FROM ({_OUTCOME}) o WHERE status <> 'open'")
def n8_stream_attempts(b):
    """Attempts in no order, some of them told twice."""
    return _streamed(b, [_mixed_up(b.b_attempts, "page_id", "attempt")], streams.stream_attempts)


@query("response_id bigint, text string, n_events bigint", "SELECT conv_id AS response_id, trim(string_agg(text, '' ORDER BY turn)) AS text, count(*) + 1 AS n_events FROM conversations GROUP BY 1")
def n7_stream_assemble_response(b):
    """Events in no order, some of them told twice."""
    from folio.operators.replies import parse_sse
    from folio.plans.block_queries import _sse

    rows = parse_sse(_sse(b)).select("response_id", "pos", "type", "delta", "response", "nested")
    return _streamed(b, [_mixed_up(rows, "response_id", "pos")], streams.stream_assemble_response)


@query("job_id bigint, at bigint, level string, message string", "SELECT job_id, epoch_us(ts) // 1000 AS at, 'INFO' AS level, phase AS message FROM b_events")
def n1_stream_log(b):
    rows = b.b_events
    line = F.concat(F.lit("["), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] [INFO] "), "phase", F.lit(" "), F.to_json(F.struct("job_id")))
    rows = _by_time(rows.select(F.col("ts").cast("timestamp").alias("ts"), line.alias("value")))
    out = _streamed(b, [rows.drop("ts")], log_rows)
    return out.select(F.try_variant_get(F.try_parse_json("detail_json"), "$.job_id", "bigint").alias("job_id"), F.unix_millis("ts").alias("at"), "level", "message")


def _append_lines(batches):
    """Rows (file, line), those of a file together, are appended to their files."""
    from folio.sources.storage import located

    for rows in batches:
        for file, part in rows.groupby("file", sort=False):
            store, place = located(file)
            with store.open_append_stream(place) as f:
                f.write("".join(f"{x}\n" for x in part["line"]).encode())
        yield rows[["file"]]


@query("job_id bigint, seq bigint, level string, message string", "SELECT job_id, seq, 'INFO' AS level, phase AS message FROM b_events")
def n1_tail_log(b):
    """A log file for every hundredth of the jobs, which grows twice while a stream follows it."""
    from folio.sources.logs import tail_log
    from folio.sources.storage import located
    from folio.streaming.session import shared_folder

    at = f"{shared_folder(b.spark)}/stream-{uuid.uuid4().hex}"
    store, place = located(f"{at}/logs")
    store.create_dir(place, recursive=True)
    line = F.concat(F.lit("["), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] [INFO] "), "phase", F.lit(" "), F.to_json(F.struct("job_id", "seq")))
    file = F.concat(F.lit(f"{at}/logs/"), F.pmod("job_id", F.lit(100)).cast("string"), F.lit(".log"))
    rows = b.b_events.select(file.alias("file"), line.alias("line"), (F.col("seq") % 2).alias("half"))
    for half in (0, 1):
        part = rows.where(F.col("half") == half).drop("half").repartition("file").sortWithinPartitions("file")
        part.mapInPandas(_append_lines, "file string").count()
        keep = lambda batch, n, half=half: batch.write.mode("overwrite").parquet(f"{at}/out/half={half}/batch={n}")
        tail_log(b.spark, f"{at}/logs").writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    v = F.try_parse_json("detail_json")
    return b.spark.read.parquet(f"{at}/out").select(F.try_variant_get(v, "$.job_id", "bigint").alias("job_id"), F.try_variant_get(v, "$.seq", "bigint").alias("seq"), "level", "message")


@query("page_id bigint, analysis_status string", "SELECT p.page_id, coalesce(r.new_status, p.analysis_status) AS analysis_status FROM b_pages p LEFT JOIN (SELECT page_id, new_status, row_number() OVER (PARTITION BY page_id ORDER BY res_ord DESC) AS k FROM b_results) r ON r.page_id = p.page_id AND r.k = 1")
def n4_stream_page_results(b):
    """Results arrive as a stream of events and are applied to the catalogue, batch by batch."""
    from folio.operators.catalogue import apply_page_results
    from folio.streaming.session import shared_folder

    at = f"{shared_folder(b.spark)}/stream-{uuid.uuid4().hex}"
    events = b("SELECT page_id, res_ord, new_status, 'page_done' AS phase FROM b_results UNION ALL SELECT page_id, 9 AS res_ord, 'running' AS new_status, 'page_running' AS phase FROM b_results")
    events.write.parquet(f"{at}/in")

    def apply(batch, n: int) -> None:
        """A batch's results, written under its number, so a repeated batch replaces itself; pages are merged when read."""
        batch.withColumn("error", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{at}/results/batch={n}")

    source = b.spark.readStream.schema(events.schema).parquet(f"{at}/in")
    streams.stream_page_results(source, apply, f"{at}/checkpoint").awaitTermination()
    pages = b("SELECT *, CAST(NULL AS STRING) AS last_error FROM b_pages")
    return apply_page_results(pages, b.spark.read.parquet(f"{at}/results"))

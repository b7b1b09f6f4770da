"""Files, archives, library round trip, attempts, logs, streams."""

import json
import re
import time
import zipfile
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.sources import attempts, files, library, logs


def put(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


def test_folders_and_images(spark, tmp_path):
    for p in ("01 첫화/001.webp", "01 첫화/002.png", "02 둘째/scene-a/001.jpg", "README.txt", "root.PNG"):
        put(tmp_path / p)
    (tmp_path / "03 비어있음").mkdir()
    got = files.scan_nested_folders(spark, str(tmp_path)).collect()
    assert [(r.title, r.pages) for r in got] == [("01 첫화", ["001.webp", "002.png"]), ("02 둘째/scene-a", ["001.jpg"])]
    assert files.scan_images(spark, str(tmp_path)).count() == 4


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("p10.png", "p2.png", "dir/", "note.txt", "x\\p1.jpg"):
            z.writestr(n, b"x")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    rows = files.scan_zip_entries(spark, str(tmp_path)).collect()
    assert [r.zip_entry_name for r in sorted((r for r in rows if not r.error), key=lambda r: r.page_ord)] == ["p2.png", "p10.png", "x/p1.jpg"]
    assert sum(bool(r.error) for r in rows) == 1


def _library(tmp_path):
    at = "2024-01-02T03:04:05.000Z"
    block = {"id": "k1", "type": "speech", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}, "sourceText": "s", "translatedText": "t", "confidence": 0.92}
    page = lambda i, s: {"id": i, "name": f"{i}.png", "width": 10, "height": 20, "blocks": [block] if i == "p1" else [], "analysisStatus": s, "createdAt": at, "updatedAt": at}
    put(tmp_path / "index.json", {"workOrder": ["w1", "gone", "w1"]})
    put(tmp_path / "works/w1/work.json", {"id": "w1", "title": "W", "chapterOrder": ["c1", "missing"], "createdAt": at, "updatedAt": at})
    put(tmp_path / "works/w1/chapters/c1/chapter.json", {"id": "c1", "workId": "w1", "title": "C", "sourceKind": "images", "status": "running", "pageOrder": ["p2", "p1"], "createdAt": at, "updatedAt": at, "pages": [page("p1", "completed"), page("p2", "failed"), page("p3", "idle")]})


def test_library_round_trip(spark, tmp_path):
    _library(tmp_path)
    lib = library.read_library(spark, str(tmp_path))
    assert [(r.page_id, r.page_ord) for r in lib["pages"].orderBy("page_ord").collect()] == [("p2", 0), ("p1", 1), ("p3", 4)]
    assert lib["blocks"].count() == 1 and lib["works"].count() == 1 and lib["chapters"].count() == 1
    library.write_library(lib, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/chapters")).first()
    assert (back.status, back.pageOrder, back.pages[1].blocks[0].translatedText) == ("partial", ["p2", "p1", "p3"], "t")
    library.write_library(lib, str(tmp_path / "json"), fmt="json")
    assert spark.read.json(str(tmp_path / "json/works")).first().chapterOrder == ["c1"]


def test_attempts(spark, tmp_path):
    for n, text in ((1, "bad"), (2, "fine")):
        put(tmp_path / f"runs/r1/pages/p 1/attempt-{n}/result.json", {"createdAt": "2024-01-02T03:04:05.000Z", "outputText": text, "settings": {"model": "m"}})
    put(tmp_path / "runs/r1/pages/p 1/attempt-2/overlay-items.json", {"items": [{"id": 1, "ko": "k"}]})
    rows = {r.attempt: r for r in attempts.scan_attempts(spark, str(tmp_path)).collect()}
    assert (rows[1].ok, rows[2].ok, rows[2].page_id, rows[2].items[0].ko, rows[1].settings.model) == (False, True, "p 1", "k", "m")


def test_attempts_without_items(spark, tmp_path):
    put(tmp_path / "runs/r1/pages/p1/attempt-1/result.json", {"outputText": "x"})
    assert [r.ok for r in attempts.scan_attempts(spark, str(tmp_path)).collect()] == [False]


def test_logs(spark, tmp_path):
    put(tmp_path / "in/app.log", '﻿[2024-01-02T03:04:05.006Z] [INFO] ready {"a":1}\n[2024-01-02T03:04:06.000Z] [ERROR] broke {not json\nplain line\n'.encode())
    rows = logs.read_log(spark, str(tmp_path / "in")).orderBy("message").collect()
    assert {(r.level, r.message, r.detail_json) for r in rows} == {("INFO", "ready", '{"a":1}'), ("ERROR", "broke {not json", None), (None, "plain line", None)}
    q = logs.stream_log(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streams_over_several_batches(spark, tmp_path):
    """The folded state does not depend on how events fall into micro-batches."""
    from folio.operators.jobs import latest_job_state
    from folio.streaming.jobs import stream_job_state
    from folio.streaming.session import state_store

    rows = [(k % 3, k // 3, "page_running" if k % 2 else "booting", k if k % 4 == 0 else None, None) for k in range(40)]
    df = spark.createDataFrame(rows, "job_id long, seq int, phase string, progress_current int, progress_total int").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(secs=F.col("seq")))
    df = df.select("job_id", "seq", "ts", "phase", "progress_current", "progress_total")
    for k in range(3):
        df.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = {}

    def keep(batch, n):
        out.update({r.job_id: r for r in batch.collect()})

    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with state_store(spark):
        stream_job_state(source).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = {r.job_id: r for r in latest_job_state(df).collect()}
    assert {k: (r.seq, r.phase, r.progress_current) for k, r in out.items()} == {k: (r.seq, r.phase, r.progress_current) for k, r in batch.items()}


def _wide_library(spark, works, chapters, pages):
    none = F.lit(None)
    w = spark.range(works).select(F.col("id").cast("string").alias("work_id"), F.concat(F.lit("W"), "id").alias("title"), F.col("id").cast("int").alias("work_ord"))
    c = w.select("work_id", F.explode(F.sequence(F.lit(1), F.lit(chapters))).alias("k")).select(F.concat_ws(".", "work_id", "k").alias("chapter_id"), "work_id", F.lit("C").alias("title"), (F.col("k") - 1).alias("chapter_ord"), F.lit("images").alias("source_kind"), none.cast("timestamp").alias("created_at"), none.cast("timestamp").alias("updated_at"))
    p = c.select("chapter_id", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("k")).select(F.concat_ws("-", "chapter_id", "k").alias("page_id"), "chapter_id", F.lit("n").alias("name"), none.cast("string").alias("image_path"), F.lit(1).alias("width"), F.lit(2).alias("height"), F.when(F.col("k") == 1, "completed").otherwise("failed").alias("analysis_status"), none.cast("string").alias("last_error"), (pages - F.col("k")).alias("page_ord"), none.cast("timestamp").alias("created_at"), none.cast("timestamp").alias("updated_at"))
    kinds = {f.name: f.dataType for f in StructType.fromDDL(f"v {library.BLOCK}")["v"].dataType}
    b = p.where("page_ord > 0").select("page_id", F.explode(F.array(F.lit(1), F.lit(0))).alias("block_ord")).select(F.concat_ws("/", "page_id", "block_ord").alias("block_id"), "page_id", "block_ord", *[(F.lit("t") if new == "source_text" else none).cast(kinds[old]).alias(new) for old, new in library.BLOCK_COLUMNS.items()])
    return {"works": w, "chapters": c, "pages": p, "blocks": b}


def test_library_files_hold_few_chapters_each(spark, tmp_path):
    """No file, and so no task, grows with the library: works of many chapters too, and the index."""
    own = _wide_library(spark, 7, 40, 2)
    library.write_library_files(own, str(tmp_path), per=3)
    for path, most in (("works/all/chapters/all/chapter.json", 20), ("works/all/work.json", 7)):
        held = [len(json.loads(f.read_text())) for f in (tmp_path / path).glob("part-*") if f.stat().st_size]
        assert len(held) > 1 and max(held) <= most
    parts = [json.loads(f.read_text()) for f in (tmp_path / "index.json").glob("part-*") if f.stat().st_size]
    assert sorted((x["first"], len(x["workOrder"])) for x in parts) == [(0, 3), (3, 3), (6, 1)]
    back = library.read_library(spark, str(tmp_path))
    assert sorted((r.work_id, r.work_ord) for r in back["works"].collect()) == [(str(k), k) for k in range(7)]
    assert {r.status for r in back["chapters"].collect()} == {"partial"} and back["chapters"].count() == 280
    places = lambda lib: sorted((r.page_id, r.page_ord) for r in lib["pages"].collect())
    texts = lambda lib: sorted((r.block_id, r.page_id, r.block_ord, r.source_text) for r in lib["blocks"].collect())
    assert places(back) == places(own) and texts(back) == texts(own)


def test_nested_chapters_are_shuffled_flat(spark):
    own = _wide_library(spark, 2, 2, 2)
    own["blocks"] = own["blocks"].withColumn("chapter_id", F.split("page_id", "-")[0])
    plan = library.nested_chapters(own["chapters"], own["pages"], own["blocks"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def _kept(spark, skip=()):
    return {f for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*") if f not in skip}


def test_waves_write_the_whole_library_and_keep_no_shuffles(spark, tmp_path):
    own, before = _wide_library(spark, 7, 40, 2), _kept(spark)
    at = {k: spark.conf.get(k) for k in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.replaceHashWithSortAgg")}
    n = library.cells(own["chapters"], 2)
    assert library._waves(n) > 1
    library.write_library_files(own, str(tmp_path / "files"), per=2)
    library.write_library(own, str(tmp_path / "parquet"), n=n)
    library.write_library(own, str(tmp_path / "once"), mode="ignore", n=n)
    for _ in range(100):
        if not _kept(spark, before):
            break
        time.sleep(0.1)
    assert not _kept(spark, before) and at == {k: spark.conf.get(k) for k in at}
    for name, fmt in (("files", "files"), ("parquet", "parquet"), ("once", "parquet")):
        back = library.read_library(spark, str(tmp_path / name), fmt)
        for table, columns in (("pages", ("page_id", "chapter_id", "page_ord", "analysis_status")), ("blocks", ("block_id", "page_id", "block_ord", "source_text")), ("chapters", ("chapter_id", "work_id", "chapter_ord"))):
            rows = lambda lib: sorted(map(tuple, lib[table].select(*columns).collect()))  # noqa: B023, E731
            assert rows(back) == rows(own)
        assert {r.n for r in back["pages"].select(F.size("blocks").alias("n")).collect()} == {0, 2}


def test_chapter_files_are_parsed_once_for_pages_and_blocks(spark, tmp_path):
    from folio.plans.catalogue_queries import _shelf

    put(tmp_path / "index.json", {"workOrder": ["5"]})
    put(tmp_path / "works/5/work.json", {"id": "5", "title": "W", "chapterOrder": ["8"], "updatedAt": "1970-01-01T00:00:01.000Z"})
    block = lambda x: {"id": str(x), "bbox": {"x": x, "y": 0, "w": 1, "h": 1}}
    put(tmp_path / "works/5/chapters/8/chapter.json", {"id": "8", "workId": "5", "pageOrder": ["1", "2", "3"], "pages": [{"id": "1", "blocks": [block(3), {"id": "n"}, block(4)]}, {"id": "2", "blocks": []}, {"id": "3"}]})
    rows = _shelf(library.read_library(spark, str(tmp_path)))
    assert len(re.findall(r"FileScan json \[[^]]*\bpages#", rows._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted((r.page_id, r.n_blocks, r.sum_x, r.work_updated) for r in rows.collect()) == [(1, 3, 7, 1000), (2, 0, 0, 1000), (3, 0, 0, 1000)]


def test_rows_dealt_before_are_not_shuffled_again(spark, tmp_path):
    own = _wide_library(spark, 7, 40, 2)
    n, k = library.cells(own["chapters"]), {x: F.col(x).cast("string").alias(x) for x in ("page_id", "chapter_id")}
    own["chapters"] = library.dealt(own["chapters"], n)
    own["pages"] = library.dealt(own["pages"].select(*[k.get(c, F.col(c)) for c in own["pages"].columns]), n)
    own["blocks"] = own["blocks"].withColumn("chapter_id", F.split("page_id", "-")[0])
    own["blocks"] = library.dealt(own["blocks"], n).join(own["pages"].select("cell", "chapter_id", "page_id"), ["cell", "chapter_id", "page_id"])
    with library._writing(spark):
        plan = library._dealt_chapters(own["chapters"], own["pages"], own["blocks"], n)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 4 and "ObjectHashAggregate" not in plan
    library.write_library(own, str(tmp_path), n=n)
    back = library.read_library(spark, str(tmp_path), "parquet")
    assert back["pages"].count() == 560 and sorted(r.block_id for r in back["blocks"].collect()) == sorted(r.block_id for r in own["blocks"].collect())

"""Streams over several micro-batches, with late, repeated and interleaved rows, against their batch twins."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folio.operators import jobs
from folio.operators import replies as rep
from folio.streaming import jobs as st
from folio.streaming.session import state_store

BASE = 1_700_000_000


def at(seconds):
    return dt.datetime.fromtimestamp(BASE + seconds, dt.timezone.utc)


def streamed(spark, folder, batches, schema, transform, mode="append"):
    """batches: a list of rows for each source, a file each; rows (with batch) that the stream gives."""
    sources = []
    for k, (files, kind) in enumerate(zip(batches, schema)):
        for rows in files:
            spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/in{k}", mode="append")
        sources.append(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in{k}"))
    keep = lambda batch, n: batch.write.parquet(f"{folder}/out/batch={n}")
    with state_store(spark):
        transform(*sources).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/c").outputMode(mode).trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.parquet(f"{folder}/out")


RESPONSE = "response_id long, pos int, type string, delta string, response string, nested string"


@pytest.mark.parametrize("seed", [1, 2])
def test_responses_in_any_order_and_twice(spark, tmp_path, seed):
    rng, rows = random.Random(seed), []
    for r in range(40):
        n = rng.randrange(6)
        rows += [(r, k, "response.output_text.delta", f"{r}-{k} ", None, None) if rng.random() < 0.8 else (r, k, "other", None, None, "nested" if k % 2 else None) for k in range(n)]
        rows.append((r, n, rng.choice(["response.completed", "response.incomplete"]), None, '{"output_text": "whole"}', None))
    told = rows + [x for x in rows if rng.random() < 0.4] * 2
    rng.shuffle(told)
    got = streamed(spark, tmp_path, [[told[n::5] for n in range(5)]], [RESPONSE], st.stream_assemble_response).collect()
    twin = rep.assemble_response(spark.createDataFrame(told, RESPONSE)).collect()
    key = lambda r: (r.response_id, r.text.strip(), r.n_events, r.error)
    assert len(got) == 40 and sorted(map(key, got)) == sorted(map(key, twin))


def test_one_delta_delivered_twice(spark, tmp_path):
    delta = lambda k, d: (1, k, "response.output_text.delta", d, None, None)
    end = (1, 2, "response.completed", None, None, None)
    files = [[delta(0, "he")], [delta(0, "he"), end], [delta(1, "llo")], [end, delta(1, "llo")]]
    rows = streamed(spark, tmp_path, [files], [RESPONSE], st.stream_assemble_response).collect()
    assert [(r.text, r.n_events, r.error) for r in rows] == [("hello", 3, None)]


ATTEMPT = "page_id long, attempt int, ok boolean, message string"


@pytest.mark.parametrize("seed", [1, 2])
def test_attempts_in_any_order_and_twice(spark, tmp_path, seed):
    rng, rows = random.Random(seed), []
    for p in range(60):
        for a in range(1, rng.randrange(1, 9)):
            ok = rng.random() < 0.15
            rows.append((p, a, ok, None if ok else f"m{a}"))
    rows.append((99, 6, True, None))  # beyond the last attempt that counts
    rows += [(99, a, False, f"m{a}") for a in range(1, 6)]
    told = rows + [x for x in rows if rng.random() < 0.4]
    rng.shuffle(told)
    got = streamed(spark, tmp_path, [[told[n::4] for n in range(4)]], [ATTEMPT], st.stream_attempts).collect()
    twin = jobs.attempt_outcome(spark.createDataFrame(told, ATTEMPT)).where("status <> 'open'").collect()
    assert sorted((r.page_id, r.status, r.last_error) for r in got) == sorted((r.page_id, r.status, r.last_error) for r in twin)
    assert (99, "failed", "m5") in [(r.page_id, r.status, r.last_error) for r in got]


EVENT = "job_id long, seq int, phase string, ts timestamp"


@pytest.mark.parametrize("step", [1, 60])
def test_feed_of_long_runs(spark, tmp_path, step):
    """Late events split runs; at a minute an event, all but the last ten are settled."""
    rng, rows, files = random.Random(step), [], []
    for j in range(4):
        phase = "booting"
        for k in range(400):
            phase = rng.choice(["booting", "page_running", "page_done"]) if rng.random() < (0.02 if j < 2 else 0.5) else phase
            rows.append((j, k, phase, at(k * step)))
    rows.sort(key=lambda r: r[1] + rng.random() * 8)  # up to eight places late
    files = [rows[n : n + 200] for n in range(0, len(rows), 200)]
    out = streamed(spark, tmp_path, [files], [EVENT], st.stream_status_feed, "update")
    out = out.join(out.groupBy("job_id").agg(F.max("batch").alias("batch")), ["job_id", "batch"])
    twin = jobs.status_feed(spark.createDataFrame(rows, EVENT))
    names = ("job_id", "place", "seq", "label")
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(map(tuple, twin.select(*names).collect()))


def test_settled_runs_fold():
    spans = [(k, k, "a", k) for k in range(100)]
    folded = st._folded(spans, 89)
    assert folded == [(0, 89, "a", 89), *spans[90:]]
    assert st._folded(sorted([*folded, (50, 50, "late", 50)]), 89) == folded
    split = st._folded([(0, 5, "a", 5), (6, 6, "b", 6), (7, 9, "a", 9)], 100)
    assert split == [(0, 5, "a", 5), (6, 6, "b", 6), (7, 9, "a", 9)]


EDIT, MARK = "chapter_id long, ts timestamp, version long, snapshot string", "chapter_id long, ts timestamp, running boolean"


def held(spark, folder, edits, marks, spans, gap, cuts):
    """Edits and marks as two streams cut at the same times, and their twin over the spans."""
    far = at(10**6)
    slices = lambda rows: [[r for r in rows if lo <= r[1] < hi] for lo, hi in zip(cuts, cuts[1:])]
    e = slices([*edits, (-1, far, 0, "")])
    m = slices([*marks, (-1, far, False)])
    got = streamed(spark, folder, [e, m], [EDIT, MARK], lambda x, y: st.coalesce_edits(x, gap, y))
    twin = st.coalesce_edits(spark.createDataFrame(edits, EDIT), gap, spark.createDataFrame(spans, "chapter_id long, started timestamp, ended timestamp"))
    rows = lambda df: sorted((r.chapter_id, r.burst_start, r.burst_end, r.snapshot, r.version, r.edits) for r in df.where("chapter_id >= 0").collect())
    return rows(got), rows(twin)


@pytest.mark.parametrize("seed", [1, 2])
def test_held_edits_streamed(spark, tmp_path, seed):
    rng = random.Random(seed)
    edits, marks, spans = [], [], []
    for c in range(12):
        edits += [(c, at(s), k, f"{c}/{k}") for k, s in enumerate(sorted(rng.sample(range(20_000), 60)))]
        times = sorted(rng.sample(range(20_000), 6))
        for a, b in zip(times[::2], times[1::2]):
            spans.append((c, at(a), at(b)))
            marks += [(c, at(a), True), (c, at(b), False)]
    # held to the second at which the next job starts, and edits at both ends of a span
    edits += [(50, at(s), k, str(s)) for k, s in enumerate((10, 100, 200, 300))]
    marks += [(50, at(100), True), (50, at(200), False), (50, at(200), True), (50, at(300), False)]
    spans += [(50, at(100), at(200)), (50, at(200), at(300))]
    got, twin = held(spark, tmp_path, edits, marks, spans, "120 seconds", [at(x) for x in (0, 4000, 9000, 9500, 15_000, 10**7)])
    assert got == twin and len(got) > 50


def test_an_edit_held_for_days_holds_no_other_chapter(spark, tmp_path):
    day = 86_400
    edits = [(1, at(60), 1, "held"), (2, at(3600), 2, "free"), (2, at(2 * day), 3, "free again")]
    marks, spans = [(1, at(30), True), (1, at(4 * day), False)], [(1, at(30), at(4 * day))]
    got, twin = held(spark, tmp_path, edits, marks, spans, "400 milliseconds", [at(x) for x in (0, 1000, day, 3 * day, 10**7)])
    assert got == twin and [r[3] for r in got] == ["held", "free", "free again"]


def test_streamed_rows_are_read_and_written_by_many_tasks(spark):
    from pathlib import Path

    from folio.plans import job_queries
    from folio.streaming.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("stream-*"))
    rows = spark.range(0, 900, 1, 4).withColumn("_file", F.col("id") % 3)
    out = job_queries._streamed(SimpleNamespace(spark=spark), [rows], lambda s: s)
    assert out.count() == 900 and out.select("batch").distinct().count() == 3
    (at,) = set(folder.glob("stream-*")) - before
    assert len(list((at / "in0").glob("*.parquet"))) > 3


def test_attempts_take_rows_without_frames():
    class Seen:
        value = None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    processor = st.Attempts(3)
    processor.init(SimpleNamespace(getValueState=lambda *a: Seen()))
    tell = lambda *rows: list(processor.handleInputRows((7,), iter([Row(attempt=a, ok=ok, message=m) for a, ok, m in rows]), None))
    assert tell((2, False, "m2"), (1, False, "m1")) == []
    assert tell((3, False, None), (2, False, "m2")) == [Row(page_id=7, status="failed", last_error=None)]
    assert tell((1, True, None)) == []

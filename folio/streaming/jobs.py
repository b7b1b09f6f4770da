"""Streams of job events, response deltas, attempts, edits and page results.

Event time is ts, order is seq.  Rows later than the watermark are dropped by the stateful
operators.  With ttl_ms (or patience_ms) state that has been silent for so long goes, for which
the stream must run on processing time and so never ends by itself; without, a stream can be run
to its end with availableNow.  Every stream has a batch twin in folio.operators with which tests
compare it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.functions.labels import job_label
from folio.operators.jobs import CARRIED, FEED, MAX_ATTEMPTS, refresh_events
from folio.operators.replies import ENDS, event_text, response_text

WATERMARK = "10 minutes"
#: The same in microseconds, as far as an event of a feed may lie before its job's newest one.
LATE_US = 10 * 60 * 1_000_000
#: For streams that run on: a week.
TTL_MS = 7 * 24 * 3600 * 1000
EDIT_GAP = "400 milliseconds"
EVENT = "job_id long, seq int, ts timestamp, phase string, progress_current int, progress_total int"
#: Each nullable field with the seq of the event that brought it, so that late events within a job change nothing newer.
_STATE = "seq int, ts timestamp, phase string, progress_current int, current_seq int, progress_total int, total_seq int"


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _mode(limit_ms: int | None) -> str:
    return "ProcessingTime" if limit_ms else "None"


class _Kept(StatefulProcessor):
    """Base of processors whose state may have a time to live."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl = ttl_ms

    def close(self) -> None:
        pass


def _or_none(v):
    return None if v is None or v is pd.NaT or v != v else v


class JobState(_Kept):
    """Newest event per job with nullable fields carried forward."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", _STATE, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.state.get()) if self.state.exists() else [-1, None, None, None, -1, None, -1]
        for part in rows:
            for r in part.itertuples():
                if r.seq > now[0]:
                    now[:3] = [int(r.seq), r.ts, r.phase]
                for k, c in ((3, "progress_current"), (5, "progress_total")):
                    v = _or_none(getattr(r, c))
                    if v is not None and r.seq > now[k + 1]:
                        now[k : k + 2] = [int(v), int(r.seq)]
        self.state.update(tuple(now))
        yield pd.DataFrame({"job_id": [key[0]], "seq": [now[0]], "ts": [now[1]], "phase": [now[2]], "progress_current": pd.array([now[3]], "Int32"), "progress_total": pd.array([now[5]], "Int32")})


def stream_job_state(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Update stream of each job's latest state (twin: latest_job_state)."""
    return events.withWatermark("ts", WATERMARK).groupBy("job_id").transformWithStateInPandas(JobState(ttl_ms), EVENT, "Update", _mode(ttl_ms))


class StatusFeed(_Kept):
    """Labels that differ from the one before, newest first, at most FEED; late events find their place by seq.

    The state holds the newest FEED + 1 runs of equal labels as spans of seq, since a late event can split a run.
    Neighbouring spans of a run that are both older than LATE before the job's newest event become one, so a run is a
    few spans however long it lasts; an event that would split such a span comes too late and is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getListState("spans", "lo int, hi int, label string, ts long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = [tuple(x) for x in self.spans.get()] if self.spans.exists() else []
        newest = max((x[3] for x in spans), default=0)
        for part in rows:
            fresh = [(int(s), int(s), t, int(at)) for s, t, at in zip(part["seq"], part["label"], part["at"]) if isinstance(t, str) and t.strip()]
            newest = max([newest, *(x[3] for x in fresh)])
            spans = _folded(sorted([*spans, *fresh]), newest - LATE_US)
        begins = [k for k in range(len(spans)) if k == 0 or spans[k - 1][2] != spans[k][2]]
        spans = spans[begins[-FEED - 1] :] if len(begins) > FEED + 1 else spans
        feed = [x for k, x in enumerate(spans) if k == 0 or spans[k - 1][2] != x[2]][-FEED:]
        if spans:
            self.spans.put(spans)
        yield pd.DataFrame({"job_id": key[0], "place": range(1, len(feed) + 1), "seq": [x[0] for x in feed[::-1]], "label": [x[2] for x in feed[::-1]]})


def _folded(spans: list[tuple], settled: int) -> list[tuple]:
    """Spans (lo, hi, label, ts) in order of lo, neighbours of one run joined if both are no later than settled; what lies inside a span goes."""
    out: list[tuple] = []
    for x in spans:
        if out and x[0] <= out[-1][1]:
            continue
        if out and x[2] == out[-1][2] and max(x[3], out[-1][3]) <= settled:
            x = (out.pop()[0], x[1], x[2], x[3])
        out.append(x)
    return out


def stream_status_feed(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Update stream of each job's feed (twin: status_feed)."""
    none = F.lit(None).cast("int")
    has = lambda c: F.col(c) if c in events.columns else none
    label = job_label(F.col("phase"), F.lit(None).cast("string"), *[has(c) for c in CARRIED[2:]])
    rows = events.withWatermark("ts", WATERMARK).select("job_id", "seq", label.alias("label"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("job_id").transformWithStateInPandas(StatusFeed(ttl_ms), "job_id long, place int, seq int, label string", "Update", _mode(ttl_ms))


class Response(_Kept):
    """Parts of a response until its end; silent responses are given up by a timer.

    Events are known by pos: `upto` counts those of the gapless beginning, `ahead` lists those beyond a gap, so repeated
    and late ones do no harm in any order of batches.  A finished response leaves a mark and is not told again.
    """

    def __init__(self, patience_ms: int | None):
        super().__init__(None)
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "pos int, part string")
        self.seen = handle.getValueState("seen", "upto int, ahead array<int>, ended int, final string, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upto, ahead, ended, final, done = self.seen.get() if self.seen.exists() else (0, [], -1, None, False)
        if done:
            return
        ahead, fresh = set(ahead), []
        for r in _sorted(rows, "pos").itertuples():
            pos = int(r.pos)
            if pos < upto or pos in ahead:
                continue
            ahead.add(pos)
            if _or_none(r.part):
                fresh.append((pos, r.part))
            if r.type in ENDS and (ended < 0 or pos < ended):
                ended, final = pos, _or_none(r.final)
        while upto in ahead:
            ahead.remove(upto)
            upto += 1
        if fresh:
            self.parts.appendList(fresh)
        if 0 <= ended < upto:
            parts = sorted(tuple(x) for x in self.parts.get()) if self.parts.exists() else []
            text = "".join(d for pos, d in parts if pos <= ended)
            text = text if text.strip() else final or ""
            yield self._finish(key, text.strip(), ended + 1, None if text.strip() else "Model returned an empty response.")
        else:
            self.seen.update((upto, sorted(ahead), ended, final, False))
            if self.patience:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def _finish(self, key, text: str, n: int, error: str | None) -> pd.DataFrame:
        self.parts.clear()
        self.seen.update((0, [], -1, None, True))
        return pd.DataFrame({"response_id": [key[0]], "text": [text], "n_events": [n], "error": [error]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            upto, ahead, _, _, done = self.seen.get()
            if not done:
                yield self._finish(key, "", upto + len(ahead), "abandoned")


def stream_assemble_response(events: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """(response_id, pos from 0 without gaps, type, delta, response, nested) -> finished responses, each once (twin: assemble_response).

    A response ends with its first completed or incomplete event, when all before that one are there.
    """
    final = response_text(F.col("response")) if "response" in events.columns else F.lit(None).cast("string")
    rows = events.select("response_id", "pos", "type", event_text(events).alias("part"), F.when(F.col("type").isin(*ENDS), final).alias("final"))
    return rows.groupBy("response_id").transformWithStateInPandas(Response(patience_ms), "response_id long, text string, n_events int, error string", "Append", _mode(patience_ms))


class Attempts(_Kept):
    """A page's outcome, once: at its first success or when all its attempts have failed; attempts are known by number, so order and repeats do not matter.

    A page has few attempts and there are many pages, so its rows come as they are, without a pandas frame for each.
    """

    def __init__(self, most: int, ttl_ms: int | None = None):
        super().__init__(ttl_ms)
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "failed array<int>, message string, done boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        failed, message, done = self.seen.get() or ([], None, False)
        if done:
            return
        failed, out = set(failed), None
        for r in sorted(rows, key=lambda r: r.attempt):
            if r.ok:
                out = ("completed", None)
                break
            if r.attempt >= max(failed, default=r.attempt):
                message = r.message
            failed.add(r.attempt)
        if out is None and len(failed) >= self.most:
            out = ("failed", message)
        self.seen.update(([], None, True) if out else (sorted(failed), message, False))
        if out:
            yield Row(page_id=key[0], status=out[0], last_error=out[1])


def stream_attempts(attempts: DataFrame, most: int = MAX_ATTEMPTS, ttl_ms: int | None = None) -> DataFrame:
    """(page_id, attempt, ok, message) -> settled pages (twin: attempt_outcome)."""
    most = max(1, most)
    rows = attempts.where(F.col("attempt") <= most).withColumn("ok", F.coalesce("ok", F.lit(False)))
    return rows.groupBy("page_id").transformWithState(Attempts(most, ttl_ms), "page_id long, status string, last_error string", "Append", _mode(ttl_ms))


def held_edits(edits: DataFrame, jobs: DataFrame) -> DataFrame:
    """edits (chapter_id, ts, ...) with saved_from: ts, or the end of the chapter's job that runs at that time.

    jobs (chapter_id, started, ended) of one chapter do not overlap, so an edit is held by one job at most.
    """
    spans = jobs.select(F.col("chapter_id").alias("_c"), F.col("started").alias("_s"), F.col("ended").alias("_e"))
    hit = (F.col("chapter_id") == F.col("_c")) & (F.col("ts") >= F.col("_s")) & (F.col("ts") < F.col("_e"))
    return edits.join(spans, hit, "left").withColumn("saved_from", F.coalesce("_e", "ts")).drop("_c", "_s", "_e")


def coalesce_edits(edits: DataFrame, gap: str = EDIT_GAP, jobs: DataFrame | None = None) -> DataFrame:
    """(chapter_id, ts, version, snapshot): one row per burst with its last snapshot; batch or stream.

    With jobs, edits made while the chapter's job runs wait for its end and are saved with what follows it.  Jobs are
    spans (chapter_id, started, ended) for a batch, marks of a stream (see stream_held_edits) for a stream.
    """
    at = "ts"
    if edits.isStreaming:
        if jobs is not None:
            return stream_held_edits(edits, jobs, gap)
        edits = edits.withWatermark(at, WATERMARK)
    elif jobs is not None:
        edits, at = held_edits(edits, jobs), "saved_from"
    return edits.groupBy("chapter_id", F.session_window(at, gap).alias("w")).agg(F.max_by("snapshot", "version").alias("snapshot"), F.max("version").alias("version"), F.count("*").alias("edits")).select("chapter_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "snapshot", "version", "edits")


_END, _START, _EDIT = range(3)
#: start and last of a burst in microseconds, and its newest version.
_BURST = "start long, last long, version long, snapshot string, edits long"


class HeldEdits(_Kept):
    """A chapter's edits and the marks of its jobs, taken in order of time as the watermark passes them.

    What lies after the watermark waits in a list; before it there are at most one burst that can still grow, and one sum of the edits
    that a running job holds.  A timer ends the burst, or takes up the first of the list.
    """

    def __init__(self, gap_us: int):
        super().__init__(None)
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, kind int, version long, snapshot string")
        self.burst = handle.getValueState("burst", _BURST)
        self.held = handle.getValueState("held", f"running boolean, {_BURST}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(r.at), int(r.kind), int(r.version), _or_none(r.snapshot)) for part in rows for r in part.itertuples()]
        yield from self._pass(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._pass(key, [], timerValues)

    def _pass(self, key, fresh: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted([*map(tuple, self.waiting.get() if self.waiting.exists() else ()), *fresh], key=lambda x: x[:3])
        burst = list(self.burst.get()) if self.burst.exists() else None
        running, *held = self.held.get() if self.held.exists() else (False, 0, 0, None, None, 0)
        out, n = [], 0
        for n, (at, kind, version, snapshot) in enumerate([*waiting, (now + 1, _END, 0, None)]):
            if at > now:
                break
            if kind == _START:
                running = True
            elif kind == _EDIT and running:
                held = _joined(held, [at, at, version, snapshot, 1])
            else:
                new = [at, at, version, snapshot, 1]
                if kind == _END:
                    new, held, running = [at, at, *held[2:]], [0, 0, None, None, 0], False
                if new[4]:
                    if burst and at > burst[1] + self.gap:  # a session takes in what comes at its very end
                        out.append(burst)
                        burst = None
                    burst = _joined(burst, new)
        waiting = waiting[n:]
        if burst and burst[1] + self.gap <= now:
            out.append(burst)
            burst = None
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        self.burst.update(tuple(burst)) if burst else self.burst.clear()
        self.held.update((running, *held)) if running else self.held.clear()
        due = [x for x in (burst and burst[1] + self.gap, waiting and waiting[0][0]) if x]
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        if out:
            rows = [(key[0], b[0], b[1] + self.gap, b[3], b[2], b[4]) for b in out]
            yield pd.DataFrame(rows, columns=["chapter_id", "burst_start", "burst_end", "snapshot", "version", "edits"])


def _joined(burst: list | None, new: list) -> list:
    """A burst with what comes after it; the newest version's snapshot counts."""
    if not burst or not burst[4]:
        return new
    start, last, version, snapshot, edits = burst
    return [start, max(last, new[1]), *(new[2:4] if new[2] > version else (version, snapshot)), edits + new[4]]


def stream_held_edits(edits: DataFrame, marks: DataFrame, gap: str = EDIT_GAP) -> DataFrame:
    """Two streams, edits (chapter_id, ts, version, snapshot) and marks of jobs (chapter_id, ts, running), -> bursts (twin: coalesce_edits with jobs).

    A mark says that a chapter's job begins (running) or ends at ts.  The watermark is the older of both streams', so neither can get ahead of the other.
    """
    none = F.lit(None)
    kind = F.when(F.col("running"), _START).otherwise(_END)
    left = edits.withWatermark("ts", WATERMARK).select("chapter_id", "ts", F.unix_micros("ts").alias("at"), F.lit(_EDIT).alias("kind"), F.coalesce(F.col("version").cast("long"), F.lit(-1)).alias("version"), F.col("snapshot").cast("string").alias("snapshot"))
    right = marks.withWatermark("ts", WATERMARK).select("chapter_id", "ts", F.unix_micros("ts").alias("at"), kind.alias("kind"), F.lit(-1).cast("long").alias("version"), none.cast("string").alias("snapshot"))
    processor = HeldEdits(pd.Timedelta(gap) // pd.Timedelta(microseconds=1))
    out = left.unionByName(right).groupBy("chapter_id").transformWithStateInPandas(processor, "chapter_id long, burst_start long, burst_end long, snapshot string, version long, edits long", "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("burst_start", "burst_end")})


def upsert_stream(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs apply(batch, batch_id) on each micro-batch; apply must be safe to repeat for one batch_id."""
    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_page_results(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Page results to the catalogue, micro-batch by micro-batch; only events that make it stale get through."""
    return upsert_stream(refresh_events(events), apply, checkpoint, once)

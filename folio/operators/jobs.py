"""Jobs: attempts, outcomes, event folding, feeds and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.labels import SKIPPED_MARK, UNCERTAIN_MARK, classify_failure, job_label, warning_summary

MAX_ATTEMPTS, FEED = 5, 16
CARRIED = ("progress_current", "progress_total", "page_index", "page_total", "attempt", "attempt_total")
INDETERMINATE = ("booting", "model_downloading")
REFRESHING = ("page_done", "page_skipped")


def attempt_outcome(attempts: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per page: its first success, or failed with the last message once `most` attempts failed; else open.  An attempt that is there twice counts once."""
    a = attempts.where(F.col("attempt") <= max(1, most)).groupBy("page_id").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won_at"), F.size(F.collect_set("attempt")).alias("n_attempts"), F.max_by("message", "attempt").alias("last_message"))
    status = F.when(F.col("won_at").isNotNull(), "completed").when(F.col("n_attempts") >= max(1, most), "failed").otherwise("open")
    return a.select("page_id", status.alias("status"), "won_at", "n_attempts", F.when(F.col("won_at").isNull(), F.col("last_message")).alias("last_error"))


def retry_pages(pages: DataFrame, attempts: DataFrame) -> DataFrame:
    """Pages still without a success, with the number of their next attempt."""
    tried = attempts.groupBy("page_id").agg(F.max("attempt").alias("_a"), F.bool_or("ok").alias("_ok"))
    return pages.join(tried, "page_id", "left").where("_ok IS NULL OR NOT _ok").withColumn("next_attempt", F.coalesce("_a", F.lit(0)) + 1).drop("_a", "_ok")


def failure_report(attempts: DataFrame) -> DataFrame:
    """Failed attempts by class: how many, on how many pages, and how many were retries."""
    return attempts.where("NOT ok").groupBy(classify_failure(F.col("message")).alias("category")).agg(F.count("*").alias("failures"), F.countDistinct("page_id").alias("pages"), F.count_if(F.col("attempt") > 1).alias("retries"))


def run_result(events: DataFrame) -> DataFrame:
    """(job_id, result): how the last event leaves a job."""
    last = events.groupBy("job_id").agg(F.max_by("phase", "seq").alias("phase"))
    return last.select("job_id", F.when(F.col("phase").isin("cancelled", "failed"), F.col("phase")).otherwise("completed").alias("result"))


def job_states(events: DataFrame) -> DataFrame:
    """events with the nullable fields carried forward from earlier events of the job."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in CARRIED if c in events.columns})


def latest_job_state(events: DataFrame) -> DataFrame:
    """One row per job: newest event, each nullable field as last seen.  Aggregates only, so it combines before the shuffle."""
    kept = [c for c in events.columns if c not in ("job_id", *CARRIED)]
    newest = [F.max_by(c, "seq").alias(c) for c in kept]
    carried = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in CARRIED if c in events.columns]
    return events.groupBy("job_id").agg(*newest, *carried)


def most_recent(rows: DataFrame, group: str, order: str, most: int = FEED) -> DataFrame:
    """The newest rows of each group by order, at most `most`."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc()))
    return rows.withColumn("place", n).where(F.col("place") <= most)


def _labelled(events: DataFrame) -> DataFrame:
    has = lambda c, kind="int": F.col(c) if c in events.columns else F.lit(None).cast(kind)
    return events.withColumn("label", job_label(has("phase", "string"), has("status", "string"), has("page_index"), has("page_total"), has("attempt"), has("attempt_total")))


def status_feed(events: DataFrame, most: int = FEED) -> DataFrame:
    """(job_id, place, label): newest first, without blanks and repeats of the one before, at most so many per job."""
    w = Window.partitionBy("job_id").orderBy("seq")
    rows = _labelled(events).where("trim(label) <> ''").withColumn("_before", F.lag("label").over(w)).where("_before IS NULL OR _before <> label")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("seq").desc()))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("job_id", "place", "seq", "label")


def progress(states: DataFrame) -> DataFrame:
    """(job_id, mode, current, total, ratio) of job states; mode is null where there is nothing to show."""
    total = F.floor(F.greatest(F.lit(1), F.floor("progress_total")))
    current = F.least(total, F.greatest(F.lit(0), F.floor("progress_current")))
    waiting = F.col("phase").isin(*INDETERMINATE)
    known = F.col("progress_current").isNotNull() & (F.col("progress_total") > 0)
    mode = F.when(waiting, "indeterminate").when(known, "determinate")
    shown = mode == "determinate"
    return states.select("job_id", mode.alias("mode"), F.when(shown, current).cast("int").alias("current"), F.when(shown, total).cast("int").alias("total"), F.when(shown, current / total).alias("ratio"))


def refresh_events(events: DataFrame) -> DataFrame:
    """Events after which a catalogue view is stale (stateless, so it serves streams as well)."""
    return events.where(F.col("phase").isin(*REFRESHING))


def run_warnings(warnings: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, summary) of warning texts (key, warning)."""
    rows = warnings.groupBy(key).agg(F.bool_or(F.contains("warning", F.lit(SKIPPED_MARK))).alias("s"), F.bool_or(F.contains("warning", F.lit(UNCERTAIN_MARK))).alias("u"))
    return rows.select(key, warning_summary(F.lit(True), F.col("s"), F.col("u")).alias("summary"))


def batch_run_prefix(runs: DataFrame) -> DataFrame:
    """(batch_id, ord, status): the runs up to and including a batch's first one that did not complete."""
    w = Window.partitionBy("batch_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_fine", F.coalesce(F.bool_and(F.col("status") == "completed").over(w), F.lit(True))).where("_fine").drop("_fine")

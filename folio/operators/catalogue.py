"""The catalogue: works hold chapters hold pages hold blocks, all in an order that is data.

Every list has an ordinal column and every window is partitioned by work, chapter or page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import sanitize_title, search_text, with_search_text


def listed(df: DataFrame, key: str, array: str, out_id: str, out_ord: str) -> DataFrame:
    """(key, id, ordinal from 0) of an order array; of a repeated id the first place counts."""
    rows = df.select(key, F.posexplode(array).alias(out_ord, out_id))
    return rows.groupBy(key, out_id).agg(F.min(out_ord).alias(out_ord))


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("chapter_id").agg(F.count("*").alias("page_count"))


def status_flags(status: Column) -> list[Column]:
    """Aggregates over pages that status_by_flags reads; partial ones of them combine by the same aggregates."""
    return [F.bool_and(status == "completed").alias("done"), F.bool_or(status == "running").alias("busy"), F.bool_and(status == "failed").alias("lost"), F.bool_or(status == "completed").alias("some")]


def status_by_flags() -> Column:
    return F.when(F.col("done"), "completed").when(F.col("busy"), "running").when(F.col("lost"), "failed").when(F.col("some"), "partial").otherwise("idle")


def chapter_status(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """(chapter_id, status) by precedence; a chapter without pages is idle."""
    known = pages.groupBy("chapter_id").agg(*status_flags(F.col("analysis_status")))
    return chapters.select("chapter_id").join(known, "chapter_id", "left").select("chapter_id", status_by_flags().alias("status"))


def list_library(works: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Works with their chapters in order and page counts; a work or chapter whose record is missing is left out."""
    rows = works.select("work_id", F.col("title").alias("work_title"), "work_ord").join(chapters.select("work_id", "chapter_id", "title", "chapter_ord"), "work_id")
    return rows.join(page_count(pages), "chapter_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def orphans(listing: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Listed ids without a record."""
    return listing.join(records.select(key).distinct(), key, "left_anti")


def locate_chapters(works: DataFrame, ids: DataFrame) -> DataFrame:
    """(chapter_id, work_id): the first work, in work order, whose chapter_order holds the chapter."""
    places = works.select("work_id", "work_ord", F.explode("chapter_order").alias("chapter_id"))
    return places.join(ids.select("chapter_id").distinct(), "chapter_id", "left_semi").groupBy("chapter_id").agg(F.min_by("work_id", "work_ord").alias("work_id"))


def reorder_ids(current: Column, following: Column) -> Column:
    """What following lists of current, in its order (repeats stay), then the rest of current.

    Set functions, which hash, serve arrays without repeats; only with repeats, which they would drop, each id is looked up in the other array.
    """
    once = (F.size(F.array_distinct(current)) == F.size(current)) & (F.size(F.array_distinct(following)) == F.size(following))
    looked_up = F.concat(F.filter(following, lambda x: F.array_contains(current, x)), F.filter(current, lambda x: ~F.array_contains(following, x)))
    return F.when(once, F.concat(F.array_intersect(following, current), F.array_except(current, following))).otherwise(looked_up)


def reorder_records(records: DataFrame, order: DataFrame, group: str, key: str, ordinal: str) -> DataFrame:
    """records with new ordinals from 1: as order (group, key, order_pos) lists them, unlisted ones after in prior order."""
    first = order.groupBy(group, key).agg(F.min("order_pos").alias("_pos"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_pos").asc_nulls_last(), F.col(ordinal), F.col(key)))
    return records.join(first, [group, key], "left").withColumn("_new", n).drop(ordinal, "_pos").withColumnRenamed("_new", ordinal)


def split_by_ids(rows: DataFrame, ids: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys are among ids, the rest)."""
    return rows.join(ids, keys, "left_semi"), rows.join(ids, keys, "left_anti")


def move_before_target(order: Column, moved: Column, target: Column) -> Column:
    """The array with moved taken out and put at the place that target had before; unknown ids change nothing."""
    at = F.array_position(order, target).cast("int")
    rest = F.filter(order, lambda x: x != moved)
    known = (F.array_position(order, moved) > 0) & (at > 0) & (moved != target)
    return F.when(known, F.concat(F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(moved), F.slice(rest, F.greatest(at, F.lit(1)), F.size(rest)))).otherwise(order)


def search_catalogue(works: DataFrame, chapters: DataFrame, query: str) -> DataFrame:
    """(work_id, chapter_id, work_ord, chapter_ord) that match; a title hit keeps all its chapters, even none."""
    q = search_text(query)
    w = with_search_text(works.select("work_id", "work_ord", F.col("title").alias("_w")), "_w", "_wn")
    c = with_search_text(chapters.select("work_id", "chapter_id", "chapter_ord", F.col("title").alias("_c")), "_c", "_cn")
    rows = w.join(c, "work_id", "left")
    if q:
        rows = rows.where(F.contains(F.col("_wn"), F.lit(q)) | F.coalesce(F.contains(F.col("_cn"), F.lit(q)), F.lit(False)))
    return rows.select("work_id", "chapter_id", "work_ord", "chapter_ord")


def select_pages_for_run(pages: DataFrame, mode: str, page_id=None) -> DataFrame:
    if mode == "all":
        return pages
    if mode == "single-page":
        return pages.where(F.col("page_id") == F.lit(page_id))
    if mode != "pending":
        raise ValueError(f"unknown run mode {mode}")
    return pages.where("analysis_status <> 'completed'")


def edit_locked_pages(pages: DataFrame, active_jobs: DataFrame) -> DataFrame:
    """Pages of chapters with an active job that are not completed yet."""
    return pages.join(active_jobs.select("chapter_id").distinct(), "chapter_id", "left_semi").where("analysis_status <> 'completed'")


def apply_page_results(pages: DataFrame, results: DataFrame) -> DataFrame:
    """pages with status and last_error of results (page_id, res_ord, new_status, error); of repeats the last wins."""
    last = results.groupBy("page_id").agg(F.max_by(F.struct("new_status", "error"), "res_ord").alias("r"))
    hit = F.col("r").isNotNull()
    return pages.join(last, "page_id", "left").withColumns({"analysis_status": F.when(hit, F.col("r.new_status")).otherwise(F.col("analysis_status")), "last_error": F.when(hit, F.col("r.error")).otherwise(F.col("last_error"))}).drop("r")


def _flagged(pages: DataFrame, ids: DataFrame) -> DataFrame:
    return pages.join(ids.select("page_id").distinct().withColumn("_hit", F.lit(True)), "page_id", "left")


def mark_running(pages: DataFrame, ids: DataFrame) -> DataFrame:
    rows = _flagged(pages, ids)
    return rows.withColumns({"analysis_status": F.when(F.col("_hit"), "running").otherwise(F.col("analysis_status")), "last_error": F.when(F.col("_hit"), None).otherwise(F.col("last_error"))}).drop("_hit")


def finalize_running(pages: DataFrame, ids: DataFrame, status: str, error: str | None = None) -> DataFrame:
    """Pages of ids that are still running become status; failed ones get the error."""
    rows = _flagged(pages, ids).withColumn("_hit", F.coalesce("_hit", F.lit(False)) & (F.col("analysis_status") == "running"))
    last_error = F.when(F.col("_hit"), F.lit(error if status == "failed" else None)).otherwise(F.col("last_error"))
    return rows.withColumns({"last_error": last_error, "analysis_status": F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("analysis_status"))}).drop("_hit")


def merge_live_local(live: DataFrame, local: DataFrame, dirty: DataFrame) -> DataFrame:
    """live pages, but the whole local page where it is dirty and both are completed; kept_local says which.

    Of a kept page every column that local has is taken, but for last_error, which stays the live one's.
    """
    mine = [c for c in live.columns if c in local.columns and c not in ("page_id", "last_error")]
    kept = _flagged(local, dirty).where("_hit AND analysis_status = 'completed'").select("page_id", F.struct(*mine).alias("_mine"))
    rows = live.join(kept, "page_id", "left").withColumn("kept_local", F.col("_mine").isNotNull() & (F.col("analysis_status") == "completed"))
    chosen = [F.when(F.col("kept_local"), F.col(f"_mine.{c}")).otherwise(F.col(c)).alias(c) if c in mine else F.col(c) for c in live.columns]
    return rows.select(*chosen, "kept_local")


def merge_live_local_blocks(live: DataFrame, local: DataFrame, merged: DataFrame) -> DataFrame:
    """Blocks of merged pages (from merge_live_local): the local ones of pages kept as local, else the live ones."""
    kept = merged.where("kept_local").select("page_id")
    return live.join(kept, "page_id", "left_anti").unionByName(local.join(kept, "page_id", "left_semi"), allowMissingColumns=True)


def repair_references(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """(mark_id, chapter_id, page_id): the page if it still exists, else the chapter's first page, else null."""
    alive = pages.select("chapter_id", "page_id", F.lit(True).alias("_alive"))
    first = pages.groupBy("chapter_id").agg(F.min_by("page_id", "page_ord").alias("_first"))
    rows = marks.join(alive, ["chapter_id", "page_id"], "left").join(first, "chapter_id", "left")
    return rows.select("mark_id", "chapter_id", F.when(F.col("_alive"), F.col("page_id")).otherwise(F.col("_first")).alias("page_id"), F.coalesce("_alive", F.lit(False)).alias("kept"))


def cascade(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is gone; call it level by level, down to run artifacts."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def renumber(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    return rows.withColumn(ordinal, F.row_number().over(Window.partitionBy(group).orderBy(ordinal)))


def rename(rows: DataFrame, patches: DataFrame, key: str, fallback: str, within: str | None = None) -> DataFrame:
    """rows with the sanitised titles of patches (key, title, patch_ord), the last of a key.

    With within (a work's id, for chapters) a new title that another row of the group has gets a number, in order of patch_ord.
    """
    last = patches.groupBy(key).agg(F.max_by("title", "patch_ord").alias("_t"), F.max("patch_ord").alias("_p"), F.lit(True).alias("_hit"))
    out = rows.join(last, key, "left").withColumn("title", F.when(F.col("_hit"), sanitize_title(F.coalesce("_t", F.lit("")), fallback)).otherwise(F.col("title")))
    if within is not None:
        old, new = out.where("_hit IS NULL").select(within, "title"), out.where("_hit").select(within, F.col(key).alias("chapter_id"), "title", F.col("_p").alias("arrival"))
        given = unique_titles(old, new, within).select(F.col("chapter_id").alias(key), F.col("title").alias("_u"))
        out = out.join(given, key, "left").withColumn("title", F.coalesce("_u", "title")).drop("_u")
    return out.drop("_t", "_p", "_hit")


def touch(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """parents whose updated_at is no older than that of their children."""
    newest = children.groupBy(key).agg(F.max("updated_at").alias("_u"))
    return parents.join(newest, key, "left").withColumn("updated_at", F.greatest("updated_at", "_u")).drop("_u")


def adjacent_pages(pages: DataFrame) -> DataFrame:
    w = Window.partitionBy("chapter_id").orderBy("page_ord", "page_id")
    return pages.select("chapter_id", "page_id", F.lag("page_id").over(w).alias("previous_page_id"), F.lead("page_id").over(w).alias("next_page_id"))


def repoint_deleted(marks: DataFrame, pages: DataFrame, gone: DataFrame) -> DataFrame:
    """(mark_id, page_id): a mark on a deleted page moves to the next survivor, else the previous, else null."""
    dead = gone.select("page_id").distinct().withColumn("_gone", F.lit(True))
    chapter, so_far = Window.partitionBy("chapter_id"), (Window.unboundedPreceding, -1)
    alive = F.when(F.col("_gone").isNull(), F.col("page_id"))
    nearest = F.last(alive, ignorenulls=True)  # in both directions over a frame that only grows, so a chapter takes linear time
    before = nearest.over(chapter.orderBy("page_ord", "page_id").rowsBetween(*so_far))
    after = nearest.over(chapter.orderBy(F.desc("page_ord"), F.desc("page_id")).rowsBetween(*so_far))
    to = pages.select("chapter_id", "page_id", "page_ord").join(dead, "page_id", "left").select("page_id", F.coalesce(alive, after, before).alias("_to"))
    return marks.join(to, "page_id", "left").select("mark_id", F.col("_to").alias("page_id"))


def page_file_names(pages: DataFrame) -> DataFrame:
    """page_id and NNN-<id>.<ext> by place in the chapter, at least three digits."""
    n = F.row_number().over(Window.partitionBy("chapter_id").orderBy("page_ord", "page_id")).cast("string")
    padded = F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0"))
    from folio.functions.text import extension

    return pages.select("page_id", F.concat(padded, F.lit("-"), F.col("page_id").cast("string"), F.lit("."), extension(F.col("name"))).alias("file_name"))


def unique_title(existing: DataFrame, new: DataFrame, key: str = "work_id") -> DataFrame:
    """One new title per group: as it is, or with the smallest free ` (k)`.  Set-based: only suffixes up to the group's size can be taken."""
    taken = existing.select(key, F.col("title").alias("t")).distinct()
    used = taken.join(new.select(key, F.col("title").alias("_n")), key).select(key, "_n", "t")
    k = F.when(F.col("t").startswith(F.concat("_n", F.lit(" ("))) & F.col("t").endswith(")"), F.substring(F.col("t"), F.length("_n") + 3, F.length("t") - F.length("_n") - 3))
    number = F.when(k.rlike("^[1-9][0-9]{0,8}$"), k.try_cast("int"))
    state = used.groupBy(key, "_n").agg(F.bool_or(F.col("t") == F.col("_n")).alias("hit"), F.collect_set(number).alias("ks"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("ks") + 1), F.col("ks")))
    return new.join(state.withColumnRenamed("_n", "title"), [key, "title"], "left").select(key, F.when(F.coalesce("hit", F.lit(False)), F.concat("title", F.lit(" ("), free.cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"))


_NUMBERED = r"( \(\d+\))+$"


def _titles(pdf: pd.DataFrame) -> pd.DataFrame:
    taken, nexts, out = set(pdf.title[pdf.is_old]), {}, []
    for row in pdf[~pdf.is_old].sort_values(["arrival", "chapter_id"], kind="stable").itertuples():
        title = row.title
        if title in taken:
            k = nexts.get(title, 1)
            while f"{title} ({k})" in taken:
                k += 1
            nexts[title] = k
            title = f"{title} ({k})"
        taken.add(title)
        out.append((row.chapter_id, title))
    return pd.DataFrame(out, columns=["chapter_id", "title"])


def unique_titles(existing: DataFrame, new: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, chapter_id, title, arrival) -> (chapter_id, title): many new titles per group, each sees those before it.

    A number only ever makes ` (k)` of a title, so titles that differ without such endings never
    meet: a family is a group's titles that are alike without them.  Where no title of a family has
    an ending, a new one's number is its place, counted in the JVM; only families with endings of
    their own, in which a number may be taken already, are numbered one by one.
    """
    kind = new.schema["chapter_id"].dataType
    old = existing.select(key, F.lit(None).cast(kind).alias("chapter_id"), "title", F.lit(None).cast("long").alias("arrival"), F.lit(True).alias("is_old"))
    rows = old.unionByName(new.select(key, "chapter_id", "title", F.col("arrival").cast("long").alias("arrival"), F.lit(False).alias("is_old")))
    rows = rows.withColumn("stem", F.regexp_replace("title", _NUMBERED, ""))
    family = rows.groupBy(key, "stem").agg(F.bool_or(F.col("title") != F.col("stem")).alias("odd"), F.bool_or("is_old").alias("met"))
    rows = rows.join(family.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")) & rows["stem"].eqNullSafe(family["stem"])).drop("_k", family["stem"])
    place = F.row_number().over(Window.partitionBy(key, "stem").orderBy("arrival", "chapter_id")) + F.col("met").cast("int")
    plain = rows.where("NOT odd AND NOT is_old").withColumn("n", place)
    plain = plain.select("chapter_id", F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" ("), (F.col("n") - 1).cast("string"), F.lit(")"))).alias("title"))
    hard = rows.where("odd").groupBy(key, "stem").applyInPandas(_titles, f"chapter_id {kind.simpleString()}, title string")
    return plain.unionByName(hard)


def append_chapters(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """chapters with new ones after each work's last, in their order (arrival)."""
    last = chapters.groupBy("work_id").agg(F.max("chapter_ord").alias("_last"))
    n = F.row_number().over(Window.partitionBy("work_id").orderBy("arrival", "chapter_id"))
    added = new.join(last, "work_id", "left").select("chapter_id", "work_id", "title", (F.coalesce("_last", F.lit(0)) + n).cast("int").alias("chapter_ord"))
    return chapters.select("chapter_id", "work_id", "title", "chapter_ord").unionByName(added)

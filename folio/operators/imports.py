"""Imports: files to ordered drafts, selections, snapshots, request files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import basename, blank_to_null, is_image, natural_key, sanitize_title


def image_files(files: DataFrame) -> DataFrame:
    return files.where(is_image(F.col("path")))


def import_ordinals(files: DataFrame, container: str, tie: str) -> DataFrame:
    """files with page_ord, 1-based natural order of the path inside each container."""
    w = Window.partitionBy(container).orderBy(natural_key(F.col("path")), F.col(tie))
    return files.withColumn("page_ord", F.row_number().over(w))


def import_preview(files: DataFrame, container: str, tie: str) -> DataFrame:
    """(container, page_count, pages): a draft per container, its pages in natural order."""
    key = F.struct(natural_key(F.col("path")).alias("k"), F.col(tie).alias("t"), basename(F.col("path")).alias("name"))
    rows = image_files(files).groupBy(container).agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(key)).alias("p"))
    return rows.select(container, "page_count", F.transform("p", lambda x: x["name"]).alias("pages"))


def all_drafts(*parts: DataFrame) -> DataFrame:
    """Drafts (title, source_kind, page_count) of all kinds in one natural order of their titles."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(natural_key(F.col("title")), "title")


def selected_drafts(drafts: DataFrame, selections: DataFrame) -> DataFrame:
    """Drafts whose (last) selection is enabled; a blank title keeps the draft's own."""
    ord_ = F.col("sel_ord") if "sel_ord" in selections.columns else F.lit(0)
    last = selections.groupBy("draft_id").agg(F.max_by(F.struct(F.col("enabled").alias("e"), F.col("title").alias("t")), ord_).alias("s"))
    rows = drafts.join(last, "draft_id").where("s.e")
    return rows.withColumn("title", sanitize_title(F.coalesce("s.t", F.lit("")), F.col("title"))).drop("s")


def valid_imports(selections: DataFrame, targets: DataFrame, key: str = "import_id") -> DataFrame:
    """(key, valid): a new title or an existing work, and some enabled selection with a title."""
    some = selections.groupBy(key).agg(F.bool_or(F.col("enabled") & blank_to_null(F.col("title")).isNotNull()).alias("_some"))
    ready = blank_to_null(F.col("new_title")).isNotNull() | F.col("work_id").isNotNull()
    return targets.join(some, key, "left").select(key, (ready & F.coalesce("_some", F.lit(False))).alias("valid"))


def newest_first(rows: DataFrame, group: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col("mtime").desc(), F.col("snapshot").desc())
    return rows.withColumn("place", F.row_number().over(w))


def latest_complete_snapshot(snapshots: DataFrame) -> DataFrame:
    """(repo, snapshot, companion_rank): the newest snapshot of a repo that has its model and some companion."""
    return newest_first(snapshots.where("has_model AND companion_rank IS NOT NULL"), "repo").where("place = 1").select("repo", "snapshot", "companion_rank")


# Labels of a page's pictures in a request.
ORIGINAL = "the original full manga page."
ENHANCED = "the same full manga page rendered as grayscale/high-contrast assist view."


def image_labels(images: Column) -> Column:
    """(role, uri) pictures as (label, uri), numbered from 1."""
    said = lambda x: F.when(x["role"] == "enhanced", ENHANCED).otherwise(ORIGINAL)
    return F.transform(images, lambda x, k: F.struct(F.concat(F.lit("Image "), (k + 1).cast("string"), F.lit(": "), said(x)).alias("label"), x["uri"].alias("uri")))


def request_body(system: Column, prompt: Column, retry_prompt: Column, images: Column, attempt: Column, model: Column, most: Column, kind: str = "chat", hosted: bool = False, sampling: dict[str, Column] | None = None, effort: Column | None = None) -> Column:
    """JSON of one model request: text, labelled image references, the prompt of the attempt, and the options that its provider takes.

    kind is "chat" or "responses" (which only a hosted provider has); images is an array of (label, uri).
    A model run by oneself takes sampling (temperature, top_p, top_k) and is told not to reason; a
    hosted one takes an effort.
    """
    said = F.when(attempt > 1, retry_prompt).otherwise(prompt)
    if kind == "chat":
        part = lambda text, uri: F.struct(F.when(uri.isNull(), "text").otherwise("image_url").alias("type"), text.alias("text"), F.when(uri.isNotNull(), F.struct(uri.alias("url"))).alias("image_url"))
    else:
        part = lambda text, uri: F.struct(F.when(uri.isNull(), "input_text").otherwise("input_image").alias("type"), text.alias("text"), uri.alias("image_url"))
    none = F.lit(None).cast("string")
    shown = F.flatten(F.transform(images, lambda i: F.array(part(i["label"], none), part(none, i["uri"]))))
    content = F.concat(shown, F.array(part(said, none)))
    user = F.struct(F.lit("user").alias("role"), content.alias("content"))
    if kind != "chat":
        options = {"model": model, "instructions": system, "input": F.array(user), "reasoning": F.struct((none if effort is None else effort).alias("effort")), "stream": F.lit(True), "store": F.lit(False)}
    else:
        messages = F.array(F.struct(F.lit("system").alias("role"), F.array(part(system, none)).alias("content")), user)
        if hosted:
            options = {"model": model, "max_tokens": most, "reasoning_effort": none if effort is None else effort, "messages": messages}
        else:
            still = {k: F.lit(0) for k in ("presence_penalty", "frequency_penalty")}
            options = {"model": model, **(sampling or {}), **still, "max_tokens": most, "reasoning_budget": F.lit(0), "enable_thinking": F.lit(False), "messages": messages}
    return F.to_json(F.struct(*[c.alias(k) for k, c in options.items()]))

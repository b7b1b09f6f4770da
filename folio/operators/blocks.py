"""Text blocks of pages: from records, edits, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.geometry import apply_bbox_edit, clamp_bbox, estimate_font_px, offset_bbox
from folio.functions.labels import block_type, display_text, render_direction, uncertain
from folio.functions.text import trimmed

# Fixed values of a new block.
LINE_HEIGHT, ALIGN, TEXT_COLOR = 1.18, "center", "#111111"
BACKGROUND, SFX_BACKGROUND, OPACITY, SFX_OPACITY = "#fffdf5", "#fff4ea", 0.88, 0.7
CONFIDENCE, CONFIDENCE_WITHOUT_SOURCE = 0.92, 0.75
COPY_SHIFT = 16.0


def items_to_blocks(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, id, type, bbox, jp, ko) with (page_id, width, height) -> blocks."""
    kind = block_type(F.col("type"))
    rows = items.join(pages.select("page_id", "width", "height"), "page_id")
    source, translated, box = trimmed(F.col("jp")), trimmed(F.col("ko")), clamp_bbox(F.col("bbox"))
    sfx = F.col("block_type") == "sfx"
    rows = rows.select("page_id", F.col("id").alias("block_ord"), kind.alias("block_type"), box.alias("box"), source.alias("source_text"), translated.alias("translated_text"), "width", "height")
    return rows.select(
        "page_id", "block_ord", F.concat(F.col("page_id").cast("string"), F.lit("-block-"), F.col("block_ord").cast("string")).alias("block_id"),
        F.col("block_type").alias("type"), F.col("box").alias("bbox"), F.lit("normalized_1000").alias("bbox_space"), "source_text", "translated_text",
        F.when(F.col("source_text") != "", CONFIDENCE).otherwise(CONFIDENCE_WITHOUT_SOURCE).alias("confidence"),
        F.lit("vertical").alias("source_direction"), F.lit("horizontal").alias("render_direction"),
        estimate_font_px(display_text(F.col("translated_text"), F.col("source_text")), F.col("box"), F.col("width"), F.col("height")).alias("font_size_px"),
        F.lit(LINE_HEIGHT).alias("line_height"), F.lit(ALIGN).alias("text_align"), F.lit(TEXT_COLOR).alias("text_color"),
        F.when(sfx, SFX_BACKGROUND).otherwise(BACKGROUND).alias("background_color"), F.when(sfx, SFX_OPACITY).otherwise(OPACITY).alias("opacity"), F.lit(True).alias("auto_fit_text"),
    )


def uncertain_items(items: DataFrame) -> DataFrame:
    return items.where(uncertain(F.col("jp"), F.col("ko")))


def page_warnings(items: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, uncertain_count) of pages that have uncertain items."""
    return items.groupBy(key).agg(F.count_if(uncertain(F.col("jp"), F.col("ko"))).alias("uncertain_count")).where("uncertain_count > 0")


def visible_text(blocks: DataFrame) -> DataFrame:
    """block_id and display_text of blocks that are shown."""
    return blocks.where("render_direction <> 'hidden'").select("block_id", display_text(F.col("translated_text"), F.col("source_text")).alias("display_text"))


def edit_blocks(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """blocks with the patches (block_id, patch_ord and any block columns; null: as it was) of the same block_id.

    Of several patches of one block the last one of each column wins.  A box is clamped and goes to
    the layout box where there is one; a patch of render_bbox sets the layout box itself.
    """
    set_ = [c for c in patches.columns if c in blocks.columns and c not in ("block_id", "page_id", "block_ord")]
    last = patches.groupBy("block_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("patch_ord"))).alias(f"_{c}") for c in set_])
    rows = blocks.join(last, "block_id", "left")
    new = {c: F.coalesce(f"_{c}", c) for c in set_ if c not in ("bbox", "render_bbox", "render_direction")}
    if "render_direction" in blocks.columns:
        new["render_direction"] = render_direction(F.coalesce("_render_direction", "render_direction") if "render_direction" in set_ else F.col("render_direction"))
    layout = F.coalesce(clamp_bbox(F.col("_render_bbox")), "render_bbox") if "render_bbox" in set_ else F.col("render_bbox")
    if "render_bbox" in set_:
        new["render_bbox"] = layout
    if "bbox" in set_:
        source, moved = apply_bbox_edit(F.col("bbox"), layout, F.col("_bbox"))
        edited = F.col("_bbox").isNotNull()
        new |= {"bbox": F.when(edited, source).otherwise(F.col("bbox")), "render_bbox": F.when(edited, moved).otherwise(layout)}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in blocks.columns])


def delete_blocks(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    return blocks.join(ids.select("block_id").distinct(), "block_id", "left_anti")


def duplicate_blocks(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """blocks and shifted copies of those in ids, each copy after the page's last block and named by its place there, so no id repeats."""
    page, shift = Window.partitionBy("page_id"), F.lit(COPY_SHIFT)
    rows = blocks.join(ids.select("block_id", F.lit(True).alias("_chosen")).distinct(), "block_id", "left")
    chosen = F.coalesce(F.col("_chosen"), F.lit(False)) & F.col("page_id").isNotNull()
    upto = page.orderBy("block_ord", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.max("block_ord").over(page) + F.count(F.when(chosen, True)).over(upto)
    rows = rows.withColumns({"_place": place, "_chosen": chosen})
    new = {"block_ord": F.col("_place"), "block_id": F.concat("block_id", F.lit("-copy-"), F.col("_place").cast("string")), "bbox": offset_bbox(F.col("bbox"), shift, shift), "render_bbox": offset_bbox(F.col("render_bbox"), shift, shift)}
    block = F.struct(*blocks.columns)
    copy = F.struct(*[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in blocks.schema])
    return rows.select(F.inline(F.when(F.col("_chosen"), F.array(block, copy)).otherwise(F.array(block))))

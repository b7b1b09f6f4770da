"""Boxes on a 0..1000 grid, pixel boxes, and font estimates as column expressions.

A box is a struct (x, y, w, h) of doubles.  Finiteness is tested before greatest/least, which take
NaN for the largest value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import utf16_length

GRID = 1000.0
SIDES = ("x", "y", "w", "h")
MAX_PADDING = 14.0


def bbox(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in zip(SIDES, (x, y, w, h))])


def clamp(v: Column, lo: Column | float, hi: Column | float) -> Column:
    """Within lo..hi (hi wins if they cross); lo for null, NaN and infinities."""
    lo, hi = (F.lit(b) if isinstance(b, (int, float)) else b for b in (lo, hi))
    odd = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(odd, lo).otherwise(F.least(hi, F.greatest(lo, v)))


def clamp_bbox(b: Column) -> Column:
    x, y = clamp(b["x"], 0.0, GRID), clamp(b["y"], 0.0, GRID)
    return bbox(x, y, clamp(b["w"], 1.0, GRID - x), clamp(b["h"], 1.0, GRID - y))


def bbox_to_pixels(b: Column, width: Column, height: Column) -> Column:
    return bbox(b["x"] / GRID * width, b["y"] / GRID * height, b["w"] / GRID * width, b["h"] / GRID * height)


def pixels_to_bbox(b: Column, width: Column, height: Column) -> Column:
    w, h = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height)
    return clamp_bbox(bbox(b["x"] / w * GRID, b["y"] / h * GRID, b["w"] / w * GRID, b["h"] / h * GRID))


def render_bbox(source: Column, layout: Column) -> Column:
    """The layout box if there is one, else the source box, clamped."""
    return clamp_bbox(F.coalesce(layout, source))


def apply_bbox_edit(source: Column, layout: Column, edit: Column) -> tuple[Column, Column]:
    """(source box, layout box) after an edit, which goes to the layout box where there is one."""
    return F.when(layout.isNull(), clamp_bbox(edit)).otherwise(source), F.when(layout.isNotNull(), clamp_bbox(edit))


def offset_bbox(b: Column, dx: Column, dy: Column) -> Column:
    return F.when(b.isNotNull(), clamp_bbox(bbox(b["x"] + dx, b["y"] + dy, b["w"], b["h"])))


def drag_bbox(b: Column, kind: Column, dx_px: Column, dy_px: Column, stage_w: Column, stage_h: Column) -> Column:
    """A recorded drag on a stage: move shifts the box, resize grows it."""
    dx, dy = dx_px / F.greatest(F.lit(1), stage_w) * GRID, dy_px / F.greatest(F.lit(1), stage_h) * GRID
    move = kind == "move"
    return clamp_bbox(bbox(F.when(move, b["x"] + dx).otherwise(b["x"]), F.when(move, b["y"] + dy).otherwise(b["y"]), F.when(move, b["w"]).otherwise(b["w"] + dx), F.when(move, b["h"]).otherwise(b["h"] + dy)))


def js_round(v: Column) -> Column:
    return F.floor(v + 0.5)


def estimate_font_px(text: Column, b: Column, width: Column, height: Column) -> Column:
    px = bbox_to_pixels(b, width, height)
    n = F.greatest(F.lit(1), utf16_length(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", "")))
    lines = F.greatest(F.lit(1), F.ceil(n / F.greatest(F.lit(4), F.floor(px["w"] / 20))))
    by_height = F.floor(px["h"] / (lines * 1.2))
    by_width = F.floor(px["w"] / F.least(F.lit(12), F.greatest(F.lit(4), n)))
    return clamp(F.least(by_height, by_width, F.lit(40)).cast("double"), 12.0, 72.0)


def scaled_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size with the long side scaled down to at most `most`, never up, each side at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height, F.lit(1)))
    return tuple(F.greatest(F.lit(1), js_round(v * scale)).cast("int") for v in (width, height))


def block_rect(b: Column, page_w: Column, page_h: Column, stage_w: Column, stage_h: Column) -> Column:
    px, sx, sy = bbox_to_pixels(b, page_w, page_h), stage_w / F.greatest(F.lit(1), page_w), stage_h / F.greatest(F.lit(1), page_h)
    return bbox(px["x"] * sx, px["y"] * sy, px["w"] * sx, px["h"] * sy)


def padding_px(rect: Column) -> Column:
    side = F.least(rect["w"], rect["h"])
    return F.when(side <= 48, 0).when(side <= 72, 1).when(side <= 96, 2).otherwise(js_round(clamp(side * 0.06, 3.0, MAX_PADDING))).cast("int")


def vertical_columns(chars: Column, font: Column, line: Column, height: Column) -> Column:
    """Columns that so many characters (without spaces) need at a font size."""
    per = F.greatest(F.lit(1), F.floor(height / F.greatest(font, line)))
    return F.when(chars <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(chars / per))).cast("int")


def vertical_fits(chars: Column, font: Column, line: Column, width: Column, height: Column) -> Column:
    return (chars <= 0) | (vertical_columns(chars, font, line, height) * (font * 1.15) <= width)


def rgba(hex_color: Column, alpha: Column) -> Column:
    v = F.regexp_replace(hex_color, "^#", "")
    part = lambda k: F.conv(F.substring(v, k, 2), 16, 10)
    a = clamp(alpha, 0.0, 1.0)
    shown = F.when(a == F.floor(a), a.cast("int").cast("string")).otherwise(a.cast("string"))
    return F.concat(F.lit("rgba("), part(1), F.lit(", "), part(3), F.lit(", "), part(5), F.lit(", "), shown, F.lit(")"))

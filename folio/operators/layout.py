"""Layout checks: largest fitting font and overflow of every block of a corpus.

Vertical text is pure arithmetic, a binary search inside one expression.  Horizontal text wraps by
a stated glyph model (0.95 em per code point) in an Arrow function, on horizontal rows only.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from folio.functions.geometry import block_rect, padding_px, render_bbox, vertical_fits
from folio.functions.text import utf16_length

# Fixed values of the fit.
MIN_FONT, MAX_FONT, STEPS, GLYPH_EM = 2, 256, 8, 0.95
BORDER, GUARD = 1, 10
_SPACE = re.compile(r"\s")


def wrap(text: str, width: float, font: float) -> list[int]:
    """Lengths in code points of the lines that text takes at a width."""
    per = max(1, math.floor(width / (GLYPH_EM * font) + 1e-9))
    out: list[int] = []
    for paragraph in text.replace("\r", "").split("\n"):
        flat = re.sub(r"\s+", " ", paragraph).strip()
        if not flat:
            out.append(0)
        k = 0
        while k < len(flat):
            line = flat[k : k + per]
            k += len(line)
            if k < len(flat) and flat[k] == " ":  # a space that would begin a line is dropped
                k += 1
            out.append(len(line.rstrip()))
    return out


def _fits(text: str, font: float, width: float, height: float, line_height: float, glyphs: int = 0) -> bool:
    """Whether the wrapped text fits; a text of so many glyphs without white space need not be wrapped to know its lines."""
    if glyphs:
        per = max(1, math.floor(width / (GLYPH_EM * font) + 1e-9))
        n, longest = -(-glyphs // per), min(per, glyphs)
    else:
        lines = wrap(text, width, font)
        n, longest = len(lines), max(lines, default=0)
    return n * font * line_height <= height and longest * GLYPH_EM * font <= width + 1e-9


@F.pandas_udf(StructType([StructField("font", IntegerType()), StructField("overflow", BooleanType())]))
def _horizontal(text: pd.Series, cap: pd.Series, width: pd.Series, height: pd.Series, line: pd.Series, auto: pd.Series) -> pd.DataFrame:
    out = []
    for t, c, w, h, lh, fit in zip(text, cap, width, height, line, auto):
        c = max(MIN_FONT, int(c))
        if not t.strip():
            out.append((c, False))
            continue
        glyphs = 0 if _SPACE.search(t) else len(t)
        lo, hi, best = MIN_FONT, c, MIN_FONT if fit else c
        while fit and lo <= hi:
            mid = (lo + hi) // 2
            if _fits(t, mid, w, h, lh, glyphs):
                best, lo = mid, mid + 1
            else:
                hi = mid - 1
        out.append((best, not _fits(t, best, w, h, lh, glyphs)))
    return pd.DataFrame(out, columns=["font", "overflow"])


def fit_vertical(chars: Column, cap: Column, width: Column, height: Column, line_height: Column) -> Column:
    """Largest font in MIN_FONT..cap that fits, MIN_FONT if none does, by bisection in one expression."""
    start = F.struct(F.lit(MIN_FONT).alias("lo"), cap.cast("int").alias("hi"), F.lit(MIN_FONT).alias("best"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        fine = vertical_fits(chars, mid, mid * line_height, width, height)
        live = s["lo"] <= s["hi"]
        return F.struct(F.when(live & fine, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(live & ~fine, mid - 1).otherwise(s["hi"]).alias("hi"), F.when(live & fine, mid).otherwise(s["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["best"])


def layout_qa(blocks: DataFrame, stage_w: float, stage_h: float) -> DataFrame:
    """blocks (block_id, text, bbox, render_bbox, width, height, render_direction, font_size_px, line_height, auto_fit_text) -> block_id, font_px, overflow, padding."""
    sw, sh = F.lit(float(stage_w)), F.lit(float(stage_h))
    rows = blocks.withColumn("_r", block_rect(render_bbox(F.col("bbox"), F.col("render_bbox")), F.col("width"), F.col("height"), sw, sh))
    rows = rows.withColumn("padding", padding_px(F.col("_r")))
    inner = lambda side: F.greatest(F.lit(1.0), F.greatest(F.lit(1.0), F.col(f"_r.{side}") - F.col("padding") * 2 - 2 * BORDER) - 2 * GUARD)
    scale = F.least(sw / F.greatest(F.lit(1), F.col("width")), sh / F.greatest(F.lit(1), F.col("height")))
    auto = F.coalesce("auto_fit_text", F.lit(True))
    rows = rows.withColumns({"_w": inner("w"), "_h": inner("h"), "_p": F.greatest(F.lit(float(MIN_FONT)), F.floor(F.col("font_size_px") * scale).cast("double")), "_auto": auto})
    cap = F.when(F.col("_auto"), F.least(F.lit(float(MAX_FONT)), F.greatest(F.lit(float(MIN_FONT)), F.col("_p"), F.col("_w"), F.col("_h")))).otherwise(F.col("_p"))
    rows = rows.withColumn("_cap", F.greatest(F.lit(MIN_FONT), F.floor(cap)).cast("int"))
    upright = F.col("render_direction") == "vertical"
    chars = utf16_length(F.regexp_replace("text", r"(?U)\s+", ""))
    v = rows.where(upright).withColumn("_n", chars)
    v = v.withColumn("font_px", F.when(F.col("_auto") & (F.col("_n") > 0), fit_vertical(F.col("_n"), F.col("_cap"), F.col("_w"), F.col("_h"), F.col("line_height"))).otherwise(F.col("_cap")))
    v = v.withColumn("overflow", (F.col("_n") > 0) & ~vertical_fits(F.col("_n"), F.col("font_px"), F.col("font_px") * F.col("line_height"), F.col("_w"), F.col("_h")))
    h = rows.where(~upright | F.col("render_direction").isNull()).withColumn("_f", _horizontal(F.coalesce("text", F.lit("")), "_cap", "_w", "_h", "line_height", "_auto"))
    out = ["block_id", "font_px", "overflow", "padding"]
    return v.select(*out).unionByName(h.select("block_id", F.col("_f.font").alias("font_px"), F.col("_f.overflow").alias("overflow"), "padding"))

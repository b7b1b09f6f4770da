"""Text, path and number rules as column expressions (all inside code generation)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
DEFAULT_MIME = "image/png"
PREVIEW_CHARS = 240
# What script engines take for white space.
BLANK = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    """Trims every Unicode space and the byte order mark, as script engines do."""
    return F.trim(c, F.lit(BLANK))


def trimmed(c: Column) -> Column:
    """As js_trim, for a column at hand: trims only where an end is blank, which costs less where few are."""
    ends = F.ascii(c).isin(*map(ord, BLANK)) | F.ascii(F.substring(c, -1, 1)).isin(*map(ord, BLANK))
    return F.when(ends, js_trim(c)).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(js_trim(c), F.lit(""))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def is_ascii(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\x00-\x7F]*$"), F.lit(True))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def with_search_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the search form (compatibility form, trimmed, lower case) of a column.

    ASCII rows, which need no normalisation, stay in the JVM; the others take an Arrow branch.
    """
    plain = df.where(is_ascii(F.col(column))).withColumn(out, F.lower(js_trim(F.col(column))))
    rest = df.where(~is_ascii(F.col(column))).withColumn(out, F.lower(js_trim(_nfkc(F.col(column)))))
    return plain.unionByName(rest)


def search_text(query: str) -> str:
    return unicodedata.normalize("NFKC", query or "").strip().strip("﻿").strip().lower()


def preview(c: Column, most: int = PREVIEW_CHARS) -> Column:
    flat = js_trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def truncate_note(c: Column, most: int, dots: str = "...") -> Column:
    """Cuts a text and says how many characters went; dots is `...` or the one-character ellipsis."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit(f"{dots} [truncated "), (F.length(c) - most).cast("string"), F.lit(" chars]")))


def slash_norm(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(slash_norm(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def strip_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def mime_of(path: Column) -> Column:
    ext, out = extension(path), F.lit(DEFAULT_MIME)
    for k, v in MIME_TYPES.items():
        out = F.when(ext == k, F.lit(v)).otherwise(out)
    return out


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_of(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def sanitize_title(title: Column, fallback: Column | str) -> Column:
    return F.coalesce(blank_to_null(title), F.lit(fallback) if isinstance(fallback, str) else fallback)


def escape_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r?\n", r"\\n")


def finite(v: Column) -> Column:
    """The double, or null for null, NaN and infinities."""
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def js_number(c: Column) -> Column:
    """A script engine's number of a string: blank is 0, hexadecimal counts, anything not finite is null."""
    t = js_trim(c)
    hexed = F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 64), 16, 10).cast("double"))
    plain = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), finite(t.try_cast("double")))
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(hexed, plain))


def natural_key(c: Column) -> Column:
    """Sort key for numeric-aware, case- and accent-blind order in any script: an array that orders as it should.

    Runs of other characters than digits carry the root collation of Unicode without case and
    accents; digit runs become their length and digits without leading zeros.  Order by this and
    then by an input ordinal, since different texts can have one key.
    """
    runs = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))

    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        key = F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(F.concat(F.lit("1"), x))
        return F.collate(key, "UNICODE_CI_AI")

    return F.transform(runs, part)


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def log_fields(line: Column) -> tuple[Column, Column, Column, Column]:
    """ts, level, message and detail (the trailing JSON object, null if it is none) of a log line."""
    line = F.regexp_replace(line, r"^\x{FEFF}", "")
    pattern = r"(?s)^\[([^\]]*)\] \[([A-Z]+)\] (.*)$"
    rest = F.regexp_extract(line, pattern, 3)
    cut = F.instr(rest, " {")
    tail = F.substring(rest, cut + 1, F.length(rest))
    json = F.when((cut > 0) & F.try_parse_json(tail).isNotNull(), tail)
    message = F.when(json.isNotNull(), F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    return parse_iso(F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")), message, json

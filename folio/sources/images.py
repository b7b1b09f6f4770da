"""Sizes of images from the first bytes of their files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.storage import opened

#: Size of a page whose image cannot be read.
FALLBACK = (1000, 1400)
#: Bytes read first; where a header lies further on (after large metadata), as many again each time.
HEAD = 1 << 16
#: JPEG segments that begin a frame and so hold its size, and those without a length.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_BARE = {0x01, *range(0xD0, 0xD9)}
Size = tuple[int, int]


class More(Exception):
    """The header goes on beyond the bytes at hand, at least to this place."""


def _int(b: bytes, at: int, n: int, order: str = "big") -> int:
    if len(b) < at + n:
        raise More(at + n)
    return int.from_bytes(b[at : at + n], order)


def _jpeg(b: bytes) -> Size | None:
    at = 2
    while True:
        if _int(b, at, 1) != 0xFF:
            return None
        while (mark := _int(b, at + 1, 1)) == 0xFF:  # fill bytes
            at += 1
        if mark in _FRAMES:
            return _int(b, at + 7, 2), _int(b, at + 5, 2)
        if mark in (0xD9, 0xDA):
            return None
        at += 2 if mark in _BARE else 2 + _int(b, at + 2, 2)


def _webp(b: bytes) -> Size | None:
    _int(b, 0, 30)
    kind = b[12:16]
    if kind == b"VP8X":
        return 1 + _int(b, 24, 3, "little"), 1 + _int(b, 27, 3, "little")
    if kind == b"VP8L" and b[20] == 0x2F:
        bits = _int(b, 21, 4, "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        return _int(b, 26, 2, "little") & 0x3FFF, _int(b, 28, 2, "little") & 0x3FFF
    return None


def header_size(b: bytes) -> Size | None:
    """(width, height) from the first bytes of a PNG, JPEG or WebP file; None if they are none of these or a side is 0.  More if it takes more bytes to tell."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        size = (_int(b, 16, 4), _int(b, 20, 4)) if b[12:16] in (b"IHDR", b"") else None
    elif b[:2] == b"\xff\xd8":
        size = _jpeg(b)
    elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        size = _webp(b)
    else:
        size = None
    return size if size and all(size) else None


def _of_file(path: str) -> Size | None:
    try:
        with opened(path) as f:
            b, want = f.read(HEAD), HEAD
            while True:
                try:
                    return header_size(b)
                except More as e:
                    if len(b) < want:
                        return None
                    want = max(want + HEAD, int(e.args[0]))
                    b += f.read(want - len(b))
    except (OSError, pa.ArrowException):
        return None


def _of_bytes(b: bytes | None) -> Size | None:
    try:
        return header_size(b or b"")
    except More:
        return None


def _sized(column: str, of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [of(x) for x in rows[column]]
            out = rows.drop(columns=[column]) if of is _of_bytes else rows
            yield out.assign(width=[(s or FALLBACK)[0] for s in found], height=[(s or FALLBACK)[1] for s in found], size_known=[s is not None for s in found])

    return run


def with_image_sizes(files: DataFrame, path: str = "path") -> DataFrame:
    """files with width, height and size_known, from the head of the file that each path names; FALLBACK where that gives no size."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(_sized(path, _of_file), f"{schema}, width int, height int, size_known boolean")


def with_header_sizes(files: DataFrame, content: str = "content") -> DataFrame:
    """The same of files whose first bytes are a binary column, which is dropped."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != content)
    return files.mapInPandas(_sized(content, _of_bytes), f"{schema}, width int, height int, size_known boolean")


def size_conflicts(pages: DataFrame) -> DataFrame:
    """Pages whose stored width or height is not that of their image: page rows with the image's size; pages without a known size are left out."""
    return pages.where("size_known AND (width <> page_width OR height <> page_height)").withColumn("ratio", F.col("width") * F.col("page_height") / (F.col("height") * F.col("page_width")))

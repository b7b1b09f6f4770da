"""Growing logs, archives read by range, and image headers."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.sources import images, tail
from folio.sources.files import scan_zip_entries
from folio.sources.logs import tail_log


def run(source, folder):
    def keep(batch, n):
        batch.write.mode("append").parquet(f"{folder}/out")

    source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination(100)


LINE = "[2024-01-02T03:04:05.678Z] [INFO] {0}\n"


def test_appended_lines_come_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    path = logs / "app.log"
    out = lambda: sorted(r.message for r in spark.read.parquet(f"{tmp_path}/out").collect())
    told = []

    def grown(text, mode="a"):
        with path.open(mode, encoding="utf-8") as f:
            f.write(text)
        run(tail_log(spark, str(logs), splitBytes="50"), tmp_path)  # every run is a restart of the stream

    grown("﻿" + LINE.format("a") + LINE.format("한 b")[:-5])
    told += ["a"]
    assert out() == told
    grown(LINE.format("한 b")[-5:] + LINE.format("c") * 2)
    told += ["c", "c", "한 b"]
    assert out() == told
    (logs / "other.log").write_text(LINE.format("z"), encoding="utf-8")
    grown("")
    told += ["z"]
    assert out() == sorted(told)
    grown(LINE.format("new"), "w")  # cut short: begins again
    told += ["new"]
    assert out() == sorted(told)
    grown("")
    assert out() == sorted(told)


def test_spans_hold_each_line_once(tmp_path):
    path = tmp_path / "x.log"
    body = b"".join(b"%d" % k * (k % 7) + b"\n" for k in range(200))
    path.write_bytes(body)
    for split in (1, 2, 3, 10, 64, 10_000):
        got = [x for s in tail.spans({}, {str(path): len(body)}, split) for x in tail.lines(str(tmp_path), s)]
        assert [x[2].encode() for x in got] == body.split(b"\n")[:-1]
        assert all(body[b : b + len(t)] == t.encode() and (b == 0 or body[b - 1 : b] == b"\n") for _, b, t in got)
    assert tail.spans({"f": 100}, {"f": 40}, 100) == [tail.Span("f", 0, 40, 40)]
    assert tail.spans({"f": 40}, {"f": 40}, 100) == []
    path.write_bytes(b"whole\nhalf")
    assert tail.whole_lines(str(tmp_path), str(path), 10) == 6 and tail.whole_lines(str(tmp_path), str(path), 10, 6) == 6


def test_from_the_end(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "app.log").write_text(LINE.format("old"))
    run(tail_log(spark, str(logs), from_end=True), tmp_path)
    with (logs / "app.log").open("a") as f:
        f.write(LINE.format("new"))
    run(tail_log(spark, str(logs), from_end=True), tmp_path)
    assert [r.message for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["new"]


def test_archives_by_range(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a b+%.zip", "w") as z:
        z.writestr("2.png", b"x" * 10)
        z.writestr("10.PNG", b"y")
        z.writestr("dir\\1.jpg", b"")
        z.writestr("note.txt", b"")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    rows = scan_zip_entries(spark, str(tmp_path)).collect()
    good = sorted((r.page_ord, r.zip_entry_name, r.size) for r in rows if r.error is None)
    assert good == [(1, "2.png", 10), (2, "10.PNG", 1), (3, "dir/1.jpg", 0)]
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.error) == ["broken.zip"]


def test_archive_above_two_gigabytes(spark, tmp_path):
    """A sparse file: an entry of 5 GB of nothing, stored, and one after it, so offsets need Zip64."""
    path, size = tmp_path / "big.zip", 5 << 30
    with path.open("wb") as f:
        name = b"big.png"
        f.write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, size, size))
        f.seek(size, 1)
        at = f.tell()
        f.write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0, 0, 0, 0, 0, 0, 0, 9, 0) + b"small.jpg")
        start = f.tell()
        f.write(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20, 0, 0, 0, 0, 0) + name + struct.pack("<2H2Q", 1, 16, size, size))
        f.write(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0, 0, 9, 12, 0, 0, 0, 0, 0xFFFFFFFF) + b"small.jpg" + struct.pack("<2HQ", 1, 8, at))
        end = f.tell()
        f.write(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 2, 2, end - start, start))
        f.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        f.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 2, 2, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    rows = scan_zip_entries(spark, str(tmp_path)).collect()
    assert [(r.error, r.zip_entry_name, r.size) for r in sorted(rows, key=lambda r: r.page_ord)] == [(None, "big.png", size), (None, "small.jpg", 0)]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"rest"


def jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xff\xc2" + struct.pack(">HBHH", 11, 8, h, w) + b"rest"


def webp(kind, body):
    return b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + body.ljust(14, b"\0")


SIZES = {
    "a.png": (png(640, 480), (640, 480)),
    "b.jpg": (jpeg(3, 70_000 % 65_536), (3, 70_000 % 65_536)),
    "far.jpeg": (jpeg(9, 8, b"\xff\xe1" + struct.pack(">H", 65_000) + b"\xff" * 64_998 + b"\xff\xe2" + struct.pack(">H", 60_000) + b"x" * 59_998), (9, 8)),
    "x.webp": (webp(b"VP8X", b"\0\0\0\0" + (1919).to_bytes(3, "little") + (1079).to_bytes(3, "little")), (1920, 1080)),
    "l.webp": (webp(b"VP8L", b"\x2f" + (99 | 199 << 14).to_bytes(4, "little")), (100, 200)),
    "v.webp": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 31, 0x4000 | 17)), (31, 17)),
    "none.png": (b"", None),
    "zero.png": (png(0, 5), None),
    "cut.png": (png(5, 5)[:18], None),
    "cut.jpg": (jpeg(5, 5)[:6], None),
    "nosize.jpg": (b"\xff\xd8\xff\xda" + b"x" * 40, None),
    "text.png": (b"<html>", None),
}


def test_image_sizes(spark, tmp_path):
    for name, (content, _) in SIZES.items():
        (tmp_path / name).write_bytes(content)
    want = {n: (*(s or images.FALLBACK), s is not None) for n, (_, s) in SIZES.items()}
    files = spark.createDataFrame([(str(tmp_path / n),) for n in [*SIZES, "absent.png"]], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.size_known) for r in images.with_image_sizes(files).collect()}
    assert got == want | {"absent.png": (1000, 1400, False)}
    rows = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in SIZES.items()] + [("null", None)], "name string, content binary")
    got = {r.name: (r.width, r.height, r.size_known) for r in images.with_header_sizes(rows).collect()}
    assert got == want | {"null": (1000, 1400, False)}


def test_read_back_through_spark(spark, tmp_path):
    for name in ("a.png", "b.jpg"):
        (tmp_path / name).write_bytes(SIZES[name][0])
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    assert listed.count() == images.with_image_sizes(listed).where(F.col("size_known")).count() == 2
    assert images.with_image_sizes(listed.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 17, 40])
def test_any_cut_header_is_safe(n):
    for content, size in SIZES.values():
        assert images._of_bytes(content[:n]) in (size, None)

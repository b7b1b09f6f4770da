"""Lines appended to files, as a stream with byte offsets.

Spark's own file streams see each file once.  This source remembers how far every file below a path
has been read, gives the whole lines that were appended since, and begins a file again that has
become shorter.  A line without its line break yet waits for it.  Offsets are the stream's
checkpoint, so after a restart no line is lost or told twice; a file that was cut short and has
grown beyond its old length between two micro-batches cannot be told from one that only grew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from folio.sources.storage import located, sizes

#: Bytes that one task reads, and that are looked at together for line breaks.
SPLIT, BLOCK = 1 << 26, 1 << 20


class Span(NamedTuple):
    """Lines of a file that begin in [start, stop); end is where the last whole line ends."""

    file: str
    start: int
    stop: int
    end: int


class SpanPartition(InputPartition):
    def __init__(self, span: Span):
        self.value = span


def spans(start: dict, end: dict, split: int = SPLIT) -> list[Span]:
    """What is new between two offsets {file: bytes}, in pieces of at most split bytes; a file that is shorter than before is new from its first byte."""
    out = []
    for file, stop in sorted(end.items()):
        begin = start.get(file, 0)
        begin = 0 if begin > stop else begin
        out += [Span(file, k, min(k + split, stop), stop) for k in range(begin, stop, split)]
    return out


def whole_lines(root: str, file: str, size: int, known: int = 0) -> int:
    """Bytes of a file up to its last line break, looking back no further than what is known to be whole."""
    store, _ = located(root)
    with store.open_input_file(file) as f:
        stop = size
        while stop > known:
            start = max(known, stop - BLOCK)
            f.seek(start)
            at = f.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return min(known, size)


def lines(root: str, span: Span) -> Iterator[tuple[str, int, str]]:
    """(file, byte, line) of a span's lines; its first line is the one before's, unless it begins at the span's start."""
    store, _ = located(root)
    with store.open_input_file(span.file) as f:
        at = max(0, span.start - 1)
        f.seek(at)
        rest, first = b"", span.start > 0
        while at < span.stop or rest:
            block = f.read(min(BLOCK, span.end - at - len(rest)))
            if not block:
                break
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                begin, at = at, at + len(line) + 1
                if first:
                    first = False
                    continue
                if begin >= span.stop:
                    return
                yield span.file, begin, line.decode("utf-8", "replace").removesuffix("\r")


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, at_end: bool, split: int):
        self.root, self.at_end, self.split = root, at_end, split
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.at_end else {}

    def latestOffset(self) -> dict:
        found = sizes(self.root)
        known = {f: n for f, n in self.seen.items() if n <= found.get(f, -1)}
        self.seen = {f: whole_lines(self.root, f, n, known.get(f, 0)) for f, n in found.items()}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [SpanPartition(x) for x in spans(start, end, self.split)]

    def read(self, partition: SpanPartition) -> Iterator[tuple[str, int, str]]:
        return lines(self.root, partition.value)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Format `appended_lines`: option path, startingPosition (`begin` or `end`), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, byte long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("startingPosition", "begin") == "end", int(self.options.get("splitBytes", SPLIT)))

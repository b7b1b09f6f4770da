"""Files of any store that pyarrow can open, read by range from inside tasks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """Store and place in it of a URI as Spark writes it (file:/a), or of a plain path."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if not path.startswith("/") else (fs.LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    """A file to seek in: only what is asked for is read."""
    store, place = located(path)
    return store.open_input_file(place)


def sizes(root: str) -> dict[str, int]:
    """Size of every file below a folder, or of the one file that root names."""
    store, place = located(root)
    info = store.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File}

"""Bytes of files read by ranges in tasks, through Arrow's file systems."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow.fs as pafs

#: Schemes that Arrow opens, and what it calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
_PATH = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(/.*)")
_known: dict[tuple[str, str], tuple[pafs.FileSystem, str]] = {}


def scheme(path: str) -> str:
    """A path's scheme; "file" without one."""
    found = _PATH.fullmatch(path)
    return (found[1] or "file").lower() if found else "file"


def opened(path: str):
    """A file that can be read at any place. A worker keeps its file systems."""
    found = _PATH.fullmatch(path)
    if found is None or (found[1] or "file") == "file":
        return pafs.LocalFileSystem().open_input_file(found[3] if found else path)
    key = SCHEMES[found[1].lower()], found[2] or ""
    if key not in _known:
        _known[key] = pafs.FileSystem.from_uri(f"{key[0]}://{key[1]}/")
    fs, base = _known[key]
    return fs.open_input_file(f"{base.rstrip('/')}{found[3]}")


class Window:
    """A file's first ``width`` bytes, then ``step`` bytes from wherever is asked: a walk by lengths doesn't read what it passes over."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int, width: int = 1 << 16, step: int = 1 << 12) -> None:
        self.read_at, self.size, self.width, self.step = read_at, size, width, step
        self.start, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the file's end."""
        if at >= self.size:
            return b""
        n = min(n, self.size - at)
        if at < self.start or at + n > self.start + len(self.held):
            self.start, self.held = at, self.read_at(min(max(n, self.step if at else self.width), self.size - at), at)
        return self.held[at - self.start : at - self.start + n]

"""Files of any store that tasks can open: local and mounted paths, and the stores that Arrow knows by URI.

Listings travel as plain names and sizes; bytes are read by the task that uses them.
"""

from __future__ import annotations

import posixpath
import re
from fnmatch import fnmatch

import pyarrow.fs as pafs


def plain(path: str) -> str:
    """``file:`` URIs as plain paths; other names as they are."""
    return re.sub(r"^file:/*", "/", path)


def open_store(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path inside it, and the prefix that makes its names URIs again."""
    path = plain(path)
    if "://" not in path:
        return pafs.LocalFileSystem(), path, ""
    store, inside = pafs.FileSystem.from_uri(path)
    return store, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def list_files(path: str, glob: str | None = None, recursive: bool = True) -> list[tuple[str, int, float]]:
    """``(name, bytes, modified)`` of the files below ``path``, sorted by name."""
    store, inside, prefix = open_store(path)
    found = store.get_file_info(pafs.FileSelector(inside, recursive=recursive, allow_not_found=True))
    if not found and (one := store.get_file_info(inside)).is_file:
        found = [one]
    return sorted(
        (prefix + f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0)
        for f in found
        if f.is_file and (glob is None or fnmatch(posixpath.basename(f.path), glob))
    )


def read_bytes(path: str) -> bytes:
    store, inside, _ = open_store(path)
    with store.open_input_file(inside) as f:
        return f.read()


def write_bytes(path: str, content: bytes) -> None:
    """Write a file whole: a reader sees the old one or the new one, also when a task is tried again."""
    store, inside, _ = open_store(path)
    store.create_dir(posixpath.dirname(inside), recursive=True)
    part = f"{inside}.{id(content):x}.part"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, inside)

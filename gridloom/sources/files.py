"""Files that Python sources open themselves, on any file system that Arrow knows."""

from __future__ import annotations

from fnmatch import fnmatch

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it of an absolute path or a URI (file, hdfs, s3, gs)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def listed(path: str, suffix: str) -> tuple[fs.FileSystem, list[str]]:
    """The files of a path, sorted: a file, a folder's files of this suffix, or a pattern in the last part of the path."""
    head, _, last = path.rstrip("/").rpartition("/")
    pattern = any(c in last for c in "*?[")
    system, at = located(head if pattern else path)
    if not pattern and system.get_file_info(at).type == fs.FileType.File:
        return system, [at]
    found = system.get_file_info(fs.FileSelector(at))
    match = last if pattern else f"*{suffix}"
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, match))

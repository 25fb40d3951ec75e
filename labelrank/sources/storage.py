"""File systems as seen from Python workers, for the formats that Spark does not read itself."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI (local, hdfs, s3, gs) and the path in it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def files_in(path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder that end in ``suffix``, in order of name; names that
    begin with _ or . are left out."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner))
             if f.is_file and f.base_name.endswith(suffix) and f.base_name[0] not in "_."]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


def local_path(path: str) -> str | None:
    """The path in a mounted file system, or None for a remote one."""
    fs, inner = file_system(path)
    return inner if isinstance(fs, pafs.LocalFileSystem) else None

"""Listing and opening files from the driver and from tasks, on any file system Arrow knows."""

from __future__ import annotations

import fnmatch
import os
import re

import pyarrow as pa
from pyarrow import fs

_WILD = re.compile(r"[*?\[]")


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("s3a:"):
        path = "s3:" + path[len("s3a:") :]
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    system, inner = resolve(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def _prefix(path: str, inner: str) -> str:
    """What stands before the inner path of a store, so that a listed file can be opened again."""
    if path.startswith("file:") or "://" not in path:
        return ""
    plain, inner = path.rstrip("/"), inner.rstrip("/")
    return plain[: len(plain) - len(inner)] if plain.endswith(inner) else path.split("://")[0] + "://"


def known(path: str) -> bool:
    """Whether Arrow can read the file system of ``path``; Spark's own readers know others too."""
    try:
        resolve(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def listed_as(path: str) -> str:
    """How a file or folder is named in a listing."""
    inner = resolve(path)[1]
    return _prefix(path, inner) + inner


def list_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """``(path, length)`` of a file, of all files below a folder, or of a wildcard's matches.

    Paths outside local folders keep their scheme and authority.
    """
    system, root = resolve(path) if not _WILD.search(path) else (None, None)
    if system is not None:
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [(_prefix(path, root) + info.path, info.size)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        pattern, prefix = None, _prefix(path, root)
    else:
        fixed = path[: _WILD.search(path).start()].rsplit("/", 1)[0] or "/"
        system, root = resolve(fixed)
        prefix = _prefix(fixed, root)
        pattern = root + path[len(fixed) :] if root != "/" else path
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(
        (prefix + i.path, i.size)
        for i in found
        if i.type == fs.FileType.File
        and i.path.endswith(suffix)
        and (pattern is None or fnmatch.fnmatch(i.path, pattern))
    )


def open_file(path: str):
    system, inner = resolve(path)
    return system.open_input_file(inner)


# From so many files on, one sync of the machine is cheaper than one commit of its journal per file.
TOGETHER = 16


def settle(handles: list[int]) -> None:
    """Have local files on disk, and close them; an error of any is raised."""
    try:
        if len(handles) >= TOGETHER:
            os.sync()
        # After the sync these have nothing to wait for, but tell what has failed.
        for handle in handles:
            os.fsync(handle)
    finally:
        for handle in handles:
            os.close(handle)

"""Listing of folder trees by tasks: the driver never holds a list of files."""

from __future__ import annotations

import fnmatch
import os
import stat
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.session import reading_tasks, store
from clipledger.sources import files

_FOUND = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified_ms", pa.int64())])
_COLUMNS = "path string, length bigint, modified_ms bigint"
# Names that Spark's own readers pass over: hidden ones, and those that are not written to their end.
PASSED_OVER = r"/(\.|_(?![^/]*=))|\._COPYING_$"
# Entries of one folder sent at once.
SENT = 1 << 14


def _list_folder(folder: str) -> Iterator[tuple[str, int | None, int | None]]:
    """Files of a folder with their lengths and times in ms, and its folders without them."""
    system, root = files.resolve(folder)
    info = system.get_file_info(root)
    prefix = files._prefix(folder, root)
    if info.type == fs.FileType.File:
        yield _entry(prefix, info)
    elif isinstance(system, fs.LocalFileSystem):
        # A folder of millions of files is never held whole.
        yield from _list_local(prefix, root)
    else:
        # A folder that is gone by now holds nothing.
        for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            yield _entry(prefix, found)


def _entry(prefix: str, info: fs.FileInfo) -> tuple[str, int | None, int | None]:
    if info.type != fs.FileType.File:
        return prefix + info.path, None, None
    return prefix + info.path, info.size, None if info.mtime_ns is None else info.mtime_ns // 1_000_000


def _list_local(prefix: str, root: str) -> Iterator[tuple[str, int | None, int | None]]:
    try:
        entries = os.scandir(root)
    except FileNotFoundError:
        return
    with entries:
        for entry in entries:
            try:
                facts = entry.stat()
            except FileNotFoundError:
                continue
            path = f"{prefix}{root.rstrip('/')}/{entry.name}"
            if stat.S_ISREG(facts.st_mode):
                yield path, facts.st_size, facts.st_mtime_ns // 1_000_000
            elif stat.S_ISDIR(facts.st_mode):
                yield path, None, None


def _expand(batches):
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            found = _list_folder(folder)
            while some := list(islice(found, SENT)):
                columns = zip(_FOUND, zip(*some))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in columns], schema=_FOUND)


def list_tree(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, length`` of a file, of all files below a folder, or of a wildcard's matches.

    The same files as ``files.list_files``. Folders of one level are listed side by side, each by
    one task, and are the input of the next level; every level is a table in the shared folder,
    so there is one job per level of the tree and none lists a folder twice.
    """
    return list_files(spark, path, suffix).select("path", "length")


def list_visible(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, length, modified`` of the files that Spark's readers would find below ``path``."""
    found = list_files(spark, path, suffix)
    # What stands above the first wildcard, or the folder itself, may have any name.
    above = files.listed_as(_root(path)).rstrip("/")
    below = F.expr(f"substring(path, {len(above) + 1})")
    return found.filter(~below.rlike(PASSED_OVER)).select(
        "path", "length", F.timestamp_millis("modified_ms").alias("modified")
    )


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """As :func:`list_tree`, with ``modified_ms``."""
    wild, root = files._WILD.search(path), _root(path)
    if not files.exists(root):
        raise FileNotFoundError(path)
    tasks, levels = reading_tasks(spark), []
    folders = spark.createDataFrame([(root,)], "path string")
    while True:
        spread = folders.repartition(tasks, "path") if levels else folders
        level = store(spread.mapInArrow(_expand, _COLUMNS), "listing")
        levels.append(level.filter("length is not null"))
        folders = level.filter("length is null").select("path")
        if folders.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    if suffix:
        found = found.filter(F.col("path").endswith(suffix))
    if wild:
        found = found.mapInArrow(_matching(path), _COLUMNS)
    return found


def _root(path: str) -> str:
    """The folder that listing begins at."""
    wild = files._WILD.search(path)
    return path[: wild.start()].rsplit("/", 1)[0] or "/" if wild else path


def _matching(pattern: str):
    def run(batches):
        for batch in batches:
            keep = [fnmatch.fnmatch(p, pattern) for p in batch.column("path").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run

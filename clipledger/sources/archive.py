"""Files of an archive as tables: artifact scan, box index, payload ranges, content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.functions.arrow import batches, framing_fault
from clipledger.operators.artifacts import classify
from clipledger.operators.timeline import flag_complete
from clipledger.plans.scan import attach, chunk_of
from clipledger.session import reading_tasks
from clipledger.sources.files import known, open_file
from clipledger.sources.listing import list_visible

HASH_READ = 4 << 20
BOX_SCHEMA = (
    "path string, boxes array<struct<type: string, offset: bigint, size: bigint>>, "
    "data_start bigint, data_bound bigint"
)
_BOX_ARROW = pa.schema(
    [
        ("path", pa.string()),
        (
            "boxes",
            pa.list_(
                pa.struct([("type", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
            ),
        ),
        ("data_start", pa.int64()),
        ("data_bound", pa.int64()),
    ]
)
_HASH_ARROW = pa.schema([("path", pa.string()), ("sha256", pa.string())])
_FAULT_ARROW = pa.schema(
    [
        ("clip_id", pa.string()),
        ("seq", pa.int64()),
        ("frame_no", pa.int64()),
        ("fault", pa.string()),
    ]
)


def _file_path(column: str = "path"):
    return F.regexp_replace(column, r"^file:/+", "/")


def scan_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Every known file below ``root``: ``path, clip_key, kind, length, modified``.

    Only the file metadata is read, by the tasks that list the folders. Spark's own source lists
    stores that Arrow does not know; its content column is pruned away.
    """
    if known(root):
        files = list_visible(spark, root)
    else:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(root)
            .select(_file_path().alias("path"), "length", F.col("modificationTime").alias("modified"))
        )
    return (
        classify(files)
        .filter("kind is not null")
        .select("path", "clip_key", "kind", "length", "modified")
    )


def walk_boxes(path: str) -> dict:
    """Top-level boxes up to the media data, where that starts, and where valid data ends.

    Only headers are read. The declared end of the media box counts when it lies in the file; a
    file that was never finished has valid data up to its length.
    """
    boxes, start = [], None
    with open_file(path) as handle:
        length = handle.size()
        at, bound = 0, length
        while at + 8 <= length:
            handle.seek(at)
            head = handle.read(8)
            if len(head) < 8:
                break
            size, kind = int.from_bytes(head[:4], "big"), head[4:].decode("latin-1")
            if kind == "mdat":
                wide = size == 1
                start = at + (16 if wide else 8)
                if wide:
                    more = handle.read(8)
                    size = int.from_bytes(more, "big", signed=True) if len(more) == 8 else 0
                boxes.append({"type": kind, "offset": at, "size": size})
                if size > 0 and at + size <= length:
                    bound = at + size
                break
            if size < 8:
                break
            boxes.append({"type": kind, "offset": at, "size": size})
            at += size
    return {"path": path, "boxes": boxes, "data_start": start, "data_bound": bound}


def _spread(files: DataFrame, *by) -> DataFrame:
    """Share rows that stand for much reading over a fixed number of tasks.

    The rows are small, so without a fixed number AQE would put them all in one task.
    """
    return files.repartition(reading_tasks(files.sparkSession), *by)


def box_index(artifacts: DataFrame) -> DataFrame:
    """Box layout of each file: one small seek-only read per file, spread over the cluster."""

    def job(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (p for part in parts for p in part.column(0).to_pylist())
        return batches((walk_boxes(p) for p in paths), _BOX_ARROW)

    return _spread(artifacts.select("path"), "path").mapInArrow(job, BOX_SCHEMA)


def content_hash(files: DataFrame) -> DataFrame:
    """SHA-256 of each file, read in pieces, so a file may be larger than a cell can be.

    A file that cannot be read gets the empty string.
    """

    def digest(path: str) -> dict:
        found = hashlib.sha256()
        try:
            with open_file(path) as handle:
                while piece := handle.read(HASH_READ):
                    found.update(piece)
        except OSError:
            return {"path": path, "sha256": ""}
        return {"path": path, "sha256": found.hexdigest()}

    def job(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (p for part in parts for p in part.column(0).to_pylist())
        return batches((digest(p) for p in paths), _HASH_ARROW, 64)

    return _spread(files.select("path"), "path").mapInArrow(job, "path string, sha256 string")


def attach_payload(samples: DataFrame, boxes: DataFrame, files: DataFrame) -> DataFrame:
    """Byte range of each complete packet: ``path, offset, size`` in the clip's partial file.

    ``files`` has ``clip_id, path``; a file without media data gives no ranges.
    """
    placed = (
        files.select("clip_id", "path")
        .join(boxes.select("path", "data_start", "data_bound"), "path")
        .filter("data_start is not null")
    )
    complete = flag_complete(samples, placed).filter("is_complete").drop("is_complete")
    return attach(complete, placed.select("clip_id", "path"), ["clip_id"], chunk_of("seq"))


def audit_framing(ranges: DataFrame, split_rows: int = 4096) -> DataFrame:
    """Video packets whose length prefixes do not tile them exactly, as damaged frames.

    Packets are read where they lie, in file order, a few thousand per task group; only faults
    come back.
    """

    def faults(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, handle = None, None
        for part in parts:
            for row in part.to_pylist():
                if row["path"] != name:
                    if handle is not None:
                        handle.close()
                    name, handle = row["path"], open_file(row["path"])
                handle.seek(row["offset"])
                data = handle.read(row["size"])
                fault = "short read" if len(data) < row["size"] else framing_fault(data)
                if fault is not None:
                    yield {**{k: row[k] for k in ("clip_id", "seq", "frame_no")}, "fault": fault}
        if handle is not None:
            handle.close()

    def job(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(faults(parts), _FAULT_ARROW)

    video = ranges.filter("is_video").select("clip_id", "seq", "frame_no", "path", "offset", "size")
    spread = _spread(video, "path", chunk_of("seq", split_rows)).sortWithinPartitions(
        "path", "offset"
    )
    return spread.mapInArrow(job, "clip_id string, seq bigint, frame_no bigint, fault string")

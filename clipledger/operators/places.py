"""Frames compared where they lie: their places are joined, and pixels are read last.

A join of two runs on (clip, frame) would shuffle the pixels of both. Here only places travel: the
file and row of a frame in a Parquet table, or the path of a raw dump. Tasks then read the two
sides of their pairs, so a pixel goes from its file to the task that compares it and no further.
"""

from __future__ import annotations

import urllib.parse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions.arrow import plane_psnr
from clipledger.operators.frames import FRAME, GATE_DB, gate_verdict, pick_frames
from clipledger.plans.scan import idiv
from clipledger.session import reading_tasks
from clipledger.sources.files import open_file
from clipledger.sources.rawframes import frame_bytes

# Rows of a table that stay together, and pairs whose pixels a task holds at once.
UNIT_ROWS = 256
HELD_PAIRS = 16


def frame_places(frames: DataFrame) -> DataFrame:
    """``clip_id, frame_no, file, row`` of a table of frames read from Parquet; no pixel is read."""
    return frames.select(
        *FRAME, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )


class _Rows:
    """Values of one column by file and row; the row group read last is kept."""

    def __init__(self, column: str) -> None:
        self.column, self.path, self.file, self.group, self.held = column, None, None, None, None

    def __call__(self, path: str, row: int):
        if path != self.path:
            # Spark gives the path as an address.
            self.file = pq.ParquetFile(open_file(urllib.parse.unquote(path)))
            meta = self.file.metadata
            sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
            self.path, self.group, self.begins = path, None, np.concatenate([[0], np.cumsum(sizes)])
        group = int(np.searchsorted(self.begins, row, "right")) - 1
        if group != self.group:
            self.held = self.file.read_row_group(group, columns=[self.column]).column(0)
            self.group = group
        return self.held[row - int(self.begins[group])].as_py()


_CLIP = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _compared(kind: str):
    return pa.schema([("clip_id", _CLIP[kind]), ("frame_no", pa.int64()), ("psnr", pa.float64())])


def _psnr_of_places(pairs: DataFrame, column: str) -> DataFrame:
    """``clip_id, frame_no, psnr`` of pairs of places; a place without a row gives no value."""
    kind = dict(pairs.dtypes)["clip_id"]
    schema = _compared(kind)

    def run(batches):
        one, two = _Rows(column), _Rows(column)
        for batch in batches:
            rows = batch.to_pylist()
            for begin in range(0, len(rows), HELD_PAIRS):
                held = rows[begin : begin + HELD_PAIRS]
                # Each side is read in the order of its own file.
                pixels = []
                for read, file, row in ((one, "file_a", "row_a"), (two, "file_b", "row_b")):
                    order = sorted((i for i, r in enumerate(held) if r[file] is not None), key=lambda i: (held[i][file], held[i][row]))
                    pixels.append({i: read(held[i][file], held[i][row]) for i in order})
                values = [plane_psnr(pixels[0].get(i), pixels[1].get(i)) for i in range(len(held))]
                columns = [[r["clip_id"] for r in held], [r["frame_no"] for r in held], values]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    unit = idiv("row_a", F.lit(UNIT_ROWS).cast("bigint"))
    near = pairs.repartition(reading_tasks(pairs.sparkSession), F.col("file_a"), unit)
    return near.sortWithinPartitions("file_a", "row_a").mapInArrow(run, f"clip_id {kind}, frame_no bigint, psnr double")


def _side(frames: DataFrame, name: str) -> DataFrame:
    return frame_places(frames).withColumnsRenamed({"file": f"file_{name}", "row": f"row_{name}"})


def compare_places(a: DataFrame, b: DataFrame, column: str = "planes") -> DataFrame:
    """PSNR of every common frame of two runs: the rows of ``compare_runs``, without a shuffle of pixels.

    ``a`` and ``b`` are tables read from Parquet, with 16-bit planes in ``column``.
    """
    return _psnr_of_places(_side(a, "a").join(_side(b, "b"), FRAME), column)


def gate_places(
    a: DataFrame, b: DataFrame, clips: DataFrame, min_db: float = GATE_DB, column: str = "planes"
) -> DataFrame:
    """The rows of ``gate`` for two runs read from Parquet: only row groups with a picked frame are read."""
    picks = pick_frames(clips)
    pairs = picks.join(_side(a, "a"), FRAME, "left").join(_side(b, "b"), FRAME, "left")
    return gate_verdict(_psnr_of_places(pairs, column), clips, min_db)


def gate_files(
    dumps: DataFrame, clips: DataFrame, width: int, height: int, layout: str = "rgb16", min_db: float = GATE_DB
) -> DataFrame:
    """The rows of ``gate`` for raw dumps (``clip_id, path_a, path_b``): three frames of each are read.

    A clip without dumps, or with a frame that a dump does not hold in full, is not gated.
    """
    size = frame_bytes(width, height, layout)
    picks = pick_frames(clips).join(dumps.select("clip_id", "path_a", "path_b"), "clip_id", "left")
    kind = dict(picks.dtypes)["clip_id"]
    schema = _compared(kind)

    def read(path: str | None, frame: int) -> bytes | None:
        if path is None:
            return None
        with open_file(path) as handle:
            if (frame + 1) * size > handle.size():
                return None
            handle.seek(frame * size)
            return handle.read(size)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            values = [plane_psnr(*(read(r[p], r["frame_no"]) for p in ("path_a", "path_b"))) for r in rows]
            columns = [[r["clip_id"] for r in rows], [r["frame_no"] for r in rows], values]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    asked = picks.select("clip_id", "frame_no", "path_a", "path_b").repartition(reading_tasks(picks.sparkSession), *FRAME)
    return gate_verdict(asked.mapInArrow(run, f"clip_id {kind}, frame_no bigint, psnr double"), clips, min_db)

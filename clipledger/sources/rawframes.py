"""Fixed-size raw frames: planar 16-bit RGB, or 10-bit 4:2:0 dumps."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from clipledger.schemas import FRAMES
from clipledger.session import reading_tasks
from clipledger.sources.files import list_files, open_file
from clipledger.sources.listing import list_tree

SPLIT_BYTES = 128 << 20
BATCH_BYTES = 8 << 20


def frame_bytes(width: int, height: int, layout: str) -> int:
    """Bytes of one frame; chroma planes of odd sizes are rounded up."""
    if layout == "rgb16":
        return width * height * 6
    if layout == "yuv420p10":
        chroma = ((width + 1) // 2) * ((height + 1) // 2)
        return (width * height + 2 * chroma) * 2
    raise ValueError(f"unknown layout {layout!r}")


@dataclass
class FrameSplit(InputPartition):
    """Frame ranges ``(path, first, count)`` that one task reads."""

    ranges: list[tuple[str, int, int]] = field(default_factory=list)


def split_frames(files: list[tuple[str, int, int]], step: int) -> list[FrameSplit]:
    """Cut ``(path, low, high)`` into splits of ``step`` frames; short files share a split."""
    splits, current, room = [], [], step
    for path, at, end in files:
        while at < end:
            take = min(end - at, room)
            current.append((path, at, take))
            at, room = at + take, room - take
            if room == 0:
                splits.append(FrameSplit(current))
                current, room = [], step
    if current or not splits:
        splits.append(FrameSplit(current))
    return splits


class RawFrameSource(DataSource):
    """``format("rawframes")`` with options ``width``, ``height``, ``layout``, ``suffix``.

    ``minFrame`` and ``maxFrame`` (exclusive) cut the scan before any byte is read, and so do
    filters that compare ``frame_no`` with a number.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return RawFrameReader(self.options)


class RawFrameReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.width, self.height = int(options["width"]), int(options["height"])
        self.size = frame_bytes(self.width, self.height, options.get("layout", "rgb16"))
        self.suffix = options.get("suffix", "")
        self.low = int(options.get("minFrame", "0"))
        high = options.get("maxFrame")
        self.high = None if high is None else int(high)

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_no",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo):
                    self._narrow(f.value, f.value + 1)
                    continue
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._narrow(f.value + isinstance(f, GreaterThan), None)
                    continue
                if isinstance(f, (LessThan, LessThanOrEqual)):
                    self._narrow(0, f.value + isinstance(f, LessThanOrEqual))
                    continue
            yield f

    def _narrow(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)

    def partitions(self):
        step = max(SPLIT_BYTES // self.size, 1)
        files = []
        for path, length in list_files(self.path, self.suffix):
            total = length // self.size
            files.append((path, self.low, total if self.high is None else min(total, self.high)))
        return split_frames(files, step)

    def read(self, partition):
        per_batch = max(BATCH_BYTES // self.size, 1)
        for path, first, count in partition.ranges:
            with open_file(path) as handle:
                handle.seek(first * self.size)
                for at in range(first, first + count, per_batch):
                    numbers = range(at, min(at + per_batch, first + count))
                    yield self._batch(path, numbers, [handle.read(self.size) for _ in numbers])

    def _batch(self, path: str, numbers: range, planes: list[bytes]) -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([path] * n),
                pa.array(numbers, pa.int64()),
                pa.array([self.width] * n, pa.int32()),
                pa.array([self.height] * n, pa.int32()),
                pa.array(planes, pa.binary()),
            ],
            names=["clip_id", "frame_no", "width", "height", "planes"],
        )


def register(spark: SparkSession) -> None:
    # Without it Spark refuses readers that take filters.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawFrameSource)


def scan_frames(
    spark: SparkSession,
    path: str,
    width: int,
    height: int,
    layout: str = "rgb16",
    suffix: str = "",
    frames: tuple[int, int | None] = (0, None),
) -> DataFrame:
    """The rows of ``format("rawframes")``, with the files listed and cut into ranges by tasks.

    ``frames``: first frame and the one after the last; null for all.
    """
    options = {"path": path, "width": str(width), "height": str(height), "layout": layout}
    reader = RawFrameReader(options)
    step = max(SPLIT_BYTES // reader.size, 1)
    whole = F.col("length").cast("bigint")
    total = F.call_function("div", whole, F.lit(reader.size).cast("bigint"))
    if frames[1] is not None:
        total = F.least(total, F.lit(frames[1]).cast("bigint"))
    low = F.lit(frames[0]).cast("bigint")
    files = list_tree(spark, path, suffix).select("path", total.alias("total")).filter(F.col("total") > low)
    begins = files.withColumn("begin", F.explode(F.sequence(low, F.col("total") - 1, F.lit(step).cast("bigint"))))
    ranges = begins.select("path", "begin", F.least(F.lit(step), F.col("total") - F.col("begin")).alias("frames"))

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("path", "begin", "frames")))
            for one in rows:
                yield from reader.read(FrameSplit([one]))

    return ranges.repartition(reading_tasks(spark), "path", "begin").mapInArrow(run, FRAMES)

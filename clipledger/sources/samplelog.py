"""The binary sample log: batch scan, growing-log stream, and sink.

A log is an 8-byte header and records of 33 bytes, so any range of records can be read or written
on its own. A scan is split by record range, and the sink writes each record at its own position:
neither needs a clip to sit in one task.
"""

from __future__ import annotations

import json
import os
import random
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from clipledger.schemas import SAMPLES
from clipledger.sources.files import list_files, open_file, resolve, settle

# Fixed values of the format.
MAGIC = 0x4E524153
VERSION = 2
HEADER = np.array([MAGIC, VERSION], "<u4").tobytes()
RECORD = np.dtype(
    [("flags", "u1"), ("size", "<i8"), ("pts", "<i8"), ("dts", "<i8"), ("frame_no", "<i8")]
)
SUFFIX = ".samples"

SPLIT_RECORDS = 1 << 21
BATCH_RECORDS = 1 << 16
OPEN_LOGS = 256


@dataclass(frozen=True)
class LogRange:
    path: str
    start: int
    count: int


@dataclass
class LogSplit(InputPartition):
    ranges: list[LogRange] = field(default_factory=list)


def records_in(length: int) -> int:
    """Whole records of a file; a half-written last one is the end of the log."""
    return max(length - len(HEADER), 0) // RECORD.itemsize


def split_ranges(ranges: list[LogRange], size: int = SPLIT_RECORDS) -> list[LogSplit]:
    """Cut long logs and pack short ones, so that splits are of about the same size."""
    splits, current, room = [], [], size
    for whole in ranges:
        at, left = whole.start, whole.count
        while True:
            take = min(left, room)
            current.append(LogRange(whole.path, at, take))
            at, left, room = at + take, left - take, room - max(take, 1)
            if room <= 0:
                splits.append(LogSplit(current))
                current, room = [], size
            if left <= 0:
                break
    if current:
        splits.append(LogSplit(current))
    return splits


def clip_of(path: str, by_name: bool) -> str:
    bare = path.removesuffix(SUFFIX)
    return urllib.parse.unquote(bare.rsplit("/", 1)[-1]) if by_name else bare


def read_ranges(split: LogSplit, by_name: bool) -> Iterator[pa.RecordBatch]:
    for part in split.ranges:
        with open_file(part.path) as handle:
            if handle.read(len(HEADER)) != HEADER:
                raise ValueError(f"{part.path} is not a sample log of version {VERSION}")
            handle.seek(len(HEADER) + part.start * RECORD.itemsize)
            at, end = part.start, part.start + part.count
            clip = clip_of(part.path, by_name)
            while at < end:
                raw = handle.read(min(BATCH_RECORDS, end - at) * RECORD.itemsize)
                rows = np.frombuffer(raw, RECORD, count=len(raw) // RECORD.itemsize)
                if not len(rows):
                    break
                yield _to_batch(rows, clip, at)
                at += len(rows)


def _to_batch(rows: np.ndarray, clip: str, first: int) -> pa.RecordBatch:
    n = len(rows)
    columns = {
        "clip_id": pa.array([clip], pa.string()).take(pa.array(np.zeros(n, "i4"))),
        "seq": pa.array(np.arange(first, first + n, dtype="i8")),
        "is_video": pa.array((rows["flags"] & 1) != 0),
        **{c: pa.array(np.ascontiguousarray(rows[c])) for c in ("size", "pts", "dts")},
        "is_key": pa.array((rows["flags"] & 2) != 0),
        "frame_no": pa.array(np.ascontiguousarray(rows["frame_no"])),
    }
    return pa.RecordBatch.from_pydict(columns)


class SampleLogSource(DataSource):
    """``format("samplelog")``. Option ``clipId``: ``path`` (default) or ``name``."""

    @classmethod
    def name(cls) -> str:
        return "samplelog"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema):
        return SampleLogReader(self.options)

    def streamReader(self, schema):
        return SampleLogStreamReader(self.options)

    def writer(self, schema, overwrite):
        return SampleLogWriter(self.options["path"], overwrite)


class SampleLogReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.by_name = options.get("clipId", "path") == "name"

    def partitions(self):
        files = list_files(self.path, SUFFIX)
        splits = split_ranges([LogRange(p, 0, records_in(n)) for p, n in files])
        return splits or [LogSplit([])]

    def read(self, partition):
        return read_ranges(partition, self.by_name)


class SampleLogStreamReader(DataSourceStreamReader):
    """Records appended to logs, each once. The offset is the number of whole records per file."""

    def __init__(self, options):
        self.path = options["path"]
        self.by_name = options.get("clipId", "path") == "name"

    def initialOffset(self):
        return {"logs": "{}"}

    def latestOffset(self):
        logs = {p: records_in(n) for p, n in list_files(self.path, SUFFIX)}
        return {"logs": json.dumps(logs, sort_keys=True)}

    def partitions(self, start, end):
        before, after = json.loads(start["logs"]), json.loads(end["logs"])
        grown = [
            LogRange(path, before.get(path, 0), count - before.get(path, 0))
            for path, count in after.items()
            if count > before.get(path, 0)
        ]
        return split_ranges(grown)

    def read(self, partition):
        return read_ranges(partition, self.by_name)

    def commit(self, end):
        pass


@dataclass
class LogWritten(WriterCommitMessage):
    counts: dict[str, tuple[int, ...]] = field(default_factory=dict)


# A prime below 2 ** 31, so that products of remainders fit 64 bits.
PRIME = (1 << 31) - 1


@lru_cache(maxsize=8)
def _powers(base: int) -> np.ndarray:
    """The first 65,536 powers of a base, made once for all clips of a task."""
    small = np.ones(1, np.uint64)
    while len(small) < 1 << 16:
        small = np.concatenate([small, small * np.uint64(pow(base, len(small), PRIME)) % np.uint64(PRIME)])
    return small


def _numbering(seq: np.ndarray, bases: tuple[int, ...]) -> tuple[int, ...]:
    """Count of positions, the sums of their first three powers, and sums of powers of ``bases``.

    With random bases they tell 0..n-1 from what repeats or leaves out positions, without a list.
    """
    chances = []
    for base in bases:
        high, at = np.unique(seq >> 16, return_inverse=True)
        step = pow(base, 1 << 16, PRIME)
        wide = np.array([pow(step, int(h), PRIME) for h in high], np.uint64)
        powers = _powers(base)[seq & 0xFFFF] * wide[at] % np.uint64(PRIME)
        chances.append(int(powers.sum()))
    low = int(seq.min())
    near = (seq - low).astype(object) if len(seq) > 1 << 16 or seq.max() - low > 1 << 15 else seq - low
    n, a, b, c = len(seq), int(near.sum()), int((near**2).sum()), int((near**3).sum())
    return (n, *chances, a + n * low, b + 2 * low * a + n * low**2, c + 3 * low * b + 3 * low**2 * a + n * low**3)


def _added(one: tuple[int, ...] | None, two: tuple[int, ...]) -> tuple[int, ...]:
    return two if one is None else tuple(x + y for x, y in zip(one, two, strict=True))


class SampleLogWriter(DataSourceArrowWriter):
    """One log per clip below a folder that driver and executors share.

    ``seq`` must number the records of a clip from 0 without gaps. Records go straight to their
    place in a staged file, whatever task they come from, and a repeated task writes the same
    bytes again. A log appears under its name only when all of its records are there.
    :func:`write_logs` orders the rows first, so that the writes are long ones.
    """

    def __init__(self, path: str, overwrite: bool):
        system, self.root = resolve(path)
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError("records are written in place: give a mounted folder, not a store")
        self.overwrite = overwrite
        self.bases = tuple(random.SystemRandom().randrange(1 << 16, PRIME - 1) for _ in range(2))
        self.stage = f"{self.root}/_staged-{uuid.uuid4().hex}"
        os.makedirs(self.stage, exist_ok=True)

    def _staged(self, clip: str) -> str:
        return f"{self.stage}/{urllib.parse.quote(clip, safe='')}{SUFFIX}"

    def write(self, iterator):
        counts: dict[str, tuple[int, ...]] = {}
        handles: dict[str, int] = {}
        try:
            for batch in iterator:
                frame = batch.to_pandas().sort_values(["clip_id", "seq"])
                for clip, rows in frame.groupby("clip_id", sort=False):
                    self._write_rows(self._handle(handles, clip), rows)
                    counts[clip] = _added(counts.get(clip), _numbering(rows["seq"].to_numpy(), self.bases))
        finally:
            settle(list(handles.values()))
        return LogWritten(counts)

    def _handle(self, handles: dict[str, int], clip: str) -> int:
        if clip not in handles:
            if len(handles) >= OPEN_LOGS:
                full = list(handles.values())
                handles.clear()
                settle(full)
            handles[clip] = os.open(self._staged(clip), os.O_CREAT | os.O_WRONLY)
            os.pwrite(handles[clip], HEADER, 0)
        return handles[clip]

    @staticmethod
    def _write_rows(handle: int, rows) -> None:
        out = np.empty(len(rows), RECORD)
        out["flags"] = rows["is_video"].to_numpy() * 1 + rows["is_key"].to_numpy() * 2
        for column in ("size", "pts", "dts", "frame_no"):
            out[column] = rows[column].to_numpy()
        seq = rows["seq"].to_numpy()
        for run in np.split(np.arange(len(seq)), np.flatnonzero(np.diff(seq) != 1) + 1):
            place = len(HEADER) + int(seq[run[0]]) * RECORD.itemsize
            os.pwrite(handle, out[run[0] : run[-1] + 1].tobytes(), place)

    def commit(self, messages):
        totals: dict[str, tuple[int, ...]] = {}
        for message in messages:
            for clip, found in (message.counts if message else {}).items():
                totals[clip] = _added(totals.get(clip), found)
        for clip, (n, *sums) in totals.items():
            ones = [(pow(b, n, PRIME) - 1) * pow(b - 1, -1, PRIME) % PRIME for b in self.bases]
            powers = [n * (n - 1) // 2, (n - 1) * n * (2 * n - 1) // 6, (n * (n - 1) // 2) ** 2]
            k = len(ones)
            if [s % PRIME for s in sums[:k]] != ones or sums[k:] != powers:
                raise ValueError(f"records of {clip} are not numbered 0..{n - 1}")
            target = f"{self.root}/{os.path.basename(self._staged(clip))}"
            if os.path.exists(target) and not self.overwrite:
                raise FileExistsError(target)
        for clip in totals:
            staged = self._staged(clip)
            os.replace(staged, f"{self.root}/{os.path.basename(staged)}")
        os.rmdir(self.stage)
        if self.overwrite:
            written = {os.path.basename(self._staged(clip)) for clip in totals}
            for name in os.listdir(self.root):
                if name.endswith(SUFFIX) and name not in written:
                    os.unlink(f"{self.root}/{name}")

    def abort(self, messages):
        for name in os.listdir(self.stage):
            os.unlink(f"{self.stage}/{name}")
        os.rmdir(self.stage)


def write_logs(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write a log table as log files. Rows are ranged by (clip, seq): a large clip is split."""
    register(samples.sparkSession)
    (
        samples.repartitionByRange("clip_id", "seq")
        .sortWithinPartitions("clip_id", "seq")
        .write.format("samplelog")
        .mode(mode)
        .save(path)
    )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SampleLogSource)

"""Sample logs kept as parts and a manifest: a sink for stores that have neither places nor renames.

A task writes the rows it holds as parts, whole objects, and a list of them. Which parts make up the
logs is said by manifests, and one small file that the driver writes last names the manifests in
force: until then nothing of a write is seen, and what a task that was lost has left is never read.
A log of any size is as many parts as tasks held of it, so none of them sees the whole log.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger.schemas import SAMPLES
from clipledger.session import reading_tasks, store
from clipledger.sources import files, samplelog

# The file that names the manifests in force, oldest first.
CURRENT = "_current"
PART_RECORDS = 1 << 20
PARTS = "clip_id string, begin bigint, records bigint, part string"
_PARTS = pa.schema([("clip_id", pa.string()), ("begin", pa.int64()), ("records", pa.int64()), ("part", pa.string())])


def _write(path: str, *pieces: bytes) -> None:
    system, inner = files.resolve(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as out:
        for piece in pieces:
            out.write(piece)


def _records(rows: pa.Table) -> bytes:
    out = np.empty(rows.num_rows, samplelog.RECORD)
    flags = [rows[c].to_numpy().astype(np.uint8) for c in ("is_video", "is_key")]
    out["flags"] = flags[0] + 2 * flags[1]
    for column in ("size", "pts", "dts", "frame_no"):
        out[column] = rows[column].to_numpy()
    return out.tobytes()


def _write_parts(folder: str):
    """Parts of the rows of a task, which come by clip and seq; a row for each."""

    def run(batches):
        held, count = [], 0
        attempt = uuid.uuid4().hex

        def flush():
            table = pa.Table.from_batches(held)
            clip, seq = table["clip_id"].to_pylist(), table["seq"].to_numpy()
            cuts = [i for i in range(1, len(clip)) if clip[i] != clip[i - 1] or seq[i] != seq[i - 1] + 1]
            out = []
            for begin, end in zip([0, *cuts], [*cuts, len(clip)]):
                name = f"{urllib.parse.quote(clip[begin], safe='')}/{seq[begin]:019d}-{attempt}.part"
                _write(f"{folder}/{name}", samplelog.HEADER, _records(table.slice(begin, end - begin)))
                out.append((clip[begin], int(seq[begin]), end - begin, f"{folder}/{name}"))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PARTS.types)], schema=_PARTS)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= PART_RECORDS:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return run


def _write_manifest(folder: str):
    def run(batches):
        rows = pa.Table.from_batches(batches, schema=_PARTS)
        path = f"{folder}/{uuid.uuid4().hex}.parquet"
        if rows.num_rows:
            sink = pa.BufferOutputStream()
            pq.write_table(rows, sink)
            _write(path, sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array([path] * bool(rows.num_rows), pa.string())], names=["path"])

    return run


def _current(path: str) -> list[str]:
    if not files.exists(f"{path}/{CURRENT}"):
        return []
    with files.open_file(f"{path}/{CURRENT}") as handle:
        return json.loads(handle.read())


def _read_manifests(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with files.open_file(path) as handle:
                yield from pq.read_table(handle).cast(_PARTS).to_batches()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts of the logs in force: ``clip_id, begin, records, part``."""
    named = spark.createDataFrame([(p,) for p in _current(path)], "path string")
    # A manifest lists the files that tasks wrote; their number follows the tasks, not the logs.
    lists = named.mapInArrow(_read_lists, "path string")
    return lists.repartition(reading_tasks(spark), "path").mapInArrow(_read_manifests, PARTS)


def _read_lists(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with files.open_file(path) as handle:
                names = json.loads(handle.read())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])


def write_log_parts(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write a log table below ``path``, on any file system Arrow knows.

    ``seq`` must number the records of a clip from 0 without gaps; ``append`` refuses clips that are
    there, ``overwrite`` puts the new logs in the place of all others. Rows are ranged by (clip, seq), so a large
    clip is split. The driver writes two small files, the list of the manifests of this write and, last, CURRENT.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, name = samples.sparkSession, uuid.uuid4().hex
    path = path.rstrip("/")
    columns = [c.split()[0] for c in SAMPLES.split(", ")]
    rows = samples.select(F.col("clip_id").cast("string").alias("clip_id"), *columns[1:])
    ranged = rows.repartitionByRange("clip_id", "seq").sortWithinPartitions("clip_id", "seq")
    parts = store(ranged.mapInArrow(_write_parts(f"{path}/_parts/{name}"), PARTS), "parts")
    # A few rows for each clip: as many as tasks held of it.
    line = Window.partitionBy("clip_id").orderBy("begin", "part")
    due = F.coalesce(F.lag(F.col("begin") + F.col("records")).over(line), F.lit(0).cast("bigint"))
    wrong = parts.withColumn("due", due).filter("begin <> due").select("clip_id", "due").first()
    if wrong:
        raise ValueError(f"records of {wrong.clip_id} are not numbered without gaps: {wrong.due} is due")
    before = _current(path) if mode == "append" else []
    if before:
        there = manifest(spark, path).select("clip_id").distinct().join(parts.select("clip_id"), "clip_id", "left_semi").first()
        if there:
            raise FileExistsError(f"{path}: {there.clip_id}")
    manifests = parts.mapInArrow(_write_manifest(f"{path}/_manifest/{name}"), "path string")
    listed = [r.path for r in store(manifests, "manifests").collect()]
    _write(f"{path}/_manifest/{name}.json", json.dumps(listed).encode())
    _write(f"{path}/{CURRENT}", json.dumps([*before, f"{path}/_manifest/{name}.json"]).encode())


def _read_parts(batches):
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("clip_id", "begin", "records", "part")))
        for clip, begin, records, part in rows:
            split = samplelog.LogSplit([samplelog.LogRange(part, 0, records)])
            for found in samplelog.read_ranges(split, False):
                seq = pa.compute.add(found.column("seq"), begin)
                own = pa.array([clip], pa.string()).take(pa.array(np.zeros(found.num_rows, "i4")))
                columns = [own, seq, *(found.column(i) for i in range(2, found.num_columns))]
                yield pa.RecordBatch.from_arrays(columns, names=found.schema.names)


def read_log_parts(spark: SparkSession, path: str) -> DataFrame:
    """The log table that :func:`write_log_parts` has written; no logs are no rows."""
    parts = manifest(spark, path.rstrip("/"))
    return parts.repartition(reading_tasks(spark), "clip_id", "begin").mapInArrow(_read_parts, SAMPLES)


def join_logs(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Each log as one ``.samples`` file below ``target``: ``path, records``.

    For readers that want whole files: a task joins the parts of a log into one object, streaming.
    """
    parts = manifest(spark, path.rstrip("/"))
    target = target.rstrip("/")
    by_clip = parts.repartition("clip_id").sortWithinPartitions("clip_id", "begin")
    return store(by_clip.mapInArrow(_join(target), "path string, records bigint"), "joined")


def _join(target: str):
    def run(batches):
        out, open_clip, records, done = None, None, 0, []

        def close():
            out.close()
            done.append((f"{target}/{urllib.parse.quote(open_clip, safe='')}{samplelog.SUFFIX}", records))

        for batch in batches:
            for clip, part in zip(batch.column("clip_id").to_pylist(), batch.column("part").to_pylist()):
                if clip != open_clip:
                    if out is not None:
                        close()
                    system, inner = files.resolve(target)
                    system.create_dir(inner, recursive=True)
                    name = f"{inner}/{urllib.parse.quote(clip, safe='')}{samplelog.SUFFIX}"
                    out, open_clip, records = system.open_output_stream(name), clip, 0
                    out.write(samplelog.HEADER)
                with files.open_file(part) as handle:
                    handle.seek(len(samplelog.HEADER))
                    while raw := handle.read(1 << 20):
                        out.write(raw)
                        records += len(raw) // samplelog.RECORD.itemsize
        if out is not None:
            close()
        paths, counts = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return run

"""Streams whose answer depends on all earlier rows of a clip, on Spark's keyed state.

A clip may hold a third of a stream, and there may be millions of clips with a few rows each. So rows
are not dealt by clip one by one: tasks first pack what they read into one row per group of clips,
or into runs of numbers; only these meet in the state of the group. What chunks of a clip need from
before is put beside them, for all chunks of a group at once, and the rows come out
after these have been spread again. State is Spark's own (RocksDB): a batch
writes the state of its clips only, a repeated batch starts from the version before, and old
versions are removed by Spark. What a task holds of one clip is its part of one batch; bound that
with the limits of the source (``maxRecordsPerBatch``, ``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from clipledger.operators.artifacts import classify
from clipledger.session import scratch_path
from clipledger.sources.files import exists

# Settings a query is started with and keeps: state in RocksDB, of which a batch writes its changes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Rows of a clip in one chunk.
PACK_ROWS = 1 << 16


class KeyedStream:
    """A streaming plan with keyed state, and the table its output is written to."""

    def __init__(
        self, spark: SparkSession, plan: Callable[[DataFrame], DataFrame], output: str, folder: str | None = None
    ):
        self.spark, self.plan, self.output_schema = spark, plan, output
        self.folder = folder or scratch_path(spark, "keyed")

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/output/batch={batch_id}")

    def start(self, stream: DataFrame, **trigger):
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in STATE}
        for key, value in STATE.items():
            conf.set(key, value)
        try:
            return (
                self.plan(stream)
                .writeStream.foreachBatch(self._write)
                .outputMode("append")
                .option("checkpointLocation", f"{self.folder}/progress")
                .trigger(**(trigger or {"availableNow": True}))
                .start()
            )
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)

    def drain(self, stream: DataFrame) -> DataFrame:
        """Process all there is, then return the whole output."""
        self.start(stream).awaitTermination()
        return self.result()

    def result(self) -> DataFrame:
        if not exists(f"{self.folder}/output"):
            return self.spark.createDataFrame([], self.output_schema)
        rows = self.spark.read.schema(f"{self.output_schema}, batch bigint").parquet(f"{self.folder}/output")
        return rows.drop("batch")


# --- chunks of a clip ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Carried:
    """What a chunk tells later ones, and what it gives once it knows what came before.

    The functions take many chunks at once: a table whose rows lie together by chunk and in order, and
    for each row the number of its chunk. ``reduce(table, chunk)`` gives the facts of the chunks that
    have rows; ``how`` says for each fact whether chunks add up (``sum``) or the highest counts (``max``, -1 if
    none). ``expand(table, chunk, before)`` makes output rows and tells the chunk of each; ``before`` has
    an array per fact so far and ``first``, true for the first chunk of a clip. ``shrink`` tells the
    rows that either needs.
    """

    order: str
    how: dict[str, str]
    reduce: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]]
    expand: Callable[[pa.Table, np.ndarray, dict], tuple[pa.Table, np.ndarray]]
    shrink: Callable[[pa.Table, np.ndarray], np.ndarray] | None = None


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    codes = column.combine_chunks().dictionary_encode()
    return (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)


def _begins(codes: np.ndarray) -> np.ndarray:
    """Where the stretches of equal values begin."""
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)


def _spans(column: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Begin and end of the stretches of equal values."""
    begins = _begins(_codes(column)).tolist() if len(column) else []
    return list(zip(begins, [*begins[1:], len(column)]))


def _sum_by(values: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each chunk."""
    total, begins = np.cumsum(values), _begins(chunk)
    lengths = np.diff(np.append(begins, len(chunk)))
    return total - np.repeat(total[begins] - values[begins], lengths)


def _high_by(values: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Running highest values that begin anew with each chunk."""
    return pd.Series(values).groupby(chunk, sort=False).cummax().to_numpy()


def _high_before(values: np.ndarray, chunk: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The highest value before each row in its chunk, ``least`` of the chunk at least."""
    high = np.append(np.int64(-(1 << 62)), _high_by(values, chunk)[:-1]) if len(values) else values
    high[_begins(chunk)] = -(1 << 62)
    return np.maximum(high, least)


# Groups of clips that have their state under one key, each clip a row of its own in it. Must stay the same.
BUCKETS = 1024
# Rows that a task holds before it sends them, one row per group; and rows that go on together at least.
SENT_ROWS, MERGED_ROWS = 1 << 18, 1 << 15


def _packer(carried: Carried, pack_rows: int):
    """One row per group of clips from many: the facts of its chunks, and their rows."""

    def flush(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        table = table.filter(pc.and_(table["clip_id"].is_valid(), table[carried.order].is_valid()))
        if not table.num_rows:
            return
        keys = [("bucket", "ascending"), ("clip_id", "ascending"), (carried.order, "ascending")]
        table = table.sort_by(keys).combine_chunks()
        n, clips = table.num_rows, _begins(_codes(table["clip_id"]))
        place = np.arange(n) - np.repeat(clips, np.diff(np.append(clips, n)))
        begins = np.flatnonzero(place % pack_rows == 0)
        lengths = np.diff(np.append(begins, n))
        chunk = np.repeat(np.arange(len(begins)), lengths)
        order, first = _numbers(table, carried.order), pa.array(begins)
        facts = {
            "clip_id": table["clip_id"].take(first),
            "begins": pa.array(order[begins]),
            "ends": pa.array(order[begins + lengths - 1]),
            **{k: pa.array(v, pa.int64()) for k, v in carried.reduce(table, chunk).items()},
        }
        facts, buckets = pa.table(facts), _numbers(table, "bucket")[begins]
        rows = table.drop_columns(["clip_id", "bucket"])
        if carried.shrink is not None:
            stay = carried.shrink(table, chunk)
            rows, chunk = rows.filter(pa.array(stay)), chunk[stay]
        cuts = np.append(_begins(buckets), len(buckets))
        ends = np.searchsorted(chunk, cuts)
        out = {"facts": [], "rows": []}
        for low, high, begin, end in zip(cuts[:-1], cuts[1:], ends[:-1], ends[1:]):
            own = rows.slice(begin, end - begin).append_column("_c", pa.array(chunk[begin:end] - low, pa.int64()))
            out["facts"].append(_to_bytes(facts.slice(low, high - low)))
            out["rows"].append(_to_bytes(own))
        columns = [pa.array(buckets[cuts[:-1]], pa.int32()), *[pa.array(v, pa.binary()) for v in out.values()]]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *out])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SENT_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return run


class _Carry(StatefulProcessor):
    """Gives each chunk of a clip what the earlier ones add up to, for a group of clips at once."""

    def __init__(self, carried: Carried, clip_type: str) -> None:
        self.carried, self.clip_type = carried, clip_type

    def init(self, handle) -> None:
        facts = ", ".join(f"{name} bigint" for name in self.carried.how)
        self.state = handle.getMapState("carried", f"clip_id {self.clip_type}", f"last bigint, {facts}")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        facts = [_from_bytes(raw) for raw in frame["facts"]]
        parts = list(frame["rows"])
        chunks = pa.concat_tables(facts).to_pandas()
        chunks["part"] = np.repeat(np.arange(len(facts)), [f.num_rows for f in facts])
        chunks["_c"] = np.concatenate([np.arange(f.num_rows) for f in facts])
        chunks, parts = self._apart(chunks.sort_values(["clip_id", "begins", "ends"], ignore_index=True), parts)
        clip = _codes(pa.chunked_array([pa.array(chunks["clip_id"])]))
        heads = _begins(clip)
        tails = np.append(heads[1:], len(clip)) - 1
        names = chunks["clip_id"].to_numpy()[heads].tolist()
        known = [self.state.getValue((name,)) for name in names] if self.state.exists() else [None] * len(names)
        for name, begins, before in zip(names, chunks["begins"].to_numpy()[heads].tolist(), known):
            if before is not None and begins <= before[0]:
                raise ValueError(f"{self.carried.order} {begins} of clip {name} comes after {before[0]}")
        lengths = tails - heads + 1
        first = np.zeros(len(clip), bool)
        first[heads] = [before is None for before in known]
        after = [chunks["ends"].to_numpy()[tails]]
        for i, (fact, kind) in enumerate(self.carried.how.items()):
            start = np.array([(0 if kind == "sum" else -1) if b is None else b[i + 1] for b in known], np.int64)
            value, start = chunks[fact].to_numpy(), np.repeat(start, lengths)
            if kind == "sum":
                through = _sum_by(value, clip) + start
                chunks[fact] = through - value
            else:
                chunks[fact] = _high_before(value, clip, start)
                through = np.maximum(chunks[fact].to_numpy(), value)
            after.append(through[tails])
        for name, *values in zip(names, *(a.tolist() for a in after)):
            self.state.updateValue((name,), tuple(values))
        chunks["first"] = first
        yield from self._sent(key[0], chunks[["part", "_c", "clip_id", "first", *self.carried.how]], parts)

    def _sent(self, bucket: int, chunks: pd.DataFrame, parts: list):
        """The parts of a group, small ones put together; a part tells what came before its chunks."""
        befores, tables, rows, shift, sent = [], [], 0, 0, 0
        chunks = chunks.sort_values(["part", "_c"], ignore_index=True)
        cuts = np.searchsorted(chunks["part"].to_numpy(), np.arange(len(parts) + 1))
        for number, raw in enumerate(parts):
            before = chunks.iloc[cuts[number] : cuts[number + 1]].drop(columns="part")
            if not len(before):
                continue
            table = _from_bytes(raw)
            befores.append(before.assign(_c=before["_c"] + shift))
            tables.append(table.set_column(table.num_columns - 1, "_c", pc.add(table["_c"], shift)))
            shift, rows = shift + int(before["_c"].iloc[-1]) + 1, rows + table.num_rows
            if rows >= MERGED_ROWS:
                yield self._row(bucket, sent, befores, tables)
                befores, tables, rows, shift, sent = [], [], 0, 0, sent + 1
        if befores:
            yield self._row(bucket, sent, befores, tables)

    @staticmethod
    def _row(bucket: int, sent: int, befores: list, tables: list) -> pd.DataFrame:
        before = pa.Table.from_pandas(pd.concat(befores), preserve_index=False)
        rows = _to_bytes(pa.concat_tables(tables).combine_chunks())
        return pd.DataFrame({"bucket": [bucket], "part": [sent], "before": [_to_bytes(before)], "rows": [rows]})

    def _apart(self, chunks: pd.DataFrame, parts: list) -> tuple[pd.DataFrame, list]:
        """The chunks in order; those of a clip that reach into each other are made one, in a part of its own."""
        clip = _codes(pa.chunked_array([pa.array(chunks["clip_id"])]))
        begins = chunks["begins"].to_numpy()
        reach = _high_before(chunks["ends"].to_numpy(), clip, np.full(len(clip), -(1 << 62)))
        fresh = begins > reach
        fresh[_begins(clip)] = True
        group = np.cumsum(fresh) - 1
        together = np.bincount(group)[group] > 1
        if not together.any():
            return chunks, parts
        carried = self.carried
        mixed, alone = chunks[together].assign(group=group[together]), chunks[~together]
        number = {g: i for i, g in enumerate(mixed["group"].unique().tolist())}
        parts, taken = list(parts), []
        for part, some in mixed.groupby("part"):
            table = _from_bytes(parts[part])
            to = np.full(int(max(chunks.loc[chunks["part"] == part, "_c"])) + 1, -1)
            to[some["_c"].to_numpy()] = [number[g] for g in some["group"]]
            to = to[_numbers(table, "_c")]
            parts[part] = _to_bytes(table.filter(pa.array(to < 0)))
            own = table.filter(pa.array(to >= 0))
            taken.append(own.set_column(own.num_columns - 1, "_c", pa.array(to[to >= 0], pa.int64())))
        table = pa.concat_tables(taken).sort_by([("_c", "ascending"), (carried.order, "ascending")]).combine_chunks()
        chunk = _numbers(table, "_c")
        whole = mixed.groupby("group", sort=False).agg(clip_id=("clip_id", "first"), begins=("begins", "min"), ends=("ends", "max"))
        for name, kind in carried.how.items():
            whole[name] = np.int64(0 if kind == "sum" else -1)
        has = chunk[_begins(chunk)]
        for name, values in carried.reduce(table, chunk).items():
            found = whole[name].to_numpy().copy()
            found[has] = values
            whole[name] = found
        if carried.shrink is not None:
            table = table.filter(pa.array(carried.shrink(table, chunk)))
        whole = whole.assign(part=len(parts), _c=np.arange(len(whole)))
        merged = pd.concat([alone, whole[alone.columns]]).sort_values(["clip_id", "begins", "ends"], ignore_index=True)
        return merged, [*parts, _to_bytes(table)]

    def close(self) -> None:
        pass


def _expander(carried: Carried, clip: pa.DataType, others: list[str]):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                before = _from_bytes(batch.column("before")[row].as_py())
                table = _from_bytes(batch.column("rows")[row].as_py())
                chunk = np.searchsorted(_numbers(before, "_c"), _numbers(table, "_c"))
                if others:
                    told = pa.Table.from_struct_array(batch.column("told")[row].values)
                    at = pc.index_in(before["clip_id"], told["clip_id"].combine_chunks()).combine_chunks()
                    # Chunks of clips without facts give nothing.
                    stay = at.is_valid().to_numpy(zero_copy_only=False)
                    kept = stay[chunk]
                    table, chunk = table.filter(pa.array(kept)), (np.cumsum(stay) - 1)[chunk[kept]]
                    before, at = before.filter(pa.array(stay)), at.drop_null()
                    for name in others:
                        before = before.append_column(name, told[name].take(at))
                facts = {n: before[n].to_numpy() for n in ("first", *carried.how, *others)}
                found, chunk = carried.expand(table.drop_columns(["_c"]), chunk, facts)
                if not found.num_rows:
                    continue
                column = before["clip_id"].cast(clip).take(pa.array(chunk))
                yield from found.add_column(0, "clip_id", column).combine_chunks().to_batches()

    return run


_CLIP_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _bucket():
    return F.pmod(F.xxhash64("clip_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def carried_plan(
    rows: DataFrame,
    carried: Carried,
    output: str,
    clip_type: str,
    facts: DataFrame | None = None,
    pack_rows: int = PACK_ROWS,
) -> DataFrame:
    """The output of ``carried`` over a stream: packed, carried by clip, spread again and unpacked.

    ``facts`` (one row per clip) is joined to what comes out of the state, by groups of clips, and its
    columns reach ``expand`` in ``before``; clips without facts give nothing.
    """
    packed = rows.select("*", _bucket()).mapInArrow(_packer(carried, pack_rows), "bucket int, facts binary, rows binary")
    known = packed.groupBy("bucket").transformWithStateInPandas(
        _Carry(carried, clip_type), "bucket int, part int, before binary, rows binary", "append", "none"
    )
    others = []
    if facts is not None:
        others = [c for c in facts.columns if c != "clip_id"]
        told = facts.groupBy(_bucket()).agg(F.collect_list(F.struct("clip_id", *others)).alias("told"))
        known = known.join(told, "bucket")
    return known.repartition("bucket", "part").mapInArrow(
        _expander(carried, _CLIP_TYPES[clip_type], others), output
    )


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def keyed_dedup(spark: SparkSession, clip_type: str = "bigint", pack_rows: int = PACK_ROWS) -> KeyedStream:
    """Arrivals (``clip_id, arrival, n``) whose number is above all earlier ones, each once.

    The same rows as the batch operator ``ordered_dedup``. Arrivals that one before them in their own
    chunk already beats do not travel. Negative and null numbers are left out; an ``arrival`` at or
    below one of an earlier batch ends the stream with an error.
    """

    def rising(table: pa.Table, chunk: np.ndarray, high: np.ndarray) -> np.ndarray:
        n = _numbers(table, "n")
        return n > _high_before(n, chunk, high)

    def expand(table: pa.Table, chunk: np.ndarray, before: dict) -> tuple[pa.Table, np.ndarray]:
        stay = rising(table, chunk, before["high"][chunk])
        return table.filter(pa.array(stay)), chunk[stay]

    carried = Carried(
        "arrival",
        {"high": "max"},
        lambda table, chunk: {"high": np.maximum(_reduced(np.maximum, _numbers(table, "n"), chunk), -1)},
        expand,
        lambda table, chunk: rising(table, chunk, np.full(len(chunk), -1)),
    )
    output = f"clip_id {clip_type}, arrival bigint, n bigint"

    def plan(stream: DataFrame) -> DataFrame:
        rows = stream.select(
            F.col("clip_id").cast(clip_type), F.col("arrival").cast("bigint"),
            F.coalesce(F.col("n").cast("bigint"), F.lit(-1).cast("bigint")).alias("n"),
        )
        return carried_plan(rows, carried, output, clip_type, pack_rows=pack_rows)

    return KeyedStream(spark, plan, output)


def _reduced(how: np.ufunc, values: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """One value per chunk that has rows."""
    return how.reduceat(values, _begins(chunk)) if len(values) else np.zeros(0, np.int64)


def keyed_checkpoints(
    spark: SparkSession, every: int = 500, channels: int = 2, clip_type: str = "bigint", pack_rows: int = PACK_ROWS
) -> KeyedStream:
    """A checkpoint row per clip at its start and after every ``every`` video packets.

    Input is the sample log. Each row tells the video packets and the audio end sample so far;
    ``after_seq`` is -1 for the one at the start. A ``seq`` at or below one of an earlier batch ends the
    stream with an error.
    """
    step = F.lit(channels * 3).cast("bigint")

    def is_video(table: pa.Table) -> np.ndarray:
        return table["is_video"].to_numpy()

    def reduce(table: pa.Table, chunk: np.ndarray) -> dict[str, np.ndarray]:
        videos = _reduced(np.add, is_video(table).astype(np.int64), chunk)
        return {"videos": videos, "audio": np.maximum(_reduced(np.maximum, _numbers(table, "audio_end"), chunk), -1)}

    def shrink(table: pa.Table, chunk: np.ndarray) -> np.ndarray:
        """Video rows, and audio rows that end later than all before them in the chunk."""
        ends = _numbers(table, "audio_end")
        return is_video(table) | (ends > _high_before(ends, chunk, np.full(len(ends), -1)))

    def expand(table: pa.Table, chunk: np.ndarray, before: dict) -> tuple[pa.Table, np.ndarray]:
        video, ends = is_video(table), _numbers(table, "audio_end")
        count = before["videos"][chunk] + (_sum_by(video.astype(np.int64), chunk) if len(chunk) else 0)
        due = np.flatnonzero(video & (count % every == 0))
        ends = np.maximum(_high_by(ends, chunk), np.maximum(before["audio"], 0)[chunk]) if len(chunk) else ends
        first = np.flatnonzero(before["first"])
        columns = [_numbers(table, "seq")[due], count[due], ends[due]]
        columns = [np.append(np.full(len(first), start), c) for start, c in zip((-1, 0, 0), columns)]
        names = ("after_seq", "video_frames", "audio_end_sample")
        found = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})
        return found, np.append(first, chunk[due])

    carried = Carried("seq", {"videos": "sum", "audio": "max"}, reduce, expand, shrink)
    output = f"clip_id {clip_type}, after_seq bigint, video_frames bigint, audio_end_sample bigint"

    def plan(stream: DataFrame) -> DataFrame:
        end = F.when(~F.col("is_video"), F.col("pts") + F.call_function("div", F.col("size").cast("bigint"), step))
        rows = stream.select(
            F.col("clip_id").cast(clip_type), "seq", F.coalesce("is_video", F.lit(False)).alias("is_video"),
            F.coalesce(end, F.lit(-1)).cast("bigint").alias("audio_end"),
        )
        return carried_plan(rows, carried, output, clip_type, pack_rows=pack_rows)

    return KeyedStream(spark, plan, output)


def keyed_resume(
    spark: SparkSession, bounds: DataFrame, clip_type: str = "string", pack_rows: int = PACK_ROWS
) -> KeyedStream:
    """The complete prefix of growing logs: packets that end at or below the bound of valid data.

    Input is the sample log, ``bounds`` has ``clip_id, data_start, data_bound``; the state of a clip is
    the bytes it has had. A ``seq`` at or below one of an earlier batch ends the stream with an error.
    """

    def sizes(table: pa.Table) -> np.ndarray:
        return np.maximum(pc.fill_null(table["size"], 0).to_numpy(), 0)

    def expand(table: pa.Table, chunk: np.ndarray, before: dict) -> tuple[pa.Table, np.ndarray]:
        if not table.num_rows:
            return table, chunk
        size = sizes(table)
        offset = before["data_start"][chunk] + before["seen"][chunk] + _sum_by(size, chunk) - size
        done = (size > 0) & (offset + size <= before["data_bound"][chunk])
        return table.append_column("offset", pa.array(offset)).filter(pa.array(done)), chunk[done]

    carried = Carried("seq", {"seen": "sum"}, lambda table, chunk: {"seen": _reduced(np.add, sizes(table), chunk)}, expand)
    fields = "seq bigint, is_video boolean, size bigint, pts bigint, dts bigint, is_key boolean, frame_no bigint"
    output = f"clip_id {clip_type}, {fields}, offset bigint"
    facts = bounds.select(F.col("clip_id").cast(clip_type).alias("clip_id"), "data_start", "data_bound")

    def plan(stream: DataFrame) -> DataFrame:
        rows = stream.select(F.col("clip_id").cast(clip_type), *[f.split()[0] for f in fields.split(", ")])
        return carried_plan(rows, carried, output, clip_type, facts, pack_rows)

    return KeyedStream(spark, plan, output)


# --- runs of numbers ----------------------------------------------------------------------------------


def number_runs(batches):
    """(clip_id, low, high, since) of the numbers of each Arrow batch; ``since`` is the earliest time in us."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.filter(pc.and_(table["clip_id"].is_valid(), table["n"].is_valid()))
        table = table.sort_by([("clip_id", "ascending"), ("n", "ascending")])
        if not table.num_rows:
            continue
        n, since = _numbers(table, "n"), _numbers(table, "since")
        fresh = np.ones(len(n), bool)
        fresh[1:] = n[1:] > n[:-1] + 1
        fresh[[begin for begin, _ in _spans(table["clip_id"])]] = True
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:], len(n)) - 1
        yield pa.RecordBatch.from_arrays(
            [
                table["clip_id"].take(pa.array(begins)).combine_chunks(),
                pa.array(n[begins]),
                pa.array(n[ends]),
                pa.array(np.minimum.reduceat(since, begins)),
            ],
            names=["clip_id", "low", "high", "since"],
        )


# A value read by its key takes as long as some rows of a pass over a state.
PASS_ROWS = 8


def _looked_up(state, keys: list[tuple], rows: int) -> dict[tuple, tuple]:
    """The values of ``keys`` in a state of so many ``rows``; a pass over it where they are a good part of it."""
    if not keys or not rows:
        return {}
    if len(keys) * PASS_ROWS < rows:
        found = {k: state.getValue(k) for k in keys}
        return {k: tuple(v) for k, v in found.items() if v is not None}
    wanted = set(keys)
    return {k: tuple(v) for k, v in ((tuple(k), v) for k, v in state.iterator()) if k in wanted}


def _merged(runs: list[tuple], due: int) -> tuple[int, list[tuple]]:
    """What is due after ``runs`` (low, high, since), and those that still wait, put together where they touch."""
    now: list[tuple] = []
    for low, high, since in sorted(runs):
        if high < due:
            continue
        if now and low <= now[-1][1] + 1:
            now[-1] = (now[-1][0], max(now[-1][1], high), min(now[-1][2], since))
        else:
            now.append((low, high, since))
    if now and now[0][0] <= due:
        return now[0][1] + 1, now[1:]
    return due, now


class _Reorder(StatefulProcessor):
    """Holds runs of numbers that came early; releases what is due and tells gaps that last.

    A call takes a group of clips, each with rows of its own in the state: its facts, a row for each run it
    holds, and one while a gap may have to be told. One timer stands for the group: it runs out with the
    earliest wait, and what is due by then is told at once.
    """

    def __init__(self, start: int, timeout_ms: int | None, clip_type: str) -> None:
        self.start, self.timeout_ms, self.clip = start, timeout_ms, f"clip_id {clip_type}"

    def init(self, handle) -> None:
        self.handle = handle
        # Due number, the gap told last, when a gap is to be told (-1: never), and the runs held.
        self.facts = handle.getMapState("facts", self.clip, "due bigint, told bigint, timer bigint, runs bigint")
        self.held = handle.getMapState("held", f"{self.clip}, place bigint", "low bigint, high bigint, since bigint")
        self.waiting = handle.getMapState("waiting", self.clip, "timer bigint")
        # Rows of facts and held, and the time of the timer that runs (-1: none).
        self.group = handle.getValueState("group", "clips bigint, runs bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(map(int, self.group.get())) if self.group.exists() else (0, 0, -1)
        clips, held, alarm = before
        fresh: dict = {}
        for frame in rows:
            for clip, *run in zip(*(frame[c].tolist() for c in ("clip_id", "low", "high", "since"))):
                fresh.setdefault(clip, []).append(tuple(run))
        facts = _looked_up(self.facts, [(clip,) for clip in fresh], clips)
        places = [(clip, place) for (clip,), known in facts.items() for place in range(known[3])]
        found = _looked_up(self.held, places, held)
        old: dict = {}
        for clip, place in places:
            old.setdefault(clip, []).append(found[clip, place])
        clips += len(fresh) - len(facts)
        out, timers = [], []
        for clip, runs in fresh.items():
            had = old.get(clip, [])
            known = facts.get((clip,))
            begin, told, timer, _ = known or (self.start, self.start - 1, -1, 0)
            due, left = _merged([*had, *runs], begin)
            if due > begin:
                out.append((clip, begin, due - 1, "released"))
            self._hold(clip, had, left)
            held += len(left) - len(had)
            wanted = self._timer(told == due, left)
            if wanted != timer:
                self.waiting.updateValue((clip,), (wanted,)) if wanted >= 0 else self.waiting.removeKey((clip,))
            if wanted >= 0:
                timers.append(wanted)
            if known != (due, told, wanted, len(left)):
                self.facts.updateValue((clip,), (due, told, wanted, len(left)))
        if timers and (alarm < 0 or min(timers) < alarm):
            alarm = self._set_alarm(alarm, min(timers))
        if (clips, held, alarm) != before:
            self.group.update((clips, held, alarm))
        if out:
            yield pd.DataFrame(out, columns=["clip_id", "low", "high", "event"])

    def _hold(self, clip, had: list[tuple], left: list[tuple]) -> None:
        """Have the places of a clip hold ``left``; runs that stay as they are are not written again."""
        stay = set(left)
        kept = {run for run in had[: len(left)] if run in stay}
        moved = iter([run for run in left if run not in kept])
        for place in range(len(left)):
            if place >= len(had) or had[place] not in kept:
                self.held.updateValue((clip, place), next(moved))
        for place in range(len(left), len(had)):
            self.held.removeKey((clip, place))

    def _timer(self, told: bool, left: list[tuple]) -> int:
        """When the earliest held number of a clip has waited too long."""
        if self.timeout_ms is None or not left or told:
            return -1
        # The watermark passes whole milliseconds; a wait of exactly the timeout is no gap.
        return min(since for _, _, since in left) // 1000 + self.timeout_ms + 1

    def _set_alarm(self, alarm: int, wanted: int) -> int:
        if alarm >= 0:
            self.handle.deleteTimer(alarm)
        if wanted >= 0:
            self.handle.registerTimer(wanted)
        return wanted

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        clips, held, _ = map(int, self.group.get())
        waiting = [(clip, int(timer)) for (clip,), (timer,) in self.waiting.iterator()] if self.waiting.exists() else []
        over = [(clip,) for clip, timer in waiting if timer <= now]
        facts = _looked_up(self.facts, over, clips)
        for one, (due, _, _, runs) in facts.items():
            self.facts.updateValue(one, (due, due, -1, runs))
            self.waiting.removeKey(one)
        # The timer that ran out is gone.
        alarm = self._set_alarm(-1, min((timer for _, timer in waiting if timer > now), default=-1))
        self.group.update((clips, held, alarm))
        if facts:
            out = [(clip, due, due, "gap") for (clip,), (due, *_) in facts.items()]
            yield pd.DataFrame(out, columns=["clip_id", "low", "high", "event"])

    def close(self) -> None:
        pass


def keyed_reorder(
    spark: SparkSession, start: int = 0, timeout_s: float | None = None, clip_type: str = "bigint"
) -> KeyedStream:
    """Hold back early arrivals and release each clip's numbers in order.

    Input is ``clip_id, n, ts``. Tasks turn the numbers they read into runs, which meet in the state of a
    group of clips, and a clip keeps the runs it holds, each in a row: a run that waits is not written
    again, and a hot clip sends as few rows as it has runs. Output rows are ``released`` numbers, each once, and, when ``timeout_s`` is
    set, one ``gap`` per clip and missing number that has kept later ones waiting for longer than that
    in event time. A timer tells it, so it needs no further rows of that clip: only the time of the
    stream, the newest ``ts`` of all clips, has to go on. Late rows are never dropped. Rows without a
    clip, a number or a time are left out.
    """
    output = f"clip_id {clip_type}, n bigint, event string"
    timeout_ms = None if timeout_s is None else int(timeout_s * 1000)

    def plan(stream: DataFrame) -> DataFrame:
        rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")
        rows = rows.withWatermark("ts", "0 seconds").select(
            F.col("clip_id").cast(clip_type), F.col("n").cast("bigint").alias("n"), F.unix_micros("ts").alias("since")
        )
        # Runs carry no event time, so Spark takes none of them for late.
        runs = rows.mapInArrow(number_runs, f"clip_id {clip_type}, low bigint, high bigint, since bigint")
        events = runs.select("*", _bucket()).groupBy("bucket").transformWithStateInPandas(
            _Reorder(start, timeout_ms, clip_type),
            f"clip_id {clip_type}, low bigint, high bigint, event string",
            "append",
            "none" if timeout_s is None else "eventTime",
        )
        return events.select("clip_id", F.explode(F.sequence("low", "high")).alias("n"), "event")

    return KeyedStream(spark, plan, output)


# --- intake -------------------------------------------------------------------------------------------


class _Intake(StatefulProcessor):
    """Remembers which side files a clip has and tells its sources that still need work."""

    def init(self, handle) -> None:
        self.has = handle.getValueState("has", "output boolean, sidecar boolean")

    def handleInputRows(self, key, rows, timerValues):
        files = pd.concat(list(rows))
        before = self.has.get() if self.has.exists() else (False, False)
        output, sidecar = (bool(had or (files["kind"] == kind).any()) for had, kind in zip(before, ("output", "sidecar")))
        if (output, sidecar) != tuple(map(bool, before)):
            self.has.update((output, sidecar))
        todo = files[files["kind"] == "source"]
        if len(todo) and not (output and sidecar):
            reason = "no sidecar" if output else "new"
            yield pd.DataFrame({"path": todo["path"], "clip_key": key[0], "reason": reason})

    def close(self) -> None:
        pass


def keyed_intake(spark: SparkSession, folder: str | None = None) -> KeyedStream:
    """New source files that still need work, each told once, from a stream of all files of an archive.

    Input is ``path, kind, clip_key`` (:func:`archive_files`). Outputs and sidecars are part of the
    stream and kept in the state of their clip, so nothing is listed again for a batch: a source that
    comes is held against all that has come by then, files of its own batch included. The rows are those of the
    batch operator ``pending``. Files that are deleted later are not noticed.
    """
    output = "path string, clip_key string, reason string"

    def plan(stream: DataFrame) -> DataFrame:
        files = stream.filter(F.col("kind").isin("source", "output", "sidecar")).select("path", "kind", "clip_key")
        return files.groupBy("clip_key").transformWithStateInPandas(_Intake(), output, "append", "none")

    return KeyedStream(spark, plan, output, folder)


def archive_files(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """All known files below a folder as a stream of ``path, kind, clip_key``; only metadata is read."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    paths = reader.load(root).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"))
    return classify(paths).filter("kind is not null")

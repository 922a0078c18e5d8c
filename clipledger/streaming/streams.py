"""Streaming forms of the archive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.operators.arrivals import ordered_dedup, release_prefix
from clipledger.operators.artifacts import pending
from clipledger.operators.settings import progress
from clipledger.operators.timeline import resume_point
from clipledger.plans.scan import (
    CHUNK_ROWS,
    chunk_of,
    idiv,
    running,
    running_count,
    running_max,
    running_sum,
)
from clipledger.streaming.carry import CarriedStream, after_state, newest

PROGRESS_EVERY = "2 seconds"
# Records between two log flushes and between two checkpoints.
FLUSH_EVERY = 20
CHECKPOINT_EVERY = 500


def progress_stream(
    events: DataFrame, window: str = PROGRESS_EVERY, late: str = "10 minutes"
) -> DataFrame:
    """The newest progress figures of each clip per window of event time.

    ``events`` has ``clip_id, ts, done, total, fps_num, fps_den, fps``. Works on a stream and on a
    batch; the newest event of a clip and window is found on the map side first.
    """
    source = events.withWatermark("ts", late) if events.isStreaming else events
    last = source.groupBy(F.window("ts", window), "clip_id").agg(
        F.max_by(F.struct("ts", "done", "total", "fps_num", "fps_den", "fps"), F.struct("ts", "done")).alias("e")
    )
    flat = last.select(
        "clip_id",
        F.col("window.start").alias("window_start"),
        "e.done",
        "e.total",
        "e.fps_num",
        "e.fps_den",
        "e.fps",
        F.unix_micros("e.ts").cast("double").alias("_us"),
    ).withColumn("now_epoch", F.col("_us") / 1e6)
    return progress(flat).drop("_us")


def checkpoint_stream(
    spark: SparkSession,
    every: int = CHECKPOINT_EVERY,
    channels: int = 2,
    chunk_rows: int = CHUNK_ROWS,
    clip_type: str = "bigint",
) -> CarriedStream:
    """A checkpoint row per clip at its start and after every ``every`` video packets.

    Input is the sample log; a ``seq`` at or below one of an earlier batch is an error. Each row
    tells the video packets and the audio end sample so far; ``after_seq`` is -1 for the one at the
    start.
    """
    step_bytes = F.lit(channels * 3).cast("bigint")

    def step(batch: DataFrame, state: DataFrame):
        last = after_state(batch, state, "seq")
        ends = F.when(~F.col("is_video"), F.col("pts") + idiv("size", step_bytes))
        rows = running(
            batch.select("clip_id", "seq", "is_video", "size", "pts"),
            ["clip_id"],
            chunk_of("seq", chunk_rows),
            ["seq"],
            {
                "_video": running_count("is_video"),
                "_audio": running_max(ends.cast("bigint"), empty=0),
            },
            facts=state,
        )
        zero = F.lit(0).cast("bigint")
        rows = rows.withColumns(
            {
                "video_frames": F.col("_video") + F.coalesce("videos", zero),
                "audio_end_sample": F.greatest(F.col("_audio"), F.coalesce("audio_end", zero)),
            }
        )
        due = rows.filter(F.col("is_video") & (F.col("video_frames") % every == 0)).select(
            "clip_id", F.col("seq").alias("after_seq"), "video_frames", "audio_end_sample"
        )
        seen = batch.groupBy("clip_id").agg(
            F.count_if("is_video").alias("videos"), F.coalesce(F.max(ends), zero).alias("audio_end")
        )
        first = (
            seen.join(state, "clip_id", "left_anti")
            .select("clip_id", F.lit(-1).cast("bigint"), zero, zero)
        )
        how = {"videos": "sum", "audio_end": "max", "last": "max"}
        merged = newest(state, seen.join(last, "clip_id"), ["clip_id"], how)
        return first.union(due).toDF(*due.columns), merged

    return CarriedStream(
        spark,
        step,
        f"clip_id {clip_type}, after_seq bigint, video_frames bigint, audio_end_sample bigint",
        f"clip_id {clip_type}, videos bigint, audio_end bigint, last bigint",
    )


def ordered_dedup_stream(
    spark: SparkSession, chunk_rows: int = CHUNK_ROWS, clip_type: str = "bigint"
) -> CarriedStream:
    """Arrivals (``clip_id, arrival, n``) whose number is above all earlier ones, each once.

    An ``arrival`` at or below one of an earlier batch is an error.
    """

    def step(batch: DataFrame, state: DataFrame):
        rows = batch.select("clip_id", "arrival", "n")
        last = after_state(rows, state, "arrival")
        known = state.filter("high is not null").select("clip_id", "high")
        kept = ordered_dedup(rows, chunk_rows=chunk_rows, after=known)
        high = rows.groupBy("clip_id").agg(F.max(F.when(F.col("n") >= 0, F.col("n"))).alias("high"))
        return kept, newest(state, high.join(last, "clip_id"), ["clip_id"], {"high": "max", "last": "max"})

    return CarriedStream(
        spark,
        step,
        f"clip_id {clip_type}, arrival bigint, n bigint",
        f"clip_id {clip_type}, high bigint, last bigint",
    )


def reorder_stream(
    spark: SparkSession,
    start: int = 0,
    timeout_s: float | None = None,
    chunk_rows: int = CHUNK_ROWS,
    clip_type: str = "bigint",
) -> CarriedStream:
    """Hold back early arrivals and release each clip's numbers in order.

    Input is ``clip_id, n, ts``. Output rows are ``released`` numbers and, when ``timeout_s`` is
    set, one ``gap`` per clip and missing number that has kept later ones waiting for longer than
    that in event time, which never runs backwards. The state is the held rows and, in a row with
    n = -1, what is due next, which gap was told last and the time of it.
    """

    def step(batch: DataFrame, state: DataFrame):
        begin = F.lit(start).cast("bigint")
        none = F.lit(None).cast("bigint")
        due = state.filter("n = -1").select("clip_id", "due", "told")
        held = state.filter("n >= 0").select("clip_id", "n", "ts")
        fresh = batch.select("clip_id", F.col("n").cast("bigint"), F.col("ts").cast("timestamp"))
        waiting = held.union(fresh).groupBy("clip_id", "n").agg(F.min("ts").alias("ts"))
        starts = due.select("clip_id", F.col("due").alias("start"))
        flagged = release_prefix(waiting, start, chunk_rows=chunk_rows, starts=starts).join(
            waiting, ["clip_id", "n"]
        )
        out = flagged.filter("released").select("clip_id", "n", F.lit("released").alias("event"))
        rest = flagged.filter("not released").select("clip_id", "n", "ts")
        now_due = (
            due.union(fresh.select("clip_id", begin, none))
            .union(out.select("clip_id", F.col("n") + 1, none))
            .groupBy("clip_id")
            .agg(F.max("due").alias("due"), F.max("told").alias("told"))
        )
        now = None
        if timeout_s is not None:
            times = fresh.select("ts").union(state.filter("n = -1").select("ts"))
            now = times.agg(F.max("ts")).first()[0]
            stuck = rest.groupBy("clip_id").agg(F.min("ts").alias("since"))
            waited = F.unix_micros(F.lit(now)) - F.unix_micros("since")
            gaps = (
                now_due.join(stuck, "clip_id")
                .filter((waited > int(timeout_s * 1e6)) & ~F.col("told").eqNullSafe(F.col("due")))
                .select("clip_id", F.col("due").alias("n"), F.lit("gap").alias("event"))
            )
            out = out.union(gaps)
            now_due = now_due.join(
                gaps.select("clip_id", F.col("n").alias("_gap")), "clip_id", "left"
            ).select("clip_id", "due", F.coalesce("_gap", "told").alias("told"))
        state_rows = rest.select("clip_id", "n", "ts", none.alias("due"), none.alias("told")).union(
            now_due.select(
                "clip_id", F.lit(-1).cast("bigint"), F.lit(now).cast("timestamp"), "due", "told"
            )
        )
        return out, state_rows

    return CarriedStream(
        spark,
        step,
        f"clip_id {clip_type}, n bigint, event string",
        f"clip_id {clip_type}, n bigint, ts timestamp, due bigint, told bigint",
    )


def resume_stream(
    spark: SparkSession, bounds: DataFrame, chunk_rows: int = CHUNK_ROWS, clip_type: str = "bigint"
) -> CarriedStream:
    """The complete prefix of growing logs: packets that end at or below the bound of valid data.

    Input is the sample log; a ``seq`` at or below one of an earlier batch is an error. The state is
    the bytes seen of each clip.
    :func:`resume_now` gives the resume points when they are wanted.
    """

    def step(batch: DataFrame, state: DataFrame):
        last = after_state(batch, state, "seq")
        seen = state.select("clip_id", "seen")
        facts = bounds.select("clip_id", "data_start", "data_bound").join(seen, "clip_id", "left")
        size = F.greatest(F.col("size"), F.lit(0).cast("bigint"))
        rows = running(
            batch,
            ["clip_id"],
            chunk_of("seq", chunk_rows),
            ["seq"],
            {"_before": running_sum(size, inclusive=False)},
            facts=facts,
        )
        offset = F.col("data_start") + F.coalesce("seen", F.lit(0).cast("bigint")) + F.col("_before")
        kept = rows.withColumn("offset", offset).filter(
            (F.col("size") > 0) & (F.col("offset") + F.col("size") <= F.col("data_bound"))
        )
        grown = batch.groupBy("clip_id").agg(F.sum(size).alias("seen"))
        return (
            kept.select(*batch.columns, "offset"),
            newest(state, grown.join(last, "clip_id"), ["clip_id"], {"seen": "sum", "last": "max"}),
        )

    return CarriedStream(
        spark,
        step,
        f"clip_id {clip_type}, seq bigint, is_video boolean, size bigint, pts bigint, dts bigint, "
        "is_key boolean, frame_no bigint, offset bigint",
        f"clip_id {clip_type}, seen bigint, last bigint",
    )


def resume_now(stream: CarriedStream, clips: DataFrame) -> DataFrame:
    """The resume point of each clip from what a :func:`resume_stream` has written so far."""
    return resume_point(stream.result().withColumn("is_complete", F.lit(True)), clips)


def intake_stream(spark: SparkSession, list_artifacts, folder: str | None = None) -> CarriedStream:
    """New source files (``path, is_regular``) that still need work, each reported once.

    ``list_artifacts()`` gives the artifacts at the time of a batch, so that what has been
    finished meanwhile is left out.
    """

    def step(batch: DataFrame, state: DataFrame):
        todo = pending(batch.select("path", "is_regular"), list_artifacts())
        return todo, state

    return CarriedStream(
        spark, step, "path string, clip_key string, reason string", "path string", folder
    )


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """New files below a folder as a stream; only their metadata is read."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{NEV,nev}")
        .load(root)
        .select(
            F.regexp_replace("path", r"^file:/+", "/").alias("path"), F.lit(True).alias("is_regular")
        )
    )

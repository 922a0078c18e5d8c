"""Packet logs: byte offsets, complete prefix, resume point, reorder and timeline repair.

Every operator takes the ``samples`` table (one row per packet, ``seq`` = position in the log of
its clip) and works on all clips at once. Running values go through :mod:`clipledger.plans.scan`,
so a clip of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.plans.scan import (
    CHUNK_ROWS,
    CHUNK_TICKS,
    attach,
    chunk_of,
    idiv,
    ordered_chunks,
    running,
    running_count,
    running_last,
    running_max,
    running_sum,
    whole_max,
)
from clipledger.session import store

CLIP = ["clip_id"]
# Packets per range in the steps of the search for the cut; the last step looks at single packets.
CUT_WIDTHS = (1 << 18, 1 << 9, 1)
# Fixed value: frames to step back from a key frame when groups are open.
RESUME_BACKOFF = 17


LOG_CHUNK = "log_chunk"


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def log_chunk(samples: DataFrame, chunk_rows: int) -> Column:
    """Chunk of a packet: the stored one of a bucketed log table, else derived from ``seq``."""
    return F.col(LOG_CHUNK) if LOG_CHUNK in samples.columns else chunk_of("seq", chunk_rows)


def write_log_table(
    samples: DataFrame, table: str, buckets: int, path: str | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Store a log as a table bucketed and sorted by (clip, chunk), and return it.

    Running values over such a table need no shuffle and no sort of the packets. Buckets hold
    chunks, not clips, so a clip that is a third of the archive is spread over all of them.
    """
    chunked = samples.withColumn(LOG_CHUNK, chunk_of("seq", chunk_rows))
    # One file per bucket, so that its sort order holds.
    writer = (
        chunked.repartition(buckets, "clip_id", LOG_CHUNK)
        .write.mode("overwrite")
        .bucketBy(buckets, "clip_id", LOG_CHUNK)
        .sortBy("clip_id", LOG_CHUNK, "seq")
    )
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return samples.sparkSession.table(table)


def _bytes() -> Column:
    """Bytes a packet adds to the data: negative sizes add none."""
    return F.greatest(F.col("size"), _long(0))


def non_empty(samples: DataFrame) -> DataFrame:
    """Packets that carry bytes."""
    return samples.filter(F.col("size") > 0)


def offsets(samples: DataFrame, data_start: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Byte offset of each packet: start of the data plus all earlier sizes in write order."""
    out = running(
        samples,
        CLIP,
        log_chunk(samples, chunk_rows),
        ["seq"],
        {"offset": running_sum(_bytes(), inclusive=False)},
    )
    return out.withColumn("offset", F.col("offset") + data_start)


def flag_complete(
    samples: DataFrame, bounds: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``offset`` and ``is_complete``: the packet lies wholly below the bound of valid data.

    ``bounds`` has ``clip_id, data_start, data_bound``. Sizes count only when positive, so packet
    ends rise along the log and all rows after the first one over the bound are over it too.
    Empty packets hold no bytes and are never complete. Rows without clip or position have no
    place in a log and are left out.
    """
    out = running(
        samples,
        CLIP,
        log_chunk(samples, chunk_rows),
        ["seq"],
        {"_before": running_sum(_bytes(), inclusive=False)},
        facts=bounds.select("clip_id", "data_start", "data_bound"),
    )
    out = out.withColumn("offset", F.col("data_start") + F.col("_before"))
    fits = (F.col("size") > 0) & (F.col("offset") + F.col("size") <= F.col("data_bound"))
    return out.withColumn("is_complete", F.coalesce(fits, F.lit(False))).select(
        *samples.columns, "offset", "is_complete"
    )


def complete_cut(
    samples: DataFrame, bounds: DataFrame, widths: tuple[int, ...] = CUT_WIDTHS
) -> DataFrame:
    """``clip_id, cut_seq``: the first log position of each clip that is not complete.

    The position is searched in steps: byte totals of wide ranges of positions (reduced on the map
    side) tell in which range a clip crosses its bound, then only that range is summed in narrower
    ones, down to single packets. Each step leaves one row per clip, written to the shared folder:
    its true size lets Catalyst broadcast it into the next step, so the log is read a few times
    but never shuffled. A clip that never crosses has a null ``cut_seq``; one without bounds is
    cut at 0.
    """
    if any(wide % narrow for wide, narrow in zip(widths, widths[1:])) or widths[-1] != 1:
        raise ValueError("each width must be a multiple of the next one, and the last must be 1")
    so_far = (
        Window.partitionBy("clip_id")
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    room = F.col("data_bound") - F.col("data_start")
    found, wider = None, None
    for width in widths:
        rows = samples.select("clip_id", "seq", _bytes().alias("_bytes"))
        if found is not None:
            rows = rows.withColumn("_at", chunk_of("seq", wider)).join(
                found.filter("_at is not null").select("clip_id", "_at"), ["clip_id", "_at"]
            )
        left = bounds.select("clip_id", room.alias("_left")) if found is None else found.select(
            "clip_id", "_left"
        )
        summed = (
            rows.groupBy("clip_id", chunk_of("seq", width).alias("_part"))
            .agg(F.sum("_bytes").alias("_bytes"))
            .withColumn("_upto", F.sum("_bytes").over(so_far))
            .join(left, "clip_id", "left")
        )
        over = F.when(F.col("_upto") > F.col("_left"), F.col("_part"))
        before = F.col("_left") - F.col("_upto") + F.col("_bytes")
        step = summed.groupBy("clip_id").agg(
            F.min(over).alias("_at"),
            F.min_by(before, over).alias("_left"),
            F.bool_or(F.col("_left").isNotNull()).alias("_known"),
        )
        if found is not None:
            step = found.select("clip_id", "_known").join(step.drop("_known"), "clip_id", "left")
        found, wider = store(step, "cut"), width
    cut = F.when(F.col("_known"), F.col("_at")).otherwise(_long(0))
    return found.select("clip_id", cut.alias("cut_seq"))


def mark_complete(
    samples: DataFrame, bounds: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``is_complete`` only: :func:`flag_complete` without the offsets."""
    return flag_complete(samples, bounds, chunk_rows).drop("offset")


def mark_by_cut(
    samples: DataFrame, bounds: DataFrame, widths: tuple[int, ...] = CUT_WIDTHS
) -> DataFrame:
    """The rows of :func:`mark_complete`, from one cut position per clip.

    The log is read once per width and never shuffled; worth it for logs that are not bucketed and
    too large to shuffle.
    """
    placed = samples.filter("clip_id is not null and seq is not null")
    known = attach(placed, complete_cut(placed, bounds, widths), CLIP, chunk_of("seq"))
    before = F.col("cut_seq").isNull() | (F.col("seq") < F.col("cut_seq"))
    return known.withColumn("is_complete", (F.col("size") > 0) & before).drop("cut_seq")


def complete_prefix(
    samples: DataFrame, bounds: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The packets before the first one that would cross the bound of valid data."""
    return flag_complete(samples, bounds, chunk_rows).filter("is_complete").drop("is_complete")


def count_complete(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("clip_id").agg(F.count_if("is_complete").alias("complete_packets"))


def video_count(samples: DataFrame) -> DataFrame:
    return samples.groupBy("clip_id").agg(F.count_if("is_video").alias("video_packets"))


def _audio_end(channels: Column) -> Column:
    end = F.col("pts") + idiv(F.col("size"), (channels * 3).cast("bigint"))
    return F.when(~F.col("is_video") & (channels > 0), F.greatest(end, _long(0)))


def audio_end(samples: DataFrame, channels: int | Column) -> DataFrame:
    """End sample of the last audio packet; 0 without audio or without channels."""
    channels = F.lit(channels) if isinstance(channels, int) else channels
    return samples.groupBy("clip_id").agg(
        F.coalesce(F.max(_audio_end(channels)), _long(0)).alias("audio_end_sample")
    )


def last_key(samples: DataFrame) -> DataFrame:
    """Frame number of the key frame that was written last (not of the highest one)."""
    known = F.when(F.col("is_video") & F.col("is_key") & (F.col("frame_no") >= 0), F.col("seq"))
    return samples.groupBy("clip_id").agg(
        F.coalesce(F.max_by("frame_no", known), _long(0)).alias("last_key_frame")
    )


def prefix_max(points: DataFrame, frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Highest dts of all frames below each asked frame number, -1 when there is none.

    Points and frames are first reduced to one row per frame number, then scanned once.
    """
    cells = frames.filter("frame_no >= 0").select("clip_id", "frame_no", "dts", F.lit(0).alias("_q"))
    asked = points.select("clip_id", "frame_no", F.lit(None).cast("bigint"), F.lit(1))
    grouped = (
        cells.union(asked)
        .groupBy("clip_id", "frame_no")
        .agg(F.max("dts").alias("_dts"), F.max("_q").alias("_q"))
    )
    out = running(
        grouped,
        CLIP,
        chunk_of("frame_no", chunk_rows),
        ["frame_no"],
        {"max_dts": running_max("_dts", inclusive=False, empty=-1)},
    )
    return out.filter("_q = 1").select("clip_id", "frame_no", "max_dts")


def _step_back(frame: Column, open_gop: Column) -> Column:
    return F.when((open_gop != 0) & (frame > RESUME_BACKOFF), frame - RESUME_BACKOFF).otherwise(
        frame
    )


def _resume_places(flagged: DataFrame, clips: DataFrame, chunk_rows: int) -> DataFrame:
    """One row per clip with complete packets: resume frame and what a report counts, in one pass of the log.

    Each complete packet falls on a place, the number of its frame or -1 without one, and a key frame on
    that of its candidate too. Places add up on the map side and travel once; all figures
    of a clip, the resume frame and the counts, are read off the same scan of its places.
    """
    counts = "channels" in clips.columns
    settings = clips.select("clip_id", "fps_den", "open_gop", *(["channels"] if counts else []))
    packets = attach(
        flagged.filter("is_complete"), settings.drop("fps_den"), CLIP, chunk_of("seq", chunk_rows), "inner"
    )
    none = F.lit(None).cast("bigint")
    framed = F.coalesce(F.col("is_video") & (F.col("frame_no") >= 0), F.lit(False))
    key_seq = F.when(framed & F.col("is_key"), F.col("seq"))
    own = F.struct(
        F.when(framed, F.col("frame_no")).otherwise(_long(-1)).alias("at"),
        F.when(framed, F.col("dts")).alias("dts"),
        none.alias("key_seq"),
        key_seq.alias("own_seq"),
        _long(1).alias("packets"),
        F.col("is_video").cast("bigint").alias("video"),
        (_audio_end(F.col("channels")) if counts else none).alias("audio"),
    )
    candidate = F.struct(
        _step_back(F.col("frame_no"), F.col("open_gop")).alias("at"),
        none.alias("dts"),
        F.col("seq").alias("key_seq"),
        *[none.alias(n) for n in ("own_seq", "packets", "video", "audio")],
    )
    places = (
        packets.select(
            "clip_id", F.explode(F.when(key_seq.isNotNull(), F.array(own, candidate)).otherwise(F.array(own))).alias("p")
        )
        .groupBy("clip_id", F.col("p.at").alias("frame_no"))
        .agg(
            *[F.max(f"p.{n}").alias(f"_{n}") for n in ("dts", "key_seq", "own_seq", "audio")],
            *[F.sum(f"p.{n}").alias(f"_{n}") for n in ("packets", "video")],
        )
    )
    written = F.when(
        F.col("_key_seq").isNotNull(), F.struct("_key_seq", F.col("frame_no").alias("at"))
    )
    scanned = running(
        places,
        CLIP,
        chunk_of("frame_no", chunk_rows),
        ["frame_no"],
        {
            "_below": running_max("_dts", inclusive=False, empty=-1),
            "_newest": whole_max(written),
        },
        facts=settings.select("clip_id", "fps_den"),
    ).withColumn("_limit", F.coalesce(F.col("_newest.at"), _long(0)))
    place = F.col("frame_no")
    good = (place > 0) & (F.col("_below") < (place - 2) * F.greatest(F.col("fps_den"), _long(1)))
    picked = scanned.groupBy("clip_id").agg(
        F.max_by("frame_no", F.when(good, F.col("_key_seq"))).alias("_key"),
        F.max(F.when(good, F.col("_key_seq"))).alias("_key_at"),
        F.max(F.when(place == 0, F.col("_key_seq"))).alias("_zero_at"),
        F.max(F.when(good & (place <= F.col("_limit")), place)).alias("_frame"),
        F.sum("_packets").alias("complete_packets"),
        F.sum("_video").alias("_video"),
        F.max_by("frame_no", "_own_seq").alias("_last"),
        F.max("_audio").alias("_audio"),
    )
    by_key = F.when(F.col("_key_at") > F.coalesce(F.col("_zero_at"), _long(-1)), F.col("_key"))
    return picked.withColumn("resume_frame", F.coalesce(by_key, F.col("_frame"), _long(0)))


def resume_point(flagged: DataFrame, clips: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """First frame to encode again for each clip, 0 for a fresh start.

    ``flagged`` comes from :func:`mark_complete` or :func:`flag_complete`; ``clips`` has ``clip_id, fps_den, open_gop``.
    A candidate c is good when every dts below it is under (c - 2) frames. The candidate of the
    last written good key frame wins, unless a key frame that steps back to 0 was written later;
    then the largest good frame up to the last key frame is taken. That frame is always a logged
    frame number or the candidate of the last key frame, so only those need a look.
    """
    found = _resume_places(flagged, clips.select("clip_id", "fps_den", "open_gop"), chunk_rows)
    return (
        clips.select("clip_id")
        .join(found.select("clip_id", "resume_frame"), "clip_id", "left")
        .select("clip_id", F.coalesce("resume_frame", _long(0)).alias("resume_frame"))
    )


def resume_report(flagged: DataFrame, clips: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One line per clip: what can be reused, where to go on, and why.

    ``clips`` has ``clip_id, fps_den, open_gop, channels, frame_count``. All figures come from one
    pass of the flagged log.
    """
    zero = _long(0)
    video = F.coalesce("_video", zero)
    reusable = F.least(video, F.col("frame_count"))
    frame = F.coalesce("resume_frame", zero)
    resumed = frame > 0
    return (
        clips.select("clip_id", "frame_count")
        .join(_resume_places(flagged, clips, chunk_rows), "clip_id", "left")
        .select(
            "clip_id",
            F.coalesce("complete_packets", zero).alias("complete_packets"),
            reusable.alias("video_frames"),
            F.coalesce("_last", zero).alias("last_key_frame"),
            frame.alias("resume_frame"),
            F.when(resumed, F.greatest(reusable - frame, zero)).otherwise(zero).alias("frames_to_redo"),
            F.when(resumed, F.coalesce("_audio", zero)).otherwise(zero).alias("resume_sample"),
            F.when(video == 0, "no complete video")
            .when(~resumed, "first group only")
            .otherwise("resume")
            .alias("reason"),
        )
    )


def purge_reorder(
    flagged: DataFrame,
    resume: DataFrame,
    skip_audio: bool = False,
    data_start: int = 0,
    rescale: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The log and layout to replay: complete packets below the resume frame, in replay order.

    Video at or after ``resume_frame`` is dropped, the rest is ordered by (dts, video first, log
    order) and gets a new ``seq`` and ``offset``. Video and audio clocks are compared as they are;
    with ``rescale`` (``clip_id, fps_num, sample_rate``) they are compared in seconds.
    """
    columns = [c for c in flagged.columns if c not in ("is_complete", "offset")]
    kept = attach(
        flagged.filter("is_complete").select(*columns),
        resume.select("clip_id", "resume_frame"),
        CLIP,
        chunk_of("seq", chunk_rows),
    ).filter(
        ~F.col("is_video")
        | F.col("resume_frame").isNull()
        | (F.col("frame_no") < F.col("resume_frame"))
    )
    if skip_audio:
        kept = kept.filter("is_video")
    clock = F.col("dts")
    if rescale is not None:
        kept = attach(
            kept,
            rescale.select("clip_id", "fps_num", "sample_rate"),
            CLIP,
            chunk_of("seq", chunk_rows),
        )
        # dts / rate compared exactly: cross-multiplied by the other clock's rate.
        wide = F.col("dts").cast("decimal(38,0)")
        clock = F.when(F.col("is_video"), wide * F.col("sample_rate")).otherwise(
            wide * F.col("fps_num")
        )
    kept = kept.select(
        *columns, clock.alias("_clock"), F.when(F.col("is_video"), 0).otherwise(1).alias("_lane")
    ).withColumnRenamed("seq", "old_seq")
    order = ["_clock", "_lane", "old_seq"]
    out = running(
        ordered_chunks(kept, ["clip_id", *order]),
        CLIP,
        "order_chunk",
        order,
        {
            "seq": running_count(inclusive=False),
            "offset": running_sum("size", inclusive=False),
        },
    )
    rest = [c for c in columns if c not in ("clip_id", "seq")]
    return out.select(
        "clip_id", "seq", "old_seq", *rest, (F.col("offset") + data_start).alias("offset")
    )


def session_shift(
    old: DataFrame, resume: DataFrame, new: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Move the video of a new session so that its first dts is above every replayed dts.

    The same shift is added to dts and pts of the whole session, and only when needed. ``old`` is
    the kept log, ``new`` the packets of the session.
    """
    spread = chunk_of("seq", chunk_rows)
    replayed = attach(
        old.filter("is_video and frame_no >= 0").select("clip_id", "seq", "frame_no", "dts"),
        resume.select("clip_id", "resume_frame"),
        CLIP,
        spread,
    ).filter("frame_no < resume_frame")
    floor = replayed.groupBy("clip_id").agg((F.max("dts") + 1).alias("_floor"))
    first = (
        new.filter("is_video")
        .groupBy("clip_id")
        .agg(F.min_by(F.greatest(F.col("dts"), _long(0)), "seq").alias("_first"))
    )
    shift = first.join(floor, "clip_id", "left").select(
        "clip_id",
        F.greatest(F.coalesce("_floor", _long(0)) - F.col("_first"), _long(0)).alias("shift"),
    )
    moved = attach(new, shift, CLIP, spread)
    by = F.when(F.col("is_video"), F.coalesce("shift", _long(0))).otherwise(_long(0))
    start = F.when(F.col("is_video"), F.greatest(F.col("dts"), _long(0))).otherwise(F.col("dts"))
    return moved.withColumns(
        {"pts": F.col("pts") + by, "dts": start + by, "shift": by}
    ).select(*new.columns, "shift")


def monotone_dts(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Make the dts of a clip's video strictly rising in write order.

    Negative dts become 0, then each dts is at least one above the one before; pts is raised to the
    new dts only where dts had to be raised. With r the rank of a packet the result is
    r + max(dts - r) over the packets so far, so no row-by-row loop is needed.
    """
    part = ["clip_id", "_chunk"]
    inside = Window.partitionBy(*part).orderBy("seq")
    ranked = (
        samples.withColumn("_chunk", log_chunk(samples, chunk_rows))
        .filter("is_video and clip_id is not null and _chunk is not null")
        .withColumn("_start", F.greatest(F.col("dts"), _long(0)))
        .withColumn("_rank", F.row_number().over(inside).cast("bigint"))
        .withColumn("_lead", F.col("_start") - F.col("_rank"))
    )
    # Ranks are counted inside a chunk; the chunks before it shift both sides by their row count.
    before = (
        Window.partitionBy("clip_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        ranked.groupBy(*part)
        .agg(F.count("*").alias("_rows"), F.max("_lead").alias("_top"))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(before), _long(0)))
        .withColumn("_floor", F.max(F.col("_top") - F.col("_base")).over(before))
        .select(*part, "_base", "_floor")
    )
    so_far = F.max("_lead").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    scanned = ranked.withColumn("_lead", so_far).join(carried, part)
    fixed = (
        F.col("_base")
        + F.col("_rank")
        + F.greatest(F.col("_lead") - F.col("_base"), F.col("_floor"))
    )
    raised = fixed > F.col("_start")
    return scanned.select(
        *[c for c in samples.columns if c not in ("pts", "dts")],
        F.when(raised, F.greatest(F.col("pts"), fixed)).otherwise(F.col("pts")).alias("pts"),
        fixed.alias("dts"),
        (F.col("dts") != fixed).alias("changed"),
    )


def _pts_steps(samples: DataFrame, chunk_ticks: int) -> DataFrame:
    """One row per distinct video pts: how often it occurs and the distinct pts before it."""
    times = samples.filter("is_video").groupBy("clip_id", "pts").agg(F.count("*").alias("copies"))
    return running(
        times,
        CLIP,
        chunk_of("pts", chunk_ticks),
        ["pts"],
        {"prev_pts": running_last("pts", inclusive=False)},
    )


def cadence_gaps(samples: DataFrame, clips: DataFrame, chunk_ticks: int = CHUNK_TICKS) -> DataFrame:
    """Places where the sorted pts of a clip do not start at 0 or do not step by one frame."""
    steps = attach(
        _pts_steps(samples, chunk_ticks),
        clips.select("clip_id", "fps_den"),
        CLIP,
        chunk_of("pts", chunk_ticks),
    )
    wrong_start = F.col("prev_pts").isNull() & (F.col("pts") != 0)
    wrong_step = F.col("pts") - F.col("prev_pts") != F.col("fps_den")
    return steps.filter(
        wrong_start | F.coalesce(wrong_step, F.lit(False)) | (F.col("copies") > 1)
    ).select("clip_id", "prev_pts", "pts", "copies")


def cadence(samples: DataFrame, clips: DataFrame, chunk_ticks: int = CHUNK_TICKS) -> DataFrame:
    """Per clip: do the sorted pts start at 0, step by one frame, and number ``frame_count``?"""
    counted = video_count(samples)
    wrong = (
        cadence_gaps(samples, clips, chunk_ticks)
        .groupBy("clip_id")
        .agg(F.count("*").alias("bad_steps"))
    )
    zero = _long(0)
    bad = F.coalesce("bad_steps", zero)
    have = F.coalesce("video_packets", zero)
    return (
        clips.select("clip_id", "frame_count")
        .join(counted, "clip_id", "left")
        .join(wrong, "clip_id", "left")
        .select(
            "clip_id",
            have.alias("video_packets"),
            bad.alias("bad_steps"),
            ((bad == 0) & (have == F.col("frame_count"))).alias("ok"),
        )
    )


def frame_duration(
    samples: DataFrame, method: str = "run", chunk_ticks: int = CHUNK_TICKS
) -> DataFrame:
    """Ticks per frame of each clip, guessed from the gaps of its sorted positive video pts.

    ``run``: the gap of the longest run of equal gaps, the first one on a tie. ``mode``: the most
    frequent gap, the smallest on a tie. A clip without gaps gets 1.

    Runs are found inside chunks; only the first and last run of a chunk and the gap that joins two
    chunks can belong to a longer run, so only those few rows go through a per-clip window.
    """
    everyone = samples.select("clip_id").distinct()
    times = samples.filter("is_video and pts > 0").select("clip_id", "pts").distinct()
    if method == "mode":
        best = (
            running(
                times,
                CLIP,
                chunk_of("pts", chunk_ticks),
                ["pts"],
                {"_prev": running_last("pts", inclusive=False)},
            )
            .filter("_prev is not null")
            .groupBy("clip_id", (F.col("pts") - F.col("_prev")).alias("gap"))
            .agg(F.count("*").alias("n"))
            .groupBy("clip_id")
            .agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("gap"))
        )
    elif method == "run":
        best = (
            _gap_runs(times, chunk_ticks)
            .groupBy("clip_id")
            .agg(F.max_by("gap", F.struct("n", -F.col("at"))).alias("gap"))
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    return everyone.join(best, "clip_id", "left").select(
        "clip_id", F.coalesce("gap", _long(1)).alias("frame_ticks")
    )


def _gap_runs(times: DataFrame, chunk_ticks: int) -> DataFrame:
    """Runs of equal gaps between distinct pts: ``clip_id, at, gap, n``.

    Of the runs that lie within a chunk only the best inner one is kept.
    """
    part = ["clip_id", "_chunk"]
    inside = Window.partitionBy(*part).orderBy("pts")
    runs = (
        times.withColumn("_chunk", chunk_of("pts", chunk_ticks))
        .withColumn("gap", F.col("pts") - F.lag("pts").over(inside))
        .withColumn("_new", F.when(F.col("gap") == F.lag("gap").over(inside), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*part, "_run")
        .agg(
            F.first("gap").alias("gap"),
            F.count("*").alias("n"),
            F.min("pts").alias("at"),
            F.max("pts").alias("end"),
        )
    )
    # Run 1 is the first pts of the chunk, which has no gap inside it; run 2 is its first real run.
    last_run = F.max("_run").over(Window.partitionBy(*part))
    run = F.struct("gap", "n", "at")
    real = F.col("gap").isNotNull()
    inner = real & (F.col("_run") > 2) & (F.col("_run") < F.col("_last"))
    by_clip = Window.partitionBy("clip_id").orderBy("_chunk")
    chunks = (
        runs.withColumn("_last", last_run)
        .groupBy(*part)
        .agg(
            F.min("at").alias("_from"),
            F.max("end").alias("_to"),
            F.min_by(run, F.when(real, F.col("_run"))).alias("_head"),
            F.max(F.when(real & (F.col("_run") > 2), F.struct("_run", run.alias("r")))).alias("_tail"),
            F.max(F.when(inner, F.struct("n", (-F.col("at")).alias("m"), run.alias("r")))).alias("_best"),
        )
        .withColumn("_joint", F.col("_from") - F.lag("_to").over(by_clip))
    )
    one = F.lit(1).cast("bigint")
    piece = lambda r, tail, inner: F.when(
        r["gap"].isNotNull(),
        F.struct(
            r["gap"].alias("gap"),
            r["n"].alias("n"),
            r["at"].alias("at"),
            F.lit(tail).alias("tail"),
            F.lit(inner).alias("inner"),
        ),
    )
    joint = F.struct(F.col("_joint").alias("gap"), one.alias("n"), F.col("_from").alias("at"))
    pieces = F.array(
        piece(joint, False, False),
        piece(F.col("_head"), False, False),
        piece(F.col("_tail.r"), True, False),
        piece(F.col("_best.r"), False, True),
    )
    along = Window.partitionBy("clip_id", "inner").orderBy("at")
    # A run goes on from the piece before it when the gaps are equal. The last run of a chunk never
    # continues its first one: others lie between, or the gaps differ.
    goes_on = ~F.col("tail") & ~F.col("inner") & (F.col("gap") == F.lag("gap").over(along))
    return (
        chunks.select("clip_id", F.explode(pieces).alias("p"))
        .filter("p is not null")
        .select("clip_id", "p.*")
        .withColumn("_new", F.when(goes_on, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("clip_id", "inner", "_run")
        .agg(F.first("gap").alias("gap"), F.sum("n").alias("n"), F.min("at").alias("at"))
    )

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clipledger.operators import arrivals as N
from clipledger.operators import timeline as T
from clipledger.session import scratch_path
from clipledger.sources import archive as A
from clipledger.sources import samplelog
from clipledger.streaming import streams as S
from clipledger.streaming.carry import drain_append, drain_update
from tests import models
from tests.data import by_clip, frame_of, random_archive
from tests.test_audio_arrivals import arrivals
from tests.test_sources import log_bytes


def feed(spark, stream, parts):
    """Run a carried stream over one micro-batch per part, with a new query for each."""
    folder = scratch_path(spark, "feed")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(part.schema).parquet(folder)
        stream.start(source).awaitTermination()
    return stream.result()


def int_clips(rows, schema, spark):
    return spark.createDataFrame([(int(r[0][1:]), *r[1:]) for r in rows], schema)


def test_dedup_stream_equals_batch(spark):
    rows = arrivals(5, clips=30)
    df = int_clips(rows, "clip_id bigint, arrival bigint, n bigint", spark)
    parts = [df.filter(f"arrival >= {a} and arrival < {b}") for a, b in ((0, 3), (3, 4), (4, 99))]
    got = by_clip(feed(spark, S.ordered_dedup_stream(spark, 4), parts), "arrival", "n")
    assert got == by_clip(N.ordered_dedup(df), "arrival", "n")


def test_text_ids_and_an_empty_stream(spark):
    empty = S.ordered_dedup_stream(spark, clip_type="string")
    assert empty.result().columns == ["clip_id", "arrival", "n"] and empty.result().count() == 0
    rows = spark.createDataFrame([("/a.mov", i, n) for i, n in enumerate((0, 2, 1, 3))], "clip_id string, arrival bigint, n bigint")
    got = feed(spark, empty, [rows.filter("arrival < 2"), rows.filter("arrival >= 2")])
    assert sorted(r.n for r in got.collect()) == [0, 2, 3]
    log = spark.createDataFrame([("/a.mov", i, True, 1, i) for i in range(4)], "clip_id string, seq bigint, is_video boolean, size bigint, pts bigint")
    assert feed(spark, S.checkpoint_stream(spark, 2, clip_type="string"), [log]).count() == 3
    late = spark.createDataFrame([("/a.mov", n) for n in (1, 0, 3)], "clip_id string, n bigint").withColumn("ts", F.current_timestamp())
    out = feed(spark, S.reorder_stream(spark, clip_type="string"), [late])
    assert sorted(r.n for r in out.collect()) == [0, 1]


def test_rows_out_of_order_end_a_stream(spark):
    one = spark.createDataFrame([(1, 5, 4), (2, 1, 2)], "clip_id bigint, arrival bigint, n bigint")
    late = spark.createDataFrame([(1, 5, 9)], one.schema)
    stream = S.ordered_dedup_stream(spark)
    stream._run(one, 0)
    stream._run(one.filter("clip_id = 2").withColumn("arrival", F.lit(2).cast("bigint")), 1)
    with pytest.raises(ValueError, match="comes after 5"):
        stream._run(late, 2)


def test_time_of_gaps_never_runs_backwards(spark):
    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    schema = "clip_id bigint, n bigint, ts timestamp"
    stream = S.reorder_stream(spark, timeout_s=10)
    stream._run(spark.createDataFrame([(1, 0, at(100))], schema), 0)
    # An old row waits since its own time, seen from the newest time so far.
    stream._run(spark.createDataFrame([(1, 2, at(50))], schema), 1)
    assert sorted((r.n, r.event) for r in stream.result().collect()) == [(0, "released"), (1, "gap")]


def test_repeated_batch_counts_once(spark):
    stream = S.ordered_dedup_stream(spark)
    one = spark.createDataFrame([(1, 0, 4), (1, 1, 2)], "clip_id bigint, arrival bigint, n bigint")
    two = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (1, 4, 9)], one.schema)
    stream._run(one, 0)
    stream._run(two, 1)
    stream._run(two, 1)
    assert sorted(r.n for r in stream.result().collect()) == [4, 5, 9]


def test_reorder_stream(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows, numbers = [], {}
    for clip in range(12):
        line = [n for n in range(12) if not (clip % 3 == 0 and n == 6)]
        line.sort(key=lambda n: n + rng.random() * 4)
        line += [line[0], 2]
        numbers[clip] = line
        rows += [(clip, n, start + timedelta(seconds=i)) for i, n in enumerate(line)]
    df = spark.createDataFrame(rows, "clip_id bigint, n bigint, ts timestamp")
    cut = [start + timedelta(seconds=s) for s in (0, 4, 8, 12, 99)]
    parts = [df.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cut, cut[1:])]
    out = feed(spark, S.reorder_stream(spark, timeout_s=3, chunk_rows=4), parts)
    got = by_clip(out.filter("event = 'released'"), "n")
    for clip, line in numbers.items():
        assert [n for (n,) in got[clip]] == models.released(line, 0)
    gaps = by_clip(out.filter("event = 'gap' and n = 6"), "n")
    assert gaps == {clip: [(6,)] for clip in numbers if clip % 3 == 0}


def test_checkpoint_stream_equals_batch(spark):
    archive = random_archive(71, clips=15)
    df = frame_of(spark, archive).withColumn("clip_id", F.substring("clip_id", 2, 9).cast("bigint"))
    parts = [df.filter(f"seq >= {a} and seq < {b}") for a, b in ((0, 7), (7, 8), (8, 30), (30, 999))]
    cuts = by_clip(feed(spark, S.checkpoint_stream(spark, 5, 2, 4), parts), "after_seq", "video_frames", "audio_end_sample")
    for clip, log in archive.items():
        want, videos, audio = [(-1, 0, 0)], 0, 0
        for p in log:
            if p["is_video"]:
                videos += 1
                if videos % 5 == 0:
                    want.append((p["seq"], videos, audio))
            else:
                audio = max(audio, p["pts"] + int(p["size"] / 6))
        assert cuts[int(clip[1:])] == want


def test_growing_logs_and_resume_stream(spark, tmp_path):
    samplelog.register(spark)
    archive = {c: [{**p, "size": abs(p["size"])} for p in log] for c, log in random_archive(81, clips=6).items()}
    bounds = spark.createDataFrame(
        [(c, 7, 7 + sum(p["size"] for p in log) * 2 // 3) for c, log in archive.items()],
        "clip_id string, data_start bigint, data_bound bigint",
    )
    stream = S.resume_stream(spark, bounds, chunk_rows=4, clip_type="string")
    folder = str(tmp_path / "logs")
    (tmp_path / "logs").mkdir()
    for step in (0.3, 0.5, 1.0):
        for clip, log in archive.items():
            raw = log_bytes(log)
            torn = raw if step == 1.0 else raw[: 8 + int((len(raw) - 8) * step)]
            (tmp_path / "logs" / f"{clip}.samples").write_bytes(torn)
        growing = spark.readStream.format("samplelog").option("clipId", "name").load(folder)
        stream.start(growing).awaitTermination()
    got = by_clip(stream.result(), "seq", "size", "offset")
    batch = T.complete_prefix(frame_of(spark, archive), bounds)
    assert got == by_clip(batch, "seq", "size", "offset")
    clips = spark.createDataFrame(
        [(c, 10, i % 2) for i, c in enumerate(archive)], "clip_id string, fps_den bigint, open_gop int"
    )
    points = {r.clip_id: r.resume_frame for r in S.resume_now(stream, clips).collect()}
    assert points == {r.clip_id: r.resume_frame for r in T.resume_point(T.mark_complete(frame_of(spark, archive), bounds), clips).collect()}
    again = spark.readStream.format("samplelog").option("clipId", "name").load(folder)
    assert drain_append(again).count() == sum(map(len, archive.values()))


def test_progress_stream_equals_batch(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [
        (rng.randint(0, 4), start + timedelta(milliseconds=rng.randint(0, 40_000)), i, 400, 24, 1, 2.5)
        for i in range(300)
    ]
    df = spark.createDataFrame(
        rows, "clip_id bigint, ts timestamp, done bigint, total bigint, fps_num int, fps_den int, fps double"
    )
    folder = scratch_path(spark, "ticks")
    df.coalesce(1).write.parquet(folder)
    out = drain_append(S.progress_stream(spark.readStream.schema(df.schema).parquet(folder), late="0 seconds"))
    pick = lambda d: {(r.clip_id, r.window_start): (r.done, r.left_text) for r in d.collect()}
    stream, batch = pick(out), pick(S.progress_stream(df))
    last = max(r[1] for r in rows)
    closed = {k: v for k, v in batch.items() if k[1].replace(tzinfo=timezone.utc) + timedelta(seconds=2) <= last}
    assert stream == closed and len(closed) > 80
    # Update mode tells the open window too.
    live = S.progress_stream(spark.readStream.schema(df.schema).parquet(folder))
    assert pick(drain_update(live, ["clip_id", "window_start"])) == batch


def test_intake_reports_each_source_once(spark, tmp_path):
    for name in ("a.NEV", "b.nev", "b.h265.mov", "b.h265.mov.sidecar.json", "c.txt"):
        (tmp_path / name).write_text(name)
    stream = S.intake_stream(spark, lambda: A.scan_artifacts(spark, str(tmp_path)))
    stream.start(S.source_files(spark, str(tmp_path))).awaitTermination()
    assert [r.reason for r in stream.result().collect()] == ["new"]
    (tmp_path / "d.NEV").write_text("later")
    (tmp_path / "d.h265.mov").write_text("half")
    stream.start(S.source_files(spark, str(tmp_path))).awaitTermination()
    got = sorted((r.path.rsplit("/", 1)[1], r.reason) for r in stream.result().collect())
    assert got == [("a.NEV", "new"), ("d.NEV", "no sidecar")]


@pytest.mark.parametrize("n", [5, 20])
def test_checkpoint_interval(spark, n):
    rows = [(1, i, True, 1, i) for i in range(45)]
    df = spark.createDataFrame(rows, "clip_id bigint, seq bigint, is_video boolean, size bigint, pts bigint")
    out = feed(spark, S.checkpoint_stream(spark, n), [df])
    assert sorted(r.video_frames for r in out.collect()) == list(range(0, 46, n))

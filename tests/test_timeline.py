import random

import pytest
from pyspark.sql import functions as F

from clipledger.operators import timeline as T
from tests import models
from tests.data import DEN, by_clip, frame_of, random_archive

WIDTHS = [3, 16, 1 << 18]


def bounds_of(spark, archive, seed=1):
    rng = random.Random(seed)
    rows = []
    for clip, log in archive.items():
        total = sum(max(p["size"], 0) for p in log)
        rows.append((clip, 100, 100 + rng.choice([-5, 0, total // 3, int(total * 0.8), total, total + 9])))
    return rows, spark.createDataFrame(rows, "clip_id string, data_start bigint, data_bound bigint")


@pytest.mark.parametrize("width", WIDTHS)
def test_offsets(spark, width):
    archive = random_archive(1)
    got = by_clip(T.offsets(frame_of(spark, archive), 5, width), "seq", "offset")
    for clip, log in archive.items():
        assert got[clip] == [(i, 5 + o) for i, o in enumerate(models.offsets(log))]


@pytest.mark.parametrize("width", WIDTHS)
def test_complete_prefix_both_ways(spark, width):
    archive = random_archive(2)
    rows, bounds = bounds_of(spark, archive)
    df = frame_of(spark, archive)
    flagged = by_clip(T.flag_complete(df, bounds, width), "seq", "is_complete")
    steps = (width * 4, width, 1)
    marked = by_clip(T.mark_by_cut(df, bounds, steps), "seq", "is_complete")
    short = by_clip(T.mark_complete(df, bounds), "seq", "is_complete")
    for clip, start, bound in rows:
        want = list(enumerate(models.complete(archive[clip], start, bound)))
        assert flagged[clip] == want
        assert marked[clip] == want
        assert short[clip] == want
    counted = {r.clip_id: r.complete_packets for r in T.count_complete(T.mark_complete(df, bounds)).collect()}
    assert counted == {c: sum(models.complete(archive[c], s, b)) for c, s, b in rows}


def test_cut_steps_must_nest(spark):
    archive = random_archive(3, clips=3)
    _, bounds = bounds_of(spark, archive)
    for widths in ((3, 2, 1), (8, 4)):
        with pytest.raises(ValueError):
            T.complete_cut(frame_of(spark, archive), bounds, widths)


def test_clip_without_bounds_has_nothing_complete(spark):
    archive = random_archive(3, clips=3)
    _, bounds = bounds_of(spark, archive)
    df, known = frame_of(spark, archive), bounds.filter("clip_id <> 'c1'")
    for out in (T.flag_complete(df, known), T.mark_by_cut(df, known)):
        assert out.filter("clip_id = 'c1'").count() == len(archive["c1"])
        assert out.filter("clip_id = 'c1' and is_complete").count() == 0


def marked_archive(spark, seed):
    archive = random_archive(seed, clips=200)
    rows, bounds = bounds_of(spark, archive, seed)
    kept = {
        c: [p for p, ok in zip(archive[c], models.complete(archive[c], s, b)) if ok]
        for c, s, b in rows
    }
    clips = spark.createDataFrame(
        [(c, i % 2, DEN, 2, 40) for i, c in enumerate(archive)],
        "clip_id string, open_gop int, fps_den bigint, channels bigint, frame_count bigint",
    )
    return archive, kept, T.mark_by_cut(frame_of(spark, archive), bounds), clips


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("seed", [11, 12])
def test_resume_point(spark, width, seed):
    _, kept, marked, clips = marked_archive(spark, seed)
    got = {r.clip_id: r.resume_frame for r in T.resume_point(marked, clips, width).collect()}
    want = {c: models.resume_point(kept[c], i % 2, DEN) for i, c in enumerate(kept)}
    assert got == want
    assert len(set(want.values())) > 5 and 0 in want.values()


def test_resume_point_without_broadcast(spark, no_broadcast):
    test_resume_point(spark, 4, 13)


def test_resume_report(spark):
    _, kept, marked, clips = marked_archive(spark, 14)
    rows = {r.clip_id: r for r in T.resume_report(marked, clips).collect()}
    assert len(rows) == len(kept)
    for i, (clip, log) in enumerate(kept.items()):
        row, video = rows[clip], [p for p in log if p["is_video"]]
        resume = models.resume_point(log, i % 2, DEN)
        assert row.complete_packets == len(log)
        assert row.video_frames == min(len(video), 40)
        assert row.resume_frame == resume
        audio = max([p["pts"] + p["size"] // 6 for p in log if not p["is_video"]], default=0)
        assert row.resume_sample == (audio if resume else 0)
        assert row.reason == (
            "no complete video" if not video else "resume" if resume else "first group only"
        )


@pytest.mark.parametrize("width", WIDTHS)
def test_monotone(spark, width):
    archive = random_archive(21)
    got = by_clip(T.monotone_dts(frame_of(spark, archive), width), "seq", "pts", "dts")
    for clip, log in archive.items():
        video = [p for p in log if p["is_video"]]
        want = [(p["seq"], *t) for p, t in zip(video, models.monotone(video))]
        assert got.get(clip, []) == want
        dts = [d for _, _, d in want]
        assert all(a < b for a, b in zip(dts, dts[1:]))


@pytest.mark.parametrize("width", WIDTHS)
def test_prefix_max(spark, width):
    archive = random_archive(22)
    df = frame_of(spark, archive).filter("is_video")
    points = df.select("clip_id", (F.col("frame_no") + 1).alias("frame_no"))
    got = by_clip(T.prefix_max(points, df, width), "frame_no", "max_dts")
    for clip, log in archive.items():
        video = [p for p in log if p["is_video"]]
        want = {
            p["frame_no"] + 1: max(
                [q["dts"] for q in video if 0 <= q["frame_no"] <= p["frame_no"]], default=-1
            )
            for p in video
        }
        assert dict(got.get(clip, [])) == want


@pytest.mark.parametrize("width", [4, 20, 1 << 22])
def test_frame_duration(spark, width):
    rng = random.Random(31)
    archive, times = {}, {}
    for i in range(150):
        clip, at = f"d{i}", 0
        times[clip] = []
        for _ in range(rng.randint(0, 30)):
            at += rng.choice([0, 1, 1, 2, 2, 3, 9])
            times[clip].append(at)
        archive[clip] = [
            dict(clip_id=clip, seq=s, is_video=True, size=1, pts=t, dts=t, is_key=False, frame_no=s)
            for s, t in enumerate(rng.sample(times[clip], len(times[clip])))
        ]
    got = {r.clip_id: r.frame_ticks for r in T.frame_duration(frame_of(spark, archive), chunk_ticks=width).collect()}
    assert got == {c: models.frame_duration(t) for c, t in times.items() if t}


def test_longest_run_is_not_the_mode(spark):
    pts = [1, 2, 4, 5, 7, 8, 11, 14]
    log = [
        dict(clip_id="a", seq=i, is_video=True, size=1, pts=p, dts=p, is_key=False, frame_no=i)
        for i, p in enumerate(pts)
    ]
    df = frame_of(spark, {"a": log})
    assert T.frame_duration(df, chunk_ticks=5).first().frame_ticks == 3
    assert T.frame_duration(df, "mode").first().frame_ticks == 1
    with pytest.raises(ValueError):
        T.frame_duration(df, "gcd")


@pytest.mark.parametrize("skip_audio", [False, True])
def test_purge_reorder(spark, skip_audio):
    _, kept, marked, clips = marked_archive(spark, 41)
    resume = spark.createDataFrame(
        [(c, i % 25) for i, c in enumerate(kept)], "clip_id string, resume_frame bigint"
    )
    got = by_clip(T.purge_reorder(marked, resume, skip_audio, 9), "seq", "old_seq", "offset")
    for i, (clip, log) in enumerate(kept.items()):
        rest = [
            p
            for p in log
            if (p["is_video"] and p["frame_no"] < i % 25) or (not p["is_video"] and not skip_audio)
        ]
        rest.sort(key=lambda p: (p["dts"], not p["is_video"]))
        want = [
            (n, p["seq"], 9 + o) for n, (p, o) in enumerate(zip(rest, models.offsets(rest)))
        ]
        assert got.get(clip, []) == want


def test_purge_rescaled_compares_seconds(spark):
    mk = lambda s, v, d: dict(
        clip_id="a", seq=s, is_video=v, size=1, pts=d, dts=d, is_key=True, frame_no=s if v else -1
    )
    # 10 video ticks at 100/s are 0.1 s; 500 audio ticks at 10000/s are 0.05 s.
    df = frame_of(spark, {"a": [mk(0, True, 0), mk(1, True, 10), mk(2, False, 500)]})
    marked = df.withColumn("is_complete", F.lit(True))
    none = spark.createDataFrame([], "clip_id string, resume_frame bigint")
    rates = spark.createDataFrame([("a", 100, 10000)], "clip_id string, fps_num bigint, sample_rate bigint")
    order = lambda out: [r.old_seq for r in out.orderBy("seq").collect()]
    assert order(T.purge_reorder(marked, none)) == [0, 1, 2]
    assert order(T.purge_reorder(marked, none, rescale=rates)) == [0, 2, 1]


def test_session_shift(spark):
    mk = lambda s, v, d, f: dict(
        clip_id="a", seq=s, is_video=v, size=1, pts=d + 3, dts=d, is_key=True, frame_no=f
    )
    old = frame_of(spark, {"a": [mk(0, True, 0, 0), mk(1, True, 30, 2), mk(2, True, 90, 7)]})
    new = frame_of(spark, {"a": [mk(0, True, -4, 5), mk(1, True, 10, 6), mk(2, False, 8, -1)]})
    resume = spark.createDataFrame([("a", 5)], "clip_id string, resume_frame bigint")
    got = by_clip(T.session_shift(old, resume, new), "seq", "dts", "pts", "shift")
    assert got == {"a": [(0, 31, 30, 31), (1, 41, 44, 31), (2, 8, 11, 0)]}
    high = new.withColumn("dts", F.col("dts") + 500)
    assert {r.shift for r in T.session_shift(old, resume, high).collect()} == {0}


@pytest.mark.parametrize("width", [5, 40, 1 << 22])
def test_cadence(spark, width):
    def clip(name, times):
        return [
            dict(clip_id=name, seq=i, is_video=True, size=1, pts=t, dts=t, is_key=False, frame_no=i)
            for i, t in enumerate(times)
        ]

    good = [i * DEN for i in range(12)]
    archive = {
        "good": clip("good", reversed(good)),
        "late": clip("late", good[1:]),
        "gap": clip("gap", good[:4] + good[5:]),
        "twice": clip("twice", good + [30]),
        "short": clip("short", good[:-1]),
    }
    clips = spark.createDataFrame(
        [(c, DEN, 12) for c in [*archive, "none"]], "clip_id string, fps_den bigint, frame_count bigint"
    )
    rows = {r.clip_id: (r.video_packets, r.bad_steps, r.ok) for r in T.cadence(frame_of(spark, archive), clips, width).collect()}
    assert rows == {
        "good": (12, 0, True),
        "late": (11, 1, False),
        "gap": (11, 1, False),
        "twice": (13, 1, False),
        "short": (11, 0, False),
        "none": (0, 0, False),
    }


def test_last_key_is_by_write_order(spark):
    mk = lambda s, f, k: dict(
        clip_id="a", seq=s, is_video=True, size=1, pts=0, dts=0, is_key=k, frame_no=f
    )
    df = frame_of(spark, {"a": [mk(0, 0, True), mk(1, 30, True), mk(2, 12, True), mk(3, 99, False)]})
    assert T.last_key(df).first().last_key_frame == 12


def test_clip_counts(spark):
    archive = random_archive(51, clips=20)
    df = frame_of(spark, archive)
    counts = {r.clip_id: r.video_packets for r in T.video_count(df).collect()}
    ends = {r.clip_id: r.audio_end_sample for r in T.audio_end(df, 2).collect()}
    none = {r.audio_end_sample for r in T.audio_end(df, 0).collect()}
    for clip, log in archive.items():
        assert counts[clip] == sum(p["is_video"] for p in log)
        want = max([p["pts"] + int(p["size"] / 6) for p in log if not p["is_video"]], default=0)
        assert ends[clip] == max(want, 0)
    assert none == {0}


def test_bucketed_log_needs_no_shuffle(spark, tmp_path, no_broadcast):
    archive = random_archive(61)
    df = frame_of(spark, archive)
    table = T.write_log_table(df, "bucketed_log", 4, str(tmp_path / "log"), chunk_rows=8)
    out = T.offsets(table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 2 and all("Bucketed: true" in line for line in scans)
    # The one exchange left moves chunk totals to their clip and back.
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(moved) == 2, plan
    got = by_clip(out, "seq", "offset")
    for clip, log in archive.items():
        assert got[clip] == list(enumerate(models.offsets(log)))
    spark.sql("drop table bucketed_log")


def test_rows_without_place_are_left_out(spark):
    schema = "clip_id string, seq bigint, is_video boolean, size bigint, pts bigint, dts bigint, is_key boolean, frame_no bigint"
    rows = [("a", 0, True, 5, 0, 0, True, 0), ("a", None, True, 5, 0, 0, True, 0), (None, 1, True, 5, 0, 0, True, 0), ("a", 1, True, 9, 0, 0, True, 0)]
    log = spark.createDataFrame(rows, schema)
    bounds = spark.createDataFrame([("a", 0, 6)], "clip_id string, data_start bigint, data_bound bigint")
    for marked in (T.mark_complete(log, bounds), T.mark_by_cut(log, bounds, (4, 2, 1))):
        assert sorted((r.clip_id, r.seq, r.is_complete) for r in marked.collect()) == [("a", 0, True), ("a", 1, False)]


def test_resume_report_reads_the_log_once(spark, tmp_path, no_broadcast):
    """The log is scanned for the totals of its chunks and for its rows, and no more."""
    archive = random_archive(17, clips=20)
    frame_of(spark, archive).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    clips = spark.createDataFrame(
        [(c, 10, i % 2, 2, 40) for i, c in enumerate(archive)],
        "clip_id string, fps_den bigint, open_gop int, channels int, frame_count bigint",
    )
    bounds = spark.createDataFrame([(c, 0, 60) for c in archive], "clip_id string, data_start bigint, data_bound bigint")
    report = T.resume_report(T.mark_complete(log, bounds), clips)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "size#" in line]
    assert 1 <= len(scans) <= 3

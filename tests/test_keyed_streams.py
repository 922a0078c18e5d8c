"""Streams on keyed state against the batch operators and plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clipledger.operators import arrivals as N
from clipledger.operators import timeline as T
from clipledger.streaming import keyed as K
from tests import models
from tests.data import by_clip, frame_of, random_archive
from tests.test_audio_arrivals import arrivals
from tests.test_streams import feed, int_clips

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_dedup_equals_batch(spark, pack_rows=2):
    df = int_clips(arrivals(5, clips=30), "clip_id bigint, arrival bigint, n bigint", spark)
    parts = [df.filter(f"arrival >= {a} and arrival < {b}") for a, b in ((0, 3), (3, 4), (4, 99))]
    got = feed(spark, K.keyed_dedup(spark, pack_rows=pack_rows), parts)
    assert by_clip(got, "arrival", "n") == by_clip(N.ordered_dedup(df), "arrival", "n")


def test_chunks_that_reach_into_each_other(spark):
    """One clip dealt over tasks at random: chunks overlap and are merged."""
    rng = random.Random(3)
    rows = [(1, i, rng.randrange(400)) for i in range(300)]
    df = spark.createDataFrame(rows, "clip_id bigint, arrival bigint, n bigint")
    stream = K.keyed_dedup(spark, pack_rows=7)
    folder = f"{stream.folder}/feed"
    df.repartition(5).write.parquet(folder)
    got = stream.drain(spark.readStream.schema(df.schema).parquet(folder))
    assert by_clip(got, "arrival", "n") == by_clip(N.ordered_dedup(df), "arrival", "n")


def test_rows_out_of_order_end_the_stream(spark):
    schema = "clip_id bigint, arrival bigint, n bigint"
    one = spark.createDataFrame([(1, 5, 4), (2, 1, 2), (None, 9, 9)], schema)
    with pytest.raises(Exception, match="comes after 5"):
        feed(spark, K.keyed_dedup(spark), [one, one.filter("clip_id = 2").withColumn("arrival", F.lit(2).cast("bigint")), spark.createDataFrame([(1, 5, 9)], schema)])


def test_empty_stream_and_text_ids(spark):
    stream = K.keyed_dedup(spark, "string")
    assert stream.result().columns == ["clip_id", "arrival", "n"] and stream.result().count() == 0
    rows = spark.createDataFrame([("/a.mov", i, n) for i, n in enumerate((0, 2, 1, None, 3))], "clip_id string, arrival bigint, n bigint")
    got = feed(spark, stream, [rows.filter("arrival < 2"), rows.filter("arrival >= 2")])
    assert sorted(r.n for r in got.collect()) == [0, 2, 3]


def test_checkpoints_equal_loops(spark, pack_rows=3):
    archive = random_archive(71, clips=15)
    df = frame_of(spark, archive).withColumn("clip_id", F.substring("clip_id", 2, 9).cast("bigint"))
    parts = [df.filter(f"seq >= {a} and seq < {b}") for a, b in ((0, 7), (7, 8), (8, 30), (30, 999))]
    stream = K.keyed_checkpoints(spark, 5, 2, pack_rows=pack_rows)
    cuts = by_clip(feed(spark, stream, parts), "after_seq", "video_frames", "audio_end_sample")
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


def test_resume_equals_batch(spark):
    archive = random_archive(81, clips=8)
    df = frame_of(spark, archive)
    bounds = spark.createDataFrame(
        [(c, 7, 7 + sum(max(p["size"], 0) for p in log) * 2 // 3) for c, log in archive.items()],
        "clip_id string, data_start bigint, data_bound bigint",
    )
    parts = [df.filter(f"seq >= {a} and seq < {b}") for a, b in ((0, 9), (9, 10), (10, 25), (25, 999))]
    got = by_clip(feed(spark, K.keyed_resume(spark, bounds, pack_rows=4), parts), "seq", "size", "offset")
    want = by_clip(T.complete_prefix(df, bounds), "seq", "size", "offset")
    assert got == want and want


def test_state_of_other_clips_is_not_written(spark):
    """A batch of one clip writes the state of that clip, whatever others there are."""
    schema = "clip_id bigint, arrival bigint, n bigint"
    stream = K.keyed_dedup(spark)
    first = spark.createDataFrame([(c, 0, 1) for c in range(500)], schema)
    folder, updated = f"{stream.folder}/feed", []
    for part in (first, spark.createDataFrame([(3, 1, 2)], schema), spark.createDataFrame([(3, 2, 3), (4, 2, 9)], schema)):
        part.coalesce(1).write.mode("append").parquet(folder)
        query = stream.start(spark.readStream.schema(schema).parquet(folder))
        query.awaitTermination()
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        updated.append(sum(s["numRowsUpdated"] for s in states))
    assert updated == [500, 1, 2]


# --- reorder ------------------------------------------------------------------------------------------


def test_reorder_equals_loops(spark):
    rng = random.Random(8)
    rows, numbers = [], {}
    for clip in range(12):
        line = [n for n in range(12) if not (clip % 3 == 0 and n == 6)]
        line.sort(key=lambda n: n + rng.random() * 4)
        line += [line[0], 2, -4]
        numbers[clip] = line
        rows += [(clip, n, at(i)) for i, n in enumerate(line)]
    df = spark.createDataFrame(rows, "clip_id bigint, n bigint, ts timestamp")
    parts = [df.filter((F.col("ts") >= at(a)) & (F.col("ts") < at(b))) for a, b in ((0, 4), (4, 8), (8, 12), (12, 99))]
    out = feed(spark, K.keyed_reorder(spark, timeout_s=3), parts)
    got = by_clip(out.filter("event = 'released'"), "n")
    for clip, line in numbers.items():
        assert [n for (n,) in got[clip]] == models.released(line, 0)
    gaps = by_clip(out.filter("event = 'gap' and n = 6"), "n")
    assert gaps == {clip: [(6,)] for clip in numbers if clip % 3 == 0}


def test_gap_comes_without_new_rows_of_its_clip(spark):
    schema = "clip_id bigint, n bigint, ts timestamp"
    stream = K.keyed_reorder(spark, timeout_s=10)
    stuck = spark.createDataFrame([(1, 0, at(0)), (1, 2, at(1)), (1, 3, at(2))], schema)
    other = lambda s: spark.createDataFrame([(2, s, at(s))], schema)
    seen = lambda: sorted((r.clip_id, r.n, r.event) for r in stream.result().filter("clip_id = 1").collect())
    feed(spark, stream, [stuck, other(9)])
    assert seen() == [(1, 0, "released")]
    # Eleven seconds after the first held number nothing is over yet: it has waited ten.
    feed_more(spark, stream, other(11))
    assert seen() == [(1, 0, "released")]
    feed_more(spark, stream, other(12))
    assert seen() == [(1, 0, "released"), (1, 1, "gap")]
    # The gap is told once; when the number comes after all, the held ones go on.
    feed_more(spark, stream, other(40))
    assert len(seen()) == 2
    feed_more(spark, stream, spark.createDataFrame([(1, 1, at(3)), (1, 7, at(41))], schema))
    assert seen() == [(1, 0, "released"), (1, 1, "gap"), (1, 1, "released"), (1, 2, "released"), (1, 3, "released")]
    feed_more(spark, stream, other(60))
    assert (1, 4, "gap") in seen() and len(seen()) == 6


def feed_more(spark, stream, part):
    feed(spark, _Again(stream), [part])


class _Again:
    """A started stream goes on with one more file of its own feed."""

    def __init__(self, stream):
        self.stream = stream

    def start(self, source):
        return self.stream.start(source)

    def result(self):
        return self.stream.result()


def test_held_runs_are_not_written_again(spark):
    schema = "clip_id bigint, n bigint, ts timestamp"
    stream, folder, updated = K.keyed_reorder(spark), None, []
    folder = f"{stream.folder}/feed"
    early = spark.createDataFrame([(1, 10 * i, at(i)) for i in range(1, 200)], schema)
    for part in (early, spark.createDataFrame([(1, 5, at(300))], schema), spark.createDataFrame([(1, 0, at(301))], schema)):
        part.coalesce(1).write.mode("append").parquet(folder)
        query = stream.start(spark.readStream.schema(schema).parquet(folder))
        query.awaitTermination()
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        updated.append(sum(s["numRowsUpdated"] for s in states))
    # 199 runs and the facts; then one run and the facts; then the facts alone.
    assert updated[0] >= 199 and updated[1] <= 4 and updated[2] <= 4
    assert [r.n for r in stream.result().collect()] == [0]


def test_number_runs(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, *range(30)]), rng.randrange(1000)) for _ in range(200)]
    df = spark.createDataFrame(rows, "clip_id bigint, n bigint, since bigint").coalesce(1)
    runs = df.mapInArrow(K.number_runs, "clip_id bigint, low bigint, high bigint, since bigint").collect()
    have = {(c, n): min(s for k, m, s in rows if (k, m) == (c, n)) for c, n, _ in rows if c and n is not None}
    assert {(r.clip_id, n) for r in runs for n in range(r.low, r.high + 1)} == set(have)
    assert all(r.since == min(have[r.clip_id, n] for n in range(r.low, r.high + 1)) for r in runs)
    assert len({(r.clip_id, r.low) for r in runs}) == len(runs) and not {(r.clip_id, r.high + 1) for r in runs} & set(have)


# --- intake -------------------------------------------------------------------------------------------


def test_intake_tells_each_source_once(spark, tmp_path):
    from clipledger.operators.artifacts import pending
    from clipledger.sources import archive as A

    for name in ("a.NEV", "b.nev", "b.h265.mov", "b.h265.mov.sidecar.json", "c.txt", "e.h265.mov", "e.h265.mov.sidecar.json"):
        (tmp_path / name).write_text(name)
    stream = K.keyed_intake(spark)
    go = lambda: stream.start(K.archive_files(spark, str(tmp_path))).awaitTermination()
    told = lambda: sorted((r.path.rsplit("/", 1)[1], r.reason) for r in stream.result().collect())
    go()
    assert told() == [("a.NEV", "new")]
    sources = spark.createDataFrame([(str(tmp_path / n), True) for n in ("a.NEV", "b.nev")], "path string, is_regular boolean")
    batch = pending(sources, A.scan_artifacts(spark, str(tmp_path))).collect()
    assert [(r.path, r.clip_key, r.reason) for r in stream.result().collect()] == [tuple(r) for r in batch]
    # The side files of e came in the first batch and are remembered; d has half of them.
    for name in ("d.NEV", "d.h265.mov", "e.NEV", "a.h265.mov"):
        (tmp_path / name).write_text("later")
    go()
    assert told() == [("a.NEV", "new"), ("d.NEV", "no sidecar")]

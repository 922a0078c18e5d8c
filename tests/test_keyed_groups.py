"""Streams over many clips with few rows each, which travel by groups."""

import random

from pyspark.sql import functions as F

from clipledger.operators import timeline as T
from clipledger.streaming import keyed as K
from tests.data import by_clip, frame_of, random_archive
from tests.test_streams import feed


def test_many_clips_travel_in_few_rows(spark, monkeypatch):
    """There was a row for each clip of a chunk, so 6 M arrivals of 90,000 clips made millions."""
    kept = {}
    monkeypatch.setattr(K, "carried_plan", lambda rows, carried, *rest, **more: kept.update(carried=carried) or rows)
    df = spark.range(0, 20000, 1, 1).selectExpr("id % 5000 clip_id", "id arrival", "id * 7 % 31 n")
    rows = K.keyed_dedup(spark).plan(df)
    packed = rows.select("*", K._bucket()).mapInArrow(K._packer(kept["carried"], 64), "bucket int, facts binary, rows binary")
    assert packed.count() <= K.BUCKETS


def test_packets_dealt_at_random_over_files_and_batches(spark):
    """Chunks of many clips reach into each other in a batch, and go on in the next."""
    archive = random_archive(91, clips=40)
    df = frame_of(spark, archive)
    bounds = spark.createDataFrame(
        [(c, 7, 7 + sum(max(p["size"], 0) for p in log) * 2 // 3) for c, log in archive.items() if c != "c3"],
        "clip_id string, data_start bigint, data_bound bigint",
    )
    rng = random.Random(2)
    streams = {
        "resume": (K.keyed_resume(spark, bounds, pack_rows=4), ("seq", "size", "offset")),
        "cuts": (K.keyed_checkpoints(spark, 5, 2, "string", pack_rows=3), ("after_seq", "video_frames", "audio_end_sample")),
    }
    got, whole = {}, {}
    for name, (stream, columns) in streams.items():
        folder = f"{stream.folder}/feed"
        for low, high in ((0, 20), (20, 999)):
            df.filter(f"seq >= {low} and seq < {high}").repartition(5, F.rand(rng.randrange(99))).write.mode("append").parquet(folder)
            stream.start(spark.readStream.schema(df.schema).parquet(folder)).awaitTermination()
        got[name] = by_clip(stream.result(), *columns)
    assert got["resume"] == by_clip(T.complete_prefix(df, bounds), "seq", "size", "offset") and "c3" not in got["resume"]
    again = K.keyed_checkpoints(spark, 5, 2, "string")
    whole["cuts"] = by_clip(feed(spark, again, [df.filter(f"seq >= {a} and seq < {b}") for a, b in ((0, 20), (20, 999))]), *streams["cuts"][1])
    assert got["cuts"] == whole["cuts"] and len(got["cuts"]) == 40

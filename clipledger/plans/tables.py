"""The driver's tables seen as archive tables.

A user of ``events`` is a clip and each event a packet; purchases are audio, the rest is video whose
frames are written in the order 0, 3, 1, 2 within groups of four, with a key frame every twelve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.plans.scan import idiv, ordered_chunks, running, running_count
from clipledger.session import store

FPS_NUM, FPS_DEN, SAMPLE_RATE, CHANNELS = 60000, 1001, 48000, 2
DATA_START = 40

_samples: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_samples(events: DataFrame) -> DataFrame:
    """The packet log of each user, in the order (ts, event_id)."""
    packets = events.select(
        F.col("user_id").alias("clip_id"),
        "event_id",
        "ts",
        "value",
        (F.col("event_type") != "purchase").alias("is_video"),
    )
    ranked = running(
        ordered_chunks(packets, ["clip_id", "ts", "event_id"]),
        ["clip_id"],
        "order_chunk",
        ["ts", "event_id"],
        {
            "seq": running_count(inclusive=False),
            "_upto": running_count("is_video"),
        },
    ).withColumn("_v", F.col("_upto") - 1)
    group = idiv(F.greatest("_v", F.lit(0)), F.lit(4).cast("bigint"))
    phase = F.pmod("_v", F.lit(4))
    place = F.when(phase == 0, 0).when(phase == 1, 3).when(phase == 2, 1).otherwise(2)
    frame = F.when(F.col("is_video"), group * 4 + place).otherwise(-1).cast("bigint")
    dts = F.when(F.col("is_video"), F.greatest(F.col("_v") - 2, F.lit(0)) * FPS_DEN).otherwise(
        F.greatest(F.col("_v"), F.lit(0)) * 800
    )
    return ranked.select(
        "clip_id",
        "seq",
        "is_video",
        (F.floor(F.col("value") * 100).cast("bigint") + 1).alias("size"),
        F.when(F.col("is_video"), frame * FPS_DEN).otherwise(dts).cast("bigint").alias("pts"),
        dts.cast("bigint").alias("dts"),
        F.when(F.col("is_video"), F.pmod("_v", F.lit(12)) == 0).otherwise(True).alias("is_key"),
        frame.alias("frame_no"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet log table, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _samples:
        _samples[key] = store(build_samples(table(spark, sf_dir, "events")), "samples")
    return _samples[key]


def bounds(log: DataFrame) -> DataFrame:
    """A partial file per clip that holds four fifths of the logged bytes."""
    kept = F.floor(F.sum("size") * F.lit(0.8)).cast("bigint")
    return log.groupBy("clip_id").agg(
        F.lit(DATA_START).cast("bigint").alias("data_start"),
        (kept + DATA_START).alias("data_bound"),
    )


def clips(log: DataFrame) -> DataFrame:
    """Clip facts: open groups on odd clips, one clip frame per logged frame."""
    as_long = lambda v: F.lit(v).cast("bigint")
    return log.groupBy("clip_id").agg(
        F.pmod("clip_id", F.lit(2)).cast("int").alias("open_gop"),
        F.count_if("is_video").alias("frame_count"),
        as_long(FPS_NUM).alias("fps_num"),
        as_long(FPS_DEN).alias("fps_den"),
        as_long(SAMPLE_RATE).alias("sample_rate"),
        as_long(CHANNELS).alias("channels"),
        as_long(1 << 40).alias("samples_per_channel"),
    )

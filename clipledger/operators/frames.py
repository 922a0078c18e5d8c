"""Frame comparison: PSNR, the first/middle/last gate, and the decode path it decides."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.functions.arrow import (
    PEAK_16_BIT,
    PERFECT_DB,
    batches,
    planar,
    plane_psnr,
    psnr_planes,
    repack_words,
)
from clipledger.plans.scan import idiv
from clipledger.session import reading_tasks
from clipledger.sources.files import open_file
from clipledger.sources.rawframes import frame_bytes

FRAME = ["clip_id", "frame_no"]
# Fixed value: lowest PSNR two decode runs may have.
GATE_DB = 55.0


def psnr(a: Column | str, b: Column | str, peak: float = PEAK_16_BIT) -> Column:
    """PSNR of two numeric arrays; equal arrays give 99 dB, different sizes 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    square = lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    error = F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    value = F.when(error <= 0, PERFECT_DB).otherwise(
        F.lit(10.0) * F.log10(F.lit(peak * peak) / error)
    )
    same_size = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(same_size, value).otherwise(0.0))


def frame_ab(a: DataFrame, b: DataFrame, column: str = "planes") -> DataFrame:
    """The same frame of two decode runs side by side: ``a`` and ``b`` hold the pixel data."""
    pick = lambda df, name: df.select(*FRAME, F.col(column).alias(name))
    return pick(a, "a").join(pick(b, "b"), FRAME)


def pick_frames(clips: DataFrame) -> DataFrame:
    """First, middle and last frame of each clip, each once."""
    n = F.col("frame_count").cast("bigint")
    middle = idiv(n - 1, F.lit(2).cast("bigint"))
    picks = F.array_distinct(F.array(F.lit(0).cast("bigint"), n - 1, middle))
    return clips.filter("frame_count > 0").select("clip_id", F.explode(picks).alias("frame_no"))


def gate(
    a: DataFrame,
    b: DataFrame,
    clips: DataFrame,
    min_db: float = GATE_DB,
    column: str = "planes",
    score: Column | None = None,
) -> DataFrame:
    """Compare first, middle and last frame of two runs; the worst PSNR decides.

    An empty clip passes without a value. A clip with a frame missing on a side is not gated and
    has no result. Only the picked frames' pixels reach the join.
    """
    picks = pick_frames(clips)
    value = psnr_planes("a", "b") if score is None else score
    # The few picks are the build side, so all other frames are dropped where they are read.
    side = lambda df, name: df.select(*FRAME, F.col(column).alias(name)).join(
        picks, FRAME
    )
    pairs = (
        picks.join(side(a, "a"), FRAME, "left")
        .join(side(b, "b"), FRAME, "left")
        .withColumn("psnr", value)
    )
    return gate_verdict(pairs, clips, min_db)


def gate_verdict(pairs: DataFrame, clips: DataFrame, min_db: float = GATE_DB) -> DataFrame:
    """The verdict of each clip from the ``psnr`` of its picked frames; null where one is missing."""
    worst = pairs.groupBy("clip_id").agg(
        F.count("*").alias("_asked"), F.count("psnr").alias("_seen"), F.min("psnr").alias("_worst")
    )
    gated = (F.col("frame_count") == 0) | F.coalesce(F.col("_asked") == F.col("_seen"), F.lit(False))
    return (
        clips.select("clip_id", "frame_count")
        .join(worst, "clip_id", "left")
        .select(
            "clip_id",
            gated.alias("gated"),
            F.when(gated & (F.col("frame_count") > 0), F.col("_worst")).alias("worst_psnr"),
            (
                gated & ((F.col("frame_count") == 0) | F.coalesce(F.col("_worst") >= min_db, F.lit(False)))
            ).alias("pass"),
        )
    )


def decide_path(df: DataFrame) -> DataFrame:
    """Which decoder a clip uses, from ``decode_mode`` (0 auto, 1 gpu, 2 cpu), ``init_ok``,
    ``gated``, ``pass`` and ``worst_psnr``. A forced GPU that does not start is an error.
    """
    forced, cpu = F.col("decode_mode") == 1, F.col("decode_mode") == 2
    ready, gated, ok = F.col("init_ok"), F.col("gated"), F.col("pass")
    path = (
        F.when(cpu, "cpu")
        .when(~ready & forced, "error")
        .when(~ready, "cpu")
        .when(forced | (gated & ok), "gpu")
        .otherwise("cpu")
    )
    note = (
        F.when(cpu, "cpu asked for")
        .when(~ready & forced, "gpu did not start")
        .when(~ready, "gpu did not start, fall back")
        .when(~gated & forced, "gpu forced, not gated")
        .when(~gated, "not gated, fall back")
        .when(ok & (F.coalesce("worst_psnr", F.lit(0.0)) > 0), "gate passed")
        .when(ok, "gate passed, empty clip")
        .when(forced, "gpu forced, gate failed")
        .otherwise("gate failed, fall back")
    )
    return df.withColumns({"decode_path": path, "decode_note": note})


def compare_files(
    pairs: DataFrame, width: int, height: int, layout: str = "rgb16", split_bytes: int = 256 << 20
) -> DataFrame:
    """PSNR of every frame of two raw dumps per clip (``clip_id, path_a, path_b, frame_count``).

    The work is cut into frame ranges, and a task reads its range from both files, so no pixel is
    shuffled. A frame that a file does not hold in full gives no value.
    """
    size = frame_bytes(width, height, layout)
    step = max(split_bytes // (2 * size), 1)

    def job(parts):
        def rows():
            for part in parts:
                for r in part.to_pylist():
                    with open_file(r["path_a"]) as a, open_file(r["path_b"]) as b:
                        a.seek(r["first"] * size)
                        b.seek(r["first"] * size)
                        for n in range(r["first"], min(r["first"] + step, r["frame_count"])):
                            one, two = a.read(size), b.read(size)
                            whole = len(one) == len(two) == size
                            value = plane_psnr(one, two) if whole else None
                            yield {"clip_id": r["clip_id"], "frame_no": n, "psnr": value}

        return batches(rows(), schema)

    kind = dict(pairs.dtypes)["clip_id"]
    schema = pa.schema(
        [
            ("clip_id", pa.int64() if kind == "bigint" else pa.string()),
            ("frame_no", pa.int64()),
            ("psnr", pa.float64()),
        ]
    )
    last = F.greatest(F.col("frame_count").cast("bigint") - 1, F.lit(0).cast("bigint"))
    ranges = pairs.filter("frame_count > 0").select(
        "clip_id",
        "path_a",
        "path_b",
        "frame_count",
        F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(step).cast("bigint"))).alias("first"),
    )
    return ranges.repartition(reading_tasks(pairs.sparkSession), "clip_id", "first").mapInArrow(
        job, f"clip_id {kind}, frame_no bigint, psnr double"
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """PSNR of every common frame of two runs of 16-bit planes (``planes BINARY``)."""
    return frame_ab(a, b).select(*FRAME, psnr_planes("a", "b").alias("psnr"))


def to_planar(frames: DataFrame) -> DataFrame:
    """Interleaved 16-bit RGB frames as planes, so two runs compare plane by plane."""
    return frames.withColumn("planes", planar("planes"))


def repack_blocks(blocks: DataFrame) -> DataFrame:
    """Audio blocks of 4-byte words as 3-byte samples, with a hash per block."""
    return blocks.withColumn("payload", repack_words("payload")).withColumn(
        "block_hash", F.sha2("payload", 256)
    )

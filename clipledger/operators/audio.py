"""Audio blocks: sample index, cap, alignment to frames, write order, content equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions import rules as R
from clipledger.plans.scan import (
    CHUNK_ROWS,
    attach,
    chunk_of,
    idiv,
    ordered_chunks,
    running,
    running_count,
    running_last,
    running_sum,
)

CLIP = ["clip_id"]


def index_audio(
    blocks: DataFrame,
    clips: DataFrame,
    max_block_bytes: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """First sample of each audio block: samples per channel of all blocks before it.

    ``blocks`` has ``clip_id, block_idx, n_bytes`` (4 bytes per word), ``clips`` the channel count.
    Empty blocks are dropped. A block whose size is not whole words, is above the limit, or does
    not split evenly over the channels is reported in ``error``; the blocks after it are
    ``blocked``, because their position is unknown.
    """
    known = attach(
        blocks, clips.select("clip_id", "channels"), CLIP, chunk_of("block_idx", chunk_rows)
    )
    size = F.col("n_bytes")
    bad_size = size % 4 != 0
    if max_block_bytes is not None:
        bad_size = bad_size | (size > max_block_bytes)
    words = idiv(size, F.lit(4).cast("bigint"))
    channels = F.coalesce("channels", F.lit(0))
    own_error = F.when(bad_size, "bad size").when(
        (channels <= 0) | F.coalesce(words % F.nullif(channels, F.lit(0)) != 0, F.lit(True)),
        "not aligned to channels",
    )
    marked = (
        known.withColumn("_error", own_error)
        .filter((size != 0))
        .withColumn(
            "n_samples",
            F.when(F.col("_error").isNull(), idiv(words, channels.cast("bigint"))).otherwise(0),
        )
    )
    out = running(
        marked,
        CLIP,
        chunk_of("block_idx", chunk_rows),
        ["block_idx"],
        {
            "first_sample": running_sum("n_samples", inclusive=False),
            "_bad": running_count(F.col("_error").isNotNull(), inclusive=False),
        },
    )
    error = F.when(F.col("_bad") > 0, "blocked").otherwise(F.col("_error"))
    return out.withColumn("error", error).select(
        *blocks.columns,
        F.when(F.col("error").isNull(), F.col("first_sample")).alias("first_sample"),
        F.when(F.col("error").isNull(), F.col("n_samples")).alias("n_samples"),
        "error",
    )


def audio_limit(clips: DataFrame) -> DataFrame:
    """Samples per channel that may be written: those of the frames, at most those of the clip."""
    by_frames = idiv(
        F.col("frame_count") * F.col("sample_rate") * F.greatest(F.col("fps_den"), F.lit(1)),
        F.greatest(F.col("fps_num"), F.lit(1)).cast("bigint"),
    )
    return clips.select(
        "clip_id",
        F.least(by_frames, F.col("samples_per_channel")).alias("sample_limit"),
        "channels",
    )


def cap_audio(indexed: DataFrame, clips: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop blocks at or after the limit and cut the one across it to whole samples."""
    limited = attach(
        indexed.filter("error is null"),
        audio_limit(clips),
        CLIP,
        chunk_of("block_idx", chunk_rows),
        "inner",
    ).filter("first_sample < sample_limit")
    kept = F.least(F.col("n_samples"), F.col("sample_limit") - F.col("first_sample"))
    return limited.select(
        "clip_id",
        "block_idx",
        "first_sample",
        kept.alias("n_samples"),
        (kept * F.col("channels") * R.BYTES_PER_SAMPLE).alias("out_bytes"),
        (kept < F.col("n_samples")).alias("cut"),
    )


def align_audio(blocks: DataFrame, clips: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Frame before which each block is written: the first one due after its first sample."""
    timed = attach(
        blocks,
        clips.select("clip_id", "sample_rate", "fps_num", "fps_den"),
        CLIP,
        chunk_of("block_idx", chunk_rows),
    )
    frame = R.sample_frame("first_sample", "sample_rate", "fps_num", "fps_den")
    return timed.select(*blocks.columns, frame.alias("frame_no"))


def interleave(frames: DataFrame, aligned: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Write order of a clip: each frame after all audio aligned to it, leftovers at the end.

    Frames are unique per clip and the blocks of one frame are limited by the samples it lasts, so
    a range of frame numbers bounds the rows of a chunk.
    """
    none = F.lit(None).cast("bigint")
    packets = aligned.select(
        "clip_id", "frame_no", F.lit(0).alias("lane"), "first_sample", "block_idx"
    ).union(
        frames.select("clip_id", "frame_no", F.lit(1), F.lit(0).cast("bigint"), none)
    )
    return running(
        packets,
        CLIP,
        chunk_of("frame_no", max(chunk_rows // 16, 1)),
        ["frame_no", "lane", "first_sample"],
        {"position": running_count(inclusive=False)},
    ).select(
        "clip_id",
        "position",
        F.when(F.col("lane") == 0, "audio").otherwise("video").alias("kind"),
        F.when(F.col("lane") == 1, F.col("frame_no")).alias("frame_no"),
        "block_idx",
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    order: str,
    direction: str = "backward",
) -> DataFrame:
    """For each left row the nearest right row at or before (``backward``) or at or after it.

    Both sides have ``keys`` and the whole-number column ``order``; right rows are unique on them.
    Left rows without a match keep nulls. Both sides are ordered once by range, so a frequent key
    is split, and the latest right row is carried over the chunks.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    sign = 1 if direction == "backward" else -1
    left_rest = [c for c in left.columns if c not in (*keys, order)]
    right_rest = [c for c in right.columns if c not in (*keys, order)]
    left_row = F.struct(*[F.col(c) for c in left_rest]) if left_rest else F.struct(F.lit(0))
    right_row = F.struct(F.col(order).alias("_at"), *[F.col(c) for c in right_rest])
    one = left.select(*keys, (F.col(order) * sign).alias("_o"), F.lit(1).alias("_side"), left_row.alias("_l"))
    two = right.select(*keys, (F.col(order) * sign).alias("_o"), F.lit(0).alias("_side"), right_row.alias("_r"))
    both = one.unionByName(two, allowMissingColumns=True)
    # Splits left rows that share key and order; it has no effect on the match.
    both = both.withColumn("_n", F.coalesce(F.xxhash64("_l"), F.lit(0).cast("bigint")))
    line = ["_o", "_side", "_n"]
    found = running(
        ordered_chunks(both, [*keys, *line]),
        keys,
        "order_chunk",
        line,
        {"_match": running_last("_r")},
    ).filter("_side = 1")
    return found.select(
        *keys,
        (F.col("_o") * sign).alias(order),
        *[F.col(f"_l.{c}").alias(c) for c in left_rest],
        F.col("_match._at").alias(f"matched_{order}"),
        *[F.col(f"_match.{c}").alias(c) for c in right_rest],
    )


def content_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per clip: are the blocks of both sides the same bytes? A block missing on a side differs.

    Both sides have ``clip_id, block_idx, payload``; only hashes are shuffled. A block that occurs
    more than once is summed up first, so copies do not multiply in the join.
    """

    def hashed(df: DataFrame, name: str) -> DataFrame:
        digest = F.sha2("payload", 256)
        summary = F.struct(F.min(digest), F.max(digest), F.count("*"))
        return df.groupBy("clip_id", "block_idx").agg(summary.alias(name))

    pairs = hashed(left, "a").join(hashed(right, "b"), ["clip_id", "block_idx"], "full")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("a").isNotNull()
    return pairs.groupBy("clip_id").agg(
        F.count("*").alias("blocks"),
        F.count_if(~same).alias("different"),
        F.bool_and(same).alias("equal"),
    )

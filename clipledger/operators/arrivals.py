"""Ordered arrivals: tail, de-duplication, in-order release, shard audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.plans.scan import (
    CHUNK_ROWS,
    attach,
    chunk_of,
    running,
    running_count,
    running_max,
)


def tail_n(lines: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key, with ``rank`` 1 for the last one.

    Spark keeps only ``n`` rows per key and task before the shuffle (window group limit), so a
    frequent key does not travel.
    """
    last_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return lines.withColumn("rank", F.row_number().over(last_first)).filter(F.col("rank") <= n)


def ordered_dedup(
    arrivals: DataFrame,
    arrival: str = "arrival",
    number: str = "n",
    chunk_rows: int = CHUNK_ROWS,
    after: DataFrame | None = None,
) -> DataFrame:
    """Keep an arrival only when its number is above all earlier ones of its clip.

    ``arrival`` is a unique whole number that gives the order. ``after`` (``clip_id, high``) holds
    the highest number accepted before these rows.
    """
    out = running(
        arrivals.filter(F.col(number) >= 0),
        ["clip_id"],
        chunk_of(arrival, chunk_rows),
        [arrival],
        {"_high": running_max(number, inclusive=False, empty=-1)},
        facts=after,
    )
    floor = F.col("_high")
    if after is not None:
        floor = F.greatest(floor, F.coalesce("high", F.lit(-1).cast("bigint")))
    return out.filter(F.col(number) > floor).select(*arrivals.columns)


def release_prefix(
    arrivals: DataFrame,
    start: int = 0,
    number: str = "n",
    chunk_rows: int = CHUNK_ROWS,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Which numbers can be released in order: those with no gap back to the start number.

    One row per clip and number at or above the start (``starts``: ``clip_id, start`` per clip).
    """
    begin = F.lit(start).cast("bigint")
    rows = arrivals.select("clip_id", F.col(number).cast("bigint").alias("n")).distinct()
    chunk = chunk_of("n", chunk_rows)
    if starts is not None:
        rows = attach(rows, starts.select("clip_id", "start"), ["clip_id"], chunk)
        begin = F.coalesce("start", begin)
    out = running(
        rows.filter(F.col("n") >= begin), ["clip_id"], chunk, ["n"], {"_seen": running_count()}
    )
    return out.select(
        "clip_id", "n", (F.col("n") - begin + 1 == F.col("_seen")).alias("released")
    )


def audit_shards(
    arrivals: DataFrame, shards: int, start: int = 0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """First arrival of a shard that is not the number due there.

    ``arrivals`` has ``clip_id, shard, arrival, n``. The j-th item of shard k must be
    start + k + j * shards. Only shards that break the rule give a row.
    """
    out = running(
        arrivals,
        ["clip_id", "shard"],
        chunk_of("arrival", chunk_rows),
        ["arrival"],
        {"_j": running_count(inclusive=False)},
    ).withColumn("expected", start + F.col("shard") + F.col("_j") * shards)
    wrong = out.filter("n != expected")
    first = F.min_by(F.struct("arrival", "n", "expected"), "arrival")
    return (
        wrong.groupBy("clip_id", "shard")
        .agg(first.alias("v"))
        .select("clip_id", "shard", "v.arrival", "v.n", "v.expected")
    )

"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import numbered, text_or_empty, with_position
from clipledger.session import store

SHARDS = 16
SEED = "shard-1"


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, seed: str = SEED, stratum: str = "source"
) -> DataFrame:
    """The rows of ``docs``, all columns, with ``shard`` and ``slot`` (place in the shard, from 0).

    Deals ``docs`` into ``shards`` so that every shard has the mixture of the whole.

    Rows of each source are shuffled by a seeded hash of their doc_id and ranked; a row's
    fractional rank is (rank - 1/2) / rows of its source. The rows in the order of fractional
    rank are cut into shards whose counts differ by one at most (law ``rows``). The cuts are by
    place, so each shard is within one row of the exact share of every source, but for ties.

    Both orders are range partitions on a unique key; only totals of partitions are carried over,
    so a source with a third of all rows is spread over many tasks. Rows are written once under a
    number of their own; small rows are placed, and joined to the whole ones by that number.

    Null sources are a source of their own, null doc_ids are shuffled like any other value, null
    texts have size 1 and crc 0, repeated rows each get a place of their own, an empty table gives
    an empty result, and other columns of ``docs`` are carried along. Columns of ``docs`` named
    ``shard``, ``slot`` or ``_shard_row`` are replaced.
    """
    whole = docs.drop("shard", "slot").withColumn("_shard_row", F.monotonically_increasing_id())
    whole = store(whole, "shard-rows")
    rows = whole.select(
        "_shard_row",
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.col(stratum).isNull().alias("_none"),
        text_or_empty(stratum).alias("_source"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_mix"),
    )
    within = ["_none", "_source", "_mix", "doc_id", "text_crc32", "size"]
    ranked = numbered(rows, within, "shard-rank")
    runs = ranked.groupBy("_part", "_none", "_source").agg(
        F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    source = Window.partitionBy("_none", "_source")
    carried = runs.select(
        "_part",
        "_none",
        "_source",
        "_first",
        (F.sum("_n").over(source.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(source).alias("_of"),
    )
    rank = F.col("_before") + F.col("_idx") - F.col("_first")
    share = ranked.join(carried, ["_part", "_none", "_source"]).withColumn(
        "_share", (rank + F.lit(0.5)) / F.col("_of")
    )
    placed = with_position(
        numbered(
            share.drop("_part", "_idx", "_first", "_before", "_of"),
            ["_share", *within],
            "shard-place",
            ("_none", "_mix"),
        )
    )
    shard = F.call_function("div", F.col("_pos") * shards, F.col("_all"))
    first = F.call_function("div", shard * F.col("_all") + (shards - 1), F.lit(shards).cast("bigint"))
    places = placed.select(
        "_shard_row", shard.cast("int").alias("shard"), (F.col("_pos") - first).cast("bigint").alias("slot")
    )
    return whole.join(places, "_shard_row").drop("_shard_row")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, stratum: str = "source") -> DataFrame:
    """The documents of :func:`shard_documents` told by size and checksum, taken from its rows.

    Returns doc_id, size (bytes of text and one), text_crc32, law, shard, slot and grown_shard.
    """
    return shard_documents(docs, shards, seed, stratum).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Helpers the training-data operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger.session import store

# Text handled at once inside a task. Batches are cut to it, so memory follows it, not the rows
# of a batch; one longer text is a batch of its own.
SLICE_BYTES = 4 << 20

LOW_INDEX = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add ``_k1``, ``_k2``: never null, equal only for rows with the same doc_id and text.

    Rows that share a doc_id but not the text keep apart; exact repeats of a row share the key
    and every decision made for it.
    """
    absent = F.col("doc_id").isNull()
    return docs.withColumns(
        {
            "_k1": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")),
            "_k2": F.xxhash64(F.col("text"), absent, F.col("text").isNull()),
        }
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def numbered(df: DataFrame, order: list, label: str, drop: tuple = ()) -> DataFrame:
    """Rows in the full ``order``, written once, with ``_part`` and the place ``_idx`` in it.

    The range partitions follow the order, so a place in the whole order is the number of rows
    of the parts before plus ``_idx``. Rows equal in ``order`` are told apart by where they were
    read, so no set of equal rows has to share one partition.
    """
    spread = df.withColumn("_at", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at")
    placed = ranged.withColumn("_mid", F.monotonically_increasing_id()).drop("_at", *drop)
    return (
        store(placed, label)
        .withColumn("_part", F.shiftright("_mid", 33))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(LOW_INDEX)))
        .drop("_mid")
    )


def with_position(rows: DataFrame) -> DataFrame:
    """Add ``_pos`` (from 0) and ``_all`` (count of rows) to rows from :func:`numbered`.

    Only one row per partition meets in the window.
    """
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.orderBy("_part")
    carried = sizes.select(
        "_part",
        (F.sum("_n").over(every) - F.col("_n")).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    return (
        rows.join(carried, "_part")
        .withColumn("_pos", F.col("_base") + F.col("_idx"))
        .drop("_base", "_part", "_idx")
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps. Minima are pre-aggregated and joined back, so a
    hub is never gathered in one task. Each round is a table in the shared folder; the rounds grow
    with the logarithm of the longest chain.
    """
    edges = store(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(lowest, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a")
        edges = store(
            small.select("a", F.col("m").alias("b"))
            .unionByName(
                small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            )
            .filter("a <> b")
            .distinct(),
            label,
        )
        now = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h"),
        ).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def per_process(name: str, make: Callable):
    """What ``make`` returned the first time in this process: Python workers outlive their tasks."""
    holder = sys.modules.setdefault("_clipledger_process", types.ModuleType("_clipledger_process"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut so that the ``text`` column of each part holds about ``most`` bytes."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def by_slices(function: Callable, schema: pa.Schema, text: str = "text") -> Callable:
    """A mapInArrow function that calls ``function(batch) -> dict of columns`` slice by slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_pydict(function(part), schema=schema)

    return run


def whole_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` regrouped so that no group is cut between two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = None
        for key in keys:
            column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            equal = column == column[-1]
            same = equal if same is None else same & equal
        begin = batch.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        elif held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(i)[0] != batch.column(i)[0] for i in map(batch.schema.get_field_index, keys)):
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)

"""Running values over a clip of any length, without one task per clip.

A plain window ``PARTITION BY clip_id ORDER BY seq`` sends a whole clip to one task. One clip may
hold a third of an archive, so every running value here is computed in two levels instead:

1. rows are cut into chunks of bounded size; a chunk column never decreases along the order;
2. each chunk is reduced to one total (combined on the map side), and the totals of the earlier
   chunks are carried forward by a window over the short table of totals;
3. rows are windowed inside their own chunk and the carried total is added.

Rows are shuffled once, by (key, chunk). The join with the carried totals and the window use the
same partitioning, and no task holds more than one chunk of a clip at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.session import store

# Rows per chunk when the order is a dense row number.
CHUNK_ROWS = 1 << 18
# Ticks per chunk when the order is a media time and rows are distinct per tick. At the usual
# tens to thousands of ticks per frame this is well below CHUNK_ROWS; it can never be above it
# by more than this many distinct values.
CHUNK_TICKS = 1 << 22


def idiv(a, b) -> Column:
    """Integer division that truncates, on whole 64-bit numbers."""
    left = F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(a)
    right = F.col(b) if isinstance(b, str) else b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", left, right)


def chunk_of(order, width: int = CHUNK_ROWS) -> Column:
    return idiv(order, F.lit(width).cast("bigint"))


@dataclass(frozen=True)
class Running:
    """One running value: how a chunk is summed up, carried on, and merged with its rows."""

    kind: str
    value: Column
    inclusive: bool = True
    empty: object = None

    def total(self, order: list[str]) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        if self.kind == "min":
            return F.min(self.value)
        if self.kind == "whole":
            return F.max(self.value)
        known = F.when(self.value.isNotNull(), F.struct(*order))
        return F.max_by(self.value, known)

    def over(self, column: Column, window) -> Column:
        if self.kind == "last":
            return F.last(column, ignorenulls=True).over(window)
        return getattr(F, self.kind)(column).over(window)

    def merge(self, carried: Column, local: Column) -> Column:
        if self.kind == "sum":
            merged = F.coalesce(carried + local, carried, local)
        elif self.kind == "max":
            merged = F.greatest(carried, local)
        elif self.kind == "min":
            merged = F.least(carried, local)
        else:
            merged = F.coalesce(local, carried)
        return merged if self.empty is None else F.coalesce(merged, F.lit(self.empty))


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def running_sum(value, inclusive: bool = True) -> Running:
    return Running("sum", _column(value).cast("bigint"), inclusive, 0)


def running_count(condition=None, inclusive: bool = True) -> Running:
    one = F.lit(1) if condition is None else F.when(_column(condition), 1).otherwise(0)
    return Running("sum", one.cast("bigint"), inclusive, 0)


def running_max(value, inclusive: bool = True, empty=None) -> Running:
    return Running("max", _column(value), inclusive, empty)


def whole_max(value) -> Running:
    """The highest value of the whole key, on every row; it comes with the table of totals."""
    return Running("whole", _column(value))


def running_last(value, inclusive: bool = True) -> Running:
    """The latest value that is not null."""
    return Running("last", _column(value), inclusive)


def running(
    df: DataFrame,
    keys: list[str],
    chunk: Column | str,
    order: list[str],
    values: dict[str, Running],
    facts: DataFrame | None = None,
) -> DataFrame:
    """Add running ``values`` along ``order`` (ascending, unique per key) within ``keys``.

    ``chunk`` must not decrease along ``order`` and must bound the rows that share it. ``facts``
    holds at most one row per key; its columns are joined to the table of totals, which is short,
    and so reach the rows without a second row-level join. Keys and order must not be null: such
    rows have no place in the order and are left out, in both branches alike, so that Spark can
    reuse what the branches share.
    """
    part = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", _column(chunk))
    for name in part:
        rows = rows.filter(F.col(name).isNotNull())
    totals = rows.groupBy(*part).agg(*[v.total(order).alias(f"_t_{n}") for n, v in values.items()])
    every = Window.partitionBy(*keys)
    before = every.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *part,
        *[
            (
                F.max(f"_t_{n}").over(every)
                if v.kind == "whole"
                else v.over(F.col(f"_t_{n}"), before)
            ).alias(f"_c_{n}")
            for n, v in values.items()
        ],
    )
    if facts is not None:
        carried = carried.join(facts, keys, "left")
    inside = Window.partitionBy(*part).orderBy(*order)
    local = rows.withColumns(
        {
            f"_l_{n}": v.over(
                v.value,
                inside.rowsBetween(Window.unboundedPreceding, 0 if v.inclusive else -1),
            )
            for n, v in values.items()
            if v.kind != "whole"
        }
    )
    joined = local.join(carried, part)
    fact_columns = [] if facts is None else [c for c in facts.columns if c not in keys]
    return joined.select(
        *df.columns,
        *fact_columns,
        *[
            (
                F.col(f"_c_{n}")
                if v.kind == "whole"
                else v.merge(F.col(f"_c_{n}"), F.col(f"_l_{n}"))
            ).alias(n)
            for n, v in values.items()
        ],
    )


def ordered_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``order_chunk`` for an order that has no dense row number.

    Rows are range-partitioned on the full order (which must be unique, so that equal values split
    too) and the number of the partition is the chunk. Range bounds come from a sample and the
    chunk is read by two branches of :func:`running`, so the rows are written to the shared folder
    once, with their chunk. The count of partitions follows ``spark.sql.shuffle.partitions`` and
    AQE.
    """
    ranged = df.repartitionByRange(*order)
    return store(
        ranged.withColumn("order_chunk", F.spark_partition_id().cast("bigint")), "ordered"
    )


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate, the one it picks join strategies by."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _fits_broadcast(facts: DataFrame) -> bool:
    """True when the estimate is below the session's broadcast limit."""
    conf = facts.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(facts) <= int(conf.autoBroadcastJoinThreshold())


def attach(
    rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column | str, how: str = "left"
) -> DataFrame:
    """Join one-row-per-key ``facts`` to ``rows`` in which one key may be very frequent.

    Small facts are left to Catalyst, which broadcasts them by its own size check. Otherwise the
    facts are first copied to the (key, spread) cells that occur, and rows are joined on the cell,
    so a frequent key is spread over as many tasks as ``spread`` has values. Both ways give the same
    rows, also where ``spread`` or a key is null.
    """
    if _fits_broadcast(facts):
        return rows.join(facts, keys, how)
    cell = [*keys, "_cell"]
    spread_rows = rows.withColumn("_cell", F.coalesce(_column(spread).cast("bigint"), F.lit(0).cast("bigint")))
    cells = spread_rows.select(*cell).distinct().join(facts, keys, how)
    return spread_rows.join(cells, cell, how).drop("_cell")

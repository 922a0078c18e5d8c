"""Registry of named queries, and the views both engines share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipledger.plans import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its DuckDB twin."""

    def register(function):
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The tables hold plain UTC times.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view written in SQL that Spark and DuckDB both read; ``{table}`` names an input table."""
    used = {t: tables.table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same view for DuckDB, as a subquery."""
    return "(" + text.format(**{t: t for t in TABLES}) + ")"


# The packet log as SQL: the twin of plans.tables.build_samples.
SAMPLES = """
b as (select user_id clip_id, event_id, ts, value, event_type <> 'purchase' is_video,
      row_number() over (partition by user_id order by ts, event_id) - 1 seq from events),
v as (select *, sum(case when is_video then 1 else 0 end)
      over (partition by clip_id order by seq rows unbounded preceding) - 1 vseq from b),
w as (select *, vseq - 4*floor(vseq/4.0) ph from v),
x as (select clip_id, cast(seq as bigint) seq, is_video,
      cast(floor(value*100) as bigint)+1 size,
      case when is_video then cast(4*floor(vseq/4.0)
        + case when ph=0 then 0 when ph=1 then 3 when ph=2 then 1 else 2 end as bigint)
        else -1 end frame_no,
      case when is_video then cast(greatest(vseq-2,0)*1001 as bigint)
        else cast(greatest(vseq,0)*800 as bigint) end dts,
      case when is_video then (vseq - 12*floor(vseq/12.0))=0 else true end is_key from w),
samples as (select clip_id, seq, is_video, size,
      case when is_video then frame_no*1001 else dts end pts, dts, is_key, frame_no from x),
bounds as (select clip_id, 40 data_start, cast(floor(sum(size)*0.8) as bigint) + 40 data_bound
      from samples group by clip_id),
clips as (select clip_id, clip_id % 2 open_gop, cast(sum(case when is_video then 1 else 0 end)
      as bigint) frame_count, 60000 fps_num, 1001 fps_den, 48000 sample_rate, 2 channels
      from samples group by clip_id),
placed as (select *, cast(40 + sum(size) over (partition by clip_id order by seq
      rows unbounded preceding) - size as bigint) "offset" from samples),
flagged as (select p.*, p."offset" + p.size <= b.data_bound is_complete
      from placed p join bounds b using (clip_id))
"""


def with_samples(rest: str) -> str:
    return f"with {SAMPLES}{rest}"

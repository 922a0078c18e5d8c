"""Streaming queries: each drains its input and returns all the stream has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.catalog.archive import ARRIVALS, NUMBER, NUMBERED
from clipledger.catalog.base import duck, query, with_samples
from clipledger.catalog.settings import duration_sql
from clipledger.catalog.timeline import log
from clipledger.plans import tables
from clipledger.session import scratch_path
from clipledger.sources import documents as docs
from clipledger.sources import intake, samplelog
from clipledger.streaming import keyed as K
from clipledger.streaming import streams as S
from clipledger.streaming.carry import drain_append, drain_update


def table_stream(spark, sf_dir, name: str) -> DataFrame:
    """One of the driver's tables as a file stream."""
    schema = tables.table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    )


def log_stream(spark, sf_dir) -> DataFrame:
    """The packet log table as a file stream."""
    samples = log(spark, sf_dir)
    folder = samples.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(samples.schema).parquet(folder)


def in_batches(stream, rows: DataFrame, order: str, batches: int = 4) -> DataFrame:
    """What ``stream`` has written after ``rows`` came in as that many micro-batches."""
    folder = scratch_path(rows.sparkSession, "feed")
    span = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    width = (span.high - span.low) // batches + 1
    for low in range(span.low, span.high + 1, width):
        rows.filter((F.col(order) >= low) & (F.col(order) < low + width)).write.mode("append").parquet(folder)
        source = rows.sparkSession.readStream.schema(rows.schema).parquet(folder)
        stream.start(source).awaitTermination()
    return stream.result()


TICKER = "2 seconds"


@query(
    "progress_stream",
    f"""with e as (select user_id clip_id, ts, epoch_us(time_bucket(interval '{TICKER}', ts)) window_us,
    (event_id * 7) % 900 done, value from events),
t as (select *, row_number() over (partition by clip_id, window_us order by ts desc, done desc) rk from e),
r as (select clip_id, window_us, done, done / 600.0::double f, done * 1001.0::double / 60000.0::double a,
  case when value / 10 > 0.01::double then (600.0::double - done) / (value / 10) else 0 end w
  from t where rk = 1)
select clip_id, window_us, done, least(f, 1.0::double) fraction, {duration_sql('a')} done_text,
  {duration_sql('w')} left_text from r""",
)
def progress_stream(spark, sf_dir):
    events = table_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("(event_id * 7) % 900").alias("done"),
        F.lit(600).cast("bigint").alias("total"),
        F.lit(60000).alias("fps_num"),
        F.lit(1001).alias("fps_den"),
        (F.col("value") / 10).alias("fps"),
    )
    out = drain_update(S.progress_stream(events, TICKER, "0 seconds"), ["clip_id", "window_start"])
    return out.select(
        "clip_id",
        F.unix_micros("window_start").alias("window_us"),
        "done",
        "fraction",
        "done_text",
        "left_text",
    )


CHECKPOINT_STREAM_SQL = with_samples(
    """, t as (select clip_id, seq, is_video, sum(case when is_video then 1 else 0 end) over line n,
  max(case when not is_video then pts + size // 6 end) over line a from samples
  window line as (partition by clip_id order by seq rows unbounded preceding))
select clip_id, seq after_seq, cast(n as bigint) video_frames,
  cast(coalesce(a, 0) as bigint) audio_end_sample from t where is_video and n % 20 = 0
union all select distinct clip_id, -1, 0, 0 from samples"""
)


@query("checkpoint_stream", CHECKPOINT_STREAM_SQL)
def checkpoint_stream(spark, sf_dir):
    return K.keyed_checkpoints(spark, every=S.FLUSH_EVERY).drain(log_stream(spark, sf_dir))


@query("checkpoint_stream_batches", CHECKPOINT_STREAM_SQL)
def checkpoint_stream_batches(spark, sf_dir):
    stream = K.keyed_checkpoints(spark, every=S.FLUSH_EVERY, pack_rows=64)
    return in_batches(stream, log(spark, sf_dir), "seq")


def numbered_events(spark, sf_dir, streamed: bool) -> DataFrame:
    events = (table_stream if streamed else tables.table)(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("clip_id"),
        F.col("event_id").alias("arrival"),
        F.expr("event_id + (event_id * 37) % 11 * 40 - (event_id * 53) % 7 * 90").alias("n"),
    )


ORDERED_DEDUP_STREAM_SQL = f"""select clip_id, arrival, n from (select *, max(case when n >= 0 then n end) over
  (partition by clip_id order by arrival rows between unbounded preceding and 1 preceding) high
  from {duck(ARRIVALS)} a) q where n >= 0 and n > coalesce(high, -1)"""


@query("ordered_dedup_stream", ORDERED_DEDUP_STREAM_SQL)
def ordered_dedup_stream(spark, sf_dir):
    return K.keyed_dedup(spark).drain(numbered_events(spark, sf_dir, True))


@query("ordered_dedup_stream_batches", ORDERED_DEDUP_STREAM_SQL)
def ordered_dedup_stream_batches(spark, sf_dir):
    return in_batches(K.keyed_dedup(spark, pack_rows=64), numbered_events(spark, sf_dir, False), "arrival")


# All numbers that come out, without a limit on waiting.
RELEASED_SQL = with_samples(
    NUMBERED
    + """, d as (select distinct clip_id, n from numbered where n >= 0),
r as (select *, n + 1 = row_number() over (partition by clip_id order by n) released from d)
select clip_id, cast(n as bigint) n, 'released' event from r where released"""
)
REORDER_STREAM_SQL = with_samples(
    NUMBERED
    + """, d as (select clip_id, n, min(seq) came from numbered where n >= 0 group by 1, 2),
r as (select *, n + 1 = row_number() over (partition by clip_id order by n) released from d),
due as (select c.clip_id, coalesce(max(n) filter (released), -1) + 1 due from clips c
  left join r using (clip_id) group by 1),
stuck as (select clip_id, min(came) since from r where not released group by 1)
select clip_id, cast(n as bigint) n, 'released' event from r where released union all
select clip_id, cast(due as bigint), 'gap' from due join stuck using (clip_id)
where (select max(seq) from samples) - since > 30"""
)


@query("reorder_stream", REORDER_STREAM_SQL)
def reorder_stream(spark, sf_dir):
    arrivals = log_stream(spark, sf_dir).select(
        "clip_id", F.expr(NUMBER).alias("n"), F.timestamp_seconds("seq").alias("ts")
    )
    return K.keyed_reorder(spark, timeout_s=30).drain(arrivals)


@query("reorder_stream_batches", RELEASED_SQL)
def reorder_stream_batches(spark, sf_dir):
    arrivals = log(spark, sf_dir).select(
        "clip_id", F.expr(NUMBER).alias("n"), F.timestamp_seconds("seq").alias("ts"), "seq"
    )
    return in_batches(K.keyed_reorder(spark), arrivals, "seq")


def logs_on_disk(spark, sf_dir) -> str:
    """The packet logs as binary files, one per clip."""
    folder = scratch_path(spark, "logs")
    samplelog.write_logs(
        log(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string")), folder
    )
    return folder


def growing_logs(spark, folder: str) -> DataFrame:
    return spark.readStream.format("samplelog").option("clipId", "name").load(folder)


@query(
    "growing_log_stream",
    with_samples(
        "select cast(clip_id as varchar) clip_id, seq, is_video, size, pts, dts, is_key, frame_no "
        "from samples"
    ),
)
def growing_log_stream(spark, sf_dir):
    return drain_append(growing_logs(spark, logs_on_disk(spark, sf_dir)))


@query(
    "growing_log_batches",
    with_samples(
        "select cast(clip_id as varchar) clip_id, seq, is_video, size, pts, dts, is_key, frame_no "
        "from samples"
    ),
)
def growing_log_batches(spark, sf_dir):
    """The logs as a stream of bounded batches, planned by tasks."""
    samples = log(spark, sf_dir)
    # About eight batches whatever the size of the log.
    most = max(samples.count() // 8, 1)
    folder = scratch_path(spark, "intake")
    grower = intake.LogIntake(spark, logs_on_disk(spark, sf_dir), folder, most, by_name=True)
    grower.plan()
    return drain_append(grower.stream())


RESUME_STREAM_SQL = with_samples(
    'select cast(clip_id as varchar) clip_id, seq, is_video, size, pts, dts, is_key, frame_no, '
    '"offset" from flagged where is_complete'
)


@query("resume_stream", RESUME_STREAM_SQL)
def resume_stream(spark, sf_dir):
    bounds = tables.bounds(log(spark, sf_dir)).withColumn(
        "clip_id", F.col("clip_id").cast("string")
    )
    stream = K.keyed_resume(spark, bounds)
    return stream.drain(growing_logs(spark, logs_on_disk(spark, sf_dir)))


@query("resume_stream_batches", RESUME_STREAM_SQL)
def resume_stream_batches(spark, sf_dir):
    samples = log(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string"))
    stream = K.keyed_resume(spark, tables.bounds(samples), pack_rows=64)
    return in_batches(stream, samples, "seq")


@query(
    "intake_stream",
    """select '/' || s_suppkey || '.NEV' name, '/' || s_suppkey || '.h265.mov' output,
  case when s_suppkey % 3 = 0 then 'no sidecar' else 'new' end reason from supplier
where s_suppkey % 6 <> 0""",
)
def intake_stream(spark, sf_dir):
    folder = scratch_path(spark, "intake").removeprefix("file:")
    supplier = tables.table(spark, sf_dir, "supplier")
    made = lambda suffix, where: supplier.filter(where).select(
        F.concat(F.lit(f"{folder}/"), F.col("s_suppkey"), F.lit(suffix)).alias("path"),
        F.encode("s_name", "utf-8").alias("content"),
    )
    docs.write_files(
        made(".NEV", "true")
        .union(made(".h265.mov", "s_suppkey % 3 = 0"))
        .union(made(".h265.mov.sidecar.json", "s_suppkey % 6 = 0"))
    )
    todo = K.keyed_intake(spark).drain(K.archive_files(spark, folder))
    last = lambda c: F.regexp_extract(c, r"(/[^/]*)$", 1)
    return todo.select(last("path").alias("name"), last("clip_key").alias("output"), "reason")

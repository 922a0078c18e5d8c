"""Queries over audio blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.catalog.base import duck, query, view, with_samples
from clipledger.catalog.timeline import log
from clipledger.functions import rules as R
from clipledger.operators import audio as A
from clipledger.operators import frames as V
from clipledger.plans import tables

# Audio packets as raw blocks of 4-byte words; some are empty, and rare ones are damaged.
BLOCK_BYTES = (
    "case when size % 31 = 0 then 0 when size % 307 = 0 then size * 8 + 2 "
    "when size % 311 = 0 then size * 8 + 4 else size * 8 end"
)
BLOCKS = f""",
blocks as (select clip_id, seq block_idx, {BLOCK_BYTES} n_bytes
  from samples where not is_video),
sized as (select *, case when n_bytes % 4 <> 0 then 'bad size'
    when (n_bytes // 4) % 2 <> 0 then 'not aligned to channels' end own
  from blocks where n_bytes <> 0),
counted as (select *, case when own is null then n_bytes // 8 else 0 end n_samples,
    sum(case when own is null then 0 else 1 end) over line before_bad from sized
  window line as (partition by clip_id order by block_idx
    rows between unbounded preceding and 1 preceding)),
summed as (select *, sum(n_samples) over (partition by clip_id order by block_idx
    rows unbounded preceding) - n_samples first_sample,
  case when before_bad > 0 then 'blocked' else own end error from counted),
indexed as (select clip_id, block_idx, n_bytes,
  cast(case when error is null then first_sample end as bigint) first_sample,
  cast(case when error is null then n_samples end as bigint) n_samples, error from summed),
limits as (select clip_id, least((frame_count * 48000 * 1001) // 60000,
    30000 + 100 * clip_id) sample_limit from clips),
capped as (select i.clip_id, block_idx, first_sample,
    least(n_samples, sample_limit - first_sample) kept, n_samples
  from indexed i join limits using (clip_id) where error is null and first_sample < sample_limit),
aligned as (select clip_id, block_idx, first_sample,
  ((first_sample + 1) * 60000 + 48048000 - 1) // 48048000 - 1 frame_no
  from indexed where error is null)
"""


def blocks(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).filter("not is_video").select(
        "clip_id", F.col("seq").alias("block_idx"), F.expr(BLOCK_BYTES).alias("n_bytes")
    )


def audio_clips(spark, sf_dir) -> DataFrame:
    clips = tables.clips(log(spark, sf_dir))
    return clips.withColumn("samples_per_channel", 30000 + 100 * F.col("clip_id"))


def indexed(spark, sf_dir) -> DataFrame:
    return A.index_audio(blocks(spark, sf_dir), audio_clips(spark, sf_dir))


@query(
    "audio_index",
    with_samples(
        BLOCKS + "select clip_id, block_idx, n_bytes, first_sample, n_samples, error from indexed"
    ),
)
def audio_index(spark, sf_dir):
    return indexed(spark, sf_dir)


@query(
    "audio_cap",
    with_samples(
        BLOCKS
        + "select clip_id, block_idx, first_sample, cast(kept as bigint) n_samples, "
        "cast(kept * 6 as bigint) out_bytes, kept < n_samples cut from capped"
    ),
)
def audio_cap(spark, sf_dir):
    return A.cap_audio(indexed(spark, sf_dir), audio_clips(spark, sf_dir))


def aligned(spark, sf_dir, capped: bool = False) -> DataFrame:
    clips = audio_clips(spark, sf_dir)
    good = indexed(spark, sf_dir).filter("error is null")
    if capped:
        good = A.cap_audio(good, clips)
    return A.align_audio(good.select("clip_id", "block_idx", "first_sample"), clips)


@query(
    "audio_align",
    with_samples(
        BLOCKS
        + """, due as (select i.clip_id, i.block_idx, i.first_sample, min(f.n) frame_no
  from indexed i join (select unnest(range(0,
    (select max(first_sample) // 800 + 2 from indexed))) n) f on ((f.n + 1) * 48000 * 1001) // 60000 > i.first_sample
    and f.n between i.first_sample // 801 - 1 and i.first_sample // 800 + 1
  where i.error is null group by 1, 2, 3)
select clip_id, block_idx, first_sample, cast(frame_no as bigint) frame_no from due"""
    ),
)
def audio_align(spark, sf_dir):
    return aligned(spark, sf_dir)


@query(
    "audio_align_asof",
    with_samples(
        BLOCKS
        + """, l as (select clip_id, block_idx, first_sample + 1 due from indexed where error is null),
r as (select clip_id, frame_no, ((frame_no + 1) * 48000 * 1001) // 60000 due
  from samples where is_video)
select l.clip_id, l.block_idx, l.due, r.due matched_due, r.frame_no
from l asof left join r on l.clip_id = r.clip_id and l.due <= r.due"""
    ),
)
def audio_align_asof(spark, sf_dir):
    left = (
        indexed(spark, sf_dir)
        .filter("error is null")
        .select("clip_id", "block_idx", (F.col("first_sample") + 1).alias("due"))
    )
    rate, num, den = (F.lit(v).cast("bigint") for v in (48000, 60000, 1001))
    right = (
        log(spark, sf_dir)
        .filter("is_video")
        .select("clip_id", "frame_no", R.frame_sample_target("frame_no", rate, num, den).alias("due"))
    )
    return A.asof_join(left, right, ["clip_id"], "due", "forward")


@query(
    "events_asof",
    """select l.user_id, l.event_id, r.event_id matched_event_id, r.value
from events l asof left join (select * from events where event_type = 'click') r
  on l.user_id = r.user_id and l.event_id >= r.event_id
where l.event_type = 'purchase'""",
)
def events_asof(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("user_id", "event_id")
    right = events.filter("event_type = 'click'").select("user_id", "event_id", "value")
    return A.asof_join(left, right, ["user_id"], "event_id")


@query(
    "audio_interleave",
    with_samples(
        BLOCKS
        + """, packets as (
  select a.clip_id, a.frame_no, 0 lane, a.first_sample, a.block_idx from aligned a
    semi join capped c on a.clip_id = c.clip_id and a.block_idx = c.block_idx union all
  select clip_id, frame_no, 1, 0, null from samples where is_video)
select clip_id, cast(row_number() over (partition by clip_id order by frame_no, lane, first_sample)
    - 1 as bigint) position, case when lane = 0 then 'audio' else 'video' end kind,
  case when lane = 1 then frame_no end frame_no, block_idx from packets"""
    ),
)
def audio_interleave(spark, sf_dir):
    return A.interleave(log(spark, sf_dir).filter("is_video"), aligned(spark, sf_dir, capped=True))


MADE = """select conv_id clip_id, turn + case when (turn + conv_id * 3) % 43 = 0 then 1000 else 0 end
  block_idx, case when (turn * 7 + conv_id) % 31 = 0 then text || '.' else text end text
  from {conversations}"""


@query(
    "audio_content_equal",
    f"""select coalesce(a.clip_id, b.conv_id) clip_id, cast(count(*) as bigint) blocks,
  cast(count(*) filter (a.text is distinct from b.text) as bigint) different,
  bool_and(a.text is not distinct from b.text) equal
from {duck(MADE)} a full join conversations b on a.clip_id = b.conv_id and a.block_idx = b.turn
group by 1""",
)
def audio_content_equal(spark, sf_dir):
    made = view(spark, sf_dir, MADE)
    kept = tables.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("clip_id"), F.col("turn").alias("block_idx"), "text"
    )
    as_bytes = lambda df: df.withColumn("payload", F.encode("text", "utf-8"))
    return A.content_equal(as_bytes(made), as_bytes(kept))


# Text bytes filled up to whole 4-byte words.
WORDS = "select conv_id clip_id, turn block_idx, text from {conversations}"


@query(
    "audio_repack",
    """with h as (select conv_id clip_id, turn block_idx, hex(encode(text)) || case
    (octet_length(encode(text)) % 4) when 0 then '' when 1 then '000000' when 2 then '0000'
    else '00' end x from conversations),
p as (select clip_id, block_idx, array_to_string(list_transform(range(0, length(x) // 8),
  lambda i: substr(x, 8*i+5, 2) || substr(x, 8*i+3, 2) || substr(x, 8*i+1, 2)), '') packed from h)
select clip_id, block_idx, cast(length(packed) // 2 as bigint) n_bytes,
  sha256(unhex(packed)) block_hash from p""",
)
def audio_repack(spark, sf_dir):
    text = F.encode("text", "utf-8")
    fill = F.pmod(4 - F.octet_length(text), F.lit(4))
    padded = F.concat(text, F.substring(F.unhex(F.lit("000000")), F.lit(1), fill))
    made = view(spark, sf_dir, WORDS).withColumn("payload", padded)
    return V.repack_blocks(made).select(
        "clip_id",
        "block_idx",
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        "block_hash",
    )

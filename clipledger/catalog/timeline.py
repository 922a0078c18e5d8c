"""Queries over the packet log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.catalog.base import ORACLES, query, with_samples
from clipledger.functions import rules as R
from clipledger.operators import timeline as T
from clipledger.plans import tables


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.samples(spark, sf_dir)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = log(spark, sf_dir)
    return T.mark_complete(samples, tables.bounds(samples))


# A rougher log: in some groups of frames dts run ahead, so that key frames fail the resume rule,
# and every fifth clip was cut very early.
AHEAD = "1001 * ((clip_id * 7 + cast(floor(frame_no / 24.0) as bigint)) % 5)"
ROUGH = f""",
rough as (select clip_id, seq, is_video, size, pts,
    case when is_video then dts + {AHEAD} else dts end dts, is_key, frame_no from samples),
rough_bounds as (select clip_id, 40 data_start,
    cast(floor(sum(size) * case when clip_id % 5 = 0 then 0.03 else 0.8 end) as bigint) + 40
    data_bound from samples group by clip_id),
rough_flagged as (select p.*, p."offset" + p.size <= b.data_bound is_complete
    from (select *, cast(40 + sum(size) over (partition by clip_id order by seq
      rows unbounded preceding) - size as bigint) "offset" from rough) p
    join rough_bounds b using (clip_id))
"""


def rough_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = log(spark, sf_dir)
    ahead = 1001 * F.expr("(clip_id * 7 + cast(floor(frame_no / 24.0) as bigint)) % 5")
    rough = samples.withColumn(
        "dts", F.when(F.col("is_video"), F.col("dts") + ahead).otherwise(F.col("dts"))
    )
    share = F.expr("case when clip_id % 5 = 0 then 0.03D else 0.8D end")
    bounds = samples.groupBy("clip_id").agg(
        F.lit(40).cast("bigint").alias("data_start"),
        (F.floor(F.sum("size") * F.first(share)).cast("bigint") + 40).alias("data_bound"),
    )
    return T.mark_complete(rough, bounds)


def resume_sql(source: str) -> str:
    """The resume rule written straight from its definition, with joins in place of scans."""
    return f"""
done as (select f.*, c.open_gop, c.fps_den from {source} f join clips c using (clip_id)
  where is_complete and is_video and frame_no >= 0),
keys as (select clip_id, seq, fps_den,
  case when open_gop = 1 and frame_no > 17 then frame_no - 17 else frame_no end cand
  from done where is_key),
lastkey as (select clip_id, arg_max(cand, seq) cap, max(fps_den) fps_den from keys group by clip_id),
stopped as (select clip_id, max(seq) at_seq from keys where cand = 0 group by clip_id),
asked as (select clip_id, cand k, fps_den from keys union
  select d.clip_id, d.frame_no, d.fps_den from done d union
  select clip_id, cap, fps_den from lastkey),
below as (select a.clip_id, a.k, a.fps_den, coalesce(max(d.dts), -1) top from asked a
  left join done d on d.clip_id = a.clip_id and d.frame_no < a.k group by 1, 2, 3),
good as (select clip_id, k from below where k > 0 and top < (k - 2) * fps_den),
by_key as (select k.clip_id, arg_max(k.cand, k.seq) frame from keys k
  join good g on g.clip_id = k.clip_id and g.k = k.cand
  left join stopped s on s.clip_id = k.clip_id where k.seq > coalesce(s.at_seq, -1) group by 1),
by_frame as (select g.clip_id, max(g.k) frame from good g join lastkey l using (clip_id)
  where g.k <= l.cap group by 1),
resume as (select c.clip_id, cast(coalesce(k.frame, f.frame, 0) as bigint) resume_frame
  from clips c left join by_key k using (clip_id) left join by_frame f using (clip_id))
"""


@query(
    "packet_offsets",
    with_samples('select clip_id, seq, size, "offset" from placed'),
)
def packet_offsets(spark, sf_dir):
    out = T.offsets(log(spark, sf_dir), tables.DATA_START)
    return out.select("clip_id", "seq", "size", "offset")


@query(
    "complete_prefix",
    with_samples('select clip_id, seq, is_video, size, "offset" from flagged where is_complete'),
)
def complete_prefix(spark, sf_dir):
    samples = log(spark, sf_dir)
    return T.complete_prefix(samples, tables.bounds(samples)).select(
        "clip_id", "seq", "is_video", "size", "offset"
    )


@query(
    "complete_count",
    with_samples(
        "select clip_id, cast(count(*) filter (is_complete) as bigint) complete_packets "
        "from flagged group by clip_id"
    ),
)
def complete_count(spark, sf_dir):
    return T.count_complete(flagged(spark, sf_dir))


@query(
    "video_count",
    with_samples(
        "select clip_id, cast(count(*) filter (is_video) as bigint) video_packets "
        "from samples group by clip_id"
    ),
)
def video_count(spark, sf_dir):
    return T.video_count(log(spark, sf_dir))


@query(
    "audio_end",
    with_samples(
        "select clip_id, cast(coalesce(max(case when not is_video then pts + size // 6 end), 0) "
        "as bigint) audio_end_sample from samples group by clip_id"
    ),
)
def audio_end(spark, sf_dir):
    return T.audio_end(log(spark, sf_dir), 2)


@query(
    "last_key",
    with_samples(
        "select clip_id, cast(coalesce(arg_max(frame_no, seq) "
        "filter (is_video and is_key and frame_no >= 0), 0) as bigint) last_key_frame "
        "from samples group by clip_id"
    ),
)
def last_key(spark, sf_dir):
    return T.last_key(log(spark, sf_dir))


@query(
    "prefix_max",
    with_samples(
        ", points as (select clip_id, frame_no from samples where is_video and is_key) "
        "select p.clip_id, p.frame_no, cast(coalesce(max(s.dts), -1) as bigint) max_dts "
        "from points p left join samples s on s.clip_id = p.clip_id and s.is_video "
        "and s.frame_no >= 0 and s.frame_no < p.frame_no group by 1, 2"
    ),
)
def prefix_max(spark, sf_dir):
    video = log(spark, sf_dir).filter("is_video")
    return T.prefix_max(video.filter("is_key"), video)


@query(
    "resume_point",
    with_samples("," + resume_sql("flagged") + "select clip_id, resume_frame from resume"),
)
def resume_point(spark, sf_dir):
    return T.resume_point(flagged(spark, sf_dir), tables.clips(log(spark, sf_dir)))


@query(
    "resume_point_rough",
    with_samples(
        ROUGH + "," + resume_sql("rough_flagged") + "select clip_id, resume_frame from resume"
    ),
)
def resume_point_rough(spark, sf_dir):
    return T.resume_point(rough_flagged(spark, sf_dir), tables.clips(log(spark, sf_dir)))


@query(
    "resume_report",
    with_samples(
        ROUGH
        + ","
        + resume_sql("rough_flagged")
        + """, counted as (select clip_id, count(*) filter (is_complete) packets,
  count(*) filter (is_complete and is_video) video,
  arg_max(frame_no, seq) filter (is_complete and is_video and is_key and frame_no >= 0) last,
  max(pts + size // 6) filter (is_complete and not is_video) audio
  from rough_flagged group by clip_id)
select clip_id, cast(packets as bigint) complete_packets,
  cast(least(video, frame_count) as bigint) video_frames,
  cast(coalesce(last, 0) as bigint) last_key_frame, resume_frame,
  cast(case when resume_frame > 0 then greatest(least(video, frame_count) - resume_frame, 0)
    else 0 end as bigint) frames_to_redo,
  cast(case when resume_frame > 0 then coalesce(audio, 0) else 0 end as bigint) resume_sample,
  case when video = 0 then 'no complete video' when resume_frame = 0 then 'first group only'
    else 'resume' end reason
from clips join counted using (clip_id) join resume using (clip_id)"""
    ),
)
def resume_report(spark, sf_dir):
    return T.resume_report(rough_flagged(spark, sf_dir), tables.clips(log(spark, sf_dir)))


@query(
    "purge_reorder",
    with_samples(
        ","
        + resume_sql("flagged")
        + """, kept as (select f.* from flagged f join resume r using (clip_id)
  where is_complete and (not is_video or frame_no < resume_frame)),
o as (select *, row_number() over line - 1 new_seq, sum(size) over (line
    rows between unbounded preceding and current row) - size place
  from kept window line as (partition by clip_id order by dts, is_video desc, seq))
select clip_id, cast(new_seq as bigint) seq, seq old_seq, is_video, size, pts, dts, is_key,
  frame_no, cast(place as bigint) "offset" from o"""
    ),
)
def purge_reorder(spark, sf_dir):
    marked = flagged(spark, sf_dir)
    return T.purge_reorder(marked, T.resume_point(marked, tables.clips(log(spark, sf_dir))))


@query(
    "session_shift",
    with_samples(
        ROUGH
        + ","
        + resume_sql("flagged")
        + """, top as (select f.clip_id, max(dts) + 1 floor_dts from flagged f
  join resume r using (clip_id)
  where is_complete and is_video and frame_no >= 0 and frame_no < resume_frame group by 1),
news as (select s.* replace (s.dts - 4004 as dts) from samples s join resume r using (clip_id)
  where not is_video or frame_no >= resume_frame),
moves as (select n.clip_id, greatest(coalesce(max(t.floor_dts), 0)
    - arg_min(greatest(n.dts, 0), n.seq), 0) by_ticks
  from news n left join top t using (clip_id) where is_video group by 1)
select clip_id, seq, is_video, size,
  cast(case when is_video then pts + coalesce(by_ticks, 0) else pts end as bigint) pts,
  cast(case when is_video then greatest(dts, 0) + coalesce(by_ticks, 0) else dts end as bigint) dts,
  cast(case when is_video then coalesce(by_ticks, 0) else 0 end as bigint) shift
from news left join moves using (clip_id)"""
    ),
)
def session_shift(spark, sf_dir):
    samples, marked = log(spark, sf_dir), flagged(spark, sf_dir)
    resume = T.resume_point(marked, tables.clips(samples))
    new = (
        samples.withColumn("dts", F.col("dts") - 4004)
        .join(resume, "clip_id")
        .filter("not is_video or frame_no >= resume_frame")
        .drop("resume_frame")
    )
    return T.session_shift(marked.filter("is_complete"), resume, new).select(
        "clip_id", "seq", "is_video", "size", "pts", "dts", "shift"
    )


@query(
    "monotone_dts",
    with_samples(
        ROUGH
        + """, r as (select *, greatest(dts - 5005, 0) d0, row_number() over
    (partition by clip_id order by seq) rn from rough where is_video),
m as (select *, rn + max(d0 - rn) over (partition by clip_id order by seq
    rows unbounded preceding) fixed from r)
select clip_id, seq, cast(case when fixed > d0 then greatest(pts, fixed) else pts end as bigint) pts,
  cast(fixed as bigint) dts, dts - 5005 <> fixed changed from m"""
    ),
)
def monotone_dts(spark, sf_dir):
    rough = rough_flagged(spark, sf_dir).withColumn("dts", F.col("dts") - 5005)
    return T.monotone_dts(rough).select("clip_id", "seq", "pts", "dts", "changed")


# Some frames lost (logged as something else) and some logged with the pts of the frame before, so
# that the cadence has faults to find.
WORN = """,
worn as (select * replace (is_video and size % 7 <> 0 as is_video,
  case when size % 41 = 0 then greatest(pts - 1001, 0) else pts end as pts) from samples)
"""


def worn(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).withColumns(
        {
            "is_video": F.expr("is_video and size % 7 <> 0"),
            "pts": F.expr("case when size % 41 = 0 then greatest(pts - 1001, 0) else pts end"),
        }
    )


CADENCE = """, t as (select clip_id, pts, count(*) copies from worn where is_video group by 1, 2),
s as (select *, lag(pts) over (partition by clip_id order by pts) prev_pts from t),
gaps as (select * from s where copies > 1 or (prev_pts is null and pts <> 0)
  or pts - prev_pts <> 1001)
"""


@query(
    "cadence_gaps",
    with_samples(
        WORN + CADENCE + "select clip_id, prev_pts, pts, cast(copies as bigint) copies from gaps"
    ),
)
def cadence_gaps(spark, sf_dir):
    return T.cadence_gaps(worn(spark, sf_dir), tables.clips(log(spark, sf_dir)))


@query(
    "cadence",
    with_samples(
        WORN
        + CADENCE
        + """, vc as (select clip_id, count(*) n from worn where is_video group by 1),
g as (select clip_id, count(*) n from gaps group by 1)
select clip_id, cast(coalesce(vc.n, 0) as bigint) video_packets,
  cast(coalesce(g.n, 0) as bigint) bad_steps,
  coalesce(g.n, 0) = 0 and coalesce(vc.n, 0) = frame_count ok
from clips left join vc using (clip_id) left join g using (clip_id)"""
    ),
)
def cadence(spark, sf_dir):
    return T.cadence(worn(spark, sf_dir), tables.clips(log(spark, sf_dir)))


DURATION = """, t as (select distinct clip_id, pts - (pts // 1001) % 3 pts from samples
  where is_video and size % 3 <> 0 and pts > 0),
d as (select *, pts - lag(pts) over (partition by clip_id order by pts) gap from t),
n as (select *, case when gap = lag(gap) over (partition by clip_id order by pts) then 0 else 1 end
  fresh from d where gap is not null),
r as (select *, sum(fresh) over (partition by clip_id order by pts rows unbounded preceding) run
  from n),
runs as (select clip_id, run, max(gap) gap, count(*) len, min(pts) at_pts from r group by 1, 2),
everyone as (select distinct clip_id from samples)
"""


def uneven(spark, sf_dir) -> DataFrame:
    """Lost frames and a jitter of up to two ticks, so that gaps differ."""
    jitter = F.expr("case when is_video and pts > 0 then pts - (pts div 1001) % 3 else pts end")
    return log(spark, sf_dir).withColumns(
        {"is_video": F.expr("is_video and size % 3 <> 0"), "pts": jitter}
    )


@query(
    "frame_duration",
    with_samples(
        DURATION
        + """, best as (select clip_id, gap, row_number() over (partition by clip_id
    order by len desc, at_pts) rk from runs)
select e.clip_id, cast(coalesce(b.gap, 1) as bigint) frame_ticks
from everyone e left join best b on b.clip_id = e.clip_id and rk = 1"""
    ),
)
def frame_duration(spark, sf_dir):
    return T.frame_duration(uneven(spark, sf_dir))


@query(
    "frame_duration_mode",
    with_samples(
        DURATION
        + """, best as (select clip_id, gap, row_number() over (partition by clip_id
    order by count(*) desc, gap) rk from d where gap is not null group by clip_id, gap)
select e.clip_id, cast(coalesce(b.gap, 1) as bigint) frame_ticks
from everyone e left join best b on b.clip_id = e.clip_id and rk = 1"""
    ),
)
def frame_duration_mode(spark, sf_dir):
    return T.frame_duration(uneven(spark, sf_dir), "mode")


@query(
    "non_empty_packets",
    with_samples(
        "select clip_id, seq, size - 500 as size from samples where size - 500 > 0"
    ),
)
def non_empty_packets(spark, sf_dir):
    shrunk = log(spark, sf_dir).withColumn("size", F.col("size") - 500)
    return T.non_empty(shrunk).select("clip_id", "seq", "size")


@query(
    "packet_duration",
    with_samples(
        "select clip_id, seq, cast(case when is_video then 1001 else size // 6 end as bigint) "
        "ticks from samples"
    ),
)
def packet_duration(spark, sf_dir):
    ticks = R.packet_duration("is_video", "size", F.lit(1001), F.lit(2))
    return log(spark, sf_dir).select("clip_id", "seq", ticks.alias("ticks"))


@query(
    "frame_clock",
    with_samples(
        "select clip_id, frame_no, frame_no * 1001 pts, "
        "((frame_no + 1) * 48000 * 1001) // 60000 sample_target from samples where is_video"
    ),
)
def frame_clock(spark, sf_dir):
    video = log(spark, sf_dir).filter("is_video")
    rate, num, den = (F.lit(v).cast("bigint") for v in (48000, 60000, 1001))
    return video.select(
        "clip_id",
        "frame_no",
        R.frame_pts("frame_no", den).alias("pts"),
        R.frame_sample_target("frame_no", rate, num, den).alias("sample_target"),
    )


# The same queries with chunks so small that even a short log crosses their borders.
FEW = 16


@query("packet_offsets_chunked", ORACLES["packet_offsets"])
def packet_offsets_chunked(spark, sf_dir):
    out = T.offsets(log(spark, sf_dir), tables.DATA_START, FEW)
    return out.select("clip_id", "seq", "size", "offset")


@query("complete_count_chunked", ORACLES["complete_count"])
def complete_count_chunked(spark, sf_dir):
    samples = log(spark, sf_dir)
    return T.count_complete(T.mark_complete(samples, tables.bounds(samples), FEW))


@query("complete_count_by_cut", ORACLES["complete_count"])
def complete_count_by_cut(spark, sf_dir):
    samples = log(spark, sf_dir)
    return T.count_complete(T.mark_by_cut(samples, tables.bounds(samples), (FEW, 4, 1)))


@query("resume_report_chunked", ORACLES["resume_report"])
def resume_report_chunked(spark, sf_dir):
    clips = tables.clips(log(spark, sf_dir))
    return T.resume_report(rough_flagged(spark, sf_dir), clips, FEW)


@query("purge_reorder_chunked", ORACLES["purge_reorder"])
def purge_reorder_chunked(spark, sf_dir):
    marked = flagged(spark, sf_dir)
    resume = T.resume_point(marked, tables.clips(log(spark, sf_dir)), FEW)
    return T.purge_reorder(marked, resume, chunk_rows=FEW)


@query("monotone_dts_chunked", ORACLES["monotone_dts"])
def monotone_dts_chunked(spark, sf_dir):
    rough = rough_flagged(spark, sf_dir).withColumn("dts", F.col("dts") - 5005)
    return T.monotone_dts(rough, FEW).select("clip_id", "seq", "pts", "dts", "changed")


@query("frame_duration_chunked", ORACLES["frame_duration"])
def frame_duration_chunked(spark, sf_dir):
    return T.frame_duration(uneven(spark, sf_dir), chunk_ticks=20_000)

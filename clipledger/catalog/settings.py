"""Queries over clip facts, settings and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipledger.catalog.base import duck, query, view
from clipledger.functions import rules as R
from clipledger.operators import settings as S
from clipledger.plans import tables


@query(
    "output_name",
    "select page_id, regexp_replace(url, '\\.[^./]*$', '') || '.h265.mov' output from pages",
)
def output_name(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select(
        "page_id", R.default_output("url").alias("output")
    )


RATES = """select p_partkey clip_id,
  case when p_size % 4 = 0 then null when p_size % 7 = 0 then 0 else p_size * 60000 end record_num,
  case when p_size % 3 = 0 then null when p_size % 11 = 0 then 0 else p_size * 21000 end record_den,
  case when p_size % 8 = 0 then 30000 else 24 end container_num,
  case when p_size % 8 = 0 then 1001 end container_den from {part}"""


@query(
    "fps_normalize",
    f"""with r as (select clip_id, case when record_num is not null then record_num
    else container_num end n, coalesce(case when record_num is not null then record_den
    else container_den end, 1) d from {duck(RATES)} q),
s as (select clip_id, case when n = 0 then 1 else n end fps_num,
  case when d = 0 then 1 else d end fps_den from r)
select clip_id, cast(fps_num as bigint) fps_num, cast(fps_den as bigint) fps_den,
  fps_den > 1000000 or fps_num > 2000000 fps_reject from s""",
)
def fps_normalize(spark, sf_dir):
    return S.normalize_fps(view(spark, sf_dir, RATES)).select(
        "clip_id", "fps_num", "fps_den", "fps_reject"
    )


AUDIO = """select p_partkey clip_id, p_size % 5 channels, p_size % 3 block_count,
  case when p_size % 7 = 0 then 0 when p_size % 7 = 1 then p_size * 20000 else 44100 end sample_rate,
  case when p_size % 6 = 0 then 16 else 24 end bits from {part}"""


@query(
    "audio_check",
    f"""select clip_id, channels > 0 and block_count > 0 audio_present,
  cast(case when channels > 0 and block_count > 0 and (sample_rate <= 0 or sample_rate > 384000)
    then 48000 else sample_rate end as bigint) sample_rate,
  channels > 0 and block_count > 0 and bits <> 24 audio_reject from {duck(AUDIO)} q""",
)
def audio_check(spark, sf_dir):
    return S.check_audio(view(spark, sf_dir, AUDIO)).select(
        "clip_id", "audio_present", "sample_rate", "audio_reject"
    )


SHOT = """select p_partkey clip_id, 3000 + p_size * 50 kelvin, cast(p_size / 4.0 as double) tint,
  100 * p_size iso, cast(p_size / 8.0 as double) exposure, 1 + p_size % 2 lens,
  p_size % 2 chroma_nr from {part}"""
USER = """select case when p_size % 13 = 0 then -p_partkey else p_partkey end clip_id,
  case when p_size % 2 = 0 then 0 else 5600 end kelvin,
  cast(case when p_size % 3 = 0 then 'NaN' else '1.5' end as double) tint,
  case when p_size % 5 = 0 then 0 else 800 end iso,
  cast(case when p_size % 7 = 0 then 'NaN' else '-0.25' end as double) exposure,
  p_size % 3 lens, case when p_size % 4 = 0 then -1 else 1 end chroma_nr from {part}"""


@query(
    "settings_overrides",
    f"""select s.clip_id,
  case when u.kelvin is null or u.kelvin = 0 then s.kelvin else u.kelvin end kelvin,
  case when u.tint is null or isnan(u.tint) then s.tint else u.tint end tint,
  case when u.iso is null or u.iso = 0 then s.iso else u.iso end iso,
  case when u.exposure is null or isnan(u.exposure) then s.exposure else u.exposure end exposure,
  case when u.chroma_nr is null or u.chroma_nr = -1 then s.chroma_nr else u.chroma_nr end chroma_nr,
  case when u.lens is null or u.lens = 0 then s.lens else u.lens end lens
from {duck(SHOT)} s left join {duck(USER)} u using (clip_id)""",
)
def settings_overrides(spark, sf_dir):
    return S.apply_overrides(view(spark, sf_dir, SHOT), view(spark, sf_dir, USER))


OPTIONS = """select l_orderkey * 8 + l_linenumber clip_id,
  cast(l_quantity as int) * 2500 kelvin, cast(l_quantity * 5 - 150 as double) tint,
  cast(l_quantity as bigint) * 250000 iso, cast(120 - l_quantity * 5 as double) exposure,
  l_linenumber * 9 crf, l_linenumber * 10 - 10 keyint, cast(l_quantity as int) min_keyint,
  l_linenumber * 200 pools, cast(l_quantity as int) * 6 cpu_workers,
  cast(l_quantity as int) * 90 jobs, l_linenumber - 1 buffers, l_linenumber % 4 open_gop,
  case when l_linenumber = 3 then 0 when l_linenumber = 4 then -2 else -1 end max_frames
  from {lineitem}"""

_RANGES = " union all ".join(
    f"select clip_id, '{name}' \"rule\", cast({name} as double) \"value\" from o "
    f"where {name} < {low} or {name} > {high}"
    for name, (low, high) in S.OPTION_RANGES.items()
)


@query(
    "settings_violations",
    f"""with o as (select * from {duck(OPTIONS)} q)
{_RANGES} union all
select clip_id, 'max_frames', cast(max_frames as double) from o
  where max_frames = 0 or max_frames < -1 or max_frames > 1000000000 union all
select clip_id, 'min_keyint above keyint', cast(min_keyint as double) from o
  where keyint > 0 and min_keyint > keyint""",
)
def settings_violations(spark, sf_dir):
    return S.validate_settings(view(spark, sf_dir, OPTIONS))


PRINT = """select p_partkey clip_id, p_size % 3 decode_mode, p_size * 100 kelvin,
  cast(case when p_size % 3 = 0 then 'NaN' else cast(p_size * 125 as string) end as double) / 1000 tint,
  p_size * 100 iso, cast(case when p_size % 4 = 0 then 'NaN' else '-0.5' end as double) exposure,
  p_size % 3 lens, -1 chroma_nr, 14 crf, p_type preset, 0 keyint, 1 min_keyint,
  p_size % 2 open_gop, 16 buffers, p_size % 2 = 0 faststart, p_size % 5 = 0 no_audio,
  -1 max_frames from {part}"""


FINGERPRINT_SQL = f"""select clip_id, sha256(concat('decode=', decode_mode, '|kelvin=', kelvin, '|tint=',
  case when isnan(tint) then 'nan' else printf('%.6f', tint) end, '|iso=', iso, '|exposure=',
  case when isnan(exposure) then 'nan' else printf('%.6f', exposure) end, '|lens=', lens,
  '|chromaNr=', chroma_nr, '|crf=', crf, '|preset=', preset, '|keyint=', keyint, '|minKeyint=',
  min_keyint, '|openGop=', open_gop, '|buffers=', buffers, '|faststart=',
  case when faststart then 1 else 0 end, '|noAudio=', case when no_audio then 1 else 0 end,
  '|maxFrames=', max_frames)) settings_hash from {duck(PRINT)} q"""


@query("settings_fingerprint", FINGERPRINT_SQL)
def settings_fingerprint(spark, sf_dir):
    return S.settings_hash(view(spark, sf_dir, PRINT)).select("clip_id", "settings_hash")


# Markers turned into nulls do not change the fingerprint.
@query("settings_fingerprint_cleaned", FINGERPRINT_SQL)
def settings_fingerprint_cleaned(spark, sf_dir):
    cleaned = S.clean_sentinels(view(spark, sf_dir, PRINT))
    return S.settings_hash(cleaned).select("clip_id", "settings_hash")


@query("content_fingerprint", "select doc_id, sha256(text) content_hash from documents")
def content_fingerprint(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", R.sha256_text("text").alias("content_hash")
    )


KEYINT = """select p_partkey clip_id, p_size * 500 fps_num,
  case when p_size % 2 = 0 then 1001 else 30000 end fps_den,
  case when p_size % 5 = 0 then p_size else 0 end keyint from {part}"""


@query(
    "key_interval",
    f"""select clip_id, cast(case when keyint > 0 then keyint
  else greatest(floor(fps_num::double / fps_den * 2.0::double + 0.5::double), 1) end as bigint) keyint
from {duck(KEYINT)} q""",
)
def key_interval(spark, sf_dir):
    return view(spark, sf_dir, KEYINT).select(
        "clip_id", R.auto_keyint("fps_num", "fps_den", "keyint").alias("keyint")
    )


RATE_TEXT = """select l_orderkey * 8 + l_linenumber clip_id, case when l_linenumber = 7 then 'n/a'
  when l_linenumber = 6 then '25/0' else
  concat(cast(l_quantity as int) * 1000, '/', cast(l_discount * 100 as int) * 100 + l_linenumber) end
  rate from {lineitem}"""


@query(
    "segment_frames",
    f"""with q as (select clip_id, regexp_extract(rate, '^([0-9]+)/([1-9][0-9]+)$', 1) n,
  regexp_extract(rate, '^([0-9]+)/([1-9][0-9]+)$', 2) d from {duck(RATE_TEXT)} z)
select clip_id, cast(case when n = '' then 600 else greatest((try_cast(n as bigint) * 10
  + try_cast(d as bigint) // 2) // try_cast(d as bigint), 1) end as bigint) frames from q""",
)
def segment_frames(spark, sf_dir):
    return view(spark, sf_dir, RATE_TEXT).select(
        "clip_id", R.segment_frames("rate").alias("frames")
    )


@query(
    "rational_text",
    f"""select clip_id, try_cast(regexp_extract(rate, '^([0-9]+)/([0-9]+)$', 1) as bigint) num,
  try_cast(regexp_extract(rate, '^([0-9]+)/([0-9]+)$', 2) as bigint) den from {duck(RATE_TEXT)} q""",
)
def rational_text(spark, sf_dir):
    pair = R.parse_rational("rate")
    return view(spark, sf_dir, RATE_TEXT).select(
        "clip_id", pair.num.alias("num"), pair.den.alias("den")
    )


SECONDS = """select l_orderkey, l_linenumber, (l_extendedprice - 5000) / 8 secs from {lineitem}"""


def duration_sql(column: str) -> str:
    s = f"cast(floor(greatest({column}, 0) + 0.5::double) as bigint)"
    two = lambda n: f"lpad(cast({n} as varchar), 2, '0')"
    short = f"{two(f'({s} % 3600) // 60')} || ':' || {two(f'{s} % 60')}"
    return f"case when {s} >= 3600 then cast({s} // 3600 as varchar) || ':' || {short} else {short} end"


@query(
    "duration_text",
    f"select l_orderkey, l_linenumber, {duration_sql('secs')} \"text\" "
    f"from {duck(SECONDS)} q",
)
def duration_text(spark, sf_dir):
    return view(spark, sf_dir, SECONDS).select(
        "l_orderkey", "l_linenumber", R.fmt_duration("secs").alias("text")
    )


JOBS = """select o_orderkey clip_id, cast(o_custkey * 3 as bigint) done,
  cast(case when o_orderkey % 9 = 0 then 0 else 2000 end as bigint) total, 60000 fps_num,
  case when o_orderkey % 10 = 0 then 0 else 1001 end fps_den,
  (o_orderkey % 16) / 8.0 fps, 1700000000.0 now_epoch from {orders}"""


@query(
    "progress",
    f"""with q as (select clip_id, cast(done as double) done, cast(total as double) total,
  cast(fps as double) fps, case when fps_den > 0 then fps_den else 1 end::double den,
  cast(now_epoch as double) now_epoch from {duck(JOBS)} z),
r as (select *, case when total > 0 then least(done / total, 1.0::double) else 0 end fraction,
  done * den / 60000.0::double a, total * den / 60000.0::double b,
  case when fps > 0.01::double then (total - done) / fps else 0 end w from q)
select clip_id, fraction,
  rpad(repeat('#', cast(floor(fraction * 20 + 0.5::double) as int)), 20, '-') bar,
  a media_done_s, b media_total_s, b - a media_left_s, w work_left_s, now_epoch + w eta_epoch,
  {duration_sql('a')} done_text, {duration_sql('b')} total_text, {duration_sql('w')} left_text,
  {duration_sql('(b - a)')} media_left_text from r""",
)
def progress(spark, sf_dir):
    jobs = view(spark, sf_dir, JOBS)
    for name in ("fps", "now_epoch"):
        jobs = jobs.withColumn(name, F.col(name).cast("double"))
    return S.progress(jobs).drop("done", "total", "fps_num", "fps_den", "fps", "now_epoch")


CAPPED = """select o_custkey clip_id, o_orderkey % 64 frame_no, 20 + o_custkey % 30 frame_count
  from {orders}"""


@query(
    "frame_cap",
    f"select clip_id, frame_no from {duck(CAPPED)} q where frame_no < least(32, frame_count)",
)
def frame_cap(spark, sf_dir):
    return S.cap_frames(view(spark, sf_dir, CAPPED), 32).select("clip_id", "frame_no")


META = """select event_id, user_id, event_type, props from {events}"""


@query(
    "meta_columns",
    """select event_id, json_extract_string(props, '$.k') k, event_type,
  cast(null as varchar) lens_name, cast(2 as bigint) map_size from events""",
)
def meta_columns(spark, sf_dir):
    pair = lambda key, value: F.array(F.lit(key), value.cast("string"))
    meta = F.array(
        pair("k", F.get_json_object("props", "$.k")),
        pair("event_type", F.col("event_type")),
        pair("event_type", F.lit("a later pair of the same key")),
    )
    rows = view(spark, sf_dir, META).withColumn("meta", meta)
    as_map = R.meta_map("meta")
    return rows.select(
        "event_id",
        R.meta_value("meta", "k").alias("k"),
        as_map["event_type"].alias("event_type"),
        R.meta_value("meta", "lens_name").alias("lens_name"),
        F.size(as_map).cast("bigint").alias("map_size"),
    )


# Sidecar-like texts whose hash sits under different names and depths.
HASHED = """select doc_id, case when doc_id % 4 = 0
    then concat('{{"n": {{"hash": "deep', doc_id, '"}}, "sha256": "top', doc_id, '"}}')
  when doc_id % 4 = 1 then concat('{{"a": 1, "src": {{"sha_256" : "in', doc_id, '"}}, "hash": "x"}}')
  when doc_id % 8 = 2 then concat('{{"sha256": null, "hash": "h', doc_id, '"}}')
  when doc_id % 8 = 6 then concat('{{"sha256": false, "note": "\\\\"hash\\\\": \\\\"no\\\\"", "n": {{"hash": "q\\\\"',
    doc_id, '"}}}}')
  else concat('{{"name": "', lang, '"}}') end doc from {documents}"""


@query(
    "json_first_key",
    """select doc_id, case doc_id % 4 when 0 then 'top' || doc_id when 1 then 'in' || doc_id
  when 2 then case when doc_id % 8 = 2 then 'h' else 'q"' end || doc_id end "found",
  doc_id % 4 in (0, 2) has_sha256 from documents""",
)
def json_first_key(spark, sf_dir):
    return view(spark, sf_dir, HASHED).select(
        "doc_id",
        R.json_first("doc", ["sha256", "sha_256", "sha-256", "hash"]).alias("found"),
        R.json_has("doc", "sha256").alias("has_sha256"),
    )

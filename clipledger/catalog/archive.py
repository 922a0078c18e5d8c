"""Queries over artifacts, checkpoints, sidecars, probes, and files on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.catalog.base import duck, query, view, with_samples
from clipledger.catalog.timeline import log
from clipledger.functions.rules import round_half_up
from clipledger.operators import arrivals as N
from clipledger.operators import artifacts as P
from clipledger.operators import frames as frame_files
from clipledger.operators import verify as V
from clipledger.plans import tables
from clipledger.session import scratch_path
from clipledger.sources import archive as files
from clipledger.sources import documents as docs
from clipledger.sources import intake, logparts, rawframes, samplelog

# --- checkpoints and states -----------------------------------------------------------------

CHECKPOINTS = """select cast(c_custkey as string) clip_key,
  case when c_custkey % 11 = 0 then '1.9' else '2.0' end toolVersion,
  concat('/in/', c_custkey, case when c_custkey % 13 = 0 then '.nev' else '.NEV' end) input,
  case when c_custkey % 5 = 0 then '' when c_custkey % 7 = 0 then 'old'
    else concat('h', c_custkey) end sourceSha256,
  case when c_custkey % 17 = 0 then 's1' else 's2' end settingsHash,
  c_custkey * 10 videoFrames, c_custkey * 8000 audioEndSample, c_custkey * 12 totalFrames
  from {customer}"""
NOW = """select case when c_custkey % 19 = 0 then concat('x', c_custkey)
    else cast(c_custkey as string) end clip_key, '2.0' tool_version,
  concat('/in/', c_custkey, '.NEV') input, concat('h', c_custkey) sha256, 's2' settings_hash
  from {customer}"""
MATCHED = f"""matched as (select c.clip_key, case when n.clip_key is null then 'no source'
    when "toolVersion" <> tool_version then 'other version'
    when c.input <> n.input then 'other input'
    when "sourceSha256" <> '' and "sourceSha256" <> sha256 then 'source changed'
    when "settingsHash" <> settings_hash then 'other settings'
    when "sourceSha256" = '' then 'unverified' else 'match' end status
  from {duck(CHECKPOINTS)} c left join {duck(NOW)} n on n.clip_key = c.clip_key)"""


def matches(spark, sf_dir) -> DataFrame:
    return P.match_checkpoints(view(spark, sf_dir, CHECKPOINTS), view(spark, sf_dir, NOW))


@query(
    "checkpoint_match",
    f"with {MATCHED} select clip_key, status, status in ('match', 'unverified') usable from matched",
)
def checkpoint_match(spark, sf_dir):
    return matches(spark, sf_dir)


PARTS = """select cast(o_custkey as string) clip_key, concat('/out/', o_custkey, case
    when o_totalprice > 150000 then '.txt' when o_orderpriority = '1-URGENT' then '.part'
    when o_orderpriority = '2-HIGH' then '.samples' when o_orderpriority = '3-MEDIUM' then '.ckpt'
    when o_orderpriority = '4-NOT SPECIFIED' then '.part.old' else '.txt' end) path from {orders}"""
STATES = f"""f as (select clip_key, bool_or(path like '%.part') p, bool_or(path like '%.part.old') o,
    bool_or(path like '%.samples') s, bool_or(path like '%.ckpt') k from {duck(PARTS)} q group by 1),
j as (select coalesce(f.clip_key, m.clip_key) clip_key, coalesce(p, false) p, coalesce(o, false) o,
    coalesce(s, false) s, coalesce(k, false) k, coalesce(status in ('match', 'unverified'), false) u
  from f full join matched m on f.clip_key = m.clip_key)"""


@query(
    "artifact_state",
    f"""with {MATCHED}, {STATES}
select clip_key, p has_part, o has_part_old, s has_samples, k has_ckpt,
  case when not p then case when o then 'ROLL_BACK' else 'FRESH' end
    when not (s and k and u) then 'REJECT'
    when cast(clip_key as bigint) % 4 <> 0 then 'RESUMABLE'
    when o then 'ROLL_BACK' else 'FRESH' end state from j""",
)
def artifact_state(spark, sf_dir):
    found = view(spark, sf_dir, PARTS).withColumn("kind", P.kind_of(F.col("path")))
    progress = view(spark, sf_dir, CHECKPOINTS).select(
        "clip_key", (F.col("clip_key").cast("bigint") % 4).alias("resume_frame")
    )
    return P.artifact_state(found, matches(spark, sf_dir), progress)


SOURCES = """select concat('/in/', c_custkey, case when c_custkey % 2 = 0 then '.NEV' else '.nev' end)
  path, c_custkey % 23 <> 0 is_regular from {customer}"""
OUTPUTS = """select concat('/in/', o_custkey, case when o_totalprice > 100000 then '.txt'
    when o_orderstatus = 'F' then '.h265.mov' when o_orderstatus = 'O'
    then '.h265.mov.sidecar.json' else '.txt' end) path from {orders}"""
REASONS = f"""have as (select regexp_extract(path, '/in/([0-9]+)', 1) k,
    bool_or(path like '%.mov') o, bool_or(path like '%.json') s from {duck(OUTPUTS)} q group by 1),
reasons as (select path, '/in/' || regexp_extract(path, '/in/([0-9]+)', 1) || '.h265.mov' clip_key,
    case when not is_regular then 'not a file' when not coalesce(o, false) then 'new'
      when coalesce(s, false) then 'done' else 'no sidecar' end reason
  from {duck(SOURCES)} q left join have on k = regexp_extract(path, '/in/([0-9]+)', 1))"""


def outputs(spark, sf_dir) -> DataFrame:
    return P.classify(view(spark, sf_dir, OUTPUTS))


@query(
    "pending_sources",
    f"with {REASONS} select * from reasons where reason in ('new', 'no sidecar')",
)
def pending_sources(spark, sf_dir):
    return P.pending(view(spark, sf_dir, SOURCES), outputs(spark, sf_dir))


@query(
    "pending_sources_forced",
    f"with {REASONS} select path, clip_key, case when reason in ('done', 'no sidecar') then 'forced' "
    "else reason end reason from reasons where reason <> 'not a file'",
)
def pending_sources_forced(spark, sf_dir):
    return P.pending(view(spark, sf_dir, SOURCES), outputs(spark, sf_dir), force=True)


TWICE = """select concat('/in/', c_custkey, '.NEV') path from {customer} union all
  select concat('/in/', c_custkey, case when c_acctbal < 0 then '.nev' else '-b.nev' end)
  from {customer} union all
  select concat('/in/', o_custkey, case when o_orderstatus = 'P' then '' else '-c' end, '.NEV')
  from {orders}"""


@query(
    "name_collisions",
    f"""select regexp_replace(path, '\\.[^./]*$', '') || '.h265.mov' clip_key,
  cast(count(*) as bigint) sources, min(path) first_path, max(path) last_path
from {duck(TWICE)} q group by 1 having count(*) > 1""",
)
def name_collisions(spark, sf_dir):
    return P.name_collisions(view(spark, sf_dir, TWICE))


RUNS = """select o_orderpriority batch, concat('/in/', o_orderkey, '.NEV') clip_key,
  case o_orderstatus when 'F' then 'fail' when 'O' then 'ok' else case when o_orderkey % 5 = 0
    then 'other' else 'skip' end end status, o_orderdate started, o_orderdate ended,
  concat('archive --crf ', o_orderkey % 30) command from {orders}"""


@query(
    "batch_summary",
    f"""select batch, cast(count(*) filter (status = 'ok') as bigint) ok,
  cast(count(*) filter (status = 'fail') as bigint) failed,
  cast(count(*) filter (status = 'skip') as bigint) skipped, cast(count(*) as bigint) total,
  cast(epoch(max(ended)) - epoch(min(started)) as bigint) elapsed_s
from {duck(RUNS)} q group by batch""",
)
def batch_summary(spark, sf_dir):
    runs = view(spark, sf_dir, RUNS)
    for name in ("started", "ended"):
        runs = runs.withColumn(name, F.col(name).cast("timestamp"))
    return P.batch_summary(runs, ["batch"])


OUTPUT_LINES = """select concat('/in/', l_orderkey, '.NEV') clip_key,
  cast(l_linenumber * 100000 + l_partkey as bigint) output_line_no,
  concat('frame ', l_partkey, ' ', l_returnflag) output_line from {lineitem}"""


FAILURES = f"""with last as (select *, row_number() over (partition by clip_key order by output_line_no desc, output_line desc) rk
  from (select distinct * from {duck(OUTPUT_LINES)} q) q),
t as (select clip_key, string_agg('    ' || output_line, chr(10) order by output_line_no, output_line) txt
  from last where rk <= 5 group by 1)
select r.clip_key, strftime(ended, '%Y-%m-%d %H:%M:%S') || ' [failed] file: ' || r.clip_key || chr(10)
  || '  command: ' || command || chr(10) || '  output:' || coalesce(chr(10) || txt, '') "text"
from {duck(RUNS)} r left join t using (clip_key) where status = 'fail'"""


@query("failure_report", FAILURES)
def failure_report(spark, sf_dir):
    runs = view(spark, sf_dir, RUNS).withColumn("ended", F.col("ended").cast("timestamp"))
    return docs.failure_report(runs, view(spark, sf_dir, OUTPUT_LINES).distinct())


@query(
    "failure_log_write",
    f"""select line, cast(count(*) as bigint) times from (
  select unnest(string_split("text" || chr(10), chr(10))) line from ({FAILURES}) f) q group by line""",
)
def failure_log_write(spark, sf_dir):
    folder = scratch_path(spark, "failures")
    runs = view(spark, sf_dir, RUNS).withColumn("ended", F.col("ended").cast("timestamp"))
    docs.write_failures(runs, view(spark, sf_dir, OUTPUT_LINES).distinct(), folder)
    lines = spark.read.text(folder).withColumnRenamed("value", "line")
    return lines.groupBy("line").agg(F.count("*").alias("times"))


@query(
    "tail_lines",
    """select user_id, event_id, event_type, cast(rk as int) rank from (select *, row_number() over
  (partition by user_id order by event_id desc) rk from events) q where rk <= 5""",
)
def tail_lines(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return N.tail_n(events, ["user_id"], ["event_id"], 5)


# --- arrivals -------------------------------------------------------------------------------

ARRIVALS = """select user_id clip_id, event_id arrival,
  event_id + (event_id * 37) % 11 * 40 - (event_id * 53) % 7 * 90 n from {events}"""


@query(
    "ordered_dedup",
    f"""select clip_id, arrival, n from (select *, max(case when n >= 0 then n end) over
  (partition by clip_id order by arrival rows between unbounded preceding and 1 preceding) high
  from {duck(ARRIVALS)} a) q where n >= 0 and n > coalesce(high, -1)""",
)
def ordered_dedup(spark, sf_dir):
    return N.ordered_dedup(view(spark, sf_dir, ARRIVALS))


# Pairs swap places; rare numbers are lost and turn up far ahead.
NUMBERED = """, numbered as (select clip_id, seq, seq + case seq % 4 when 0 then 2 when 2 then -2
  else 0 end + case when size % 29 = 0 and seq > 6 then 1000000 else 0 end n from samples)
"""
NUMBER = (
    "seq + case seq % 4 when 0 then 2 when 2 then -2 else 0 end"
    " + case when size % 29 = 0 and seq > 6 then 1000000 else 0 end"
)



def numbered(spark, sf_dir) -> DataFrame:
    return log(spark, sf_dir).select("clip_id", "seq", F.expr(NUMBER).alias("n"))


@query(
    "release_prefix",
    with_samples(
        NUMBERED
        + """select clip_id, cast(n as bigint) n, n - 1 = row_number() over
  (partition by clip_id order by n) released from (select distinct clip_id, n from numbered) q
  where n >= 2"""
    ),
)
def release_prefix(spark, sf_dir):
    return N.release_prefix(numbered(spark, sf_dir), start=2)


SHARDED = """, sharded as (select clip_id, seq % 3 shard, seq arrival,
  10 + seq + case when size % 83 = 0 then 3 else 0 end n from samples)
"""


@query(
    "shard_audit",
    with_samples(
        SHARDED
        + """, j as (select *, 10 + shard + 3 * (row_number() over
  (partition by clip_id, shard order by arrival) - 1) expected from sharded),
bad as (select *, row_number() over (partition by clip_id, shard order by arrival) rk from j
  where n <> expected)
select clip_id, cast(shard as bigint) shard, arrival, cast(n as bigint) n,
  cast(expected as bigint) expected from bad where rk = 1"""
    ),
)
def shard_audit(spark, sf_dir):
    rows = log(spark, sf_dir).select(
        "clip_id",
        F.expr("seq % 3").alias("shard"),
        F.col("seq").alias("arrival"),
        F.expr("10 + seq + case when size % 83 = 0 then 3 else 0 end").alias("n"),
    )
    return N.audit_shards(rows, 3, 10)


# --- verification ---------------------------------------------------------------------------

STREAM_FACTS = """select concat('/out/', p_partkey, '.h265.mov') path,
  case when p_size % 13 <> 0 then 1920 + p_size end w, case when p_size % 29 = 0 then 0 else 1080 end h,
  case when p_size % 9 = 0 then 'h264' else 'hevc' end codec,
  case when p_size % 10 = 0 then 'Main' else 'Main 10' end profile,
  case when p_size % 12 = 0 then 'yuv420p' else 'yuv420p10le' end pix,
  case when p_size % 14 = 0 then 'bt709' when p_size % 2 = 0 then 'bt2020nc' else 'bt2020c' end cs,
  case when p_size % 15 = 0 then 'tv' when p_size % 2 = 0 then 'pc' else 'jpeg' end cr,
  case when p_size % 4 <> 0 then case when p_size % 17 = 0 then 96000 else 48000 end end rate,
  p_size % 3 ch from {part}"""


def probe(spark, sf_dir) -> DataFrame:
    c = F.col
    none = F.lit(None)
    stream = lambda **kw: F.struct(
        *[
            kw.get(name, none).cast(kind).alias(name)
            for name, kind in (
                ("codec_name", "string"),
                ("profile", "string"),
                ("pix_fmt", "string"),
                ("color_space", "string"),
                ("color_range", "string"),
                ("r_frame_rate", "string"),
                ("width", "int"),
                ("height", "int"),
                ("sample_rate", "int"),
                ("channels", "int"),
            )
        ]
    )
    video = stream(
        codec_name=c("codec"),
        profile=c("profile"),
        pix_fmt=c("pix"),
        color_space=c("cs"),
        color_range=c("cr"),
        width=c("w"),
        height=c("h"),
    )
    audio = stream(codec_name=F.lit("pcm_s24le"), sample_rate=c("rate"), channels=c("ch"))
    data = stream(codec_name=F.lit("tmcd"))
    return view(spark, sf_dir, STREAM_FACTS).select(
        "path", F.array(data, audio, video, audio).alias("streams")
    )


@query(
    "stream_summary",
    f"""select path, cast(case when w is null then 0 else 1 end as bigint) video_streams,
  cast(case when rate is null then 0 else 2 end as bigint) audio_streams,
  case when w is not null then codec end codec_name, case when w is not null then profile end profile,
  case when w is not null then pix end pix_fmt, case when w is not null then cs end color_space,
  case when w is not null then cr end color_range, w width, case when w is not null then h end height,
  rate sample_rate, case when rate is not null then ch end channels from {duck(STREAM_FACTS)} q""",
)
def stream_summary(spark, sf_dir):
    return V.stream_summary(probe(spark, sf_dir))


SIDECAR_TEXT = """select concat(case when p_size % 7 = 0 then '/lost/' else '/out/' end, p_partkey,
  '.h265.mov') path, concat('{{"source": "/in/',
  p_partkey, '.NEV", "encode": {{"crf": 14', case when p_size % 11 = 0 then '' else ', "keyint": 120' end,
  '}}, "matrix": "BT.2020", "decode_path": "', case when p_size % 3 = 0 then 'gpu' when p_size % 31 = 0
  then 'tpu' else 'cpu' end, '", "gpu_device": ', case when p_size % 6 = 0 then 'null' else '"card 0"' end,
  case when p_size % 9 = 0 then '' else ', "gate_psnr_db": null' end, '}}') text, p_size from {part}"""
RULES = f"""s as (select path, w is not null v, rate is not null a, q.* exclude (path)
    from {duck(STREAM_FACTS)} q),
t as (select path, p_size from {duck(SIDECAR_TEXT)} q),
m as (select s.*, t.path is not null has, p_size % 3 = 0 gpu, p_size from s left join t using (path)),
rules as (
  select path, 'video stream' "rule", v ok, true applies from m union all
  select path, 'codec', v and codec = 'hevc', true from m union all
  select path, 'profile', v and profile = 'Main 10', true from m union all
  select path, 'pixel format', v and pix = 'yuv420p10le', true from m union all
  select path, 'color space', v and cs like 'bt2020%', true from m union all
  select path, 'color range', v and cr in ('pc', 'jpeg'), true from m union all
  select path, 'size', v and w > 0 and h > 0, true from m union all
  select path, 'sample rate', rate between 44000 and 52000, a from m union all
  select path, 'channels', ch >= 1, a from m union all
  select path, 'sidecar crf', true, has from m union all
  select path, 'sidecar keyint', p_size % 11 <> 0, has from m union all
  select path, 'sidecar matrix', true, has from m union all
  select path, 'decode path', p_size % 3 = 0 or p_size % 31 <> 0, has from m union all
  select path, 'gpu device', p_size % 6 <> 0, has and gpu from m union all
  select path, 'gate value', p_size % 9 <> 0, has and gpu from m),
checked as (select path, "rule", case when not coalesce(applies, false) then 'info'
    when coalesce(ok, false) then 'pass' else 'fail' end status from rules)"""


def archive_rule_rows(spark, sf_dir) -> DataFrame:
    sidecars = V.read_sidecar_text(view(spark, sf_dir, SIDECAR_TEXT).select("path", "text"))
    return V.verify_archives(V.stream_summary(probe(spark, sf_dir)), sidecars)


@query("archive_rules", f"with {RULES} select * from checked")
def archive_rules(spark, sf_dir):
    return archive_rule_rows(spark, sf_dir)


@query(
    "archive_verdict",
    f"""with {RULES} select path, cast(count(*) filter (status = 'fail') as bigint) failed_rules,
  case when count(*) filter (status = 'fail') = 0 then 'PASS' else 'FAIL' end verdict
from checked group by path""",
)
def archive_verdict(spark, sf_dir):
    return V.verdict(archive_rule_rows(spark, sf_dir))


# Documents as sources: a third of the archives names the same source.
HASHED_SOURCES = """select concat(case when doc_id % 8 = 7 then '/lost/' else '/in/' end, lang, '/',
  doc_id, '.NEV') path, text from {documents}"""
RECORDED = """select concat('/in/', d.lang, '/', d.doc_id, '.h265.mov') path,
  case when doc_id % 5 = 0 then 'wrong' when doc_id % 9 = 4 then null else text end want,
  case when doc_id % 3 = 0 then concat('/moved/', doc_id, '.NEV')
    when doc_id % 3 = 1 then concat('/in/', lang, '/', doc_id, '.NEV') end name_one,
  case when doc_id % 3 = 2 then '/in/en/1.NEV' end name_two from {documents} d"""


@query(
    "source_hash_check",
    f"""with h as (select path, sha256(text) hash from {duck(HASHED_SOURCES)} q),
w as (select path, case when want is null then null else sha256(want) end want, name_one, name_two
  from {duck(RECORDED)} q),
n as (select path, want, name_one nm from w union all select path, want, name_two from w),
g as (select n.path, want, coalesce(a.hash, b.hash) got from n left join h a on a.path = nm
  left join h b on b.path = regexp_extract(n.path, '^(.*/)', 1) || regexp_extract(nm, '([^/]*)$', 1)
  where nm is not null),
f as (select path, count(got) found, count(*) filter (got = want) same from g group by 1)
select w.path, case when want is null then 'no hash' when same > 0 then 'pass'
  when found > 0 then 'fail' else 'not found' end status from w left join f using (path)""",
)
def source_hash_check(spark, sf_dir):
    hashes = view(spark, sf_dir, HASHED_SOURCES).select("path", F.sha2("text", 256).alias("sha256"))
    sidecars = view(spark, sf_dir, RECORDED).select(
        "path", F.sha2("want", 256).alias("sha256"), F.array("name_one", "name_two").alias("candidates")
    )
    return V.verify_source_hash(sidecars, hashes)


# --- files ----------------------------------------------------------------------------------


@query(
    "sample_log_round_trip",
    with_samples(
        "select cast(clip_id as varchar) clip_id, seq, is_video, size, pts, dts, is_key, frame_no "
        "from samples"
    ),
)
def sample_log_round_trip(spark, sf_dir):
    folder = scratch_path(spark, "logs")
    samplelog.write_logs(
        log(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string")), folder
    )
    return spark.read.format("samplelog").option("clipId", "name").load(folder)


LOGS_SQL = with_samples(
    "select cast(clip_id as varchar) clip_id, seq, is_video, size, pts, dts, is_key, frame_no from samples"
)


@query("sample_log_tree_scan", LOGS_SQL)
def sample_log_tree_scan(spark, sf_dir):
    """Logs in several folders, listed and cut into ranges by tasks."""
    folder = scratch_path(spark, "logs").removeprefix("file:")
    samples = log(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string"))
    for part in range(3):
        samplelog.write_logs(samples.filter(F.expr(f"cast(clip_id as bigint) % 3 = {part}")), f"{folder}/{part}/logs")
    return intake.scan_logs(spark, folder, by_name=True)


@query("sample_log_parts_round_trip", LOGS_SQL)
def sample_log_parts_round_trip(spark, sf_dir):
    """Logs as parts with a manifest, in two writes."""
    folder = scratch_path(spark, "logs").removeprefix("file:")
    samples = log(spark, sf_dir).withColumn("clip_id", F.col("clip_id").cast("string"))
    for part in range(2):
        logparts.write_log_parts(samples.filter(F.expr(f"cast(clip_id as bigint) % 2 = {part}")), folder)
    return logparts.read_log_parts(spark, folder)


@query(
    "checkpoint_table_round_trip",
    f"""select clip_key, 1 "version", "toolVersion", input, "sourceSha256", "settingsHash",
  cast("videoFrames" as bigint) "videoFrames", cast("audioEndSample" as bigint) "audioEndSample",
  cast("totalFrames" as bigint) "totalFrames", true is_valid from {duck(CHECKPOINTS)} q""",
)
def checkpoint_table_round_trip(spark, sf_dir):
    folder = scratch_path(spark, "checkpoints")
    newest = view(spark, sf_dir, CHECKPOINTS).withColumn("version", F.lit(1))
    older = newest.withColumn("videoFrames", F.col("videoFrames") - 7)
    snapshots = older.withColumn("taken", F.lit(1)).union(newest.withColumn("taken", F.lit(2)))
    docs.write_checkpoints(older.withColumn("taken", F.lit(0)), folder, "taken")
    docs.write_checkpoints(snapshots, folder, "taken")
    return docs.read_checkpoint_table(spark, folder)


@query(
    "checkpoint_bucket_round_trip",
    f"""select clip_key, 1 "version", "toolVersion", input, "sourceSha256", "settingsHash",
  cast("videoFrames" as bigint) "videoFrames", cast("audioEndSample" as bigint) "audioEndSample",
  cast("totalFrames" as bigint) "totalFrames", true is_valid from {duck(CHECKPOINTS)} q""",
)
def checkpoint_bucket_round_trip(spark, sf_dir):
    """Older snapshots of all clips, then the newest in two versions of some clips each."""
    folder = scratch_path(spark, "checkpoints").removeprefix("file:")
    newest = view(spark, sf_dir, CHECKPOINTS).withColumn("version", F.lit(1))
    older = newest.withColumn("videoFrames", F.col("videoFrames") - 7)
    half = F.pmod(F.xxhash64("clip_key"), F.lit(2)) == 0
    for k, rows in enumerate((older, newest.filter(half), newest.filter(~half))):
        docs.write_checkpoint_buckets(rows.withColumn("taken", F.lit(k)), folder, "taken", buckets=16)
    return docs.read_checkpoint_buckets(spark, folder)


CKPT_TEXT = """select doc_id, case when doc_id % 4 = 0 then concat('{{"version":1,"toolVersion":"2.0",',
    '"sourceSha256":"","settingsHash":"s","videoFrames":', doc_id,
    ',"audioEndSample":0,"totalFrames":9}}')
  when doc_id % 4 = 1 then concat('{{"version":1,"toolVersion":"2.0","input":"a \\\\"b\\\\".NEV",',
    '"sourceSha256":"x","settingsHash":"s","videoFrames":1,"audioEndSample":0,"totalFrames":9}}')
  when doc_id % 4 = 2 then '{{"version":1,"toolVersion":"2.0","videoFrames":5}}'
  else '{{"version":1,"toolVer' end text from {documents}"""


@query(
    "checkpoint_parse",
    """select doc_id, case when doc_id % 4 = 1 then 'a "b".NEV' end input,
  cast(case doc_id % 4 when 0 then doc_id when 1 then 1 when 2 then 5 end as bigint) "videoFrames",
  doc_id % 4 < 2 is_valid from documents""",
)
def checkpoint_parse(spark, sf_dir):
    return docs.parse_checkpoints(view(spark, sf_dir, CKPT_TEXT)).select("doc_id", "input", "videoFrames", "is_valid")


# Names that an address would encode.
ODD_NAME = "clip a%20+é#"


@query(
    "checkpoint_scan",
    f"""select '{ODD_NAME}' || doc_id || '.h265.mov' name, case when doc_id % 4 = 1 then 'a "b".NEV' end input,
  cast(case doc_id % 4 when 0 then doc_id when 1 then 1 when 2 then 5 end as bigint) "videoFrames",
  doc_id % 4 < 2 is_valid from documents""",
)
def checkpoint_scan(spark, sf_dir):
    folder = scratch_path(spark, "checkpoints").removeprefix("file:")
    name = F.concat(F.lit(f"{folder}/{ODD_NAME}"), F.col("doc_id"), F.lit(".h265.mov.ckpt"))
    docs.write_files(
        view(spark, sf_dir, CKPT_TEXT).select(name.alias("path"), F.encode("text", "utf-8").alias("content"))
    )
    return docs.read_checkpoints(spark, folder).select(
        F.regexp_extract("clip_key", r"([^/]*)$", 1).alias("name"), "input", "videoFrames", "is_valid"
    )


SIDECARS = """select concat('/out/', p_partkey, '.h265.mov') clip_key, '1.0' tool_version,
  '9.2' sdk_version, concat('/in/"', p_name, '"/', p_partkey, '.NEV') input, 'ab' sha256,
  cast(4000 + p_size as bigint) width, cast(2000 as bigint) height, cast(p_size as bigint) frames_done,
  cast(p_size + 5 as bigint) frame_count, cast(60000 as bigint) fps_num, cast(1001 as bigint) fps_den,
  2 channels, 48000 sample_rate, 24 bits, p_size % 3 lens, p_size % 2 = 0 gpu_used,
  case when p_size % 2 = 0 then 'card' else '' end gpu_device, p_size % 4 <> 1 gated,
  cast(case when p_size % 4 = 0 then 0 else 55 + p_size / 7.0 end as double) gate_psnr, '' note,
  cast(5600 as double) kelvin, cast(case when p_size % 5 = 0 then 'NaN' else '1.23456789' end as double) tint,
  cast(800 as bigint) iso, cast(-0.5 as double) exposure, 14 crf, 'slow' preset,
  case when p_size % 6 = 0 then 48 else 0 end keyint, 0 min_keyint, 0 pools, p_size % 9 <> 0 success
  from {part}"""


@query(
    "sidecar_round_trip",
    f"""select clip_key, input source, frames_done frame_count, '60000/1001' fps,
  case lens when 1 then 'on' when 2 then 'off' else 'auto' end lens_correction,
  case when gpu_used then 'gpu' else 'cpu' end decode_path,
  case when gpu_device = '' then null else gpu_device end gpu_device,
  case when gated and gate_psnr > 0 then cast(printf('%.5e', gate_psnr) as double) end gate_psnr_db,
  cast(null as varchar) decode_note, case when not isnan(tint) then 1.23457::double end tint,
  cast(case when keyint > 0 then keyint else 120 end as int) keyint, 1 min_keyint, 8 pools, success,
  'lens ' || clip_key lens_name from {duck(SIDECARS)} q""",
)
def sidecar_round_trip(spark, sf_dir):
    folder = scratch_path(spark, "sidecars").removeprefix("file:")
    meta = F.array(F.array(F.lit("lens_name"), F.concat(F.lit("lens "), F.col("clip_key"))))
    rows = view(spark, sf_dir, SIDECARS).withColumn("meta", meta)
    docs.write_sidecars(rows.withColumn("clip_key", F.concat(F.lit(folder), F.col("clip_key"))))
    back = docs.read_sidecars(spark, f"file:{folder}")
    return back.select(
        F.regexp_replace("clip_key", r"^.*(/out/[^/]*)$", "$1").alias("clip_key"),
        "source",
        "frame_count",
        "fps",
        "lens_correction",
        "decode_path",
        "gpu_device",
        "gate_psnr_db",
        "decode_note",
        "applied.tint",
        "encode.keyint",
        "encode.min_keyint",
        "encode.pools",
        "success",
        F.col("meta")[0][1].alias("lens_name"),
    )


# One small movie file per turn of a conversation: a header box and the media box, which holds two
# length-prefixed packets (the role and the text). Some files were never finished, some prefixes
# are damaged.
MOVIES = """select concat('/', conv_id, '-', turn) name, conv_id, turn, role, text from {conversations}"""
MOVIE_FACTS = f"""select name, turn, octet_length(encode(role)) + 4 r, octet_length(encode(text)) + 4 t,
  (conv_id * 5 + turn) % 3 = 0 open, (conv_id + turn * 5) % 11 = 0 damaged from {duck(MOVIES)} q"""


def _be(value, width: int = 8):
    return F.unhex(F.lpad(F.hex(value), width, "0"))


def write_movies(spark, sf_dir) -> str:
    """Write the movie files and return their folder."""
    folder = scratch_path(spark, "movies").removeprefix("file:")
    role, text = F.encode("role", "utf-8"), F.encode("text", "utf-8")
    is_open = F.expr("(conv_id * 5 + turn) % 3 = 0")
    damaged = F.expr("(conv_id + turn * 5) % 11 = 0")
    body = F.concat(
        _be(F.octet_length(role)),
        role,
        _be(F.octet_length(text) + F.when(damaged, 1).otherwise(0)),
        text,
    )
    size = F.octet_length(body) + 8
    declared = F.when(is_open, size + 1000).otherwise(size)
    head = F.concat(_be(F.lit(16)), F.encode(F.lit("ftypqt  abcd"), "utf-8"))
    tail = F.when(is_open, F.unhex(F.lit(""))).otherwise(
        F.concat(_be(F.lit(12)), F.encode(F.lit("moovwxyz"), "utf-8"))
    )
    media = F.concat(_be(declared), F.encode(F.lit("mdat"), "utf-8"), body)
    docs.write_files(
        view(spark, sf_dir, MOVIES).select(
            F.concat(F.lit(folder), F.col("name"), F.lit(".part")).alias("path"),
            F.concat(head, media, tail).alias("content"),
        )
    )
    return folder


@query(
    "artifact_scan",
    f"""select name || '.part' name, 'part' kind,
  cast(24 + r + t + case when open then 0 else 12 end as bigint) length from ({MOVIE_FACTS}) q""",
)
def artifact_scan(spark, sf_dir):
    folder = write_movies(spark, sf_dir)
    return files.scan_artifacts(spark, folder).select(
        F.regexp_extract("path", r"(/[^/]*)$", 1).alias("name"), "kind", "length"
    )


@query(
    "box_index",
    f"""select name, cast(24 as bigint) data_start, cast(24 + r + t as bigint) data_bound,
  cast(2 as bigint) boxes from ({MOVIE_FACTS}) q""",
)
def box_index(spark, sf_dir):
    folder = write_movies(spark, sf_dir)
    return files.box_index(files.scan_artifacts(spark, folder)).select(
        F.regexp_extract("path", r"(/[^/]*)\.part$", 1).alias("name"),
        "data_start",
        "data_bound",
        F.size("boxes").cast("bigint").alias("boxes"),
    )


def movie_ranges(spark, sf_dir) -> DataFrame:
    """Packets of the movie files with the byte range of each."""
    folder = write_movies(spark, sf_dir)
    found = files.scan_artifacts(spark, folder).select(
        F.regexp_extract("path", r"(/[^/]*)\.part$", 1).alias("clip_id"), "path"
    )
    packet = lambda seq, column: F.struct(
        F.lit(seq).cast("bigint").alias("seq"),
        (F.octet_length(F.encode(column, "utf-8")) + 4).cast("bigint").alias("size"),
    )
    samples = (
        view(spark, sf_dir, MOVIES)
        .select(
            F.col("name").alias("clip_id"),
            F.explode(F.array(packet(0, "role"), packet(1, "text"))).alias("p"),
        )
        .select(
            "clip_id",
            "p.seq",
            F.lit(True).alias("is_video"),
            "p.size",
            F.col("p.seq").alias("frame_no"),
        )
    )
    return files.attach_payload(samples, files.box_index(found), found)


@query(
    "payload_ranges",
    f"""select name clip_id, cast(0 as bigint) seq, cast(24 as bigint) "offset", cast(r as bigint) size
from ({MOVIE_FACTS}) q union all
select name, 1, 24 + r, t from ({MOVIE_FACTS}) q""",
)
def payload_ranges(spark, sf_dir):
    return movie_ranges(spark, sf_dir).select("clip_id", "seq", "offset", "size")


@query(
    "framing_audit",
    f"""select name clip_id, cast(1 as bigint) seq, cast(1 as bigint) frame_no,
  'unit at 0 runs over the end' fault from ({MOVIE_FACTS}) q where damaged and t >= 8""",
)
def framing_audit(spark, sf_dir):
    return files.audit_framing(movie_ranges(spark, sf_dir))


@query(
    "file_content_hash",
    """select '/' || doc_id || '.NEV' name, sha256(text) sha256 from documents
union all select '/gone.NEV', ''""",
)
def file_content_hash(spark, sf_dir):
    folder = scratch_path(spark, "sources").removeprefix("file:")
    made = tables.table(spark, sf_dir, "documents").select(
        F.concat(F.lit(f"{folder}/"), F.col("doc_id"), F.lit(".NEV")).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )
    docs.write_files(made)
    found = files.scan_artifacts(spark, folder).select("path")
    asked = found.union(spark.range(1).select(F.lit(f"{folder}/gone.NEV")))
    return files.content_hash(asked).select(
        F.regexp_extract("path", r"(/[^/]*)$", 1).alias("name"), "sha256"
    )


# Vectors as frames of a 10-bit 4:2:0 dump: 2 x 21 pixels take 64 words.
@query(
    "raw_frame_scan",
    """select '/' || vec_id || '.yuv' name, cast(0 as bigint) frame_no, 2 width, 21 height,
  sha256(array_to_string(list_transform(embedding, lambda v:
    lpad(hex(cast(floor((v::double + 1.0::double) * 16384) as bigint) % 256 * 256
      + cast(floor((v::double + 1.0::double) * 16384) as bigint) // 256), 4, '0')), '')) planes_hash
from embeddings""",
)
def raw_frame_scan(spark, sf_dir):
    from clipledger.catalog.frames import as_planes

    rawframes.register(spark)
    folder = scratch_path(spark, "frames").removeprefix("file:")
    docs.write_files(
        tables.table(spark, sf_dir, "embeddings").select(
            F.concat(F.lit(f"{folder}/"), F.col("vec_id"), F.lit(".yuv")).alias("path"),
            as_planes("embedding").alias("content"),
        )
    )
    frames = (
        spark.read.format("rawframes")
        .option("width", 2)
        .option("height", 21)
        .option("layout", "yuv420p10")
        .load(folder)
    )
    return frames.select(
        F.regexp_extract("clip_id", r"(/[^/]*)$", 1).alias("name"),
        "frame_no",
        "width",
        "height",
        F.sha2(F.hex("planes"), 256).alias("planes_hash"),
    )


@query(
    "raw_frame_tree_scan",
    f"""select '{ODD_NAME}' || vec_id || '.rgb' name, cast(0 as bigint) frame_no, 3 width, 7 height,
  sha256(array_to_string(list_transform(embedding[1:63], lambda v:
    lpad(hex(cast(floor((v::double + 1.0::double) * 16384) as bigint) % 256 * 256
      + cast(floor((v::double + 1.0::double) * 16384) as bigint) // 256), 4, '0')), '')) planes_hash
from embeddings""",
)
def raw_frame_tree_scan(spark, sf_dir):
    """Dumps listed and cut into frame ranges by tasks."""
    folder = write_dumps(spark, sf_dir, F.col("embedding"))
    frames = rawframes.scan_frames(spark, folder, 3, 7, frames=(0, 5))
    return frames.select(
        F.regexp_extract("clip_id", r"([^/]*)$", 1).alias("name"),
        "frame_no",
        "width",
        "height",
        F.sha2(F.hex("planes"), 256).alias("planes_hash"),
    )


# The same vectors as 3 x 7 pixels of three planes; the word left over is no whole frame.
@query(
    "raw_frame_scan_rgb",
    f"""select '{ODD_NAME}' || vec_id || '.rgb' name, cast(0 as bigint) frame_no, 3 width, 7 height,
  sha256(array_to_string(list_transform(embedding[1:63], lambda v:
    lpad(hex(cast(floor((v::double + 1.0::double) * 16384) as bigint) % 256 * 256
      + cast(floor((v::double + 1.0::double) * 16384) as bigint) // 256), 4, '0')), '')) planes_hash
from embeddings""",
)
def raw_frame_scan_rgb(spark, sf_dir):
    rawframes.register(spark)
    folder = write_dumps(spark, sf_dir, F.col("embedding"))
    frames = (
        spark.read.format("rawframes")
        .option("width", 3)
        .option("height", 7)
        .option("layout", "rgb16")
        .load(folder)
        .filter("frame_no < 5")
    )
    return frames.select(
        F.regexp_extract("clip_id", r"([^/]*)$", 1).alias("name"),
        "frame_no",
        "width",
        "height",
        F.sha2(F.hex("planes"), 256).alias("planes_hash"),
    )


def write_dumps(spark, sf_dir, values) -> str:
    """One dump per vector; returns their folder."""
    from clipledger.catalog.frames import as_planes

    folder = scratch_path(spark, "frames").removeprefix("file:")
    docs.write_files(
        tables.table(spark, sf_dir, "embeddings").select(
            F.concat(F.lit(f"{folder}/{ODD_NAME}"), F.col("vec_id"), F.lit(".rgb")).alias("path"),
            as_planes(values).alias("content"),
        )
    )
    return folder


# Dumps of three whole frames of 1 x 7 pixels, compared with their mirror; a fourth frame is torn.
@query(
    "frame_psnr_files",
    """with f as (select vec_id, n, list_slice(embedding, 21 * n + 1, 21 * n + 21) a,
  list_slice(list_reverse(embedding), 21 * n + 1, 21 * n + 21) b from embeddings, range(4) t(n)),
er as (select vec_id, n, len(a) words, list_sum(list_transform(list_zip(a, b), lambda p:
    (cast(floor((p[1]::double + 1.0::double) * 16384) as bigint)
     - cast(floor((p[2]::double + 1.0::double) * 16384) as bigint)) ** 2))::double / len(a) mse from f)
select vec_id clip_id, n frame_no, case when words = 21 then floor((case when mse <= 0 then 99.0::double
  else 10.0::double * log10(65535.0::double * 65535.0::double / mse) end) * 1e6 + 0.5) / 1e6 end psnr from er""",
)
def frame_psnr_files(spark, sf_dir):
    sides = {
        "path_a": write_dumps(spark, sf_dir, F.col("embedding")),
        "path_b": write_dumps(spark, sf_dir, F.reverse("embedding")),
    }
    path = lambda folder: F.concat(F.lit(f"{folder}/{ODD_NAME}"), F.col("vec_id"), F.lit(".rgb"))
    pairs = tables.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        *[path(folder).alias(side) for side, folder in sides.items()],
        F.lit(4).cast("bigint").alias("frame_count"),
    )
    return frame_files.compare_files(pairs, 1, 7).withColumn("psnr", round_half_up("psnr", 6))


@query(
    "quality_log_scan",
    """select l_returnflag, cast(count(*) as bigint) lines, cast(sum(l_quantity) as bigint) total
from lineitem group by 1""",
)
def quality_log_scan(spark, sf_dir):
    folder = scratch_path(spark, "quality")
    line = F.concat(F.lit("n:1 psnr_avg:"), F.col("l_quantity").cast("int"), F.lit(".00"))
    tables.table(spark, sf_dir, "lineitem").select("l_returnflag", line.alias("value")).write.partitionBy(
        "l_returnflag"
    ).text(folder)
    logs = docs.read_quality_logs(spark, f"{folder}/*/")
    flag = F.regexp_extract("path", r"l_returnflag=([^/]*)", 1)
    return logs.groupBy(flag.alias("l_returnflag")).agg(
        F.count("*").alias("lines"), F.sum("psnr_avg").cast("bigint").alias("total")
    )

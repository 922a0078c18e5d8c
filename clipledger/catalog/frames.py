"""Queries over frames and quality logs. Embeddings stand in for pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.catalog.base import duck, query, view
from clipledger.functions.rules import round_half_up
from clipledger.operators import frames as V
from clipledger.operators import places as L
from clipledger.operators import quality as Q
from clipledger.plans import tables
from clipledger.session import scratch_path, store
from clipledger.sources import documents as docs

# Ten frames per clip; even vectors are run a, odd ones run b. In every third clip run b repeats
# run a and the odd vectors are frames that only run b has; elsewhere a few numbers are off.
RUN_A = """select cast(floor(vec_id / 20.0) as bigint) clip_id,
  cast(floor(vec_id / 2.0) as bigint) % 10 frame_no, embedding planes
  from {embeddings} where vec_id % 2 = 0"""
RUN_B = """select cast(floor(vec_id / 20.0) as bigint) clip_id,
  cast(floor(vec_id / 2.0) as bigint) % 10 + case when floor(vec_id / 20.0) % 3 = 0 and vec_id % 2 = 1
    then 10 when floor(vec_id / 20.0) % 7 = 5 and floor(vec_id / 2.0) % 10 > 8 then 50 else 0 end
  frame_no, embedding planes from {embeddings}
  where vec_id % 2 = 1 or floor(vec_id / 20.0) % 3 = 0"""
CLIPS = """select cast(floor(vec_id / 20.0) as bigint) clip_id, max(case when
  floor(vec_id / 20.0) % 11 = 10 then 0 else 1 end) * count(distinct floor(vec_id / 2.0)) frame_count
  from {embeddings} group by 1"""

PAIRS = f"""ab as (select clip_id, frame_no, a.planes a, b.planes b
  from {duck(RUN_A)} a join {duck(RUN_B)} b using (clip_id, frame_no)),
er as (select clip_id, frame_no, list_sum(list_transform(list_zip(a, b),
    lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) / len(a) mse from ab),
db as (select clip_id, frame_no, case when mse <= 0 then 99.0::double
    else 10.0::double * log10(1.0::double / mse) end psnr from er)"""


def run_a(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, RUN_A)


def run_b(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, RUN_B)


@query(
    "frame_psnr",
    f"with {PAIRS} select clip_id, frame_no, floor(psnr * 1e6 + 0.5) / 1e6 psnr from db",
)
def frame_psnr(spark, sf_dir):
    pairs = V.frame_ab(run_a(spark, sf_dir), run_b(spark, sf_dir))
    return pairs.select(
        "clip_id", "frame_no", round_half_up(V.psnr("a", "b", peak=1.0), 6).alias("psnr")
    )


@query(
    "frame_ab",
    f"with {PAIRS} select clip_id, frame_no, cast(len(a) as bigint) size_a, "
    "cast(len(b) as bigint) size_b, a = b same from ab",
)
def frame_ab(spark, sf_dir):
    return V.frame_ab(run_a(spark, sf_dir), run_b(spark, sf_dir)).select(
        "clip_id",
        "frame_no",
        F.size("a").cast("bigint").alias("size_a"),
        F.size("b").cast("bigint").alias("size_b"),
        (F.col("a") == F.col("b")).alias("same"),
    )


ORDER_CLIPS = "select o_custkey clip_id, count(*) frame_count from {orders} group by o_custkey"


@query(
    "frame_pick",
    f"""select clip_id, 0 frame_no from {duck(ORDER_CLIPS)} union
select clip_id, frame_count - 1 from {duck(ORDER_CLIPS)} union
select clip_id, (frame_count - 1) // 2 from {duck(ORDER_CLIPS)}""",
)
def frame_pick(spark, sf_dir):
    return V.pick_frames(view(spark, sf_dir, ORDER_CLIPS))


GATE_DB = 16.0
GATE = f"""{PAIRS}, c as (select * from {duck(CLIPS)}),
asked as (select clip_id, frame_count, 0 frame_no from c where frame_count > 0 union
  select clip_id, frame_count, frame_count - 1 from c where frame_count > 0 union
  select clip_id, frame_count, (frame_count - 1) // 2 from c where frame_count > 0),
seen as (select a.clip_id, count(*) n, count(psnr) have, min(psnr) worst from asked a
  left join db using (clip_id, frame_no) group by 1),
gate as (select c.clip_id, c.frame_count = 0 or n = have gated,
  case when c.frame_count > 0 and n = have then worst end worst_psnr,
  c.frame_count = 0 or (n = have and worst >= {GATE_DB}) pass from c left join seen using (clip_id))
"""


def gate_result(spark, sf_dir) -> DataFrame:
    return V.gate(
        run_a(spark, sf_dir),
        run_b(spark, sf_dir),
        view(spark, sf_dir, CLIPS),
        GATE_DB,
        score=V.psnr("a", "b", peak=1.0),
    )


@query(
    "decode_gate",
    f"with {GATE} select clip_id, gated, floor(worst_psnr * 1e6 + 0.5) / 1e6 worst_psnr, pass from gate",
)
def decode_gate(spark, sf_dir):
    return gate_result(spark, sf_dir).withColumn("worst_psnr", round_half_up("worst_psnr", 6))


@query(
    "decode_path",
    f"""with {GATE}, g as (select *, cast(clip_id % 4 as int) % 3 decode_mode,
  clip_id % 5 <> 4 init_ok from gate)
select clip_id, decode_mode,
  case when decode_mode = 2 then 'cpu'
    when not init_ok then case when decode_mode = 1 then 'error' else 'cpu' end
    when decode_mode = 1 then 'gpu' when gated and pass then 'gpu' else 'cpu' end decode_path,
  case when decode_mode = 2 then 'cpu asked for'
    when not init_ok then case when decode_mode = 1 then 'gpu did not start'
      else 'gpu did not start, fall back' end
    when not gated then case when decode_mode = 1 then 'gpu forced, not gated'
      else 'not gated, fall back' end
    when pass then case when worst_psnr > 0 then 'gate passed' else 'gate passed, empty clip' end
    when decode_mode = 1 then 'gpu forced, gate failed'
    else 'gate failed, fall back' end decode_note from g""",
)
def decode_path(spark, sf_dir):
    facts = gate_result(spark, sf_dir).withColumns(
        {
            "decode_mode": (F.col("clip_id") % 4).cast("int") % 3,
            "init_ok": F.col("clip_id") % 5 != 4,
        }
    )
    return V.decide_path(facts).select("clip_id", "decode_mode", "decode_path", "decode_note")


# Vectors as 16-bit little-endian words.
def as_planes(column: str):
    """An array of numbers around 0 as bytes, two per value."""

    def word(v):
        level = F.floor((v.cast("double") + 1.0) * 16384).cast("int")
        low, high = F.pmod(level, F.lit(256)), F.floor(level / 256).cast("int")
        return F.lpad(F.hex(low * 256 + high), 4, "0")

    return F.unhex(F.array_join(F.transform(column, word), ""))


def raw_run(df: DataFrame) -> DataFrame:
    return df.withColumn("planes", as_planes("planes"))


LEVEL_PSNR = f"""with ab as (select clip_id, frame_no, a.planes a, b.planes b
  from {duck(RUN_A)} a join {duck(RUN_B)} b using (clip_id, frame_no)),
er as (select clip_id, frame_no, list_sum(list_transform(list_zip(a, b), lambda p:
    (cast(floor((p[1]::double + 1.0::double) * 16384) as bigint)
     - cast(floor((p[2]::double + 1.0::double) * 16384) as bigint)) ** 2))::double / len(a) mse from ab)
select clip_id, frame_no, floor((case when mse <= 0 then 99.0::double
  else 10.0::double * log10(65535.0::double * 65535.0::double / mse) end) * 1e6 + 0.5) / 1e6 psnr
from er"""


@query("frame_psnr_planes", LEVEL_PSNR)
def frame_psnr_planes(spark, sf_dir):
    out = V.compare_runs(raw_run(run_a(spark, sf_dir)), raw_run(run_b(spark, sf_dir)))
    return out.withColumn("psnr", round_half_up("psnr", 6))


def stored_runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Both runs as Parquet tables."""
    return tuple(store(raw_run(run(spark, sf_dir)), "run") for run in (run_a, run_b))


@query("frame_psnr_places", LEVEL_PSNR)
def frame_psnr_places(spark, sf_dir):
    """Places joined, pixels read by the tasks that compare them."""
    out = L.compare_places(*stored_runs(spark, sf_dir))
    return out.withColumn("psnr", round_half_up("psnr", 6))


LEVEL_GATE_DB = 28.0


@query(
    "decode_gate_places",
    f"with {GATE.replace(PAIRS, f'db as ({LEVEL_PSNR})').replace(str(GATE_DB), str(LEVEL_GATE_DB))} "
    "select * from gate",
)
def decode_gate_places(spark, sf_dir):
    out = L.gate_places(*stored_runs(spark, sf_dir), view(spark, sf_dir, CLIPS), LEVEL_GATE_DB)
    return out.withColumn("worst_psnr", round_half_up("worst_psnr", 6))


# A clip is five vectors; its second dump has them doubled back, or is cut short in every fourth clip.
DUMPED = """select cast(floor(vec_id / 5.0) as bigint) clip_id, vec_id % 5 frame_no, embedding planes,
  case when floor(vec_id / 5.0) % 3 = 0 then embedding else reverse(embedding) end other from {embeddings}"""


@query(
    "decode_gate_files",
    f"""with e as (select clip_id, frame_no, planes a, other b from {duck(DUMPED)} q),
n as (select clip_id, count(*) frame_count from e group by 1),
er as (select clip_id, frame_no, list_sum(list_transform(list_zip(a, b), lambda p:
    (cast(floor((p[1]::double + 1.0::double) * 16384) as bigint)
     - cast(floor((p[2]::double + 1.0::double) * 16384) as bigint)) ** 2))::double / len(a) mse from e),
db as (select clip_id, frame_no, case when mse <= 0 then 99.0::double
    else 10.0::double * log10(65535.0::double * 65535.0::double / mse) end psnr from er),
worst as (select clip_id, min(psnr) psnr from db join n using (clip_id)
  where frame_no in (0, frame_count - 1, (frame_count - 1) // 2) group by 1)
select clip_id, clip_id % 4 <> 1 gated,
  case when clip_id % 4 <> 1 then floor(psnr * 1e6 + 0.5) / 1e6 end worst_psnr,
  clip_id % 4 <> 1 and psnr >= {LEVEL_GATE_DB} pass from worst""".replace("reverse(embedding)", "list_reverse(embedding)"),
)
def decode_gate_files(spark, sf_dir):
    """Raw dumps of two runs, of which three frames are read."""
    folder = scratch_path(spark, "dumps").removeprefix("file:")
    frames = view(spark, sf_dir, DUMPED)
    both = frames.groupBy("clip_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_no", as_planes("planes").alias("a"), as_planes("other").alias("b")))).alias("f")
    )
    path = lambda run: F.concat(F.lit(f"{folder}/{run}/"), F.col("clip_id"), F.lit(".yuv"))
    joined = lambda run: F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x[run])), ""))
    cut = F.col("clip_id") % 4 == 1
    short = F.expr("substring(content, 1, length(content) - 1)")
    whole = both.select("clip_id", path("a").alias("path"), joined("a").alias("content"))
    other = both.select("clip_id", path("b").alias("path"), joined("b").alias("content"))
    docs.write_files(whole.drop("clip_id"))
    docs.write_files(other.select("path", F.when(cut, short).otherwise(F.col("content")).alias("content")))
    clips = both.select("clip_id", F.size("f").alias("frame_count"))
    dumps = both.select("clip_id", path("a").alias("path_a"), path("b").alias("path_b"))
    out = L.gate_files(dumps, clips, 2, 21, "yuv420p10", LEVEL_GATE_DB)
    return out.withColumn("worst_psnr", round_half_up("worst_psnr", 6))


@query(
    "frame_planar",
    """with p as (select vec_id, list_concat(embedding, case len(embedding) % 3
    when 1 then [0.0::float, 0.0::float] when 2 then [0.0::float] else [] end) v from embeddings)
select vec_id, sha256(array_to_string(list_transform(range(0, len(v)),
  lambda i: cast(cast(floor((v[1 + (i // (len(v) // 3)) + 3 * (i % (len(v) // 3))]::double
    + 1.0::double) * 16384) as bigint) as varchar)), ',')) layout_hash from p""",
)
def frame_planar(spark, sf_dir):
    missing = F.pmod(-F.size("embedding"), F.lit(3))
    pixels = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), missing))
    raw = tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", as_planes(pixels).alias("planes")
    )
    planes = V.to_planar(raw).withColumn("x", F.hex("planes"))
    words = F.transform(
        F.sequence(F.lit(0), (F.length("x") / 4 - 1).cast("int")),
        lambda i: F.conv(
            F.concat(
                F.substring(F.col("x"), 4 * i + 3, F.lit(2)),
                F.substring(F.col("x"), 4 * i + 1, F.lit(2)),
            ),
            16,
            10,
        ),
    )
    return planes.select("vec_id", F.sha2(F.array_join(words, ","), 256).alias("layout_hash"))


# Quality logs: one line per order line; a clip is a supplier.
LINES = """select l_suppkey clip_id, l_orderkey frame_no, l_linenumber part_no,
  concat('n:', l_linenumber, ' mse_avg:0.1 psnr_avg:',
    case when l_quantity = 50 then 'inf' when l_quantity = 1 and l_suppkey % 3 = 0 then '-inf'
    else concat(cast(l_quantity as int) + 30, '.', lpad(cast(l_linenumber * 9 as string), 2, '0')) end)
  line from {lineitem}"""
SSIM = """select l_suppkey clip_id, l_orderkey frame_no, l_linenumber part_no,
  concat('n:', l_linenumber, ' Y:0.9 All:', case when l_quantity = 49 then 'inf' else
    concat('0.', 9 + cast(l_quantity as int) * 2 , l_linenumber) end, ' (17.2)') line
  from {lineitem}"""
PARSED = f"""parsed as (select clip_id, frame_no, part_no,
  case regexp_extract(line, 'psnr_avg:(-?inf|-?[0-9.]+)', 1) when '' then null
    when 'inf' then 'infinity'::double when '-inf' then '-infinity'::double
    else try_cast(regexp_extract(line, 'psnr_avg:(-?inf|-?[0-9.]+)', 1) as double) end psnr_avg,
  case regexp_extract(line, 'All:(inf|[0-9.]+)', 1) when '' then null
    when 'inf' then 'infinity'::double
    else try_cast(regexp_extract(line, 'All:(inf|[0-9.]+)', 1) as double) end ssim
  from (select * from {duck(LINES)} union all select * from {duck(SSIM)}) q)"""


def as_in_duck(text: str) -> str:
    """The view for Spark with DuckDB's results: concat leaves nulls out, a cast to int rounds half to even."""
    text = text.replace("concat(", "concat_ws('', ")
    return text.replace("cast(l_quantity as int)", "cast(rint(l_quantity) as int)")


def quality_log(spark, sf_dir) -> DataFrame:
    lines = view(spark, sf_dir, as_in_duck(LINES)).union(view(spark, sf_dir, as_in_duck(SSIM)))
    return Q.parse_quality_log(lines)


@query("quality_parse", f"with {PARSED} select * from parsed")
def quality_parse(spark, sf_dir):
    return quality_log(spark, sf_dir).drop("line")


POOLED = f"""{PARSED}, pooled as (select clip_id, cast(count(psnr) as bigint) frames,
  floor((cast(sum(cast(psnr as decimal(18,8))) as double) / count(psnr)) * 1000.0 + 0.5) / 1000.0 psnr,
  floor((cast(sum(cast(ssim as decimal(18,8))) as double) / count(ssim)) * 100000.0 + 0.5)
    / 100000.0 ssim
  from (select clip_id, case psnr_avg when 'infinity'::double then 100.0::double
      when '-infinity'::double then 0.0::double else psnr_avg end psnr,
    case ssim when 'infinity'::double then 1.0::double else ssim end ssim from parsed) z group by 1)"""


@query("quality_pool", f"with {POOLED} select * from pooled")
def quality_pool(spark, sf_dir):
    return Q.pool_quality(quality_log(spark, sf_dir), ["clip_id"])


@query(
    "quality_worst_frame",
    f"with {PARSED} select clip_id, min(psnr_avg) worst_psnr, "
    "coalesce(min(psnr_avg) >= 45, false) pass from parsed group by clip_id",
)
def quality_worst_frame(spark, sf_dir):
    return Q.worst_frame(quality_log(spark, sf_dir))


# Two tries per supplier; every fourth clip has a VMAF score.
TRIES = """select s_suppkey clip_id, 1 attempt,
  case when s_suppkey % 4 = 0 then 90 + s_acctbal / 1000 end vmaf,
  case when s_suppkey % 4 <> 0 then 38 + s_acctbal / 1000 end psnr,
  case when s_suppkey % 4 <> 0 then 0.95 + s_acctbal / 200000 end ssim from {supplier}
  union all select s_suppkey, 2,
  case when s_suppkey % 4 = 0 then 92 + s_acctbal / 1000 end,
  case when s_suppkey % 4 <> 0 then 41 + s_acctbal / 1000 end,
  case when s_suppkey % 4 <> 0 then 0.97 + s_acctbal / 200000 end from {supplier}
  where s_suppkey % 5 <> 0"""


@query(
    "quality_verdict",
    f"""with t as (select clip_id, attempt, cast(vmaf as double) vmaf, cast(psnr as double) psnr,
  cast(ssim as double) ssim, coalesce(case when vmaf is not null then vmaf >= 95
    else psnr >= 42 and ssim >= 0.97 end, false) pass from {duck(TRIES)} q),
b as (select o.clip_id, not o.pass needs_retry, (not o.pass) and w.clip_id is not null retried,
  o.vmaf v1, o.psnr p1, o.ssim s1, o.pass k1, w.vmaf v2, w.psnr p2, w.ssim s2, w.pass k2
  from t o left join t w on w.clip_id = o.clip_id and w.attempt = 2 where o.attempt = 1)
select clip_id, needs_retry, retried, case when retried then v2 else v1 end vmaf,
  case when retried then p2 else p1 end psnr, case when retried then s2 else s1 end ssim,
  case when (case when retried then k2 else k1 end) then 'PASS' else 'FAIL' end verdict from b""",
)
def quality_verdict(spark, sf_dir):
    runs = view(spark, sf_dir, TRIES)
    for name in ("vmaf", "psnr", "ssim"):
        runs = runs.withColumn(name, F.col(name).cast("double"))
    return Q.quality_verdict(runs)

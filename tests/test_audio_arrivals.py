import random

import pytest
from pyspark.sql import functions as F

from clipledger.functions import rules as R
from clipledger.operators import arrivals as N
from clipledger.operators import audio as A
from tests import models
from tests.data import by_clip

FACTS = "clip_id string, channels bigint, frame_count bigint, sample_rate bigint, fps_num bigint, fps_den bigint, samples_per_channel bigint"
BLOCKS = "clip_id string, block_idx bigint, n_bytes bigint"


def clip_facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


@pytest.mark.parametrize("width", [2, 9, 1 << 18])
def test_index_cap_align(spark, width):
    rng = random.Random(width)
    facts, blocks, want = [], [], {}
    for i in range(60):
        clip, channels = f"a{i}", rng.choice([1, 2, 3])
        frames, cap = rng.randint(1, 40), rng.randint(1, 400)
        facts.append((clip, channels, frames, 100, 30, 2, cap))
        at, line, broken = 0, [], False
        limit = min(frames * 100 * 2 // 30, cap)
        for j in range(rng.randint(0, 25)):
            samples = rng.randint(0, 30)
            size, error = samples * channels * 4, None
            roll = rng.random()
            if roll < 0.02:
                size, error = size + 3, "bad size"
            elif roll < 0.04 and channels > 1:
                size, error = size + 4, "not aligned to channels"
            blocks.append((clip, j, size))
            if size == 0:
                continue
            if broken:
                line.append((j, None, None, "blocked"))
            elif error:
                broken = True
                line.append((j, None, None, error))
            else:
                line.append((j, at, samples, None))
                at += samples
        want[clip] = (line, limit, channels)
    df = spark.createDataFrame(blocks, BLOCKS).repartition(3)
    clips = clip_facts(spark, facts)
    indexed = A.index_audio(df, clips, chunk_rows=width)
    got = {c: v for c, v in by_clip(indexed.fillna("-", ["error"]).fillna(-1), "block_idx", "first_sample", "n_samples", "error").items()}
    plain = lambda line: [(j, -1 if s is None else s, -1 if n is None else n, e or "-") for j, s, n, e in line]
    assert got == {c: plain(line) for c, (line, _, _) in want.items() if line}
    capped = by_clip(A.cap_audio(indexed, clips, width), "block_idx", "n_samples", "out_bytes", "cut")
    for clip, (line, limit, channels) in want.items():
        kept = [
            (j, min(n, limit - s), min(n, limit - s) * channels * 3, s + n > limit)
            for j, s, n, e in line
            if e is None and s < limit
        ]
        assert capped.get(clip, []) == kept
    aligned = A.align_audio(indexed.filter("error is null"), clips, width)
    for row in aligned.collect():
        assert row.frame_no == models.align(row.first_sample, 100, 30, 2)


def test_block_over_the_limit_is_bad(spark):
    df = spark.createDataFrame([("a", 0, 8), ("a", 1, 80)], BLOCKS)
    clips = clip_facts(spark, [("a", 2, 9, 100, 30, 1, 99)])
    rows = A.index_audio(df, clips, max_block_bytes=64).orderBy("block_idx").collect()
    assert [r.error for r in rows] == [None, "bad size"]


def test_synthetic_clip_limits(spark):
    """120 frames at 60000/1001 with 20 blocks of 4800 samples."""
    clips = clip_facts(spark, [("s", 2, 120, 48000, 60000, 1001, 96000)])
    assert A.audio_limit(clips).first().sample_limit == 96000
    longer = clip_facts(spark, [("s", 2, 120, 48000, 60000, 1001, 10**9)])
    assert A.audio_limit(longer).first().sample_limit == 96096


@pytest.mark.parametrize("width", [16, 64, 1 << 18])
def test_interleave(spark, width):
    frames = [("a", n) for n in range(20)]
    audio = [("a", i, s, models.align(s, 48000, 24, 1)) for i, s in enumerate(range(0, 41000, 900))]
    out = A.interleave(
        spark.createDataFrame(frames, "clip_id string, frame_no bigint"),
        spark.createDataFrame(audio, "clip_id string, block_idx bigint, first_sample bigint, frame_no bigint"),
        width,
    )
    got = [(r.kind, r.frame_no if r.kind == "video" else r.block_idx) for r in out.orderBy("position").collect()]
    want, left = [], list(audio)
    for _, n in frames:
        while left and left[0][2] < (n + 1) * 2000:
            want.append(("audio", left.pop(0)[1]))
        want.append(("video", n))
    want += [("audio", b[1]) for b in left]
    assert got == want
    assert [r.position for r in out.orderBy("position").collect()] == list(range(len(want)))


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, direction):
    rng = random.Random(3)
    left = [(f"k{rng.randint(0, 3)}", rng.randint(0, 60), i) for i in range(120)]
    right = list({(f"k{rng.randint(0, 2)}", rng.randint(0, 60)): 0 for _ in range(60)})
    out = A.asof_join(
        spark.createDataFrame(left, "k string, t bigint, id bigint"),
        spark.createDataFrame([(k, t, t * 2) for k, t in right], "k string, t bigint, v bigint"),
        ["k"],
        "t",
        direction,
    )
    got = {r.id: (r.matched_t, r.v) for r in out.collect()}
    for k, t, i in left:
        near = [x for kk, x in right if kk == k and (x <= t if direction == "backward" else x >= t)]
        best = (max if direction == "backward" else min)(near, default=None)
        assert got[i] == (best, None if best is None else best * 2)
    with pytest.raises(ValueError):
        A.asof_join(out, out, ["k"], "t", "nearest")


def test_content_equal(spark):
    copies = [("w", 0, b"same")] * 40
    a = [("x", 0, b"aa"), ("x", 1, b"bb"), ("y", 0, b"cc"), ("z", 0, b""), *copies]
    b = [("x", 0, b"aa"), ("x", 1, b"bb"), ("y", 0, b"cd"), ("y", 1, b"ee"), ("z", 0, b""), *copies]
    schema = "clip_id string, block_idx bigint, payload binary"
    rows = A.content_equal(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    assert {r.clip_id: (r.equal, r.different) for r in rows} == {
        "w": (True, 0), "x": (True, 0), "y": (False, 2), "z": (True, 0)
    }


def arrivals(seed, clips=80):
    rng = random.Random(seed)
    return [
        (f"a{c}", i, rng.randint(-1, 14))
        for c in range(clips)
        for i in range(rng.randint(1, 25))
    ]


@pytest.mark.parametrize("width", [2, 8, 1 << 18])
def test_dedup_and_release(spark, width):
    rows = arrivals(width)
    df = spark.createDataFrame(rows, "clip_id string, arrival bigint, n bigint").repartition(3)
    kept = by_clip(N.ordered_dedup(df, chunk_rows=width), "arrival", "n")
    free = by_clip(N.release_prefix(df, 1, chunk_rows=width).filter("released"), "n")
    starts = spark.createDataFrame([(f"a{c}", c % 5) for c in range(40)], "clip_id string, start bigint")
    own = by_clip(N.release_prefix(df, 1, chunk_rows=width, starts=starts).filter("released"), "n")
    for c in range(80):
        numbers = [n for k, _, n in rows if k == f"a{c}"]
        assert [n for _, n in kept.get(f"a{c}", [])] == models.dedup([n for n in numbers if n >= 0])
        assert [n for (n,) in free.get(f"a{c}", [])] == models.released(numbers, 1)
        assert [n for (n,) in own.get(f"a{c}", [])] == models.released(numbers, c % 5 if c < 40 else 1)


@pytest.mark.parametrize("width", [3, 1 << 18])
def test_shard_audit(spark, width):
    good = [("g", (n - 5) % 3, n, n) for n in range(5, 40)]
    bad = [("b", k, n, n if n != 20 else 26) for _, k, n, _ in good]
    df = spark.createDataFrame(good + bad, "clip_id string, shard bigint, arrival bigint, n bigint")
    rows = N.audit_shards(df, 3, 5, width).collect()
    assert [(r.clip_id, r.shard, r.arrival, r.n, r.expected) for r in rows] == [("b", 0, 20, 26, 20)]


def test_tail_uses_group_limit(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("k"), "id")
    out = N.tail_n(df, ["k"], ["id"], 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
    assert sorted((r.k, r.id, r["rank"]) for r in out.collect()) == [
        (0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)
    ]


def test_clock_round_trip(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("n"))
    rate, num, den = (F.lit(v).cast("bigint") for v in (48000, 60000, 1001))
    target = R.frame_sample_target("n", rate, num, den)
    back = df.select("n", R.sample_frame(target, rate, num, den).alias("next"), R.sample_frame(target - 1, rate, num, den).alias("same"))
    assert back.filter("next <> n + 1 or same <> n").count() == 0

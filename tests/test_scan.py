import random

import pytest
from pyspark.sql import functions as F

from clipledger.plans import scan as S


def rows_for(seed, n=400):
    rng = random.Random(seed)
    # One key holds two thirds of the rows.
    return [
        ("hot" if rng.random() < 0.66 else f"k{rng.randint(0, 5)}", i, rng.choice([None, *range(-5, 9)]))
        for i in range(n)
    ]


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_loop(spark, width, inclusive):
    rows = rows_for(width + inclusive)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(3)
    got = {
        r.o: (r.s, r.m, r.lo, r.last, r.n, r.w)
        for r in S.running(
            df,
            ["k"],
            S.chunk_of("o", width),
            ["o"],
            {
                "s": S.running_sum("v", inclusive),
                "m": S.running_max("v", inclusive),
                "lo": S.Running("min", F.col("v"), inclusive),
                "last": S.running_last("v", inclusive),
                "n": S.running_count("v > 2" and F.col("v") > 2, inclusive),
                "w": S.whole_max("v"),
            },
        ).collect()
    }
    seen: dict[str, list] = {}
    for k, o, v in rows:
        before = seen.setdefault(k, [])
        if inclusive:
            before.append(v)
        known = [x for x in before if x is not None]
        top = max(x for kk, _, x in rows if kk == k and x is not None)
        want = (
            sum(known),
            max(known, default=None),
            min(known, default=None),
            known[-1] if known else None,
            sum(1 for x in known if x > 2),
            top,
        )
        assert got[o] == want
        if not inclusive:
            before.append(v)
    assert len(got) == len(rows)


def test_facts_reach_every_row(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(20)], "k string, o bigint, v bigint")
    facts = spark.createDataFrame([("a", 7)], "k string, f bigint")
    out = S.running(df, ["k"], S.chunk_of("o", 3), ["o"], {"s": S.running_sum("v")}, facts=facts)
    assert [(r.o, r.s, r.f) for r in out.orderBy("o").collect()] == [(i, i + 1, 7) for i in range(20)]


def test_ordered_chunks_split_a_hot_key(spark):
    rows = rows_for(5, 3000)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunked = S.ordered_chunks(df, ["k", "v", "o"])
        out = S.running(chunked, ["k"], "order_chunk", ["v", "o"], {"n": S.running_count()})
        hot = chunked.filter("k = 'hot'").select("order_chunk").distinct().count()
        got = {(r.k, r.o): r.n for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert hot > 1
    want = {}
    for key in {k for k, _, _ in rows}:
        line = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        want.update({(k, o): i + 1 for i, (k, o, _) in enumerate(line)})
    assert got == want


def test_a_hot_key_is_spread_over_tasks(spark, no_broadcast):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"))
    facts = spark.createDataFrame([("hot", 7)], "k string, f bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (
            S.running(df, ["k"], S.chunk_of("o", 100), ["o"], {"s": S.running_sum("v")}),
            S.attach(df, facts, ["k"], S.chunk_of("o", 100)),
        ):
            sizes = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
            assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_both_ways(spark, how, request):
    rows = spark.createDataFrame(
        [("hot", i) for i in range(50)] + [("x", 1), (None, 2)], "k string, o bigint"
    )
    facts = spark.createDataFrame([("hot", 1.5), ("y", 2.0)], "k string, f double")
    plain = sorted(map(str, rows.join(facts, "k", how).collect()))
    assert sorted(map(str, S.attach(rows, facts, ["k"], "o", how).collect())) == plain
    request.getfixturevalue("no_broadcast")
    spread = S.attach(rows, facts, ["k"], S.chunk_of("o", 8), how)
    assert "_cell" in spread._jdf.queryExecution().toString()
    assert sorted(map(str, spread.collect())) == plain


def test_attach_is_the_same_in_both_plans(spark):
    rows = spark.createDataFrame(
        [("a", 0), ("a", None), ("b", 5), (None, 1), (None, None), ("z", 3)], "clip_id string, seq bigint"
    )
    facts = spark.createDataFrame([("a", 100), ("b", 200), ("c", 300)], "clip_id string, fact bigint")
    key, found = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(key)
    for limit in ("-1", "1g"):
        spark.conf.set(key, limit)
        for how in ("left", "inner"):
            out = S.attach(rows, facts, ["clip_id"], "seq", how)
            found.append(sorted([tuple(r) for r in out.select("clip_id", "seq", "fact").collect()], key=str))
    spark.conf.set(key, before)
    assert found[0] == found[2] and found[1] == found[3] and ("a", None, 100) in found[0]

"""Frames compared where they lie, against the comparison that joins pixels."""

import os

import pytest

from clipledger.operators import frames as V
from clipledger.operators import places as L

SCHEMA = "clip_id string, frame_no bigint, planes binary"


@pytest.fixture
def runs(spark, tmp_path):
    rows_a = [(f"c{i % 7}", i // 7, os.urandom(48)) for i in range(160)]
    rows_b = [(c, n, p if n % 3 else os.urandom(48)) for c, n, p in rows_a if (c, n) != ("c2", 0)] + [("c9", 0, b"ab"), ("c1", 99, None)]
    out = []
    for name, rows in (("a b%", rows_a), ("b", rows_b)):
        path = str(tmp_path / name)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3, "planes")
        # Small row groups, several files.
        frame.write.option("parquet.block.size", 1024).parquet(path)
        out.append(spark.read.parquet(path))
    return out


def found(df):
    return sorted((r.clip_id, r.frame_no, None if r.psnr is None else round(r.psnr, 9)) for r in df.collect())


def test_compare_places(spark, runs, monkeypatch):
    monkeypatch.setattr(L, "HELD_PAIRS", 5)
    a, b = runs
    assert found(L.compare_places(a, b)) == found(V.compare_runs(a, b))
    assert len(found(L.compare_places(a, b))) == 159


def test_no_pixel_is_shuffled(spark, runs, no_broadcast):
    clips = spark.createDataFrame([("c1", 20)], "clip_id string, frame_count bigint")
    for df in (L.compare_places(*runs), L.gate_places(*runs, clips)):
        assert "planes" not in df._jdf.queryExecution().executedPlan().toString()


def test_gate_places(spark, runs):
    a, b = runs
    clips = spark.createDataFrame(
        [(f"c{i}", n) for i, n in enumerate((23, 23, 23, 30, 0, 1, 22))] + [("none", 4)], "clip_id string, frame_count bigint"
    )
    key = lambda df: sorted(map(tuple, df.select("clip_id", "gated", "worst_psnr", "pass").collect()))
    assert key(L.gate_places(a, b, clips, 10.0)) == key(V.gate(a, b, clips, 10.0))


def test_gate_files(spark, tmp_path):
    frames = {c: [os.urandom(24) for _ in range(n)] for c, n in (("one", 5), ("two", 5), ("three", 1), ("four", 4))}
    other = {c: [f if i % 2 == 0 else os.urandom(24) for i, f in enumerate(fs)] for c, fs in frames.items()}
    for c in frames:
        (tmp_path / f"{c}.a").write_bytes(b"".join(frames[c]))
        (tmp_path / f"{c}.b").write_bytes(b"".join(other[c])[: -1 if c == "two" else None])
    dumps = spark.createDataFrame([(c, str(tmp_path / f"{c}.a"), str(tmp_path / f"{c}.b")) for c in frames], "clip_id string, path_a string, path_b string")
    clips = spark.createDataFrame([(c, len(f)) for c, f in frames.items()] + [("empty", 0), ("lost", 2)], "clip_id string, frame_count bigint")
    got = {r.clip_id: r for r in L.gate_files(dumps, clips, 2, 2).collect()}
    # Frames 0, 2 and 4 of five are alike; of four, frame 1 and 3 are not.
    assert (got["one"].gated, got["one"].worst_psnr, got["one"]["pass"]) == (True, 99.0, True)
    assert (got["two"].gated, got["two"].worst_psnr, got["two"]["pass"]) == (False, None, False)
    assert got["three"].worst_psnr == 99.0 and got["four"].worst_psnr < 55 and not got["four"]["pass"]
    assert (got["empty"].gated, got["empty"]["pass"]) == (True, True) and not got["lost"].gated

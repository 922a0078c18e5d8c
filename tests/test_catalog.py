"""Every registered query against its SQL twin."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from clipledger.catalog.base import TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    yield con
    con.close()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in places) for r in found.fetchall()]
    assert ordered(rows) == ordered(want)
    assert rows


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "clip_id" and df.count() > 0


def test_no_task_sees_a_whole_clip(spark, sf_dir):
    """Windows over packets are cut by chunk; a window by clip alone only sees chunk totals."""
    names = (
        "packet_offsets monotone_dts resume_point resume_report audio_index release_prefix "
        "purge_reorder audio_interleave ordered_dedup shard_audit cadence_gaps audio_align_asof"
    )
    for name in names.split():
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            # "_t_" columns are chunk totals.
            if " Window [" in line and "_chunk" not in line and "max(_t_" not in line:
                raise AssertionError(f"{name}: {line[:200]}")


def test_no_forbidden_calls():
    bad = re.compile(r"localCheckpoint|crossJoin|toPandas\(|\.rdd\b|collect_set")
    for folder, _, files in os.walk(os.path.join(ROOT, "clipledger")):
        for file in files:
            if file.endswith(".py"):
                text = open(os.path.join(folder, file), encoding="utf-8").read()
                assert not bad.search(text), file

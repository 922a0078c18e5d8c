"""The quality-log queries against their SQL on null and fractional values."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_catalog import ordered

LINES = "l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_quantity double"


@pytest.mark.parametrize("name", ["quality_parse", "quality_pool", "quality_worst_frame"])
def test_null_and_fractional_quantities(spark, tmp_path, name):
    """DuckDB's concat leaves nulls out and its casts round; Spark's gave null lines and cut fractions off."""
    quantities = [None, 1.0, 49.0, 50.0, 7.0, 30.5, 31.5, 31.7, 48.6, 0.2, -3.5]
    rows = [(s, 10 * s + i, n, q) for s in (1, 3) for i, q in enumerate(quantities) for n in (1, 7, None)]
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = con.sql(entry.oracle_sql()[name])
    found = entry.queries()[name](spark, str(tmp_path))
    assert ordered(found.select(*wanted.columns).collect()) == ordered(wanted.fetchall())

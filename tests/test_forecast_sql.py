"""The SQL of the segments' lines on tables whose segments have seasons, and on one with a partial last month."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import bag

from tabularium.plans import registry

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("end", ["2001-01-01", "1999-05-01", "1999-05-03"])
def test_segment_lines_follow_the_whole_rule(spark, tmp_path, end):
    """Segments with seasons and a trend; the table ends with a year, within one, or two days into a month, which is then left out."""
    spark.read.parquet(f"{SF}/orders.parquet").where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()["segment_forecast_lines"])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = [r.asDict() for r in registry.queries()["segment_forecast_lines"](spark, str(tmp_path)).collect()]
    assert got and bag(got) == bag(want)

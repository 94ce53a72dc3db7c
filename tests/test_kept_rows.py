"""Reports go through what lies behind their table once, however many passes they make over its rows."""

import datetime

from pyspark.sql import functions as F

from tabularium.operators import findings as K
from tabularium.plans import report


def counted(spark, n=2_000):
    """(a table, how many of its rows have been made so far)."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    day = F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("id") % 1400).cast("int")).cast("timestamp_ntz")
    rows = spark.range(0, n, 1, 3).select("id", day.alias("day"), (F.col("id") % 97 + 1).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.lit("x").alias("unused"))
    return rows.mapInArrow(count, rows.schema), made


def test_filtered_report_goes_through_its_rows_once(spark):
    df, made = counted(spark)
    rows = report.filtered_report(df, "day", "v", "sum", ["g"]).collect()
    assert {r["analysis"] for r in rows} >= {"trend", "period", "robust", "driver"} and made.value == 2_000
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_weak_points_go_through_their_rows_twice(spark):
    """Once for the kept columns, once for the missing data of all columns."""
    df, made = counted(spark)
    df = df.withColumn("profit", F.when(F.col("g") == "a", -F.col("v")).otherwise(F.col("v"))).withColumn("gap", F.when(F.col("id") % 2 == 0, 1))
    got = {r["kind"]: r for r in K.weak_points(df, "day", "v", "sum", ["g"], "profit", key=["id"]).collect()}
    assert got["missing"]["value"] == 50.0 and got["losing_segment"]["significant"] and made.value == 4_000
    assert not spark.sparkContext._jsc.getPersistentRDDs()

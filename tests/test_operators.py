"""Planted patterns and hand calculations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tabularium.operators import aggregates as A
from tabularium.operators import combine as J
from tabularium.operators import entities as E
from tabularium.operators import findings as K
from tabularium.operators import inference as I
from tabularium.operators import quality as Q
from tabularium.operators import relations as R
from tabularium.operators import series as S
from tabularium.operators import text as X
from tabularium.sources.tables import read_table, write_table


def month(i, start=2020):
    return f"{start + i // 12}-{i % 12 + 1:02d}"


def series(spark, values):
    return spark.createDataFrame([(month(i), float(v)) for i, v in enumerate(values)], "month string, value double")


def test_formats_agree(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "id long, name string, x double")
    for fmt in ("csv", "tsv", "json", "parquet"):
        write_table(df, str(tmp_path / f"t.{fmt}"), fmt)
        got = read_table(spark, str(tmp_path / f"t.{fmt}"), fmt)
        assert sorted((int(r["id"]), r["name"], r["x"]) for r in got.collect()) == [(1, "a", 1.5), (2, "b", 2.5)]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"meta": 1, "data": [{"a": 1, "Address": {"City": "X"}}, {"a": 2, "Address": {"City": "Y"}}]}')
    (tmp_path / "c.json").write_text('{"a": [1, 2], "b": ["x", "y"]}')
    w = read_table(spark, str(tmp_path / "w.json"))
    assert sorted(w.columns) == ["Address.City", "a"] and w.count() == 2
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "c.json")).select("a", "b").collect())) == [(1, "x"), (2, "y")]


def test_latin1(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,x\ncaf\xe9,1\n".encode("latin1"))
    assert read_table(spark, str(tmp_path / "l.csv")).first()["name"] == "café"


def test_coerce_and_profile(spark):
    df = spark.createDataFrame([(str(i) if i else "n/a", "x" * (i % 3 + 5)) for i in range(20)], "a string, b string")
    got = Q.coerce_numeric(df)
    assert dict(got.dtypes) == {"a": "double", "b": "string"} and got.where("a is null").count() == 1
    p = {r["column"]: r for r in Q.profile_columns(got).collect()}
    assert p["a"]["non_null"] == 19 and p["a"]["all_integer"] and p["a"]["sequential"] == 1.0 and p["b"]["distinct"] == 3


def test_roles_and_domains(spark):
    rows = [(f"P{i}", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), "flu asthma".split()[i % 2], "abc"[i % 3], 100.0 + i, 20 + i % 60) for i in range(60)]
    df = spark.createDataFrame(rows, "Patient_ID string, Admission_Date timestamp_ntz, Condition string, Hospital string, Billing_Amount double, Age int")
    roles = {r["column"]: r["role"] for r in Q.classify_roles(df).collect()}
    assert roles == {"Patient_ID": "PATIENT", "Admission_Date": "DATE", "Condition": "CONDITION", "Hospital": "HOSPITAL", "Billing_Amount": "FINANCIAL_METRIC", "Age": "AGE"}
    p = Q.understand(df)
    assert (p.domain, p.date, p.measures) == ("healthcare", "Admission_Date", [("Billing_Amount", "sum"), ("Age", "avg")])
    assert [(c, ok) for c, _, ok in p.dimensions] == [("Condition", True), ("Hospital", True)]


def test_quality(spark):
    df = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (2, 3.0, "k"), (3, 4.0, "k")], "a int, b double, c string")
    assert Q.missing_by_column(df).collect() == [Row(column="b", missing_pct=50.0)]
    assert Q.duplicate_stats(df).first()["duplicate_rows"] == 1
    assert [r["column"] for r in Q.constant_columns(df).collect()] == ["c"]
    assert Q.quality_score(df).first()["score"] == pytest.approx(round(100 - 40 / 6 - 5 - 5, 1))


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(5.0,)] * 3, "v double")
    assert [tuple(r) for r in A.histogram(df, "v").collect()] == [(0, 4.5, 5.5, 3)]


def test_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 1.0), ("b", 2.0)], "k string, v double")
    assert [tuple(r) for r in A.distribution_sum(df, "k", "v").collect()] == [("b", 2.0), ("a", 0.0)]


def test_filter_then_report_is_report_on_the_filtered(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1 + i % 6, 1), "ab"[i % 2], float(i)) for i in range(60)], "d timestamp_ntz, k string, v double")
    kept = A.filter_rows(df, "d", "2020-02-01", "2020-04-30", {"k": ["a"]})
    again = spark.createDataFrame(kept.collect(), df.schema)
    assert A.trend(kept, "d", "v").collect() == A.trend(again, "d", "v").collect()


def test_join_key_and_join(spark):
    orders = spark.createDataFrame([(i, f"C{c}", 10.0, "West") for i, c in enumerate([1, 1, 2, 3, 4, 5, 9])], "order_id int, Customer_ID string, Sales double, Region string")
    customers = spark.createDataFrame([(f"C{i}", f"name {i}", "East") for i in range(1, 6)], "Customer_ID string, Customer string, Region string")
    found = {r["left_column"]: r["chosen"] for r in J.detect_join_key(orders, customers).collect()}
    assert found["Customer_ID"] and not found["Region"]
    joined, info = J.relational_join(customers, orders, "Customer_ID", "Customer_ID", "customers", "orders")
    row = info.first()
    assert (row["fact"], row["matched"], row["unmatched"], round(row["match_rate_pct"], 1)) == ("orders", 6, 1, 85.7)
    assert "Region (orders)" in joined.columns and joined.count() == 7


def test_snapshots(spark):
    old = spark.createDataFrame([("s1", ["a", "b"]), ("s2", ["a", "b", "c"])], "name string, columns array<string>")
    assert J.match_snapshot(old, ["a", "b"]).first()["name"] == "s1"
    assert J.match_snapshot(old, ["x"]).count() == 0


def test_vif_and_correlation(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(a + 0.01 * b), float(b)) for a, b in zip(x, z, strict=True)], "x double, y double, z double")
    v = {r["column"]: r for r in R.vif(df, ["x", "y", "z"]).collect()}
    assert v["x"]["severity"] == "severe"
    c = {(r["col1"], r["col2"]): r for r in R.correlations(df, ["x", "y", "z"]).collect()}
    assert c["x", "y"]["significant"] and c["x", "y"]["strength"] == "strong" and not c["x", "z"]["reported"]


def test_partial_correlation_explains(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=400)
    df = spark.createDataFrame([(float(a + 0.4 * b), float(a + 0.4 * c), float(a), "hi" if a > 0 else "lo") for a, b, c in zip(z, rng.normal(size=400), rng.normal(size=400), strict=True)], "x double, y double, z double, g string")
    effects = {r["control"]: r["effect"] for r in R.partial_correlations(df, [("x", "y")], ["z"], ["g"]).collect()}
    assert effects["z"] == "mostly_explained" and effects["g"] in ("partially_explained", "mostly_explained")


def test_simpson(spark):
    rows = [(float(i % 20 + 20 * g), float(-(i % 20) + 40 * g), str(g)) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    assert R.simpsons(df, [("x", "y")], ["g"]).first()["reversed"]


def test_anomalies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(o), float(20 * o + rng.normal())) for i, o in enumerate(rng.normal(50, 5, 300))] + [(900 + i, 50.0, 200.0) for i in range(5)] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, orders double, revenue double")
    got = R.anomalies(df, ["orders", "revenue"], ["id"])
    assert {r["id"] for r in got.limit(5).collect()} == {900, 901, 902, 903, 904}
    assert not R.anomaly_flags(df, ["orders", "revenue"], "u").where("id = 999").first()["u"]


def test_segments(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, rng.normal(c, 1, 2))) for c in ((0, 0), (20, 0), (0, 20)) for _ in range(100)]
    _, summary = R.segments(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    assert sorted(r["size"] for r in summary.select("segment", "size").distinct().collect()) == [100, 100, 100]


def test_benford(spark):
    df = spark.createDataFrame([(float(2**i),) for i in range(1, 300)], "v double")
    assert not R.benford(df, ["v"]).first()["deviates"]
    flat = spark.createDataFrame([(float(d * 10**k),) for d in range(1, 10) for k in range(4) for _ in range(10)], "v double")
    assert R.benford(flat, ["v"]).first()["deviates"]


def test_ab(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 60)] + [("b", float(v)) for v in rng.normal(1.5, 1, 50)]
    r = I.ab_test(spark.createDataFrame(rows, "g string, v double"), "g", "a", "b", "v").first()
    a, b = (np.array([v for g, v in rows if g == x]) for x in "ab")
    u = sum((b[:, None] > a).ravel()) + 0.5 * sum((b[:, None] == a).ravel())
    assert r["u"] == u and r["significant"] and r["primary_test"] == "welch" and r["low"] < b.mean() - a.mean() < r["high"]


def test_rates(spark):
    rows = [("a", "y")] * 48 + [("a", "n")] * 32 + [("b", "y")] * 56 + [("b", "n")] * 14
    r = {x["level"]: x for x in I.ab_rate_test(spark.createDataFrame(rows, "g string, o string"), "g", "a", "b", "o").collect()}
    assert r["y"]["difference"] == pytest.approx(0.2) and r["y"]["low"] == pytest.approx(0.0524, abs=1e-3) and r["y"]["method"] == "chi_square"


def test_kpi_interval_holds_the_point(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(500)], "v double")
    r = I.kpi_intervals(df, [("v", "sum")]).first()
    assert r["low"] < r["point"] < r["high"] and r["n"] == 500


def test_seasonality(spark):
    rng = np.random.default_rng(5)
    off = [0, -20, -5, 0, 2, 3, 0, -2, 1, 4, 6, 15]
    got = S.seasonality(series(spark, [100 + 2 * i + off[i % 12] + rng.normal() for i in range(48)]))
    r = got.first()
    assert r["seasonal"] and (r["peak_month"], r["trough_month"]) == (12, 2)
    noise = S.seasonality(series(spark, rng.normal(100, 5, 48))).first()
    assert not noise["seasonal"]


def test_forecast(spark):
    rng = np.random.default_rng(6)
    got = S.forecast(series(spark, [10 + 3 * i + rng.normal() for i in range(24)])).orderBy("month").collect()
    assert [r["month"] for r in got] == ["2022-01", "2022-02", "2022-03"]
    assert all(r["low"] < r["value"] < r["high"] and abs(r["value"] - (10 + 3 * (24 + i))) < 3 for i, r in enumerate(got))
    exact = S.forecast(series(spark, [2.0 * i for i in range(12)])).first()
    assert exact["low"] is None and exact["value"] == pytest.approx(24)
    assert S.forecast(series(spark, rng.normal(0, 1, 40))).count() == 0


def test_changepoint(spark):
    rng = np.random.default_rng(7)
    r = S.changepoint(series(spark, [*rng.normal(100, 4, 24), *rng.normal(150, 4, 12)])).first()
    assert r["is_break"] and r["month"] == "2022-01" and 40 < r["shift_pct"] < 58
    assert not S.changepoint(series(spark, rng.normal(100, 4, 36))).first()["is_break"]


def test_drivers_add_up(spark):
    rows = [(dt.datetime(2023, m, 1), r, c, {("West", "F", 6): 3.0, ("East", "F", 6): 9.0}.get((r, c, m), 10.0)) for m in range(1, 7) for r in ("West", "East") for c in "FT" for _ in range(10)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, region string, category string, v double")
    got = S.drivers(df, "d", "v", "sum", ["region", "category"], ["2023-05"], ["2023-06"])
    by = got.groupBy("dimension").agg(F.sum("change").alias("c"), F.first("dimension_rank").alias("k")).collect()
    assert {r["dimension"]: (round(r["c"], 6), r["k"]) for r in by} == {"category": (-80.0, 1), "region": (-80.0, 2)}
    avg = S.drivers(df, "d", "v", "avg", ["category"], ["2023-05"], ["2023-06"])
    assert avg.agg(F.sum("change")).first()[0] == pytest.approx(-2.0)


def test_cohorts_and_risk(spark):
    rows = [(c * 10 + e, dt.datetime(2023, 1 + c + k, 5)) for c in range(3) for e in range(10) for k in range(2) if k == 0 or e < 6]
    got = E.cohorts(spark.createDataFrame(rows, "e int, d timestamp_ntz"), "e", "d")
    assert {r["retention"] for r in got.where("month_number = 1").collect()} == {0.6}
    visits = [(e, dt.datetime(2024, 6, 1) - dt.timedelta(days=30 * k + (120 if e >= 50 else 0))) for e in range(60) for k in range(4)]
    risk = E.retention_risk(spark.createDataFrame(visits, "e int, d timestamp_ntz"), "e", "d").collect()
    assert len(risk) == 10 and {r["level"] for r in risk} == {"high"} and risk[0]["typical_gap"] == 30.0


def test_findings_gate(spark):
    df = spark.createDataFrame([("a", 90.0), ("b", 5.0), ("c", 5.0)], "k string, v double")
    fact = K.concentration(df, "k", "v")
    assert fact.first()["significant"] and fact.first()["value"] == 90.0
    weak = fact.withColumn("significant", F.lit(False)).withColumn("priority", F.lit("high"))
    r = K.ranked(weak).first()
    assert r["priority"] == "medium" and r["score"] == pytest.approx(0.6 * (90 - 100 / 3))


def test_sensitive(spark):
    rows = [(f"user{i}@mail.example.com", f"+1 (555) 010-{1000 + i}", "4111 1111 1111 1111", "2024-01-0" + str(i % 9 + 1), i) for i in range(10)]
    df = spark.createDataFrame(rows, "contact string, tel string, pay string, seen string, ssn int")
    got = {r["column"]: r for r in X.scan_sensitive(df).collect()}
    assert {c: r["kind"] for c, r in got.items()} == {"contact": "email", "tel": "phone", "pay": "card", "ssn": "gov_id"}
    assert got["ssn"]["confidence"] == "medium" and X.header_kind("email_count") is None and X.header_kind("CustomerID") == "person_id"
    assert "example.com" not in str(X.publish_findings(df).collect())


def test_leaks_and_masks(spark):
    df = spark.createDataFrame([("write to a.b@c.org now", 1), ("id 123-45-6789.", 2), ("9123-45-67890", 3), (None, 4)], "t string, n int")
    assert {(r["kind"], r["rows"]) for r in X.scan_text_leaks(df, ["t"]).collect()} == {("email", 1), ("ssn", 1), ("card", 0)}
    m = X.mask_columns(spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), (None, 4)], "k string, i int"), ["k", "i"])
    assert m.columns == ["k"] and sorted(str(r["k"]) for r in m.collect()) in (["None", "k 1", "k 1", "k 2"], ["None", "k 1", "k 2", "k 2"])


def test_keywords(spark):
    df = spark.createDataFrame([("the quality of this product is quality",)] * 12, "t string")
    got = {r["word"]: (r["n"], r["entries_pct"]) for r in X.keywords(df, "t").collect()}
    assert got == {"quality": (24, 100.0), "product": (12, 100.0)}


@pytest.mark.parametrize("f", [lambda d: A.trend(d, "d", "v"), lambda d: A.histogram(d, "v"), lambda d: Q.quality_score(d), lambda d: R.correlations(d, ["v", "w"]), lambda d: S.period_comparison(d, "d", "v"), lambda d: E.cohorts(d, "k", "d"), lambda d: X.keywords(d, "k"), lambda d: Q.outlier_summary(d, ["v"])])
def test_empty_tables(spark, f):
    f(spark.createDataFrame([], "d timestamp_ntz, k string, v double, w double")).collect()


def test_many_rows_of_few_values(spark):
    """Intervals over more rows than a bootstrap has cells: as wide as the theory says, round the point."""
    n, few = 100_000, 50
    df = spark.range(n).select((F.col("id") % few).cast("double").alias("v"), F.when(F.col("id") < 3 * few, "rare").otherwise("rest").alias("g"))
    half = 1.96 * np.sqrt((few**2 - 1) / 12 / n)
    r = I.kpi_intervals(df, [("v", "avg")]).first()
    assert r["point"] == pytest.approx(24.5) and r["low"] == pytest.approx(24.5 - half, abs=half / 5) and r["high"] == pytest.approx(24.5 + half, abs=half / 5)
    c = I.bootstrap_claim(df, "gap", "v", "g", "rare", reference=-9.0).first()
    wide = 1.96 * np.sqrt((few**2 - 1) / 12 / 150)
    assert c["valid"] == 300 and c["significant"] and c["low"] == pytest.approx(-wide, abs=wide / 3) and c["high"] == pytest.approx(wide, abs=wide / 3)
    s = I.bootstrap_claim(df, "share", "v", "g", "rare").first()
    assert s["low"] < 0.15 < s["high"] < 0.25


def test_samples_pick_rows(spark):
    df = spark.range(30_000).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3 * 10).cast("double").alias("y"))
    assert A.scatter(df, "x", "y").select("x").distinct().count() == 3
    assert {r["x"]: r["n"] > 6000 for r in I._sample(df).groupBy("x").agg(F.count("x").alias("n")).collect()} == {0.0: True, 1.0: True, 2.0: True}
    assert sorted(r["size"] for r in R.segments(df, ["x", "y"])[1].select("segment", "size").distinct().collect()) == [10_000] * 3


@pytest.mark.parametrize("first", [None, "no date"])
def test_dates_after_other_rows(spark, first):
    """Dates as text are found by all non-null values, wherever they stand."""
    when = F.when(F.col("id") < 1100, F.lit(first)).otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
    r = Q.profile_columns(spark.range(0, 20_000, 1, 1).select(when.cast("string").alias("when"))).first()
    assert r["date_rate"] == pytest.approx(1 if first is None else 18_900 / 20_000)

"""Quantiles, breaks, gates, personal data and comparisons on planted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import combine as J
from tabularium.operators import common as C
from tabularium.operators import findings as K
from tabularium.operators import series as S
from tabularium.operators import text as X


@pytest.mark.parametrize("close", [200_000, 25])
def test_quantiles_are_exact(spark, monkeypatch, close):
    """Ties, long tails, nulls and NaN, one value, two values, none: as numpy has them, also where brackets must be narrowed."""
    monkeypatch.setattr(C, "CLOSE", close)
    rng = np.random.default_rng(5)
    n = 4001
    cols = {"even": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "tail": np.exp(8 * rng.normal(size=n)), "one": np.full(n, 7.0), "holes": np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n)), "whole": np.arange(n, dtype=float)}
    rows = [[None if np.isnan(x) and rng.random() < 0.5 else float(x) for x in r] for r in zip(*cols.values(), strict=True)]
    df = spark.createDataFrame([(*r, None) for r in rows], ", ".join(f"`{c}` double" for c in [*cols, "nothing"])).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = C.quantiles(df, [*cols, "nothing"], probs)
    assert set(got) == set(cols)
    for c, x in cols.items():
        x = x[~np.isnan(x)]
        assert got[c][0] == len(x) and got[c][1] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    assert C.quantiles(spark.createDataFrame([(1.0,), (2.0,)], "`a.b` double"), ["a.b"], [0.5]) == {"a.b": (2, [1.5])}


def test_split_scores_by_lines(spark):
    """The step between both lines' edge months over its standard error, line by line."""
    rng = np.random.default_rng(8)
    y = rng.normal(100, 5, 21) + np.where(np.arange(21) >= 9, 40, 0)
    months = [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(21)]
    got = {r["i"]: r["score"] for r in S.split_scores(spark.createDataFrame(list(zip(months, y.tolist(), strict=True)), "month string, value double")).collect()}
    want = {}
    for i in range(4, 18):
        left, right = np.polyfit(np.arange(i), y[:i], 1), np.polyfit(np.arange(21 - i), y[i:], 1)
        sse = [((y[:i] - np.polyval(left, np.arange(i))) ** 2).sum(), ((y[i:] - np.polyval(right, np.arange(21 - i))) ** 2).sum()]
        want[i] = abs(right[1] - np.polyval(left, i - 1)) / np.sqrt(sse[0] / (i - 1) / i + sse[1] / (20 - i) / (21 - i))
    assert got == pytest.approx(want) and max(got, key=got.get) == 9
    assert S._all_scores(y[None])[0] == pytest.approx(max(want.values()))


def test_weak_points_are_gated(spark):
    """A decline over many rows holds; one over a few noisy rows goes down a priority and in score."""
    rng = np.random.default_rng(2)
    sure = [(f"{y}-06-01", float(v)) for y, m in ((2020, 100), (2023, 55)) for v in rng.normal(m, 10, 500)]
    noisy = [(f"{y}-06-01", float(v)) for y, m in ((2020, 100), (2023, 88)) for v in m + np.array([-70, -30, 0, 5, 25, 70])]
    for rows, holds in ((sure, True), (noisy, False)):
        df = spark.createDataFrame(rows, "day string, v double").withColumn("day", F.to_timestamp_ntz("day"))
        r = next(x for x in K.weak_points(df, "day", "v", "avg", []).collect() if x["kind"] == "declining")
        assert r["significant"] is holds and r["ci_low"] < r["value"] < r["ci_high"]
        assert r["score"] == pytest.approx(abs(r["value"]) * (1 if holds else 0.6)) and r["priority"] == ("high" if holds else "low")


def test_a_gate_that_cannot_run_changes_nothing(spark):
    fact = K.concentration(spark.createDataFrame([("a", 90.0), ("b", 5.0), ("c", 5.0)], "k string, v double"), "k", "v").withColumn("priority", F.lit("high"))
    claim = spark.createDataFrame([("share", None, None, 0, False)], "kind string, low double, high double, valid long, significant boolean")
    r = K.gated(fact, claim).first()
    assert (r["priority"], r["significant"], r["ci_low"]) == ("high", None, None) and r["score"] == pytest.approx(90 - 100 / 3)


def test_kinds_of_personal_data(spark):
    n = 40
    rows = [(f"u{i}@mail.example.org", f"A{chr(97 + i % 26)}b O{chr(97 + i // 26)}c", f"555-01{i:02d}", f"{100 + i}-12-{1000 + i}", f"555 123 {1000 + i}", "Blue Widget", "x" if i % 2 else f"me{i}@mail.example.org", None, 5551230000 + i, f"flat {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "phone string, member_name string, `Mobile No` string, passport string, ssn string, product_name string, mixed string, email string, telephone long, `HomeAddress` string")
    got = {r["column"]: (r["kind"], r["by_value"], r["by_header"], r["confidence"]) for r in X.scan_sensitive(df).collect()}
    assert got == {
        "phone": ("email", True, True, "high"), "member_name": ("person_name", True, True, "high"), "Mobile No": ("phone", True, True, "high"), "passport": ("gov_id", True, True, "high"), "ssn": ("gov_id", True, True, "high"),
        "mixed": ("email", True, False, "medium"), "telephone": ("phone", False, True, "medium"), "HomeAddress": ("address", False, True, "low"),
    }


def test_issues_between_snapshots(spark):
    kinds = "kind string, subject string, priority string"
    old = spark.createDataFrame([("a", "x", "low"), ("a", "y", "high"), ("b", "x", "medium"), ("c", "x", None)], kinds)
    new = spark.createDataFrame([("a", "x", "high"), ("a", "y", "low"), ("b", "x", "medium"), ("d", "x", "low")], kinds)
    assert {(r["kind"], r["subject"]): r["change"] for r in J.issue_drift(old, new).collect()} == {("a", "x"): "worse", ("a", "y"): "better", ("b", "x"): "same", ("c", "x"): "resolved", ("d", "x"): "new"}
    got = {r["aspect"]: r["differs"] for r in J.compare_tables(spark.createDataFrame([(1.0, "a")] * 30, "sales double, region string"), spark.createDataFrame([(1.0, "a")] * 20, "sales double, region string")).collect()}
    assert got["rows"] and not got["columns"] and not got["domain"]


def test_report_plan():
    from tabularium.operators.quality import Profile
    from tabularium.plans import report

    p = Profile(100, 5, 100.0, "sales", "day", "Customer", [("sales", "sum"), ("profit", "sum"), ("age", "avg")], [("region", 4, True), ("kind", 9, True), ("many", 80, False)])
    planned = report.plan(p)
    assert [x[:2] for x in planned] == [("trend", "sales"), ("histogram", "sales"), ("histogram", "profit"), ("histogram", "age"), ("box", "sales"), ("scatter", "sales x profit"), ("scatter", "sales x age"), ("scatter", "profit x age"), ("matrix", "measures"), ("count", "region"), ("by", "region"), ("count", "kind"), ("by", "kind"), ("pivot", "region x kind")]
    assert report.top_analyses(planned) == [("trend", "sales"), ("count", "region"), ("count", "kind")]
    assert report.top_analyses([("count", "a", 75), ("by", "a", 55)]) == [("count", "a"), ("by", "a")] and report.top_analyses([]) == []

"""Selection, clustering, bootstraps and join reports that count every row, against brute force and simulations."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import bootstrap as B
from tabularium.operators import clustering as G
from tabularium.operators import combine as J
from tabularium.operators import common as C
from tabularium.operators import entities as E
from tabularium.operators import findings as K
from tabularium.operators import inference as I
from tabularium.operators import relations as R
from tabularium.operators import text as X


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [float(i % 7) for i in range(300)], [random.Random(3).gauss(0, 1e6) for _ in range(2000)], [-1.5, 0.0, -0.0, 3.0, 3.0]])
def test_kth_largest(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    order = sorted(values, reverse=True)
    for k in sorted({1, min(2, len(values)), len(values) // 2 or 1, len(values)}):
        t, above, equal = C.kth_largest(rows, "v", k)
        assert (t, above, equal) == (order[k - 1], sum(v > order[k - 1] for v in values), sum(v == order[k - 1] for v in values))


def test_concentration_with_ties(spark):
    rows = [(c, v) for c in range(100) for v in ([50.0] if c < 3 else [10.0] if c < 40 else [1.0, 1.0])] + [(None, 1e9), (7, None)]
    df = spark.createDataFrame(rows, "c long, v double")
    got = E.customer_concentration(df, "c", "v").first()
    by = collections.Counter()
    for c, v in rows:
        if c is not None:
            by[c] += v or 0.0
    top = sum(sorted(by.values(), reverse=True)[:10])
    assert (got["customers"], got["top_customers"]) == (100, 10) and got["share_pct"] == pytest.approx(top * 100 / sum(by.values()))
    plan = E.customer_concentration(df, "c", "v")._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan


def test_concentration_of_few(spark):
    assert E.customer_concentration(spark.createDataFrame([(1, 2.0)], "c long, v double"), "c", "v").count() == 0


def blobs(n, seed=5):
    rng = np.random.default_rng(seed)
    mid = np.array([[0, 0], [6, 1], [2, 7]])
    return mid[rng.choice(3, n, p=[0.5, 0.3, 0.2])] + rng.normal(size=(n, 2))


def test_kmeans_cost_is_that_of_a_full_fit(spark):
    x = blobs(40_000)
    z = (x - x.mean(0)) / x.std(0)
    points = spark.createDataFrame(z.tolist(), "a double, b double").persist()
    centres, score = G.kmeans(points, ["a", "b"], len(z), range(2, 6), size=2_000)
    assert len(centres) == 3 == max(score, key=score.get)
    cost = lambda c: ((z[:, None] - c) ** 2).sum(2).min(1).sum()
    best = np.array([z[np.argmin(((x[:, None] - np.array([[0, 0], [6, 1], [2, 7]])) ** 2).sum(2), axis=1) == j].mean(0) for j in range(3)])
    for _ in range(50):
        own = ((z[:, None] - best) ** 2).sum(2).argmin(1)
        best = np.array([z[own == j].mean(0) for j in range(3)])
    assert cost(centres) <= 1.01 * cost(best)


def test_coreset_weighs_what_it_stands_for(spark):
    x = blobs(40_000)
    z = (x - x.mean(0)) / x.std(0)
    some = G.coreset(spark.createDataFrame(z.tolist(), "a double, b double"), ["a", "b"], len(z), 4_000).toPandas()
    assert 3_000 < len(some) < 5_000 and some["w"].sum() == pytest.approx(len(z), rel=0.05)
    for c in ([0.0, 0.0], [1.0, -2.0]):
        assert (some["w"] * ((some[["a", "b"]] - c) ** 2).sum(axis=1)).sum() == pytest.approx(((z - c) ** 2).sum(), rel=0.06)


def test_silhouette_by_sums_is_that_of_pairs(spark):
    x = blobs(150, 9)
    points = spark.createDataFrame(x.tolist(), "a double, b double")
    centres = np.array([[0.0, 0.0], [6.0, 1.0], [2.0, 7.0]])
    own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = []
    for i in range(len(x)):
        a = d[i][own == own[i]].sum() / (sum(own == own[i]) - 1)
        b = min(d[i][own == j].mean() for j in range(3) if j != own[i])
        want.append((b - a) / max(a, b))
    assert G.silhouettes(points, ["a", "b"], {3: centres})[3] == pytest.approx(np.mean(want))


def test_segments_assign_all_rows(spark):
    rows = [(float(i % 3) * 50 + i % 5, float(i % 3) * -20 + i % 2, i) for i in range(900)] + [(None, 1.0, -1)]
    out, summary = R.segments(spark.createDataFrame(rows, "a double, b double, i long"), ["a", "b"])
    by = {r["i"] % 3: r["segment"] for r in out.collect()}
    assert out.count() == 900 and len(set(by.values())) == 3
    assert {r["size"] for r in summary.collect()} == {300}


def claims_of(level="x"):
    return [B.Claim("m", "mean", "v"), B.Claim("s", "share", "v", "g", level, reference=40.0), B.Claim("d", "gap", "v", "g", level), B.Claim("c", "change", "v", "g", level, other="y")]


def test_bootstrap_ignores_partitions(spark):
    rows = [(i, "x" if i % 3 else "y", float(i % 17)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    got = [sorted((r["name"], round(r["low"], 9), round(r["high"], 9), r["significant"]) for r in B.bootstrap(d, claims_of(), ["i"]).collect()) for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("v")))]
    assert got[0] == got[1] == got[2]


def test_bootstrap_points(spark):
    rows = [(i, "x" if i % 3 else "y", float(i % 17)) for i in range(3000)] + [(-1, None, 5.0), (-2, "x", None)]
    x, y = ([v for i, g, v in rows if g == k and v is not None] for k in "xy")
    every = [v for _, _, v in rows if v is not None]
    got = {r["name"]: r for r in B.bootstrap(spark.createDataFrame(rows, "i long, g string, v double"), claims_of(), ["i"]).collect()}
    mean = lambda v: sum(v) / len(v)
    want = {"m": mean(every), "s": sum(x) * 100 / (sum(x) + sum(y)), "d": mean(x) - mean(y), "c": (mean(x) - mean(y)) * 100 / mean(y)}
    for k, v in want.items():
        assert got[k]["point"] == pytest.approx(v) and got[k]["low"] <= v <= got[k]["high"] and got[k]["valid"] == 300
    se = np.std(every) / len(every) ** 0.5
    assert got["m"]["high"] - got["m"]["low"] == pytest.approx(2 * 1.96 * se, rel=0.2)


def test_bootstrap_covers(spark):
    """Of 10 samples, about as many intervals hold the mean that the samples come from as with normal ones, and they are about as wide."""
    rng = np.random.default_rng(2)
    values = rng.exponential(10, (10, 400))
    df = spark.createDataFrame([(k * 1000 + i, k, float(v)) for k in range(10) for i, v in enumerate(values[k])], "i long, k long, v double")
    got = {int(r["name"]): r for r in B.bootstrap(df, [B.Claim(str(k), "mean", "v", where=F.col("k") == k) for k in range(10)], ["i"], draws=200).collect()}
    half = 1.96 * values.std(axis=1) / 20
    assert sum(r["low"] <= 10 <= r["high"] for r in got.values()) >= (np.abs(values.mean(axis=1) - 10) <= half).sum() - 1
    assert np.mean([(got[k]["high"] - got[k]["low"]) / 2 / half[k] for k in range(10)]) == pytest.approx(1, abs=0.12)


def test_bootstrap_needs_two_rows_a_side_and_takes_sides(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "y", 3.0), (4, "y", 2.5)], "i long, g string, v double")
    r = B.bootstrap(df, [B.Claim("d", "gap", "v", "g", "x")], ["i"]).first()
    assert (r["valid"], r["low"], r["significant"]) == (0, None, False)
    many = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(500)], "i long, v double")
    got = {r["name"]: r["significant"] for r in B.bootstrap(many, [B.Claim("both", "mean", "v", reference=5.0), B.Claim("below", "mean", "v", reference=5.0, side="below"), B.Claim("above", "mean", "v", reference=5.0, side="above")]).collect()}
    assert got == {"both": True, "below": True, "above": False}
    assert B.bootstrap(many.limit(0), [B.Claim("m", "mean", "v")]).first()["valid"] == 0


def test_a_rise_does_not_confirm_a_decline_one_sided(spark):
    # ten rows a day in the first year, each worth 1; in the last one half as many, each worth 1.2: the sum falls, the mean rises
    rows = [(f"{y}-{m:02d}-{d:02d}", v + 0.01 * (d % 3)) for y, times, v in ((2020, 4, 1.0), (2021, 2, 1.2)) for m in range(1, 13) for d in range(1, 29) for _ in range(times)]
    df = spark.createDataFrame(rows, "t string, v double").select(F.to_date("t").alias("t"), "v", F.monotonically_increasing_id().alias("i"))
    pick = lambda **kw: {r["kind"]: r["significant"] for r in K.weak_points(df, "t", "v", "sum", [], **kw).collect()}["declining"]
    assert pick() and not pick(one_sided=True)


def test_partial_last_year_is_left_out_on_request(spark):
    rows = [(f"{y}-{m:02d}-{d:02d}", 10.0 + d % 3) for y in (2020, 2021) for m in range(1, 13) for d in (1, 15, 31 if m in (1, 12) else 28)] + [(f"2022-{m:02d}-02", 10.0) for m in (1, 2)]
    df = spark.createDataFrame(rows, "t string, v double").select(F.to_date("t").alias("t"), "v")
    kinds = lambda **kw: {r["kind"] for r in K.weak_points(df, "t", "v", "sum", [], **kw).collect()}
    assert "declining" in kinds() and "declining" not in kinds(whole_years=True)


def test_kpi_interval_uses_all_rows(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 50).cast("double").alias("v"), (F.col("id") % 2).cast("double").alias("w"))
    got = {r["measure"]: r for r in I.kpi_intervals(df, [("v", "sum"), ("w", "avg")]).collect()}
    se = (sum((i - 24.5) ** 2 for i in range(50)) / 50 / 60_000) ** 0.5
    assert got["v"]["point"] == 24.5 * 60_000 and got["v"]["high"] - got["v"]["low"] == pytest.approx(2 * 1.96 * se * 60_000, rel=0.2)
    assert got["w"]["low"] < 0.5 < got["w"]["high"]


@pytest.mark.parametrize("null_safe", [False, True])
def test_join_report_counts_by_keys(spark, null_safe):
    facts = [(k, i) for i, k in enumerate([1, 1, 2, 3, 3, 3, None, None, 9])]
    dims = [(1, "a"), (2, "b"), (2, "c"), (4, "d"), (None, "e"), (5, "f"), (6, "g")]
    a, b = spark.createDataFrame(facts, "k long, x long"), spark.createDataFrame(dims, "k long, y string")
    joined, info = J.relational_join(a, b, "k", "k", null_safe=null_safe)
    match = lambda k: [y for d, y in dims if d == k and (null_safe or k is not None)]
    r = info.first()
    assert (r["rows"], r["matched"], r["fact_rows_matched"]) == (sum(max(1, len(match(k))) for k, _ in facts), sum(len(match(k)) for k, _ in facts), sum(bool(match(k)) for k, _ in facts))
    assert joined.count() == r["rows"]
    plan = info._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan and "distinct" not in plan.lower()


def test_join_key_of_many_values(spark):
    """Beyond what a sketch holds: pairs that may be the key are counted exactly, a hopeless one keeps its estimate."""
    left = spark.range(30_000).select((F.col("id") % 20_000).alias("key"), F.col("id").alias("Row No"), (F.col("id") % 7).alias("kind"))
    right = spark.range(20_000).select((F.col("id") + 5_000).alias("Key"), (F.col("id") + 1_000_000).alias("row_no"), (F.col("id") % 5).alias("Kind"))
    got = {r["left_column"]: r for r in J.detect_join_key(left, right).collect()}
    key = got["key"]
    assert key["exact"] and key["chosen"]
    assert (key["left_uniqueness"], key["right_uniqueness"], key["overlap"]) == (20_000 / 30_000, 1.0, 0.75)
    assert got["Row No"]["overlap"] == 0 and not got["Row No"]["chosen"] and not got["Row No"]["exact"]
    assert got["kind"]["exact"] and got["kind"]["overlap"] == 1.0 and not got["kind"]["chosen"]
    blank = spark.createDataFrame([(None, 1)], "key string, x int")
    none = J.detect_join_key(blank, right).collect()
    assert [(r["left_uniqueness"], r["overlap"], r["chosen"]) for r in none] == [(None, 0.0, False)]


def test_few_distinct(spark):
    """Columns of many values aren't counted; the others are, nulls aside."""
    rows = spark.range(5_000).select("id", (F.col("id") % 30).alias("a.b"), F.when(F.col("id") % 2 == 0, F.col("id") % 45).alias("c"), F.lit(None).cast("string").alias("none"))
    assert C.few_distinct(rows, ["id", "a.b", "c", "none"], 30) == (5_000, {"a.b": 30, "c": 45, "none": 0})
    assert C.few_distinct(rows.limit(0), ["id"], 30) == (0, {"id": 0})
    assert C.few_distinct(rows, [], 30) == (5_000, {})


def test_report_keeps_nothing(spark):
    """A report lets the columns go that it kept for its passes."""
    from tabularium.plans import report

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = spark.range(400).select(F.concat(F.lit("g"), F.col("id") % 4).alias("Region"), (F.col("id") * 1.5).alias("Sales"), (F.col("id") % 50 + 0.25).alias("Profit"))
    assert {r["analysis"] for r in report.full_report(rows).collect()} == {"histogram", "box", "scatter", "count", "by"}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


@pytest.mark.parametrize(("tracked", "named"), [(16_384, 300), (64, 20), (16, 4)])
def test_keywords_are_exact(spark, monkeypatch, tracked, named):
    """Heavy words, ties and a long tail, whether the sketches part them or all words must be counted."""
    monkeypatch.setattr(X, "TRACKED", tracked)
    monkeypatch.setattr(X, "NAMED", named)
    rng = np.random.default_rng(11)
    tail = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3_000)]
    texts = [" ".join([*(w for w, k in (("alpha", 3), ("beta", 2), ("gamma", 2), ("the", 9)) for _ in range(k * (i % 3 > 0))), *rng.choice(tail, 5), "Delta-x"]) for i in range(600)]
    want_n, want_e = collections.Counter(), collections.Counter()
    for t in texts:
        found = [w for w in re.findall("[a-z]{3,}", t.lower()) if w not in X.STOP_WORDS]
        want_n.update(found)
        want_e.update(set(found))
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string").repartition(6)
    got = [(r["word"], r["n"], round(r["entries_pct"], 6)) for r in X.keywords(df, "t", n=12).collect()]
    assert got == [(w, k, round(want_e[w] * 100 / 600, 6)) for w, k in sorted(want_n.items(), key=lambda x: (-x[1], x[0]))[:12]]


def test_join_key_counts_all_pairs(spark):
    """Every pair is counted, also one that can't be the key, whose overlap a sketch only estimates."""
    left = spark.range(30_000).select((F.col("id") % 20_000).alias("key"), F.col("id").alias("Row No"), (F.col("id") % 7).alias("kind"), F.lit(None).cast("string").alias("none"))
    right = spark.range(20_000).select((F.col("id") + 5_000).alias("Key"), (F.col("id") + 29_877).alias("row_no"), (F.col("id") % 5).alias("Kind"), F.lit(None).cast("string").alias("None"))
    out = J.detect_join_key(left, right, whole=True)
    assert "exact" not in out.columns
    got = {r["left_column"]: tuple(r)[2:] for r in out.collect()}
    assert got == {"key": (20_000 / 30_000, 1.0, 0.75, True), "Row No": (1.0, 1.0, 123 / 20_000, False), "kind": (7 / 30_000, 5 / 20_000, 1.0, False), "none": (None, None, 0.0, False)}
    assert J.detect_join_key(left.select("kind"), right.select("row_no"), whole=True).columns == out.columns


def test_join_key_query_has_no_estimates(spark, sf):
    """The registered query and its SQL state counts alone."""
    from tabularium.plans import registry

    assert "exact" not in registry.oracle_sql()["detect_join_key"] and "exact" not in registry.queries()["detect_join_key"](spark, sf).columns


def test_segments_go_over_blocks(spark):
    """Passes are over kept blocks of doubles: no pass explodes rows by model, and the summary follows from the last pass's sums, whatever the partitions."""
    x = blobs(20_000)
    points = spark.createDataFrame(x.tolist(), "a double, b double").repartition(5)
    packed = G.blocks(points, ["a", "b"])
    assert packed.count() < 20 and sorted(map(tuple, G.unpacked(packed, ["a", "b"]).collect())) == sorted(map(tuple, points.collect()))
    models = {k: np.random.default_rng(k).normal(size=(k, 2)) * 4 for k in (2, 3)}
    got = G.cluster_sums(points, ["a", "b"], models)
    for k, m in models.items():
        d = ((x[:, None] - m) ** 2).sum(2)
        own = d.argmin(1)
        for j, (n, sums, square, cost) in enumerate(got[k]):
            assert n == sum(own == j)
            assert not n or sums == pytest.approx(x[own == j].sum(0)) and (square, cost) == pytest.approx(((x[own == j] ** 2).sum(), d[own == j].min(1).sum()))
    out, summary = R.segments(points, ["a", "b"])
    assert "Generate" not in summary._jdf.queryExecution().toString()
    means = {(r["segment"], m): r[m] for r in out.groupBy("segment").avg("a", "b").withColumnsRenamed({"avg(a)": "a", "avg(b)": "b"}).collect() for m in "ab"}
    assert {(r["segment"], r["measure"]): pytest.approx(r["mean"]) for r in summary.collect()} == means

"""Intervals and directed tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.functions import stats as S
from tabularium.operators.bootstrap import Claim, bootstrap
from tabularium.operators.common import number

#: Rows that a bootstrap of medians takes.
SAMPLE = 20_000


def _sample(df: DataFrame, n: int = SAMPLE, seed: int = 0) -> DataFrame:
    """n rows at random: rows of equal values are picked independently."""
    return df.orderBy(F.rand(seed)).limit(n)


def kpi_intervals(df: DataFrame, measures: list[tuple[str, str]], n_boot: int = 1000, key: list[str] | None = None) -> DataFrame:
    """(measure, agg, n, point, low, high, margin_pct) for up to six measures with 10 values.

    The point is exact. The 95 % interval is that of the mean in a Poisson bootstrap of all rows, told apart by `key` (see bootstrap.bootstrap); sums are scaled by the true n. All measures share one pass.
    """
    some = measures[:6]
    band = bootstrap(df, [Claim(str(i), "mean", m) for i, (m, _) in enumerate(some)], key, n_boot)
    wide = df.agg(*(x for i, (m, how) in enumerate(some) for x in (F.count(number(m)).alias(f"n{i}"), (F.sum if how == "sum" else F.avg)(number(m)).alias(f"p{i}"))))
    points = [F.struct(F.lit(str(i)).alias("name"), F.lit(m).alias("measure"), F.lit(how).alias("agg"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("point")) for i, (m, how) in enumerate(some)]
    out = wide.select(F.explode(F.array(*points)).alias("r")).select("r.*").where("n >= 10").join(F.broadcast(band.select("name", "low", "high")), "name")
    scale = F.when(F.col("agg") == "sum", F.col("n")).otherwise(1)
    out = out.select("measure", "agg", "n", "point", (F.col("low") * scale).alias("low"), (F.col("high") * scale).alias("high"))
    return out.withColumn("margin_pct", F.try_divide((F.col("high") - F.col("low")) * 50, F.nullif(F.abs("point"), F.lit(0.0))))


def bootstrap_claim(df: DataFrame, kind: str, value: str, group: str | None = None, level: str | None = None, other: str | None = None, reference: float = 0.0, draws: int = 300, key: list[str] | None = None) -> DataFrame:
    """(kind, low, high, valid, significant) of one claim on all rows, see bootstrap.bootstrap, which takes many at once."""
    return bootstrap(df, [Claim(kind, kind, value, group, level, other, reference)], key, draws).select("kind", "low", "high", "valid", "significant")


def outcome_kind(df: DataFrame, outcome: str) -> DataFrame:
    """(values, numbers, distinct, infinite, kind): numeric if all values are numbers of over two kinds, else categorical; refused with infinite values."""
    v = number(outcome)
    row = df.where(F.col(outcome).isNotNull()).agg(F.count(F.lit(1)).alias("values"), F.count(v).alias("numbers"), F.count_distinct(F.col(outcome)).alias("distinct"), F.count_if(F.abs(v) == float("inf")).alias("infinite"))
    return row.withColumn("kind", F.when(F.col("infinite") > 0, "refused").when((F.col("numbers") == F.col("values")) & (F.col("distinct") > 2), "numeric").otherwise("categorical"))


def rank_sums(rows: DataFrame) -> DataFrame:
    """(u, ties, na, nb) of (g a | b, v): Mann-Whitney U of b over a, with the ties' sum of t^3 - t.

    Values collapse to counts, which are cumulated in ranges of values: offsets come from the ranges' totals, so no window spans all rows.
    """
    counts = rows.groupBy("v").agg(F.count_if(F.col("g") == "a").alias("ka"), F.count_if(F.col("g") == "b").alias("kb"))
    edges = counts.select(F.percentile_approx("v", [i / 16 for i in range(1, 16)]).alias("e"))
    ranged = counts.crossJoin(F.broadcast(edges)).withColumn("r", F.size(F.filter("e", lambda e: e < F.col("v")))).drop("e")
    totals = ranged.groupBy("r").agg(F.sum("ka").alias("t"))
    offsets = totals.select("r", F.coalesce(F.sum("t").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    below = F.coalesce(F.sum("ka").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ranged.join(F.broadcast(offsets), "r").withColumn("less", below + F.col("offset"))
    t = (F.col("ka") + F.col("kb")).cast("double")
    return x.agg(F.sum(F.col("kb") * (F.col("less") + F.col("ka") * 0.5)).alias("u"), F.sum(t * t * t - t).alias("ties"), F.sum("ka").alias("na"), F.sum("kb").alias("nb"))


SCHEMA_AB = (
    "n_a long, n_b long, mean_a double, mean_b double, difference double, t double, df double, p_value double, low double, high double, hedges_g double, u double, mann_whitney_p double, rank_biserial double, p_b_greater double, median_low double, median_high double, primary_test string, significant boolean"
)


def ab_test(df: DataFrame, group: str, a: str, b: str, outcome: str, seed: int = 0, draws: int = 1000) -> DataFrame:
    """One row of a two-group test of a numeric outcome; five rows in each group.

    Welch's t with interval and bias-corrected effect size; Mann-Whitney leads where a group has fewer than 30 rows and isn't normal
    (Shapiro-Wilk p < 0.05), with an interval of the difference of medians from the bootstrap
    (of 20,000 random rows of a group that has more). The other test stands beside it.
    """
    rows = df.where(F.col(group).cast("string").isin(a, b)).select(F.when(F.col(group).cast("string") == a, "a").otherwise("b").alias("g"), number(outcome).alias("v")).where("v is not null")
    m = {r["g"]: r for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"), F.count_if(F.abs("v") == float("inf")).alias("inf")).collect()}
    spark = df.sparkSession
    if set(m) != {"a", "b"} or min(m[x]["n"] for x in "ab") < 5 or any(m[x]["inf"] for x in "ab"):
        return spark.createDataFrame([], SCHEMA_AB)
    na, nb, va, vb = m["a"]["n"], m["b"]["n"], m["a"]["var"], m["b"]["var"]
    diff, se2 = m["b"]["mean"] - m["a"]["mean"], va / na + vb / nb
    se = math.sqrt(se2)
    dof = se2**2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) if se2 else float(na + nb - 2)
    t = diff / se if se else 0.0
    half = S.t_quantile(0.05, dof) * se
    sd = math.sqrt((va + vb) / 2)
    g = diff / sd * (1 - 3 / (4 * (na + nb) - 9)) if sd else 0.0
    r = rank_sums(rows).first()
    mw = S.mann_whitney_p(r["u"], na, nb, r["ties"])
    p_greater = r["u"] / (na * nb)
    small = {x: [q["v"] for q in rows.where(F.col("g") == x).collect()] for x in "ab" if m[x]["n"] < 30}
    skewed = any(S.shapiro_p(np.array(v)) < 0.05 for v in small.values())
    low = high = None
    if skewed:
        one, two = (np.array(small.get(x) or [q["v"] for q in _sample(rows.where(F.col("g") == x)).collect()]) for x in "ab")
        rng = np.random.default_rng(seed)
        d = [float(np.median(rng.choice(two, len(two))) - np.median(rng.choice(one, len(one)))) for _ in range(draws)]
        low, high = (float(q) for q in np.percentile(d, [2.5, 97.5]))
    p = S.t_two_sided(t, dof)
    lead = "mann_whitney" if skewed else "welch"
    return spark.createDataFrame([(na, nb, m["a"]["mean"], m["b"]["mean"], diff, t, dof, p, diff - half, diff + half, g, float(r["u"]), mw, 2 * p_greater - 1, p_greater, low, high, lead, (mw if skewed else p) < 0.05)], SCHEMA_AB)


def ab_rate_test(df: DataFrame, group: str, a: str, b: str, outcome: str, positive: str | None = None) -> DataFrame:
    """(level, count_a, count_b, rate_a, rate_b, difference, low, high, relative_risk, chi2, p_value, method, cramers_v, biggest_gap) for each outcome level (ten at most, unless one is named).

    Chi-square without correction; Fisher's exact test for two levels with an expected count under 5. Differences have Newcombe intervals.
    """
    schema = "level string, count_a long, count_b long, rate_a double, rate_b double, difference double, low double, high double, relative_risk double, chi2 double, p_value double, method string, cramers_v double, biggest_gap boolean"
    g, o = F.col(group).cast("string"), F.col(outcome).cast("string")
    level = F.when(o == positive, positive).otherwise("other") if positive is not None else o
    rows = df.where(g.isin(a, b) & o.isNotNull()).groupBy(level.alias("level")).agg(F.count_if(g == a).alias("x"), F.count_if(g == b).alias("y")).orderBy("level").limit(11).collect()
    na, nb = sum(r["x"] for r in rows), sum(r["y"] for r in rows)
    if len(rows) > 10 or len(rows) < 2 or min(na, nb) < 5:
        return df.sparkSession.createDataFrame([], schema)
    n = na + nb
    expected = [((r["x"] + r["y"]) * na / n, (r["x"] + r["y"]) * nb / n) for r in rows]
    chi2 = sum((r["x"] - e) ** 2 / e + (r["y"] - f) ** 2 / f for r, (e, f) in zip(rows, expected, strict=True))
    p, method = S.chi2_tail(chi2, len(rows) - 1), "chi_square"
    if len(rows) == 2 and min(min(e) for e in expected) < 5:
        p, method = S.fisher_exact(rows[0]["x"], rows[1]["x"], rows[0]["y"], rows[1]["y"]), "fisher_exact"
    gaps = [abs(r["y"] / nb - r["x"] / na) for r in rows]
    out = []
    for r, gap in zip(rows, gaps, strict=True):
        pa, pb = r["x"] / na, r["y"] / nb
        low, high = S.newcombe(r["x"], na, r["y"], nb)
        out.append((r["level"], r["x"], r["y"], pa, pb, pb - pa, low, high, pb / pa if pa else None, chi2, p, method, math.sqrt(chi2 / n), gap == max(gaps)))
    return df.sparkSession.createDataFrame(out, schema)

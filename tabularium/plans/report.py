"""Report jobs: which analyses a table gets, as one table of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.operators import aggregates as A
from tabularium.operators import quality as Q
from tabularium.operators import relations as R
from tabularium.operators import series as S
from tabularium.operators.common import few_distinct, number, typed

COLUMNS = "analysis string, subject string, label string, other string, value double"


def _part(df: DataFrame, analysis: str, subject: str, label=None, other=None, value=None) -> DataFrame:
    text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    return df.select(F.lit(analysis).alias("analysis"), F.lit(subject).alias("subject"), text(label).alias("label"), text(other).alias("other"), F.col(value).cast("double").alias("value"))


#: How much an analysis matters, and what one of the primary measure gets on top.
IMPORTANCE = {"trend": 85, "count": 75, "by": 55, "histogram": 50, "pivot": 45, "matrix": 40, "scatter": 35, "box": 30}
PRIMARY = 10


def plan(p: Q.Profile) -> list[tuple[str, str, int]]:
    """(analysis, subject, importance) of all analyses that a profile calls for, in order."""
    dims = [c for c, _, ok in p.dimensions if ok]
    if not p.measures:
        return [("count", c, IMPORTANCE["count"]) for c in dims]
    primary, names = p.measures[0][0], [m for m, _ in p.measures]
    out = [("trend", primary, IMPORTANCE["trend"])] if p.date else []
    out += [("histogram", m, IMPORTANCE["histogram"] + PRIMARY * (m == primary)) for m in names] + [("box", primary, IMPORTANCE["box"])]
    out += [("scatter", f"{a} x {b}", IMPORTANCE["scatter"]) for i, a in enumerate(names) for b in names[i + 1 :]]
    out += [("matrix", "measures", IMPORTANCE["matrix"])] if len(names) >= 3 else []
    out += [(kind, c, IMPORTANCE[kind]) for c in dims for kind in ("count", "by")]
    small = [c for c, n, ok in sorted(p.dimensions, key=lambda x: x[1]) if ok and n <= 10][:2]
    return out + ([("pivot", " x ".join(small), IMPORTANCE["pivot"])] if len(small) == 2 else [])


def top_analyses(planned: list[tuple[str, str, int]], n: int = 3) -> list[tuple[str, str]]:
    """The n most important analyses: no subject twice, no kind more than half of them (rounded up), unless there are too few."""
    order = sorted(planned, key=lambda x: -x[2])
    chosen: list[tuple[str, str]] = []
    for kind, subject, _ in order:
        if len(chosen) < n and subject not in {s for _, s in chosen} and sum(k == kind for k, _ in chosen) < max(1, (n + 1) // 2):
            chosen.append((kind, subject))
    rest = [(k, s) for k, s, _ in order if (k, s) not in chosen]
    return chosen + rest[: n - len(chosen)]


def histograms(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """(column, bin, low, high, n) of all columns: their ends in one pass, their bins in another. See aggregates.histogram."""
    df, by = typed(df, cols)
    v = [by[c] for c in cols]
    row = df.agg(*(f(x).alias(f"{k}{i}") for i, x in enumerate(v) for k, f in (("a", F.min), ("b", F.max), ("d", F.approx_count_distinct)))).first()
    few = [i for i in range(len(cols)) if row[f"d{i}"] <= 5 * bins]
    exact = df.agg(*(F.count_distinct(v[i]).alias(f"d{i}") for i in few)).first() if few else {}
    shape = []
    for i in range(len(cols)):
        k = min(bins, exact[f"d{i}"] if i in few else bins)
        low, high = (row[f"a{i}"], row[f"b{i}"]) if row[f"a{i}"] != row[f"b{i}"] else ((row[f"a{i}"] or 0) - 0.5, (row[f"b{i}"] or 0) + 0.5)
        shape.append((i, cols[i], low, (high - low) / max(k, 1), k))
    bin_of = lambda i, low, width, k: F.least(F.floor((v[i] - low) / F.lit(width)), F.lit(k - 1)).cast("int")
    cells = F.array(*(F.struct(F.lit(i).alias("i"), bin_of(i, low, width, k).alias("bin")) for i, _, low, width, k in shape))
    counts = df.select(F.explode(cells).alias("c")).select("c.*").where("bin is not null").groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(i, c, j, low + j * width, low + (j + 1) * width) for i, c, low, width, k in shape for j in range(k)], "i int, `column` string, bin int, low double, high double")
    return grid.join(F.broadcast(counts), ["i", "bin"], "left").select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def distributions(df: DataFrame, dims: list[str], metric: str, how: str, n: int = 15) -> DataFrame:
    """(kind count | by, column, label, value): the n most frequent values of each dimension, and those with the greatest metric, from one unpivoted grouping."""
    v = number(F.col(f"`{metric}`"))
    long = df.select(v.alias("v"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("label")) for c in dims))).alias("d")).where("d.label is not null")
    by = long.groupBy("d.column", "d.label").agg(F.count(F.lit(1)).cast("double").alias("count"), A.agg_of("v", how).alias("by"))
    kinds = by.select("column", "label", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("count", "by")))).alias("k")).select("k.kind", "column", "label", "k.value")
    order = Window.partitionBy("kind", "column").orderBy(F.desc_nulls_last("value"), "label")
    return kinds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def full_report(df: DataFrame, overrides: dict[str, str] | None = None, points: int = 400) -> DataFrame:
    """All analyses that a table's profile calls for, in long form: COLUMNS, importance and top (one of the three to show first).

    Trend of the primary measure; histograms of all measures and a box plot of the primary one; for all pairs of measures the points of one
    sample of rows, with r for three measures or more; counts and sums by each chartable dimension; a cross-tab of the two best dimensions of at most ten values. A
    table without measures gets its frequencies. The columns needed are kept (persisted) for the passes over them
    and let go when the result is there: it is short (bins, months, the first labels of each dimension, `points` rows) and comes to the driver.
    """
    p = Q.understand(df, overrides)
    planned = plan(p)
    dims = [c for c, _, ok in p.dimensions if ok]
    if not p.measures:
        out = A.no_metric_report(df, dims or [c for c, _, _ in p.dimensions]).select(F.col("kind").alias("analysis"), "subject", "label", F.lit(None).cast("string").alias("other"), "value")
    else:
        primary, how = p.measures[0]
        names = [m for m, _ in p.measures]
        kept = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*names, *(c for c, _, _ in p.dimensions), *([p.date] if p.date else [])]))).persist()
        parts = [histograms(kept, names).select(F.lit("histogram").alias("analysis"), F.col("column").alias("subject"), F.col("bin").cast("string").alias("label"), F.concat_ws(" to ", F.round("low", 2), F.round("high", 2)).alias("other"), F.col("n").cast("double").alias("value"))]
        box = A.boxplot(kept, primary)
        shown = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).cast("double").alias("value")) for k in ("n", "min", "low", "q1", "median", "q3", "high", "max", "outliers"))))
        parts.append(_part(box.select(shown.alias("b")).select("b.*"), "box", primary, "label", None, "value"))
        if p.date:
            parts.append(_part(A.trend(kept, p.date, primary, how), "trend", primary, "month", None, "value"))
        if len(names) >= 2:
            some = kept.select(*(number(F.col(f"`{m}`")).alias(f"m{i}") for i, m in enumerate(names))).orderBy(F.rand(0)).limit(points)
            pairs = F.explode(F.array(*(F.struct(F.lit(f"{a} x {b}").alias("subject"), F.col(f"m{i}").alias("x"), F.col(f"m{j}").alias("y")) for i, a in enumerate(names) for j, b in enumerate(names) if i < j)))
            parts.append(some.select(pairs.alias("p")).where("p.x is not null and p.y is not null").select(F.lit("scatter"), "p.subject", F.lit(None).cast("string"), F.col("p.x").cast("string"), "p.y"))
        if len(names) >= 3:
            parts.append(_part(A.correlation_matrix(kept, names), "matrix", "measures", "col1", "col2", "r"))
        if dims:
            parts.append(distributions(kept, dims, primary, how).select("kind", "column", "label", F.lit(None).cast("string"), "value"))
        small = next((s for k, s, _ in planned if k == "pivot"), None)
        if small:
            parts.append(_part(A.pivot(kept, *[c for c, n, ok in sorted(p.dimensions, key=lambda x: x[1]) if ok and n <= 10][:2], primary, how), "pivot", small, "dim1", "dim2", "value"))
        out = parts[0]
        for more in parts[1:]:
            out = out.union(more)
        try:
            rows = out.collect()
        finally:
            kept.unpersist()
        out = df.sparkSession.createDataFrame(rows, COLUMNS)
    first = top_analyses(planned)
    marks = df.sparkSession.createDataFrame([(k, s, i, (k, s) in first) for k, s, i in planned], "analysis string, subject string, importance int, top boolean")
    return out.join(F.broadcast(marks), ["analysis", "subject"], "left")


def filtered_report(df: DataFrame, date: str, metric: str, agg: str, dims: list[str]) -> DataFrame:
    """Seasons, period comparison, drivers and robustness of filtered rows (COLUMNS); dimensions are judged anew on them.

    The columns needed are kept (persisted) for the passes over them, so that joins and filters behind df run once, and let go when the result is there: it is short (months and segments) and
    comes to the driver.
    """
    kept = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([date, metric, *dims]))).persist()
    try:
        rows = _filtered_parts(kept, date, metric, agg, dims).collect()
    finally:
        kept.unpersist()
    return df.sparkSession.createDataFrame(rows, COLUMNS)


def _filtered_parts(df: DataFrame, date: str, metric: str, agg: str, dims: list[str]) -> DataFrame:
    rows, distinct = few_distinct(df, dims, 30)
    use = [c for c in dims if 2 <= distinct.get(c, 0) <= min(30, max(rows / 2, 2))]
    series = A.trend(df, date, metric, agg)
    out = _part(series, "trend", metric, "month", None, "value")
    out = out.unionByName(_part(S.seasonality(series).where("season is not null"), "season", metric, "month", None, "season"))
    out = out.unionByName(_part(S.period_comparison(df, date, metric, agg), "period", metric, "month", "previous_month", "change_pct"))
    out = out.unionByName(_part(R.robust_kpis(df, [(metric, agg)]), "robust", metric, None, None, "change_pct"))
    before, after = S.last_two_months(df, date)
    if use and before and after:
        out = out.unionByName(_part(S.drivers(df, date, metric, agg, use, before, after), "driver", metric, "dimension", "segment", "change"))
    return out

"""Filters, grouped aggregates and chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.operators import common as C
from tabularium.operators.common import agg_of, by_pair, number, quantiles, rows_from, top


def analysis_slice(df: DataFrame, date: str | None, dimensions: list[str], measures: list[str]) -> DataFrame:
    """The date as yyyy-MM-dd, dimensions and measures, each once."""
    cols = list(dict.fromkeys([*([date] if date else []), *dimensions, *measures]))
    return df.select(*(F.date_format(C.timestamp(df, c), "yyyy-MM-dd").alias(c) if c == date else F.col(c) for c in cols))


def filter_rows(df: DataFrame, date: str | None = None, date_from: str | None = None, date_to: str | None = None, allowed: dict[str, list] | None = None) -> DataFrame:
    """Rows whose day is in a closed range (null days go once there is a range) and whose dimensions have allowed values (none: all)."""
    if date and (date_from or date_to):
        ts = C.timestamp(df, date)
        if date_from:
            df = df.where(ts >= F.lit(date_from).cast("timestamp_ntz"))
        if date_to:
            df = df.where(ts < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp_ntz"))
    for c, values in (allowed or {}).items():
        if values:
            df = df.where(F.col(c).isin(list(values)))
    return df


def level_counts(df: DataFrame, col: str) -> DataFrame:
    """(level, rows) of non-empty values, most frequent first."""
    return df.where(F.col(col).isNotNull() & (F.trim(F.col(col).cast("string")) != "")).groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "level")


def date_range(df: DataFrame, col: str) -> DataFrame:
    """(first_day, last_day) as text."""
    day = F.date_format(C.timestamp(df, col), "yyyy-MM-dd")
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def trend(df: DataFrame, date: str, metric: str, agg: str = "sum") -> DataFrame:
    """(month, value): months without rows are absent."""
    typed = df.select(C.month(C.timestamp(df, date)).alias("month"), number(metric).alias("value")).where("month is not null and value is not null")
    return typed.groupBy("month").agg(agg_of("value", agg).alias("value")).orderBy("month")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal bins from min to max, the last one closed; as many as distinct values, if fewer; empty bins count 0."""
    values = df.select(number(col).alias("v")).where("v is not null")
    k = values.select("v").distinct().limit(bins).count()
    ends = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    if not k:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    a, b = (ends["a"] - 0.5, ends["b"] + 0.5) if ends["a"] == ends["b"] else (ends["a"], ends["b"])
    width = (b - a) / k
    counts = values.groupBy(F.least(F.floor((F.col("v") - a) / F.lit(width)), F.lit(k - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = values.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", (F.lit(a) + F.col("bin") * width).alias("low"), (F.lit(a) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")


def distribution_count(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """(label, rows): the most frequent values."""
    return top(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("rows")), "rows", "label", n)


def distribution_sum(df: DataFrame, col: str, metric: str, agg: str = "sum", n: int = 15) -> DataFrame:
    """(label, value): the metric by a dimension, greatest first."""
    return top(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(agg_of(number(metric), agg).alias("value")), "value", "label", n)


def _top_labels(df: DataFrame, col: str, alias: str, n: int) -> DataFrame:
    return df.groupBy(F.col(col).alias(alias)).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), alias).limit(n).select(alias)


def pivot(df: DataFrame, dim1: str, dim2: str, metric: str, agg: str = "sum", n: int = 8) -> DataFrame:
    """(dim1, dim2, value) for all pairs of the n most frequent values of two dimensions; null where a pair has no rows."""
    rows = df.where(F.col(dim1).isNotNull() & F.col(dim2).isNotNull()).select(F.col(dim1).alias("dim1"), F.col(dim2).alias("dim2"), number(metric).alias("v"))
    a, b = F.broadcast(_top_labels(rows, "dim1", "dim1", n)), F.broadcast(_top_labels(rows, "dim2", "dim2", n))
    cells = rows.join(a, "dim1", "left_semi").join(b, "dim2", "left_semi").groupBy("dim1", "dim2").agg(agg_of("v", agg).alias("value"))
    return a.crossJoin(b).join(F.broadcast(cells), ["dim1", "dim2"], "left")


def ad_hoc(df: DataFrame, agg: str, measure: str, dim1: str, dim2: str | None = None) -> DataFrame:
    """sum, avg or count of a measure by one dimension (15 greatest) or two (8 x 8)."""
    return pivot(df, dim1, dim2, measure, agg) if dim2 else distribution_sum(df, dim1, measure, agg)


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, n: int = 400) -> DataFrame:
    """(x, y, color) of at most n complete rows, picked at random."""
    rows = df.select(number(x).alias("x"), number(y).alias("y"), (F.col(color).cast("string") if color else F.lit(None).cast("string")).alias("color"))
    return rows.where("x is not null and y is not null").orderBy(F.rand(0)).limit(n)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, strength) of two columns on complete rows."""
    both = number(x).isNotNull() & number(y).isNotNull()
    r = F.coalesce(F.nanvl(F.corr(F.when(both, number(x)), F.when(both, number(y))), F.lit(0.0)), F.lit(0.0))
    return df.agg(F.count_if(both).alias("n"), r.alias("r")).withColumn("strength", F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.4, "moderate").when(F.abs("r") >= 0.15, "weak").otherwise("none"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col1, col2, r) of all ordered pairs, on rows complete for the pair; undefined is 0, the diagonal 1. One pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "col1 string, col2 string, r double")
    by = by_pair(df, pairs, lambda x, y: [F.nanvl(F.corr(x, y), F.lit(0.0)).alias("r")])
    cells = [(c, c, None) for c in cols] + [(*p, i) for i, (a, b) in enumerate(pairs) for p in ((a, b), (b, a))]
    grid = df.sparkSession.createDataFrame(cells, "col1 string, col2 string, i int")
    return grid.join(F.broadcast(by), "i", "left").select("col1", "col2", F.when(F.col("i").isNull(), 1.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"))


def boxplot(df: DataFrame, col: str) -> DataFrame:
    """(n, min, q1, median, q3, max, low, high, outliers, examples): fences clipped to the data, the 30 least values beyond them."""
    v = df.select(number(F.col(f"`{col}`")).alias("v")).where("v is not null")
    _, (q1, q2, q3) = quantiles(df, [col], [0.25, 0.5, 0.75]).get(col, (0, [None] * 3))
    low, high = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else (None, None)
    lit = lambda x: F.lit(x).cast("double")
    stats = v.agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if((F.col("v") < lit(low)) | (F.col("v") > lit(high))).alias("outliers"))
    few = v.where((F.col("v") < lit(low)) | (F.col("v") > lit(high))).orderBy("v").limit(30).agg(F.sort_array(F.collect_list("v")).alias("examples"))
    stats = stats.select("n", "min", lit(q1).alias("q1"), lit(q2).alias("median"), lit(q3).alias("q3"), "max", F.greatest(F.col("min"), lit(low)).alias("low"), F.least(F.col("max"), lit(high)).alias("high"), "outliers")
    return stats.crossJoin(F.broadcast(few))


def kpis(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One row of the standard figures of the mapped roles; figures of absent roles are null."""
    role = lambda r: number(mapping[r]) if r in mapping else F.lit(None).cast("double")
    total = lambda r: F.coalesce(F.sum(role(r)), F.lit(0.0)) if r in mapping else F.lit(None).cast("double")
    day = F.date_format(C.timestamp(df, mapping["date"]), "yyyy-MM-dd") if "date" in mapping else F.lit(None).cast("string")
    missing = sum((F.avg(F.col(f"`{c}`").isNull().cast("int")) for c in df.columns), F.lit(0.0)) / max(len(df.columns), 1)
    out = df.agg(
        total("revenue").alias("total_revenue"), total("profit").alias("total_profit"), F.count(F.lit(1)).alias("order_count"), F.avg(role("revenue")).alias("avg_order_value"),
        total("quantity").alias("total_units"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), (100 * (1 - missing)).alias("completeness_pct"),
    ).withColumns({"margin_pct": F.try_divide(F.col("total_profit") * 100, F.nullif("total_revenue", F.lit(0.0))), "column_count": F.lit(len(df.columns))})
    if "customer" not in mapping:
        return out.withColumns({"unique_customers": F.lit(None).cast("long"), "revenue_per_customer": F.lit(None).cast("double")})
    by = df.where(F.col(mapping["customer"]).isNotNull()).groupBy(mapping["customer"]).agg(F.coalesce(F.sum(role("revenue")), F.lit(0.0)).alias("r"))
    return out.crossJoin(by.agg(F.count(F.lit(1)).alias("unique_customers"), F.avg("r").alias("revenue_per_customer")))


def monthly_revenue(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(month, revenue, profit): only the date must be there."""
    m = C.month(C.timestamp(df, mapping["date"]))
    parts = [F.coalesce(F.sum(number(mapping[r])), F.lit(0.0)).alias(r) for r in ("revenue", "profit") if r in mapping]
    return df.where(m.isNotNull()).groupBy(m.alias("month")).agg(*parts).orderBy("month")


def breakdown(df: DataFrame, col: str, mapping: dict[str, str], n: int = 15) -> DataFrame:
    """(label, revenue, profit, margin_pct) by one column, the n greatest revenues; no margin at zero revenue."""
    rows = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("label")).agg(*(F.coalesce(F.sum(number(mapping[r])), F.lit(0.0)).alias(r) for r in ("revenue", "profit")))
    return top(rows, "revenue", "label", n).withColumn("margin_pct", F.try_divide(F.col("profit") * 100, F.nullif("revenue", F.lit(0.0))))


def all_breakdowns(df: DataFrame, mapping: dict[str, str], cols: list[str], n: int = 15, most: int = 6) -> DataFrame:
    """(column, label, revenue, profit, margin_pct): `breakdown` of up to six columns with few distinct values, by one pass for all of them."""
    rows, distinct = C.few_distinct(df, cols, 30)
    use = [c for c in cols if 2 <= distinct.get(c, 0) <= min(30, max(rows / 2, 2))][:most]
    if not use:
        return df.sparkSession.createDataFrame([], "column string, label string, revenue double, profit double, margin_pct double")
    long = df.select(number(mapping["revenue"]).alias("r"), number(mapping["profit"]).alias("p"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in use))).alias("d"))
    sums = long.where("d.label is not null").groupBy("d.column", "d.label").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("revenue"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("profit"))
    ranked = sums.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("revenue"), "label"))).where(F.col("k") <= n).drop("k")
    return ranked.withColumn("margin_pct", F.try_divide(F.col("profit") * 100, F.nullif("revenue", F.lit(0.0))))


def yearly_change(df: DataFrame, date: str, metric: str, agg: str = "sum") -> DataFrame:
    """(first_year, first_value, last_year, last_value, change_pct)."""
    rows = df.select(F.year(C.timestamp(df, date)).alias("y"), number(metric).alias("v")).where("y is not null and v is not null")
    by = rows.groupBy("y").agg(agg_of("v", agg).alias("value"))
    out = by.agg(F.min("y").alias("first_year"), F.min_by("value", "y").alias("first_value"), F.max("y").alias("last_year"), F.max_by("value", "y").alias("last_value"))
    return out.where("first_year < last_year").withColumn("change_pct", F.try_divide((F.col("last_value") - F.col("first_value")) * 100, F.nullif(F.abs("first_value"), F.lit(0.0))))


def no_metric_report(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(kind, subject, label, value) for a table without measures: counts, completeness and the most frequent values of its dimensions."""
    missing = sum((F.avg(F.col(f"`{c}`").isNull().cast("int")) for c in df.columns), F.lit(0.0)) / max(len(df.columns), 1)
    facts = df.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.lit(float(len(df.columns))).alias("columns"), (100 * (1 - missing)).alias("completeness_pct"))
    out = rows_from(facts, {k: {"value": k} for k in ("rows", "columns", "completeness_pct")}, "subject").select(F.lit("table").alias("kind"), "subject", F.lit(None).cast("string").alias("label"), "value")
    for d in dimensions:
        out = out.unionByName(distribution_count(df, d).select(F.lit("frequency").alias("kind"), F.lit(d).alias("subject"), F.col("label").cast("string").alias("label"), F.col("rows").cast("double").alias("value")))
    return out

"""Findings: rules over aggregates, as a table of facts.

Columns: kind, subject, value_label, metric, value, reference, score, priority, significant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.operators import aggregates as A
from tabularium.operators import bootstrap as B
from tabularium.operators import common as C
from tabularium.operators import quality as Q
from tabularium.operators.common import number

COLUMNS = "kind string, subject string, value_label string, metric string, value double, reference double, score double, priority string, significant boolean"


def _facts(df: DataFrame, **cols) -> DataFrame:
    """df with the facts' columns; those not given are null."""
    kinds = [c.split() for c in COLUMNS.split(", ")]
    return df.select(*((cols[n] if not isinstance(cols.get(n), str) else F.lit(cols[n])).cast(t).alias(n) if n in cols else F.lit(None).cast(t).alias(n) for n, t in kinds))


def most_common(df: DataFrame, dims: list[str]) -> DataFrame:
    """The most common value of each dimension, and its share of all rows."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("subject"), F.col(d).cast("string").alias("label")) for d in dims))).alias("d")).select("d.*")
    counts = long.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.sum("n").over(Window.partitionBy("subject"))).where("label is not null")
    first = counts.withColumn("k", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "label"))).where("k = 1")
    share = F.col("n") * 100.0 / F.col("rows")
    return _facts(first, kind="most_common", subject=F.col("subject"), value_label=F.col("label"), value=share, score=share / 100)


def measure_averages(df: DataFrame, measures: list[str]) -> DataFrame:
    """The mean of each measure with values; reference is their number."""
    wide = df.agg(*(x for m in measures for x in (F.avg(number(m)).alias(f"{m}|a"), F.count(number(m)).alias(f"{m}|n"))))
    from tabularium.operators.common import rows_from

    rows = rows_from(wide, {m: {"a": f"{m}|a", "n": f"{m}|n"} for m in measures}).where("n > 0")
    return _facts(rows, kind="average", subject=F.col("column"), metric=F.col("column"), value=F.col("a"), reference=F.col("n"))


def top_segment(df: DataFrame, dim: str, metric: str, agg: str = "sum") -> DataFrame:
    """The segment with the greatest value of a metric, of two or more."""
    by = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("label")).agg((F.sum if agg == "sum" else F.avg)(number(metric)).alias("v")).where("v is not null")
    best = by.agg(F.max(F.struct(F.col("v"), F.col("label"))).alias("b"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    return _facts(best, kind="top_segment", subject=F.lit(dim), value_label=F.col("b.label"), metric=F.lit(metric), value=F.col("b.v"))


def strongest_correlation(df: DataFrame, measures: list[str], least: float = 0.4) -> DataFrame:
    """The pair of measures with the greatest |r|; score 0 below `least`."""
    best = A.correlation_matrix(df, measures).where("col1 < col2").orderBy(F.desc(F.abs("r")), "col1", "col2").limit(1)
    return _facts(best, kind="correlation", subject=F.col("col1"), value_label=F.col("col2"), value=F.col("r"), reference=F.lit(least), score=F.when(F.abs("r") >= least, F.abs("r")).otherwise(0.0), significant=F.abs("r") >= least)


def concentration(df: DataFrame, dim: str, metric: str) -> DataFrame:
    """The top segment's share of a metric against an even share; significant over 1.5 times that."""
    by = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("label")).agg(F.coalesce(F.sum(number(metric)), F.lit(0.0)).alias("v"))
    one = by.agg(F.sum("v").alias("all"), F.count(F.lit(1)).alias("k"), F.max(F.struct("v", "label")).alias("b")).where("all > 0 and k >= 2")
    share, even = F.col("b.v") * 100 / F.col("all"), 100.0 / F.col("k")
    return _facts(one, kind="concentration", subject=F.lit(dim), value_label=F.col("b.label"), metric=F.lit(metric), value=share, reference=even, score=share - even, significant=share > 1.5 * even)


def losing_segments(df: DataFrame, dim: str, revenue: str, profit: str, n: int = 2) -> DataFrame:
    """The n segments with the worst margins; significant where it is a loss."""
    by = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("label")).agg(F.sum(number(revenue)).alias("r"), F.sum(number(profit)).alias("p"))
    margin = F.try_divide(F.col("p") * 100, F.nullif("r", F.lit(0.0)))
    worst = by.withColumn("m", margin).where("m is not null").orderBy("m", "label").limit(n)
    return _facts(worst, kind="losing_segment", subject=F.lit(dim), value_label=F.col("label"), metric=F.lit(profit), value=F.col("m"), reference=F.lit(0.0), score=F.greatest(-F.col("m"), F.lit(0.0)), significant=F.col("m") < 0)


def discount_bands(df: DataFrame, discount: str, revenue: str, profit: str) -> DataFrame:
    """The margin of each discount band; the worst loss and the highest band that still pays are marked in `priority`."""
    most = df.agg(F.max(number(discount))).first()[0] or 0
    d = number(discount) / (100.0 if most > 1.5 else 1.0)
    band = F.when((d > -0.01) & (d <= 0), "0").when((d > 0) & (d <= 0.2), "0-20%").when((d > 0.2) & (d <= 0.4), "20-40%").when((d > 0.4) & (d <= 0.6), "40-60%").when((d > 0.6) & (d <= 1.01), "over 60%")
    by = df.select(band.alias("band"), number(revenue).alias("r"), number(profit).alias("p")).where("band is not null").groupBy("band").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    m = by.withColumn("m", F.try_divide(F.col("p") * 100, F.nullif("r", F.lit(0.0)))).where("m is not null")
    marks = m.agg(F.min(F.when(F.col("m") < 0, F.struct("m", "band"))).alias("bad"), F.max(F.when(F.col("m") >= 0, F.col("band"))).alias("good"))
    m = m.crossJoin(F.broadcast(marks))
    return _facts(m, kind="discount_band", subject=F.lit(discount), value_label=F.col("band"), metric=F.lit(profit), value=F.col("m"), reference=F.lit(0.0), priority=F.when(F.col("band") == F.col("bad.band"), "worst").when(F.col("band") == F.col("good"), "highest_paying"), significant=F.col("m") < 0)


def declining(df: DataFrame, date: str, metric: str, agg: str = "sum") -> DataFrame:
    """The change from first to last year; significant below -5 %, priority medium below -15 and high below -30 %."""
    y = A.yearly_change(df, date, metric, agg)
    c = F.col("change_pct")
    return _facts(y, kind="declining", subject=F.lit(metric), value_label=F.concat_ws("-", "first_year", "last_year"), metric=F.lit(metric), value=c, reference=F.lit(-5.0), score=F.greatest(-c, F.lit(0.0)), priority=F.when(c < -30, "high").when(c < -15, "medium").otherwise("low"), significant=c < -5)


def missing_data(df: DataFrame, cols: list[str], n: int = 3) -> DataFrame:
    """The n columns with the most nulls over 15 %."""
    worst = Q.missing_by_column(df.select(*cols)).where("missing_pct > 15").orderBy(F.desc("missing_pct"), "column").limit(n)
    p = F.col("missing_pct")
    return _facts(worst, kind="missing", subject=F.col("column"), value=p, reference=F.lit(15.0), score=p, priority=F.when(p > 50, "high").when(p > 30, "medium").otherwise("low"), significant=F.lit(True))


def high_outliers(df: DataFrame, measure: str) -> DataFrame:
    """How much of a measure's total lies above Q3 + 1.5 quartile ranges; significant if under 8 % of the rows hold over 20 %."""
    found = Q.fences(df, [measure]).get(measure)
    if not found or found[0] < 20 or found[2] <= found[1]:
        return df.sparkSession.createDataFrame([], COLUMNS)
    v = number(measure)
    row = df.agg((F.count_if(v > found[4]) * 100.0 / F.count(v)).alias("rows_pct"), F.try_divide(F.sum(F.when(v > found[4], v).otherwise(0.0)) * 100, F.nullif(F.sum(v), F.lit(0.0))).alias("share"))
    return _facts(row, kind="high_outliers", subject=F.lit(measure), metric=F.lit(measure), value=F.col("share"), reference=F.col("rows_pct"), score=F.col("share"), significant=(F.col("rows_pct") < 8) & (F.col("share") > 20))


def under_performing(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """The segment with the worst mean against the overall mean; significant from 15 % below."""
    rows = df.where(F.col(dim).isNotNull()).select(F.col(dim).cast("string").alias("label"), number(measure).alias("v")).where("v is not null")
    by = rows.groupBy("label").agg(F.avg("v").alias("m"))
    one = by.agg(F.min(F.struct("m", "label")).alias("b"), F.count(F.lit(1)).alias("k")).where("k >= 2").crossJoin(rows.agg(F.avg("v").alias("overall")))
    below = F.try_divide((F.col("overall") - F.col("b.m")) * 100, F.nullif(F.abs("overall"), F.lit(0.0)))
    return _facts(one, kind="under_performing", subject=F.lit(dim), value_label=F.col("b.label"), metric=F.lit(measure), value=F.col("b.m"), reference=F.col("overall"), score=below, significant=below >= 15)


#: Priorities after a gate that a finding failed.
LOWER = {"high": "medium", "medium": "low", "low": "low"}


def ranked(facts: DataFrame, n: int = 8) -> DataFrame:
    """The n findings with the greatest scores; those that failed their gate count 0.6 times and go down one priority."""
    failed = F.col("significant") == F.lit(False)
    down = F.coalesce(F.create_map(*(F.lit(x) for kv in LOWER.items() for x in kv))[F.col("priority")], F.col("priority"))
    gated = facts.withColumn("score", F.when(failed, F.col("score") * 0.6).otherwise(F.col("score"))).withColumn("priority", F.when(failed, down).otherwise(F.col("priority")))
    return gated.orderBy(F.desc_nulls_last("score"), "kind", "subject", "value_label").limit(n)


def gated(fact: DataFrame, claim: DataFrame) -> DataFrame:
    """A finding after a bootstrap (inference.bootstrap_claim) of the numbers behind it: with low and high of the interval, and significant or not.

    One that doesn't hold keeps 0.6 of its score and goes down one priority. Where the bootstrap can't be run (too few rows), the finding stays as it is.
    """
    checked = F.col("__s").isNotNull()
    down = F.create_map(*(F.lit(x) for kv in LOWER.items() for x in kv))[F.col("priority")]
    fails = checked & ~F.col("__s")
    known = claim.where("valid > 0").agg(F.max("significant").alias("__s"), F.round(F.max("low"), 3).alias("ci_low"), F.round(F.max("high"), 3).alias("ci_high"))
    out = fact.crossJoin(F.broadcast(known))
    return out.select(
        *(c for c in fact.columns if c not in ("score", "priority", "significant")), F.when(fails, F.col("score") * 0.6).otherwise(F.col("score")).alias("score"), F.when(fails, down).otherwise(F.col("priority")).alias("priority"),
        F.when(checked, F.col("__s")).alias("significant"), "ci_low", "ci_high",
    )


def weak_points(df: DataFrame, date: str | None, metric: str, agg: str, dims: list[str], profit: str | None = None, n: int = 6, key: list[str] | None = None, one_sided: bool = False, whole_years: bool = False) -> DataFrame:
    """The n weak points of a table with the greatest scores: a decline, concentrations, weak segments, losing segments, high outliers and missing data.

    Each claim is checked by a Poisson bootstrap of the rows that it stands on, all claims in one pass (rows are told apart by `key`, see bootstrap.bootstrap); missing data is a fact about all rows
    and isn't checked. An interval that excludes the reference confirms a claim, whichever side it lies on; with `one_sided` only if it lies on the claim's. With `whole_years` a last year
    that has no December is left out of the decline.

    The columns needed are kept (persisted) for the passes over them, so that joins behind df run once for them and once for the missing data, and let go when the result is there: it has n rows at
    most and comes to the driver.
    """
    used = [*([date] if date else []), metric, *dims, *([profit] if profit else []), *(key or [])]
    kept = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(used))).persist()
    try:
        out = _weak_points(df, kept, date, metric, agg, dims, profit, n, key, one_sided, whole_years)
        return df.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        kept.unpersist()


def _weak_points(whole: DataFrame, df: DataFrame, date: str | None, metric: str, agg: str, dims: list[str], profit: str | None, n: int, key: list[str] | None, one_sided: bool, whole_years: bool) -> DataFrame:
    facts: list[DataFrame] = []
    claims: list[B.Claim] = []

    def add(fact: DataFrame, kind: str = "", **claim) -> None:
        """A finding and the claim that it is checked by, if any."""
        facts.append(fact.withColumn("__claim", F.lit(str(len(claims)) if kind else None).cast("string")))
        if kind:
            side = claim.pop("side") if one_sided else claim.pop("side") and None
            claims.append(B.Claim(str(len(claims)), kind, claim.pop("value", metric), side=side, **claim))

    add(missing_data(whole, list(whole.columns)).withColumn("significant", F.lit(None).cast("boolean")))
    if date:
        years = df
        if whole_years:
            end = df.agg(F.max(C.timestamp(df, date))).first()[0]
            years = df.where(F.year(C.timestamp(df, date)) < end.year) if end is not None and end.month < 12 else df
        fact = declining(years, date, metric, agg).where("significant")
        row = fact.first()
        if row:
            first, last = row["value_label"].split("-")
            add(fact, "change", group=F.year(C.timestamp(df, date)), level=last, other=first, reference=-5.0, side="below")
    for dim in dims:
        fact = concentration(df, dim, metric).where("significant")
        row = fact.first()
        if row:
            level = F.when(F.col("value") > 50, "high").when(F.col("value") > 2 * F.col("reference"), "medium").otherwise("low")
            add(fact.withColumn("priority", level), "share", group=dim, level=row["value_label"], reference=1.5 * row["reference"], side="above")
        fact = under_performing(df, dim, metric).where("significant")
        row = fact.first()
        if row:
            add(fact.withColumn("priority", F.when(F.col("score") > 35, "high").otherwise("medium")), "gap", group=dim, level=row["value_label"], side="below")
        if profit:
            losing = losing_segments(df, dim, metric, profit).where("significant")
            for row in losing.collect():  # two at most
                one = losing.where(F.col("value_label") == row["value_label"]).withColumn("priority", F.when(F.col("value") < -20, "high").otherwise("medium"))
                add(one, "mean", value=profit, where=F.col(dim).cast("string") == row["value_label"], side="below")
    high = high_outliers(df, metric).where("significant")
    if high.first():
        add(high.withColumn("priority", F.when(F.col("value") > 40, "high").otherwise("medium")))
    out = facts[0]
    for more in facts[1:]:
        out = out.unionByName(more)
    checks = B.bootstrap(df, claims, key).where("valid > 0").select(F.col("name").alias("__claim"), F.col("significant").alias("__s"), F.round("low", 3).alias("ci_low"), F.round("high", 3).alias("ci_high"))
    out = out.join(F.broadcast(checks), "__claim", "left")  # a row for each claim
    fails = F.coalesce(~F.col("__s"), F.lit(False))
    down = F.create_map(*(F.lit(x) for kv in LOWER.items() for x in kv))[F.col("priority")]
    kept = [c for c in facts[0].columns if c not in ("score", "priority", "significant", "__claim")]
    out = out.select(
        *kept, F.when(fails, F.col("score") * 0.6).otherwise(F.col("score")).alias("score"), F.when(fails, down).otherwise(F.col("priority")).alias("priority"),
        F.when(F.col("__claim").isNull(), F.col("significant")).otherwise(F.col("__s")).alias("significant"), "ci_low", "ci_high",
    )
    return out.orderBy(F.desc_nulls_last("score"), "kind", "subject", "value_label").limit(n)

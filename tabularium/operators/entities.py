"""Entities over time: cohorts, overdue customers, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.operators import common as C
from tabularium.operators.common import number


def _months(ts):
    return F.year(ts) * 12 + F.month(ts)


#: Months of a bitmap word, and words that an entity may have; beyond, months are gathered as a set.
WORD, WORDS = 64, 32


def _active_months(seen: DataFrame, first: int, last: int) -> DataFrame:
    """(e, ms): each entity's months in ascending order, from (e, m): bitmaps of months, merged before and after one shuffle by entity."""
    words = (last - first) // WORD + 1
    if words > WORDS:
        return seen.groupBy("e").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    at = F.col("m") - first
    bit = F.expr(f"shiftleft(1L, cast((m - {first}) % {WORD} as int))")
    maps = seen.groupBy("e").agg(*(F.bit_or(F.when(F.floor(at / WORD) == i, bit)).alias(f"w{i}") for i in range(words)))
    months = [F.expr(f"transform(filter(sequence(0, {WORD - 1}), i -> shiftrightunsigned(coalesce(w{i}, 0L), i) & 1L = 1L), i -> i + {first + WORD * i})") for i in range(words)]
    return maps.select("e", F.concat(*months).alias("ms"))


def cohorts(df: DataFrame, entity: str, date: str, least: int = 5, last: int = 12, span: int = 11) -> DataFrame:
    """(cohort, size, month_number, active, retention, observed): distinct entities by the month they were first seen in and the months since.

    Cohorts of `least` entities, at least two of them, the last `last`; months 0 to min(span, greatest seen); a month without activity counts 0, and
    observed says whether the data reach that far.
    """
    ts = C.timestamp(df, date)
    seen = df.where(F.col(entity).isNotNull() & ts.isNotNull()).select(F.col(entity).alias("e"), _months(ts).alias("m"))
    ends = seen.agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    active = _active_months(seen, ends["a"] or 0, ends["b"] or 0)
    first = active.select(F.element_at("ms", 1).alias("c"), F.explode("ms").alias("m"))
    cells = first.groupBy("c", (F.col("m") - F.col("c")).alias("k")).agg(F.count(F.lit(1)).alias("active"))
    sizes = cells.where("k = 0").select("c", F.col("active").alias("size")).where(F.col("size") >= least)
    ranked = sizes.select("c", "size", F.row_number().over(Window.orderBy(F.desc("c"))).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("cohorts")).where((F.col("r") <= last) & (F.col("cohorts") >= 2))
    most = cells.join(F.broadcast(ranked.select("c")), "c", "left_semi").agg(F.least(F.max("k"), F.lit(span)).alias("most"))
    end = cells.agg(F.max(F.col("c") + F.col("k")).alias("end"))
    grid = ranked.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(end)).select("c", "size", "end", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("k"))
    out = grid.join(cells, ["c", "k"], "left")
    label = F.format_string("%04d-%02d", F.floor((F.col("c") - 1) / 12).cast("int"), ((F.col("c") - 1) % 12 + 1).cast("int"))
    active = F.coalesce("active", F.lit(0))
    return out.select(label.alias("cohort"), "size", F.col("k").alias("month_number"), active.alias("active"), (active / F.col("size")).alias("retention"), (F.col("c") + F.col("k") <= F.col("end")).alias("observed"))


def retention_risk(df: DataFrame, entity: str, date: str, n: int = 20) -> DataFrame:
    """(entity, last_seen, days_since, typical_gap, ratio, level, flagged, entities): the n most overdue entities.

    The typical gap is the median of all whole-day gaps over 0 between an entity's visits (10 at least); overdue from 1.5 gaps since
    the last visit to the table's last day, high from 3.0 (rounded to two digits).
    """
    ts = C.timestamp(df, date)
    seen = df.where(F.col(entity).isNotNull() & ts.isNotNull()).select(F.col(entity).alias("entity"), ts.cast("timestamp_ntz").alias("t")).distinct()
    before = F.lag("t").over(Window.partitionBy("entity").orderBy("t"))
    gaps = seen.select(F.floor(F.timestamp_diff("SECOND", before, F.col("t")) / 86400).alias("gap")).where("gap > 0")
    typical = gaps.agg(F.percentile("gap", F.lit(0.5)).alias("typical_gap"), F.count(F.lit(1)).alias("g")).where("g >= 10")
    last = seen.groupBy("entity").agg(F.max("t").alias("last_seen"))
    table = last.agg(F.max("last_seen").alias("end"), F.count(F.lit(1)).alias("entities"))
    out = last.crossJoin(F.broadcast(table)).crossJoin(F.broadcast(typical)).withColumn("days_since", F.floor(F.timestamp_diff("SECOND", F.col("last_seen"), F.col("end")) / 86400))
    out = out.withColumn("ratio", F.col("days_since") / F.col("typical_gap")).where("ratio >= 1.5")
    flagged = out.agg(F.count(F.lit(1)).alias("flagged"))
    top = out.orderBy(F.desc("ratio"), "entity").limit(n).crossJoin(F.broadcast(flagged))
    return top.select("entity", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "days_since", "typical_gap", "ratio", F.when(F.round("ratio", 2) >= 3.0, "high").otherwise("medium").alias("level"), "flagged", "entities")


def customer_concentration(df: DataFrame, customer: str, revenue: str) -> DataFrame:
    """(customers, top_customers, share_pct, reported): the share of revenue of the top tenth of 10 or more customers; reported over 20 %.

    The least revenue of the top tenth is found by counted brackets, so no task holds or sorts the customers.
    """
    by = df.where(F.col(customer).isNotNull()).groupBy(F.col(customer).alias("c")).agg(F.coalesce(F.sum(number(revenue)), F.lit(0.0)).alias("r")).select("r").persist()
    try:
        row = by.agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("all")).first()
        n = row["n"]
        if n < 10:
            return df.sparkSession.createDataFrame([], "customers long, top_customers long, share_pct double, reported boolean")
        k = max(1, n // 10)
        least, above, _ = C.kth_largest(by, "r", k)
        most = by.agg(F.coalesce(F.sum(F.when(F.col("r") > least, F.col("r"))), F.lit(0.0))).first()[0] + (k - above) * least  # of equal ones, as many as there is room for
    finally:
        by.unpersist()
    share = most * 100 / row["all"] if row["all"] else None
    return df.sparkSession.createDataFrame([(n, k, share, None if share is None else share > 20)], "customers long, top_customers long, share_pct double, reported boolean")

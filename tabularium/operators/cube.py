"""A cube of mergeable states: one pass over a table, then any filter on its dimensions and months is answered from cells.

A cell is a month and a level of each dimension; it holds the number of rows, and for each measure how many values there are, their sum, mean, squared deviations, least and greatest. States of
cells merge exactly, so answers are those of a new scan of the filtered rows. There are at most months x product of the dimensions' levels cells, whatever the number of rows: pick dimensions of few levels
(`plans.report.plan` says which), and write the cube (`sources.write_table`) to use it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.operators import common as C
from tabularium.operators.common import number

STATES = ("n", "sum", "mean", "m2", "min", "max")


def build(df: DataFrame, date: str, dims: list[str], measures: list[str]) -> DataFrame:
    """(month, dimensions as text, rows, <measure>__n, __sum, __mean, __m2, __min, __max): a row for each cell that has rows. Null months and levels are cells of their own."""
    keys = [C.month(C.timestamp(df, date)).alias("month"), *(F.col(f"`{d}`").cast("string").alias(d) for d in dims)]
    values = df.select(*keys, *(number(F.col(f"`{m}`")).alias(f"__v{i}") for i, m in enumerate(measures)))
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, m in enumerate(measures):
        v = F.col(f"__v{i}")
        aggs += [F.count(v).alias(f"{m}__n"), F.sum(v).alias(f"{m}__sum"), F.avg(v).alias(f"{m}__mean"), (F.var_pop(v) * F.count(v)).alias(f"{m}__m2"), F.min(v).alias(f"{m}__min"), F.max(v).alias(f"{m}__max")]
    return values.groupBy("month", *(F.col(f"`{d}`") for d in dims)).agg(*aggs)


def measures_of(cube: DataFrame) -> list[str]:
    return [c.removesuffix("__m2") for c in cube.columns if c.endswith("__m2")]


def dimensions_of(cube: DataFrame) -> list[str]:
    states = {f"{m}__{s}" for m in measures_of(cube) for s in STATES}
    return [c for c in cube.columns if c not in states and c not in ("month", "rows")]


def pick(cube: DataFrame, levels: dict[str, list[str]] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The cells of some levels of dimensions, from one month (yyyy-MM) to another; what isn't named isn't filtered. A cube, too."""
    for d, some in (levels or {}).items():
        if d not in dimensions_of(cube):
            raise ValueError(f"the cube has no dimension {d}")
        cube = cube.where(F.col(f"`{d}`").isin([str(x) for x in some]))
    if first is not None:
        cube = cube.where(F.col("month") >= first)
    return cube if last is None else cube.where(F.col("month") <= last)


def _value(measure: str | None, how: str) -> Column:
    """count of rows, or sum (0 without values) or avg of a measure, of the cells of a group."""
    if how == "count" or measure is None:
        return F.coalesce(F.sum("rows"), F.lit(0)).cast("double")
    total = F.sum(f"`{measure}__sum`")
    return F.coalesce(total, F.lit(0.0)) if how == "sum" else F.try_divide(total, F.sum(f"`{measure}__n`"))


def trend(cube: DataFrame, measure: str, how: str = "sum") -> DataFrame:
    """(month, value), months without a date left out."""
    return cube.where("month is not null").groupBy("month").agg(_value(measure, how).alias("value"))


def breakdown(cube: DataFrame, dim: str, measure: str, how: str = "sum") -> DataFrame:
    """(label, rows, value, share_pct): a dimension's levels; the share is that of all rows with a level."""
    by = cube.where(F.col(f"`{dim}`").isNotNull()).groupBy(F.col(f"`{dim}`").alias("label")).agg(F.sum("rows").alias("rows"), _value(measure, how).alias("value"))
    return by.withColumn("share_pct", F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()))  # a row for each level


def summary(cube: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """(measure, n, total, mean, sd, min, max): sd is that of the sample, from the cells' squared deviations and the distances of their means."""
    out = None
    for m in measures or measures_of(cube):
        c = cube.where(F.col(f"`{m}__n`") > 0).select(*(F.col(f"`{m}__{s}`").alias(s) for s in STATES))
        whole = c.agg(F.sum("n").alias("all"), (F.sum("sum") / F.sum("n")).alias("mid"))
        spread = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("mid")) * (F.col("mean") - F.col("mid")))
        row = c.crossJoin(F.broadcast(whole)).agg(
            F.lit(m).alias("measure"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("sum").alias("total"), F.max("mid").alias("mean"), F.sqrt(F.try_divide(spread, F.max("all") - 1)).alias("sd"), F.min("min").alias("min"), F.max("max").alias("max")
        )
        out = row if out is None else out.unionByName(row)
    return out


def drivers(cube: DataFrame, measure: str, dims: list[str] | None = None) -> DataFrame:
    """(dimension, segment, before_value, after_value, change): what each level added to the change of a sum between the last two months that the cells have."""
    dims = dims or dimensions_of(cube)
    months = cube.where("month is not null").groupBy().agg(F.slice(F.reverse(F.array_sort(F.collect_set("month"))), 1, 2).alias("last")).where(F.size("last") == 2)  # as many as there are months
    near = cube.crossJoin(F.broadcast(months)).where(F.array_contains("last", F.col("month")))
    levels = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"`{d}`").alias("segment")) for d in dims))).alias("l")
    long = near.select(levels, F.col(f"`{measure}__sum`").alias("v"), (F.col("month") == F.col("last")[0]).alias("now")).where("l.segment is not null")
    side = lambda now: F.coalesce(F.sum(F.when(F.col("now") == now, F.col("v"))), F.lit(0.0))
    out = long.groupBy("l.dimension", "l.segment").agg(side(False).alias("before_value"), side(True).alias("after_value"))
    return out.withColumn("change", F.col("after_value") - F.col("before_value"))

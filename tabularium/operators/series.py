"""Monthly series: comparison, seasons, forecast, breaks, and what drove a change.

A series is (keys..., month, value) with one row for each month that has data; gaps stay out and regressions use the row's number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.functions import stats as S
from tabularium.operators import common as C
from tabularium.operators.common import agg_of, number

SEASON_MONTHS, FORECAST_MONTHS, BREAK_MONTHS = 36, 6, 8
DRAWS = 1000


def _by(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def indexed(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds i (0, 1, ...) and n (months of the series)."""
    return series.withColumns({"i": F.row_number().over(_by(keys).orderBy("month")) - 1, "n": F.count(F.lit(1)).over(_by(keys))})


def period_comparison(df: DataFrame, date: str, metric: str, agg: str = "sum", skip_last: bool = False) -> DataFrame:
    """(month, previous_month, value, previous_value, change_pct, t, df, p_value, significant) of the last month present and the one before; 5 rows each.

    skip_last leaves out a last month that is not complete. Welch's test is on the rows' values.
    """
    rows = df.select(C.month(C.timestamp(df, date)).alias("month"), number(metric).alias("v")).where("month is not null and v is not null")
    by = rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), agg_of("v", agg).alias("value"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    ranked = by.withColumn("k", F.row_number().over(Window.orderBy(F.desc("month"))) - (1 if skip_last else 0)).where("k between 1 and 2")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    both = ranked.agg(*(at(c, k) for c in ("month", "n", "value", "mean", "var") for k in (1, 2))).where("n1 >= 5 and n2 >= 5")
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    out = both.withColumns({"t": F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b)), "df": F.try_divide(F.pow(a + b, F.lit(2.0)), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))})
    out = out.withColumn("p_value", S.t_p(F.col("t"), F.col("df")))
    return out.select(F.col("month1").alias("month"), F.col("month2").alias("previous_month"), F.col("value1").alias("value"), F.col("value2").alias("previous_value"), F.try_divide((F.col("value1") - F.col("value2")) * 100, F.nullif(F.abs("value2"), F.lit(0.0))).alias("change_pct"), "t", "df", "p_value", (F.col("p_value") < 0.05).alias("significant"))


def seasonality(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The series with n, trend, season (offset of its calendar month), residual, f, p_value, seasonal, season_strength, trend_strength, peak_month and trough_month.

    36 months at least. Trend: centred 2 x 12 moving average. Offsets: means of the detrended values by calendar month (two each), centred to zero. A
    one-way analysis of variance of the detrended values over calendar months decides (p < 0.05).
    """
    keys = keys or []
    w = _by(keys)
    x = indexed(series, keys).where(F.col("n") >= SEASON_MONTHS)
    order = w.orderBy("month")
    halves = (F.avg("value").over(order.rowsBetween(-6, 5)) + F.avg("value").over(order.rowsBetween(-5, 6))) / 2
    x = x.withColumn("trend", F.when((F.col("i") >= 6) & (F.col("i") < F.col("n") - 6), halves)).withColumn("moy", F.substring("month", 6, 2).cast("int"))
    x = x.withColumn("detrended", F.col("value") - F.col("trend"))
    by = x.where("detrended is not null").groupBy(*keys, "moy").agg(F.count(F.lit(1)).alias("k"), F.avg("detrended").alias("m"), (F.var_pop("detrended") * F.count(F.lit(1))).alias("within")).where("k >= 2")
    grand = F.sum(F.col("m") * F.col("k")).over(w) / F.sum("k").over(w)
    by = by.withColumns({"groups": F.count(F.lit(1)).over(w), "all": F.sum("k").over(w), "grand": grand, "centre": F.avg("m").over(w), "ss_within": F.sum("within").over(w)})
    by = by.withColumn("ss_between", F.sum(F.col("k") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))).over(w))
    by = by.withColumn("f", F.try_divide(F.col("ss_between") / F.nullif(F.col("groups") - 1, F.lit(0)), F.col("ss_within") / F.nullif(F.col("all") - F.col("groups"), F.lit(0))))
    by = by.withColumn("season", F.col("m") - F.col("centre")).withColumn("p_value", S.f_p(F.col("f"), F.col("groups") - 1, F.col("all") - F.col("groups")))
    by = by.withColumns({"peak_month": F.max(F.struct("season", "moy")).over(w)["moy"], "trough_month": F.min(F.struct("season", "moy")).over(w)["moy"]})
    out = x.join(by.select(*keys, "moy", "season", "f", "p_value", "peak_month", "trough_month"), [*keys, "moy"], "left")
    out = out.withColumn("residual", F.col("detrended") - F.col("season"))
    strength = lambda part: F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop("residual").over(w), F.var_pop(F.when(F.col("residual").isNotNull(), F.col("residual") + F.col(part))).over(w)))
    return out.withColumns({"season_strength": strength("season"), "trend_strength": strength("trend"), "seasonal": F.col("p_value") < 0.05}).select(*keys, "month", "value", "n", "trend", "season", "residual", "f", "p_value", "seasonal", "season_strength", "trend_strength", "peak_month", "trough_month")


def _line(x: DataFrame, keys: list[str], y: str, where: Column | None = None) -> DataFrame:
    """Slope, intercept and r2 of y over i for each series, as window columns."""
    w = _by(keys)
    yy = F.when(where, F.col(y)) if where is not None else F.col(y)
    ii = F.when(where, F.col("i").cast("double")) if where is not None else F.col("i").cast("double")
    cov, var = F.covar_pop(ii, yy).over(w), F.var_pop(ii).over(w)
    x = x.withColumns({"slope": F.try_divide(cov, var), "r2": F.coalesce(F.try_divide(cov * cov, F.nullif(var * F.var_pop(yy).over(w), F.lit(0.0))), F.lit(0.0)), "mi": F.avg(ii).over(w), "my": F.avg(yy).over(w)})
    return x.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mi")).drop("mi", "my")


def forecast(series: DataFrame, keys: list[str] | None = None, periods: int = 3, seasonal: DataFrame | None = None, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(keys, month, value, low, high, slope, intercept, r_squared, months, partial_dropped): the next months of a linear trend with R2 of 0.3 or more.

    Six months at least. The last month is dropped as partial if it is under 25 % of the line through the others and under their minimum
    (seven months at least). seasonal: a result of `seasonality` whose offsets are taken out before and put back after. The 95 % band
    resamples residuals, one task for each series; no band if they are all zero.
    """
    keys = keys or []
    x = indexed(series, keys).where(F.col("n") >= FORECAST_MONTHS)
    if seasonal is not None:
        off = seasonal.where("seasonal and season is not null").select(*keys, F.substring("month", 6, 2).alias("moy"), "season").distinct()
        x = x.withColumn("moy", F.substring("month", 6, 2)).join(off, [*keys, "moy"], "left").withColumn("season", F.coalesce("season", F.lit(0.0)))
    else:
        x = x.withColumn("season", F.lit(0.0))
    x = x.withColumn("y", F.col("value") - F.col("season"))
    w = _by(keys)
    not_last = F.col("i") < F.col("n") - 1
    x = _line(x, keys, "y", not_last)
    guess = F.col("intercept") + F.col("slope") * F.col("i")
    low_last = (~not_last) & (F.col("n") >= 7) & (F.col("y") < 0.25 * guess) & (F.col("y") < F.min(F.when(not_last, F.col("y"))).over(w))
    x = x.withColumn("partial_dropped", F.max(low_last).over(w)).where(not_last | ~F.col("partial_dropped")).drop("slope", "intercept", "r2")
    x = x.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= FORECAST_MONTHS)
    x = _line(x, keys, "y").where("r2 >= 0.3")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys), "step int", "low double", "high double"])

    def band(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        y, i, n = pdf["y"].to_numpy(), np.arange(len(pdf), dtype=float), len(pdf)
        fit = pdf["intercept"].iloc[0] + pdf["slope"].iloc[0] * i
        res = y - fit
        steps = np.arange(n, n + periods)
        if np.allclose(res, 0):
            low = high = np.full(periods, np.nan)
        else:
            rng = np.random.default_rng(seed)
            ys = fit + rng.choice(res, (draws, n))
            ci = i - i.mean()
            slope = (ys * ci).sum(axis=1) / (ci * ci).sum()
            base = ys.mean(axis=1) - slope * i.mean()
            sims = base[:, None] + slope[:, None] * steps + rng.choice(res, (draws, periods))
            low, high = np.percentile(sims, [2.5, 97.5], axis=0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * periods for k in keys}, "step": np.arange(1, periods + 1), "low": low, "high": high})

    bands = (x if keys else x.withColumn("__all", F.lit(0))).groupBy(*(keys or ["__all"])).applyInPandas(band, schema)
    last = x.groupBy(*keys).agg(F.max("month").alias("last"), F.max("n").alias("months"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.first("r2").alias("r_squared"), F.first("partial_dropped").alias("partial_dropped"), F.max_by("value", "i").alias("last_value"))
    ahead = last.crossJoin(series.sparkSession.range(1, periods + 1).select(F.col("id").cast("int").alias("step")))
    ahead = ahead.withColumn("month", F.date_format(F.add_months(F.to_date(F.concat("last", F.lit("-01"))), F.col("step") + F.when(F.col("partial_dropped"), 1).otherwise(0)), "yyyy-MM"))
    if seasonal is not None:
        ahead = ahead.withColumn("moy", F.substring("month", 6, 2)).join(off, [*keys, "moy"], "left").withColumn("season", F.coalesce("season", F.lit(0.0)))
    else:
        ahead = ahead.withColumn("season", F.lit(0.0))
    out = ahead.join(bands, [*keys, "step"])
    return out.select(*keys, "month", (F.col("intercept") + F.col("slope") * (F.col("months") + F.col("step") - 1) + F.col("season")).alias("value"), F.nanvl(F.col("low") + F.col("season"), F.lit(None).cast("double")).alias("low"), F.nanvl(F.col("high") + F.col("season"), F.lit(None).cast("double")).alias("high"), "slope", "intercept", "r_squared", "months", "partial_dropped", "last_value")


def segment_series(df: DataFrame, dim: str, date: str, metric: str, agg: str = "sum", n: int = 4) -> DataFrame:
    """(dim, month, value) of the n segments with the greatest sums that have 20 rows and 6 months."""
    rows = df.select(F.col(dim).cast("string").alias(dim), C.month(C.timestamp(df, date)).alias("month"), number(metric).alias("v")).where(f"`{dim}` is not null and month is not null and v is not null")
    top = rows.groupBy(dim).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("rows"), F.count_distinct("month").alias("months")).orderBy(F.desc("s"), dim).limit(n).where("rows >= 20 and months >= 6").select(dim)
    return rows.join(F.broadcast(top), dim, "left_semi").groupBy(dim, "month").agg(agg_of("v", agg).alias("value"))


def segment_forecast(df: DataFrame, dim: str, date: str, metric: str, agg: str = "sum", n: int = 4) -> DataFrame:
    """The forecasts of the n greatest segments with projected_change_pct, the last projected month against the last actual one, greatest change first. Weak fits are left out."""
    series = segment_series(df, dim, date, metric, agg, n)
    out = forecast(series, [dim], seasonal=seasonality(series, [dim]))
    end = F.max_by("value", "month").over(Window.partitionBy(dim))
    return out.withColumn("projected_change_pct", F.try_divide((end - F.col("last_value")) * 100, F.nullif(F.abs("last_value"), F.lit(0.0)))).orderBy(F.desc(F.abs("projected_change_pct")), dim, "month")


def split_scores(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, month, i, gap, score): for each split with 4 months on either side, the step from the left line's value at its last month to the right
    line's at its first, over its standard error: the root of both sides' residual variances (over n - 1) by their months.
    """
    keys = keys or []
    x = indexed(series, keys).where(F.col("n") >= BREAK_MONTHS).withColumn("x", F.col("i").cast("double"))
    order = _by(keys).orderBy("month")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)

    def fit(w):
        cov, var = F.covar_pop("x", "value").over(w), F.var_pop("x").over(w)
        slope = cov / var
        return slope, F.avg("value").over(w) - slope * F.avg("x").over(w), (F.var_pop("value").over(w) - slope * cov) * F.count(F.lit(1)).over(w)

    ok = (F.col("i") >= 4) & (F.col("n") - F.col("i") >= 4)
    (s1, b1, e1), (s2, b2, e2) = fit(before), fit(after)
    left, right = F.col("x"), F.col("n") - F.col("x")
    spread = F.greatest(e1, F.lit(0.0)) / (left - 1) / left + F.greatest(e2, F.lit(0.0)) / (right - 1) / right
    x = x.withColumns({"gap": F.when(ok, (b2 + s2 * left) - (b1 + s1 * (left - 1))), "spread": F.when(ok, spread), "before_mean": F.avg("value").over(before), "after_mean": F.avg("value").over(after)})
    return x.where(ok).select(*keys, "month", "i", "n", "gap", F.try_divide(F.abs("gap"), F.nullif(F.sqrt("spread"), F.lit(0.0))).alias("score"), "before_mean", "after_mean")


def _all_scores(y: np.ndarray) -> np.ndarray:
    """The best split score of each row of a 2-D array of series, by running sums."""
    m, n = y.shape
    x = np.arange(n, dtype=float)
    run = lambda v: np.concatenate([np.zeros((m, 1)), np.cumsum(v, axis=1)], axis=1)
    sy, syy, sxy = run(y), run(y * y), run(y * x)
    sx, sxx = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    i = np.arange(4, n - 3)

    def part(a, b):
        k = b - a
        mx, my = (sx[b] - sx[a]) / k, (sy[:, b] - sy[:, a]) / k
        var, cov = (sxx[b] - sxx[a]) / k - mx**2, (sxy[:, b] - sxy[:, a]) / k - mx * my
        slope = cov / var
        return slope, my - slope * mx, ((syy[:, b] - syy[:, a]) / k - my**2 - slope * cov) * k

    (s1, b1, e1), (s2, b2, e2) = part(np.zeros_like(i), i), part(i, np.full_like(i, n))
    gap = np.abs((b2 + s2 * i) - (b1 + s1 * (i - 1)))
    dev = np.sqrt(np.maximum(e1, 0) / (i - 1) / i + np.maximum(e2, 0) / (n - i - 1) / (n - i))
    return np.where(dev > 0, gap / np.where(dev > 0, dev, 1), 0).max(axis=1)


def changepoint(series: DataFrame, keys: list[str] | None = None, seasonal: DataFrame | None = None, shuffles: int = DRAWS, seed: int = 0) -> DataFrame:
    """(keys, month, score, before_mean, after_mean, shift_pct, p_value, is_break): the best split of each series.

    p: the share of shuffled series (one task for each series) whose best score is no smaller. A break has p < 0.05 and a mean shift of 15 %. Offsets of
    `seasonal` are taken out where they cover all months of a series.
    """
    keys = keys or []
    if seasonal is not None:
        off = seasonal.where("seasonal and season is not null").select(*keys, F.substring("month", 6, 2).alias("moy"), "season").distinct()
        j = series.withColumn("moy", F.substring("month", 6, 2)).join(off, [*keys, "moy"], "left")
        series = j.withColumn("value", F.when(F.bool_and(F.col("season").isNotNull()).over(_by(keys)), F.col("value") - F.col("season")).otherwise(F.col("value"))).drop("moy", "season")
    best = split_scores(series, keys).withColumn("k", F.row_number().over(_by(keys).orderBy(F.desc_nulls_last("score"), "month"))).where("k = 1")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in keys), "p_value double"])

    def p_value(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("month")["value"].to_numpy(float)
        rng = np.random.default_rng(seed)
        real = _all_scores(y[None])[0]
        shuffled = _all_scores(rng.permuted(np.repeat(y[None], shuffles, axis=0), axis=1))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "p_value": [(1 + (shuffled >= real - 1e-12).sum()) / (shuffles + 1)]})

    long = indexed(series, keys).where(F.col("n") >= BREAK_MONTHS)
    ps = (long if keys else long.withColumn("__all", F.lit(0))).groupBy(*(keys or ["__all"])).applyInPandas(p_value, schema)
    out = best.join(ps, keys) if keys else best.crossJoin(ps)
    shift = F.try_divide((F.col("after_mean") - F.col("before_mean")) * 100, F.nullif(F.abs("before_mean"), F.lit(0.0)))
    return out.select(*keys, "month", "score", "before_mean", "after_mean", shift.alias("shift_pct"), "p_value", ((F.col("p_value") < 0.05) & (F.abs(shift) >= 15)).alias("is_break"))


def drivers(df: DataFrame, date: str, metric: str, agg: str, dims: list[str], before: list[str], after: list[str], top: int = 6, keep: int = 6, least: int = 5) -> DataFrame:
    """Which segments drove the change of a metric between two sets of months.

    (dimension, segment, before_value, after_value, change, net_share, gross_share, offsetting, concentration, dimension_rank). Sum: the mean
    monthly total; avg: the mean of monthly means, to which a segment adds sum / n of the month, so changes add up. The `top` segments by |change| and
    Other; null is (blank). offsetting: |net| under 20 % of the gross movement. concentration: the top movement's share of the gross less 100 / segments;
    dimensions are ranked by it and `keep` of them stay. No rows if either side has fewer than `least`.
    """
    m = C.month(C.timestamp(df, date))
    df = between_months(df, date, min([*before, *after], default=None), max([*before, *after], default=None))
    rows = df.select(m.alias("month"), number(metric).alias("v"), *(F.coalesce(F.col(d).cast("string"), F.lit("(blank)")).alias(d) for d in dims)).where(F.col("v").isNotNull() & F.col("month").isin([*before, *after]))
    rows = rows.withColumn("after", F.col("month").isin(after))
    long = rows.select("month", "after", "v", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("segment")) for d in dims))).alias("d"))
    cells = long.groupBy("d.dimension", "d.segment", "month", "after").agg(F.sum("v").alias("s"))
    month_n = rows.groupBy("month", "after").agg(F.count(F.lit(1)).alias("n"))
    side = month_n.groupBy("after").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("months"))
    cells = cells.join(F.broadcast(month_n.select("month", "n")), "month").join(F.broadcast(side), "after").where(F.col("rows") >= least)
    part = F.col("s") / F.col("months") if agg == "sum" else F.col("s") / F.col("n") / F.col("months")
    seg = cells.groupBy("dimension", "segment").agg(F.sum(F.when(~F.col("after"), part).otherwise(0.0)).alias("before_value"), F.sum(F.when(F.col("after"), part).otherwise(0.0)).alias("after_value"))
    both = side.agg(F.count_if(F.col("rows") >= least).alias("sides")).where("sides = 2")
    seg = seg.crossJoin(F.broadcast(both)).drop("sides").withColumn("change", F.col("after_value") - F.col("before_value"))
    w = Window.partitionBy("dimension")
    seg = seg.withColumns({"net": F.sum("change").over(w), "gross": F.sum(F.abs("change")).over(w), "k": F.count(F.lit(1)).over(w), "most": F.max(F.abs("change")).over(w), "rank": F.row_number().over(w.orderBy(F.desc(F.abs("change")), "segment"))})
    seg = seg.withColumn("concentration", F.try_divide(F.col("most") * 100, "gross") - 100.0 / F.col("k"))
    named = seg.withColumn("segment", F.when(F.col("rank") <= top, F.col("segment")).otherwise("Other")).groupBy("dimension", "segment", "net", "gross", "concentration").agg(*(F.sum(c).alias(c) for c in ("before_value", "after_value", "change")))
    dims_ranked = named.groupBy("dimension").agg(F.max("concentration").alias("c")).withColumn("dimension_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("c"), "dimension"))).where(F.col("dimension_rank") <= keep).drop("c")
    out = named.join(F.broadcast(dims_ranked), "dimension")
    return out.select("dimension", "segment", "before_value", "after_value", "change", F.try_divide(F.col("change") * 100, F.nullif("net", F.lit(0.0))).alias("net_share"), F.try_divide(F.abs("change") * 100, F.nullif("gross", F.lit(0.0))).alias("gross_share"), (F.abs("net") < 0.2 * F.col("gross")).alias("offsetting"), "concentration", "dimension_rank")


def drill(df: DataFrame, date: str, metric: str, agg: str, dims: list[str], before: list[str], after: list[str]) -> DataFrame:
    """`drivers` once more inside the top segment of the first-ranked dimension, if that holds 50 to 100 % of the gross movement."""
    found = drivers(df, date, metric, agg, dims, before, after)
    first = found.where("dimension_rank = 1 and segment <> 'Other'").orderBy(F.desc("gross_share"), "segment").first()
    rest = [d for d in dims if first is None or d != first["dimension"]]
    if first is None or not rest or not 50 <= (first["gross_share"] or 0) < 100:
        return found.limit(0)
    inside = df.where(F.coalesce(F.col(first["dimension"]).cast("string"), F.lit("(blank)")) == first["segment"])
    return drivers(inside, date, metric, agg, rest, before, after)


def between_months(df: DataFrame, date: str, first: str | None, last: str | None) -> DataFrame:
    """Rows from the first day of one month to the last of another; on a typed date column the scan prunes them."""
    if first is None or last is None:
        return df.limit(0)
    t = C.timestamp(df, date)
    year, month = map(int, last.split("-"))
    kind = df.schema[date].dataType.simpleString()
    at = lambda text: F.lit(text).cast(kind if kind in ("date", "timestamp", "timestamp_ntz") else "timestamp")
    return df.where((t >= at(f"{first}-01")) & (t < at(f"{year + month // 12:04d}-{month % 12 + 1:02d}-01")))


def last_two_months(df: DataFrame, date: str) -> tuple[list[str], list[str]]:
    """([previous], [last]) of the months present: two greatest dates, no grouping of the table."""
    t = C.timestamp(df, date)
    last = df.agg(F.max(t).alias("t")).select(C.month("t"), F.trunc(F.col("t").cast("date"), "month")).first()
    if last[0] is None:
        return [], []
    before = df.where(t < F.lit(last[1]).cast(df.select(t.alias("t")).schema["t"].dataType)).agg(F.max(t).alias("t")).select(C.month("t")).first()[0]
    return [before] if before else [], [last[0]]

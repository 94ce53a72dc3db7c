"""Rules that all operators share: missing values, numbers, months, order of ties."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd MMM yyyy")


def number(col: str | Column) -> Column:
    """A double; text that is no number, and NaN, are null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def typed(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """(the columns as doubles, where each is): projected once, as an aggregate that holds a conversion several times makes code too large to be compiled."""
    names = {c: f"v{i}" for i, c in enumerate(dict.fromkeys(cols))}
    return df.select(*(number(F.col(f"`{c}`")).alias(v) for c, v in names.items())), {c: F.col(v) for c, v in names.items()}


def by_pair(df: DataFrame, pairs: list[tuple[str, str]], of: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """(i, aggregates of x and y) on rows complete for the i-th pair of columns; a pair without such rows has no row.

    One unpivoted grouping by the pair's number, combined before the shuffle: one small aggregate, compiled, however many pairs.
    """
    rows, v = typed(df, [c for p in pairs for c in p])
    cells = F.array(*(F.struct(F.lit(i).alias("i"), v[a].alias("x"), v[b].alias("y")) for i, (a, b) in enumerate(pairs)))
    long = rows.select(F.explode(cells).alias("c")).select("c.*").where("x is not null and y is not null")
    return long.groupBy("i").agg(*of(F.col("x"), F.col("y")))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in double and float columns becomes null: one kind of missing value."""
    return df.withColumns({f.name: F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def timestamp(df: DataFrame, col: str) -> Column:
    """A timestamp from a date, timestamp or text column; text in none of DATE_FORMATS is null."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        return F.col(col)
    return parsed(F.col(col))


def parsed(text: Column) -> Column:
    """A timestamp from text in one of DATE_FORMATS, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))


def month(col: str | Column) -> Column:
    """The month as yyyy-MM."""
    return F.date_format(col, "yyyy-MM")


def agg_of(col: str | Column, how: str) -> Column:
    """sum (0 if all are null), avg or count."""
    if how == "count":
        return F.count(F.lit(1))
    return F.coalesce(F.sum(col), F.lit(0.0)) if how == "sum" else F.avg(col)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def rows_from(row: DataFrame, columns: dict[str, dict[str, str]], key: str = "column") -> DataFrame:
    """Turns one wide row of aggregates into a row for each column: columns[name] = {output: wide column}."""
    structs = [F.struct(F.lit(name).alias(key), *(F.col(f"`{wide}`").alias(out) for out, wide in parts.items())) for name, parts in columns.items()]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


#: Values around a quantile that may come to the driver; the size of the KLL sketches that close in on it, and thrice the error of ranks that they state.
CLOSE, SKETCH, SLACK = 200_000, 8_192, 0.002
#: Values that an estimate of edges in a selection keeps.
ACCURACY = 10_000


def _sketched(v: Column, shares: list[float]) -> tuple[Column, Callable[[Column], Column]]:
    """A mergeable sketch of a column, and what tells its values at some shares of the ranks (null without values)."""
    at = F.array(*(F.lit(min(1.0, max(0.0, s))) for s in shares))
    return F.kll_sketch_agg_double(v, F.lit(SKETCH)), lambda s: F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, at))


def _values_at(rows: DataFrame, wanted: dict[str, tuple[Column, list[float]]], extra: list[Column]) -> Row:
    """Estimated values {name: (column, shares)} of all columns, and further aggregates, by one scan."""
    made = {name: _sketched(v, shares) for name, (v, shares) in wanted.items()}
    row = rows.agg(*extra, *(sketch.alias(name) for name, (sketch, _) in made.items()))
    return row.select("*", *(read(F.col(name)).alias(f"{name}_at") for name, (_, read) in made.items())).drop(*made).first()


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, tuple[int, list[float]]]:
    """{column: (n, its linear quantiles)} of the columns with numbers, exactly, whatever the number of different values.

    KLL sketches of all columns, merged from the partitions' in one scan, bracket each quantile; the brackets are counted, and narrowed by sketches of what they hold where that is over CLOSE
    rows; then their different values with counts, which are few, tell the ranks sought. Every pass serves all columns, with partial aggregates of fixed size. A sketch that missed its rank
    costs a pass, never a right result.
    """
    v = [number(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(cols)]
    rows = df.select(*v)
    wide = [p for q in probs for p in (q - SLACK, q + SLACK)]
    sketched = _values_at(rows, {f"q{i}": (F.col(f"v{i}"), wide) for i in range(len(cols))}, [F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))])
    first = {**{f"n{i}": sketched[f"n{i}"] for i in range(len(cols))}, **{f"q{i}": sketched[f"q{i}_at"] for i in range(len(cols))}}
    sought = [[i, int((first[f"n{i}"] - 1) * q), first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1]] for i in range(len(cols)) if first[f"n{i}"] for j, q in enumerate(probs)]
    found: dict[int, list[float]] = {}
    for _ in range(64):
        if not sought:
            break
        inside = [F.col(f"v{i}").between(a, b) for i, _, a, b in sought]
        row = rows.agg(*(F.count_if(F.col(f"v{i}") < a).alias(f"l{t}") for t, (i, _, a, _) in enumerate(sought)), *(F.count_if(x).alias(f"m{t}") for t, x in enumerate(inside))).first()
        # of a bracket that an estimate missed, the side towards the rank is open
        for t, x in enumerate(sought):
            below, n = row[f"l{t}"], row[f"m{t}"]
            if x[1] < below:
                x[2] = float("-inf")
            elif min(x[1] + 1, first[f"n{x[0]}"] - 1) >= below + n:
                x[3] = float("inf")
        missed = any(x[1] < row[f"l{t}"] or min(x[1] + 1, first[f"n{x[0]}"] - 1) >= row[f"l{t}"] + row[f"m{t}"] for t, x in enumerate(sought))
        large = [t for t, x in enumerate(sought) if row[f"m{t}"] > CLOSE and x[2] < x[3]]
        if missed:
            continue
        if large:
            near = lambda t: [(sought[t][1] + d - row[f"l{t}"]) / row[f"m{t}"] + e for d, e in ((0, -SLACK), (1, SLACK))]
            closer = _values_at(rows, {f"q{t}": (F.when(inside[t], F.col(f"v{sought[t][0]}")), near(t)) for t in large}, [])
            before = [tuple(x) for x in sought]
            for t in large:
                sought[t][2:] = closer[f"q{t}_at"]
            if [tuple(x) for x in sought] != before:
                continue
        parts = F.array(*(F.struct(F.lit(t).alias("t"), F.when(x, F.col(f"v{sought[t][0]}")).alias("v")) for t, x in enumerate(inside)))
        near = rows.where(reduce(or_, inside)).select(F.explode(parts).alias("s")).where("s.v is not null").groupBy("s.t", "s.v").agg(F.count(F.lit(1)).alias("k")).collect()
        for t, (i, rank, _, _) in enumerate(sought):
            values, at, pair = sorted((r["v"], r["k"]) for r in near if r["t"] == t), row[f"l{t}"], []
            for want in (rank, min(rank + 1, first[f"n{i}"] - 1)):
                upto = at
                for value, k in values:
                    upto += k
                    if want < upto:
                        pair.append(value)
                        break
            found.setdefault(i, []).append(pair)
        break
    out = {}
    for i, pairs in found.items():
        n = first[f"n{i}"]
        part = [(n - 1) * q - int((n - 1) * q) for q in probs]
        out[cols[i]] = (n, [a if a == b else a + (b - a) * f for (a, b), f in zip(pairs, part, strict=True)])
    return out


#: Edges that a round of a selection counts at.
EDGES = 32


def kth_largest(rows: DataFrame, value: str, k: int) -> tuple[float, int, int]:
    """(the k-th largest value, how many are greater, how many are equal) of a column of doubles without null or NaN, of k rows at least.

    Each round estimates edges inside the bracket that holds the rank (values that occur), counts above and at them, and goes on between two of them: no rows come together, and the bracket
    shrinks to about a thirtieth each time.
    """
    v = F.col(value) + F.lit(0.0)  # -0.0 is 0.0
    low, high = float("-inf"), float("inf")  # both excluded, but for infinite values
    inside = F.lit(True)
    while True:
        steps = [i / (EDGES - 1) for i in range(EDGES)]
        edges = sorted(set(rows.agg(F.percentile_approx(F.when(inside, v), steps, ACCURACY)).first()[0]))
        row = rows.agg(*(F.count_if(v > e).alias(f"a{i}") for i, e in enumerate(edges)), *(F.count_if(v == e).alias(f"e{i}") for i, e in enumerate(edges))).first()
        for i, e in enumerate(edges):
            above, equal = row[f"a{i}"], row[f"e{i}"]
            if above < k <= above + equal:
                return e + 0.0, above, equal
            if above >= k:
                low = e
            elif above + equal < k:
                high = e
                break
        inside = (v > low) & (v < high)


def few_distinct(df: DataFrame, cols: list[str], most: int) -> tuple[int, dict[str, int]]:
    """(rows, {column: different values}) of the columns with about `most` values or fewer: estimated first, and only those with at most twice as many are counted, so that
    no task sends more than a few values of a column.
    """
    near = [F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(f"d{i}") for i, c in enumerate(cols)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *near).first()
    few = [c for i, c in enumerate(cols) if row[f"d{i}"] <= 2 * most]
    exact = df.agg(*(F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(few))).first() if few else []
    return row["rows"], dict(zip(few, exact, strict=True))


def top(df: DataFrame, value: str, label: str, n: int) -> DataFrame:
    """The n rows with the greatest values; ties by label, nulls last."""
    return df.orderBy(F.desc_nulls_last(value), F.asc(label)).limit(n)

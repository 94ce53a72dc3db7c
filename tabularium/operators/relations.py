"""Relationships between measures."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.functions import stats as S
from tabularium.operators import clustering as G
from tabularium.operators.common import by_pair, number, rows_from, typed
from tabularium.operators.quality import fences


def _complete(cols: list[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & number(c).isNotNull()
    return out


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


def _safe_r(r: Column) -> Column:
    return F.nanvl(r, F.lit(None).cast("double"))


def correlations(df: DataFrame, cols: list[str], min_r: float = 0.3) -> DataFrame:
    """(col1, col2, n, r, p_value, significant, strength, small_sample, reported) for each pair with 5 paired rows and no constant.

    All pairs in one pass; reported says |r| >= min_r.
    """
    pairs = _pairs(cols)
    if not pairs:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, n long, r double, p_value double, significant boolean, strength string, small_sample boolean, reported boolean")
    by = by_pair(df, pairs, lambda x, y: [F.count(F.lit(1)).alias("n"), _safe_r(F.corr(x, y)).alias("r"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("s")])
    names = df.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, col1 string, col2 string")
    out = names.join(F.broadcast(by), "i").select("col1", "col2", "n", "r", "s").where("n >= 5 and s > 0 and r is not null").drop("s")
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    p = F.when(F.abs("r") >= 1, 0.0).otherwise(S.t_p(t, F.col("n") - 2))
    strength = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.5, "moderate").otherwise("weak")
    return out.withColumn("p_value", p).select("*", (F.col("p_value") < 0.05).alias("significant"), strength.alias("strength"), (F.col("n") < 30).alias("small_sample"), (F.abs("r") >= min_r).alias("reported"))


def strongest(pairs: DataFrame) -> DataFrame:
    """(sign, col1, col2, r) of the strongest positive and negative reported correlation; significant ones are preferred."""
    signed = pairs.where("reported and r <> 0").withColumn("sign", F.when(F.col("r") > 0, "positive").otherwise("negative"))
    first = Window.partitionBy("sign").orderBy(F.desc("significant"), F.desc(F.abs("r")), "col1", "col2")
    return signed.withColumn("k", F.row_number().over(first)).where("k = 1").select("sign", "col1", "col2", "r")


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, sample covariances) on complete rows: one row to the driver."""
    rows, v = typed(df, cols)
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(v[c]).alias(f"m{i}") for i, c in enumerate(cols))]
    aggs += [F.covar_samp(v[cols[i]], v[cols[j]]).alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    row = rows.where(reduce(and_, (x.isNotNull() for x in v.values()), F.lit(True))).agg(*aggs).first()
    k = len(cols)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(k)]), cov


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, r_squared, vif, severity) of three or more non-constant measures on 10 or more complete rows: the inverse correlation matrix has the answer."""
    schema = "column string, r_squared double, vif double, severity string"
    n, _, cov = moments(df, cols) if len(cols) >= 3 else (0, None, np.zeros((0, 0)))
    keep = [i for i in range(len(cov)) if cov[i, i] > 0]
    if n < 10 or len(keep) < 3:
        return df.sparkSession.createDataFrame([], schema)
    sd = np.sqrt(np.diag(cov)[keep])
    corr = cov[np.ix_(keep, keep)] / np.outer(sd, sd)
    rows = []
    for k, i in enumerate(keep):
        rest = [x for x in range(len(keep)) if x != k]
        weights = np.linalg.lstsq(corr[np.ix_(rest, rest)], corr[rest, k], rcond=None)[0]
        r2 = float(min(0.999999, max(0.0, corr[rest, k] @ weights)))
        v = 1 / (1 - r2)
        rows.append((cols[i], r2, v, "severe" if v >= 10 else "moderate" if v >= 5 else "ok"))
    return df.sparkSession.createDataFrame(rows, schema)


def simpsons(df: DataFrame, pairs: list[tuple[str, str]], dims: list[str]) -> DataFrame:
    """(col1, col2, dimension, overall_r, groups, usable_groups, reversed) for dimensions with 2 to 8 values.

    A group is usable with 15 paired rows, no constant and |r| >= 0.15; reversed: two usable groups at least, all of the opposite sign.
    """
    out = None
    for a, b in pairs:
        both = df.where(_complete([a, b])).select(number(a).alias("x"), number(b).alias("y"), *(F.col(d).cast("string").alias(d) for d in dims))
        overall = both.agg(_safe_r(F.corr("x", "y")).alias("overall_r"))
        long = both.select("x", "y", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in dims))).alias("d")).where("d.level is not null")
        groups = long.groupBy("d.dimension", "d.level").agg(F.count(F.lit(1)).alias("n"), _safe_r(F.corr("x", "y")).alias("r"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("s"))
        usable = (F.col("n") >= 15) & (F.col("s") > 0) & (F.abs("r") >= 0.15)
        by = groups.crossJoin(F.broadcast(overall)).groupBy("dimension", "overall_r").agg(
            F.count(F.lit(1)).alias("groups"), F.count_if(usable).alias("usable_groups"), F.bool_and(F.when(usable, F.signum("r") == -F.signum("overall_r"))).alias("opposite"),
        ).where("groups between 2 and 8")
        part = by.select(F.lit(a).alias("col1"), F.lit(b).alias("col2"), "dimension", "overall_r", "groups", "usable_groups", ((F.col("usable_groups") >= 2) & F.coalesce("opposite", F.lit(False))).alias("reversed"))
        out = part if out is None else out.unionByName(part)
    return out


def partial_correlations(df: DataFrame, pairs: list[tuple[str, str]], measures: list[str], dims: list[str], most: int = 8) -> DataFrame:
    """(col1, col2, control, control_type, n, overall_r, partial_r, p_value, drop, effect) on rows complete for pair and control (15 at least).

    A numeric control uses the textbook formula with n - 3 degrees of freedom, a category the correlation within its groups (summed
    products, no join back) with n - k - 1. effect: reverses, mostly_explained, partially_explained or none.
    """
    out = None
    for a, b in pairs:
        controls = [(m, "numeric") for m in measures if m not in (a, b)] + [(d, "category") for d in dims]
        for z, kind in controls[:most]:
            if kind == "numeric":
                rows = df.where(_complete([a, b, z])).select(number(a).alias("x"), number(b).alias("y"), number(z).alias("z"))
                row = rows.agg(F.count(F.lit(1)).alias("n"), _safe_r(F.corr("x", "y")).alias("overall_r"), _safe_r(F.corr("x", "z")).alias("xz"), _safe_r(F.corr("y", "z")).alias("yz"))
                partial = F.try_divide(F.col("overall_r") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))))
                row = row.select("n", "overall_r", partial.alias("partial_r"), (F.col("n") - 3).alias("df"))
            else:
                rows = df.where(_complete([a, b]) & F.col(z).isNotNull()).select(number(a).alias("x"), number(b).alias("y"), F.col(z).alias("z"))
                xs = rows.groupBy("z").agg(F.count(F.lit(1)).alias("n"), *(e.alias(k) for k, e in {"xy": F.covar_pop("x", "y"), "xx": F.var_pop("x"), "yy": F.var_pop("y")}.items()))
                within = xs.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *(F.sum(F.col(k) * F.col("n")).alias(k) for k in ("xy", "xx", "yy")))
                overall = rows.agg(_safe_r(F.corr("x", "y")).alias("overall_r"))
                row = within.crossJoin(overall).select("n", "overall_r", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("partial_r"), (F.col("n") - F.col("k") - 1).alias("df"))
            part = row.where("n >= 15 and partial_r is not null").select(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.lit(z).alias("control"), F.lit(kind).alias("control_type"), "n", "overall_r", "partial_r", "df")
            out = part if out is None else out.unionByName(part)
    r = F.col("partial_r")
    drop = F.abs("overall_r") - F.abs(r)
    effect = F.when((F.signum(r) != F.signum("overall_r")) & (F.abs(r) >= 0.15), "reverses").when((drop >= 0.15) & (F.abs(r) < 0.3), "mostly_explained").when(drop >= 0.15, "partially_explained").otherwise("none")
    t = r * F.sqrt(F.try_divide("df", 1 - r * r))
    return out.select("col1", "col2", "control", "control_type", "n", "overall_r", "partial_r", S.t_p(t, F.col("df")).alias("p_value"), drop.alias("drop"), effect.alias("effect"))


def _distance(df: DataFrame, cols: list[str]) -> tuple[list[str], Column, float] | None:
    """(measures used, squared Mahalanobis distance as a column, its cut-off at 1 %), or None for too few rows."""
    use = cols[:6]
    n, mean, cov = moments(df, use)
    keep = [i for i in range(len(use)) if cov[i, i] > 0]
    if len(keep) < 2 or n < max(30, 10 * len(keep)):
        return None
    inverse = np.linalg.pinv(cov[np.ix_(keep, keep)])
    centred = [number(use[i]) - float(mean[i]) for i in keep]
    d2 = sum((centred[i] * centred[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(keep)) for j in range(i, len(keep))), F.lit(0.0))
    return [use[i] for i in keep], d2, S.chi2_quantile(0.01, len(keep))


def anomaly_flags(df: DataFrame, cols: list[str], flag: str = "unusual") -> DataFrame:
    """df with a boolean: complete rows whose squared Mahalanobis distance has a chi-square tail below 1 %."""
    found = _distance(df, cols)
    if not found:
        return df.withColumn(flag, F.lit(False))
    return df.withColumn(flag, F.coalesce(found[1] > found[2], F.lit(False)))


def anomalies(df: DataFrame, cols: list[str], id_cols: list[str], n: int = 50) -> DataFrame:
    """id_cols, distance (squared), p_value, z scores (map) and the two measures with the greatest |z| of at least 0.5, for the n most distant flagged rows."""
    found = _distance(df, cols)
    if not found:
        return df.select(*id_cols, F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("map<string,double>").alias("z"), F.lit(None).cast("array<string>").alias("traits")).limit(0)
    use, d2, cut = found
    row = df.where(_complete(use)).agg(*(F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(use)), *(F.stddev_pop(number(c)).alias(f"s{i}") for i, c in enumerate(use))).first()
    z = F.create_map(*(x for i, c in enumerate(use) for x in (F.lit(c), (number(c) - row[f"m{i}"]) / row[f"s{i}"])))
    some = df.withColumn("distance", d2).where(F.col("distance") > cut).select(*id_cols, "distance", z.alias("z")).orderBy(F.desc("distance"), *id_cols).limit(n)
    traits = F.slice(F.transform(F.reverse(F.array_sort(F.transform(F.filter(F.map_entries("z"), lambda e: F.abs(e["value"]) >= 0.5), lambda e: F.struct(F.abs(e["value"]).alias("a"), e["key"].alias("k"))))), lambda s: s["k"]), 1, 2)
    return some.withColumn("p_value", S.chi2_p(F.col("distance"), F.lit(len(use)))).select(*id_cols, "distance", "p_value", "z", traits.alias("traits"))


def segments(df: DataFrame, cols: list[str], k_range: tuple[int, int] = (2, 5), seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(df with segment, summary): k-means on up to six standardized measures; k by silhouette. All complete rows count, in the centres, the silhouette and the segments.

    Segments are numbered by size; the summary has a row for each segment and measure: mean, z and whether |z| >= 0.35 makes it a trait (two at most).
    """
    use = cols[:6]
    schema = "segment int, size long, measure string, mean double, z double, trait boolean"
    n, mean, cov = moments(df, use)
    keep = [i for i in range(len(use)) if cov[i, i] > 0]
    if n < 30 or len(keep) < 2:
        return df.withColumn("segment", F.lit(None).cast("int")), df.sparkSession.createDataFrame([], schema)
    names = [use[i] for i in keep]
    sd = {c: float(np.sqrt(cov[i, i] * (n - 1) / n)) for c, i in zip(names, keep, strict=True)}
    mid = {c: float(mean[i]) for c, i in zip(names, keep, strict=True)}
    scaled = df.where(_complete(names)).withColumns({f"__z{i}": (number(c) - mid[c]) / sd[c] for i, c in enumerate(names)})
    zs = [f"__z{i}" for i in range(len(names))]
    centres, _, found = G.fitted(scaled.select(*zs), zs, n, range(k_range[0], k_range[1] + 1), seed)
    order = sorted(range(len(centres)), key=lambda j: (found[j][0], -j), reverse=True)
    assigned = scaled.withColumn("segment", G.nearest(zs, centres[order])["j"])
    rows = []
    for place, j in enumerate(order):
        size, sums = found[j]
        if size:
            z = {c: float(s / size) for c, s in zip(names, sums, strict=True)}
            most = sorted(names, key=lambda c: (-abs(z[c]), c))[:2]
            rows += [(place, int(size), c, mid[c] + sd[c] * z[c], z[c], abs(z[c]) >= 0.35 and c in most) for c in names]
    return assigned.drop(*zs), df.sparkSession.createDataFrame(rows, schema)


def benford(df: DataFrame, cols: list[str], most: int = 3) -> DataFrame:
    """(column, digit, n, share, expected, chi2, p_value, deviates) of leading digits, for columns with 100 non-zero values over two orders of magnitude."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.abs(number(c)).alias("v")) for c in cols[:most])))
    long = df.select(parts.alias("p")).select("p.*").where("v > 0 and v < double('infinity')")
    digit = F.greatest(F.lit(1), F.least(F.lit(9), F.floor(F.col("v") / F.pow(F.lit(10.0), F.floor(F.log10("v")))).cast("int")))
    counts = long.groupBy("column", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    total = counts.groupBy("column").agg(F.sum("n").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).where("total >= 100 and high / low >= 100")
    grid = total.crossJoin(df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit")))
    cells = grid.join(counts.select("column", "digit", "n"), ["column", "digit"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "expected": F.log10(1 + 1 / F.col("digit"))})
    term = F.pow(F.col("n") - F.col("expected") * F.col("total"), F.lit(2.0)) / (F.col("expected") * F.col("total"))
    cells = cells.withColumn("chi2", F.sum(term).over(Window.partitionBy("column")))
    return cells.withColumn("p_value", S.chi2_p(F.col("chi2"), F.lit(8))).select("column", "digit", "n", (F.col("n") / F.col("total")).alias("share"), "expected", "chi2", "p_value", (F.col("p_value") < 0.05).alias("deviates"))


def robust_kpis(df: DataFrame, measures: list[tuple[str, str]]) -> DataFrame:
    """(measure, agg, full, trimmed, change_pct, outside_pct, material, skewed) with and without values beyond the quartile fences.

    material: an average moves by 10 %, or extremes carry 20 % of a sum; skewed: over 5 % of rows are outside; no spread: no row.
    """
    found = {m: f for m, f in fences(df, [m for m, _ in measures]).items() if f[2] > f[1]}
    use = [(m, how) for m, how in measures if m in found]
    schema = "measure string, agg string, full double, trimmed double, change_pct double, outside_pct double, material boolean, skewed boolean"
    if not use:
        return df.sparkSession.createDataFrame([], schema)
    aggs, names = [], {}
    for m, how in use:
        v, inside = number(m), number(m).between(found[m][3], found[m][4])
        f = F.sum if how == "sum" else F.avg
        aggs += [f(v).alias(f"{m}|f"), f(F.when(inside, v)).alias(f"{m}|t"), (F.count_if(~inside) * 100.0 / F.count(v)).alias(f"{m}|o")]
        names[m] = {"full": f"{m}|f", "trimmed": f"{m}|t", "outside_pct": f"{m}|o"}
    out = rows_from(df.agg(*aggs), names, "measure")
    how = F.create_map(*(F.lit(x) for kv in use for x in kv))[F.col("measure")]
    change = F.try_divide((F.col("trimmed") - F.col("full")) * 100, F.nullif(F.abs("full"), F.lit(0.0)))
    return out.select("measure", how.alias("agg"), "full", "trimmed", change.alias("change_pct"), "outside_pct", (F.abs(change) >= F.when(how == "sum", 20.0).otherwise(10.0)).alias("material"), (F.col("outside_pct") > 5).alias("skewed"))


def robust_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col1, col2, r, n, inside_r, inside_n, p_value, inside_p, effect) again on rows inside both columns' fences (10 at least).

    effect: flips (both |r| >= 0.1), lost_significance, weakens or strengthens (by 0.15), holds.
    """
    cols = sorted({c for p in pairs for c in p})
    found = fences(df, cols)
    rows, v = typed(df, cols)
    aggs, cells, marks = [], [], []
    for i, (a, b) in enumerate(pairs):
        marks += [(v[a].isNotNull() & v[b].isNotNull()).alias(f"f{i}"), (v[a].between(found[a][3], found[a][4]) & v[b].between(found[b][3], found[b][4])).alias(f"t{i}")]
        for k in "ft":
            mark = F.col(f"{k}{i}")
            aggs += [_safe_r(F.corr(F.when(mark, v[a]), F.when(mark, v[b]))).alias(f"r{k}{i}"), F.count_if(mark).alias(f"n{k}{i}")]
        cells.append(F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"rf{i}").alias("r"), F.col(f"nf{i}").alias("n"), F.col(f"rt{i}").alias("inside_r"), F.col(f"nt{i}").alias("inside_n")))
    out = rows.select("*", *marks).agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("inside_n >= 10 and r is not null and inside_r is not null")
    p = lambda r, n: S.t_p(F.col(r) * F.sqrt(F.try_divide(F.col(n) - 2, 1 - F.col(r) * F.col(r))), F.col(n) - 2)
    out = out.withColumns({"p_value": p("r", "n"), "inside_p": p("inside_r", "inside_n")})
    diff = F.abs("inside_r") - F.abs("r")
    flips = (F.signum("r") != F.signum("inside_r")) & (F.abs("r") >= 0.1) & (F.abs("inside_r") >= 0.1)
    return out.withColumn("effect", F.when(flips, "flips").when((F.col("p_value") < 0.05) & (F.col("inside_p") >= 0.05), "lost_significance").when(diff <= -0.15, "weakens").when(diff >= 0.15, "strengthens").otherwise("holds"))

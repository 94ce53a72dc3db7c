"""Joining, combining and comparing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.operators.aggregates import kpis
from tabularium.operators.common import number
from tabularium.operators.quality import normal_name


#: Values that a sketch of different values keeps (its default); below it, estimates are exact.
SKETCHED = 4096


def _text(c: str) -> Column:
    return F.lower(F.trim(F.col(f"`{c}`").cast("string")))


def _sketches(df: DataFrame, cols: list[str], side: str) -> DataFrame:
    """One row: for the i-th column its non-null values and a theta sketch of the different ones."""
    return df.agg(*(e.alias(f"{k}{side}{i}") for i, c in enumerate(cols) for k, e in (("n", F.count(_text(c))), ("s", F.theta_sketch_agg(_text(c))))))


def _value_counts(df: DataFrame, cols: dict[int, str], name: str) -> DataFrame:
    """(i, v, name): rows that hold each value of each column, by one scan."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _text(c).alias("v")) for i, c in cols.items())))
    return df.select(cells.alias("x")).select("x.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias(name))


def detect_join_key(a: DataFrame, b: DataFrame, unique: float = 0.9, overlap: float = 0.2, most: int = 30, whole: bool = False) -> DataFrame:
    """(left_column, right_column, left_uniqueness, right_uniqueness, overlap, exact, chosen) for columns with equal normalized names.

    Uniqueness is distinct / non-null; overlap is the number of shared values (trimmed, lower case) over the smaller side's. A key needs
    uniqueness on one side and overlap; the best by (overlap, greater uniqueness) is chosen.

    One scan of each table sketches all columns. Pairs that could still be the key by the sketches' error bounds are counted exactly, all by one more scan of each table; the
    others keep their estimates (exact is false, but for columns of up to SKETCHED values). The chosen pair is always exact. With `whole` nothing is estimated: every pair is counted, by one
    scan of each table, and there is no column exact.
    """
    names = {normal_name(c): c for c in b.columns}
    pairs = [(c, names[normal_name(c)]) for c in a.columns if normal_name(c) in names][:most]
    schema = "left_column string, right_column string, left_uniqueness double, right_uniqueness double, overlap double, exact boolean, chosen boolean"
    if not pairs:
        none = a.sparkSession.createDataFrame([], schema)
        return none.drop("exact") if whole else none
    if whole:
        found = {i: (0, 0, 0, 0, 0) for i in range(len(pairs))} | _pair_counts(a, b, dict(enumerate(pairs)))
        return _chosen(a.sparkSession, pairs, found, set(found), unique, overlap, schema).drop("exact")
    wide = _sketches(a, [x for x, _ in pairs], "x").crossJoin(_sketches(b, [y for _, y in pairs], "y"))  # one row each
    size = lambda s: F.theta_sketch_estimate(s)
    row = wide.select(*(e.alias(f"{k}{i}") for i in range(len(pairs)) for k, e in (
        ("nx", F.col(f"nx{i}")), ("ny", F.col(f"ny{i}")), ("dx", size(f"sx{i}")), ("dy", size(f"sy{i}")), ("both", size(F.theta_intersection(f"sx{i}", f"sy{i}"))),
    ))).first()
    found = {i: tuple(row[f"{k}{i}"] or 0 for k in ("nx", "ny", "dx", "dy", "both")) for i in range(len(pairs))}
    known = {i for i, (_, _, dx, dy, _) in found.items() if max(dx, dy) < SKETCHED}
    near = {i: _bounds(*found[i], i in known) for i in found}
    sure = max((low for low, _, u_low, _ in near.values() if u_low >= unique and low >= overlap), default=overlap)
    final = [i for i, (_, high, _, u_high) in near.items() if u_high >= unique and high >= sure and i not in known]
    if final:
        found |= _pair_counts(a, b, {i: pairs[i] for i in final})
    return _chosen(a.sparkSession, pairs, found, known | set(final), unique, overlap, schema)


def _pair_counts(a: DataFrame, b: DataFrame, pairs: dict[int, tuple[str, str]]) -> dict[int, tuple]:
    """{i: (non-null values left and right, different ones left and right, shared ones)} of pairs with values, exactly: a row for each pair."""
    x, y = _value_counts(a, {i: p[0] for i, p in pairs.items()}, "x"), _value_counts(b, {i: p[1] for i, p in pairs.items()}, "y")
    sums = x.join(y, ["i", "v"], "full_outer").groupBy("i").agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.count("x").alias("dx"), F.count("y").alias("dy"), F.count(F.col("x") + F.col("y")).alias("both"))
    return {r["i"]: tuple(r[k] or 0 for k in ("nx", "ny", "dx", "dy", "both")) for r in sums.collect()}


def _chosen(spark: SparkSession, pairs: list[tuple[str, str]], found: dict[int, tuple], exact: set[int], unique: float, overlap: float, schema: str) -> DataFrame:
    """The pairs with their shares and the chosen one, of those whose counts are exact."""
    share = lambda n, m: n / m if m else None
    out = [(*pairs[i], share(dx, nx), share(dy, ny), share(both, min(dx, dy)) or 0.0, i in exact) for i, (nx, ny, dx, dy, both) in found.items()]
    good = [(r[4], max(r[2] or 0, r[3] or 0), r[0]) for r in out if r[5] and max(r[2] or 0, r[3] or 0) >= unique and r[4] >= overlap]
    best = max(good)[2] if good else None
    return spark.createDataFrame([(*r, r[0] == best) for r in out], schema)


def _bounds(nx: float, ny: float, dx: float, dy: float, both: float, known: bool) -> tuple[float, float, float, float]:
    """(least and greatest overlap, least and greatest uniqueness of the better side) that sketches leave possible: four standard errors, and ten unseen values for a shared one."""
    u, small = max(dx / nx if nx else 0, dy / ny if ny else 0), min(dx, dy)
    o = both / small if small else 0
    if known or not small:
        return o, o, u, u
    union = max(dx + dy - both, 1)
    off = (4 * (both * union / SKETCHED) ** 0.5 + 10 * union / SKETCHED) / small + 4 * o / SKETCHED**0.5
    far = 4 * u / SKETCHED**0.5
    return max(0.0, o - off), o + off, u - far, u + far


def relational_join(a: DataFrame, b: DataFrame, left: str, right: str, name_a: str = "a", name_b: str = "b", null_safe: bool = False) -> tuple[DataFrame, DataFrame]:
    """A left join of the fact side (the one with less unique keys; a if equal) with the other, and (fact, rows, matched, unmatched, match_rate_pct, fact_rows_matched).

    Columns with equal names get ` (file)`; the right key goes. Counts follow from how often each key stands on either side.
    """
    if _uniqueness(a, left) > _uniqueness(b, right):
        a, b, left, right, name_a, name_b = b, a, right, left, name_b, name_a
    info = _join_counts(_multiplicity(a, left), _multiplicity(b, right), name_a, null_safe)
    same = [c for c in a.columns if c in b.columns and not (c == left and c == right)]
    facts = a.withColumnsRenamed({c: f"{c} ({name_a})" for c in same})
    dims = b.withColumnsRenamed({c: f"{c} ({name_b})" for c in same})
    left, dim_key = (f"{left} ({name_a})" if left in same else left), (f"{right} ({name_b})" if right in same else right)
    dims = dims.withColumnRenamed(dim_key, "__key")
    on = F.col(f"`{left}`").eqNullSafe(F.col("__key")) if null_safe else F.col(f"`{left}`") == F.col("__key")
    return facts.join(dims, on, "left").drop("__key"), info


def _multiplicity(df: DataFrame, key: str) -> DataFrame:
    """(k, n): how many rows hold each key, null included."""
    return df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def _uniqueness(df: DataFrame, key: str) -> float:
    """Different keys over rows with a key; 0 without any."""
    return _multiplicity(df, key).where("k is not null").agg(F.try_divide(F.count(F.lit(1)), F.sum("n"))).first()[0] or 0


def _join_counts(facts: DataFrame, dims: DataFrame, name: str, null_safe: bool) -> DataFrame:
    """The counts of a left join from the keys' multiplicities on both sides, without joining rows."""
    d = dims.select(F.col("k").alias("dk"), F.col("n").alias("dn"))
    keys = facts.join(d, F.col("k").eqNullSafe(F.col("dk")) if null_safe else F.col("k") == F.col("dk"), "left").select("n", "dn")
    met = F.coalesce("dn", F.lit(0))
    some = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = keys.agg(some(F.col("n") * F.greatest(met, F.lit(1))).alias("rows"), some(F.col("n") * met).alias("matched"), some(F.when(met > 0, F.col("n"))).alias("fact_rows_matched"), some("n").alias("fact_rows"))
    return sums.select(F.lit(name).alias("fact"), "rows", "matched", (F.col("fact_rows") - F.col("matched")).alias("unmatched"), F.try_divide(F.col("matched") * 100.0, "fact_rows").alias("match_rate_pct"), "fact_rows_matched")


def combine(frames: list[DataFrame], mappings: list[dict[str, str]], names: list[str]) -> DataFrame:
    """The mapped columns of all tables under their roles' names, with _source_file; roles that a table lacks are null."""
    out = None
    for df, mapping, name in zip(frames, mappings, names, strict=True):
        part = df.select(*(F.col(f"`{c}`").alias(role) for role, c in mapping.items()), F.lit(name).alias("_source_file"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """(aspect, value_a, value_b, differs): rows, columns, quality score and domain of two tables."""
    from tabularium.operators import quality as Q

    p, q = Q.understand(a), Q.understand(b)
    score = lambda d: str(Q.quality_score(d).first()["score"])
    rows = [("rows", str(p.rows), str(q.rows)), ("columns", str(p.columns), str(q.columns)), ("quality_score", score(a), score(b)), ("domain", p.domain, q.domain)]
    return a.sparkSession.createDataFrame([(*r, r[1] != r[2]) for r in rows], "aspect string, value_a string, value_b string, differs boolean")


def issue_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of findings (kind, subject, priority): (kind, subject, old_priority, new_priority, change resolved | new | worse | better | same)."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col(c))
    keyed = lambda d, name: d.groupBy("kind", "subject").agg(F.max_by("priority", F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("priority"))).alias(name), F.lit(True).alias(f"in_{name}"))
    both = keyed(old, "old_priority").join(keyed(new, "new_priority"), ["kind", "subject"], "full_outer")
    moved = rank("new_priority") - rank("old_priority")
    change = F.when(F.col("in_new_priority").isNull(), "resolved").when(F.col("in_old_priority").isNull(), "new").when(moved > 0, "worse").when(moved < 0, "better").otherwise("same")
    return both.select("kind", "subject", "old_priority", "new_priority", change.alias("change"))


KPI_NAMES = ("total_revenue", "total_profit", "margin_pct", "order_count", "avg_order_value", "unique_customers", "revenue_per_customer", "total_units", "completeness_pct")


def compare_kpis(a: DataFrame, b: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(metric, value_a, value_b, delta, change_pct) of the figures that both tables have."""
    long = lambda df, v: kpis(df, mapping).select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias(v)) for k in KPI_NAMES))).alias("m")).select("m.*").where(f"{v} is not null")
    both = long(a, "value_a").join(long(b, "value_b"), "metric")
    return both.withColumn("delta", F.col("value_b") - F.col("value_a")).withColumn("change_pct", F.try_divide(F.col("delta") * 100, F.nullif(F.abs("value_a"), F.lit(0.0))))


def compare_correlations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables (col1, col2, r): (col1, col2, r_a, r_b, delta, sign_flip, only_in); pairs are unordered."""
    def keyed(df: DataFrame, r: str) -> DataFrame:
        return df.where("col1 <> col2").select(F.least("col1", "col2").alias("col1"), F.greatest("col1", "col2").alias("col2"), F.col("r").alias(r)).dropDuplicates(["col1", "col2"])

    both = keyed(a, "r_a").join(keyed(b, "r_b"), ["col1", "col2"], "full_outer")
    flip = (F.signum("r_a") != F.signum("r_b")) & (F.abs("r_a") > 0.1) & (F.abs("r_b") > 0.1)
    return both.select("col1", "col2", "r_a", "r_b", (F.col("r_b") - F.col("r_a")).alias("delta"), F.coalesce(flip, F.lit(False)).alias("sign_flip"), F.when(F.col("r_b").isNull(), "a").when(F.col("r_a").isNull(), "b").alias("only_in"))


def snapshot(df: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, sum, avg, n, rows, columns): a table's fingerprint, to be kept as Parquet."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *(x for m in measures for x in (F.sum(number(m)).alias(f"{m}|s"), F.avg(number(m)).alias(f"{m}|a"), F.count(number(m)).alias(f"{m}|n"))))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"`{m}|s`").alias("sum"), F.col(f"`{m}|a`").alias("avg"), F.col(f"`{m}|n`").alias("n")) for m in measures)))
    return wide.select("rows", rows.alias("m")).select("m.*", "rows", F.array(*map(F.lit, sorted(df.columns))).alias("columns"))


def match_snapshot(columns: DataFrame, now: list[str], least: float = 0.6) -> DataFrame:
    """(name, jaccard) of the best earlier snapshot (name, columns): the same column set, else the greatest Jaccard similarity from `least`."""
    here = F.array(*map(F.lit, now))
    score = F.size(F.array_intersect("columns", here)) / F.size(F.array_union("columns", here))
    return columns.withColumn("jaccard", score).where(F.col("jaccard") >= least).orderBy(F.desc("jaccard"), "name").limit(1).select("name", "jaccard")


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots: (measure, old_sum, new_sum, change_pct, row_change, added, removed)."""
    o = old.select("measure", F.col("sum").alias("old_sum"), F.col("rows").alias("old_rows"), F.col("columns").alias("old_columns"))
    n = new.select("measure", F.col("sum").alias("new_sum"), F.col("rows").alias("new_rows"), F.col("columns").alias("new_columns"))
    table = o.agg(F.max("old_rows").alias("r0"), F.max("old_columns").alias("c0")).crossJoin(n.agg(F.max("new_rows").alias("r1"), F.max("new_columns").alias("c1")))
    both = o.select("measure", "old_sum").join(n.select("measure", "new_sum"), "measure", "full_outer").crossJoin(F.broadcast(table))
    return both.select(
        "measure", "old_sum", "new_sum", F.try_divide((F.col("new_sum") - F.col("old_sum")) * 100, F.nullif(F.abs("old_sum"), F.lit(0.0))).alias("change_pct"), (F.col("r1") - F.col("r0")).alias("row_change"),
        F.array_except("c1", "c0").alias("added"), F.array_except("c0", "c1").alias("removed"),
    )

"""A Poisson bootstrap of many claims at once.

Rows are dealt into cells by a hash of their key, and one aggregate sums up every claim in every cell. Each draw weighs each cell by a Poisson number that a hash of cell and draw gives: cells are
independent of each other, and where a key tells rows apart the result is the same however they are partitioned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.operators.common import number

#: Cells that rows are dealt into. Rows of a cell share their weights.
CELLS = 8192
#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
UPTO = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


@dataclass(frozen=True)
class Claim:
    """A claim on the numbers in `value`.

    kind: mean; share (of rows where group is level in the sum of all, %); gap (their mean less that of the others); change (from the others' mean to theirs, %). Without a level, all rows
    with a group are meant; `other` names the level to compare with, else all other rows; `where` says which rows count. It holds if the 95 % interval excludes the reference; with side "below" or "above" only if the interval lies there.
    """

    name: str
    kind: str
    value: str
    group: str | Column | None = None
    level: str | None = None
    other: str | None = None
    reference: float = 0.0
    where: Column | None = None
    side: str | None = None

    def sides(self) -> tuple[Column, Column]:
        """Whether a row is on the claim's side, and on the side that it is compared with."""
        counts = number(self.value).isNotNull() & (F.coalesce(self.where, F.lit(False)) if self.where is not None else F.lit(True))
        if self.group is None:
            return counts, F.lit(False)
        g = (F.col(self.group) if isinstance(self.group, str) else self.group).cast("string")
        mine = counts & (g == self.level if self.level is not None else g.isNotNull())
        rest = g == self.other if self.other is not None else g != self.level if self.level is not None else F.lit(False)
        return F.coalesce(mine, F.lit(False)), F.coalesce(counts & rest, F.lit(False))


def digits(text: Column, first: int) -> Column:
    """Eight hexadecimal digits of the MD5 of a text, from the first-th on, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 8), 16, 10).cast("long")


def cell_of(key: list[str] | None) -> Column:
    """The cell of a row: the first eight digits of the MD5 of its key columns, joined by |, modulo CELLS; nulls count as ''. Without a key, rows are dealt by their place."""
    if not key:
        return digits(F.monotonically_increasing_id().cast("string"), 1) % CELLS
    return digits(F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key)), 1) % CELLS


def weight(uniform: Column) -> Column:
    """A Poisson number of mean 1 from a number between 0 and 2^32."""
    out = F.lit(0)
    for p in UPTO:
        out = out + (uniform >= F.lit(p * 2**32)).cast("int")
    return out


def bootstrap(df: DataFrame, claims: list[Claim], key: list[str] | None = None, draws: int = 300) -> DataFrame:
    """(name, kind, point, low, high, valid, significant) for each claim, in one pass over df.

    key: columns that tell rows apart; rows that agree in them share their weights. Without a key each row has weights of its own, which depend on its place in the table. Sides need two rows each, else valid is 0 and the bounds are null. A claim is
    significant if half of its draws at least are defined and the interval excludes the reference.
    """
    schema = "name string, kind string, point double, low double, high double, valid long, significant boolean"
    if not claims:
        return df.sparkSession.createDataFrame([], schema)
    sums = []
    for i, c in enumerate(claims):
        a, b = c.sides()
        v = number(c.value)
        sums += [F.sum(F.when(a, v)).alias(f"as{i}"), F.count_if(a).alias(f"an{i}"), F.sum(F.when(b, v)).alias(f"bs{i}"), F.count_if(b).alias(f"bn{i}")]
    cells = df.withColumn("__cell", cell_of(key)).groupBy(F.col("__cell").alias("cell")).agg(*sums)
    names = [f"{x}{i}" for i in range(len(claims)) for x in ("as", "an", "bs", "bn")]
    # draw -1 weighs every cell once: the point
    drawn = cells.crossJoin(F.broadcast(df.sparkSession.range(-1, draws).select(F.col("id").alias("draw"))))
    text = F.concat_ws("|", F.col("cell").cast("string"), F.col("draw").cast("string"))
    weighed = drawn.withColumns({w: F.when(F.col("draw") < 0, 1).otherwise(weight(digits(text, at))) for w, at in (("wa", 1), ("wb", 9))})
    totals = weighed.groupBy("draw").agg(*(F.coalesce(F.sum(F.col(n) * F.col(f"w{n[0]}")), F.lit(0)).alias(n) for n in names))
    stats = totals.select("draw", *(_statistic(c, i).alias(f"x{i}") for i, c in enumerate(claims)), *(F.col(n) for n in names if n[1] == "n"))
    known = [F.when(F.col("draw") >= 0, F.col(f"x{i}")) for i in range(len(claims))]
    row = stats.agg(
        *(F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias(f"q{i}") for i, x in enumerate(known)), *(F.count(x).alias(f"v{i}") for i, x in enumerate(known)),
        *(F.max(F.when(F.col("draw") < 0, F.col(n))).alias(n) for n in [f"x{i}" for i in range(len(claims))] + [n for n in names if n[1] == "n"]),
    )
    out = []
    for i, c in enumerate(claims):
        enough = (F.col(f"an{i}") >= 2) & ((F.col(f"bn{i}") >= 2) if c.group is not None and c.kind != "mean" else F.lit(True))
        low, high = (F.when(enough, F.col(f"q{i}")[k]) for k in (0, 1))
        beyond = high < c.reference if c.side == "below" else low > c.reference if c.side == "above" else (low > c.reference) | (high < c.reference)
        valid = F.when(enough, F.col(f"v{i}")).otherwise(F.lit(0)).cast("long")
        out.append(
            F.struct(
                F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.col(f"x{i}").alias("point"), low.alias("low"), high.alias("high"), valid.alias("valid"),
                F.coalesce(beyond & (valid >= draws / 2), F.lit(False)).alias("significant"),
            )
        )
    return row.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def _statistic(c: Claim, i: int) -> Column:
    a, b = F.try_divide(F.col(f"as{i}"), F.col(f"an{i}")), F.try_divide(F.col(f"bs{i}"), F.col(f"bn{i}"))
    if c.kind == "share":
        return F.try_divide(F.col(f"as{i}") * 100.0, F.col(f"as{i}") + F.col(f"bs{i}"))
    if c.kind == "gap":
        return a - b
    if c.kind == "change":
        return F.try_divide((a - b) * 100.0, F.abs(b))
    return a

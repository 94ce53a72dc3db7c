"""Filters answered from a cube's cells are those of a new scan, and read nothing but the cells."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabularium.operators import cube as U
from tabularium.operators import entities as E


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(f"20{20 + i % 3}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", rng.choice(["a", "b", None]), rng.randint(1, 3), rng.choice([None, 1e9 + rng.random(), rng.gauss(5, 2)]), float(i % 7)) for i in range(1500)]
    return [*out, (None, "a", 1, 3.0, 1.0), ("2020-02-02", "a", 1, float("nan"), 2.0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "day string, `a.kind` string, size long, v double, w double").withColumn("day", F.to_date("day"))


@pytest.fixture(scope="module")
def cube(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube") / "cells")
    U.build(table, "day", ["a.kind", "size"], ["v", "w"]).write.parquet(path)
    return spark.read.parquet(path)


def kept(rows, kinds, sizes, first, last):
    return [r for r in rows if (kinds is None or r[1] in kinds) and (sizes is None or r[2] in sizes) and (first is None or (r[0] is not None and r[0][:7] >= first)) and (last is None or (r[0] is not None and r[0][:7] <= last))]


@pytest.mark.parametrize("kinds,sizes,first,last", [(None, None, None, None), (["a"], None, None, None), (["a", "b"], [1, 3], "2020-06", "2021-09"), (None, [2], None, "2020-12"), (["none"], None, None, None)])
def test_filters(cube, rows, kinds, sizes, first, last):
    levels = {k: v for k, v in (("a.kind", kinds), ("size", sizes)) if v is not None}
    some, want = U.pick(cube, levels, first, last), kept(rows, kinds, sizes, first, last)
    number = lambda x: x is not None and not math.isnan(x)
    by: dict = {}
    for r in want:
        if r[0] is not None:
            by.setdefault(r[0][:7], []).append(r[4])
    assert {r["month"]: r["value"] for r in U.trend(some, "w").collect()} == {m: pytest.approx(sum(v)) for m, v in by.items()}
    got = {r["measure"]: r for r in U.summary(some).collect()}
    for i, m in ((3, "v"), (4, "w")):
        v = [r[i] for r in want if number(r[i])]
        assert got[m]["n"] == len(v)
        if len(v) > 1:
            assert got[m]["mean"] == pytest.approx(statistics.fmean(v)) and got[m]["sd"] == pytest.approx(statistics.stdev(v)) and (got[m]["min"], got[m]["max"]) == (min(v), max(v))
    shares = {r["label"]: (r["rows"], r["value"], r["share_pct"]) for r in U.breakdown(some, "size", "w", "avg").collect()}
    assert shares == {str(s): (len(x), pytest.approx(statistics.fmean(x)), pytest.approx(len(x) * 100 / len(want))) for s in (1, 2, 3) if (x := [r[4] for r in want if r[2] == s])}


def test_small_spread_far_from_zero(spark):
    values = [1e9 + i % 2 for i in range(200)]
    df = spark.createDataFrame([("2020-01-01", str(i % 5), v) for i, v in enumerate(values)], "d string, k string, v double")
    assert U.summary(U.build(df, "d", ["k"], ["v"])).first()["sd"] == pytest.approx(statistics.stdev(values))


def test_drivers_add_up(cube, rows):
    got = U.drivers(cube, "w").collect()
    last = sorted({r[0][:7] for r in rows if r[0]})[-2:]
    for s in (1, 2, 3):
        before, after = (sum(r[4] for r in rows if r[0] and r[0][:7] == m and r[2] == s) for m in last)
        r = next(x for x in got if x["dimension"] == "size" and x["segment"] == str(s))
        assert (r["before_value"], r["after_value"], r["change"]) == (pytest.approx(before), pytest.approx(after), pytest.approx(after - before))


def test_answers_read_only_cells(cube):
    for df in (U.trend(U.pick(cube, {"size": [1]}), "v"), U.breakdown(cube, "size", "v"), U.summary(cube), U.drivers(cube, "v")):
        assert set(df.inputFiles()) <= set(cube.inputFiles())


def test_cubes_of_nothing_and_wrong_dimensions(spark, table, cube):
    none = U.build(table.limit(0), "day", ["a.kind"], ["v"])
    assert U.trend(none, "v").count() == U.drivers(none, "v").count() == 0 and U.summary(none).first()["n"] == 0
    assert U.dimensions_of(cube) == ["a.kind", "size"] and U.measures_of(cube) == ["v", "w"]
    with pytest.raises(ValueError):
        U.pick(cube, {"colour": ["red"]})


def test_cohorts_of_long_and_short_histories(spark):
    """Months beyond one bitmap word, and entities seen again after years."""
    rng = random.Random(1)
    seen = [(e, f"{2000 + m // 12}-{m % 12 + 1:02d}-{rng.randint(1, 28):02d}") for e in range(60) for m in {e % 6, e % 6 + rng.randint(0, 11), rng.randint(e % 6, 140)}]
    got = E.cohorts(spark.createDataFrame([*seen, (None, "2000-01-01"), (5, None)], "e long, d string").withColumn("d", F.to_date("d")), "e", "d")
    months: dict = {}
    for e, d in seen:
        months.setdefault(e, set()).add(int(d[:4]) * 12 + int(d[5:7]))
    for r in got.collect():
        first = int(r["cohort"][:4]) * 12 + int(r["cohort"][5:])
        mine = [m for m in months.values() if min(m) == first]
        assert r["size"] == len(mine) and r["active"] == sum(first + r["month_number"] in m for m in mine)
    assert got.count()

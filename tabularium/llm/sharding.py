"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

#: A prime below 2**31: squares of its residues fit a long.
PRIME = 2147483647
#: Round keys.
KEYS = (1103515245, 747796405, 1640531527, 362436069, 521288629, 88675123)
#: Rows that a numbering bucket holds on average, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 65_536
#: Numbers that an equal row is expanded to at a time.
CHUNK = 10_000


def _mixed(x: Column, key: Column) -> Column:
    """A number below PRIME from x < 2**32 and a round key: two squarings in the field of PRIME."""
    a = (x % PRIME + key) % PRIME
    b = (a * a + key) % PRIME
    return ((b + x % 65521) * (b + x % 65521) % PRIME * 48271 + x) % PRIME


def _round_trip(p: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the permutation of 0 .. a*b-1: halves of p in turn get a keyed function of the other half added."""
    keys = F.array(*(F.struct(F.lit(i % 2).alias("side"), F.lit((k + seed * 7919) % PRIME).cast("long").alias("key")) for i, k in enumerate(KEYS)))
    start = F.struct(F.floor(p / b).cast("long").alias("l"), (p % b).cast("long").alias("r"))

    def step(s: Column, k: Column) -> Column:
        return F.struct(
            F.when(k["side"] == 0, (s["l"] + _mixed(s["r"], k["key"])) % a).otherwise(s["l"]).alias("l"),
            F.when(k["side"] == 1, (s["r"] + _mixed(s["l"], k["key"])) % b).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """A bijection of 0 .. n-1.

    The Feistel network permutes 0 .. a*b-1 with a*b a little over n. A result of n or more is walked on
    along its cycle until it falls below n; that takes at most as many steps as there are numbers from n
    to a*b-1 (fewer than sqrt(n) + 1), which bounds the walk.
    """
    a = max(1, int(n**0.5))
    b = -(-max(n, 1) // a)
    excess = a * b - n
    first = _round_trip(number.cast("long"), a, b, seed)
    if not excess:
        return first

    def walk(p: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), p, lambda q, _: F.when(q < n, q).otherwise(_round_trip(q, a, b, seed)))

    out = F.when(first < n, first).otherwise(walk(first, min(8, excess)))
    if excess > 8:
        # a second, longer walk for the few that need it
        out = F.transform(F.array(out), lambda q: F.when(q < n, q).otherwise(walk(q, excess)))[0]
    return out


def numbered(df: DataFrame, id_col: str, number: str = "row_number") -> DataFrame:
    """df with gapless global row numbers from 0 that depend on its rows alone, not on its partitions.

    Equal rows are counted before the shuffle and expanded again afterwards, so a row that repeats for a third of
    the table costs no more than another until then; it is expanded in chunks of CHUNK numbers, which are dealt out. Buckets by hash are numbered in
    parallel; a window over their row counts (65,536 at most) gives each its first number.
    """
    columns = df.columns
    n = df.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    totals = counted.groupBy("__b").agg(F.sum("__n").alias("__s"))
    starts = totals.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    order = [F.col(id_col), *(F.col(c) for c in columns if c != id_col)]
    upto = F.sum("__n").over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("__upto", upto).join(starts, "__b").withColumn("__end", F.col("__start") + F.col("__upto"))
    few = placed.where(F.col("__n") <= CHUNK).select(*columns, F.explode(F.sequence(F.col("__end") - F.col("__n"), F.col("__end") - 1)).alias(number))
    chunks = placed.where(F.col("__n") > CHUNK).select(*columns, "__end", F.explode(F.sequence(F.col("__end") - F.col("__n"), F.col("__end") - 1, F.lit(CHUNK))).alias("__from"))
    last = F.least(F.col("__from") + CHUNK, F.col("__end")) - 1
    return few.unionByName(chunks.repartition("__from").select(*columns, F.explode(F.sequence("__from", last)).alias(number)))


def shard(df: DataFrame, id_col: str, shards: int, seed: int = 0) -> DataFrame:
    """Deals the rows of df into `shards` shards whose row counts are at most one apart; adds shard and slot.

    The global row number is permuted (see `permuted`); shard is the permuted number modulo `shards` and slot
    the quotient, so slots are gapless from 0 in each shard and both can be computed from the row number alone.
    Null values are values like others; repeated rows each get a place; an empty table gives an empty table. Columns may have any
    names; those named row_number, shard or slot are replaced. Map columns are compared by their sorted entries; maps inside other columns are not supported.
    """
    df = df.drop("row_number", "shard", "slot")
    n = df.count()
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    maps = [f.name for f in flat.schema if isinstance(f.dataType, MapType)]
    flat = flat.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps})
    rows = numbered(flat, flat.columns[df.columns.index(id_col)]).withColumns({c: F.map_from_entries(c) for c in maps})
    p = permuted(F.col("row_number"), n, seed)
    rows = rows.withColumn("row_number", p).select(*flat.columns, (F.col("row_number") % shards).cast("int").alias("shard"), F.floor(F.col("row_number") / shards).cast("long").alias("slot"))
    return rows.toDF(*df.columns, "shard", "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard(narrow, "doc_id", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Near-duplicate vectors by collision counting on one-dimensional projections (after query-aware LSH).

Unit vectors with a cosine of `cosine` or more differ by at most d = sqrt(2 - 2 * cosine) in length, so by a normal deviate of
that size on a random projection. A group of vectors is sorted on each of PROJECTIONS projections; around every query a window
of SPREAD deviations to both sides is cut out of each sorted list, and the collisions of each pair in these windows are counted. Pairs that
reach the count that a true pair reaches with probability RECALL are verified by the exact cosine.

A label of up to DIRECT * BLOCK vectors is one group. A larger one is dealt into cells first, by several further projections at
once, as often as the recall asks for (`tables`): a pair meets where it shares a cell, so that the work grows far slower than with the square of a label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import random_words, written
from tabularium.llm.components import components
from tabularium.llm.groups import by_group, in_blocks

#: Projections that collisions are counted on; half a window in deviations; the probability to find a pair at the limit.
PROJECTIONS, SPREAD, RECALL = 24, 1.5, 0.9999
#: Vectors of a block (larger groups are compared in pairs of blocks), and the blocks of a label from which it is dealt into cells.
BLOCK, DIRECT = 2048, 8
#: Width of a cell in units of d, the most projections that a cell is made of, and the spread of unit vectors of one label on a projection.
CELL, MOST, SPREAD_OF_ALL = 5.0, 12, math.sqrt(2)


def least_count(n: int, p: float, recall: float) -> int:
    """The greatest count that a binomial of n trials reaches with probability `recall`."""
    tail, k = 0.0, n
    while k > 0:
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
        k -= 1
    return 0


def same_cell(spread: float, width: float) -> float:
    """The probability that two points whose difference is normal with this spread lie in one cell of this width (with a random offset)."""
    if spread == 0:
        return 1.0
    x = width / spread
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def tables(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections that make a cell, how often all vectors are dealt into cells) for a label of n vectors."""
    if n <= DIRECT * BLOCK:
        return 0, 1
    d = _distance(cosine)
    many = min(MOST, max(1, math.ceil(math.log(n / BLOCK) / -math.log(min(0.9, same_cell(SPREAD_OF_ALL, CELL * d))))))
    return many, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(same_cell(d, CELL * d) ** many, 0.9999))))


def _distance(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 1e-12))


def unscaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two, exactly, so that the largest component lies between 0.5 and 1: no square over- or underflows."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def projected(vectors: DataFrame, cosine: float) -> DataFrame:
    """Adds cells (one number for each table) and projections to vectors: embedding, dim, n (vectors of its label), ..."""
    width = CELL * _distance(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, dim, n = batch.column("embedding").to_pylist(), batch.column("dim").to_numpy(), batch.column("n").to_numpy()
            kinds = {int(k): tables(int(k), cosine) for k in np.unique(n)}
            out = np.zeros((len(values), PROJECTIONS), np.float32)
            cells: list = [None] * len(values)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                x = unscaled(np.array([values[i] for i in at], np.float64))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                rng = np.random.default_rng(d)
                out[at] = x @ rng.standard_normal((d, PROJECTIONS))
                for kind in set(kinds.values()):
                    some = np.flatnonzero([kinds[int(k)] == kind for k in n[at]])
                    many, times = kind
                    rng = np.random.default_rng([d, many, times])
                    p = x[some] @ rng.standard_normal((d, many * times)) + rng.uniform(0, width, many * times)
                    c = np.floor(p / width).astype(np.int64).view(np.uint64).reshape(len(some), times, many)
                    with np.errstate(over="ignore"):
                        c = (c * random_words(many, 53)).sum(axis=2, dtype=np.uint64).view(np.int64)
                    for i, row in zip(at[some].tolist(), c.tolist(), strict=True):
                        cells[i] = row
            flat = pa.ListArray.from_arrays(pa.array((np.arange(len(out) + 1) * PROJECTIONS).astype(np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64())), flat], names=[*batch.schema.names, "cells", "projections"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, types + ", cells array<bigint>, projections array<float>")


def collisions(p: np.ndarray, of: np.ndarray, window: float, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, sorted candidates) for the queries `of`: the rows of p that collide with it in at least `least` query-centred windows."""
    order = [np.argsort(p[:, k], kind="stable") for k in range(p.shape[1])]
    cuts = [np.searchsorted(p[o, k], [p[of, k] - window, p[of, k] + window]) for k, o in enumerate(order)]
    for i, q in enumerate(of.tolist()):
        count = np.bincount(np.concatenate([o[lo[i] : hi[i]] for o, (lo, hi) in zip(order, cuts, strict=True)]), minlength=len(p))
        yield q, np.flatnonzero(count >= least)


def links(vectors: DataFrame, cosine: float, recall: float = RECALL) -> DataFrame:
    """(a, b) links of spanning forests and (a, null, links) sums of copies linked; vectors: gid (of the label), cid, embedding, copies, cells, projections."""
    window = SPREAD * _distance(cosine) + 1e-5  # projections are rounded
    least = least_count(PROJECTIONS, math.erf(SPREAD / math.sqrt(2)), recall)
    keys = ["gid", "table", "cell"]
    rows = vectors.select("gid", "cid", "embedding", "copies", "projections", "cells", F.posexplode("cells").alias("table", "cell"))
    # the cells of earlier tables tell which pairs have met before
    rows = rows.withColumn("before", F.slice("cells", F.lit(1), F.col("table"))).drop("cells")
    sizes = written(vectors.select("gid", F.posexplode("cells").alias("table", "cell")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")

    def search(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cid, copies, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "copies", "__own"))
        n = len(cid)
        p = batch.column("projections").flatten().to_numpy().astype(np.float64).reshape(n, PROJECTIONS)
        v = unscaled(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))
        norm = np.sqrt((v * v).sum(axis=1))
        before = batch.column("before").flatten().to_numpy().reshape(n, -1)
        first, cross = batch.column("__i")[0].as_py(), batch.column("__i")[0].as_py() != batch.column("__j")[0].as_py()
        total, part, edges = np.zeros(n, np.int64), np.arange(n), []
        for x, y in collisions(p, np.flatnonzero(own == first) if cross else np.arange(n), window, least):
            y = y[own[y] != first] if cross else y[y > x]
            if before.shape[1] and len(y):
                y = y[~(before[y] == before[x]).any(axis=1)]
            y = y[(v[y] * v[x]).sum(axis=1) / (norm[y] * norm[x]) >= cosine]
            if not len(y):
                continue
            total[x] += copies[y].sum()
            total[y] += copies[x]
            new, at = np.unique(part[y], return_index=True)
            at, new = at[new != part[x]], new[new != part[x]]
            if len(new):  # links that join two parts of the forest
                edges += [(x, int(k)) for k in y[at]]
                part[np.isin(part, new)] = part[x]
        at = np.flatnonzero(total)
        if not len(at):
            return None
        a = np.concatenate([cid[at], cid[[e[0] for e in edges]]])
        b = pa.array([None] * len(at) + cid[[e[1] for e in edges]].tolist(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([total[at], np.zeros(len(edges), np.int64)]))], names=["a", "b", "links"])

    rows = in_blocks(rows.join(sizes, keys), "cell", "n", "cid", BLOCK)
    return by_group(rows.select(*keys, "__i", "__j", "__own", "cid", "embedding", "copies", "projections", "before"), [*keys, "__i", "__j"], search, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors of equal, non-null labels with a cosine of `cosine` or more.

    Equal vectors of a label are one class and are searched once. Any finite vector but zero has a cosine, however small or
    large its components. Vectors that are null, empty, zero or hold null or non-finite
    components, null labels and vectors of different lengths link with nothing; a null id is a component of its own (null, kept).
    Rows with the same id, vector and label count as one. Further columns are ignored; an empty table gives none.
    """
    v, given = F.col("v"), vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast(given if given == "array<float>" else "array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.coalesce(fine, F.lit(False))).dropDuplicates(["vec_id", "label", "v"])
    # the numbers of classes and labels are written with them, so they stay what they are
    classes = written(good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    groups = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).withColumn("gid", F.monotonically_increasing_id())
    sized = classes.withColumn("dim", F.size("v")).join(written(groups, "labels"), ["label", "dim"]).select("gid", "n", "dim", "cid", F.col("v").alias("embedding"), "copies")
    found = written(links(written(projected(sized, cosine), "projected"), cosine), "vector-links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    linked = classes.join(roots, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = linked.join(first, "root").select("label", "v", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = good.join(by_class, ["label", "v"]).groupBy("vec_id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The links of all vectors at a cosine of 0.98."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

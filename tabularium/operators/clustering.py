"""K-means on whole tables: a weighted coreset finds the start, every row moves the centres and counts in the silhouette."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a coreset, about.
CORESET = 20_000


def coreset(points: DataFrame, cols: list[str], n: int, size: int = CORESET, seed: int = 1) -> DataFrame:
    """About `size` rows of standardized points, with a weight w for each: a row is kept with a chance that is half the same for all and half by its share of the squared distances
    from the mean, and weighs what it stands for, so that the weighted cost of any centres estimates that of all rows. With no more than `size` rows all are kept.
    """
    if n <= size:
        return points.withColumn("w", F.lit(1.0))
    square = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    chance = F.least(F.lit(1.0), size * (0.5 + 0.5 * square / len(cols)) / n)  # squared distances sum up to n for each column
    return points.withColumns({"w": 1 / chance, "__u": F.rand(seed)}).where(F.col("__u") < chance).drop("__u")


def nearest(cols: list[str], centres: np.ndarray) -> Column:
    """(d, j): the squared distance to the nearest centre, and its number (ties: the least)."""
    parts = []
    for j, centre in enumerate(centres):
        d = F.lit(0.0)
        for c, x in zip(cols, centre.tolist(), strict=True):
            d = d + (F.col(c) - x) * (F.col(c) - x)
        parts.append(F.struct(d.alias("d"), F.lit(j).alias("j")))
    return F.array_min(F.array(*parts))


def blocks(points: DataFrame, cols: list[str]) -> DataFrame:
    """(block binary): the rows of each batch as doubles, one row after the other, so that a pass over them has no rows to convert."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["block"])

    return points.select(*cols).mapInArrow(pack, "block binary")


def unpacked(packed: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of blocks, in their order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                x = np.frombuffer(b.as_buffer(), np.float64).reshape(-1, len(cols))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(len(cols))], names=cols)

    return packed.mapInArrow(rows, ", ".join(f"`{c}` double" for c in cols))


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows' squared distances to centres (centres x rows), summed column by column as `nearest` does."""
    out = np.zeros((len(centres), len(x)))
    for c in range(x.shape[1]):
        d = x[:, c] - centres[:, c, None]
        out += d * d
    return out


def _summed(packed: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a matrix of `width` columns that `part` makes of a block's rows: each task sums its blocks', Spark sums the tasks'."""
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column(0):
                m = part(np.frombuffer(b.as_buffer(), np.float64))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(total[:, i]) for i in range(width))], names=["at", *names])

    got = packed.mapInArrow(sums, "at int, " + ", ".join(f"{n} double" for n in names)).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).collect()  # a row for each centre or model
    return np.array([[r[n] for n in names] for r in sorted(got, key=lambda r: r["at"])]).reshape(-1, width)


def cluster_sums(points: DataFrame, cols: list[str], models: dict[int, np.ndarray]) -> dict[int, list]:
    """For every model (number of clusters: centres), its clusters' (rows, sums of columns, sum of squared lengths, inertia) over all rows: one pass for all models, one row a cluster to the driver."""
    return _cluster_sums(blocks(points, cols), len(cols), models)


def _cluster_sums(packed: DataFrame, width: int, models: dict[int, np.ndarray]) -> dict[int, list]:
    def part(block: np.ndarray) -> np.ndarray:
        x = block.reshape(-1, width)
        square = (x * x).sum(axis=1)
        out = []
        for m in models.values():
            d = _squared(x, m)
            j = d.argmin(axis=0)
            by = lambda w, j=j, n=len(m): np.bincount(j, weights=w, minlength=n)
            out.append(np.stack([np.bincount(j, minlength=len(m)), by(square), by(d.min(axis=0)), *(by(x[:, c]) for c in range(width))], axis=1))
        return np.concatenate(out)

    got = _summed(packed, 3 + width, part)
    out: dict[int, list] = {}
    at = 0
    for k, m in models.items():
        mine = got[at : at + len(m)] if len(got) else np.zeros((len(m), 3 + width))
        out[k] = [(int(r[0]), r[3:], float(r[1]), float(r[2])) if r[0] else (0, m[j], 0.0, 0.0) for j, r in enumerate(mine)]
        at += len(m)
    return out


def _lloyd(packed: DataFrame, width: int, models: dict[int, np.ndarray], steps: int = 10, still: float = 1e-4) -> dict[int, np.ndarray]:
    """Moves the centres of all models to the means of their rows, all rows counted, until none moves by `still` or `steps` are done."""
    for _ in range(steps):
        found = _cluster_sums(packed, width, models)
        moved = {k: np.array([s / n if n else m for (n, s, _, _), m in zip(found[k], models[k], strict=True)]) for k in models}
        shift = max(float(np.abs(moved[k] - models[k]).max()) for k in models)
        models = moved
        if shift < still:
            break
    return models


def silhouettes(points: DataFrame, cols: list[str], models: dict[int, np.ndarray]) -> dict[int, float]:
    """The mean silhouette of all rows by squared distances, for every model: a row's mean distance to a cluster follows from the cluster's count, sum and squared lengths."""
    packed = blocks(points, cols)
    return _silhouettes(packed, len(cols), models, _cluster_sums(packed, len(cols), models))


def _silhouettes(packed: DataFrame, width: int, models: dict[int, np.ndarray], found: dict[int, list]) -> dict[int, float]:
    def part(block: np.ndarray) -> np.ndarray:
        x = block.reshape(-1, width)
        square = (x * x).sum(axis=1)
        out = np.zeros((len(models), 2))
        for i, (k, m) in enumerate(models.items()):
            own = _squared(x, m).argmin(axis=0)
            sizes = np.array([float(n) for n, *_ in found[k]])
            far = np.stack([square + q / n - 2 * (x @ (s / n)) if n else np.full(len(x), np.inf) for n, s, q, _ in found[k]])
            rows = np.arange(len(x))
            n_own = sizes[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                a = far[own, rows] * n_own / (n_own - 1)
                far[own, rows] = np.inf
                b = far.min(axis=0)
                s = (b - a) / np.maximum(a, b)
            out[i] = s[np.isfinite(s) & (n_own > 1)].sum(), len(x)
        return out

    got = _summed(packed, 2, part)
    return {k: float(got[i, 0] / got[i, 1]) for i, k in enumerate(models)}


def fitted(points: DataFrame, cols: list[str], n: int, ks: range, seed: int = 1, size: int = CORESET) -> tuple[np.ndarray, dict[int, float], list[tuple[int, np.ndarray]]]:
    """(centres of the number of clusters with the best silhouette, all silhouettes, rows and sums of columns of each of its clusters) of n standardized points; started on a coreset, finished on all rows.

    All passes go over the points as blocks of doubles, kept for them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    packed = blocks(points, cols).persist()
    start = VectorAssembler(inputCols=cols, outputCol="v").transform(coreset(unpacked(packed, cols), cols, n, size, seed)).select("v", "w").persist()
    try:
        models = {k: np.array(KMeans(k=k, seed=seed, featuresCol="v", weightCol="w", maxIter=30).fit(start).clusterCenters()) for k in ks}
        models = _lloyd(packed, len(cols), models)
        found = _cluster_sums(packed, len(cols), models)
        score = _silhouettes(packed, len(cols), models, found)
    finally:
        start.unpersist()
        packed.unpersist()
    best = max(score, key=lambda k: (score[k], -k))
    return models[best], score, [(rows, sums) for rows, sums, *_ in found[best]]


def kmeans(points: DataFrame, cols: list[str], n: int, ks: range, seed: int = 1, size: int = CORESET) -> tuple[np.ndarray, dict[int, float]]:
    """(centres of the number of clusters with the best silhouette, all silhouettes). See fitted."""
    centres, score, _ = fitted(points, cols, n, ks, seed, size)
    return centres, score

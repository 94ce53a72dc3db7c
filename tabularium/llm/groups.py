"""Groups that a task reads as a stream, and that are split into pairs of blocks where they are large."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(rows: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """Adds __i, __j and __own: a group of over `block` rows is split into blocks by a hash of the member, and each row goes
    to every pair of blocks that its own is part of, so that all pairs of rows meet exactly once (own blocks differ, or i = j).
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member, group), blocks.cast("long")).cast("int")
    rows = rows.withColumn("__blocks", blocks).withColumn("__own", own)
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return rows.withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")}).drop("__blocks", "__other")


def by_group(rows: DataFrame, keys: list[str], task: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs task on all rows of each key, one group after the other in a sorted stream: no task holds more than one group and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            first = np.flatnonzero(new).tolist()
            for lo, hi in zip(first, [*first[1:], batch.num_rows], strict=True):
                key = tuple(c[lo] for c in cols)
                if key != last and held:
                    if (out := task(_joined(held))) is not None and out.num_rows:
                        yield out
                    held = []
                last = key
                held.append(batch.slice(lo, hi - lo))
        if held and (out := task(_joined(held))) is not None and out.num_rows:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def forest(near: Callable[[int, np.ndarray], np.ndarray], n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0 .. n-1: near(x, others) says which of others are neighbours of x. Nodes reached are not asked about again."""
    left = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if hit.any():
                got = left[hit].tolist()
                out += [(x, y) for y in got]
                queue += got
                left = left[~hit]
    return out

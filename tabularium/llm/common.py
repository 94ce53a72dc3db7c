"""What the training-data operators share: shared folders, Bloom filters, words and their hashes."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Entries that a task's word cache holds before it starts anew.
CACHE = 200_000
#: Bytes of text that a task looks at together.
SLICE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and everything runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tabularium-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def hash_sample(df: DataFrame, rows: int, size: int, *keys: str, seed: int = 0) -> DataFrame:
    """About `size` of `rows` rows, picked by a hash of their keys: the same rows however they are partitioned, and few from each task."""
    scale = 1 << 40
    return df if rows <= size else df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(scale)) < int(scale * size / rows))


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: whatever they are called, dots included, they pass through tasks; toDF(*df.columns) gives the names back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


BLOOM_WORDS = 1 << 16


def bloom(keys: DataFrame, column: str, words: int = BLOOM_WORDS) -> np.ndarray:
    """A Bloom filter of fixed size (64 * words bits, two bits a key) over a long column; at most `words` rows reach the driver."""
    rows = (
        keys.select(F.explode(F.array(*(F.xxhash64(column, F.lit(s)) for s in (1, 2)))).alias("h"))
        .select(F.pmod(F.shiftrightunsigned("h", 6), F.lit(words)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    )
    out = np.zeros(words, np.int64)
    for r in rows:
        out[r["w"]] = r["b"]
    return out


def _xx_long(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of a long column, vectorised (XXH64 of eight bytes)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.asarray(seed, np.uint64) + p5 + np.uint64(8)
        h = h ^ (rot(values.astype(np.uint64) * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        return h ^ (h >> np.uint64(32))


def _xx_int(value: int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int (XXH64 of four bytes)."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = seed + p5 + np.uint64(4)
        h = h ^ (np.uint64(value) * p1)
        h = rot(h, 23) * p2 + p3
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        return h ^ (h >> np.uint64(32))


def in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys the filter may hold; never false for a key that it was built from."""
    out = np.ones(len(keys), bool)
    for s in (1, 2):
        h = _xx_int(s, _xx_long(keys.astype(np.int64).view(np.uint64), 42))
        w = (h >> np.uint64(6)) % np.uint64(len(bits))
        out &= ((bits[w.astype(np.int64)].view(np.uint64) >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


_KEPT: dict = {}


def kept(key: tuple, make):
    """One thing that a Python worker keeps for its next tasks of the same kind."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drops what the worker has kept and gives memory that it no longer uses back to the system; tasks of another kind begin with it."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what was freed
        trim(0)


class Hashes(dict):
    """Word (bytes) -> 64-bit hash; a cache of bounded size."""

    def __init__(self, seed: int = 0) -> None:
        release()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows of about `limit` bytes (one row at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def in_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(first row, end, texts) of runs of rows of about `limit` bytes, as `slices` cuts them; only one run's texts are Python objects at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, limit + (size[lo - 1] if lo else 0), side="right")))
        yield lo, hi, as_bytes(column.slice(lo, hi - lo))
        lo = hi


def split_words(texts: Iterable[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in a row, and where each text's begin (one more entry than texts)."""
    parts = [t.split() if t else [] for t in texts]
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return list(itertools.chain.from_iterable(parts)), ends


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted different numbers."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(h: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """A hash of each n consecutive words, given the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(random_words(n, seed)):
            out += h[i : len(h) - n + 1 + i] * m
    return mix(out)


class WordTable:
    """A row of numbers for each word (bytes), computed for many new words at once; starts anew when it holds `limit` words."""

    def __init__(self, compute, width: int, limit: int = CACHE) -> None:
        release()
        self.compute, self.width, self.limit = compute, width, limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.matrix = np.zeros((4096, self.width), np.float32)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Where in `matrix` the words' rows are."""
        if len(self.known) > self.limit:
            self._clear()
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            need = len(known) + len(new)
            if need > len(self.matrix):
                grown = np.zeros((max(need, min(2 * len(self.matrix), need + 65_536)), self.width), np.float32)
                grown[: len(known)] = self.matrix[: len(known)]
                self.matrix = grown
            self.matrix[len(known) : need] = self.compute(new)
            known.update(zip(new, range(len(known), need), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def char_grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of each word in lower case with a space on both sides: (buckets of all grams, the word of each), words in order."""
    joined = np.frombuffer(b" " + b" ".join(words).decode("utf-8", "replace").lower().encode() + b" ", np.uint8)
    space = joined == 32
    word = np.cumsum(space) - 1  # the space before a word counts as its begin
    out, who = [], []
    with np.errstate(over="ignore"):
        x = joined.astype(np.uint64) + np.uint64(1)
        for n in sizes:
            if len(x) < n:
                continue
            m = len(x) - n + 1
            h = np.full(m, n, np.uint64)
            inner = np.zeros(m, bool)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + x[i : i + m]
                if 0 < i < n - 1:
                    inner |= space[i : i + m]
            if n == 1:
                inner = space[:m]
            good = np.flatnonzero(~inner & (word[:m] < len(words)))
            good = good[~(space[good] & space[good + n - 1])] if n == 2 else good
            out.append((mix(h[good]) % np.uint64(buckets)).astype(np.int32))
            who.append(word[good].astype(np.int32))
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    grams, who = np.concatenate(out), np.concatenate(who)
    order = np.argsort(who, kind="stable")
    return grams[order], who[order]

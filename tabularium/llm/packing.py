"""Best-two-fit packing of tokenised documents into sequences.

Lengths lie between 1 and the capacity, so a histogram of at most `capacity` counts says all that packing needs. The packing is
found on that histogram, with a multiplicity for each kind of sequence; then every piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.llm.common import in_slices, kept, split_words, written

TOKENIZER = "word_bpe_49k.json"
#: Put between chunks that are encoded together: a single token of its own; a chunk that holds it is encoded alone.
MARK = "`"
CACHE = 600_000


#: No byte of the UTF-8 form of a character below U+0180 is greater: such characters are composed already, and their lower case needs no context.
LATIN = 0xC5


class _Places(dict):
    """Chunk -> its number; new chunks are numbered and noted."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class ChunkIds:
    """Token ids of white-space separated chunks. The tokenizer never looks across white space, so a text's ids are those of its chunks in a row. Bounded."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Latin letters alone are one word for the tokenizer's pattern: lower-cased, they need neither it nor the normalizer
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known = _Places()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _joined(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and how many each has."""
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 512):
            some = words[i : i + 512]
            ids = np.array(tokenizer.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            parts.append(np.delete(ids, at))
            sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
        return np.concatenate(parts), np.concatenate(sizes)

    def _learn(self, chunks: list[bytes]) -> None:
        kinds: tuple[list[int], ...] = ([], [], [])
        text = b" ".join(chunks).decode()
        words, lower = text.split(" "), text.lower().split(" ")
        for i, (c, w) in enumerate(zip(chunks, lower, strict=True)):
            kinds[2 if MARK in w else 0 if w.isalpha() and max(c) <= LATIN else 1].append(i)
        letters, plain, odd = kinds
        got = [self._joined([lower[i] for i in letters], self.letters), self._joined([words[i] for i in plain], self.tokenizer)]
        alone = [self.tokenizer.encode(words[i], add_special_tokens=False).ids for i in odd]
        got.append((np.array([x for ids in alone for x in ids], np.uint32), np.array([len(ids) for ids in alone], np.int64)))
        order = np.array(letters + plain + odd)
        flat, size = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        begin = np.cumsum(size) - size
        back = np.argsort(order)
        size, begin = size[back], begin[back]
        end = self.ends[-1] + np.cumsum(size)
        if end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(int(end[-1]) - len(self.ids), len(self.ids) // 2), np.uint32)])
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.ids[self.ends[-1] : end[-1]] = flat[at]
        self.ends = np.concatenate([self.ends, end])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Each text's ids."""
        chunks, ends = split_words(texts)
        if len(self.known) > CACHE:
            self.clear()
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        start, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        cum = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(start - cum[:-1], n) + np.arange(cum[-1])]
        cut = cum[ends]
        return [flat[cut[i] : cut[i + 1]] for i in range(len(texts))]


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, path: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and then end_id, cut into pieces of `capacity` tokens where it is longer: (doc_id, piece, start, length, ids_crc32[, ids])."""
    path = path or public_tokenizers.path(TOKENIZER)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(("chunks", path), lambda: ChunkIds(path))  # the chunks of the worker's earlier tasks are known
        for batch in batches:
            for lo, hi, texts in in_slices(batch.column(1)):
                rows = []
                for i, got in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), coder.encode(texts), strict=True):
                    all_ids = np.append(got, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(all_ids), capacity)):
                        some = all_ids[start : start + capacity]
                        rows.append((i, piece, start, len(some), zlib.crc32(some.tobytes()), some))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[: len(names)], kinds, strict=False)], names=names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def _largest(left: np.ndarray) -> np.ndarray:
    """For each gap, the greatest length with pieces left that fits it (0: none)."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def _improved(left: np.ndarray, fit: np.ndarray, bin_: dict[int, int], gap: int) -> int:
    """One swap: the bin's smallest piece against the two unpacked pieces that fill its expanded gap best. Returns the new gap."""
    small = min(bin_)
    room = gap + small
    a = np.flatnonzero(left[: room // 2 + 1])
    if not len(a):
        return gap
    b = fit[room - a]
    double = (a == b) & (left[a] < 2)
    if double.any():
        for i in np.flatnonzero(double):
            b[i] = fit[a[i] - 1] if a[i] > 1 else 0
    total = np.where(b > 0, a + b, 0)
    best = int(total.argmax())
    if total[best] <= small:
        return gap
    bin_[small] -= 1
    if not bin_[small]:
        del bin_[small]
    left[small] += 1
    for x in (int(a[best]), int(b[best])):
        bin_[x] = bin_.get(x, 0) + 1
        left[x] -= 1
    return room - int(total[best])


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Packs counts[l] pieces of each length l: (how many sequences, {length: pieces in each of them}).

    A sequence starts with the longest piece left and is filled greedily with the longest that fits; then, as long as
    that leaves a gap, its smallest piece is replaced by two that fit the expanded gap more tightly. What was
    found is used as often as the counts allow, so the number of steps depends on the capacity and not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    while True:
        fit = _largest(left)
        top = int(fit[capacity])
        if not top:
            return out
        bin_: dict[int, int] = {}
        gap = capacity
        while True:
            x = int(fit[gap])
            if not x:
                break
            k = min(int(left[x]), gap // x)
            bin_[x] = bin_.get(x, 0) + k
            left[x] -= k
            gap -= k * x
            if not left[x]:
                fit = _largest(left)
        for _ in range(8):
            if not gap or (len(bin_) == 1 and sum(bin_.values()) == 1 and min(bin_) == top):
                break
            fit = _largest(left)
            was, gap = gap, _improved(left, fit, bin_, gap)
            if gap == was:
                break
        for x, k in bin_.items():
            left[x] += k
        times = min(int(left[x]) // k for x, k in bin_.items())
        for x, k in bin_.items():
            left[x] -= k * times
        out.append((times, bin_))


#: Pieces that a ranking bucket holds on average.
BUCKET = 50_000


def places(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    The driver gets the histogram of lengths (`capacity` numbers at most) and finds the layout, which has a few entries for each length. Pieces of one length rank in
    buckets by hash, as many as the length needs, so that a length that a third of all pieces have is numbered in parallel; what comes before a
    bucket is joined to it.
    """
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["length"].to_numpy()] = histogram["n"].to_numpy()
    entries: dict[int, list] = {}
    first = 0
    used = np.zeros(capacity + 1, np.int64)
    for times, bin_ in best_two_fit(counts, capacity):
        offset = 0
        for x in sorted(bin_, reverse=True):
            entries.setdefault(x, []).append((int(used[x]), first, bin_[x], offset))
            used[x] += bin_[x] * times
            offset += x * bin_[x]
        first += times
    spark = pieces.sparkSession
    held = spark.sparkContext.broadcast({x: np.array(v, np.int64) for x, v in entries.items()})
    many = [(x, int(-(-counts[x] // BUCKET))) for x in range(capacity + 1) if counts[x] > BUCKET]
    buckets = F.lit(1)
    if many:  # lengths of more than one bucket
        buckets = F.coalesce(F.element_at(F.map_from_arrays(F.array(*(F.lit(x) for x, _ in many)), F.array(*(F.lit(k) for _, k in many))), F.col("length").cast("int")), F.lit(1))
    keyed = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets.cast("long")))
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    if many:
        before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        starts = keyed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n")).select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        ranked = ranked.join(starts, ["length", "__b"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    names = pieces.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = held.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                e = arrays[x][np.searchsorted(arrays[x][:, 0], rank[at], side="right") - 1]
                inside = rank[at] - e[:, 0]
                sequence[at] = e[:, 1] + inside // e[:, 2]
                offset[at] = e[:, 3] + inside % e[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(put, types + ", sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, path: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; one row for each piece.

    Null and empty texts are documents of one token (end_id). Only documents of more than `capacity` tokens are cut. Null ids are
    packed like others, repeated rows each get a place, an empty table gives none. Columns beside id and text are ignored.
    """
    return places(written(pieces_of(docs, id_col, text_col, capacity, path, end_id, keep_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences (sequence_id, ids) of pack(..., keep_ids=True); a group is one sequence, so its size is bounded."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

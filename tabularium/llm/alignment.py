"""Alignment of two tokenizers over the bytes of a text.

Both tokenizers see a space and then the text. The spans that they report are coarse cuts: character offsets of one, byte spans of the other. Where tokens share a character, or are
single bytes that stand for part of one, the lengths of their decoded bytes say where they end. Places where tokens of both end cut the text into groups, and link the two tokens that end there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.chunks import Chunks, Grown, cuts, decoded, gather, runs
from tabularium.llm.common import kept, written

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Chunks that a worker keeps, and how many are encoded together.
CHUNKS, TOGETHER = 500_000, 512
#: Links that a task counts at once, and pairs that it counts before it hands them on.
LINKS, PAIRS = 1 << 22, 1 << 20
#: Pairs whose counts every task gets; the others' are joined.
FREQUENT = 1 << 19
#: How a piece writes a space.
MARK = "▁"


class ByteLevel:
    """A tokenizer of the tokenizers library with byte-level entries; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.bytes = [b""] * self.size
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = decoded(token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.cuts = cuts(self.bytes)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and the text, and the byte where each token ends, from character offsets; tokens that share a character end by their decoded bytes."""
        got = self.tokenizer.encode(f" {text}", add_special_tokens=False)
        ids = np.array(got.ids, np.int64)
        raw = np.frombuffer(f" {text}".encode(), np.uint8)
        chars = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # where each character begins
        begin, end = chars[np.array(got.offsets, np.int64).reshape(-1, 2)].T
        return ids, refined(begin, end, np.append(end[:-1] == begin[1:], True), self.lengths[ids])


class Pieces:
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        single = [self.model.is_byte(i) for i in range(self.size)]
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if one else p.replace(MARK, " ").encode() for p, one in zip(names, single, strict=True)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.single = np.array(single)
        self.cuts = cuts(p.replace(MARK, " ") for p in names)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the text, and the byte of a space and the text where each token ends, from the spans of the encoding's proto; single bytes end by their decoded bytes."""
        pieces = self.model.encode(text, return_type="proto").pieces
        ids = np.array([p.id for p in pieces], np.int64)
        begin = np.array([p.begin for p in pieces], np.int64) + 1
        end = np.array([p.end for p in pieces], np.int64) + 1
        begin[:1] = 0
        one = self.single[ids]
        return ids, refined(begin, end, np.append(~(one[:-1] & one[1:]) & ~one[:-1], True), self.lengths[ids])


def refined(begin: np.ndarray, end: np.ndarray, clean: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens: `end` where a cut is clean, else the begin of the run of tokens since the last clean cut and the decoded lengths in it."""
    first = np.append(True, clean[:-1])
    run = np.maximum.accumulate(np.where(first, np.arange(len(end)), 0))
    upto = np.cumsum(lengths)
    start = begin[run]
    # a run begins where the token before it ends
    start[run > 0] = end[run[run > 0] - 1]
    return np.where(clean & (run == np.arange(len(end))), end, start + upto - (upto - lengths)[run])


class Aligner:
    """What two tokenizers make of texts, chunk by chunk; chunks that come again are known."""

    def __init__(self, path_a: str, path_b: str, chunks: int = CHUNKS) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.names_a, self.names_b = [[str(i) for i in range(t.size)] for t in (self.a, self.b)]
        self.chunks = Chunks(self._learn, self._forget, chunks, not (self.a.cuts and self.b.cuts))

    def _forget(self) -> None:
        self.links, self.until = Grown(np.int64), Grown(np.int64)
        self.until.add(np.zeros(1, np.int64))
        self.n_a, self.n_b, self.good = Grown(np.int32), Grown(np.int32), Grown(bool)
        self.groups: list[bytes] = []

    def _aligned(self, chunks: list[str]) -> list[tuple[int, int, np.ndarray, bytes]] | None:
        """(n_a, n_b, linked pairs, groups as text) of each chunk, encoded together; None if the tokens' bytes aren't those of the text."""
        text = " ".join(chunks)
        (a, end_a), (b, end_b) = self.a.spans(text), self.b.spans(text)
        raw = f" {text}".encode()
        if b"".join([self.a.bytes[i] for i in a.tolist()]) != raw or b"".join([self.b.bytes[i] for i in b.tolist()]) != raw:
            return None
        _, in_a, in_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        pairs = a[in_a] * self.b.size + b[in_b]
        chunk_end = np.cumsum([len(c.encode()) + 1 for c in chunks])
        last = np.searchsorted(end_a[in_a], chunk_end, side="right")  # groups up to each chunk's end
        names_a, names_b = [self.names_a[i] for i in a.tolist()], [self.names_b[i] for i in b.tolist()]
        text_of, pa_, pb_ = [], 0, 0
        for qa, qb in zip((in_a + 1).tolist(), (in_b + 1).tolist(), strict=True):
            text_of.append(f"{','.join(names_a[pa_:qa])}|{','.join(names_b[pb_:qb])}")
            pa_, pb_ = qa, qb
        out, g, pa_, pb_ = [], 0, 0, 0
        for h in last.tolist():
            qa, qb = int(in_a[h - 1]) + 1, int(in_b[h - 1]) + 1
            out.append((qa - pa_, qb - pb_, pairs[g:h], ";".join(text_of[g:h]).encode()))
            g, pa_, pb_ = h, qa, qb
        return out

    def _learn(self, new: list[str], safe: np.ndarray) -> None:
        found: list = [None] * len(new)
        safe = safe & (not self.chunks.whole)
        alone = np.flatnonzero(~safe).tolist()
        for some in np.array_split(np.flatnonzero(safe), safe.sum() // TOGETHER + 1):
            some = some.tolist()
            todo = [some] if some else []
            while todo:  # where a chunk's bytes differ, halves are tried
                some = todo.pop()
                got = self._aligned([new[i] for i in some])
                if got is not None:
                    for i, x in zip(some, got, strict=True):
                        found[i] = x
                elif len(some) > 1:
                    todo += [some[: len(some) // 2], some[len(some) // 2 :]]
        for i in alone:
            got = self._aligned([new[i]])
            found[i] = got[0] if got else None
        none = (0, 0, np.zeros(0, np.int64), b"")
        full = [x or none for x in found]
        self.n_a.add(np.array([x[0] for x in full], np.int32))
        self.n_b.add(np.array([x[1] for x in full], np.int32))
        self.good.add(np.array([x is not None for x in found], bool))
        self.links.add(np.concatenate([x[2] for x in full]))
        self.until.add(self.until.data[self.until.n - 1] + np.cumsum([len(x[2]) for x in full]))
        self.groups += [x[3] for x in full]

    def align(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, str]]:
        """(n_a, n_b, linked pairs as a * size of b + b, SHA-256 of the groups) of each text; texts without tokens have zeros, no pairs and ''."""
        at, ends = self.chunks.numbers(texts)
        flat, cum = gather(self.links.data, self.until.data, at)
        n_a, n_b = (np.concatenate([[0], np.cumsum(x.data[at], dtype=np.int64)]) for x in (self.n_a, self.n_b))
        bad = np.concatenate([[0], np.cumsum(~self.good.data[at])])
        for text, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if bad[hi] > bad[lo] or (hi == lo + 1 and not text.as_py()):
                yield 0, 0, np.zeros(0, np.int64), ""
            else:
                digest = hashlib.sha256(b";".join([self.groups[k] for k in at[lo:hi].tolist()])).hexdigest()
                yield int(n_a[hi] - n_a[lo]), int(n_b[hi] - n_b[lo]), flat[cum[lo] : cum[hi]], digest


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs): each document's tokens, groups and links; pairs are the links' numbers as little-endian integers
    of 4 bytes, or of 8 where the vocabularies need them. row tells repeated documents apart."""
    path_a, path_b = path_a or public_tokenizers.path(BYTE_LEVEL), path_b or public_tokenizers.path(PIECES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        aligner = kept(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))
        kind = width(aligner.a.size * aligner.b.size)
        for batch in batches:
            for lo, n in runs(batch.column(1)):
                got = list(aligner.align(batch.column(1).slice(lo, n)))
                n_a, n_b, pairs, digest = zip(*got, strict=True)
                size = pa.array([len(p) for p in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + n), pa.int64()), batch.column(0).slice(lo, n), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), size, size, pa.array(digest), pa.array([p.astype(kind).tobytes() for p in pairs], pa.binary())],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
                )
                row += n

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(scan, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary")


def width(pairs: int) -> str:
    """The integers that number so many pairs."""
    return "<u4" if pairs <= 1 << 32 else "<i8"


def pair_counts(links: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair in all documents, and whether that is the most of its b."""
    kind = width(size_a * size_b)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            for i in range(0, len(flat), LINKS):
                some, k = np.unique(flat[i : i + LINKS], return_counts=True)
                both = np.concatenate([pair, some.astype(np.int64)])
                pair, back = np.unique(both, return_inverse=True)
                n = np.bincount(back, np.concatenate([n, k]), len(pair)).astype(np.int64)
                if len(pair) > PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    counted = links.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("b", F.col("pair") % size_b), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document, one row for each row.

    n_links: places where tokens of both end; a link's count is that of its pair of ids in all documents. n_best: links with the highest count of their b, ties included; count_sum: the counts' sum.
    Null and empty texts, and texts whose tokens' bytes aren't a space and the text, have zeros and ''. Ids must be numbers or null; repeated rows count each; an empty table gives no rows;
    other columns are ignored.

    Tasks get the counts of the most frequent pairs, `frequent` at most; documents' other pairs, each of which is rarer, meet their counts in a join.
    """
    path_a, path_b = path_a or public_tokenizers.path(BYTE_LEVEL), path_b or public_tokenizers.path(PIECES)
    size_a, size_b = ByteLevel(path_a).size, Pieces(path_b).size
    kind = width(size_a * size_b)
    links = written(linked(docs, id_col, text_col, path_a, path_b), "links")
    counts = written(pair_counts(links, size_a, size_b), "counts")
    # whole steps of counts, from the greatest down, as long as they are few enough
    step = F.floor(F.log2("n") * 64)
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(step).agg(F.count(F.lit(1))).collect()), reverse=True)
    upto = np.cumsum([k for _, k in steps])
    known = [s for (s, _), u in zip(steps, upto.tolist(), strict=True) if u <= frequent]
    least = known[-1] if known else None
    top = counts.where(step >= F.lit(least)) if known else counts.limit(0)
    table = top.toArrow()
    pair = table["pair"].to_numpy()
    order = np.argsort(pair)
    held = docs.sparkSession.sparkContext.broadcast((pair[order], table["n"].to_numpy()[order], table["best"].to_numpy()[order].astype(np.int64)))
    every = len(known) == len(steps)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            rows = []
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = np.frombuffer(data.as_py(), kind).astype(np.int64)
                at = np.minimum(np.searchsorted(pair, mine), max(0, len(pair) - 1))
                hit = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
                other, k = np.unique(mine[~hit], return_counts=True) if not every else (mine[:0], mine[:0])
                rows.append((row, int(n[at[hit]].sum()), int(best[at[hit]].sum()), other, k))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "count_sum", "n_best", "other", "times"])

    spark = docs.sparkSession
    plain = links.drop("pairs")
    schema = "row long, count_sum long, n_best long, other array<long>, times array<long>"
    if every:
        # a document's row stays with its links: no join
        names = plain.columns[1:]
        whole = links.select("row", "pairs", *names)

        def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (got,) = score(iter([batch]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), got.column(1), got.column(2)], names=[*names, "count_sum", "n_best"])

        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "row")
        out = whole.mapInArrow(complete, f"{types}, count_sum long, n_best long")
    else:
        part = written(links.select("row", "pairs").mapInArrow(score, schema), "scored")
        rare = part.select("row", F.explode(F.arrays_zip("other", "times")).alias("x")).select("row", F.col("x.other").alias("pair"), F.col("x.times").alias("times"))
        rest = rare.join(counts.where(step < F.lit(least)) if known else counts, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("s"), F.sum(F.col("best").cast("long") * F.col("times")).alias("k"))
        sums = part.select("row", "count_sum", "n_best").join(rest, "row", "left")
        sums = sums.select("row", (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"), (F.col("n_best") + F.coalesce("k", F.lit(0))).alias("n_best"))
        out = plain.join(sums, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents, aligned by both tokenizers."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

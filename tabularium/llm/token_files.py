"""Token ids in files of Simple-8b words.

A 64-bit word holds a selector in its upper four bits and 240 to 1 ids below it. Ids too wide for a word that suits their neighbours are escaped: the word holds the
width's greatest value, the block's list of escapes the id. Blocks of BLOCK ids begin with a word of their own; a file's tables say where each block's words and escapes and
each document's ids end, so any block is decoded alone, and all words of one selector at once.

A file, little-endian: MAGIC, then as uint64 the numbers of documents, ids, blocks, words and escapes; int64 document ids; int64 ends of the documents' ids; uint32 ends
of the blocks' words; uint32 ends of the blocks' escapes; uint64 words; uint32 escapes; uint8, 1 where a document's id is not null.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat
from operator import contains

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.llm.chunks import SPACE, Chunks, Grown, cuts, decoded, gather, runs
from tabularium.llm.common import kept, shared_dir, written

TOKENIZER = "byte_bpe_50k.json"

# fixed values: the selectors of Simple-8b, ids in a word and bits of each
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

#: Widths whose greatest value means: look in the escapes.
ESCAPED = range(5, 31)
#: Bits that an escape costs.
ESCAPE_BITS = 32
BLOCK = 1024
#: Blocks that are packed side by side.
SIDE = 1024
#: A file is closed at the first document's end after so many ids.
FILE_IDS = 1 << 21
MAGIC = b"TOKENS8B"


def _parted(need: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of blocks that are cut side by side: (block, place, selector) of each. need: a row for each block, the first selector that holds each id; sizes: ids of each block.

    Each word takes the selector that costs least bits for each id, escapes included.
    """
    blocks, wide = need.shape
    use = []
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        if width not in ESCAPED and count > 1:
            half = (count + 1) // 2
            flat = need.ravel()[: need.size // half * half]
            if not len(flat) or np.maximum.reduceat(flat, np.arange(0, len(flat), half)).min() > s:  # no such word fits anywhere
                continue
        use.append(s)
    # how many ids up to each place are too wide for each selector, four selectors in the 16-bit lanes of a number; ids beyond a block's end are never too wide
    count = np.array([COUNTS[s] for s in use])
    lanes = -(-len(use) // 4)
    upto = np.zeros((lanes, blocks, wide + 1 + int(count.max())), np.uint64)
    for k in range(lanes):
        flags = np.array([sum((x > s) << (16 * i) for i, s in enumerate(use[4 * k : 4 * k + 4])) for x in range(len(COUNTS) + 1)], np.uint64)
        np.cumsum(flags[need], axis=1, out=upto[k, :, 1 : wide + 1])
        upto[k, :, wide + 1 :] = upto[k, :, wide : wide + 1]
    across = upto.shape[2]
    upto = upto.view(np.uint16).ravel()
    # bits for each id, and what an escape adds; a selector without escapes holds no wider id
    fixed = (64 / count).astype(np.float32)[:, None]
    more = np.array([ESCAPE_BITS / c if WIDTHS[s] in ESCAPED or c == 1 else 1e9 for c, s in zip(count.tolist(), use, strict=True)], np.float32)[:, None]
    row = np.arange(blocks)
    at, end = np.zeros(blocks, np.int64), sizes.astype(np.int64)
    lane = np.arange(len(use))[:, None]
    base = ((lane // 4 * blocks + row) * across) * 4 + lane % 4
    step = 4 * count[:, None]
    found = []
    while len(row):
        lo = base + 4 * at
        odd = upto.take(lo + step) - upto.take(lo)
        left = end - at
        price = odd * more
        price += fixed
        few = np.flatnonzero(left < 16)  # a last word holds what is left of its block
        if len(few):
            price[:, few] = (odd[:, few] * (more * count[:, None]) + 64) / np.minimum(count[:, None], left[few])
        best = price.argmin(axis=0)
        found.append((row, at, best))
        at = at + count[best]
        going = at < end
        if not going.all():
            row, at, end, base = row[going], at[going], end[going], base[:, going]
    row, at, best = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, row))
    return row[order], at[order], np.array(use)[best[order]]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uint32 ids as (words, ends of blocks' words, escapes, ends of blocks' escapes)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    edges = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    limits = np.array([(1 << w) - (w in ESCAPED) for w in WIDTHS], np.uint64)
    common = np.searchsorted(limits, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
    need = np.zeros((blocks, BLOCK), np.uint8)
    need.ravel()[:n] = common[np.minimum(ids, np.uint32(0xFFFF))]
    large = np.flatnonzero(ids >= 0xFFFF)
    need.ravel()[large] = np.searchsorted(limits, ids[large].astype(np.uint64), side="right")
    firsts, kinds = [], []
    for k in range(0, blocks, SIDE):
        some = edges[k : k + SIDE]
        row, at, kind = _parted(need[k : k + SIDE], np.diff(some, prepend=k * BLOCK))
        firsts.append((row + k) * BLOCK + at)
        kinds.append(kind)
    first, kind = np.concatenate(firsts), np.concatenate(kinds)
    size = np.diff(first, append=n)
    words = kind.astype(np.uint64) << np.uint64(60)
    escaped = []
    for s in np.unique(kind).tolist():
        count, width = COUNTS[s], WIDTHS[s]
        if not width:
            continue
        mine = np.flatnonzero(kind == s)
        top = np.uint64((1 << width) - 1)
        for i in range(count):
            has = mine[size[mine] > i] if i else mine
            value = ids[first[has] + i].astype(np.uint64)
            if width in ESCAPED:
                out = value >= top
                if out.any():
                    escaped.append(first[has][out] + i)
                    value[out] = top
            words[has] |= value << np.uint64(width * i)
    places = np.sort(np.concatenate(escaped)) if escaped else np.zeros(0, np.int64)
    return words, np.searchsorted(first, edges).astype(np.uint32), ids[places].astype(np.uint32), np.searchsorted(places, edges).astype(np.uint32)


def unpack(words: np.ndarray, word_ends: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of whole blocks in a row, whose words and escapes begin with those given."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    size = np.array(COUNTS)[kind]
    # the last word of a block holds what is left of it
    last = word_ends.astype(np.int64) - 1
    cum = np.cumsum(size)
    before = np.concatenate([[0], cum[last[:-1]]])
    want = np.full(len(last), BLOCK)
    want[-1] = n - BLOCK * (len(last) - 1)
    size[last] -= cum[last] - before - want
    start = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    odd = []
    for s in np.unique(kind).tolist():
        count, width = COUNTS[s], WIDTHS[s]
        if not width:
            continue
        mine = np.flatnonzero(kind == s)
        there = np.arange(count) < size[mine, None]
        top = np.uint64((1 << width) - 1)
        value = ((words[mine, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & top)[there]
        where = (start[mine, None] + np.arange(count))[there]
        out[where] = value
        if width in ESCAPED:
            odd.append(where[value == top])
    if odd and len(escapes):
        places = np.sort(np.concatenate(odd))
        out[places] = escapes[: len(places)]
    return out


def to_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A file of documents and their ids in a row."""
    words, word_ends, escapes, escape_ends = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(word_ends), len(words), len(escapes)], "<u8")
    parts = (
        head, np.array([i or 0 for i in doc_ids], "<i8"), np.cumsum(np.array(sizes, "<i8")), word_ends.astype("<u4"), escape_ends.astype("<u4"), words.astype("<u8"), escapes.astype("<u4"),
        np.array([i is not None for i in doc_ids], np.uint8),
    )
    return MAGIC + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """A file's tables; ids are decoded when asked for."""

    def __init__(self, content: bytes) -> None:
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of tokens")
        docs, self.n_ids, blocks, words, escapes = (int(x) for x in np.frombuffer(content, "<u8", 5, len(MAGIC)))
        at = len(MAGIC) + 40

        def table(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        doc_ids, ends = table("<i8", docs), table("<i8", docs)
        self.ends = np.concatenate([[0], ends])
        self.word_ends, self.escape_ends, self.words, self.escapes = (table(k, n) for k, n in (("<u4", blocks), ("<u4", blocks), ("<u8", words), ("<u4", escapes)))
        self.doc_ids = [int(i) if known else None for i, known in zip(doc_ids, table("u1", docs), strict=True)]

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids from place lo to hi; only the blocks that hold them are decoded."""
        hi = self.n_ids if hi is None else hi
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = lo // BLOCK, -(-hi // BLOCK)
        w, e = (int(x[a - 1]) if a else 0 for x in (self.word_ends, self.escape_ends))
        out = unpack(self.words[w : self.word_ends[b - 1]], self.word_ends[a:b].astype(np.int64) - w, self.escapes[e : self.escape_ends[b - 1]], min(b * BLOCK, self.n_ids) - a * BLOCK)
        return out[lo - a * BLOCK : hi - a * BLOCK]


class TextIds:
    """Ids of texts by a byte-level tokenizer, a chunk at a time."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True
        self.chunks = Chunks(self._learn, self._forget, whole=not cuts(map(decoded, self.tokenizer.get_vocab())))

    def _forget(self) -> None:
        self.flat, self.until = Grown(np.uint32), Grown(np.int64)
        self.until.add(np.zeros(1, np.int64))
        self.heads: dict[str, np.ndarray] = {}

    def _learn(self, new: list[str], safe: np.ndarray) -> None:
        size = np.zeros(len(new), np.int64)
        parts = [np.zeros(0, np.uint32)]
        # tokens that begin with a space tell chunks apart where none has a space inside
        safe = safe & (not self.chunks.whole) & ~np.fromiter(map(contains, new, repeat(" ")), bool, len(new))
        for some in np.array_split(np.flatnonzero(safe), safe.sum() // 512 + 1):
            if len(some):
                ids = np.array(self._ids(" " + " ".join([new[i] for i in some.tolist()])), np.uint32)
                size[some] = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
                parts.append(ids)
        for i in np.flatnonzero(~safe).tolist():
            ids = np.array(self._ids(f" {new[i]}"), np.uint32)
            size[i] = len(ids)
            parts.append(ids)
        order = np.argsort(~safe, kind="stable")  # how the chunks' ids lie in parts
        back = np.argsort(order)
        flat = np.concatenate(parts)
        ends = np.concatenate([[0], np.cumsum(size[order])])
        self.flat.add(gather(flat, ends, back)[0])
        self.until.add(self.until.data[self.until.n - 1] + np.cumsum(size))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids; a text's first chunk has no space before it."""
        at, ends = self.chunks.numbers(texts)
        flat, cum = gather(self.flat.data, self.until.data, at)
        out = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            first = self.chunks.names[at[lo]]
            head = self.heads.get(first)
            if head is None:
                head = self.heads[first] = np.array(self._ids(first), np.uint32)
            out.append(np.concatenate([head, flat[cum[lo + 1] : cum[hi]]]))
        return out


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes every document's ids and then end_id to files in `folder`, in ascending order of ids (nulls first, repeated ids in order of a hash of their texts);
    returns (name, part, file, n_docs, n_ids, start): the files, and how many ids come before each.

    Ids must be numbers, or text that is one (others raise an error, by the cast to long). A null or empty text is end_id alone. Other columns are ignored, an empty table gives no file.
    The folder is one that pyarrow can reach from the tasks (file, hdfs, s3, gs). A file is written under a name of its own and then moved, and a task that runs again
    writes the same bytes, so lost executors leave the folder whole. A document is never parted: a file has at most `file_ids` ids more than its last document.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        coder = kept(("token files", path), lambda: TextIds(path))
        done = 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, held, size, done
            name = f"part-{part:06d}-{done:06d}.s8b"
            mine = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(mine) as f:
                f.write(to_bytes(doc_ids, [len(x) for x in held], np.concatenate(held)))
            fs.move(mine, f"{root}/{name}")
            out = pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([part], pa.int32()), "file": pa.array([done], pa.int32()), "n_docs": [len(held)], "n_ids": [size]})
            doc_ids, held, size, done = [], [], 0, done + 1
            return out

        for batch in batches:
            for lo, n in runs(batch.column(1)):
                got = coder.encode(batch.column(1).slice(lo, n))
                for i, ids in zip(batch.column(0).slice(lo, n).to_pylist(), got, strict=True):
                    doc_ids.append(i)
                    held.append(np.append(ids, np.uint32(end_id)))
                    size += len(ids) + 1
                    if size >= file_ids:
                        yield close()
        if held:
            yield close()

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    # ties of id and text are dealt by their place, so that many copies of a row don't meet in one task
    keyed = rows.withColumns({"h": F.xxhash64("t"), "k": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(F.asc_nulls_first("i"), "h", "k").sortWithinPartitions(F.asc_nulls_first("i"), "h", "k").select("i", "t")
    files = written(ordered.mapInArrow(put, "name string, part int, file int, n_docs long, n_ids long"), "files")
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    return files.join(parts, "part").select("name", "part", "file", "n_docs", "n_ids", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("start"))


def read_ids(spark: SparkSession, folder: str, files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of `folder`, decoded from them; `files` as write_ids returns it."""
    names = ["name", "doc_id", "before", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(content.as_py())
                for d in range(0, len(file.doc_ids), 4096):
                    last = min(d + 4096, len(file.doc_ids))
                    base = file.ends[d]
                    ids = file.ids(base, file.ends[last])
                    rows = []
                    for k in range(d, last):
                        some = ids[file.ends[k] - base : file.ends[k + 1] - base]
                        rows.append((name, file.doc_ids[k], int(file.ends[k]), len(some), zlib.crc32(some.astype("<u4").tobytes()), some))
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[: len(names)], kinds, strict=False)], names=names)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    got = raw.mapInArrow(take, "name string, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)
    return got.join(files.select("name", F.col("start").alias("first")), "name").select("doc_id", (F.col("first") + F.col("before")).alias("start"), *names[3:])


def op13_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written to files in the shared folder and read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files = written(write_ids(docs, folder), "starts")
    return read_ids(spark, folder, files)

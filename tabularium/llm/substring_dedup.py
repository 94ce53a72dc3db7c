"""Repeated passages: the de Bruijn graph of token k-mers, compacted at minimizers and through Spark joins.

A window of k words is an edge of the graph; its first and last k-1 words are the nodes that it leads from and to.

1. Consecutive windows of a document that share their minimizer (the least hash of the m-word grams in a window) form a *run*. Equal
   windows have equal minimizers wherever they stand, so a minimizer that is seen in one document only has nothing repeated: most of the
   text ends here. Runs of equal contents are one edge of several windows. Where several contents meet at one
   minimizer, the runs are taken apart into single windows, once for each content, and counted window by window.
2. Each repeated edge gets the smallest document that holds it (its owner) and its source coordinates there. A table of nodes counts the
   repeated edges that lead to and from each node. A node with one of each does not branch; if both have the same owner, where
   the one follows the other, they are one path. All links of paths are found in this one aggregate over the nodes; since a path is
   consecutive in its owner's text, ordering the edges by source coordinates then compacts every path whole, however long it is.
3. Every run and window in a later document is joined to its edge and path, and what follows one path without a gap is one span.
4. The words of each span at its source coordinates are digested (SHA-256), and a document loses a span only if its own words there have
   the same digest.

Hashes of windows have 128 bits, those of nodes 64: two nodes that collide look like a branch, which only cuts a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabularium.llm.common import Hashes, bloom, in_bloom, in_slices, mix, plain_names, split_words, written

#: Words of a minimizer gram, for windows of 50.
GRAM = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _inverse(m: np.uint64) -> np.uint64:
    return np.uint64(pow(int(m), -1, 1 << 64))


class Prefix:
    """Polynomial prefix sums modulo 2**64: fingerprints of any range of words."""

    def __init__(self, h: np.ndarray, m: np.uint64) -> None:
        n = len(h)
        with np.errstate(over="ignore"):
            up = np.full(n + 1, m, np.uint64)
            up[0] = 1
            up = np.multiply.accumulate(up)
            self.down = np.full(n + 1, _inverse(m), np.uint64)
            self.down[0] = 1
            self.down = np.multiply.accumulate(self.down)
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(h * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _M1)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive numbers."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Runs:
    """The runs of all texts of a slice. h1, h2: word hashes of all texts in a row; ends: where each text's words begin."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, ends: np.ndarray, k: int, m: int) -> None:
        n = len(h1)
        self.k, self.p1, self.p2 = k, Prefix(h1, _M1), Prefix(h2, _M2)
        at = np.arange(max(n - m + 1, 0))
        starts = np.arange(max(n - k + 1, 0))
        least = window_min(self.p1.of(at, at + m), k - m + 1) if len(starts) else starts  # of the window that starts at each word, over text borders too
        text = np.searchsorted(ends, starts, side="right") - 1
        good = starts + k <= ends[text + 1]
        starts, text, least = starts[good], text[good], least[good]
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.count = np.diff(np.append(first, len(starts)))
        self.begin, self.text, self.least = starts[first], text[first], least[first]
        self.place = self.begin - ends[self.text]

    def columns(self) -> list[np.ndarray]:
        """Minimizer, two fingerprints, windows, first and last node of each run."""
        a, b = self.begin, self.begin + self.count - 1 + self.k
        u = lambda x: x.view(np.int64)
        return [u(self.least), u(self.p1.of(a, b)), u(self.p2.of(a, b)), self.count.astype(np.int32), u(self.p2.of(a, a + self.k - 1)), u(self.p2.of(b - self.k + 1, b))]

    def windows(self, some: np.ndarray) -> list[pa.Array]:
        """Two fingerprints of each window of these runs, and the nodes along them."""

        def lists(n: np.ndarray, *parts: Callable[[np.ndarray], np.ndarray]) -> list[pa.Array]:
            before = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(self.begin[some] - before[:-1], n) + np.arange(before[-1])
            return [pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(f(at).view(np.int64))) for f in parts]

        n = self.count[some]
        fingerprints = lists(n, lambda at: self.p1.of(at, at + self.k) ^ np.uint64(1), lambda at: self.p2.of(at, at + self.k))
        return fingerprints + lists(n + 1, lambda at: self.p2.of(at, at + self.k - 1))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, base) of the rows that take part."""
    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).where("doc is not null and text is not null")
    return some.withColumn("base", _base("text"))


def _base(text: str) -> Column:
    """A row's place: 30 bits of its text's hash above, room for a word's position below. Rows that share an id are kept apart by it."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 34), 32)


def _scan(docs: DataFrame, k: int, m: int, branches: np.ndarray | None = None) -> DataFrame:
    """All runs of all texts; with a Bloom filter of minimizers, the runs of these with the hashes of their windows and nodes."""
    held = docs.sparkSession.sparkContext.broadcast(branches)
    names = ["v", "c", "c2", "doc", "at", *(["n", "head", "tail"] if branches is None else ["w1", "w2", "nodes"])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = Hashes(11), held.value
        for batch in batches:
            ids, base = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, texts in in_slices(batch.column(1)):
                words, ends = split_words(texts)
                h = known.of(words)
                runs = Runs(h, mix(h ^ _M2), ends, k, m)
                v, c, c2, n, head, tail = runs.columns()
                some = np.arange(len(v)) if wanted is None else np.flatnonzero(in_bloom(wanted, v))
                if len(some):
                    where = [ids[lo:hi][runs.text[some]], base[lo:hi][runs.text[some]] + runs.place[some]]
                    more = [n, head, tail] if wanted is None else runs.windows(some)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[some], c[some], c2[some], *where)] + [pa.array(x) for x in more], names=names)

    more = "n int, head long, tail long" if branches is None else "w1 array<long>, w2 array<long>, nodes array<long>"
    return docs.mapInArrow(scan, f"v long, c long, c2 long, doc long, at long, {more}")


def compacted(edges: DataFrame) -> DataFrame:
    """Adds path (where in the owner's text the edge's path begins) to repeated edges: owner, src (source coordinate), n (windows), head, tail.

    A path is a chain of edges over nodes that one repeated edge leads to and one leads from, both with the same owner and consecutive there.
    """
    into = edges.select(F.col("tail").alias("node"), F.lit(1).alias("ins"), F.lit(0).alias("outs"), F.col("owner").alias("o1"), (F.col("src") + F.col("n")).alias("a1"), F.lit(None).cast("long").alias("o2"), F.lit(None).cast("long").alias("a2"))
    out = edges.select(F.col("head").alias("node"), F.lit(0), F.lit(1), F.lit(None), F.lit(None), F.col("owner"), F.col("src"))
    nodes = into.union(out).groupBy("node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), *(F.max(c).alias(c) for c in ("o1", "a1", "o2", "a2")))
    links = nodes.where("ins = 1 and outs = 1 and o1 = o2 and a1 = a2").select(F.col("o2").alias("owner"), F.col("a2").alias("src"), F.lit(True).alias("linked"))
    along = Window.partitionBy("owner", F.shiftright("src", 32)).orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.select("owner", "src", "n").join(links, ["owner", "src"], "left").select("owner", "src", F.last(F.when(F.col("linked").isNull(), F.col("src")), ignorenulls=True).over(along).alias("path"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, m: int | None = None) -> DataFrame:
    """Spans of words that lie in k-word windows whose words also start in a document with a smaller id, with their source.

    Returns (doc, at, words, owner, src): `words` words from place `at` of the document equal those from place `src` of the owner; a
    place is the word's position below 32 bits of the text's hash. Null ids and texts take no part; a window that repeats only within its own document is not
    repeated, nor one that repeats in rows of the same id. Spans of one document may overlap.
    """
    m = m or min(GRAM, max(1, k // 3))
    docs = _keyed(docs, id_col, text_col)
    runs = written(_scan(docs, k, m), "runs")
    shared = runs.groupBy("v").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("v")
    kept = written(runs.join(shared, "v", "left_semi"), "shared-runs")
    contents = kept.groupBy("v", "c", "c2").agg(F.min("doc").alias("owner"), F.min_by("at", "doc").alias("src"), F.max("doc").alias("last"), *(F.min(c).alias(c) for c in ("n", "head", "tail")))
    contents = written(contents, "contents")
    branch = written(contents.groupBy("v").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("v"), "branches")
    # branches: window by window, once for each content, where the document that owns it has it
    owners = contents.join(branch, "v", "left_semi").select("v", "c", "c2", F.col("owner").alias("doc"), "last")
    windows = _scan(docs, k, m, bloom(branch, "v")).join(owners, ["v", "c", "c2", "doc"])
    j = F.col("j")
    single = windows.select("doc", "at", "last", "nodes", F.posexplode(F.arrays_zip("w1", "w2")).alias("j", "w"))
    single = written(single.select(F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"), "doc", (F.col("at") + j).alias("at"), "last", F.col("nodes")[j].alias("head"), F.col("nodes")[j + 1].alias("tail")), "windows")
    once = single.groupBy("w1", "w2").agg(F.min("doc").alias("owner"), F.min_by("at", "doc").alias("src"), F.max("last").alias("last"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    once = written(once.where("owner < last").drop("last"), "edges")
    whole = contents.where("owner < last")
    edges = whole.join(branch, "v", "left_anti").select("owner", "src", "n", "head", "tail").unionByName(once.select("owner", "src", F.lit(1).alias("n"), "head", "tail"))
    paths = written(compacted(edges), "paths")
    # where later documents hold an edge: whole runs, and the windows of runs that are first of their content
    where = ["doc", "at", "n", "owner", "src"]
    held = kept.select("v", "c", "c2", "doc", "at", "n").join(whole.select("v", "c", "c2", "owner", "src"), ["v", "c", "c2"]).where("doc > owner").select(*where)
    parts = single.select("w1", "w2", "doc", "at").join(once.select("w1", "w2", "owner", "src"), ["w1", "w2"]).where("doc > owner").select("doc", "at", F.lit(1).alias("n"), "owner", "src")
    found = held.unionByName(parts).join(paths, ["owner", "src"], "left")
    # what follows a path (or, in a run taken apart elsewhere, its owner) without a gap
    along = Window.partitionBy("doc", "owner", "path", F.col("at") - F.col("src")).orderBy("at")
    found = found.withColumn("new", F.coalesce(F.lag(F.col("at") + F.col("n")).over(along) != F.col("at"), F.lit(True)))
    found = found.withColumn("part", F.sum(F.col("new").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.groupBy("doc", "owner", "path", (F.col("at") - F.col("src")).alias("apart"), "part").agg(F.min("at").alias("at"), (F.sum("n") + (k - 1)).cast("int").alias("words"), F.min("src").alias("src")).select("doc", "at", "words", "owner", "src")


def _stream(docs: DataFrame, marks: DataFrame, text_first: bool, task, schema: str) -> DataFrame:
    """Texts (doc, base, text, ...) and marks (doc, base, mark) of the same row meet in a sorted stream: task sees one row and then the other, and collects no more than it needs."""
    both = docs.withColumn("order", F.lit(0 if text_first else 1)).unionByName(marks.withColumn("order", F.lit(1 if text_first else 0)), allowMissingColumns=True)
    return both.repartition("doc", "base").sortWithinPartitions("doc", "base", "order").mapInArrow(task, schema)


def _may(held, column: pa.Array) -> np.ndarray:
    return in_bloom(held.value, column.fill_null(0).to_numpy(zero_copy_only=False)) & ~np.asarray(column.is_null())


def _only(held, name: str):
    """The rows whose id a Bloom filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may(held, batch.column(name))))

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def with_digests(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds digest to spans: SHA-256 of the words at the source coordinates."""
    asked = written(spans.select("owner", "src", "words").distinct(), "sources")
    held = docs.sparkSession.sparkContext.broadcast(bloom(asked, "owner"))
    texts = _keyed(docs, id_col, text_col)
    marks = asked.select(F.col("owner").alias("doc"), F.shiftleft(F.shiftright("src", 32), 32).alias("base"), F.struct("src", "words").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words = None, []
        for batch in batches:
            out = []
            doc, base, marks = (batch.column(c).to_pylist() for c in ("doc", "base", "mark"))
            for lo, hi, texts in in_slices(batch.column("text")):
                for d, b, t, mark in zip(doc[lo:hi], base[lo:hi], texts, marks[lo:hi], strict=True):
                    if mark is None:
                        key, words = (d, b), t.split()
                    elif key == (d, b):
                        a = mark["src"] - b
                        out.append((d, mark["src"], mark["words"], _digest(words[a : a + mark["words"]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["owner", "src", "words", "digest"])

    texts = texts.select("doc", "base", "text").mapInArrow(_only(held, "doc"), "doc long, base long, text string")
    digests = _stream(texts, marks, True, run, "owner long, src long, words int, digest binary")
    return spans.join(written(digests, "digests"), ["owner", "src", "words"])


def _kept(words: list[bytes], spans: list[tuple[int, int, bytes]]) -> list[bytes]:
    """The words outside all spans whose words have the digest."""
    edge = np.zeros(len(words) + 1, np.int64)
    for a, n, digest in spans:
        if _digest(words[a : a + n]) == digest:
            edge[a] += 1
            edge[a + n] -= 1
    return [w for w, gone in zip(words, (np.cumsum(edge) > 0).tolist(), strict=False) if not gone]


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs without the words in spans (see `with_digests`).

    digest=False: docs' columns, with the text's kept words joined by one space where any were removed (else the text as it is).
    digest=True: (id, n_words long, n_removed long, kept_sha256 string) in place of the other columns.
    Texts without spans are not shuffled: a Bloom filter of the ids with spans is asked first.
    """
    spans = written(spans.select("doc", F.shiftleft(F.shiftright("at", 32), 32).alias("base"), F.struct((F.col("at") - F.shiftleft(F.shiftright("at", 32), 32)).cast("int").alias("a"), F.col("words").alias("n"), "digest").alias("mark")), "spans")
    held = docs.sparkSession.sparkContext.broadcast(bloom(spans.select("doc"), "doc"))
    if digest:
        docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        id_col, text_col = "id", "text"
    given, text_at, id_at = docs.columns, docs.columns.index(text_col), docs.columns.index(id_col)
    docs = plain_names(docs)
    names, id_col, text_col = docs.columns, docs.columns[id_at], docs.columns[text_at]
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" if digest else docs.schema

    def result(columns: list[pa.Array], texts: list[bytes | None], spans: list[list]) -> pa.RecordBatch:
        """Rows with the spans of each."""
        if not digest:
            out = []
            for t, s in zip(texts, spans, strict=True):
                words = t.split() if t and s else []
                left = _kept(words, s)
                out.append(b" ".join(left) if len(left) < len(words) else t)
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if i == text_at else c for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays(columns, names=names)
        n, gone, sha = [], [], []
        for t, s in zip(texts, spans, strict=True):
            words = t.split() if t else []
            left = _kept(words, s) if s else words
            n.append(len(words))
            gone.append(len(words) - len(left))
            sha.append(_digest(left).hex())
        return pa.RecordBatch.from_arrays([columns[id_at], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~_may(held, batch.column(id_at))))
            for lo, hi, texts in in_slices(batch.column(text_at)):
                yield result(batch.slice(lo, hi - lo).columns, texts, [[]] * (hi - lo))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spans = None, []
        for batch in batches:
            rows, here, found = batch.column("row"), [], []
            marks = batch.column("mark").to_pylist()
            for i, (d, b) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("base").to_pylist(), strict=True)):
                if (d, b) != key:
                    key, spans = (d, b), []
                if marks[i] is not None:
                    spans.append((marks[i]["a"], marks[i]["n"], marks[i]["digest"]))
                else:
                    here.append(i)
                    found.append(spans)
            if here:
                rows = rows.take(pa.array(here))
                columns = [rows.field(i) for i in range(len(names))]
                for lo, hi, texts in in_slices(columns[text_at]):
                    yield result([c.slice(lo, hi - lo) for c in columns], texts, found[lo:hi])

    rest = docs.mapInArrow(plain, schema)
    some = docs.mapInArrow(_only(held, id_col), docs.schema).select(F.col(f"`{id_col}`").cast("long").alias("doc"), _base(f"`{text_col}`").alias("base"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    out = rest.unionByName(_stream(some, spans, False, cut, schema))
    return out if digest else out.toDF(*given)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, digest: bool = False) -> DataFrame:
    """Removes each word that a window of k consecutive words covers whose words also start in a document with a smaller id.

    Windows are judged on the input. Null and empty texts, and texts of fewer than k words, stay as they are; so do rows with a
    null id. Rows that share an id are one document, which takes nothing from itself; each of them loses what repeats in its own text. Further columns pass through; an
    empty table gives none. Result: see `cut_spans`.
    """
    spans = written(repeated_spans(docs, id_col, text_col, k), "found")
    out = cut_spans(docs, with_digests(docs, spans, id_col, text_col), id_col, text_col, digest)
    return out.withColumnRenamed("id", id_col) if digest else out


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents' words, those removed, and the digest of the kept words, for windows of 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, digest=True)

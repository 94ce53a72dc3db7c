"""Benchmark decontamination by spaced seeds: hits of fixed masks, verified as substitution-tolerant overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import CACHE, as_bytes, bloom, in_bloom, in_slices, mix, plain_names, random_words, release, split_words

#: Token positions that count (1) and that may differ (0). One of MASKS lies on equal tokens in each run of OVERLAP tokens or more of which
#: NEEDED of PARTS are equal (one of 26 or more has such a half); one of SHORT[n] does so in each match of a whole item of n tokens.
MASKS = ("111111", "11101011", "1101011001", "11001000111")
SHORT = {5: ("1111", "11011", "11101", "10111"), 6: ("1111", "11011"), 7: ("11011",), 8: ("1111",), 9: ("111011",), 10: ("1111", "11101"), 11: ("11101",), 12: ("1111",)}
#: Shortest overlap in tokens (an item with fewer must overlap whole), least share of equal tokens (NEEDED of PARTS), and the
#: least tokens of an item: shorter items are matched by nothing, unless asked for.
OVERLAP, NEEDED, PARTS, SHORTEST = 13, 4, 5, 5
#: Benchmark bytes up to which it is sent to every task; a larger one is joined by its seeds' hashes instead.
BROADCAST_BYTES = 8 << 20


class Tokens(dict):
    """Word (bytes) -> hash of its letters and digits in lower case; 0 for a word without any. Bounded."""

    def __init__(self) -> None:
        release()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode("utf-8", "replace").lower()
        if not text.isalnum():
            text = "".join(filter(str.isalnum, text))
        h = self[word] = (xxhash.xxh64_intdigest(text) | 1) if text else 0
        return h


def tokens_of(texts: list[bytes | None], cache: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, where each text's tokens begin, and each token's word position in its text."""
    words, ends = split_words(texts)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    there = h != 0
    before = np.concatenate([[0], np.cumsum(there)])
    place = np.arange(len(h)) - np.repeat(ends[:-1], np.diff(ends))
    return h[there], before[ends], place[there]


def masks_for(lengths: np.ndarray, shortest: int = SHORTEST) -> tuple[list[np.ndarray], dict[int, list[int]]]:
    """The positions of all masks that items of these lengths need, and for each length which masks its items are sought by (none for items too short)."""
    own = {n: ("1" * n,) if n < 5 else SHORT.get(n, MASKS) for n in sorted({int(x) for x in lengths if x >= max(shortest, 1)})}
    names = sorted({m for ms in own.values() for m in ms})
    return [np.flatnonzero([c == "1" for c in m]) for m in names], {n: [names.index(m) for m in ms] for n, ms in own.items()}


def seeds(h: np.ndarray, mask: np.ndarray, number: int) -> np.ndarray:
    """The hash of the mask's tokens at every position."""
    n = len(h) - int(mask[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, mix(np.array([number + 1], np.uint64)), np.uint64)
    with np.errstate(over="ignore"):
        for i, m in zip(mask, random_words(len(mask), 31), strict=True):
            out += h[i : i + n] * m
    return mix(out)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The best run of tokens with doc[shift + j] against item[j]: (first j, tokens, equal tokens), or None if there is no overlap.

    Any run of OVERLAP tokens or more (the whole item, if that is shorter) of which NEEDED of PARTS are equal is an overlap. Best: most equal tokens,
    then the first; without differing tokens at its ends as far as the least length allows.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    least = min(OVERLAP, len(item))
    if hi - lo < least:
        return None
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    equal = np.concatenate([[0], np.cumsum(same)])
    above = equal * PARTS - np.arange(len(equal)) * NEEDED  # a run qualifies where this doesn't fall
    last = np.arange(least, len(equal))
    first = np.searchsorted(-np.minimum.accumulate(above), -above[last], "left")  # the smallest begin that qualifies
    gain = np.where(last - first >= least, equal[last] - equal[first], -1)
    k = int(gain.argmax())
    if gain[k] < 0:
        return None
    a, b, n = int(first[k]), int(last[k]), int(gain[k])
    there = np.flatnonzero(same[a:b])
    start, end = a + int(there[0]), a + int(there[-1]) + 1
    if end - start < least:
        start = min(start, b - least)
        end = start + least
    return lo + start, end - start, n


Items = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]  # sorted seeds, the item and place of each, masks, items' tokens
Hit = tuple[int, int, int, int, int, int, int, float]  # row, item, word_start, word_end, item_start, n_tokens, n_equal, coverage


def _verified(texts: dict[int, np.ndarray], places: dict[int, np.ndarray], who: np.ndarray, item: np.ndarray, shift: np.ndarray, items: list[np.ndarray]) -> list[Hit]:
    """One row for each text and item that overlap: their overlap with the most equal tokens, then the fewest tokens, then the first."""
    best: dict[tuple, tuple] = {}
    for d, i, s in zip(who.tolist(), item.tolist(), shift.tolist(), strict=True):
        got = overlap(texts[d], items[i], s)
        if got and ((d, i) not in best or best[d, i][0] < (got[2], -got[1], -s)):
            best[d, i] = ((got[2], -got[1], -s), int(places[d][got[0] + s]), int(places[d][got[0] + s + got[1] - 1]) + 1, *got)
    return [(d, i, *b[1:], b[-1] / len(items[i])) for (d, i), b in sorted(best.items())]


COLUMNS = ("word_start int", "word_end int", "item_start int", "n_tokens int", "n_equal int", "coverage double")
KINDS = (pa.int32(),) * 5 + (pa.float64(),)


def _prepared(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text) and (item_id, item) that take part, each item's text once, and the items' bytes."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("item")).where("item_id is not null and item is not null").distinct()
    return docs, items, items.agg(F.coalesce(F.sum(F.octet_length("item") + 8), F.lit(0))).first()[0]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, shortest: int = SHORTEST) -> DataFrame:
    """Documents that overlap benchmark items: one row for each row of docs and item, with the overlap of the most equal tokens.

    Tokens are words without anything but letters and digits, in lower case. Columns: doc_id, item_id, word_start, word_end
    (words of the document), item_start, n_tokens, n_equal and coverage (equal tokens over the item's tokens). Items of fewer than `shortest` tokens
    match nothing; of those of fewer than 5 tokens, all tokens must be equal. Null ids and texts and empty texts match nothing. Rows are judged each by its own text, also those that share an id:
    a repeated row of docs gives its rows again, a repeated row of the benchmark doesn't. Ids may be of any type; other columns don't matter. A benchmark of up to
    `broadcast_bytes` goes to every task, a larger one is joined by its seeds; both give the same rows.
    """
    docs, items, size = _prepared(docs, benchmark, id_col, text_col, item_col, item_text)
    schema = ", ".join((f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", f"item_id {items.schema['item_id'].dataType.simpleString()}", *COLUMNS))
    return _by_broadcast(docs, items, shortest, schema) if size <= broadcast_bytes else _by_join(docs, items, shortest).select("doc_id", "item_id", *(c.split()[0] for c in COLUMNS))


def _sorted_items(items: DataFrame, shortest: int) -> tuple[list, Items]:
    """The items' ids, and their seeds in order (BROADCAST_BYTES bounds them)."""
    rows = items.orderBy("item_id", "item").collect()
    h, ends, _ = tokens_of([r["item"].encode() for r in rows], Tokens())
    texts = [h[ends[k] : ends[k + 1]] for k in range(len(rows))]
    masks, own = masks_for(np.diff(ends), shortest)
    keys, who, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at, t in enumerate(texts):
        for number in own.get(len(t), ()):
            s = seeds(t, masks[number], number)
            keys.append(s)
            who.append(np.full(len(s), at, np.int32))
            place.append(np.arange(len(s), dtype=np.int32))
    keys, who, place = (np.concatenate(x) for x in (keys, who, place))
    order = np.argsort(keys, kind="stable")
    return [r["item_id"] for r in rows], (keys[order], who[order], place[order], masks, texts)


class Search:
    """Finds the items' overlaps in texts, in a task."""

    def __init__(self, items: Items) -> None:
        self.items = items
        self.bits = np.zeros(1 << 22, bool)
        self.low = np.uint64(len(self.bits) - 1)
        self.bits[(items[0] & self.low).astype(np.int64)] = True
        self.cache = Tokens()

    def of(self, raw: list[bytes | None]) -> list[Hit]:
        """The overlaps of some texts, by row."""
        keys, who, place, masks, items = self.items
        if not len(keys):
            return []
        h, ends, places = tokens_of(raw, self.cache)
        found = []
        for number, mask in enumerate(masks):
            s = seeds(h, mask, number)
            at = np.flatnonzero(self.bits[(s & self.low).astype(np.int64)])
            a, b = np.searchsorted(keys, s[at], "left"), np.searchsorted(keys, s[at], "right")
            at, a, n = at[b > a], a[b > a], (b - a)[b > a]
            if len(at):
                pick = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pos = np.repeat(at, n)
                doc = np.searchsorted(ends, pos, side="right") - 1
                whole = pos + int(mask[-1]) < ends[doc + 1]
                found.append(np.stack([doc, who[pick], pos - ends[doc] - place[pick]])[:, whole])
        if not found or not (hits := np.unique(np.concatenate(found, axis=1), axis=1)).shape[1]:
            return []
        some = np.unique(hits[0]).tolist()
        return _verified({d: h[ends[d] : ends[d + 1]] for d in some}, {d: places[ends[d] : ends[d + 1]] for d in some}, *hits, items)


def _by_broadcast(docs: DataFrame, items: DataFrame, shortest: int, schema: str) -> DataFrame:
    """The benchmark's seeds, sorted, go to every task."""
    ids, sorted_items = _sorted_items(items, shortest)
    held = docs.sparkSession.sparkContext.broadcast((ids, sorted_items))
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = held.value
        search = Search(items)
        for batch in batches:
            for lo, hi, texts in in_slices(batch.column(1)):
                if hits := search.of(texts):
                    row, item, *rest = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array([ids[i] for i in item]), *map(pa.array, rest, KINDS)], names=names)

    return docs.mapInArrow(scan, schema)


def _by_join(docs: DataFrame, items: DataFrame, shortest: int) -> DataFrame:
    """Both sides' seeds meet in a shuffled join; a Bloom filter keeps most training seeds out of it. Adds own, a hash of the document's text."""
    docs = docs.withColumn("own", F.xxhash64("text"))
    items = items.withColumn("which", F.xxhash64("item"))
    doc_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id")))
    lengths = items.select(F.col("item_id").alias("id"), F.col("item").alias("text")).mapInArrow(_lengths, "n int").select(F.least("n", F.lit(OVERLAP)).alias("n")).distinct().collect()  # a few numbers
    masks, own = masks_for(np.array([r["n"] for r in lengths]), shortest)
    ours = items.select("item_id", "item", "which").mapInArrow(_emit(masks, own, None), f"id {item_type}, which long, place int, h long").select(F.col("id").alias("item_id"), "which", F.col("place").alias("item_place"), "h")
    bits = docs.sparkSession.sparkContext.broadcast(bloom(ours, "h", 1 << 18))
    theirs = docs.select("doc_id", "text", "own").mapInArrow(_emit(masks, None, bits), f"id {doc_type}, which long, place int, h long").select(F.col("id").alias("doc_id"), F.col("which").alias("own"), "place", "h")
    hits = theirs.join(ours, "h").select("doc_id", "own", "item_id", "which", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    pairs = hits.groupBy("doc_id", "own", "item_id", "which").agg(F.collect_list("shift").alias("shifts"))  # at most as many as both have tokens
    rows = docs.join(pairs, ["doc_id", "own"]).join(items, ["item_id", "which"]).select("doc_id", "own", "text", "item_id", "item", "shifts")
    names = ["doc_id", "own", "item_id", *(c.split()[0] for c in COLUMNS)]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        for batch in batches:
            out, kept = [], []
            for k, (t, x, s) in enumerate(zip(as_bytes(batch.column(2)), as_bytes(batch.column(4)), batch.column(5).to_pylist(), strict=True)):
                h, _, place = tokens_of([t], cache)
                g, _, _ = tokens_of([x], cache)
                got = _verified({0: h}, {0: place}, np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.array(s), [g])
                out += [r[2:] for r in got]
                kept += [k] * len(got)
            if kept:
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 1, 3)), *map(pa.array, zip(*out, strict=True), KINDS)], names=names)

    return rows.mapInArrow(verify, f"doc_id {doc_type}, own long, item_id {item_type}, " + ", ".join(COLUMNS))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, ends, _ = tokens_of(as_bytes(b.column(1)), Tokens())
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends).astype(np.int32))], names=["n"])


def _emit(masks: list[np.ndarray], own: dict[int, list[int]] | None, bits):
    """Seeds (id, text's hash, token position, hash) of all texts; own: the texts are items, and each is seen by the masks of its length alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Tokens()
        for batch in batches:
            for lo, hi, texts in in_slices(batch.column(1)):
                h, ends, _ = tokens_of(texts, cache)
                n = np.diff(ends)
                for number, mask in enumerate(masks):
                    s = seeds(h, mask, number)
                    pos = np.arange(len(s))
                    if bits is not None:
                        pos = np.flatnonzero(in_bloom(bits.value, s.view(np.int64)))
                    doc = np.searchsorted(ends, pos, side="right") - 1
                    ok = pos + int(mask[-1]) < ends[doc + 1]
                    if own is not None:
                        ok &= np.isin(np.minimum(n[doc], OVERLAP), [x for x, numbers in own.items() if number in numbers])
                    pos, doc = pos[ok], doc[ok]
                    rows = pa.array(lo + doc)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array((pos - ends[doc]).astype(np.int32)), pa.array(s[pos].view(np.int64))], names=["id", "which", "place", "h"])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows whose text overlaps a benchmark item.

    Rows with a null id or text stay, and so do empty texts; rows that share an id are judged each by its own text; repeated rows go or stay together. All columns pass through under
    whatever names. With a benchmark of up to `broadcast_bytes` nothing is shuffled.
    """
    some, items, size = _prepared(docs, benchmark, id_col, text_col, "item_id", "text")
    if size > broadcast_bytes:
        bad = _by_join(some, items, SHORTEST).select(F.struct("doc_id", "own").alias("bad")).distinct()
        key = F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("own"))
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.when(F.col(f"`{text_col}`").isNotNull(), key).alias("key"))
        return rows.join(bad, F.col("key") == F.col("bad"), "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))
    held = docs.sparkSession.sparkContext.broadcast(_sorted_items(items, SHORTEST)[1])
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(held.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, texts in in_slices(batch.column(text_at)):
                keep[[lo + r[0] for r in search.of(texts)]] = False
            yield batch.filter(pa.array(keep | np.asarray(batch.column(id_at).is_null())))

    plain = plain_names(docs)
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All overlaps of all documents with all benchmark items."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""N-gram Jaccard join by chosen paths over embedded shingle sets (after Christiani & Pagh).

A document's set of word 5-grams is embedded as T min-hash tokens: two sets share each token with the probability of their Jaccard similarity.
Each run sends a set along paths of sampled tokens: every node of the recursion samples BRANCH coordinates, and
sets that share the token there share the child. Buckets that are small enough, or DEPTH tokens deep, are searched by brute force
(large ones in pairs of blocks); other buckets are split further. The number of runs follows from the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import Hashes, as_bytes, distinct, gram_hashes, in_slices, mix, random_words, split_words, written
from tabularium.llm.components import components
from tabularium.llm.groups import by_group, forest, in_blocks

WORDS, SIMILARITY = 5, 0.8
#: Tokens of the embedding.
T = 64
BRANCH, DEPTH, RECALL = 2, 3, 0.9999
#: Sets of a bucket that need no further split, and of a block of the brute-force search in a bucket and in a group.
LEAF, BLOCK, VERIFY = 48, 1024, 192
#: Elements of all sets of a block in a group.
GRAMS = 400_000
#: Representatives up to which their ids are broadcast to find their texts (8 bytes each); more are joined.
BROADCAST_IDS = 500_000


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair of this similarity has met in a bucket with probability `recall`, even if all buckets are DEPTH deep."""
    miss = 0.0
    for _ in range(DEPTH):
        miss = (1 - similarity * (1 - miss)) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def least_matches(similarity: float) -> int:
    """Equal tokens of two embedded sets below which they are not taken for similar: five standard deviations under the mean."""
    return max(1, int(T * similarity - 5 * math.sqrt(T * similarity * (1 - similarity))))


def shingles(words: list[bytes], known: Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different n-grams; a text of fewer than n words is one gram."""
    h = known.of(words)
    if not len(h):
        return h
    return distinct(gram_hashes(h, n) if len(h) >= n else gram_hashes(h, len(h)) ^ np.uint64(len(h)))


def embedded(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS) -> DataFrame:
    """(doc long, grams int, cid long, sketch array<int>): cid is a fingerprint of the set; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(41)
        a, b = random_words(T, 43), random_words(T, 47)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, texts in in_slices(batch.column(1)):
                words, ends = split_words(texts)
                if not words:
                    continue
                h = known.of(words)
                sets, who = [], []
                size = np.diff(ends)
                if len(h) >= n:
                    g = gram_hashes(h, n)
                    of = np.searchsorted(ends, np.arange(len(g)), side="right") - 1
                    inside = np.arange(len(g)) + n <= ends[of + 1]
                    # the hash's upper 44 bits tell a text's grams apart
                    key = distinct((of[inside].astype(np.uint64) << np.uint64(44)) | (g[inside] >> np.uint64(20)))
                    sets.append(mix(key & np.uint64((1 << 44) - 1)))
                    who.append((key >> np.uint64(44)).astype(np.int64))
                short = np.flatnonzero((size > 0) & (size < n))
                if len(short):
                    sets.append(np.concatenate([gram_hashes(h[ends[i] : ends[i + 1]], int(size[i])) ^ np.uint64(size[i]) for i in short]))
                    who.append(short)
                grams, who = np.concatenate(sets), np.concatenate(who)
                order = np.argsort(who, kind="stable")
                grams, who = grams[order], who[order]
                first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                sketch = np.empty((len(first), T), np.uint32)
                with np.errstate(over="ignore"):
                    cid = mix(np.add.reduceat(mix(grams ^ np.uint64(1)), first) + np.diff(np.append(first, len(who))).astype(np.uint64))
                    for t in range(T):
                        sketch[:, t] = np.minimum.reduceat(((grams ^ b[t]) * a[t]) >> np.uint64(32), first)
                flat = pa.array(sketch.view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][who[first]]), pa.array(np.diff(np.append(first, len(who))).astype(np.int32)), pa.array(cid.view(np.int64)), pa.ListArray.from_arrays(pa.array((np.arange(len(first) + 1) * T).astype(np.int32)), flat)],
                    names=["doc", "grams", "cid", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long"), text_col).where(f"`{id_col}` is not null and `{text_col}` is not null").mapInArrow(run, "doc long, grams int, cid long, sketch array<int>")


def buckets(sets: DataFrame, runs: int) -> DataFrame:
    """(cid, path, n): the buckets of all runs in which a set has company. sets: cid, sketch."""
    coordinate = [(r, b, int(np.random.default_rng(r * BRANCH + b).integers(T))) for r in range(runs) for b in range(BRANCH)]
    now = sets.select("cid", F.explode(F.array(*(F.xxhash64(F.lit(r), F.lit(b), F.col("sketch")[c]) for r, b, c in coordinate))).alias("path"))
    found = []
    for depth in range(1, DEPTH + 1):
        now = written(now, f"paths-{depth}")
        sizes = now.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(now.join(sizes, "path"), f"buckets-{depth}")
        if depth == DEPTH:
            found.append(sized)
            break
        found.append(sized.where(F.col("n") <= LEAF))
        open_ = sized.where(F.col("n") > LEAF).select("cid", "path")
        if open_.isEmpty():
            break
        step = F.explode(F.array(*(F.xxhash64("path", F.lit(b), F.element_at("sketch", (F.pmod(F.xxhash64("path", F.lit(b), F.lit(depth)), F.lit(T)) + 1).cast("int"))) for b in range(BRANCH))))
        now = open_.join(sets.select("cid", "sketch"), "cid").select("cid", step.alias("path"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def candidate_edges(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(a, b): spanning forests, bucket by bucket, of the pairs whose embedded sets look similar. sets: cid, grams, sketch."""
    least = least_matches(similarity)
    rows = buckets(sets, runs_for(recall, similarity)).join(sets.select("cid", "grams", "sketch"), "cid")

    def search(group: pa.RecordBatch) -> pa.RecordBatch | None:
        cid, grams = group.column("cid").to_numpy(), group.column("grams").to_numpy()
        if len(cid) < 2:
            return None
        sketch = group.column("sketch").flatten().to_numpy().reshape(len(cid), T)

        def near(x: int, others: np.ndarray) -> np.ndarray:
            fits = np.minimum(grams[x], grams[others]) >= (similarity - 0.01) * np.maximum(grams[x], grams[others])
            fits[fits] = (sketch[others[fits]] == sketch[x]).sum(axis=1) >= least
            return fits

        edges = forest(near, len(cid))
        if not edges:
            return None
        a, b = np.array(edges).T
        return pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b])], names=["a", "b"])

    return by_group(in_blocks(rows, "path", "n", "cid", BLOCK).select("path", "__i", "__j", "cid", "grams", "sketch"), ["path", "__i", "__j"], search, "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sorted sets share."""
    n = len(sets)
    out = np.zeros((n, n))
    if n <= 8:
        for i in range(n):
            for j in range(i + 1, n):
                at = np.searchsorted(sets[i], sets[j])
                at[at == len(sets[i])] = 0
                out[i, j] = out[j, i] = (sets[i][at] == sets[j]).sum() if len(sets[i]) else 0
        return out
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.append(True, flat[1:] != flat[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(flat)))
    shared = np.repeat(size > 1, size)
    who, column = who[shared], (np.cumsum(new[shared]) - 1)
    # columns in slabs, so that the incidence matrix stays small
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((n, 4096), np.float32)
        x[who[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, similarity: float, n: int = WORDS) -> DataFrame:
    """Exact comparison of all sets within each candidate group: (a, b) links of a spanning forest, and (a, null, links) sums of copies linked to a set.

    members: cid, root, doc (whose text has the set), copies, grams. Groups are compared in pairs of blocks of about VERIFY sets, or GRAMS elements of large ones.
    """
    sizes = members.groupBy("root").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("grams") * (VERIFY / GRAMS))).cast("long").alias("n"))
    rows = members.drop("grams").join(sizes, "root")
    few = members.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null").join(F.broadcast(rows) if few else rows, "doc")

    def compare(group: pa.RecordBatch) -> pa.RecordBatch | None:
        known = Hashes(41)
        cid, own, copies = group.column("cid").to_numpy(), group.column("__own").to_numpy(), group.column("copies").to_numpy()
        _, once = np.unique(cid, return_index=True)  # repeated rows
        raw = as_bytes(group.column("text"))
        sets = [shingles(raw[i].split(), known, n) for i in once]
        cid, own, copies = cid[once], own[once], copies[once]
        both = intersections(sets)
        size = np.array([len(s) for s in sets])
        near = both >= similarity * (size[:, None] + size[None] - both) - 1e-9
        np.fill_diagonal(near, False)
        if group.column("__i")[0].as_py() != group.column("__j")[0].as_py():
            near &= own[:, None] != own[None]
        total = near @ copies
        edges = forest(lambda x, others: near[x, others], len(cid))
        a = np.concatenate([cid[total > 0], cid[[e[0] for e in edges]] if edges else cid[:0]])
        b = pa.array([None] * int((total > 0).sum()) + cid[[e[1] for e in edges]].tolist() if edges else [None] * int((total > 0).sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([total[total > 0], np.zeros(len(edges), np.int64)]).astype(np.int64))], names=["a", "b", "links"])

    return by_group(in_blocks(texts, "root", "n", "cid", VERIFY).select("root", "__i", "__j", "__own", "cid", "copies", "text"), ["root", "__i", "__j"], compare, "a long, b long, links long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): for each document how many others have a Jaccard similarity of `similarity` or more, and the smallest id that such links reach.

    Sets of word n-grams; a text of fewer than n words is one gram, and one without words (or null) links with nothing.
    Documents with equal sets are one class and are searched once; every link between different sets is verified exactly. Rows with
    the same id and set count as one document. Null ids have class null and no links. Further columns are ignored.
    """
    table = written(embedded(docs, id_col, text_col, n).dropDuplicates(["doc", "cid"]), "embedded")
    sets = written(table.groupBy("cid").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.min("grams").alias("grams"), F.first("sketch").alias("sketch")), "sets")
    groups = components(candidate_edges(sets, similarity, recall))
    members = written(sets.select("cid", "doc", "copies", "grams").join(groups.withColumnRenamed("node", "cid"), "cid"), "members")
    found = written(links(docs, members, id_col, text_col, similarity, n), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    linked = sets.select("cid", "doc", "copies").join(roots, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = linked.groupBy("root").agg(F.min("doc").alias("class_id"))
    classes = linked.join(least, "root").select("cid", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = table.select("doc", "cid").join(classes, "cid").groupBy("doc").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(known, F.col("doc_id") == F.col("doc"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document (the smallest id) of each group of linked documents.

    Rows with a null id or without words stay, and so do rows that share the id that stays. All columns pass through under whatever names; an empty table gives none.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    gone = jaccard_join(narrow).where("class_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The links and classes of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).withColumn("kept", F.col("doc_id") == F.col("class_id"))

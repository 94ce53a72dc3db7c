"""Vectors of any size and large labels, repeated ids and long passages, against brute force."""

import collections

import numpy as np
import pytest
from test_llm import classes
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm import embedding_dedup, substring_dedup

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def linked(rows, cosine=0.98):
    near = []
    for label in {k for _, _, k in rows}:
        some = [(i, np.array(v) / max(map(abs, v))) for i, v, k in rows if k == label]
        x = np.array([v / np.sqrt(v @ v) for _, v in some])
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        near += [(some[i][0], some[j][0]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return classes([i for i, _, _ in rows], near)


def test_tiny_and_huge_vectors(spark):
    rows = [[1e-200, 2e-200], [2e-170, 4e-170], [1.0, 2.0], [1e200, 2e200], [-0.0, 1.0], [0.0, 1.0], [5e-324, 1e-323], [1.0, -2.0], [1e308, -1e308], [1e-308, -1e-308], [1e308, 1e-308], [7.0, 0.0]]
    rows = [(i, v, 0) for i, v in enumerate(rows)]
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize(("direct", "block"), [(8, 2048), (8, 64), (1, 64)])
def test_large_label(spark, monkeypatch, direct, block):
    """One label in one group, in pairs of blocks, and in cells of several projections: the same links, each counted once."""
    monkeypatch.setattr(embedding_dedup, "DIRECT", direct)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(150, 32)) + 0.5
    rows = [(i, (centres[i % 150 if i % 3 else 0] + 0.1 * rng.normal(size=32)).tolist(), 1) for i in range(900)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embedding_dedup.near_duplicates(df.repartition(3)).collect()}
    want = linked(rows)
    missed = sum(w[1] for w in want.values()) - sum(g[1] for g in got.values())
    assert all(got[i][1] <= want[i][1] for i in want) and missed <= 0.001 * sum(w[1] for w in want.values())


def test_equal_cells_hold_pairs_as_often_as_computed():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 5, 200_000)
    hit = np.floor(x / 5) == np.floor((x + rng.normal(size=len(x))) / 5)
    assert embedding_dedup.same_cell(1.0, 5.0) == pytest.approx(hit.mean(), abs=0.005)
    assert embedding_dedup.tables(1000, 0.98) == (0, 1) and embedding_dedup.tables(10**7, 0.98)[0] > embedding_dedup.tables(10**5, 0.98)[0] > 0


DOCS = "doc_id long, text string"


def without_repeats(docs, k):
    """Rows (id, words kept) by the definition."""
    first = {}
    for i, t in sorted((i, t) for i, t in docs if i is not None and t is not None):
        w = t.encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("k", [2, 5, 50])
def test_rows_that_share_an_id(spark, k):
    """Different texts of one id are one document: each loses its own repeats and nothing else."""
    rng = np.random.default_rng(31)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [" ".join(base[int(rng.integers(6))].split()[a : a + int(rng.integers(70))]) for a in rng.integers(0, 100, 3)]
        docs.append((int(rng.integers(15)), " ".join([*parts, " ".join(rng.choice(words, int(rng.integers(60))))])))
    docs += [docs[0], docs[0], (None, docs[1][1]), (3, None), (3, ""), (4, " ".join(["la"] * 200)), (9, " ".join(["la"] * 150))]
    df = spark.createDataFrame(docs, DOCS)
    got = collections.Counter((r[0], " ".join((r[1] or "").split())) for r in substring_dedup.dedup_substrings(df, k=k).collect())
    assert got == without_repeats(docs, k)


def test_paths_are_compacted(spark):
    """A passage that two documents share is one path and one span, however long; where a third leaves it, the path is cut."""
    a = [f"a{i}" for i in range(900)]
    docs = [(1, " ".join(a)), (2, " ".join(["x", *a, "y"])), (3, "one two " + " ".join(a[100:400]) + " three")]
    spans = sorted(tuple(r) for r in substring_dedup.repeated_spans(spark.createDataFrame(docs, DOCS)).select("doc", F.col("at") % 2**32, "words", "owner", F.col("src") % 2**32).collect())
    low = [(d, at if at >= 0 else at + 2**32, n, o, src if src >= 0 else src + 2**32) for d, at, n, o, src in spans]
    cover = {d: {x for e, at, n, _, src in low if e == d for x in range(src, src + n)} for d in (2, 3)}
    assert cover == {2: set(range(900)), 3: set(range(100, 400))}
    assert len([x for x in low if x[0] == 2]) <= 12


def test_edges_become_paths(spark):
    """Nodes 1-2-3-4-5 with a branch at 3: two paths before it, and one behind each of its edges."""
    rows = [(7, 0, 2, 1, 2), (7, 2, 1, 2, 3), (7, 3, 1, 3, 4), (7, 4, 1, 4, 5), (9, 50, 1, 3, 6), (9, 51, 3, 6, 8)]
    got = substring_dedup.compacted(spark.createDataFrame(rows, "owner long, src long, n int, head long, tail long")).collect()
    assert {(r["owner"], r["src"]): r["path"] for r in got} == {(7, 0): 0, (7, 2): 0, (7, 3): 3, (7, 4): 3, (9, 50): 50, (9, 51): 50}

"""Each stage of the pipeline on nulls, empty and blank texts, repeats, clashing names and empty tables, against brute force where it drops."""

import numpy as np
import pytest
from test_llm import brute_links, classes


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = np.random.default_rng(51)
    prose = lambda n: " ".join(rng.choice([f"w{i}" for i in range(500)], n))
    long = prose(400)
    rows = [(1, prose(80)), (2, long), (3, f"begin {long} end"), (4, None), (5, ""), (6, " \t "), (7, prose(3)), (7, prose(3)), (8, long), (None, long), (9, prose(90)), (9, None)]
    extra = ["__toxic", "__toxicity", "score", "toxic", "a.b", "row", "mark", "__gone", "__bad", "c0"]
    rows += [rows[0], rows[10]]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))


def test_stages_keep_what_is_clean(spark, sf, odd_docs):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    rows = list(map(tuple, odd_docs.collect()))
    key = lambda rows: sorted(map(str, rows))
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, odd_docs, sf)
        assert out.columns == odd_docs.columns and key(map(tuple, out.collect())) == key(rows), name
    # copies: the classes of all texts with words, by brute force; rows that share the id that stays, stay
    with_words = {(r[0], r[1]) for r in rows if r[0] is not None and r[1] and r[1].split()}
    numbered = list(enumerate(sorted(with_words)))
    near = brute_links([(n, t) for n, (_, t) in numbered])
    root = {r: numbered[c][1][0] for n, (c, _) in classes([n for n, _ in numbered], near).items() for r in [numbered[n][1][0]]}
    got = stages["near_copies"](spark, odd_docs, sf)
    assert got.columns == odd_docs.columns and key(map(tuple, got.collect())) == key(r for r in rows if r[0] is None or root.get(r[0], r[0]) == r[0])


def test_cut_rows_keep_their_columns(spark, sf, odd_docs):
    import corpus_pipeline as P

    cut = dict(P.STAGES)["substring_dedup"](spark, odd_docs, sf)
    assert cut.columns == odd_docs.columns
    got = {str(r["a.b"]): (r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()}
    before = {str(r["a.b"]): (r["doc_id"], r["text"], r["n_chars"]) for r in odd_docs.collect()}
    changed = {k for k in before if got[k] != before[k]}
    assert {before[k][0] for k in changed} == {3, 8} and {got[k][1:] for k in changed} == {("begin end", 9), ("", 0)}
    assert dict(P.STAGES)["substring_dedup"](spark, odd_docs.drop("n_chars"), sf).columns == odd_docs.drop("n_chars").columns


def test_packing_and_empty_tables(spark, sf, odd_docs):
    import corpus_pipeline as P

    packed = P.pack_sequences(spark, odd_docs, sf).collect()
    assert len(packed) == odd_docs.count() and sorted(r["length"] for r in packed)[:4] == [1, 1, 1, 1]
    for name, stage in P.STAGES:
        assert stage(spark, odd_docs.limit(0), sf).count() == 0, name

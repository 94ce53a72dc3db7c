"""Decontamination against the definition, over all rows, items and alignments, by both ways of meeting."""

import collections

import numpy as np
import pytest

from tabularium.llm import decontamination as D

DOCS = "doc_id long, text string"


def words(text):
    return [w for w in ("".join(c for c in t.lower() if c.isalnum()) for t in (text or "").split()) if w]


def most_equal(doc, item, shortest=5):
    """The equal tokens of the best run of 13 tokens (or a whole shorter item) of which 80 % are equal, over all alignments; 0 without any."""
    least, best = min(13, len(item)), 0
    if len(item) < shortest:
        return 0
    for shift in range(-len(item), len(doc)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        equal = np.concatenate([[0], np.cumsum([doc[j + shift] == item[j] for j in range(lo, hi)])]) if hi > lo else np.zeros(1)
        for a in range(hi - lo - least + 1):
            n = np.arange(least, hi - lo - a + 1)
            got = equal[a + n] - equal[a]
            best = max(best, int(np.max(np.where(got * 5 >= n * 4, got, 0), initial=0)))
    return best


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("shortest", [5, 1])
def test_all_alignments(spark, limit, shortest):
    rng = np.random.default_rng(41)
    vocabulary = [f"w{i}" for i in range(25)]  # few words: many chance hits
    items = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13, 14, 17, 20, 26, 40)]
    docs = []
    for i in range(60):
        w = list(rng.choice(vocabulary, int(rng.integers(0, 40))))
        for _ in range(int(rng.integers(3))):
            part = items[int(rng.integers(len(items)))].split()
            a = int(rng.integers(len(part)))
            part = [x if rng.random() > rng.choice([0, 0.1, 0.2, 0.3]) else "new" for x in part[a : a + int(rng.integers(5, 41))]]
            at = int(rng.integers(len(w) + 1))
            w[at:at] = part
        docs.append((i % 45, " ".join(w)))  # ids that several texts share
    docs += [docs[3], docs[3], (None, docs[4][1]), (50, None), (51, "")]
    rows = [*enumerate(items), (3, items[9]), (3, items[9]), (None, items[10]), (60, None)]
    got = D.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, "item_id long, text string"), broadcast_bytes=limit, shortest=shortest).collect()
    want = collections.Counter()
    for d, t in docs:
        for i, x in {(i, x) for i, x in rows if i is not None and x is not None}:
            if d is not None and (n := most_equal(words(t), words(x), shortest)):
                want[d, i, n] += 1
    assert collections.Counter((r["doc_id"], r["item_id"], r["n_equal"]) for r in got) == want


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_of_one_id_are_judged_apart(spark, limit):
    item = " ".join(f"i{k}" for k in range(20))
    rows = [("x", "clean text", 1, None), ("x", f"so {item} and", 2, "b"), ("y", item, 3, "c"), (None, item, 4, "d"), ("z", None, 5, "e"), ("z", "", 6, "f"), ("y", item, 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __bad int, `a.b` string")
    bench = spark.createDataFrame([("q", item, "old")], "item_id string, text string, doc_id string")
    left = D.remove_contaminated(docs, bench, broadcast_bytes=limit)
    assert left.columns == docs.columns and sorted(r[2] for r in left.collect()) == [1, 4, 5, 6]
    got = D.contamination(docs, bench, broadcast_bytes=limit).collect()
    assert collections.Counter((r["doc_id"], r["item_id"], r["n_equal"]) for r in got) == {("x", "q", 20): 1, ("y", "q", 20): 2}
    assert D.remove_contaminated(docs.limit(0), bench, broadcast_bytes=limit).count() == 0 and D.remove_contaminated(docs, bench.limit(0), broadcast_bytes=limit).count() == 7


def test_names_with_dots_pass_through(spark):
    """Whatever extra columns are called, they pass through the stages of a pipeline."""
    from tabularium.llm import ngram_join, substring_dedup, toxicity

    rng = np.random.default_rng(2)
    names = ["a.b", "__bad", "__gone", "__doc", "__spans", "row", "mark", "order", "base", "doc", "key", "bad", "own", "c0", "c1", "__toxic", "__id"]
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(300)], 80)), *[f"{c}{i}" for c in names]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    bench = spark.createDataFrame([(1, "nothing of this kind stands in any of the texts here at all")], "item_id long, text string")
    kept = sorted(map(tuple, docs.collect()))
    for out in (D.remove_contaminated(docs, bench), D.remove_contaminated(docs, bench, broadcast_bytes=0), substring_dedup.dedup_substrings(docs), ngram_join.one_of_each(docs), toxicity.score(docs, None).drop("score", "predicted")):
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == kept

"""The language model's expectations over borders, ties of counts, and held-out text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import hmm_lm


def whole(ids, m):
    """Baum-Welch expectations of one text by the plain recursions."""
    k, n = len(m.start), len(ids)
    a, b, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (m.start if not t else a[t - 1] @ m.move) * m.emit[ids[t]]
        c[t] = a[t].sum()
        a[t] /= c[t]
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[ids[t + 1]] * b[t + 1]) / c[t + 1]
    g = a * b
    g /= g.sum(axis=1, keepdims=True)
    moves = sum(np.outer(a[t], m.emit[ids[t + 1]] * b[t + 1]) / c[t + 1] for t in range(n - 1)) * m.move if n > 1 else np.zeros((k, k))
    emissions = np.zeros_like(m.emit)
    np.add.at(emissions, ids, g)
    return g[0], moves, emissions


def random_model(rng, k=3, tokens=20):
    hashes = np.arange(-1, tokens - 1)
    move = 0.8 * np.eye(k) + 0.2 * rng.dirichlet(np.ones(k), k)
    emit = rng.dirichlet(np.full(tokens + 1, 0.5), k).T
    return hmm_lm.Model(hashes, np.ones(tokens, np.int64), tokens, tokens, rng.dirichlet(np.ones(k)), move / move.sum(axis=1, keepdims=True), emit)


@pytest.mark.parametrize("segment", [256, 40])
def test_expectations_cross_borders(monkeypatch, segment):
    """Segments give what the whole texts give: every token and every transition counts, those over borders too."""
    monkeypatch.setattr(hmm_lm, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    m = random_model(rng)
    sizes = [1, 2, 39, 40, 41, 255, 256, 257, 900]
    ids, ends = rng.integers(0, 21, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    emissions = np.zeros_like(m.emit)
    starts, moves = hmm_lm.expected(ids, ends, m, emissions)
    want = [whole(ids[a:b], m) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert starts == pytest.approx(sum(w[0] for w in want), abs=1e-4)
    assert moves.sum() == pytest.approx(sum(n - 1 for n in sizes)) and moves == pytest.approx(sum(w[1] for w in want), rel=1e-3)
    assert emissions.sum() == pytest.approx(sum(sizes)) and emissions == pytest.approx(sum(w[2] for w in want), abs=0.02)


def test_shrunk_emissions_keep_the_unigrams():
    """Without evidence every state emits the unigrams; with any evidence the states' mixture does."""
    rng = np.random.default_rng(4)
    m = random_model(rng)
    assert hmm_lm.emitting(m, np.zeros_like(m.emit), 2.0) == pytest.approx(np.repeat(m.unigram[:, None], 3, axis=1) / m.unigram.sum())
    counts = rng.gamma(0.3, 5, m.emit.shape)
    spread = (counts + 0.5 * (counts.sum(0) + 1) / (counts.sum() + 3)) / (counts.sum(1, keepdims=True) + 0.5)
    assert hmm_lm.emitting(m, counts, 0.5) * (spread * m.unigram[:, None]).sum(0) == pytest.approx(spread * m.unigram[:, None])


def test_most_counted_ends_within_a_step(spark):
    """Where all tokens have one count, about as many as asked for are taken, not none."""
    same = spark.range(5000).select(F.col("id").alias("h"), F.lit(3).cast("long").alias("n"))
    assert 900 < hmm_lm.most_counted(same, 1000).count() < 1100
    mixed = same.unionByName(spark.range(5000, 5100).select(F.col("id").alias("h"), F.lit(50).cast("long").alias("n")))
    got = hmm_lm.most_counted(mixed, 1000)
    assert got.where("n = 50").count() == 100 and 900 < got.count() < 1100 and hmm_lm.most_counted(mixed, 6000).count() == 5100


def test_held_out_documents_are_likelier_than_under_the_base(spark, sf):
    got = hmm_lm.op8_hmm_lm(spark, sf).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 2 and all(r["s"] > r["b"] for r in got)


def test_long_texts_give_start_values(spark):
    """A corpus of long texts alone learns."""
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(40)], 9000))) for i in range(12)], "doc_id long, text string")
    model, counts = hmm_lm.train(docs.where("doc_id < 10"), states=2)
    r = hmm_lm.score(docs.where("doc_id >= 10"), model, counts).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.9 * r[1] and r[0] > r[1]


def test_start_values_weight_and_passes_take_all_documents(spark, monkeypatch):
    """No pass leaves out a document, and the states start from a topic that a sample may miss."""
    rng = np.random.default_rng(6)
    prose = lambda c, n: " ".join(f"{c}{j}" for j in rng.integers(0, 40, n))
    docs = spark.createDataFrame([(i, prose("a", 20)) for i in range(4000)], "doc_id long, text string")
    rare = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40)) > (1 << 39)  # not among the 1,500 that start values once came from
    ids = [r[0] for r in docs.where(rare).limit(400).collect()]
    docs = docs.where(~F.col("doc_id").isin(ids)).unionByName(spark.createDataFrame([(i, prose("b", 20)) for i in ids], docs.schema))
    seen, were = [], hmm_lm.improved
    monkeypatch.setattr(hmm_lm, "improved", lambda m, starts, moves, emissions, *w: seen.append(emissions.sum()) or were(m, starts, moves, emissions, *w))
    model, _ = hmm_lm.train(docs, states=2)
    assert seen == pytest.approx([model.total] * hmm_lm.PASSES) and model.total == 4000 * 21
    of = {c: [i for i, h in enumerate(model.hashes) if h in {hmm_lm._hash(f"{c}{j}".encode()) for j in range(40)}] for c in "ab"}
    share = {c: model.emit[at].sum(axis=0) for c, at in of.items()}
    assert share["b"].argmax() != share["a"].argmax() and share["b"].max() > 0.9 and share["b"].min() < 0.01


def test_the_best_weight_is_taken_across_halves():
    """Halves that agree on the tokens' states ask for no shrinking, halves that contradict each other for the most."""
    m = random_model(np.random.default_rng(7), tokens=300)
    one = np.random.default_rng(8).dirichlet(np.full(3, 0.2), 301) * 4
    assert hmm_lm._best_weight(m, one, one) == min(hmm_lm.WEIGHTS) and hmm_lm._best_weight(m, one, np.roll(one, 1, axis=0)) == max(hmm_lm.WEIGHTS)
    assert hmm_lm._best_weight(m, one, 0 * one) == hmm_lm.WEIGHT


def test_expectations_of_tables_are_those_of_texts(spark):
    """The passes over written token places give what each text gives alone: repeated, empty and null texts, and any partitions."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in (1, 5, 40, 300, 700)] * 2 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = random_model(rng, tokens=6)
    m.hashes = np.array([hmm_lm.END, *(hmm_lm._hash(c.encode()) for c in "abcde")])
    places = hmm_lm._placed(docs.repartition(3), m, "text", "doc_id")
    index = hmm_lm.Index({int(h): i for i, h in enumerate(m.hashes)}, 6)
    ids, ends, _ = hmm_lm._tokens([t and t.encode() for t in texts], index)
    want = np.zeros_like(m.emit)
    starts, moves = hmm_lm.expected(ids, ends, m, want)
    for parts in (1, 2):
        got = hmm_lm._pass(places, m, parts)
        assert got[0] == pytest.approx(starts) and got[1] == pytest.approx(moves) and got[2].sum(axis=0) == pytest.approx(want) and len(got[2]) == parts
    assert places.agg(F.sum("n"), F.max(F.length("vector")), F.min(F.length("vector"))).first()[:] == (len(ids), 4 * hmm_lm.WIDE, 4 * hmm_lm.WIDE)

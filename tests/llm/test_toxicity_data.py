"""Toxicity on the given tables: held-out labels, scores against plain recursions, labels given twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import toxicity


@pytest.fixture(scope="module")
def trained(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, toxicity.train(docs, labels)


def test_labelled_documents_are_told_apart(trained):
    docs, labels, net = trained
    got = toxicity.score(docs, net).join(labels.select("doc_id", "toxic"), "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    for held, least in ((False, 0.85), (True, 0.5)):
        toxic = [r["predicted"] for r in got if r["held"] == held and r["toxic"] == 1]
        clean = [r["predicted"] for r in got if r["held"] == held and r["toxic"] == 0]
        assert np.mean(toxic) >= least and np.mean(clean) <= 0.05


def plain_logit(net, words):
    """The network by its equations, one word after the other, on one window."""
    par, h = net.par, toxicity.HIDDEN
    x = net.inputs(words) if words else net.inputs([b""])
    states = []
    for side, u, order in (("f", par["Uf"], range(len(x))), ("b", par["Ub"], range(len(x) - 1, -1, -1))):
        state, out = np.zeros(h), [None] * len(x)
        for t in order:
            if words:
                g = x[t] @ par["W" + side] + par["b" + side]
                z, r = (1 / (1 + np.exp(-(g[a : a + h] + state @ u[:, a : a + h]))) for a in (0, h))
                c = np.tanh(g[2 * h :] + (r * state) @ u[:, 2 * h :])
                state = state + z * (c - state)
            out[t] = state
        states.append(out)
    both = np.array([np.concatenate(p) for p in zip(*states, strict=True)])
    e = np.tanh(both @ par["A"]) @ par["v"]
    w = np.exp(e - e.max())
    return float((w / w.sum()) @ both @ par["o"] + par["c"][0])


def test_scores_are_those_of_the_worst_window(spark, trained):
    _, _, net = trained
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["the", "idiot", "SCUM!!", "stone", "réeux", "a1"], n)) for n in (1, 5, 31, 32, 33, 48, 49, 150)] + ["", None]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        starts = range(0, max(1, len(words) - 32 + 16), 16)
        worst = max(plain_logit(net, words[s : s + 32]) for s in starts)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(worst - net.shift))), abs=1e-3)


def test_a_document_labelled_both_ways_is_toxic(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (1, 0), (2, 1), (2, None), (9, 1)], "doc_id long, toxic int")
    sample, stands_for = toxicity.labelled_sample(docs, labels)
    assert sorted((r["id"], r["toxic"]) for r in sample.collect()) == [(0, 1), (1, 0), (2, 1)] and stands_for == [1.0, 1.0]

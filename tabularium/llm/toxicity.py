"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, trained in numpy.

Each word enters with a word part (a learned vector of its hash, and the log odds of the word in toxic documents) and a character
part (learned vectors of its n-grams, and their log odds). A document scores as its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import Hashes, WordTable, as_bytes, char_grams, distinct, fold, hash_sample, in_slices, plain_names, slices, split_words, written

#: The bounded sample that the network is fitted on: about so many labelled documents of each label. Of one over so many bytes the gradient steps
#: see so many words about its window of the greatest log odds; log odds and threshold come from whole texts.
SAMPLE_PER_LABEL, SAMPLE_BYTES, PASSAGE = 2000, 6_000, 128
#: Words of a window, and from one window's start to the next's.
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 4096, 1 << 16, (3, 4, 5, 6, 8)
EMBED, HIDDEN, ATTEND = 4, 8, 8
#: Gradient steps that a small sample is gone over again for.
LEAST_STEPS = 240
#: ASCII marks that don't belong to a word; standard errors that are taken off log odds.
MARKS, SURE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 1.5
WORD_KEYS = WORD_BUCKETS * 16
ODDS = 3  # log odds inputs: word, greatest and mean n-gram
INPUT = 2 * EMBED + ODDS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def word_parts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash bucket of each word in lower case without marks at its ends, and its n-grams' buckets with the word of each."""
    lower = b" ".join(words).decode("utf-8", "replace").lower().encode().split(b" ")
    h = Hashes(3).of([w.strip(MARKS) or w for w in lower])
    grams, who = char_grams(words, GRAMS, GRAM_BUCKETS)
    return (h % np.uint64(WORD_KEYS)).astype(np.int64), grams, who


@dataclass
class Network:
    word_odds: np.ndarray
    gram_odds: np.ndarray
    word_vec: np.ndarray
    gram_vec: np.ndarray
    par: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """What each word enters the network with."""
        return self._inputs(*word_parts(words))

    def _inputs(self, wide: np.ndarray, grams: np.ndarray, who: np.ndarray) -> np.ndarray:
        x = np.zeros((len(wide), INPUT), np.float32)
        x[:, :EMBED] = self.word_vec[wide % WORD_BUCKETS]
        x[:, 2 * EMBED] = self.word_odds[wide]
        if len(who):
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            n = np.diff(np.append(first, len(who)))[:, None]
            x[who[first], EMBED : 2 * EMBED] = np.add.reduceat(self.gram_vec[grams], first, axis=0) / n
            odds = self.gram_odds[grams]
            x[who[first], 2 * EMBED + 1] = np.maximum.reduceat(odds, first)
            x[who[first], 2 * EMBED + 2] = np.add.reduceat(odds, first) / n[:, 0]
        return x

    def gates(self, words: list[bytes]) -> np.ndarray:
        """The inputs' share in all gates of both directions: what a word adds wherever it stands."""
        x = self.inputs(words)
        return np.concatenate([x @ self.par["Wf"] + self.par["bf"], x @ self.par["Wb"] + self.par["bb"]], axis=1)


def windows(ends: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: (text, first word, words). Each word is in one at least; a text without words has one empty window."""
    n = np.diff(ends)
    count = np.maximum(1, -(-(n - window) // stride) + 1)
    text = np.repeat(np.arange(len(n)), count)
    j = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = ends[text] + j * stride
    return text, start, np.minimum(window, ends[text + 1] - start)


def forward(share: np.ndarray, at: np.ndarray, n: np.ndarray, par: dict[str, np.ndarray], keep: bool = False):
    """Logits of windows; share[at[w, t]]: the input share of word t of window w in all gates, of which the first n words count."""
    size, steps = at.shape
    h3 = 3 * HIDDEN
    halves = share[:, :h3], share[:, h3:]
    least = int(n.min()) if size else 0
    out = np.zeros((size, steps, 2 * HIDDEN), np.float32)
    tape = []
    for side, u in enumerate((par["Uf"], par["Ub"])):
        h = np.zeros((size, HIDDEN), np.float32)
        u_zr, u_c = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        for t in range(steps) if not side else range(steps - 1, -1, -1):
            x = halves[side][at[:, t]]
            zr = x[:, : 2 * HIDDEN] + h @ u_zr
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            c = rh @ u_c
            c += x[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            new = h + z * (c - h)
            live = (n > t)[:, None] if keep or t >= least else None
            if t >= least:
                new = np.where(live, new, h)
            if keep:
                tape.append((side, t, h, z, r, rh, c, live))
            h = new
            out[:, t, side * HIDDEN : (side + 1) * HIDDEN] = h
    a = np.tanh(out @ par["A"])
    e = a @ par["v"]
    if least < steps:
        e = np.where(np.arange(steps)[None] < np.maximum(n, 1)[:, None], e, np.float32(-1e9))
    w = np.exp(e - e.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    pooled = (w[:, :, None] * out).sum(axis=1)
    logit = pooled @ par["o"] + par["c"][0]
    return (logit, (out, a, w, pooled, tape)) if keep else logit


def backward(par: dict, kept, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the input shares."""
    out, a, w, pooled, tape = kept
    g = {k: np.zeros_like(v) for k, v in par.items()}
    g["o"], g["c"][0] = pooled.T @ d_logit, d_logit.sum()
    d_pool = d_logit[:, None] * par["o"]
    d_out = w[:, :, None] * d_pool[:, None, :]
    d_w = (out * d_pool[:, None, :]).sum(axis=2)
    d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("bt,btk->k", d_e, a)
    d_a = d_e[:, :, None] * par["v"] * (1 - a * a)
    g["A"] = out.reshape(-1, out.shape[2]).T @ d_a.reshape(-1, a.shape[2])
    d_out += d_a @ par["A"].T
    d_gate = np.zeros((*w.shape, 6 * HIDDEN), np.float32)
    carry = [np.zeros((len(w), HIDDEN), np.float32) for _ in range(2)]
    h3 = 3 * HIDDEN
    for side, t, h, z, r, rh, c, live in reversed(tape):
        name = "Ub" if side else "Uf"
        u = par[name]
        d_h = carry[side] + d_out[:, t, side * HIDDEN : (side + 1) * HIDDEN]
        d_new = np.where(live, d_h, 0)
        d_c = d_new * z * (1 - c * c)
        d_rh = d_c @ u[:, 2 * HIDDEN :].T
        d_z = d_new * (c - h) * z * (1 - z)
        d_r = d_rh * h * r * (1 - r)
        zr = np.concatenate([d_z, d_r], axis=1)
        g[name][:, : 2 * HIDDEN] += h.T @ zr
        g[name][:, 2 * HIDDEN :] += rh.T @ d_c
        d_gate[:, t, side * h3 : (side + 1) * h3] = np.concatenate([zr, d_c], axis=1)
        carry[side] = np.where(live, d_h * (1 - z) + d_rh * r + zr @ u[:, : 2 * HIDDEN].T, d_h)
    return g, d_gate


def _counts(parts, toxic: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic and how many other texts hold a key. parts: for some texts at a time, all their keys and the text of each."""
    pos, neg = np.zeros(buckets), np.zeros(buckets)
    for keys, text in parts:
        pairs = distinct(keys.astype(np.int64) * len(toxic) + text)
        key, bad = pairs // len(toxic), toxic[pairs % len(toxic)]
        pos += np.bincount(key[bad], minlength=buckets)
        neg += np.bincount(key[~bad], minlength=buckets)
    return pos, neg


def _odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log odds of a key in toxic against other texts, by the number of texts that hold it: as much of them as is sure, so that
    words of one or two texts, which the network is trained on as well, say nothing."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    sure = np.abs(odds) - SURE * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return (np.sign(odds) * np.maximum(sure, 0)).astype(np.float32)


@dataclass
class Texts:
    """Texts as ids of their words, with their words' parts."""

    ids: np.ndarray
    ends: np.ndarray
    vocab: list[bytes]
    wide: np.ndarray
    grams: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        words, ends = split_words(texts)
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
        vocab = list(index)
        return cls(ids, ends, vocab, *_vocabulary_parts(vocab))

    def keys(self, of_grams: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The word or n-gram buckets of all words of some texts at a time, and the text of each."""
        count = len(self.ends) - 1
        for i in range(0, count, 50):
            lo, hi = self.ends[i], self.ends[min(i + 50, count)]
            text = np.repeat(np.arange(i, min(i + 50, count)), np.diff(self.ends[i : i + 51]))
            if of_grams:
                at, n = _spread(self.begin, self.ids[lo:hi])
                yield self.grams[at], np.repeat(text, n)
            else:
                yield self.wide[self.ids[lo:hi]], text

    def counts(self, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many toxic and how many other texts hold each word bucket, then each n-gram bucket."""
        both = [_counts(self.keys(False), toxic, WORD_KEYS), _counts(self.keys(True), toxic, GRAM_BUCKETS)]
        return np.concatenate([both[0][0], both[1][0]]), np.concatenate([both[0][1], both[1][1]])

    def heat(self, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows (text, first word, words) and the greatest log odds of a word in each."""
        most = np.zeros(len(self.vocab), np.float32)
        for i in range(0, len(self.vocab), 20_000):
            most[i : i + 20_000] = net.inputs(self.vocab[i : i + 20_000])[:, 2 * EMBED : 2 * EMBED + 2].max(axis=1)
        of, start, n = windows(self.ends)
        per_word = most[self.ids]
        at = np.minimum(start[:, None] + np.arange(WINDOW), max(len(self.ids) - 1, 0))
        return of, start, n, np.where(np.arange(WINDOW) < n[:, None], per_word[at] if len(self.ids) else 0, -9).max(axis=1)


def _vocabulary_parts(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_parts of many words, some at a time: (word buckets, n-gram buckets, where each word's n-grams begin)."""
    wide, grams, sizes = [], [], []
    for i in range(0, len(vocab), 20_000):
        w, g, who = word_parts(vocab[i : i + 20_000])
        wide.append(w)
        grams.append(g)
        sizes.append(np.bincount(who, minlength=len(w)))
    if not wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(wide), np.concatenate(grams), np.append(0, np.cumsum(np.concatenate(sizes)))


def _spread(begin: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of these words are, and how many each has."""
    n = begin[words + 1] - begin[words]
    return np.repeat(begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def fit(sample: list[tuple[bytes, int]], seed: int = 0, epochs: int = 4, batch: int = 128, odds: np.ndarray | None = None) -> Network | None:
    """Trains on labelled texts; None without texts of both labels. odds: the log odds of all word and n-gram buckets, where known from more text."""
    toxic = np.array([y == 1 for _, y in sample], bool)
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    texts = Texts.of([t for t, _ in sample])
    ids, ends, vocab, wide, grams, begin = texts.ids, texts.ends, texts.vocab, texts.wide, texts.grams, texts.begin
    if odds is None:
        odds = _odds(*texts.counts(toxic), toxic.sum(), (~toxic).sum())
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    net = Network(
        odds[:WORD_KEYS], odds[WORD_KEYS:],
        0.1 * normal(WORD_BUCKETS, EMBED), 0.1 * normal(GRAM_BUCKETS, EMBED),
        {"Wf": normal(INPUT, 3 * HIDDEN), "Wb": normal(INPUT, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "Uf": normal(HIDDEN, 3 * HIDDEN), "Ub": normal(HIDDEN, 3 * HIDDEN), "A": normal(2 * HIDDEN, ATTEND), "v": normal(ATTEND, 1)[:, 0], "o": normal(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)},
    )
    # windows: of each toxic text the one whose words have the greatest log odds, of each other text that one and one at random
    of, start, n, hot = texts.heat(net)
    order = np.lexsort((-hot, of))
    best = order[np.append(True, of[order][1:] != of[order][:-1])]
    order = np.lexsort((rng.random(len(of)), of))
    other = order[np.append(True, of[order][1:] != of[order][:-1])]
    take = np.concatenate([best, other[~toxic[of[other]]]])
    y = toxic[of[take]].astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    weight /= weight.mean()
    state: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    epochs = max(epochs, -(-LEAST_STEPS * batch // len(take)))
    for epoch in range(epochs):
        rate = 0.01 * 0.125 ** (epoch / epochs)
        mixed = rng.permutation(len(take))
        for i in range(0, len(mixed), batch):
            some = mixed[i : i + batch]
            step += 1
            win = take[some]
            pos = np.minimum(start[win][:, None] + np.arange(WINDOW), max(len(ids) - 1, 0))
            used, inv = np.unique(ids[pos] if len(ids) else np.zeros_like(pos), return_inverse=True)
            mine, n_g = _spread(begin, used)
            x = net._inputs(wide[used], grams[mine], np.repeat(np.arange(len(used)), n_g))
            inv = inv.reshape(pos.shape)
            share = np.concatenate([x @ net.par["Wf"] + net.par["bf"], x @ net.par["Wb"] + net.par["bb"]], axis=1)
            logit, kept = forward(share, inv, n[win], net.par, keep=True)
            d = (_sigmoid(logit) - y[some]) * weight[some] / len(some)
            g, d_gate = backward(net.par, kept, d.astype(np.float32))
            flat = inv.ravel()
            by = np.argsort(flat, kind="stable")
            d_share = np.add.reduceat(d_gate.reshape(-1, 6 * HIDDEN)[by], np.searchsorted(flat[by], np.arange(len(used))), axis=0)
            d_f, d_b = d_share[:, : 3 * HIDDEN], d_share[:, 3 * HIDDEN :]
            g |= {"Wf": x.T @ d_f, "Wb": x.T @ d_b, "bf": d_f.sum(axis=0), "bb": d_b.sum(axis=0)}
            d_x = d_f @ net.par["Wf"].T + d_b @ net.par["Wb"].T
            for name, value in net.par.items():
                adam(name, value, g[name], rate)
            np.subtract.at(net.word_vec, wide[used] % WORD_BUCKETS, rate * 10 * d_x[:, :EMBED])
            d_g = np.repeat(rate * 10 * d_x[:, EMBED : 2 * EMBED] / np.maximum(n_g, 1)[:, None], n_g, axis=0)
            for k in range(EMBED):
                net.gram_vec[:, k] -= np.bincount(grams[mine], weights=d_g[:, k], minlength=GRAM_BUCKETS).astype(np.float32)
    share = np.concatenate([net.gates(vocab[i : i + 20_000]) for i in range(0, max(len(vocab), 1), 20_000)]) if vocab else net.gates([b""])
    net.shift = threshold(worst(share, ids, ends, net), toxic)
    return net


def threshold(top: np.ndarray, toxic: np.ndarray, false_alarm: float = 1.0) -> float:
    """The threshold on texts' worst windows that errs least; a clean text over it counts `false_alarm` toxic ones below it."""
    order = np.argsort(top)
    wrong = np.append(0, np.cumsum(toxic[order])) + false_alarm * np.append((~toxic[order])[::-1].cumsum()[::-1], 0)
    ok = np.flatnonzero(wrong == wrong.min())
    k = int(ok[len(ok) // 2])
    edge = np.concatenate([[top.min() - 1], top[order], [top.max() + 1]])
    return float((edge[k] + edge[k + 1]) / 2)


def worst(share: np.ndarray, ids: np.ndarray, ends: np.ndarray, net: Network, limit: int = 4096) -> np.ndarray:
    """The greatest window logit of each text."""
    of, start, n = windows(ends)
    top = np.full(len(ends) - 1, -np.inf)
    order = np.argsort(n, kind="stable")
    for i in range(0, len(order), limit):
        win = order[i : i + limit]
        steps = max(1, int(n[win].max()))
        pos = np.minimum(start[win][:, None] + np.arange(steps), max(len(ids) - 1, 0))
        at = ids[pos] if len(ids) else np.zeros_like(pos)
        np.maximum.at(top, of[win], forward(share, at, n[win], net.par))
    return top


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[float]] | None:
    """(id, text, toxic) of about SAMPLE_PER_LABEL documents of each label, of any length, picked by a hash of the id, and how many
    labelled documents one of each label stands for; None without any. Written. A document that is labelled both ways counts as toxic.
    """
    named = labels.where("toxic in (0, 1)").groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    known = named.join(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    sizes = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    label = [(r["__id"], y) for y, n in sizes.items() for r in hash_sample(known.where(F.col("__toxic") == y), n, SAMPLE_PER_LABEL, "__id", seed=17).collect()]
    if not label:
        return None
    small = docs.sparkSession.createDataFrame(label, "__id long, __toxic int")
    got = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(small), docs[id_col] == F.col("__id"))
    sample = written(got.select(F.col("__id").alias("id"), F.col(text_col).alias("text"), F.col("__toxic").alias("toxic")), "toxicity-sample")
    return sample, [max(1.0, sizes.get(y, 0) / max(1, sum(k == y for _, k in label))) for y in (0, 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pos, neg): how many toxic and other texts hold a word or n-gram bucket; key -1: how many there are."""
    pos, neg = np.zeros((2, WORD_KEYS + GRAM_BUCKETS + 1), np.int64)
    for batch in batches:
        texts, toxic = as_bytes(batch.column("text")), batch.column("toxic").to_numpy() == 1
        for lo, hi in slices(texts):
            some = Texts.of(texts[lo:hi]).counts(toxic[lo:hi])
            pos[1:] += some[0].astype(np.int64)
            neg[1:] += some[1].astype(np.int64)
        pos[0] += toxic.sum()
        neg[0] += (~toxic).sum()
    at = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(pos[at]), pa.array(neg[at])], names=["key", "pos", "neg"])


def _passages(held):
    """Long texts cut to PASSAGE words about their window of the greatest log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = as_bytes(batch.column("text"))
            for k, text in enumerate(out):
                if len(text) > SAMPLE_BYTES:
                    _, start, _, hot = Texts.of([text]).heat(held.value)
                    words = text.split()
                    lo = max(0, min(int(start[hot.argmax()]) - (PASSAGE - WINDOW) // 2, len(words) - PASSAGE))
                    out[k] = b" ".join(words[lo : lo + PASSAGE])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary()), batch.column("toxic")], names=["id", "text", "toxic"])

    return run


def _tops(held):
    """The greatest window logit of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(held.value.gates, 6 * HIDDEN, 120_000)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(worst_windows(batch.column("text"), table, held.value))], names=["toxic", "top"])

    return run


def worst_windows(column: pa.Array, table: WordTable, net: Network) -> np.ndarray:
    """The greatest window logit of each text; table: the words' gates."""
    top = np.zeros(len(column))
    for lo, hi, texts in in_slices(column):
        words, ends = split_words(texts)
        ids = table.rows(words)
        top[lo:hi] = worst(table.matrix, ids, ends, net)
    return top


def score(docs: DataFrame, net: Network | None, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) to docs, from windows over every whole text; any 16 words in a row stand whole in one.

    Null and empty texts have one empty window. Without a network all score 0. Rows stay as they are; columns of these names are replaced.
    """
    docs = docs.drop(score_col, predicted_col)
    held = docs.sparkSession.sparkContext.broadcast(net)
    given, text_at = docs.columns, docs.columns.index(text_col)
    docs = plain_names(docs)
    names = docs.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        table = WordTable(net.gates, 6 * HIDDEN, 120_000) if net else None
        for batch in batches:
            out = 1 / (1 + np.exp(-np.clip(worst_windows(batch.column(text_at), table, net) - net.shift, -30, 30))) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, types + ", score double, predicted int").toDF(*given, score_col, predicted_col)


def held_out(doc_id: Column) -> Column:
    """The documents whose labels op2 never learns from."""
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The production network, from labelled documents that are not held out: log odds and threshold from whole texts, in tasks; gradient steps on the driver."""
    drawn = labelled_sample(docs.where(~held_out(F.col("doc_id"))), labels)
    if drawn is None:
        return None
    sample, stands_for = drawn
    found = sample.mapInArrow(_count, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    both = np.zeros((2, WORD_KEYS + GRAM_BUCKETS + 1))
    both[:, found["key"].to_numpy() + 1] = found["pos"].to_numpy(), found["neg"].to_numpy()
    n_pos, n_neg = both[:, 0]
    if not n_pos or not n_neg:
        return None
    odds = _odds(both[0, 1:], both[1, 1:], n_pos, n_neg)
    context = docs.sparkSession.sparkContext
    first = Network(odds[:WORD_KEYS], odds[WORD_KEYS:], np.zeros((WORD_BUCKETS, EMBED), np.float32), np.zeros((GRAM_BUCKETS, EMBED), np.float32), {})
    got = sample.mapInArrow(_passages(context.broadcast(first)), "id long, text binary, toxic int").collect()
    net = fit([(bytes(r["text"]), r["toxic"]) for r in sorted(got, key=lambda r: (r["id"], bytes(r["text"])))], odds=odds)
    tops = sample.mapInArrow(_tops(context.broadcast(net)), "toxic int, top double").toArrow()
    # clean texts stand for more of the corpus than toxic ones, where the sample has a smaller part of them
    net.shift = threshold(tops["top"].to_numpy(), tops["toxic"].to_numpy() == 1, stands_for[0] / stands_for[1])
    return net


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), net).select("doc_id", "held_out", "score", "predicted")

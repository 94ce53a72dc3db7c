"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by the scaled forward recursion.

The states emit the FREQUENT most counted tokens and one class for all others; a token of that class has its share of the
class by its count. Token counts cover the whole training corpus; only the frequent tokens' numbers (a fixed bound) go to every task,
all others are joined.

The states start from all training documents: each has a short vector of its frequent tokens, the vectors' clusters are split along their widest
direction until there is one for each state, and a pass over all tokens counts them by their documents' clusters.

How a token spreads over the states is shrunk towards how all tokens do, by a weight that is fitted across two halves of the training
documents: rare tokens say little of the state. The states' mixture keeps every token's unigram probability, so without any evidence the model is its own base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import CACHE, SLICE, fold, in_slices, mix, release, split_words, written

STATES = 5
#: The most tokens with emission probabilities of their own, the end of a text included.
FREQUENT = 1 << 17
#: Tokens of a training segment, and those on both sides that the messages over its borders run through first: a long text's segments go side by side, and every
#: token and transition counts in one of them.
SEGMENT, RUN_UP = 256, 32
#: Baum-Welch passes over the whole training corpus.
PASSES = 2
#: Numbers of a document's vector; the share of all tokens from which on a token weighs less in it; passes over all vectors after the last split.
WIDE, COMMON, SETTLE = 64, 1e-3, 4
#: Weights (in tokens) of the states' shares in how one token spreads over them, of which the best is taken; the weight before that; the weight
#: of a flat distribution in the transitions.
WEIGHTS, WEIGHT, FLAT = (0.1, 0.5, 2.0, 8.0, 32.0, 256.0), 2.0, 1.0
#: The hash of a text's end; no word has it but by chance of 2**-64.
END = -1
#: Tokens of a block of the exact forward recursion.
BLOCK = 32


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 5) - (1 << 63)


class Index(dict):
    """Word (lower-case bytes) -> its place among the frequent tokens, or FREQUENT's end for all others. Bounded."""

    def __init__(self, places: dict[int, int], other: int) -> None:
        release()
        self.places, self.other = places, other

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        i = self[word] = self.places.get(_hash(word), self.other)
        return i


@dataclass
class Model:
    hashes: np.ndarray  # of the frequent tokens; the end of a text first
    count: np.ndarray  # their training counts
    total: int  # training tokens
    distinct: int
    start: np.ndarray
    move: np.ndarray  # K x K
    emit: np.ndarray  # (tokens + 1) x K; last: the class of all others

    @property
    def unigram(self) -> np.ndarray:
        own = (self.count + 0.5) / self.norm
        return np.append(own, self.other_norm / self.norm)

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def other_norm(self) -> float:
        """Counts and smoothing of all tokens that aren't frequent, an unseen one included."""
        return max(0.5, float(self.total - self.count.sum()) + 0.5 * (self.distinct + 1 - len(self.count)))


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h long, n long): how often each token occurs in all texts; each text ends with END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        texts_n = 0

        def flush() -> pa.RecordBatch:
            h = np.fromiter(map(_hash, sums), np.int64, len(sums))
            out = pa.RecordBatch.from_arrays([pa.array(np.append(h, END)), pa.array(np.append(np.fromiter(sums.values(), np.int64, len(sums)), texts_n))], names=["h", "n"])
            sums.clear()
            return out

        for batch in batches:
            for lo, hi, texts in in_slices(batch.column(0)):
                words, _ = split_words([t.lower() if t else t for t in texts])
                texts_n += hi - lo
                get = sums.get
                for w in words:
                    sums[w] = get(w, 0) + 1
                if len(sums) > 2 * CACHE:
                    yield flush()
                    texts_n = 0
        if sums or texts_n:
            yield flush()

    return docs.select(text_col).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 0")


def most_counted(counts: DataFrame, most: int) -> DataFrame:
    """About `most` tokens of the greatest counts; of the step of counts that they end in, some by hash. Only a histogram of counts reaches the driver before."""
    step = F.floor(F.log2("n") * 16).cast("int")
    total = 0
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect():  # at most 16 * 63 rows
        if total + r["k"] > most:
            part = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < int((1 << 40) * (most - total) / r["k"])
            return counts.where((step > r["step"]) | ((step == r["step"]) & part))
        total += r["k"]
    return counts


def _tokens(texts: list[bytes | None], index: Index) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Token places of all texts in a row with an end (0) after each, where each text's begin, and the words."""
    words, ends = split_words([t.lower() if t else t for t in texts])
    ids = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
    return np.insert(ids, ends[1:], 0), ends + np.arange(len(ends)), words


def _pieces(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, tokens) of all pieces of `size` tokens."""
    n = np.diff(ends)
    count = -(-n // size)
    text = np.repeat(np.arange(len(n)), count)
    j = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, ends[text] + j * size, np.minimum(size, n[text] - j * size)


def expected(ids: np.ndarray, ends: np.ndarray, m: Model, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch expectations of some texts: adds to emissions (tokens x K), returns (starts, moves).

    A text of over SEGMENT tokens is gone through in segments side by side. The messages over a segment's borders come from RUN_UP tokens
    on either side; its own tokens, and the transition into each, count once.
    """
    k = len(m.start)
    text, first, n = _pieces(ends, SEGMENT)
    before = np.minimum(RUN_UP, first - ends[text])
    after = np.minimum(RUN_UP, ends[text + 1] - first - n)
    begin = first == ends[text]
    first, n = first - before, before + n + after
    order = np.argsort(-n, kind="stable")
    first, n, begin = first[order], n[order], begin[order]
    own, stop = before[order], (n - after[order])
    still = m.start @ np.linalg.matrix_power(m.move, 64)
    steps = int(n.max()) if len(n) else 0
    alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps)]  # segments with over t tokens
    alphas, probs, scales = [], [], []
    a = np.where(begin[:, None], m.start, still)
    for t in range(steps):
        live = alive[t]
        p = m.emit[ids[first[:live] + t]]
        a = (a[:live] if not t else a[:live] @ m.move) * p
        c = a.sum(axis=1, keepdims=True)
        a = a / c
        alphas.append(a)
        probs.append(p)
        scales.append(c)
    moves = np.zeros((k, k))
    starts = np.zeros(k)
    b = np.ones((0, k))
    gammas, seen = [], []
    for t in range(steps - 1, -1, -1):
        live = alive[t]
        full = np.ones((live, k))
        if t + 1 < steps:
            later = alive[t + 1]
            x = probs[t + 1] * b / scales[t + 1]
            mine = ((t + 1 >= own[:later]) & (t + 1 < stop[:later]))[:, None]  # the transition into token t + 1
            moves += (alphas[t][:later] * mine).T @ x
            full[:later] = x @ m.move.T
        b = full
        g = alphas[t] * b
        g /= g.sum(axis=1, keepdims=True)
        if not t:
            starts += g[begin].sum(axis=0)
        mine = np.flatnonzero((t >= own[:live]) & (t < stop[:live]))
        gammas.append(g[mine])
        seen.append(ids[first[mine] + t])
    if seen:
        at, g = np.concatenate(seen), np.concatenate(gammas)
        for s in range(k):
            emissions[:, s] += np.bincount(at, weights=g[:, s], minlength=len(emissions))
    return starts, moves * m.move


def emitting(m: Model, emissions: np.ndarray, weight: float) -> np.ndarray:
    """Emission probabilities from expected counts: a token's spread over the states is shrunk to the states' shares by `weight` tokens."""
    shares = (emissions.sum(axis=0) + 1) / (emissions.sum() + emissions.shape[1])
    spread = (emissions + weight * shares) / (emissions.sum(axis=1, keepdims=True) + weight)
    out = spread * m.unigram[:, None]
    return out / out.sum(axis=0)


def improved(m: Model, starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, weight: float = WEIGHT) -> Model:
    """The maximisation step, with shrunk emissions."""
    start = (starts + FLAT) / (starts + FLAT).sum()
    move = (moves + FLAT) / (moves + FLAT).sum(axis=1, keepdims=True)
    return Model(m.hashes, m.count, m.total, m.distinct, start, move, emitting(m, emissions, weight))


def _vectors(ids: np.ndarray, ends: np.ndarray, m: Model) -> np.ndarray:
    """A vector of length 1 for each text: its frequent tokens, common ones weighing less, are added with a hashed sign to one of WIDE numbers."""
    h = mix(m.hashes.view(np.uint64))
    place = np.append(h % np.uint64(WIDE), 0).astype(np.int64)
    weight = np.minimum(1.0, np.sqrt(COMMON * max(m.total, 1) / np.maximum(m.count, 1))) * np.where(h >> np.uint64(63), -1.0, 1.0)
    weight = np.append(weight, 0.0)  # all others
    weight[0] = 0.0  # the end
    n = len(ends) - 1
    out = np.bincount(np.repeat(np.arange(n) * WIDE, np.diff(ends)) + place[ids], weights=weight[ids], minlength=n * WIDE).reshape(n, WIDE)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype("<f4")


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's numbers as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _placed(docs: DataFrame, m: Model, text_col: str, id_col: str) -> DataFrame:
    """(ids binary, n int, vector binary, half int) of all documents, written once for all passes.

    A text's token places (four bytes each) and how many, its vector (four bytes a number), and which half its id is dealt to.
    """
    held = docs.sparkSession.sparkContext.broadcast(Model(m.hashes, m.count, m.total, m.distinct, m.start, m.move, m.emit[:0]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        index = Index({int(h): i for i, h in enumerate(m.hashes)}, len(m.hashes))
        for batch in batches:
            for lo, hi, texts in in_slices(batch.column(0)):
                ids, ends, _ = _tokens(texts, index)
                vectors = _binary(_vectors(ids, ends, m), np.arange(hi - lo + 1) * WIDE)
                columns = [_binary(ids.astype("<i4"), ends), pa.array(np.diff(ends).astype(np.int32)), vectors, batch.column(1).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "n", "vector", "half"])

    half = F.pmod(F.xxhash64(id_col, F.lit(37)), F.lit(2)).cast("int")
    return written(docs.select(text_col, half.alias("half")).mapInArrow(place, "ids binary, n int, vector binary, half int"), "token-places")


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token places of some texts in a row, and where each text's begin."""
    return np.frombuffer(b"".join(parts), "<i4"), np.cumsum([0, *map(len, parts)]) // 4


def _totals(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], rows: int, k: int) -> np.ndarray:
    """A matrix (rows x k) of sums: each task adds its batches' to one, Spark sums the tasks'."""
    names = [f"e{s}" for s in range(k)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        out = np.zeros((rows, k))
        for batch in batches:
            add(batch, out)
        at = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(out[at, s]) for s in range(k))], names=["at", *names])

    got = df.mapInArrow(sums, "at int, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((rows, k))
    for s, c in enumerate(names):
        out[got.column("at").to_numpy(), s] = got.column(c).to_numpy()
    return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(axis=1) - 2 * x @ centers.T, axis=1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<f4").reshape(-1, WIDE).astype(float)


def _centers(places: DataFrame, k: int) -> np.ndarray:
    """k centers of all documents' vectors, each document weighing its tokens: the cluster that is widest in one direction is split along it, again and again."""
    vectors = places.select("n", "vector")
    vectors = vectors.coalesce(max(1, vectors.rdd.getNumPartitions() // 4))  # they are a small part of the table that Spark cuts into partitions
    centers = np.zeros((1, WIDE))
    for _ in range(k - 1 + SETTLE):
        split = len(centers) < k

        def add(batch: pa.RecordBatch, out: np.ndarray, centers: np.ndarray = centers, split: bool = split) -> None:
            x, n = _matrix(batch.column("vector")), batch.column("n").to_numpy()
            near = _nearest(x, centers)
            for c in range(len(centers)):
                y, w = x[near == c], n[near == c]
                out[0, c] += w.sum()
                out[1 : WIDE + 1, c] += w @ y
                if split:
                    out[WIDE + 1 :, c] += ((y.T * w) @ y).ravel()

        got = _totals(vectors, add, 1 + WIDE + WIDE**2 * split, len(centers))
        n = np.maximum(got[0], 1)
        centers = np.where(got[0] > 0, got[1 : WIDE + 1] / n, centers.T).T
        if split:
            spread = got[WIDE + 1 :].T.reshape(-1, WIDE, WIDE) - got[0][:, None, None] * centers[:, :, None] * centers[:, None, :]
            values, axes = np.linalg.eigh(spread)
            c = int(values[:, -1].argmax())
            axis = axes[c, :, -1] * np.sign(axes[c, np.abs(axes[c, :, -1]).argmax(), -1])
            step = axis * np.sqrt(max(values[c, -1], 0) / n[c])
            centers = np.vstack([centers, centers[c] + step])
            centers[c] -= step
    return centers


def _first(m: Model, places: DataFrame) -> Model:
    """Start values: each document's cluster is the state of all its tokens; Baum-Welch sets the moves."""
    k, rows = len(m.start), len(m.emit)
    held = places.sparkSession.sparkContext.broadcast(_centers(places, k))

    def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
        near = _nearest(_matrix(batch.column("vector")), held.value)
        for lo, hi, parts in in_slices(batch.column("ids")):
            ids, ends = _joined(parts)
            out += np.bincount(ids * np.int64(k) + np.repeat(near[lo:hi], np.diff(ends)), minlength=rows * k).reshape(rows, k)

    emissions = _totals(places.select("ids", "vector"), add, rows, k)
    share = emissions.sum(axis=0) / max(emissions.sum(), 1) + 0.01
    return Model(m.hashes, m.count, m.total, m.distinct, share / share.sum(), 0.9 * np.eye(k) + 0.1 / k, emitting(m, emissions, WEIGHT))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", states: int = STATES, passes: int = PASSES, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model, and the table of all token counts (h, n). Start values, weight and all passes are of all docs."""
    counts = written(token_counts(docs, text_col), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_counted(counts.where(F.col("h") != END), frequent - 1).toArrow()
    ends = counts.where(F.col("h") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hashes = np.append(END, top.column("h").to_numpy())
    count = np.append(ends, top.column("n").to_numpy()).astype(np.int64)
    m = Model(hashes, count, int(total), int(distinct), np.full(states, 1 / states), np.full((states, states), 1 / states), np.zeros((len(hashes) + 1, states)))
    places = _placed(docs, m, text_col, id_col)
    m = _first(m, places)
    starts, moves, halves = _pass(places, m, 2)
    weight = _best_weight(m, *halves)
    m = improved(m, starts, moves, halves.sum(axis=0), weight)
    for _ in range(passes - 1):
        starts, moves, emissions = _pass(places, m)
        m = improved(m, starts, moves, emissions[0], weight)
    return m, counts


def _best_weight(m: Model, one: np.ndarray, other: np.ndarray) -> float:
    """The weight under which each half's expected emissions are likeliest by what the other half's give."""
    if not (one.any() and other.any()):
        return WEIGHT
    values = [float((one * np.log(emitting(m, other, w)) + other * np.log(emitting(m, one, w))).sum()) for w in WEIGHTS]
    return WEIGHTS[int(np.argmax(np.round(values, 6)))]


def _pass(places: DataFrame, model: Model, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, moves, emissions) of one Baum-Welch pass over all documents; emissions apart for each half if there are two parts."""
    k, rows = len(model.start), len(model.emit)
    held = places.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch, out: np.ndarray) -> None:
        part = batch.column("half").to_numpy() % parts
        for lo, hi, texts in in_slices(batch.column("ids"), parts * SLICE):
            for p in range(parts):
                some = [t for t, x in zip(texts, part[lo:hi], strict=True) if x == p]
                starts, moves = expected(*_joined(some), held.value, out[p * rows : (p + 1) * rows])
                out[parts * rows] += starts
                out[parts * rows + 1 :] += moves

    got = _totals(places.select("ids", "half"), add, parts * rows + 1 + k, k)
    return got[parts * rows], got[parts * rows + 1 :], got[: parts * rows].reshape(parts, rows, k)


def log10_forward(ids: np.ndarray, ends: np.ndarray, m: Model) -> np.ndarray:
    """Each text's exact log10 likelihood: scaled products of a block's step matrices, chained by the forward recursion from block to block."""
    k = len(m.start)
    text, first, n = _pieces(ends, BLOCK)
    order = np.argsort(-n, kind="stable")
    mats = np.broadcast_to(np.eye(k), (len(n), k, k)).copy()
    logs = np.zeros(len(n))
    f, size = first[order], n[order]
    for t in range(BLOCK):
        live = int(np.searchsorted(-size, -t, side="left"))
        if not live:
            break
        x = mats[:live] * m.emit[ids[f[:live] + t]][:, None, :]
        x = (x.reshape(-1, k) @ m.move).reshape(live, k, k)
        if t % 8 == 7:
            c = x.max(axis=(1, 2))
            x /= c[:, None, None]
            logs[:live] += np.log10(c)
        mats[:live] = x
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    count = -(-np.diff(ends) // BLOCK)
    base = np.cumsum(count) - count
    out = np.add.reduceat(logs[place], base) if len(count) else np.zeros(0)
    texts = np.argsort(-count, kind="stable")
    a = np.broadcast_to(m.start, (len(count), k)).copy()
    for j in range(int(count.max()) if len(count) else 0):
        some = texts[: int(np.searchsorted(-count[texts], -j, side="left"))]
        x = np.einsum("dk,dkl->dl", a[some], mats[place[base[some] + j]])
        c = x.sum(axis=1)
        out[some] += np.log10(c)
        a[some] = x / c[:, None]
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) to docs.

    Null texts count as empty: one end. Rows stay as they are, also repeated ones; columns of these names, and those that begin with two underscores, are replaced.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*made)
    names = [c for c in docs.columns if c != text_col]
    held = docs.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        other = len(m.hashes)
        index = Index({int(h): i for i, h in enumerate(m.hashes)}, other)
        base = np.append(np.log10((m.count + 0.5) / m.norm), 0.0)
        known = np.append(m.count > 0, False)
        for batch in batches:
            for lo, hi, texts in in_slices(batch.column(text_col)):
                ids, ends, words = _tokens(texts, index)
                n = np.diff(ends)
                rare = np.flatnonzero(ids == other)
                of = np.searchsorted(ends, rare, side="right") - 1
                h = np.fromiter((_hash(words[i]) for i in (rare - of).tolist()), np.int64, len(rare))
                cut = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(n), pa.array(np.add.reduceat(known[ids].astype(np.int64), ends[:-1])), pa.array(np.add.reduceat(base[ids], ends[:-1])),
                     pa.array(log10_forward(ids, ends, m)), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(h))],
                    names=[*names, "n_tokens", "__known", "__base", "__forward", "__others", "__rare"],
                )

    part = docs.mapInArrow(run, types + ", n_tokens long, __known long, __base double, __forward double, __others long, __rare array<long>")
    part = written(part.withColumn("__row", F.monotonically_increasing_id()), "scored")
    rare = part.select("__row", F.explode("__rare").alias("h")).groupBy("__row", "h").agg(F.count(F.lit(1)).alias("k"))
    seen = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.join(counts, "h", "left").groupBy("__row").agg(F.sum(F.col("k") * F.log10(seen + 0.5)).alias("__logs"), F.sum(F.when(seen > 0, F.col("k")).otherwise(0)).alias("__more"))
    logs = F.coalesce(F.col("__logs"), F.lit(0.0))
    return part.drop("__rare").join(sums, "__row", "left").select(
        *names, "n_tokens", (F.col("__known") + F.coalesce(F.col("__more"), F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("__base") + logs - F.col("__others") * float(np.log10(model.norm))).alias("base_score"),
        (F.col("__forward") + logs - F.col("__others") * float(np.log10(model.other_norm))).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    """The documents that op8 never learns from."""
    return F.coalesce(fold(doc_id, 5) == 1, F.lit(False))


def op8_hmm_lm(spark, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    model, counts = train(docs.where("not held_out"))
    return score(docs, model, counts).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

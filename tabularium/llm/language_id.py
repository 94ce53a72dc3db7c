"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import WordTable, as_bytes, char_grams, fold, slices, split_words

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Added to each n-gram count.
SMOOTH = 0.5
#: The least gap between the mean losses of the best two languages; below it a text is flagged as ambiguous.
GAP = 0.02


def codewords(k: int) -> np.ndarray:
    """A k x bits matrix of +1 and -1 with different rows: every split of k <= 6 languages in two, else fixed random splits."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        splits = np.arange(1, 1 << (k - 1))
    else:
        rng = np.random.default_rng(5)
        bits = 10 * int(np.ceil(np.log2(k)))
        while True:
            code = np.where(rng.random((k, bits)) < 0.5, -1, 1).astype(np.int8)
            if len({r.tobytes() for r in code}) == k and (np.abs(code.sum(axis=0)) < k).all():
                return code
    return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(k)], np.int8)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits: log odds of bit +1 for an n-gram
    scale: np.ndarray  # bits: the mean size of a margin on the language's own n-grams
    trust: np.ndarray  # languages x bits: loss weights

    def decode(self, margin: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest codeword, its share, ambiguous) from mean log odds per n-gram."""
        m = np.clip(margin / self.scale, -3, 3)
        loss = np.log1p(np.exp(-2 * m[:, None, :] * self.code[None])) * self.trust[None]
        loss = loss.sum(axis=2) / self.trust.sum(axis=1)
        best = loss.argmin(axis=1)
        odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(grams, 1))[:, None])
        share = 1 / odds.sum(axis=1)
        order = np.sort(loss, axis=1)
        ambiguous = (order[:, 1] - order[:, 0] < GAP) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, share, ambiguous


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Counts the n-grams of all texts by language (summed over partitions) and sets the bits' classifiers from them.

    The driver gets BUCKETS counts for each language. None if there is no labelled text with a word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = as_bytes(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                words, ends = split_words(texts[lo:hi])
                if not words:
                    continue
                index: dict[bytes, int] = {}
                ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
                grams, who = char_grams(list(index), SIZES, BUCKETS)
                of = np.repeat(np.arange(hi - lo), np.diff(ends))
                names = np.array(langs[lo:hi], object)
                for lang in set(langs[lo:hi]):
                    n = np.bincount(ids[(names == lang)[of]], minlength=len(index))
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams, weights=n[who], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])

    rows = docs.select(text_col, lang_col).where(f"`{text_col}` is not null and `{lang_col}` is not null").mapInArrow(count, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    at = {lang: i for i, lang in enumerate(langs)}
    counts[[at[x] for x in rows.column("lang").to_pylist()], rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    share = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, other = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(one) and len(other):
            weights[:, b] = np.log(one.mean(axis=0)) - np.log(other.mean(axis=0))
    own = (share @ weights) * code  # the mean margin of each language on its own text
    trust = np.maximum(own, 1e-3)
    return Model(langs, code, weights, np.maximum(np.abs(own).mean(axis=0), 1e-3), trust / trust.max())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous to docs.

    `und` with score 0 for a null text, a text without any letter, or without a model. Each whole text is scored; rows stay
    as they are, and columns of these three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        bits = model.code.shape[1] if model else 1

        def sums(words: list[bytes]) -> np.ndarray:
            out = np.zeros((len(words), bits + 2), np.float32)
            grams, who = char_grams(words, SIZES, BUCKETS)
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else who
            if model and len(who):
                out[who[first], :bits] = np.add.reduceat(model.weights[grams], first, axis=0)
                out[who[first], bits] = np.diff(np.append(first, len(who)))
            for i, w in enumerate(words):
                s = w.decode("utf-8", "replace")
                out[i, bits + 1] = s.isalpha() or any(map(str.isalpha, s))
            return out

        table = WordTable(sums, bits + 2)
        for batch in batches:
            texts = as_bytes(batch.column(text_col))
            total = np.zeros((len(texts), bits + 2))
            for lo, hi in slices(texts):
                words, ends = split_words(texts[lo:hi])
                if words:
                    ids = table.rows(words)
                    some = np.flatnonzero(np.diff(ends))
                    total[lo + some] = np.add.reduceat(table.matrix[ids].astype(np.float64), ends[some], axis=0)
            known = (total[:, bits + 1] > 0) & bool(model)
            lang, share, unsure = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known.any():
                n = total[known, bits]
                best, part, amb = model.decode(total[known, :bits] / np.maximum(n, 1)[:, None], n)
                lang[known], share[known], unsure[known] = np.array(model.langs, object)[best], part, amb
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang.tolist(), pa.string()), pa.array(share), pa.array(unsure)], names=[*names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(score, types + ", lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    """The documents that op5 never learns from."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")

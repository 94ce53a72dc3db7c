"""Token files, tokenizer alignment and spelling variants against brute force, round trips, and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tabularium.llm import alignment, chunks, fm_index, spelling, token_files

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  a", "a ", "\n", "ünï cödé 中文 ```<|endoftext|>x", "a▁b c", "🙂🙂 👩‍👩‍👧 x", "<s> </s> <0x41>", "\x00 a\x00b", "é \té", "日本語テキスト ק", "a  b   c", "x" * 3000,
    "𐍈𐍈 𐍈", "foo \nbar", "​a ​ b", "\x1c a \x85 b", "one two one two", "one two one two", "a  b", "don't  stop'ing 123 4567",
]
DOCS = "doc_id long, text string, `my.extra` string, name string"


def docs_of(spark, texts):
    return spark.createDataFrame([(None if i == 5 else 4 if i == 3 else i, t, None, "n") for i, t in enumerate(texts)], DOCS)


# Simple-8b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**32 - 1), st.just(0)), max_size=3000))
def test_pack_round_trip(ids):
    ids = np.array(ids, np.uint32)
    file = token_files.TokenFile(token_files.to_bytes([1], [len(ids)], ids))
    assert (file.ids() == ids).all() and file.n_ids == len(ids)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 70_000])
def test_blocks_decode_alone(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2, n), rng.integers(0, 50_257, n), np.zeros(n), np.full(n, 2**32 - 1), np.where(rng.random(n) < 0.01, 2**31, rng.integers(0, 31, n))):
        ids = ids.astype(np.uint32)
        file = token_files.TokenFile(token_files.to_bytes([None], [n], ids))
        assert file.doc_ids == [None]
        for _ in range(20):
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (file.ids(lo, hi) == ids[lo:hi]).all()


def test_words_follow_the_selectors():
    words, *_ = token_files.pack(np.array([1] * 60 + [70_000] * 3, np.uint32))
    assert [int(w) >> 60 for w in words] == [2, 13] and int(words[0]) & (1 << 60) - 1 == (1 << 60) - 1
    assert int(words[1]) & (1 << 60) - 1 == 70_000 | 70_000 << 20 | 70_000 << 40


def test_escapes_pay():
    """One wide id among narrow ones takes 32 more bits, not a word of its own."""
    ids = np.full(1024, 100, np.uint32)
    ids[500] = 2**31
    words, _, escapes, _ = token_files.pack(ids)
    assert escapes.tolist() == [2**31] and len(words) == -(-1024 // 8)


def test_not_a_token_file():
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else entirely")


@pytest.mark.parametrize("file_ids", [1, 50, 1 << 21])
def test_files_round_trip(spark, tmp_path, file_ids):
    texts = ODD + [" ".join(random.Random(i).choices(["alpha", "beta", "gamma", "x1"], k=i)) for i in range(40)]
    docs = docs_of(spark, texts)
    files = token_files.write_ids(docs, f"file://{tmp_path}/out", file_ids=file_ids)
    got = token_files.read_ids(spark, f"file://{tmp_path}/out", files, keep_ids=True).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BYTES)
    of = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((r["doc_id"], tuple(of(r["text"]))) for r in docs.collect())
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        start += r["n_tokens"]
    assert not list((tmp_path / "out").glob(".*s8b*[!c]"))  # nothing half written


def test_no_documents_no_files(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    files = token_files.write_ids(empty, f"file://{tmp_path}/none")
    assert files.count() == 0 and token_files.read_ids(spark, f"file://{tmp_path}/none", files).count() == 0


def test_op13(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    tokenizer, want, start = Tokenizer.from_file(BYTES), [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.op13_token_output(spark, sf).collect()) == want


# chunks


def test_chunks_of_vocabularies_that_cannot_be_cut():
    assert chunks.cuts([b"a", b" b", b"  "]) and not chunks.cuts([b"a b"]) and chunks.cuts([b" \xc2\xa0 "])
    seen = []
    whole = chunks.Chunks(lambda new, safe: seen.extend(new), lambda: None, whole=True)
    at, cut = whole.numbers(pa.array(["a b", "c d", "a b", None]))
    assert at.tolist() == [0, 1, 0, 2] and cut.tolist() == [0, 1, 2, 3, 4] and seen == ["a b", "c d", ""]


def test_small_caches_start_anew():
    coder = alignment.Aligner(BYTES, PIECES, chunks=3)
    texts = ["one two three", "four five six", "one seven eight", "one two three"]
    got = [next(iter(coder.align(pa.array([t]))))[3] for t in texts]
    assert got[0] == got[3] == next(iter(alignment.Aligner(BYTES, PIECES).align(pa.array(texts[:1]))))[3]


# alignment


@pytest.fixture(scope="module")
def both():
    return alignment.ByteLevel(BYTES), alignment.Pieces(PIECES), SentencePieceProcessor(model_file=PIECES)


def aligned(both, text):
    """Tokens of the whole text, cut where both end."""
    a, b, model = both
    if not text:
        return 0, 0, [], ""
    one, two, raw = a.tokenizer.encode(f" {text}", add_special_tokens=False).ids, model.encode(text), f" {text}".encode()
    if b"".join(a.bytes[i] for i in one) != raw or b"".join(b.bytes[i] for i in two) != raw:
        return 0, 0, [], ""
    end_a, end_b = np.cumsum([len(a.bytes[i]) for i in one]).tolist(), np.cumsum([len(b.bytes[i]) for i in two]).tolist()
    assert a.spans(text)[1].tolist() == end_a and b.spans(text)[1].tolist() == end_b
    met = set(end_a) & set(end_b)
    groups = ([[]], [[]])
    for ids, ends, out in ((one, end_a, groups[0]), (two, end_b, groups[1])):
        for i, e in zip(ids, ends, strict=True):
            out[-1].append(i)
            if e in met:
                out.append([])
    pairs = list(zip(groups[0][:-1], groups[1][:-1], strict=True))
    text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in pairs)
    return len(one), len(two), [(x[-1], y[-1]) for x, y in pairs], hashlib.sha256(text.encode()).hexdigest()


def expected(both, rows):
    found = [(i, aligned(both, t)) for i, t in rows]
    n = collections.Counter(p for _, f in found for p in f[2])
    most: dict = collections.defaultdict(int)
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    return collections.Counter((i, f[0], f[1], len(f[2]), len(f[2]), sum(n[p] == most[p[1]] for p in f[2]), sum(n[p] for p in f[2]), f[3]) for i, f in found)


@pytest.mark.parametrize("frequent", [1 << 19, 10, 0])
def test_alignment_of_odd_texts(spark, both, frequent):
    docs = docs_of(spark, ODD)
    got = alignment.align(docs, frequent=frequent).collect()
    assert collections.Counter(tuple(r) for r in got) == expected(both, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_op12(spark, sf, both):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert collections.Counter(tuple(r) for r in alignment.op12_tokenizer_alignment(spark, sf).collect()) == expected(both, rows)


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).count() == 0


# spelling


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        for c in letters:
            out.add(word[:i] + c + word[i:])
            if i < len(word):
                out.add(word[:i] + c + word[i + 1 :])
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
    return out - {word}


@pytest.mark.parametrize("n", [1, 2, 40, 2000])
def test_search_schemes_find_all(n):
    rng = random.Random(n)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(2, 9))) for _ in range(n)})
    queries = words + ["".join(rng.choices("abzé", k=rng.randint(2, 9))) for _ in range(100)]
    index, at = fm_index.WordIndex(words), {w: i for i, w in enumerate(words)}
    for first in (True, False):
        got = {(int(a), int(b)) for q, k in index.near(queries, first) for a, b in zip(q, k, strict=True)}
        half = lambda w, e: e.startswith(w[: len(w) // 2]) if first else e.endswith(w[len(w) // 2 :])
        assert got == {(i, at[e]) for i, w in enumerate(queries) for e in edits(w, "abzé") if e in at and half(w, e)}


def forms(counts):
    near = {w: [e for e in edits(w, sorted(set("".join(counts)))) if e in counts] for w in counts}
    best = {w: min(x, key=lambda e: (-counts[e], e)) for w, x in near.items() if x}
    form = {w: f for w, f in best.items() if counts[f] >= 2 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def vocabulary(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_variants_of_planted_words(spark, block):
    """Chains of forms, ties, a hot half that is dealt into blocks, repeated rows, null ids and texts."""
    rng = random.Random(4)
    words = ["colour"] * 40 + ["color"] * 9 + ["colr" + "o"] * 4 + ["ÀÉçaé"] * 3 + ["àÉçaé"] * 3
    words += [w for w in ("prefix" + "".join(rng.choices("abc", k=4)) for _ in range(150)) for _ in range(rng.randint(3, 9))]
    rng.shuffle(words)
    rows = [(i % 50 if i % 7 else None, " ".join(words[i :: 60]).upper() if i % 2 else ", ".join(words[i :: 60])) for i in range(60)] + [(1, None), (2, ""), (3, "12 -- ab"), (9, "Zebra " * 30_000), (9, "Zebra " * 30_000)]
    docs = spark.createDataFrame([(i, t, None, "n") for i, t in rows], DOCS)
    got = sorted(tuple(r) for r in spelling.variants(docs, bucket=64, block=block).collect())
    assert got == forms(vocabulary(rows)) and any(r[1] for r in got)


def test_op11(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in spelling.op11_spelling_variants(spark, sf).collect()) == forms(vocabulary(rows))


def test_roots_follow_long_chains(spark):
    steps = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(37)] + [("x", "w05")]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(steps, "word string, form string")).collect())
    assert set(got.values()) == {"w37"} and len(got) == 38


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words", None, None)], DOCS)).count() == 0

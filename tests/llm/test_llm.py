"""The training-data operators against brute force, on planted cases, and on nulls, empty texts, ties, repeats and empty tables."""

import bisect
import collections
import hashlib
import itertools
import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.llm import common, components, decontamination, embedding_dedup, hmm_lm, language_id, ngram_join, packing, sharding, substring_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts, **extra):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, one very long text."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", None, 3), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (None, "one two three four five six", None, "s", 1), (5, "word " * 30_000, "fr", "s", 1), (6, "ünï cödé 中文 ```<|endoftext|>x", "de", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# sharding


def feistel(x, n, seed):
    a = max(1, math.isqrt(n))
    b = -(-max(n, 1) // a)

    def mixed(x, key):
        s = (x % sharding.PRIME + key) % sharding.PRIME
        t = (s * s + key) % sharding.PRIME
        return ((t + x % 65521) ** 2 % sharding.PRIME * 48271 + x) % sharding.PRIME

    while True:
        left, right = divmod(x, b)
        for i, k in enumerate(sharding.KEYS):
            key = (k + seed * 7919) % sharding.PRIME
            if i % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 23, 100, 997, 1000, 2047])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n, 3).alias("p")).orderBy("id").select("p").collect()]
    assert got == [feistel(i, n, 3) for i in range(n)] and sorted(got) == list(range(n))


def test_shards(spark, sf):
    got = sharding.op1_sharding(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in got)


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 40, "x" * (i % 3)) for i in range(120)], "id long, slot string")
    key = lambda d: sorted(map(tuple, sharding.shard(d, "id", 5).collect()))
    assert key(df) == key(df.repartition(7, "slot"))


def test_shard_odd(odd, empty):
    got = sharding.shard(odd, "doc_id", 3).collect()
    assert len(got) == 8 and sharding.shard(empty, "doc_id", 3).count() == 0


# url rules


def test_urls(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(map(str, c.sql(f"select page_id, host, path, rule, verdict from ({url_filter.OP3_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in url_filter.op3_url_filter(spark, sf).collect()) == want


def test_nested_rules_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 10)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "com", "ab.com", "A.COM", "net", "com.net", "a-b.com", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/", "/x/y?q", "#f")] + [None, "nothing", "://"] + ["http://b.a.com/x/"] * 60
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = [("com", "/", "allow"), ("a.com", "/x/", "block"), ("b.a.com", "/", "block"), ("x.b.a.com", "/x", "allow"), ("net", "/x/y", "block"), (None, "/", "block"), ("a.com", "/x/", "block")]
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2]), u


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).first()["verdict"] == "allow"


# packing


def test_tokens_and_places(spark, sf):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(packing.TOKENIZER))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    got = packing.pack(docs, capacity=300, keep_ids=True).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d in docs.collect():
        ids = [*t.encode(d["text"], add_special_tokens=False).ids, 1]
        rows = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [x for r in rows for x in r["ids"]] == ids and all(r["length"] == 300 for r in rows[:-1])
        assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) for r in rows)
    assert_layout(got, 300)


def assert_layout(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_odd_chunks_are_encoded_exactly(odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(packing.TOKENIZER))
    texts = ["I'll don't `a` ` `` it's", "ǅ ŉ İstanbul ΑΣ K é ́x", "a b c 1234 x1y2", "<|endoftext|> x<|startoftext|>y", "Größe naïve ŒUVRE", "", "!!! ... --"]
    got = packing.ChunkIds(path(packing.TOKENIZER)).encode([x.encode() for x in texts])
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_best_two_fit_beats_greedy():
    counts = np.zeros(101, np.int64)
    counts[[55, 40, 25, 22]] = [6, 6, 6, 6]
    layout = packing.best_two_fit(counts, 100)
    used = np.zeros(101, np.int64)
    for times, bin_ in layout:
        assert sum(x * k for x, k in bin_.items()) <= 100
        for x, k in bin_.items():
            used[x] += k * times
    assert (used == counts).all()
    # greedy filling leaves 55 + 40; for the 40, two pieces of 22 fill its gap more tightly
    assert layout[0][1] == {55: 1, 22: 2}


def test_pack_many(spark):
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(1, 101, 3000), np.full(1500, 37)])
    pieces = spark.createDataFrame([(i, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, length long, ids_crc32 long")
    n = assert_layout(packing.places(pieces, 100).collect(), 100)
    assert n <= 1.002 * best_fit_decreasing(lengths.tolist(), 100)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, gap - x)
    return len(gaps)


def test_pack_odd(odd, empty):
    got = packing.pack(odd).collect()
    assert sum(r["length"] for r in got if r["doc_id"] in (1, 2, 3)) == 3 and len([r for r in got if r["doc_id"] == 4]) == 2
    assert packing.pack(empty).count() == 0
    assert packing.sequences(packing.pack(odd, keep_ids=True)).count() == len({r["sequence_id"] for r in got})


# decontamination


def planted(rng):
    items = [prose(rng, n) for n in (40, 25, 15, 7, 6, 3)]
    texts = [prose(rng, 200) for _ in range(30)]
    words = items[0].split()
    for i in range(6, 40, 7):
        words[i] = "changed"
    texts[3] = prose(rng, 50) + " " + items[0].upper() + "! " + prose(rng, 20)
    texts[7] = prose(rng, 9) + " " + " ".join(words) + " " + prose(rng, 9)
    texts[8] = items[2].replace(" ", ", ")
    texts[9] = prose(rng, 5) + " " + " ".join(items[1].split()[3:18])
    texts[10] = prose(rng, 5) + " " + items[3]
    texts[11] = " ".join(items[1].split()[:8]) + " " + prose(rng, 30)
    texts[12] = items[4] + " " + prose(rng, 10) + " " + items[4]
    texts[13] = items[5]
    return items, texts, {(3, 0), (7, 0), (8, 2), (9, 1), (10, 3), (12, 4)}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_planted_benchmark(spark, odd, empty, limit):
    items, texts, want = planted(np.random.default_rng(5))
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, ""), (None, "x y z")], "item_id long, text string")
    docs = docs_of(spark, texts)
    got = decontamination.contamination(docs, bench, broadcast_bytes=limit)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    exact = got.where("doc_id = 3").first()
    assert (exact["word_start"], exact["word_end"], exact["coverage"]) == (50, 90, 1.0)
    assert decontamination.contamination(odd, bench, broadcast_bytes=limit).count() == 0
    assert decontamination.contamination(empty, bench, broadcast_bytes=limit).count() == 0
    assert decontamination.contamination(docs, bench.limit(0), broadcast_bytes=limit).count() == 0
    assert sorted(r["doc_id"] for r in decontamination.remove_contaminated(docs, bench).collect()) == [i for i in range(30) if i not in {d for d, _ in want}]


def overlaps(doc, item, shift):
    """(equal, first j, tokens) of every run of 13 tokens or a whole shorter item, of which 80 % are equal, by the definition."""
    lo, hi, least = max(0, -shift), min(len(item), len(doc) - shift), min(13, len(item))
    same = [doc[j + shift] == item[j] for j in range(lo, hi)]
    return [(sum(same[a:b]), lo + a, b - a) for a in range(hi - lo) for b in range(a + least, hi - lo + 1) if sum(same[a:b]) * 5 >= (b - a) * 4]


def test_overlap_by_definition():
    rng = np.random.default_rng(12)
    for n in [*range(5, 31)] * 20:
        item = rng.integers(1, 1000, n).astype(np.uint64)
        doc = np.where(rng.random(n) < rng.choice([0.1, 0.2, 0.3]), np.uint64(0), item)
        doc, shift = np.concatenate([rng.integers(1, 1000, 5).astype(np.uint64), doc])[: n + 5 - int(rng.integers(3))], 5
        want, got = overlaps(doc.tolist(), item.tolist(), shift), decontamination.overlap(doc, item, shift)
        assert (got is None) == (not want)
        if got:
            assert (got[2], got[0], got[1]) in want and got[2] == max(w[0] for w in want)


@pytest.mark.parametrize("n", range(5, 26))
def test_all_placements_of_changed_tokens(n):
    """Longer runs have a half that is one of 13 to 25 tokens."""
    masks, own = decontamination.masks_for(np.array([n]))
    item = np.arange(1, n + 1).astype(np.uint64)
    at = np.array(list(itertools.combinations(range(n), n // 5)))
    changed = np.zeros((len(at), n), bool)
    np.put_along_axis(changed, at, True, 1)
    hit = np.zeros(len(at), bool)
    for mask in (masks[k] for k in own[n]):
        for place in range(n - int(mask[-1])):
            hit |= ~changed[:, place + mask].any(1)
    assert hit.all()
    for row in changed[:: max(1, len(at) // 1000)]:
        assert decontamination.overlap(np.where(row, np.uint64(0), item), item, 0) is not None


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_changed_passages(spark, limit):
    """Few changed tokens, wherever they are, hide neither a passage of a longer item nor a short item."""
    rng = np.random.default_rng(14)
    items = [" ".join(f"i{k}x{j}" for j in range(n)) for k, n in enumerate((5, 8, 9, 10, 12, 13, 14, 15, 20, 40))]
    texts, want = [], set()
    for k, item in enumerate(items):
        words = item.split()[:20]
        for _ in range(20):
            w = list(words)
            for j in rng.choice(len(w), len(w) // 5, replace=False):
                w[j] = "changed"
            want.add((len(texts), k))
            texts.append(prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20))
    w = items[9].split()
    want.add((len(texts), 9))  # two verbatim quotes of 13 words with 14 other words between
    texts.append(" ".join([*w[:13], *["new"] * 14, *w[27:]]))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = decontamination.contamination(docs_of(spark, texts), bench, broadcast_bytes=limit).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)


# substring dedup


def without_repeats(docs, k):
    first = {}
    for i, t in sorted((i, t) for i, t in docs if i is not None):
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("k", [4, 12, 50])
def test_repeats(spark, k):
    rng = np.random.default_rng(k)
    texts = [prose(rng, int(n)) for n in rng.integers(0, 150, 60)]
    for i in range(60):
        if rng.random() < 0.6:
            src = texts[int(rng.integers(60))].split()
            a, b = sorted(rng.integers(0, len(src) + 1, 2))
            texts[i] += " " + " ".join(src[a:b])
    texts[5] = texts[4]
    texts[6] = "la la " * 80
    texts[7] = "x " + "la la " * 70
    got = substring_dedup.dedup_substrings(docs_of(spark, texts), k=k, digest=True).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == without_repeats(list(enumerate(texts)), k)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(docs_of(spark, texts), k=k).collect()}
    assert all(hashlib.sha256(" ".join(t.split()).encode()).hexdigest() == without[2] for t, without in ((cut[i], v) for i, v in without_repeats(list(enumerate(texts)), k).items()))


def test_repeats_odd(odd, empty):
    got = substring_dedup.dedup_substrings(odd, digest=True).collect()
    assert len(got) == 8 and {r["n_removed"] for r in got} == {0} and {r["doc_id"]: r["n_words"] for r in got}[5] == 30_000
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert sorted(map(str, substring_dedup.dedup_substrings(odd).collect())) == sorted(map(str, odd.collect()))


# n-gram join


def brute_links(texts, similarity=0.8, n=5):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    return near


def classes(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    n = collections.Counter(itertools.chain.from_iterable(near))
    return {i: (find(i), n[i]) for i in ids}


@pytest.mark.parametrize(("leaf", "block"), [(48, 1024), (4, 8)])
def test_jaccard(spark, monkeypatch, leaf, block):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("VERIFY", block)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(9)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 200, 60)]
    base = prose(rng, 150).split()
    for _ in range(60):  # a large group of near copies, linked or not
        w = list(base)
        for j in rng.integers(0, 150, int(rng.integers(0, 6))):
            w[j] = "edit"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + ["a b c", "a b c", "", None]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_join(docs).collect()}
    assert got == classes(range(len(texts)), brute_links(list(enumerate(texts))))


def test_jaccard_odd(odd, empty):
    got = ngram_join.jaccard_join(odd).collect()
    assert len(got) == 8 and {r["n_links"] for r in got} == {0}
    assert ngram_join.jaccard_join(empty).count() == 0 and ngram_join.one_of_each(odd).count() == 8


def test_runs_reach_the_recall():
    assert 1 <= ngram_join.runs_for(0.9, 0.8) <= ngram_join.runs_for(0.9999, 0.8) <= 8


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(100)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, (c, _) in classes({x for e in edges for x in e}, [tuple(sorted(e)) for e in edges]).items()}


# vectors


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, 2):
        centres = rng.normal(size=(12, 24))
        for i in range(150):
            v = centres[i % 12] + rng.normal(size=24) * (0.03, 0.12, 0.2)[i % 3]
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)] + [(1100, [2 * x for x in rows[0][1]], 0), (1101, rows[0][1], None)]
    bad = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [None] + [1.0] * 23, 0), (2004, [float("nan")] + [1.0] * 23, 0), (2005, [float("inf")] + [1.0] * 23, 0), (None, rows[0][1], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    got = {r["vec_id"]: (r["component_id"], r["n_links"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + bad, schema)).collect()}
    near = []
    for label in (0, 1, 2):
        some = [(i, np.array(v, float)) for i, v, k in rows if k == label]
        near += [(a, b) for (a, u), (b, v) in itertools.combinations(some, 2) if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.98]
    want = classes([i for i, _, _ in rows], near)
    assert {i: got[i][:2] for i in want} == want
    assert all(got[i] == (i, 0, True) for i in range(2000, 2006)) and got[None] == (None, 0, True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_collision_threshold():
    assert 20 <= embedding_dedup.least_count(24, 0.9973, 0.9999) <= 24


# models


def test_language(spark, odd, empty):
    rng = np.random.default_rng(4)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schra", "tzen", "ung"], "cc": ["eau", "oux", "ille"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(25))
    rows = [(i, make(lang), lang, "s", 1) for i, lang in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs.where("doc_id < 120"))
    got = language_id.predict(docs.where("doc_id >= 120"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    und = language_id.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "é")], "doc_id long, text string"), model)
    assert [r["lang_pred"] == "und" for r in und.orderBy("doc_id").collect()] == [True, True, True, False]
    assert language_id.fit(empty) is None and language_id.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(odd, model).count() == 8


@pytest.mark.parametrize("k", [1, 2, 4, 9, 30])
def test_codewords_differ(k):
    code = language_id.codewords(k)
    assert len({r.tobytes() for r in code}) == k


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        w = prose(rng, int(rng.integers(5, 90))).split()
        if bad:
            for _ in range(2):
                w.insert(int(rng.integers(len(w))), str(rng.choice(["idiot", "Trash", "scum!"])))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(docs, marks)
    got = toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))), net).join(marks, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    out = toxicity.score(odd, net).collect()
    assert len(out) == 8 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.train(empty, marks) is None and toxicity.score(odd, None).where("predicted = 1").count() == 0


def test_toxicity_of_long_texts(spark):
    """Labelled texts of one label are all long, with one marked passage each: they are learned from, and long clean texts stay."""
    rng = np.random.default_rng(16)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(rng, int(rng.integers(2500, 3500) if bad or i % 4 == 1 else rng.integers(5, 90))).split()
        if bad:
            at = int(rng.integers(len(w)))
            w[at:at] = [str(x) for x in rng.choice(["idiot", "Trash", "scum!"], 3)]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, marks)).join(marks, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95


def test_gradient():
    rng = np.random.default_rng(0)
    words = [(" ".join(rng.choice(["a", "b", "idiot", "c"], 6)).encode(), int(i % 2)) for i in range(20)]
    net = toxicity.fit(words, epochs=1)
    share = rng.normal(size=(7, 6 * toxicity.HIDDEN)).astype(np.float64)
    par = {k: v.astype(np.float64) for k, v in net.par.items()}
    at, n, d = rng.integers(0, 7, (3, 5)), np.array([5, 3, 0]), rng.normal(size=3)
    _, kept = toxicity.forward(share, at, n, par, keep=True)
    g, d_gate = toxicity.backward(par, kept, d)
    for name in ("Uf", "Ub", "A", "v", "o", "c"):
        flat, i = par[name].reshape(-1), int(rng.integers(par[name].size))
        e, was = 1e-3, flat[i]
        flat[i] = was + e
        up = toxicity.forward(share, at, n, par) @ d
        flat[i] = was - e
        down = toxicity.forward(share, at, n, par) @ d
        flat[i] = was
        assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=2e-3), name
    d_share = np.zeros_like(share)
    np.add.at(d_share, at, d_gate)
    e = 1e-3
    share[2, 4] += e
    up = toxicity.forward(share, at, n, par) @ d
    share[2, 4] -= 2 * e
    assert d_share[2, 4] == pytest.approx((up - toxicity.forward(share, at, n, par) @ d) / (2 * e), rel=2e-2, abs=2e-3)


def test_windows_cover_all_words():
    ends = np.array([0, 0, 1, 33, 200])
    of, start, n = toxicity.windows(ends)
    assert sorted(set(of)) == [0, 1, 2, 3]
    assert {i for s, k in zip(start, n, strict=True) for i in range(s, s + k)} == set(range(200))


def test_passages_lie_in_a_window():
    """Any passage of half a window stands whole in one window."""
    _, start, n = toxicity.windows(np.array([0, 500]))
    half = toxicity.WINDOW // 2
    assert all(any(s <= i and i + half <= s + k for s, k in zip(start, n, strict=True)) for i in range(500 - half + 1))


def test_language_model(spark, odd, empty):
    rng = np.random.default_rng(8)
    make = lambda w: " ".join(w[int(x)] for x in rng.zipf(1.5, int(rng.integers(0, 120))) % 50)
    texts = [make([f"{p}{i}" for i in range(50)]) for p in "ab" * 60]
    docs = docs_of(spark, texts)
    learn = docs.where("doc_id < 100")
    model, counts = hmm_lm.train(learn, states=2, frequent=40)
    got = {r["doc_id"]: r for r in hmm_lm.score(docs, model, counts).collect()}
    seen = collections.Counter(w for t in texts[:100] for w in [*t.encode().lower().split(), None])
    n, v = sum(seen.values()), len(seen)
    own = {int(h): i for i, h in enumerate(model.hashes)}
    for i, t in enumerate(texts):
        tokens = [*t.encode().lower().split(), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(w in seen for w in tokens), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        a, total = model.start, 0.0
        for j, w in enumerate(tokens):
            h = hmm_lm.END if w is None else hmm_lm._hash(w)
            p = model.emit[own[h]] if h in own else model.emit[-1] * (seen[w] + 0.5) / model.other_norm
            a = (a if not j else a @ model.move) * p
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[i]["score"] == pytest.approx(total)
    held = range(100, 120)
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert len(hmm_lm.score(odd, model, counts).collect()) == 8
    nothing, none = hmm_lm.train(empty)
    assert all(r["n_known"] == 0 for r in hmm_lm.score(odd, nothing, none).collect())


def test_baum_welch_raises_the_likelihood(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["x", "y"] if i % 2 else ["p", "q"], 30)).encode() for i in range(40)]
    hashes = np.array([hmm_lm.END, *(hmm_lm._hash(w) for w in (b"x", b"y", b"p", b"q"))])
    m = hmm_lm.Model(hashes, np.array([40, 300, 300, 300, 300]), 1240, 5, np.array([0.5, 0.5]), np.array([[0.6, 0.4], [0.4, 0.6]]), rng.dirichlet(np.ones(6), 2).T)
    index = hmm_lm.Index({int(h): i for i, h in enumerate(hashes)}, 5)
    ids, ends, _ = hmm_lm._tokens(texts, index)
    was = -np.inf
    for _ in range(5):
        now = hmm_lm.log10_forward(ids, ends, m).sum()
        assert now > was - 5  # the priors move it a little
        was = now
        emissions = np.zeros_like(m.emit)
        m = hmm_lm.improved(m, *hmm_lm.expected(ids, ends, m, emissions), emissions)
    assert was > -1240 * 0.65


def test_clashing_columns(spark):
    """Extra columns pass through under whatever names; a column that an operator adds replaces one of that name."""
    names = ["doc", "spans", "a", "b", "n", "score", "predicted", "slot", "shard", "root", "cid", "path", "h", "v", "k", "lang_pred", "item_id", "__gone2"]
    rng = np.random.default_rng(11)
    rows = [(i, prose(rng, 70), *[f"{c}{i}" for c in names]) for i in range(12)] + [(12, prose(rng, 3), *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    bench = spark.createDataFrame([(1, "nothing of this kind stands in any of the texts here at all")], "item_id long, text string")
    kept = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, substring_dedup.dedup_substrings(docs).collect())) == kept
    assert sorted(map(tuple, ngram_join.one_of_each(docs).collect())) == kept
    assert sorted(map(tuple, decontamination.remove_contaminated(docs, bench).collect())) == kept
    assert sorted(toxicity.score(docs, None).columns) == sorted(docs.columns)
    assert toxicity.score(docs, None, "text", "s", "p").select(*docs.columns).count() == 13
    assert sorted(sharding.shard(docs, "doc_id", 2).columns) == sorted(docs.columns)
    assert "ambiguous" in language_id.predict(docs, None).columns
    model, counts = hmm_lm.train(docs, states=2, frequent=50)
    assert hmm_lm.score(docs, model, counts).count() == 13
    assert ngram_join.jaccard_join(docs).count() == 13 and packing.pack(docs).count() == 13


# shared helpers


def test_bloom_matches_spark(spark):
    keys = spark.range(0, 100_000, 7).select((F.col("id") * 1_000_003 - 5_000).alias("k"))
    bits = common.bloom(keys, "k")
    inside = np.array([r[0] for r in keys.collect()], np.int64)
    assert common.in_bloom(bits, inside).all() and common.in_bloom(bits, inside + 1).mean() < 0.02


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = common.written(stage(spark, docs, sf), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert assert_layout(P.STAGES[-1][1](spark, docs, sf).collect(), 4096) > 0


def test_pipeline_stage_near_copies(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, (c, _) in classes([i for i, _ in texts], brute_links(texts)).items() if c == i}
    assert {r["doc_id"] for r in P.drop_near_copies(spark, docs, sf).collect()} == want

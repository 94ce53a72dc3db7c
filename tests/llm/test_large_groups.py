"""Rows, lengths and sets that a large part of a table shares; ways to fail early."""

import collections

import numpy as np
import pytest

from tabularium.llm import common, ngram_join, packing, sharding


def test_a_row_that_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(1, "same", {"a": 1, "b": 2})] * 100 + [(1, "same", {"b": 2, "a": 1})] * 40 + [(i, f"t{i}", None) for i in range(90)] + [(None, None, {})] * 8
    df = spark.createDataFrame(rows, "id int, `a.b` string, m map<string,int>")
    got = sharding.shard(df, "id", 6)
    assert got.columns == ["id", "a.b", "m", "shard", "slot"]
    places = collections.defaultdict(list)
    for r in got.collect():
        places[r["shard"]].append(r["slot"])
    assert len(places) == 6 and all(sorted(v) == list(range(len(v))) for v in places.values()) and sum(map(len, places.values())) == len(rows)
    key = lambda d: sorted(str((r["id"], r["shard"], r["slot"])) for r in d.collect())
    assert key(got) == key(sharding.shard(df.repartition(5), "id", 6))
    assert collections.Counter(str((r[0], r[1], sorted((r[2] or {}).items()))) for r in got.collect()) == collections.Counter(str((r[0], r[1], sorted((r[2] or {}).items()))) for r in rows)


def test_a_length_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 40)
    rng = np.random.default_rng(1)
    lengths = np.concatenate([np.full(700, 37), np.full(300, 100), rng.integers(1, 101, 400)])
    rows = [(i % 600, i // 600, int(n), i) for i, n in enumerate(lengths)]
    got = packing.places(spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long").repartition(7), 100).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == len(rows)
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 100


def test_groups_of_long_texts_are_split_by_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GRAMS", 600)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 5000, 250)]
    texts = []
    for i in range(12):
        w = list(base)
        w[int(rng.integers(250))] = f"x{i}"
        texts.append((i, " ".join(w)))
    got = ngram_join.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 11)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_slices_of_a_column():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 5, 3, 30, 1, 1, 1, 9, 40, 2)] + [None, ""]
    got = list(common.in_slices(pa.array(texts, pa.string()), 10))
    assert [t for _, _, part in got for t in part] == [t.encode() if t is not None else None for t in texts]
    assert [lo for lo, _, _ in got][1:] == [hi for _, hi, _ in got][:-1] and all(hi - lo == 1 or sum(len(t or b"") for t in part) <= 10 for lo, hi, part in got)

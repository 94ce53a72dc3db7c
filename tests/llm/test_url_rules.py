"""URL rules against the definition, with many ranges, many paths of one host, and odd pages."""

import collections

import numpy as np
import pytest

from tabularium.llm import url_filter

RULES = "host string, path string, verdict string"


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:].split("?")[0].split("#")[0]


def expected(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if h is not None and p is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("size", [50_000, 12])
def test_nested_hosts_and_paths(spark, monkeypatch, size):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", size)
    monkeypatch.setattr(url_filter, "LEVEL", 4)
    rng = np.random.default_rng(3)
    labels, segments = ["a", "b", "ab", "com", "net", "a-b", "é"], ["", "x", "y", "xy", "x.y", "é"]
    host = lambda: ".".join(rng.choice(labels, int(rng.integers(1, 5))))
    path = lambda: "/" + "/".join(rng.choice(segments, int(rng.integers(0, 4))))
    rules = [(host(), path() if rng.random() < 0.9 else "", str(rng.choice(["allow", "block"]))) for _ in range(120)] + [("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("", "/x", "block")]
    urls = [f"http://{host().upper()}{path() if rng.random() < 0.9 else ''}{rng.choice(['', '?q', '#f'])}" for _ in range(500)] + [None, "", "nothing", "://", ":///x", "http://com", "http://com/"] + ["http://a.com/x"] * 60
    pages = spark.createDataFrame([(i if i % 50 else None, u, i) for i, u in enumerate(urls)], "page_id long, url string, `n.o` int")
    got = url_filter.judge(pages.repartition(3), spark.createDataFrame(rules, RULES))
    assert got.columns == ["page_id", "url", "n.o", "host", "path", "rule", "verdict"]
    rows = {r["n.o"]: tuple(r)[3:] for r in got.collect()}
    assert rows == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_deep_hosts_and_long_paths(spark):
    """Rules of every depth on one long host, and of every length on one long path: the longest wins."""
    deep = [f"l{i}" for i in range(301)]
    rules = [(".".join(deep[-k:]), "/", "block" if k % 2 else "allow") for k in range(2, 302)] + [("p.q", "/" + "z" * k, "block") for k in range(0, 300, 3)]
    urls = [f"http://{'.'.join(deep)}/x", "http://p.q/" + "z" * 100_000, "http://p.q/" + "z" * 31]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.judge(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {0: ".".join(deep) + "/", 1: "p.q/" + "z" * 297, 2: "p.q/" + "z" * 30}


def test_odd_pages(spark):
    rules = spark.createDataFrame([("a", "/", "block")], RULES)
    empty = spark.createDataFrame([], "page_id long, url string, host int")
    assert url_filter.judge(empty, rules).count() == 0 and url_filter.judge(empty, rules).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    one = spark.createDataFrame([(None, None), (None, None), (1, "x://a/")], "page_id long, url string")
    assert collections.Counter(map(tuple, url_filter.judge(one, rules).select("page_id", "rule").collect())) == {(None, None): 2, (1, "a/"): 1}
    assert {r["verdict"] for r in url_filter.judge(one, rules.limit(0)).collect()} == {"allow"}

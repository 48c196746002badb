"""Benchmark search against a scan of all places, and the decomposition against a full one."""

import random

import numpy as np
import pyarrow as pa

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.common import text_buffer
from tidemark.llm.decontaminate import BUCKETS, SHARE, _weighted, common_subsequence, drop_leaks, find_leaks, item_of, randomized_svd, words_of


def words(text):
    return words_of(*text_buffer(pa.array([text or ""])))[0].tolist()


def plain(docs, items):
    """Items of which SHARE of the words stand in order somewhere in a stretch of twice their length."""
    out = set()
    for d, text in docs.items():
        own = words(text)
        for i, t in items.items():
            item = words(t)
            known = np.isin(own, item)
            for low in range(0, len(own), max(len(item) // 2, 1)):
                if known[low : low + 2 * len(item)].sum() >= SHARE * len(item) and common_subsequence(item, own[low : low + 2 * len(item)]) >= SHARE * len(item):
                    out.add((d, i))
                    break
    return out


def test_query_finds_what_a_scan_finds(spark, sample):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()}
    want = plain(sample, items)
    got = {(r.doc_id, r.item_id) for r in CASES["op10_leaks"].run(spark, BASE).collect()}
    assert len(got & want) >= 0.9 * len(want) and want
    assert all(r.share >= 0.6 for r in CASES["op10_leaks"].run(spark, BASE).collect())


def planted(n=60):
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda k: [vocabulary[min(int(rng.paretovariate(0.6)), 2999)] for _ in range(k)]
    items = {i: " ".join(text(rng.randrange(18, 60))) + "." for i in range(12)}
    docs, leaks = {}, {}
    for d in range(n):
        own = text(rng.randrange(30, 400))
        if d % 4 == 0:
            i = d // 4 % 12
            part = items[i].split(" ")
            if d % 8 == 0:  # a paraphrase: every eighth word is another one
                part = [rng.choice(vocabulary) if k % 8 == 3 else w.upper() for k, w in enumerate(part)]
            at = rng.randrange(len(own))
            own[at:at] = part
            leaks[d] = i
        docs[d] = " ".join(own)
    return docs, items, leaks


def test_planted_passages_and_paraphrases(documents, spark):
    docs, items, leaks = planted()
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: r.item_id for r in find_leaks(documents(docs), benchmark).collect()}
    # nothing that isn't planted; every exact passage, and of all at least nine in ten
    assert got.items() <= leaks.items() and len(got) >= 0.9 * len(leaks)
    assert {d for d in leaks if d % 8} <= set(got)
    df = documents(docs)
    out = drop_leaks(df, benchmark)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == set(docs) - set(got)


def test_odd_rows(documents, spark):
    item = " ".join(f"i{k}" for k in range(30))
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "..."), (1, item)], "item_id long, text string")
    df = documents([(1, None), (2, ""), (3, "x " * 50_000 + item + " y" * 50_000), (4, item), (4, item), (None, item)])
    got = sorted((r.doc_id or 0, r.item_id, r.n_common, r.share) for r in find_leaks(df, benchmark).collect())
    assert set(got) == {(0, 1, 30, 1.0), (3, 1, 30, 1.0), (4, 1, 30, 1.0)} and len([g for g in got if g[0] == 4]) == 4
    assert find_leaks(documents({}), benchmark).collect() == []
    assert find_leaks(df, benchmark.filter("item_id > 5")).collect() == []
    assert drop_leaks(df, benchmark.filter("item_id > 5")).count() == 6


def test_a_smaller_share_counts_with_the_answer(documents, spark):
    rng = random.Random(3)
    head, answer = [f"h{k}" for k in range(24)], "the answer is forty two"
    item = " ".join(head) + ". " + answer + "."
    loose = [w if k % 3 else f"z{rng.randrange(99)}" for k, w in enumerate(head)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    others = {k: " ".join(f"v{rng.randrange(4000)}" for _ in range(200)) for k in range(10, 60)}
    df = documents({1: " ".join(loose) + ". " + answer, 2: " ".join(loose) + ". the answer is not known"} | others)
    assert [r.doc_id for r in find_leaks(df, benchmark).collect()] == [1]
    assert len(item_of(1, item).answer) == 5


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert common_subsequence(a, b) == best[-1][-1]


def test_randomized_decomposition_is_close_to_the_full_one(spark):
    rng = np.random.default_rng(0)
    topics = rng.dirichlet(np.full(300, 0.02), size=5)
    rows = [rng.choice(300, size=60, p=topics[i % 5]) * 7 % BUCKETS for i in range(200)]
    idf = np.ones(BUCKETS)
    full = np.zeros((200, 300 * 7))
    for i, r in enumerate(rows):
        b, w = _weighted(r, idf)
        full[i, b] = w
    df = spark.createDataFrame([(i, r.astype(np.int32).tobytes()) for i, r in enumerate(rows)], "id long, data binary").repartition(4)
    axes, values = randomized_svd(df, idf, rank=5)
    want = np.linalg.svd(full, compute_uv=False)[:5]
    assert np.allclose(values[:5], want, rtol=0.02)
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-8)


def test_running_counts_only_of_items_with_enough_words(monkeypatch):
    """An item whose rare words are not in a stretch costs no running count there; the same matches are found."""
    from tidemark.llm import decontaminate as d

    rng = np.random.default_rng(5)
    words = [[int(w) for w in rng.integers(1, 1 << 60, 30)] for _ in range(40)]
    items = [d.Item(n, w, []) for n, w in enumerate(words)]
    finder = d.Finder(items, rng.random((BUCKETS, 8), dtype=np.float32), np.ones(BUCKETS), 0.3)
    h = rng.integers(1, 1 << 60, 1500).astype(np.uint64)
    h[700:730] = np.array(words[7], dtype=np.uint64)
    counted, cumsum = [], np.cumsum
    monkeypatch.setattr(d.np, "cumsum", lambda a, *args, **kw: (counted.append(a.shape[0]) if a.ndim == 2 and a.dtype.kind == "i" else None, cumsum(a, *args, **kw))[1])
    found = sorted(finder.matches(h, np.array([0, len(h)])))
    assert found == [(0, 7, 30, 1.0)] and sum(counted) == 1

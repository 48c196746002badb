"""Recall of planted paraphrases that the accept rules take, and where windows begin."""

import random

import numpy as np

from tidemark.llm.decontaminate import BUCKETS, Finder, Item, fit_finder, words_of
from tidemark.llm.common import text_buffer

BASE = "/root/testdata/sf0.01"


def test_recall_of_paraphrases(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    finder = fit_finder(docs, spark.read.parquet(f"{BASE}/benchmark.parquet"))
    column = docs.select("text").toArrow().column(0).combine_chunks()
    h, first = words_of(*text_buffer(column))
    hosts = [h[a:b] for a, b in zip(first[:-1], first[1:]) if 100 <= b - a <= 1500]
    rng = random.Random(0)
    for share, answer, least in ((0.6, True, 0.9), (0.7, True, 0.95), (0.8, False, 0.95), (1.0, False, 0.97)):
        found = 0
        held = [n for n, i in enumerate(finder.items) if i.answer or not answer]
        for _ in range(200):
            n = rng.choice(held)
            words = list(finder.items[n].words)
            free = len(words) - (len(finder.items[n].answer) if answer else 0)  # the answer stands at the end
            for at in rng.sample(range(free), min(free, len(words) - int(np.ceil(share * len(words) - 1e-9)))):
                words[at] = int(h[rng.randrange(len(h))])
            host = rng.choice(hosts)
            at = rng.randrange(len(host) + 1)
            text = np.concatenate([host[:at], np.array(words, dtype=np.uint64), host[at:]])
            found += any(i == n for _, i, _, _ in finder.matches(text, np.array([0, len(text)])))
        assert found >= least * 200, (share, answer, found)


def test_windows_begin_at_each_row_and_words_may_stand_apart():
    rng = np.random.default_rng(0)
    table = rng.standard_normal((BUCKETS, 8)).astype(np.float32)
    item = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    finder = Finder([Item(1, item.tolist(), [])], table, np.ones(BUCKETS), -2.0)
    first = np.array([0, 3, 3, 50, 57, 2500, 2501])
    starts = np.concatenate([at for _, at, _ in finder.candidates(rng.integers(1, 1 << 62, 2501).astype(np.uint64), first)])
    assert {0, 3, 50, 57, 2500} <= set(starts.tolist())
    apart = rng.integers(1, 1 << 62, 79).astype(np.uint64)  # another word after each of the item
    apart[::2] = item
    assert [(r, n, k) for r, n, k, _ in finder.matches(apart, np.array([0, 79]))] == [(0, 0, 40)]


def many_items(n, rng):
    vocabulary = rng.integers(1, 1 << 62, 110_000).astype(np.uint64)
    return [Item(i, vocabulary[(rng.pareto(0.7, rng.integers(8, 60)) * 20 % 110_000).astype(int)].tolist(), []) for i in range(n)]


def test_bound_counts_the_rarest_words_around_each_window():
    rng = np.random.default_rng(1)
    table = rng.standard_normal((BUCKETS, 8)).astype(np.float32)
    idf = rng.random(BUCKETS)
    items = many_items(400, rng)
    finder = Finder(items, table, idf, 0.1)
    parts = [np.array(items[k].words, dtype=np.uint64) for k in rng.integers(0, 400, 120)]
    h = np.concatenate(parts)
    first = np.concatenate([[0], np.sort(rng.integers(0, len(h), 20)), [len(h)]])
    rare = {}
    for n, item in enumerate(items):
        words = np.array(item.words, dtype=np.uint64)
        rarest = words[np.argsort(-idf[(words & np.uint64(BUCKETS - 1)).astype(int)], kind="stable")[: -(-len(words) * 3 // 5)]]
        rare[n] = set(rarest.tolist()), max(1, int(np.ceil(np.isin(words, rarest).sum() - 0.4 * len(words) - 1e-9)))

    def enough(size, at, n):
        row = int(np.searchsorted(first, at, side="right")) - 1
        words, need = rare[n]
        return sum(w in words for w in h[max(at - size, first[row]) : min(at + 2 * size, first[row + 1])].tolist()) >= need

    close = {(s, int(a), int(n)) for s, at, own in finder.candidates(h, first) for a, n in zip(at, own)}
    kept = {(s, int(a), int(n)) for s, at, own in finder.candidates(h, first, bounded=True) for a, n in zip(at, own)}
    some = sorted(close)[:: max(len(close) // 3000, 1)] + sorted(kept)
    assert kept <= close and 0 < len(kept) < len(close)
    assert all(enough(*c) == (c in kept) for c in some)


def test_index_of_a_large_benchmark():
    rng = np.random.default_rng(2)
    table = rng.standard_normal((BUCKETS, 8)).astype(np.float32)
    items = many_items(20_000, rng)
    finder = Finder(items, table, rng.random(BUCKETS), 0.3)
    # the index holds a line for each rare word of each item, and no table of words by items
    assert len(finder.holders) <= sum(len(i.words) for i in items) and len(finder.begins) == len(finder.known) + 2
    assert sorted(finder.order.tolist()) == list(range(20_000)) and max(b - a for a, b, _ in finder.blocks) <= 256
    text = np.concatenate([np.array(items[k].words, dtype=np.uint64) for k in (0, 7_000, 19_999)])
    assert {0, 7_000, 19_999} <= {n for _, n, _, _ in finder.matches(text, np.array([0, len(text)]))}

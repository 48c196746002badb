"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.graph import Forest, components
from tidemark.llm.simhash import fingerprint_links, keep_representatives, near_groups, near_pairs, near_rows


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, radius=2):
    root = {i: i for i in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_query_equals_all_pairs(spark, sample):
    prints = {i: plain_print(t) for i, t in sample.items()}
    groups = plain_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in CASES["op7_simhash"].run(spark, BASE).collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def test_odd_texts(documents):
    rows = {9: None, 8: "", 7: " \n", 3: "one", 4: "ONE", 5: "one two", 6: "long wörd É " * 5000, 2: "One\ttwo"}
    prints = {i: plain_print(t) for i, t in rows.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_groups(documents(rows)).collect()}
    groups = plain_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in rows}
    assert near_groups(documents({})).collect() == []


def test_one_document_of_each_group_stays(documents):
    df = documents([(3, "a b c d"), (1, "A B C D"), (2, "x y z"), (2, "x y z"), (None, "a b c d"), (None, "q r s t u")])
    out = keep_representatives(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "a b c d"), (0, "q r s t u"), (1, "A B C D"), (2, "x y z")]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = np.array([rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for _ in range(150)], dtype=np.uint64)
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in values] for a in values])
    got = np.zeros_like(want)
    for low, hits in near_rows(values, values, radius, queries=64):
        got[low : low + len(hits)] = hits
    assert (got == want).all()
    i, j = (x.ravel() for x in np.meshgrid(np.arange(150), np.arange(150), indexing="ij"))
    assert (near_pairs(values[i], values[j], radius) == want.ravel()).all()


@pytest.mark.parametrize("block", [4, 2048])
def test_links_join_the_same_groups(spark, block):
    rng = random.Random(5)
    start = rng.getrandbits(63)
    values, v = [], start
    for _ in range(80):  # a chain, each link within the radius
        values.append(v)
        v ^= 1 << rng.randrange(60) | 1 << rng.randrange(60)
    values += [start ^ (1 << 62) ^ (1 << 61) ^ (1 << 60) ^ (1 << k) for k in range(30)]
    values = sorted(set(values))
    links = fingerprint_links(spark.createDataFrame([(x,) for x in values], "fp long"), 2, block)
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    want = {i: c for i, c in plain_groups({x: x for x in values}).items()}
    assert {x: got.get(x, x) for x in values} == want


def test_components_of_odd_links(spark):
    links = [(1, 2), (2, 1), (3, 3), (5, 4), (None, 7), (8, None)] + [(i, i + 1) for i in range(100, 260)] + [(1000, i) for i in range(1001, 1100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 261)} | {i: 1000 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_forest_keeps_fewer_links_than_nodes():
    forest = Forest(6)
    for i, others in ((0, [1, 2, 3]), (1, [0, 2]), (4, [5]), (3, [4])):
        forest.add(i, np.array(others))
    assert len(forest.links) == 5 and len(set(forest.label.tolist())) == 1


def test_repeated_keys_keep_the_same_row_in_every_run(documents):
    docs = documents([(1, f"text number {k} of the first key") for k in range(40)] + [(2, "another")])
    kept = [sorted(r.text for r in keep_representatives(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2

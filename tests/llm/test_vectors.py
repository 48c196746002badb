"""Near-duplicate vectors against the full matrix of cosines."""

import numpy as np
import pytest

from tests.check import compare, duck
from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.vectors import Split, compare_tiles, near_vectors


def plain(rows, threshold=0.95):
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in {len(v) for _, v in sound}:
        own = [(i, v / np.abs(v).max()) for i, v in sound if len(v) == d]
        x = np.array([v / np.linalg.norm(v) for _, v in own])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            i, j = own[a][0], own[b][0]
            links[i] += 1
            links[j] += 1
            p, q = top(i), top(j)
            root[max(p, q)] = min(p, q)
    return {i: (links[i], top(i), top(i) == i) for i in root}


def rows_with_everything():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=6) * 0.15 * (i % 3)]) for i in range(200)]
    rows += [(1000 + i, [1.0, 2.0]) for i in range(9)]
    odd = [None, [], [0.0] * 6, [float("nan")] + [1.0] * 5, [None] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1e-30] * 6, [1e30] * 6]
    return rows + [(2000 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize("tile", [8, 4096])
def test_equals_full_matrix(spark, tile):
    rows = rows_with_everything()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rep string, w string")
    assert {r[0]: tuple(r[1:]) for r in near_vectors(df, tile=tile).collect()} == plain(rows)


def test_query_equals_full_matrix(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{BASE}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {r[0]: tuple(r[1:]) for r in CASES["op2_vectors"].run(spark, BASE).collect()} == plain(rows)


def test_query_equals_sql(spark):
    assert compare(duck(BASE), CASES["op2_vectors"].run(spark, BASE), CASES["op2_vectors"].sql) is None


def test_empty_and_unsound_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []
    got = near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_no_close_pair_is_pruned():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64)) + 4 * rng.normal(size=(6, 64))[rng.integers(0, 6, 300)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    hits = np.zeros((300, 300), bool)
    for low, part in compare_tiles(x, x, axes, 0.9):
        hits[low : low + len(part)] = part
    assert (hits == (x @ x.T >= 0.9)).all()
    split = Split((x @ axes)[:, :16], 9)
    leaf = split.leaf((x @ axes)[:, :16])
    for i, j in zip(*np.nonzero(hits)):
        a, b = sorted((leaf[i], leaf[j]))
        assert b in split.near(a, np.sqrt(2 - 2 * 0.9) + 1e-6)

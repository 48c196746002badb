"""Whitening against numpy on all vectors at once."""

import math

import numpy as np
import pytest

from tests.llm.conftest import BASE
from tidemark.llm.catalog import CASES
from tidemark.llm.whitening import whiten


def plain(vectors, top=16, count=False):
    """(key, component) -> (n, deviation, whitened, explained) of vectors of one length."""
    sound = [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in sound]
    fit = xs if count else sorted(set(xs))
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    at = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], dtype=float) / n
    values, axes = np.linalg.eigh(at.T @ at / n)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    out = {}
    for (k, _), x in zip(sound, xs):
        off = [n * a - s for a, s in zip(x, sums)]
        z = np.array(off) / n @ axes
        for c in range(len(values)):
            out[k, c + 1] = (n, sum(v * v for v in off), abs(z[c]) / math.sqrt(values[c]), values[c] / np.trace(at.T @ at / n))
    return out


def compare(rows, want, close=1e-7):
    assert sorted((r[0], r.component) for r in rows) == sorted(want)
    for r in rows:
        n, deviation, whitened, explained = want[r[0], r.component]
        assert r.n == n and int(r.deviation) == deviation
        assert abs(r.whitened) == pytest.approx(whitened, rel=close, abs=close)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_equals_numpy(spark):
    vectors = [(r[0], r[1]) for r in spark.read.parquet(f"{BASE}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = CASES["op12_whitening"].run(spark, BASE)
    assert dict(out.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    compare(out.collect(), plain(vectors))


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "a", "b", 1) for r in rows], f"vec_id long, embedding array<{kind}>, x string, weight string, n int")


@pytest.mark.parametrize("count", [False, True])
def test_repeated_and_unsound_vectors(spark, count):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 5)) * [3, 2, 1, 0.5, 0.2] + [0, 9, -4, 100, 0]
    rows = [(k, base[k % 40].tolist()) for k in range(100)] + [(200 + k, base[0].tolist()) for k in range(60)]
    odd = [(500, None), (501, [1.0, 2.0, None, 4.0, 5.0]), (502, [1.0, math.nan, 3.0, 4.0, 5.0]), (503, [math.inf] * 5), (504, [1e300] * 5), (505, [])]
    out = whiten(frame(spark, rows + odd), weights="count" if count else "one", top=3).collect()
    compare(out, plain(rows, 3, count))
    z = {(r.vec_id, r.component): r.whitened for r in out}
    # one sign for all rows
    fit = {tuple(v): k for k, v in rows}.values()
    pairs = [(a, b) for a in fit for b in fit]
    at = {k: np.array([math.floor(64 * c) for c in dict(rows)[k]], dtype=float) for k in fit}
    if not count:
        mean = np.mean(list(at.values()), axis=0)
        values, axes = np.linalg.eigh(np.cov(np.array(list(at.values())).T, bias=True))
        for c in (1, 2, 3):
            sign = {np.sign(((at[k] - mean) @ axes[:, -c]) * z[k, c]) for k in fit if abs(z[k, c]) > 1e-6}
            assert len(sign) == 1
    assert len(pairs) == 1600


def test_floats_become_doubles_first(spark):
    rows = [(k, [float(np.float32(0.1 * k)), float(np.float32(-0.3 * k * k)), 1.0 / (k + 1)]) for k in range(9)]
    as_floats = [(k, [float(np.float32(c)) for c in v]) for k, v in rows]
    compare(whiten(frame(spark, rows, "float"), top=2).collect(), plain(as_floats, 2))


def test_few_different_vectors_have_few_components(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    two = sorted(whiten(frame(spark, [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])])).collect(), key=lambda r: (r.vec_id, r.component))
    assert [r.n for r in two] == [2] * 6 and [r.whitened is None for r in two] == [False, True, False, False, True, True]
    assert sorted(abs(r.whitened) for r in two if r.component == 1) == pytest.approx([1.0] * 3)
    assert [r.explained for r in two if r.component == 1] == pytest.approx([1.0] * 3)


def test_other_lengths_have_their_own_fit(spark):
    rng = np.random.default_rng(4)
    two, three = [(k, rng.normal(size=2).tolist()) for k in range(20)], [(50 + k, rng.normal(size=3).tolist()) for k in range(30)]
    compare(whiten(frame(spark, two + three)).collect(), plain(two) | plain(three))


def test_large_entries_stay_exact(spark):
    rows = [(k, [k * 1e9 + 0.5, -k * k * 1e8, 7e12]) for k in range(12)]
    out = whiten(frame(spark, rows), top=1).collect()
    want = plain(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in out} == {k: want[k, 1][1] for k, _ in rows}
    with pytest.raises(ValueError):
        whiten(frame(spark, rows), weights="none")

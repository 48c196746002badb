"""Density selection against the plain rule: every cell of every grid, best first."""

import math
import random

import pytest

from tidemark.operators import events as ev


def plain(rows, h, kernel, power, gap, top):
    shape = {
        "gauss": lambda u: math.exp(-0.5 * u * u),
        "tri": lambda u: max(1 - u, 0.0),
        "cos": lambda u: 0.5 * (1 + math.cos(math.pi * u)) if u < 1 else 0.0,
    }[kernel]
    times = [t for t, _ in rows]
    lo, hi = min(times) - 5 * h, max(times) + 5 * h
    weights = [max(s, 0.0) ** power for _, s in rows]
    if sum(weights) <= 0:
        weights = [1.0] * len(rows)
    cells = [(-round(sum(w * shape(abs(lo + c * 0.5 - t) / h) for (t, _), w in zip(rows, weights)), 9), lo + c * 0.5) for c in range(math.ceil((hi - lo) / 0.5))]
    kept = []
    for neg, t in sorted(cells):
        if len(kept) < top and all(abs(t - k) > gap for k, _ in kept):
            kept.append((t, -neg + 0.0))
    return kept


@pytest.mark.parametrize("kernel,h,power,gap,top,dealt", [("tri", 5.0, 1.0, 30.0, 3, False), ("gauss", 4.0, 2.0, 30.0, 3, True), ("cos", 10.0, 3.0, 200.0, 6, False), ("tri", 8.0, 2.0, 30.0, 8, True)])
def test_picks(spark, monkeypatch, kernel, h, power, gap, top, dealt):
    if dealt:
        monkeypatch.setattr(ev, "_PACK_POINTS", 3)
    monkeypatch.setattr(ev, "_STRETCH_CELLS", 64)
    rng = random.Random(7)
    tracks = {k: [(rng.randrange(0, 4 * span) / 4, rng.choice([-1.0, 0.2, 0.5, 0.9])) for _ in range(n)] for k, (n, span) in enumerate([(1, 1), (3, 40), (60, 900), (25, 3000)])}
    tracks[9] = [(5.0, -1.0), (300.0, 0.0)]
    rows = spark.createDataFrame([(k, t, s) for k, v in tracks.items() for t, s in v], "k int, t double, score double")
    out = ev.kde_select(rows, ["k"], h, kernel, power, gap, top).collect()
    for k, v in tracks.items():
        got = [(round(r["t"], 6), round(r["density"], 6)) for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["rank"])]
        assert got == [(round(t, 6), round(d, 6)) for t, d in plain(v, h, kernel, power, gap, top)]


def test_cells_of_no_density_are_not_moved(spark):
    """Two points a year apart: the grid between them has 63 million cells, none of which is a row."""
    rows = spark.createDataFrame([(1, 0.0, 0.5), (1, 31_536_000.0, 0.4)], "k int, t double, score double")
    out = ev.kde_select(rows, ["k"], 10.0, "tri").orderBy("rank").collect()
    assert [(r["t"], r["density"]) for r in out] == [(0.0, 0.5), (31_536_000.0, 0.4), (-50.0, 0.0)]

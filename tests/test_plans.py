"""Scans, nearest joins and folds against plain Python on skewed data, with and without blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.signal import first_at_most
from tidemark.plans import blocks as bl
from tidemark.plans import folds as fo
from tidemark.plans.nearest import count_within, nearest, window_best


def points(seed, n=120, hot=0.4):
    """(key, t, score, id): one key holds a large share, some times repeat."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < hot else rnd.randint(1, 4)
        rows.append((key, rnd.randint(0, 400) / 4.0, rnd.randint(0, 30) / 10.0, i))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t double, score double, id long")


@pytest.fixture(params=[None, "16"])
def limited(spark, request):
    if request.param:
        spark.conf.set("spark.tidemark.blockRows", request.param)
    yield spark
    spark.conf.unset("spark.tidemark.blockRows")


def test_running_sum_and_previous_row(limited):
    rows = points(1)
    df = bl.fit(frame(limited, rows), ["k"], ["t", "id"])
    out = bl.scan(df, ["k"], ["t", "id"], {"s": ("sum", F.col("score"))})
    out = bl.shift(out, ["k"], ["t", "id"], {"p": F.col("id")}).collect()
    want = {}
    for k in range(5):
        total, prev = 0.0, None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[3])):
            total += r[2]
            want[r[3]] = (round(total, 6), prev)
            prev = r[3]
    assert {r["id"]: (round(r["s"], 6), r["p"]) for r in out} == want


def test_quantiles(limited):
    import numpy as np

    rows = points(2)
    out = bl.quantiles(frame(limited, rows), ["k"], "t", {"m": 0.5, "q": 0.95}).collect()
    for r in out:
        values = [x[1] for x in rows if x[0] == r["k"]]
        assert r["m"] == pytest.approx(np.percentile(values, 50))
        assert r["q"] == pytest.approx(np.percentile(values, 95))


def test_nearest_prefers_earlier_time_then_smaller_tie(limited):
    left, right = points(3), points(4, 80)
    out = nearest(frame(limited, left), frame(limited, right), ["k"], "t", "t", {"hit": "id"}, "id").collect()
    assert len(out) == len(left)
    for r in out:
        mine = [x for x in right if x[0] == r["k"]]
        best = min(mine, key=lambda x: (abs(x[1] - r["t"]), x[1], x[3]), default=None)
        assert r["hit"] == (best[3] if best else None)


def test_window_best_and_count(limited):
    left, right = points(5), points(6, 90)
    l, r = frame(limited, left), frame(limited, right)
    out = window_best(l, r, ["k"], "t", "t", 6.0, F.col("score"), F.col("id"), {"hit": F.col("id")})
    out = count_within(out, r, ["k"], "t", "t", 6.0, "n").collect()
    assert len(out) == len(left)
    for row in out:
        near = [x for x in right if x[0] == row["k"] and abs(x[1] - row["t"]) <= 6]
        best = min(near, key=lambda x: (-x[2], x[3]), default=None)
        assert (row["hit"], row["n"]) == (best[3] if best else None, len(near))


def test_suppress(limited):
    rows = list({(r[0], r[1]): r for r in points(7, 200)}.values())
    kept = {(r["k"], r["t"]) for r in fo.suppress(frame(limited, rows), ["k"], "t", "score", 3.0).collect()}
    want = set()
    for k in range(5):
        mine = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            if all(abs(r[1] - t) > 3.0 for t in mine):
                mine.append(r[1])
        want |= {(k, t) for t in mine}
    assert kept == want


def test_select_spaced(limited):
    rows = points(8, 200)
    out = fo.select_spaced(frame(limited, rows), ["k"], "t", "score", 5.0, 3).collect()
    for k in range(5):
        mine = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1])):
            if len(mine) < 3 and all(abs(r[1] - t) > 5.0 for t in mine):
                mine.append(r[1])
        assert [r["t"] for r in sorted(out, key=lambda r: r["rank"]) if r["k"] == k] == mine


def greedy(rows, size, linked, max_rows, max_total):
    """Group start of each (key, id) by the sequential rule."""
    want = {}
    for k in {r[0] for r in rows}:
        start = count = total = 0
        for p, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[3])):
            n = size(r[3])
            if p == 0 or not linked(r[3]) or (max_rows and count >= max_rows) or total + n > max_total:
                start, count, total = p, 0, 0
            count, total = count + 1, total + n
            want[r[3]] = start
    return want


@pytest.mark.parametrize("max_rows,max_total", [(4, 12), (None, 15), (3, 0)])
@pytest.mark.parametrize("sizes", ["positive", "with blanks", "mostly blank", "oversized"])
def test_greedy_groups(limited, max_rows, max_total, sizes):
    rows = points(9, 300, 0.7)
    rule = {
        "positive": ("id % 5 + 1", lambda i: i % 5 + 1),
        "with blanks": ("id % 3 * (id % 5)", lambda i: i % 3 * (i % 5)),
        "mostly blank": ("if(id % 40 = 0, 5, 0)", lambda i: 5 if i % 40 == 0 else 0),
        "oversized": ("if(id % 4 = 0, 99, if(id % 4 = 1, 3, 0))", lambda i: (99, 3, 0, 0)[i % 4]),
    }[sizes]
    df = bl.fit(frame(limited, rows), ["k"], ["id"])
    out = bl.unblock(fo.greedy_groups(df, ["k"], ["id"], F.expr(rule[0]).cast("int"), F.col("id") % 11 != 0, max_rows, max_total)).collect()
    assert {r["id"]: r["group_no"] for r in out} == greedy(rows, rule[1], lambda i: i % 11 != 0, max_rows, max_total)


def test_greedy_groups_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = points(10, 200, 0.8)
        out = fo.greedy_groups(frame(spark, rows), ["k"], ["id"], F.col("id") % 4, F.col("id") % 13 != 0, None, 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: r["group_no"] for r in out} == greedy(rows, lambda i: i % 4, lambda i: i % 13 != 0, None, 20)


def test_frames_wider_than_a_block(limited):
    rows = [(1, float(i), float(i % 7), i) for i in range(100)]
    df = bl.fit(frame(limited, rows), ["k"], ["id"], position="id")
    out = bl.frame_windows(df, ["k"], "id", 40, 25, {"s": lambda w: F.sum("score").over(w.rowsBetween(-40, 25))}).collect()
    assert {r["id"]: r["s"] for r in out} == {i: sum(j % 7 for j in range(max(0, i - 40), min(100, i + 26))) for i in range(100)}


def test_ties_of_very_large_ids(limited):
    top = 2**53
    left = limited.createDataFrame([(1, 5.0)], "k int, t double")
    right = limited.createDataFrame([(1, 5.0, 1.0, top + 1), (1, 5.0, 1.0, top), (1, 9.0, 1.0, 3)], "k int, t double, score double, id long")
    assert nearest(left, right, ["k"], "t", "t", {"hit": "id"}, "id").first()["hit"] == top
    assert window_best(left, right, ["k"], "t", "t", 6.0, F.col("score"), F.col("id"), {"hit": F.col("id")}).first()["hit"] == 3
    assert window_best(left, right, ["k"], "t", "t", 1.0, F.col("score"), F.col("id"), {"hit": F.col("id")}).first()["hit"] == top


def test_far_threshold_search_opens_other_packs(spark, monkeypatch):
    import tidemark.operators.signal as sg

    monkeypatch.setattr(sg, "PACK", 8)
    rnd = random.Random(5)
    levels = [1.0 if rnd.random() < 0.01 else 5.0 + rnd.random() for _ in range(700)]
    series = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "k int, idx long, v double")
    asked = spark.createDataFrame([(1, i, 2.0) for i in range(0, 700, 37)], "k int, idx long, thr double")
    for backward in (True, False):
        out = first_at_most(asked, series, ["k"], "thr", "v", backward, "at", 699).collect()
        assert len(out) == 19
        for r in out:
            low = [i for i, v in enumerate(levels) if v <= 2.0 and (i <= r["idx"] if backward else i >= r["idx"])]
            assert r["at"] == ((max(low) if backward else min(low)) if low else None)

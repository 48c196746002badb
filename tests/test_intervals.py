"""Cuts at quiet frames against a plain walk, with spans over many blocks, and the number of jobs they take."""

import math
import random

import pytest

from tidemark.operators.intervals import split_at_quiet


def plain_cuts(x, lo, hi, rate, target, floor_db, frame, slack):
    out, start = [], lo
    while start < hi:
        goal = min(hi, start + target)
        stop = goal
        if goal < hi:
            first, last = max(start + rate, goal - slack), min(hi, goal + slack)
            best = None
            for f in range(first // frame, max(first // frame + 1, last // frame)):
                part = x[f * frame : (f + 1) * frame]
                if len(part) == frame and None not in part:
                    level = 20 * math.log10(max(math.sqrt(sum(v * v for v in part) / frame), 1e-7))
                    if best is None or level < best[0]:
                        best = (level, f)
            if best:
                stop = max(start + rate, min(hi, best[1] * frame))
        end = min(stop, hi)
        loud = [abs(v) for v in x[start:end] if v is not None]
        if loud and 20 * math.log10(max(1e-7, max(loud))) >= floor_db:
            out.append((start, end))
        start = max(end, start + frame)
    return out


@pytest.fixture(params=[None, "16"])
def limited(spark, request):
    if request.param:
        spark.conf.set("spark.tidemark.blockRows", request.param)
    yield spark
    spark.conf.unset("spark.tidemark.blockRows")


SETTINGS = [
    dict(rate=8, target=40, floor_db=-20.0, frame=4, slack=16),
    dict(rate=7, target=30, floor_db=-20.0, frame=4, slack=28),  # the window is cut off by the least length
    dict(rate=5, target=11, floor_db=-90.0, frame=6, slack=2),
]


@pytest.mark.parametrize("setting", SETTINGS)
def test_cuts_equal_the_walk(limited, setting):
    rng = random.Random(setting["rate"])
    tracks, spans = {}, []
    for k, n in enumerate([1500, 90, 7, 333]):
        tracks[k] = [None if rng.random() < 0.03 else round(rng.uniform(-1, 1) * rng.choice([1, 0.05]), 4) for _ in range(n)]
        spans += [(k, 0, n)] if k != 3 else [(3, 5, 60), (3, 61, 70), (3, 101, 333)]
    rows = [(k, i, v) for k, x in tracks.items() for i, v in enumerate(x) if v is not None]
    samples = limited.createDataFrame(rows, "k int, idx long, x double")
    found = split_at_quiet(limited.createDataFrame(spans, "k int, lo long, hi long"), samples, ["k"], **setting)
    want = sorted((k, *piece) for k, lo, hi in spans for piece in plain_cuts(tracks[k], lo, hi, **setting))
    assert sorted(map(tuple, found.collect())) == want and len(want) > 20


def test_no_spans(spark):
    samples = spark.createDataFrame([(1, 0, 0.5)], "k int, idx long, x double")
    assert split_at_quiet(spark.createDataFrame([], "k int, lo long, hi long"), samples, ["k"], **SETTINGS[0]).collect() == []


def test_jobs_do_not_grow_with_a_span(spark):
    spark.conf.set("spark.tidemark.blockRows", "32")
    counts = []
    try:
        for n in (600, 6000):
            samples = spark.range(n).selectExpr("1 AS k", "id AS idx", "sin(id * id) AS x")
            spans = spark.createDataFrame([(1, 0, n)], "k int, lo long, hi long")
            spark.sparkContext.setJobGroup(f"cuts-{n}", "")
            pieces = split_at_quiet(spans, samples, ["k"], **SETTINGS[0]).count()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"cuts-{n}")))
            assert pieces > n / 60
    finally:
        spark.conf.unset("spark.tidemark.blockRows")
    assert counts[1] <= counts[0] + 2, counts

"""Best-first rules on a key that no task may hold: one sorted pass, equal to the expression and to plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.events import merge_nearest_rep, merge_scan_down
from tidemark.plans.folds import select_spaced


def points(seed, n):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.6 else rng.randint(1, 5), rng.randint(0, 2000) / 4.0, rng.randint(0, 40) / 10.0, i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t double, score double, id long")


RULES = {
    "down": lambda df: merge_scan_down(df, ["k"], "id", 3, 30.0),
    "mean": lambda df: merge_nearest_rep(df, ["k"], "id", 3, 30.0),
    "best": lambda df: merge_nearest_rep(df, ["k"], "id", 3, 30.0, "best"),
    "weighted": lambda df: merge_nearest_rep(df, ["k"], "id", 4, 12.0, "weighted"),
    "spaced": lambda df: select_spaced(df, ["k"], "t", "score", 15.0, 4, ["id"]),
    "column": lambda df: select_spaced(df.withColumn("gap", F.col("k") * 5.0), ["k", "gap"], "t", "score", F.col("gap"), 4, ["id"]),
}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_streamed_equals_expression(spark, rule):
    for seed in range(3):
        df = frame(spark, points(seed, 300))
        plain = sorted(map(tuple, RULES[rule](df).collect()))
        spark.conf.set("spark.tidemark.blockRows", "16")
        try:
            assert sorted(map(tuple, RULES[rule](df).collect())) == plain
        finally:
            spark.conf.unset("spark.tidemark.blockRows")


def test_jobs_do_not_grow_with_a_key(spark):
    counts = []
    spark.conf.set("spark.tidemark.blockRows", "50")
    try:
        for n in (400, 4000):
            df = frame(spark, points(9, n)).repartition(3)
            spark.sparkContext.setJobGroup(f"fold-{n}", "")
            merge_scan_down(df, ["k"], "id").collect()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fold-{n}")))
    finally:
        spark.conf.unset("spark.tidemark.blockRows")
    assert counts[0] == counts[1], counts


def test_rows_without_a_time_and_empty_input(spark):
    df = frame(spark, [(1, None, 1.0, 1), (1, 5.0, None, 2), (1, 6.0, 2.0, 3)])
    assert [(r.k, r.id, r.merged) for r in merge_scan_down(df, ["k"], "id").collect()] == [(1, 3, 1)]
    assert merge_scan_down(df.limit(0), ["k"], "id").collect() == []

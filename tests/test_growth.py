"""Steps whose work must grow no faster than the input: what is read often is written once, and repeated rows are folded first."""

from pyspark.sql import functions as F

from tidemark.operators import signal as sg
from tidemark.operators.joins import nearest_match
from tidemark.operators.sweeps import judge_settings, sweep_snap
from tidemark.plans.nearest import nearest


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tracks(spark, count=3, length=400):
    rows = spark.range(count * length).select(
        (F.col("id") % count).alias("k"), F.floor(F.col("id") / count).alias("idx"), (F.rand(7) * 20 + 10 * F.sin(F.col("id") / 40)).alias("level")
    )
    return rows.localCheckpoint()


def test_candidates_are_written_once(spark):
    """Their features were worked out again by every join that measured or read them."""
    assert "Window" not in plan(sg.candidate_table(tracks(spark), ["k"], 1.0)) and "Aggregate" not in plan(sg.candidate_table(tracks(spark), ["k"], 1.0))


def test_one_context_gives_all_shape_features(spark):
    series, bound = sg.smoothed_series(tracks(spark), ["k"], 5)
    peaks = sg.peaks_of(series, ["k"], 8, 0.8, bound)
    series = series.select("k", "idx", "smooth")
    apart = sg.edge_features(sg.level_features(peaks, series, ["k"], 1.0), series, ["k"], 1.0, bound=bound)
    once = sg.shape_features(peaks, series, ["k"], 1.0, bound=bound)
    assert once.columns == apart.columns
    want, got = (sorted(map(repr, df.collect())) for df in (apart, once))
    assert len(want) > 30 and got == want


def test_shape_features_of_tracks_beyond_a_pack(spark, monkeypatch):
    series, bound = sg.smoothed_series(tracks(spark), ["k"], 5)
    peaks = sg.peaks_of(series, ["k"], 8, 0.8, bound)
    once = sg.shape_features(peaks, series, ["k"], 1.0, bound=bound)
    monkeypatch.setattr(sg, "PACK", 128)
    packs = sg.shape_features(peaks, series, ["k"], 1.0, bound=bound)
    assert sorted(map(repr, packs.select(once.columns).collect())) == sorted(map(repr, once.collect()))


def shared_times(spark):
    """Few times, many rows at each; null keys and times, keys on one side only, equal ties at one time."""
    left = spark.range(300).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") % 5 * 3).cast("double")).alias("t"), F.col("id").alias("no")
    )
    right = spark.range(400).filter("id % 3 < 2 OR id % 7 = 0").select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"), F.when(F.col("id") % 13 > 0, (F.col("id") % 4 * 4).cast("double")).alias("u"), F.col("id").alias("own")
    )
    return left, right


def test_nearest_of_folded_times_is_the_same(spark):
    left, right = shared_times(spark)
    plain, folded = (
        sorted(map(repr, nearest(left, right, ["k"], "t", "u", {"own": "own"}, "own", coarse=c).collect())) for c in (False, True)
    )
    assert len(plain) == 300 and folded == plain


def test_nearest_match_folds_rows_of_one_time(tiny_blocks):
    """Hundreds of rows at a few times fit a task; each row went through sorted, written blocks."""
    left, right = shared_times(tiny_blocks)
    out = nearest_match(left, right, ["k"], "t", "u", 3.0, "own", {"own": "own"})
    assert "ExistingRDD" not in plan(out) and out.count() == 300


def test_a_sweep_picks_its_events_once(spark):
    """Every window, and every reading of the judge, selected the events again."""
    calls = spark.sparkContext.accumulator(0)
    pool = spark.range(40).select(F.lit(0).alias("k"), (F.col("id") * 10.0).alias("t"), (F.col("id") * 7 % 40).cast("double").alias("peak"))

    @F.udf("double")
    def seen(t):
        calls.add(1)
        return t

    picked = sweep_snap(pool.withColumn("t", seen("t")), pool, ["k"], "peak", [0.0, 6.0, 12.0, 25.0])
    out = judge_settings(picked, ["window"], pool.select("k", "t"), pool.select("k").distinct(), ["k"]).collect()
    assert [r["outputs"] for r in out] == [40] * 4 and calls.value == 40

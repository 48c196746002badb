"""State of append-only label logs: marks, finished flags and verdicts.

A log row carries ``line_no``; later lines win where the rule says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import label_candidates


def mark_key() -> Column:
    return F.bround("time", 2)


def label_key() -> Column:
    return F.bround("time", 1)


def live_marks(log: DataFrame) -> DataFrame:
    """Added and never deleted marks per (audio, time at 0.01 s); a deleted time stays deleted.

    Anything that is not an ``add`` deletes.  One map-side-combined aggregate replaces two sets.
    """
    adds = F.col("action") == "add"
    state = log.groupBy("audio", mark_key().alias("time")).agg(
        F.bool_or(adds).alias("_added"), F.bool_or(~adds).alias("_deleted")
    )
    return state.filter(F.col("_added") & ~F.col("_deleted")).select("audio", "time")


def latest_verdict(log: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Last line per (audio, time at 0.1 s)."""
    return log.groupBy("audio", label_key().alias("time")).agg(
        F.max_by(F.struct("verdict", "line_no", *carried), "line_no").alias("_last")
    ).select("audio", "time", "_last.*")


def done_flag(log: DataFrame) -> DataFrame:
    """Last line per audio; a missing flag means finished."""
    return log.groupBy("audio").agg(F.max_by(F.coalesce("done", F.lit(True)), "line_no").alias("done"))


def done_any(log: DataFrame) -> DataFrame:
    """Training's looser reading: any line that says finished."""
    return log.groupBy("audio").agg(F.bool_or(F.coalesce("done", F.lit(True))).alias("done"))


def export_truth(marks: DataFrame, done: DataFrame, work: Column, track: Column) -> DataFrame:
    """Live marks of finished tracks as (work, track, t) rows; tracks without keys are left out."""
    finished = done_flag(done).filter("done").select("audio")
    rows = live_marks(marks).join(finished, "audio", "left_semi")
    return rows.select(work.alias("work_id"), track.alias("track_id"), F.col("time").alias("t")).filter(
        F.col("work_id").isNotNull() & F.col("track_id").isNotNull()
    )


def export_feedback(log: DataFrame) -> DataFrame:
    """Latest verdicts that say yes or no and carry features."""
    rows = latest_verdict(log, ["feats"])
    return rows.filter(F.col("verdict").isin(0, 1) & F.col("feats").isNotNull() & (F.cardinality("feats") > 0))


def new_feedback_rows(log: DataFrame, work: Column, features: Sequence[str]) -> DataFrame:
    """Latest verdicts as training rows with one column per feature; unusable ones keep a ``status``."""
    rows = latest_verdict(log, ["feats"])
    status = F.when(F.col("verdict").isNull(), "undone").when(F.col("feats").isNull(), "no features").when(
        work.isNull(), "no work"
    ).otherwise("usable")
    return rows.select(
        work.alias("work_id"),
        "audio",
        "time",
        status.alias("status"),
        F.when(status == "usable", F.col("verdict")).alias("label"),
        *[F.coalesce(F.try_element_at("feats", F.lit(f)), F.lit(0.0)).alias(f) for f in features],
    )


def relabel(candidates: DataFrame, truth: DataFrame, keys: Sequence[str], previous: str, tolerance: float = 20.0) -> DataFrame:
    """Recompute hit and distance against changed truth; ``changed`` compares with the previous hit."""
    rows = label_candidates(candidates, truth, keys, tolerance)
    return rows.withColumn("changed", F.col("hit") != F.col(previous))

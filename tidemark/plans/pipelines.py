"""Whole workflows composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import BANDS_PROBABILITY, band, formula_score
from tidemark.operators import events as ev
from tidemark.operators import signal as sg
from tidemark.operators.joins import best_cue
from tidemark.operators.models import PROBABILITY_CAP, SHORTEST
from tidemark.session import cut


def hand_made_score() -> Column:
    return formula_score(F.col("signature"), F.col("recover"), F.col("txt"))


def detect_events(
    frames: DataFrame,
    keys: Sequence[str],
    hop: float,
    score: Callable[[], Column] = hand_made_score,
    least: float | None = None,
    top: int = 3,
    gap: float = ev.MERGE_GAP,
    window: float = ev.SNAP_WINDOW,
    snap_by: str = "peak",
    segments: DataFrame | None = None,
    cues: Sequence[tuple[str, str, int]] = (),
) -> tuple[DataFrame, DataFrame]:
    """Frames to (candidates, events): peaks, features, score, threshold, merge, snap.

    ``txt`` is the strongest cue said near a candidate, 0 without ``segments``.  Candidates are identified by
    their frame index and written once, because selection and snapping both read them.
    """
    found = sg.candidate_table(frames, keys, hop)
    if segments is None:
        found = found.withColumn("txt", F.lit(0).cast("long"))
    else:
        found = best_cue(found, segments, keys, cues).withColumnRenamed("cue", "txt").drop("cue_tags")
    rows = found.withColumn("score", score()).withColumn("cand_no", F.col("idx"))
    kept = cut(rows if least is None else ev.threshold_filter(rows, "score", least))
    picked = ev.merge_candidates(kept, keys, "cand_no", top, gap)
    return kept, ev.snap(picked, kept, keys, snap_by, F.col("rank_energy"), window)


def plain_probability(rows: DataFrame) -> DataFrame:
    """The score itself, from 0 to the highest probability that is shown."""
    return rows.withColumn("probability", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(PROBABILITY_CAP)))


def detect_with_model(
    candidates: DataFrame,
    tracks: DataFrame,
    keys: Sequence[str],
    hop: float,
    predict: Callable[[DataFrame], DataFrame],
    probability: Callable[[DataFrame], DataFrame] = plain_probability,
    refine: Callable[[DataFrame], DataFrame] | None = None,
    least: float | None = None,
    top: int = 3,
    gap: float = ev.MERGE_GAP,
    window: float = ev.SNAP_WINDOW,
    shortest: float = SHORTEST,
    verdict_from: float = ev.TRACK_MIN_PROBABILITY,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates with features to (scored candidates, events, verdicts) by trained models.

    ``predict`` adds ``score``, which orders candidates; ``probability`` adds a calibrated ``probability``, non-decreasing in the score, for
    thresholds and display; ``refine`` adds ``ref_score``, by which events are moved, else the louder candidate wins. Tracks
    (``keys, n_frames``) shorter than ``shortest`` seconds are skipped, for their features are unstable: their verdict
    is no event, with ``status`` ``short``. An event has the highest probability among its members, which is that of its best.
    """
    long_enough = F.col("n_frames") * F.lit(float(hop)) >= F.lit(float(shortest))
    rows = probability(predict(candidates.filter(long_enough)))
    rows = rows.withColumn("confidence", band(F.col("probability"), BANDS_PROBABILITY))
    rows = rows if refine is None else refine(rows)
    kept = cut(rows if least is None else ev.threshold_filter(rows, "probability", least))
    picked = ev.merge_candidates(kept, keys, "cand_no", top, gap)
    shown = picked.join(kept.select(*keys, "cand_no", "probability", "confidence"), [*keys, "cand_no"])
    events = cut(ev.snap(shown, kept, keys, "peak" if refine is None else "ref_score", F.col("cand_no"), window))
    found = ev.track_verdict(events, tracks, keys, "probability", verdict_from)
    status = F.when(long_enough, "ok").otherwise("short")
    return kept, events, found.join(tracks.select(*keys, status.alias("status")), list(keys))

"""Registered queries over the given tables, each with an independent SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.base import Case

_PARTS = ["signal", "text", "shaping", "spans", "joins", "events", "metrics", "labels", "sources", "models", "streams", "sweeps"]

# columns the SQL twin computes as 32-bit numbers; both sides give 64-bit ones
_NARROW = {
    "f12_work_and_track_key": "track_no",
    "i1_coverage": "ord",
    "e1_merge_candidates": "merged",
    "e2_merge_scan_down": "merged",
    "e3_merge_nearest_rep": "merged",
    "e3_merge_nearest_best": "merged",
    "e3_merge_nearest_weighted": "merged",
    "e13_detect_events": "merged",
    "a14_nearest_is_best_rate": "is_total",
    "a29_parse_report": "is_total",
    "l2_latest_verdict": "verdict",
    "l5_export_feedback": "verdict",
    "k1_timed_lines_both": "part",
    "k1_timed_lines_inline": "part",
    "k3_write_segments_json": "part",
    "k4_write_events_json": "merged",
    "st2_latest_verdict_stream": "verdict",
    "st4_progress_stream": "file_index",
    "st4_progress_batch": "file_index",
}


def _widened(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("long") if f.dataType.simpleString() == "int" else F.col(f.name) for f in df.schema])


def _wide(name: str, case: Case) -> Case:
    text = case.sql
    if name in _NARROW:
        text = f"SELECT * REPLACE ({_NARROW[name]}::BIGINT AS {_NARROW[name]}) FROM ({text})"
    return Case(lambda spark, base: _widened(case.run(spark, base)), text)


def cases() -> dict[str, Case]:
    found: dict[str, Case] = {}
    for part in _PARTS:
        found.update(import_module(f"tidemark.catalog.{part}").CASES)
    return {name: _wide(name, case) for name, case in found.items()}

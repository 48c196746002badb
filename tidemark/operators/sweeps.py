"""Parameter sweeps: all settings of a rule in one plan, judged against the truths side by side.

A setting becomes part of every key, and the operators read it as a column. So a sweep is one job however many settings
it has; a rule that needs another plan (a kernel's shape, a way to average) is one branch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators.joins import match_events
from tidemark.session import cut


def with_settings(rows: DataFrame, grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """Every row once for each setting, with the setting's values as columns."""
    settings = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in one.items()]) for one in grid])
    return rows.select("*", F.inline(settings))


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sweep_merge(candidates: DataFrame, keys: Sequence[str], ident: str, grid: Sequence[tuple[float, float]], modes: Sequence[str] = ("mean", "best"), top: int = 3) -> DataFrame:
    """``merge_chain`` for each (merge, gap) of the grid and each way to place a group: ``mode, merge, gap, keys, rank, t, score, members``.

    A merge of 0 joins only candidates at one time, which is no merging.
    """
    rows = with_settings(candidates, [{"merge": float(m), "gap": float(g)} for m, g in grid])
    picked = [
        ev.merge_chain(rows, ["merge", "gap", *keys], ident, F.col("merge"), F.col("gap"), top, mode).withColumn("mode", F.lit(mode)) for mode in modes
    ]
    return _stacked(picked)


def sweep_kernel(
    candidates: DataFrame, keys: Sequence[str], kernels: Sequence[str], widths: Sequence[float], powers: Sequence[float], min_sep: float = 30.0, top: int = 3
) -> DataFrame:
    """``kde_select`` for each kernel, width and power: ``kernel, h, power, keys, rank, t, density``."""
    rows = with_settings(candidates, [{"h": float(h), "power": float(p)} for h in widths for p in powers])
    picked = [
        ev.kde_select(rows, ["h", "power", *keys], F.col("h"), kernel, F.col("power"), min_sep, top).withColumn("kernel", F.lit(kernel)) for kernel in kernels
    ]
    return _stacked(picked)


def sweep_snap(events: DataFrame, pool: DataFrame, keys: Sequence[str], by: str, windows: Sequence[float]) -> DataFrame:
    """``snap`` of the same events for each window: ``window`` and the moved events; 0 leaves them where they are."""
    parts = []
    events = cut(events)  # every window reads them
    for w in windows:
        moved = ev.snap(events, pool, keys, by, F.col("t"), w) if w > 0 else events.withColumn("snapped_from", F.lit(None).cast("double"))
        parts.append(moved.withColumn("window", F.lit(float(w))))
    return _stacked(parts)


def sweep_top(ranked: DataFrame, tops: Sequence[int]) -> DataFrame:
    """Ranked events cut off at each number: ``top`` and the events that are left."""
    return ranked.select("*", F.explode(F.array(*[F.lit(int(k)) for k in tops])).alias("top")).filter(F.col("rank") <= F.col("top"))


def judge_settings(
    picked: DataFrame, settings: Sequence[str], truth: DataFrame, labelled: DataFrame, keys: Sequence[str], tolerance: float = 20.0
) -> DataFrame:
    """For each setting that picked something: outputs, hits, precision, recall, mean error of the hits, and share within 5 s.

    Truths of tracks on which a setting picked nothing count as missed. The settings that occur, a few, are read first.
    What was picked is written once, because the matches measure and read it several times.
    """
    picked = cut(picked)
    levels = [r.asDict() for r in picked.select(*settings).distinct().collect()]
    spread, tracks = (with_settings(rows, levels) if levels else picked.limit(0) for rows in (truth, labelled.select(*keys).distinct()))
    hits, covered = match_events(picked, spread, tracks, [*settings, *keys], tolerance)
    off = F.when(F.col("hit"), F.col("dist"))
    out = hits.groupBy(*settings).agg(
        F.count("*").alias("outputs"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("precision"),
        F.avg(off).alias("mean_abs"), F.avg((off <= 5).cast("double")).alias("within_5"),
    )
    found = covered.groupBy(*settings).agg(F.avg(F.col("covered").cast("double")).alias("recall"))
    return out.join(found, list(settings), "left")

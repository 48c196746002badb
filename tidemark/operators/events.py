"""Selecting, merging and re-positioning event candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.names import format_mmss
from tidemark.operators.intervals import group_by_gap
from tidemark.operators.joins import top_per_key
from tidemark.plans.folds import ranked_fold, select_spaced, sorted_groups
from tidemark.plans.nearest import window_best
from tidemark.session import cut

# Distance within which candidates are one event, extra candidates considered, snap
# distance, and the lowest best value of a track that has an event.
MERGE_GAP = 30.0
POOL_EXTRA = 1
SNAP_WINDOW = 12.0
TRACK_MIN_PROBABILITY = 0.30
TRACK_MIN_SCORE = 2.3
GRID = 0.5

# least cells of a stretch of a density, points of one that stay together, and parts of one with more
_STRETCH_CELLS, _PACK_POINTS, _PACK_PARTS = 2048, 4096, 256

_REP = "struct<time:double,score:double,sum:double,n:int,best:bigint,weight:double>"


def threshold_filter(candidates: DataFrame, column: str, least: float) -> DataFrame:
    """Candidates at or above a threshold; null scores never pass."""
    return candidates.filter(F.col(column) >= least)


def _reps(acc: Column) -> Column:
    return acc["reps"]


def _merge_step(gap: float, top: int | None, nearest_rep: bool, mode: str, stops: bool):
    """One candidate against the representatives: join one, open a new one, or pass."""

    def step(acc: Column, x: Column) -> Column:
        reps, t = acc["reps"], x["t"]
        away = F.transform(reps, lambda r: F.abs(t - r["time"]))
        if nearest_rep:
            closest = F.array_min(away)
            at = F.when(closest <= gap, F.array_position(away, closest)).otherwise(F.lit(0))
        else:
            at = F.array_position(F.transform(away, lambda d: d <= gap), F.lit(True))
        at = at.cast("int")

        def joined(r: Column) -> Column:
            total, n = r["sum"] + t, r["n"] + 1
            if mode == "best":
                time = r["time"]
            elif mode == "weighted":
                w = F.greatest(-x["_neg"], F.lit(1e-6))
                time = (t * w + (total - t)) / (w + (n - 1))
            else:
                time = total / n
            return F.struct(
                time.alias("time"), r["score"].alias("score"), total.alias("sum"), n.alias("n"), r["best"].alias("best"),
                r["weight"].alias("weight"),
            )

        fresh = F.struct(
            t.alias("time"), (-x["_neg"]).alias("score"), t.alias("sum"), F.lit(1).alias("n"),
            x["id"].alias("best"), F.lit(1.0).alias("weight"),
        )
        updated = F.transform(reps, lambda r, i: F.when(i == at - 1, joined(r)).otherwise(r))
        room = F.lit(True) if top is None else F.size(reps) < top
        nxt = F.when(at > 0, updated).when(room, F.array_append(reps, fresh)).otherwise(reps)
        full = (at == 0) & ~room
        closed = acc["closed"] | full if stops else acc["closed"]
        return F.struct(F.when(acc["closed"], reps).otherwise(nxt).alias("reps"), closed.alias("closed"))

    return step


def _merge_walk(gap: float, top: int | None, nearest_rep: bool, mode: str, stops: bool):
    """``_merge_step`` for one key whose rows stream past: makes a function of (negative score, t, id)."""

    def start():
        reps: list[dict] = []

        def take(values):
            neg, t, ident = values
            away = [abs(t - r["time"]) for r in reps]
            if nearest_rep:
                at = away.index(min(away)) if away and min(away) <= gap else None
            else:
                at = next((i for i, d in enumerate(away) if d <= gap), None)
            full = False
            if at is not None:
                r = reps[at]
                total, n = r["sum"] + t, r["n"] + 1
                if mode == "weighted":
                    w = max(-neg, 1e-6)
                    r["time"] = (t * w + (total - t)) / (w + (n - 1))
                elif mode != "best":
                    r["time"] = total / n
                r["sum"], r["n"] = total, n
            elif top is None or len(reps) < top:
                reps.append({"time": t, "score": -neg, "sum": t, "n": 1, "best": ident, "weight": 1.0})
            else:
                full = stops
            return {"reps": reps, "closed": full}, not full

        return take

    return start


def _fold_events(candidates: DataFrame, keys: Sequence[str], ident: str, top: int, rule: tuple) -> DataFrame:
    """Events by one of the merging rules; candidates without a time or score can't be placed and are left out."""
    rows = candidates.filter(F.col("t").isNotNull() & F.col("score").isNotNull()).select(
        *keys, (-F.col("score").cast("double")).alias("_neg"), F.col("t").cast("double").alias("t"), F.col(ident).cast("long").alias("id")
    )
    init = F.struct(F.array().cast(f"array<{_REP}>").alias("reps"), F.lit(False).alias("closed"))
    state = ranked_fold(rows, keys, ["_neg", "t", "id"], [], init, _merge_step(*rule), _merge_walk(*rule))
    ranked = F.array_sort(
        F.transform(
            F.col("state.reps"),
            lambda r, i: F.struct((-r["score"]).alias("neg"), i.alias("i"), r.alias("r")),
        )
    )
    flat = state.select(*keys, F.posexplode(F.slice(ranked, 1, top)).alias("rank", "e"))
    return flat.select(
        *keys,
        (F.col("rank") + 1).alias("rank"),
        F.col("e.r.best").alias(ident),
        F.col("e.r.time").alias("t"),
        F.col("e.r.score").alias("score"),
        F.col("e.r.n").alias("merged"),
    )


def merge_candidates(
    candidates: DataFrame, keys: Sequence[str], ident: str, top: int = 3, gap: float = MERGE_GAP, pool: int | None = None
) -> DataFrame:
    """Events from the ``pool`` best candidates per track: each joins the first event within ``gap``.

    An event's time is the mean of its members; identity and score are those of its best member.
    """
    pool = top + POOL_EXTRA if pool is None else max(1, pool)
    order = [F.col("score").desc(), F.col("t"), F.col(ident)]
    best = top_per_key(candidates.select(*keys, ident, "t", "score"), keys, order, pool, "_nth").drop("_nth")
    rows = best.select(*keys, F.struct((-F.col("score")).alias("_neg"), F.col("t").cast("double").alias("t"), F.col(ident).cast("long").alias("id")).alias("c"))
    init = F.struct(F.array().cast(f"array<{_REP}>").alias("reps"), F.lit(False).alias("closed"))
    step = _merge_step(gap, None, False, "mean", False)
    state = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("_c")).select(
        *keys, F.aggregate("_c", init, step).alias("state")
    )
    ranked = F.array_sort(
        F.transform(F.col("state.reps"), lambda r, i: F.struct((-r["score"]).alias("neg"), i.alias("i"), r.alias("r")))
    )
    flat = state.select(*keys, F.posexplode(F.slice(ranked, 1, top)).alias("rank", "e"))
    return flat.select(
        *keys,
        (F.col("rank") + 1).alias("rank"),
        F.col("e.r.best").alias(ident),
        F.col("e.r.time").alias("t"),
        F.col("e.r.score").alias("score"),
        F.col("e.r.n").alias("merged"),
    )


def merge_scan_down(candidates: DataFrame, keys: Sequence[str], ident: str, top: int = 3, gap: float = MERGE_GAP) -> DataFrame:
    """Like :func:`merge_candidates` over all candidates: new events stop at ``top``, means keep moving."""
    return _fold_events(candidates, keys, ident, top, (gap, top, False, "mean", False))


def merge_nearest_rep(
    candidates: DataFrame, keys: Sequence[str], ident: str, top: int = 3, gap: float = MERGE_GAP, mode: str = "mean"
) -> DataFrame:
    """Join the nearest event (``mean``, ``best`` or ``weighted`` time); stop at the first that fits nowhere."""
    return _fold_events(candidates, keys, ident, top, (max(gap, 1e-9), top, True, mode, True))


def merge_chain(
    candidates: DataFrame, keys: Sequence[str], ident: str, merge: float, gap: float, top: int = 3, mode: str = "mean"
) -> DataFrame:
    """Connected groups of candidates (successive distance at most ``merge``), then spaced picks.

    Groups are true connected components; a group's time is its mean or that of its best member.
    """
    best = F.max_by("t", F.struct("score", -F.col("t"))).alias("best_t")
    groups = group_by_gap(candidates, keys, "t", merge, ident, [F.max("score").alias("score"), best])
    rows = groups.select(*keys, F.col("mean_t" if mode == "mean" else "best_t").alias("t"), "score", "members")
    return select_spaced(rows, keys, "t", "score", gap, top, ["members"])


def snap(
    events: DataFrame, pool: DataFrame, keys: Sequence[str], by: str, tie: Column, window: float = SNAP_WINDOW
) -> DataFrame:
    """Move each event to the pool member with the largest ``by`` within ``window``; remember where it came from.

    Two events may land on the same member.
    """
    rows = window_best(events, pool, keys, "t", "t", window, F.col(by), tie, {"_to": F.col("t")})
    moved = F.col("_to").isNotNull() & (F.abs(F.col("_to") - F.col("t")) > 1e-6)
    cols = [F.coalesce("_to", "t").alias("t") if c == "t" else F.col(c) for c in events.columns]
    return rows.select(*cols, F.when(moved, F.col("t")).alias("snapped_from"))


def track_verdict(events: DataFrame, tracks: DataFrame, keys: Sequence[str], column: str, least: float) -> DataFrame:
    """Per track: best value over its events, whether that is an event, and how many were merged."""
    best = events.groupBy(*keys).agg(F.max(column).alias("max_score"), F.sum("merged").alias("merged_total"))
    rows = tracks.select(*keys).join(best, list(keys), "left")
    return rows.select(
        *keys,
        F.coalesce(F.col("max_score") >= least, F.lit(False)).alias("has_event"),
        "max_score",
        F.coalesce("merged_total", F.lit(0)).alias("merged_total"),
    )


def kde_select(
    candidates: DataFrame,
    keys: Sequence[str],
    h: float | Column = 10.0,
    kernel: str = "gauss",
    power: float | Column = 1.0,
    min_sep: float = 30.0,
    top: int = 3,
) -> DataFrame:
    """Peaks of a weighted kernel density on a half-second grid, at most ``top``, ``min_sep`` apart.

    Candidates at one time are one point. A point is sent to the stretches of grid that it reaches (the Gaussian until it
    underflows), and a stretch is summed and pruned where it lies: cells that better ones of their stretch rule out are not
    moved. Cells of density 0 aren't either: the first free ones fill up what the others leave. Width and power may be
    columns that are part of the keys.
    """
    width = h if isinstance(h, Column) else F.lit(float(h))
    reach = width * 39 if kernel == "gauss" else width
    weighted = candidates.filter(F.col("t").isNotNull()).select(
        *keys, F.col("t").cast("double").alias("t"), F.pow(F.greatest(F.col("score"), F.lit(0.0)), power).alias("_w")
    )
    points = weighted.groupBy(*keys, "t").agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"))
    span = points.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.sum("_w").alias("_sum"))
    span = span.withColumn("_lo", F.col("_lo") - 5 * width).withColumn("_hi", F.col("_hi") + 5 * width)
    span = span.withColumn("_cells", F.ceil((F.col("_hi") - F.col("_lo")) / GRID))
    weight = F.when(F.col("_sum") > 0, F.col("_w")).otherwise(F.col("_n").cast("double"))
    stretch = F.greatest(4 * reach, F.lit(_STRETCH_CELLS * GRID))
    at = F.col("t") - F.col("_lo")
    places = F.sequence(F.floor((at - reach - GRID) / stretch), F.floor((at + reach + GRID) / stretch))
    near = points.join(span, list(keys)).select(
        *keys, F.explode(places).alias("_place"), "t", weight.alias("_w"), "_lo", "_cells", width.cast("double").alias("_width"),
        reach.cast("double").alias("_reach"), stretch.cast("double").alias("_stretch"),
    ).filter("_place >= 0")
    # very many points of one stretch are dealt to several parts; those are summed before anything is left out
    part = F.pmod(F.xxhash64("t"), F.lit(_PACK_PARTS))
    few = near.groupBy(*keys, "_place").agg(F.count("*").alias("_points"))
    near = near.join(few, [*keys, "_place"]).withColumn("_part", F.when(F.col("_points") > _PACK_POINTS, part).otherwise(F.lit(-1).cast("long"))).drop("_points")
    group = [*keys, "_place", "_part"]
    types = [to_arrow_type(near.schema[k].dataType) for k in keys]
    kinds = ", ".join(f"`{k}` {near.schema[k].dataType.simpleString()}" for k in keys)
    dealt = near.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "t")
    partial = dealt.mapInArrow(_stretch_sums(group, types, kernel, float(min_sep), top), f"{kinds}, cell bigint, d double")
    density = partial.groupBy(*keys, "cell").agg(F.round(F.sum("d"), 9).alias("density")).filter("density > 0")
    rows = density.join(span.select(*keys, "_lo"), list(keys)).select(*keys, (F.col("_lo") + F.col("cell") * GRID).alias("t"), "density")
    picked = select_spaced(cut(rows), keys, "t", "density", min_sep, top)
    return _filled_up(picked, span, keys, min_sep, top)


def _stretch_sums(group: Sequence[str], types: Sequence, kernel: str, min_sep: float, top: int):
    """Densities of the cells of each stretch of sorted points, less those that can't be among the ``top`` picks.

    A pick is preceded by fewer than ``top`` others, and all better cells are near one of them. So a cell goes if ``top``
    better ones of its stretch lie more than two separations from each other. Densities that differ by rounding count as equal.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["t", "_w", "_lo", "_cells", "_width", "_reach", "_stretch"]
        for key, x in sorted_groups(batches, group, names):
            lo, width, reach, stretch = (float(x[c][0]) for c in ("_lo", "_width", "_reach", "_stretch"))
            place, part = key[-2], key[-1]
            first = max(0, int(np.ceil(place * stretch / GRID)))
            last = min(int(x["_cells"][0]), int(np.ceil((place + 1) * stretch / GRID)))
            if last <= first:
                continue
            total = np.zeros(last - first)
            span = np.arange(-1, int(2 * reach / GRID) + 3)
            rows = max(1, (1 << 20) // len(span))
            for i in range(0, len(x["t"]), rows):
                t, w = x["t"][i : i + rows, None], x["_w"][i : i + rows, None]
                cell = np.floor((t - lo - reach) / GRID).astype(np.int64) + span
                u = np.abs(lo + cell * GRID - t) / width
                if kernel == "gauss":
                    d = np.exp(-0.5 * u * u)
                elif kernel == "tri":
                    d = np.maximum(1 - u, 0.0)
                else:
                    d = np.where(u < 1, 0.5 * (1 + np.cos(np.pi * u)), 0.0)
                inside = (cell >= first) & (cell < last)
                total += np.bincount(cell[inside] - first, (d * w)[inside], last - first)
            found = np.flatnonzero(total > 0)
            if part < 0:
                found = found[total[found] > 4e-10]
                d, far = total[found], np.ones(len(found), dtype=bool)
                least = -np.inf
                for k in range(top):
                    if not far.any():
                        least = -np.inf
                        break
                    best = np.flatnonzero(far)[d[far].argmax()]
                    least = d[best]
                    far &= np.abs(found - found[best]) * GRID > 2 * min_sep + GRID
                found = found[d >= least * (1 - 1e-12) - 2e-9]
            n = len(found)
            if n:
                keys = [pa.array([k] * n, t) for k, t in zip(key[:-2], types)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found + first), pa.array(total[found])], [*group[:-2], "cell", "d"])

    return run


def _filled_up(picked: DataFrame, span: DataFrame, keys: Sequence[str], gap: float, top: int) -> DataFrame:
    """Picks of positive density, then the first cells of density 0 more than ``gap`` from all others, until there are ``top``.

    All positive cells lie near a pick when fewer than ``top`` are found, so a free cell has density 0; the first free one is cell 0 or
    the first beyond a pick.
    """
    item = F.struct(F.col("rank").cast("int").alias("rank"), F.col("t").alias("t"), F.col("density").alias("density"))
    held = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_held"))
    rows = span.select(*keys, "_lo", "_cells").join(held, list(keys), "left")
    kept = F.coalesce("_held", F.array().cast("array<struct<rank:int,t:double,density:double>>"))
    time = lambda c: F.col("_lo") + c * GRID

    def step(acc: Column, _: Column) -> Column:
        beyond = F.flatten(F.transform(acc, lambda k: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.floor((k["t"] + gap - F.col("_lo")) / GRID) + i)))
        cells = F.concat(F.array(F.lit(0).cast("long")), beyond)
        free = F.filter(cells, lambda c: (c >= 0) & (c < F.col("_cells")) & ~F.exists(acc, lambda k: F.abs(k["t"] - time(c)) <= gap))
        first = F.array_min(free)
        more = F.struct((F.size(acc) + 1).alias("rank"), time(first).alias("t"), F.lit(0.0).alias("density"))
        return F.when((F.size(acc) >= top) | first.isNull(), acc).otherwise(F.array_append(acc, more))

    full = F.aggregate(F.sequence(F.lit(1), F.lit(top)), kept, step)
    return rows.select(*keys, F.explode(full).alias("_e")).select(*keys, "_e.rank", "_e.t", "_e.density")


def kde_hybrid(
    candidates: DataFrame, keys: Sequence[str], ident: str, k: int = 6, use_snap: bool = True, window: float = SNAP_WINDOW, **kde
) -> DataFrame:
    """Density selection over the ``k`` best candidates, then a snap to the loudest candidate of all."""
    order = [F.col("score").desc(), F.col("t"), F.col(ident)]
    best = top_per_key(candidates.select(*keys, ident, "t", "score"), keys, order, k, "_nth")
    picked = kde_select(best, keys, **kde)
    if not use_snap:
        return picked
    return snap(picked, candidates, keys, "peak", F.col("t"), window)


def two_stage(
    candidates: DataFrame, keys: Sequence[str], ident: str, relocate: str | None, window: float, top: int = 3
) -> DataFrame:
    """Select by the classifier score, then relocate by level, by refinement score, or not at all."""
    events = merge_candidates(candidates, keys, ident, top)
    if relocate is None:
        return events.withColumn("snapped_from", F.lit(None).cast("double"))
    return snap(events, candidates, keys, relocate, F.col("t"), window)


def closest_pairs(
    candidates: DataFrame, truth: DataFrame, keys: Sequence[str], ident: str, window: float = 60.0, tolerance: float = 20.0, top: int = 3
) -> DataFrame:
    """Neighbouring pairs among each track's ``top`` candidates, classed by the truths they hit.

    A track gives at most ``top - 1`` pairs, so joining its truths stays linear.
    """
    order = [F.col("score").desc(), F.col("t"), F.col(ident)]
    best = top_per_key(candidates.select(*keys, ident, "t", "score"), keys, order, top, "_nth")
    ordered = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "score", ident))).alias("_c"))
    pairs = ordered.select(
        *keys,
        F.inline(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("_c") - 1, F.lit(1))),
                lambda i: F.struct(F.get("_c", i - 1).alias("a"), F.get("_c", i).alias("b")),
            )
        ),
    ).filter(F.col("b").isNotNull() & (F.col("b.t") - F.col("a.t") <= window))
    hits = pairs.join(truth.select(*keys, F.col("t").alias("_g")), list(keys), "left")
    near_a = F.abs(F.col("a.t") - F.col("_g")) <= tolerance
    near_b = F.abs(F.col("b.t") - F.col("_g")) <= tolerance
    counted = hits.groupBy(*keys, "a", "b").agg(
        F.count_if(near_a).alias("_na"),
        F.count_if(near_b).alias("_nb"),
        F.countDistinct(F.when(near_a | near_b, F.col("_g"))).alias("_both"),
    )
    both = (F.col("_na") > 0) & (F.col("_nb") > 0)
    kind = F.when(both & (F.col("_both") >= 2), "two truths").when(both, "one truth split").otherwise("contains miss")
    return counted.select(
        *keys,
        F.col("a.t").alias("t1"), F.col("b.t").alias("t2"), F.col("a.score").alias("score1"), F.col("b.score").alias("score2"),
        F.col(f"a.{ident}").alias("id1"), F.col(f"b.{ident}").alias("id2"), kind.alias("kind"),
    )


def with_clock(events: DataFrame) -> DataFrame:
    return events.withColumn("mmss", format_mmss(F.col("t")))

"""Frame series, smoothing, peaks and shape features around peaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import best_cue
from tidemark.plans.blocks import fit, frame_windows, largest_key, number_rows, position_bound, quantiles, shift, unblock
from tidemark.plans.folds import suppress
from tidemark.session import cut

# Feature names in model order, and the means and deviations of the hand-made score.
FEATURES = [
    "peak", "pre60", "pre30", "pre10", "post2", "post10", "post30", "signature", "contrast", "rise", "decay",
    "recover", "prominence", "plateau", "rel_time", "rank_energy", "gap_prev", "zcr", "centroid", "flatness", "txt",
]
WINDOWS = {
    "pre60": (-62, -35), "pre30": (-32, -10), "pre10": (-10, -2), "post2": (1.5, 4), "post10": (4, 10), "post30": (10, 30),
}
PACK = 4096


def frames_from_pcm(
    pcm: DataFrame, keys: Sequence[str], block_len: int, hop: int, win: int, level: str = "level"
) -> DataFrame:
    """Mean-square level in dB of each frame from sample blocks ``(keys, block_no, samples)``.

    Squares are first summed per ``hop`` cell, in each task before the shuffle, so only one small row per cell is
    shuffled; a frame then adds its ``win/hop`` cells.  A track of ``len`` samples has
    ``max(1, (len - win) div hop)`` frames.
    """
    if win % hop or block_len % hop:
        raise ValueError("win and block_len must be multiples of hop")
    cells_per_frame = win // hop
    x = F.col("_x").cast("double")
    cell = F.col("block_no") * (block_len // hop) + F.floor(F.col("_i") / hop)
    rows = (
        pcm.select(*keys, "block_no", F.posexplode("samples").alias("_i", "_x"))
        .groupBy(*keys, cell.alias("cell"))
        .agg(F.sum(x * x).alias("power"), F.count(F.lit(1)).alias("count"))
    )
    lengths = rows.groupBy(*keys).agg(F.sum("count").alias("_len"))
    per_frame = rows.select(
        *keys,
        F.explode(F.sequence(F.greatest(F.col("cell") - (cells_per_frame - 1), F.lit(0)), F.col("cell"))).alias("idx"),
        "power",
        "count",
    )
    sums = per_frame.groupBy(*keys, "idx").agg(F.sum("power").alias("power"), F.sum("count").alias("count"))
    total = F.greatest(F.lit(1), F.floor((F.col("_len") - win) / hop))
    mean = F.greatest(F.col("power") / F.col("count"), F.lit(1e-12))
    return (
        sums.join(lengths, list(keys))
        .filter(F.col("idx") < total)
        .select(*keys, "idx", (F.lit(10.0) * F.log10(mean)).alias(level))
    )


def moving_average(
    frames: DataFrame, keys: Sequence[str], k: int, value: str = "level", out: str = "smooth", bound: int | None = None
) -> DataFrame:
    """Zero-padded mean of ``k`` frames; an even ``k`` leans to the left."""
    before, after = k // 2, (k - 1) // 2
    rows = fit(frames, keys, ["idx"], position="idx", bound=bound)
    return frame_windows(
        rows, keys, "idx", before, after, {out: lambda w: F.sum(value).over(w.rowsBetween(-before, after)) / F.lit(float(k))}
    )


def track_levels(
    frames: DataFrame, keys: Sequence[str], value: str, pct: float = 0.95, bound: int | None = None
) -> DataFrame:
    """Per track: number of frames, median and upper percentile (linear interpolation)."""
    size = (F.max("idx") + 1).alias("n_frames")
    return quantiles(frames, keys, value, {"median": 0.5, "threshold": pct}, bound, [size])


def approximate_levels(frames: DataFrame, keys: Sequence[str], value: str, pct: float = 0.95) -> DataFrame:
    """Sketch-based twin of :func:`track_levels` for very large tracks, on request only."""
    return frames.groupBy(*keys).agg(
        (F.max("idx") + 1).alias("n_frames"),
        F.percentile_approx(value, 0.5, 100_000).alias("median"),
        F.percentile_approx(value, pct, 100_000).alias("threshold"),
    )


def local_maxima(
    frames: DataFrame, keys: Sequence[str], value: str, levels: DataFrame, bound: int | None = None
) -> DataFrame:
    """Frames not below the left and above the right neighbour, at or over the track's threshold."""
    rows = fit(frames, keys, ["idx"], position="idx", bound=bound)
    near = frame_windows(
        rows,
        keys,
        "idx",
        1,
        1,
        {"_left": lambda w: F.lag(value).over(w), "_right": lambda w: F.lead(value).over(w)},
    )
    v = F.col(value)
    tops = near.filter((v >= F.col("_left")) & (v > F.col("_right"))).drop("_left", "_right")
    return unblock(tops.join(levels, list(keys)).filter(v >= F.col("threshold")))


def find_peaks(
    frames: DataFrame,
    keys: Sequence[str],
    gap: int,
    smooth: int = 5,
    pct: float = 0.95,
    value: str = "level",
    bound: int | None = None,
) -> DataFrame:
    """Smoothed local maxima over the track percentile, thinned best-first to more than ``gap`` frames."""
    smoothed, bound = smoothed_series(frames, keys, smooth, value, bound)
    return peaks_of(smoothed, keys, gap, pct, bound)


def smoothed_series(
    frames: DataFrame, keys: Sequence[str], k: int, value: str = "level", bound: int | None = None
) -> tuple[DataFrame, int]:
    """(smoothed series, bound on frames per track); written once because peaks and features read it many times.

    Whether a track fits a task is told by counts, which don't number the frames; the largest index is read from what is written.
    """
    rows = largest_key(frames, keys)[0] if bound is None else bound
    smoothed = cut(moving_average(frames, keys, k, value, bound=rows))
    return smoothed, position_bound(smoothed, "idx") if bound is None else bound


def peaks_of(smoothed: DataFrame, keys: Sequence[str], gap: int, pct: float, bound: int) -> DataFrame:
    """Peaks of a smoothed series, with the track's median and length."""
    levels = track_levels(unblock(smoothed), keys, "smooth", pct, bound)
    tops = local_maxima(smoothed, keys, "smooth", levels, bound)
    return suppress(tops.select(*keys, "idx", "smooth", "median", "n_frames"), keys, "idx", "smooth", gap, bound)


def with_context(
    points: DataFrame, frames: DataFrame, keys: Sequence[str], before: int, after: int, value: str
) -> DataFrame:
    """Give each point the frames around it: ``ctx`` values and ``ctx_lo``, the index of the first.

    Frames are packed into arrays of fixed length plus a margin, so a pack is bounded whatever the
    track length, and each pack is shuffled once for all its points.
    """
    size = max(PACK, before, after)
    inside, home = F.col("idx") % size, F.floor(F.col("idx") / size)
    targets = F.filter(
        F.array(home, F.when(inside < after + 1, home - 1), F.when(inside >= size - before, home + 1)),
        lambda p: p.isNotNull() & (p >= 0),
    )
    packs = (
        frames.select(*keys, "idx", value, F.explode(targets).alias("_pack"))
        .groupBy(*keys, "_pack")
        .agg(F.sort_array(F.collect_list(F.struct("idx", value))).alias("_f"))
        .select(*keys, "_pack", F.col("_f")[0]["idx"].alias("ctx_lo"), F.transform("_f", lambda x: x[value]).alias("ctx"))
    )
    return points.withColumn("_pack", home).join(packs, [*keys, "_pack"]).drop("_pack")


def _span(lo: Column, hi: Column) -> Column:
    """Context values of frames ``[lo, hi)``."""
    return F.slice("ctx", (lo - F.col("ctx_lo") + 1).cast("int"), (hi - lo).cast("int"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _median(values: Column) -> Column:
    s = F.sort_array(F.array_compact(values))  # beyond its end lie the nulls
    n = F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def window_mean(a: float, b: float, hop: float) -> Column:
    """Mean over frames ``[i + a/hop, i + b/hop)`` clamped to the track, relative to its median."""
    i, n = F.col("idx"), F.col("n_frames")
    lo = F.least(F.greatest(F.lit(0), i + int(a / hop)), n - 1)
    hi = F.least(F.greatest(lo + 1, i + int(b / hop)), n)
    return _mean(_span(lo, hi)) - F.col("median")


def level_features(points: DataFrame, frames: DataFrame, keys: Sequence[str], hop: float, value: str = "smooth") -> DataFrame:
    """Peak height, six window means, signature, contrast, recover, prominence and plateau.

    ``points`` carries ``idx``, the value at the point, ``median`` and ``n_frames``.
    """
    reach = int(62 / hop)
    return _levels_in(with_context(points, frames, keys, reach, reach, value), hop, value).drop("ctx", "ctx_lo")


def _levels_in(rows: DataFrame, hop: float, value: str) -> DataFrame:
    """The values of :func:`level_features` from the context of each point."""
    i, n, med = F.col("idx"), F.col("n_frames"), F.col("median")
    minute, half, three = int(60 / hop), int(30 / hop), int(3 / hop)
    after = _span(i, F.least(n, i + minute))
    below = F.array_position(F.transform(after, lambda x: x < med), F.lit(True))
    around = _span(F.greatest(F.lit(0), i - half), F.least(n, i + half))
    close = _span(F.greatest(F.lit(0), i - three), F.least(n, i + three + 1))
    rows = rows.select(
        "*",
        (F.col(value) - med).alias("peak"),
        *[window_mean(a, b, hop).alias(name) for name, (a, b) in WINDOWS.items()],
        F.when(below > 0, (below - 1) * F.lit(hop)).otherwise(F.lit(60.0)).alias("recover"),
        _median(around).alias("_around"),
    )
    over = F.size(F.filter(close, lambda x: x > med + F.col("peak") * 0.5))
    return rows.select(
        "*",
        (F.col("pre30") - F.col("post2")).alias("signature"),
        (F.col("peak") - F.col("pre10")).alias("contrast"),
        (F.col("peak") - (F.col("_around") - med)).alias("prominence"),
        (over / F.size(close)).alias("plateau"),
    ).drop("_around")


def first_at_most(
    queries: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    threshold: str,
    value: str,
    backward: bool,
    out: str,
    last_index: int,
) -> DataFrame:
    """Index of the closest frame at or before (after) ``idx`` whose value is at most ``threshold``.

    Looks into the frame's own pack; what is not found there asks the table of pack minima the same
    question, recursively, and then opens the one pack that answers it.  Null if there is none.
    """
    packs = (
        series.withColumn("_pack", F.floor(F.col("idx") / PACK))
        .groupBy(*keys, "_pack")
        .agg(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("_f"))
    )
    q = queries.withColumn("_pack", F.floor(F.col("idx") / PACK))

    def look(rows: DataFrame, anchored: bool) -> DataFrame:
        limit = F.col(threshold)
        ok = F.filter(
            "_f",
            lambda x: (x["v"] <= limit)
            & ((x["idx"] <= F.col("idx")) if backward else (x["idx"] >= F.col("idx")))
            if anchored
            else x["v"] <= limit,
        )
        hit = F.try_element_at(ok, F.lit(-1 if backward else 1))["idx"]
        return rows.withColumn(out, hit).drop("_f")

    here = look(q.join(packs, [*keys, "_pack"], "left"), anchored=True)
    if last_index < PACK:
        return here.drop("_pack")
    found = here.filter(F.col(out).isNotNull()).drop("_pack")
    open_ = here.filter(F.col(out).isNull()).drop(out)
    minima = packs.select(*keys, F.col("_pack").alias("idx"), F.array_min(F.transform("_f", lambda x: x["v"])).alias("v"))
    asked = open_.select(
        *keys,
        (F.col("_pack") + (-1 if backward else 1)).alias("idx"),
        threshold,
        F.struct(*queries.columns).alias("_q"),
    )
    where = first_at_most(asked, minima, keys, threshold, "v", backward, "_at", last_index // PACK)
    again = where.withColumn("_pack", F.col("_at")).join(packs, [*keys, "_pack"], "left")
    far = look(again, anchored=False).select("_q.*", out)
    return found.unionByName(far.select(*found.columns))


def edge_features(
    points: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    hop: float,
    value: str = "smooth",
    bound: int | None = None,
) -> DataFrame:
    """Rise and decay: time back (forward) to the frame under the half-height between flank and peak.

    ``points`` carries ``peak``, ``pre10``, ``post2``, ``median`` and ``n_frames``; a flank that never
    falls that low counts to the track's first (last) frame.
    """
    rows = _half_heights(points)
    last = (position_bound(frames, "idx") if bound is None else bound) - 1
    rows = first_at_most(rows, frames, keys, "_up", value, True, "_j", last)
    rows = first_at_most(rows, frames, keys, "_down", value, False, "_k", last)
    return _edge_times(rows, hop)


def _half_heights(points: DataFrame) -> DataFrame:
    half = F.lit(0.5)
    return points.select(
        "*",
        (F.col("median") + F.col("pre10") * half + (F.col("peak") - F.col("pre10")) * half).alias("_up"),
        (F.col("median") + F.col("post2") + (F.col("peak") - F.col("post2")) * half).alias("_down"),
    )


def _edge_times(rows: DataFrame, hop: float) -> DataFrame:
    rise = (F.col("idx") - F.coalesce(F.col("_j"), F.lit(0))) * F.lit(hop)
    decay = (F.coalesce(F.col("_k"), F.col("n_frames") - 1) - F.col("idx")) * F.lit(hop)
    return rows.withColumn("rise", rise).withColumn("decay", decay).drop("_up", "_down", "_j", "_k")


def shape_features(points: DataFrame, frames: DataFrame, keys: Sequence[str], hop: float, value: str = "smooth", bound: int | None = None) -> DataFrame:
    """:func:`level_features` and :func:`edge_features`; where a track is one pack, frames are packed and joined once for both."""
    bound = position_bound(frames, "idx") if bound is None else bound
    if bound > PACK:
        return edge_features(level_features(points, frames, keys, hop, value), frames, keys, hop, value, bound)
    packs = frames.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", value))).alias("_f"))
    packs = packs.select(*keys, F.col("_f")[0]["idx"].alias("ctx_lo"), F.transform("_f", lambda x: x[value]).alias("ctx"))
    rows = _half_heights(_levels_in(points.join(packs, list(keys)), hop, value))
    at, size = (F.col("idx") - F.col("ctx_lo") + 1).cast("int"), F.size("ctx")
    near = F.lit(int(30 / hop))

    def steps(values: Column, limit: str) -> Column:
        """How many frames away the first value at most ``limit`` is; null if there is none."""
        # the outer transform holds the limit, which would else be worked out for each value
        place = lambda most: F.array_position(F.transform(values, lambda x: x <= most), F.lit(True))
        found = F.transform(F.array(limit), place)[0]
        return F.when(found > 0, found - 1)

    def back(n: Column) -> Column:
        return F.reverse(F.slice("ctx", F.greatest(F.lit(1), at - n), F.least(at, n + 1)))

    # most are found close by, and the rest of the track is searched only for the others
    up = F.coalesce(steps(back(near), "_up"), steps(back(size), "_up"))
    down = F.coalesce(steps(F.slice("ctx", at, near), "_down"), steps(F.slice("ctx", at, size), "_down"))
    rows = rows.withColumn("_j", F.col("idx") - up).withColumn("_k", F.col("idx") + down)
    return _edge_times(rows.drop("ctx", "ctx_lo"), hop)


def rank_features(
    points: DataFrame, keys: Sequence[str], hop: float, value: str = "smooth", bound: int | None = None
) -> DataFrame:
    """Relative time, rank by level, and time since the previous point in descending-level order."""
    keyed = points.withColumn("_neg", -F.col(value))
    order = ["_neg", "idx"]
    rows = number_rows(fit(keyed, keys, order, bound=bound), keys, order, "rank_energy")
    rows = unblock(shift(rows, keys, order, {"_prev": F.col("idx")}))
    span = F.greatest(F.lit(1e-6), F.col("n_frames") * F.lit(hop))
    return rows.select(
        "*",
        (F.col("idx") * F.lit(hop) / span).alias("rel_time"),
        F.coalesce((F.col("idx") - F.col("_prev")) * F.lit(hop), F.lit(0.0)).alias("gap_prev"),
    ).drop("_neg", "_prev")


def _spectrum(rate: float):
    """Arrow UDF for what has no built-in: the Hann-windowed spectrum of one short span of samples."""

    def spectrum(parts):
        import numpy as np
        import pandas as pd

        rows = []
        for part in parts:
            x = np.asarray(part, dtype=np.float64)
            mags = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) + 1e-12
            freqs = np.fft.rfftfreq(len(x), 1.0 / rate)
            rows.append((float(freqs @ mags / mags.sum()), float(np.exp(np.log(mags).mean()) / mags.mean())))
        return pd.DataFrame(rows, columns=["centroid", "flatness"])

    return F.pandas_udf(spectrum, "centroid double, flatness double", F.PandasUDFType.SCALAR)


def spectral_features(
    points: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    step: int,
    half: int,
    rate: float,
    min_samples: int = 512,
    value: str = "x",
) -> DataFrame:
    """Zero-crossing rate, spectral centroid and flatness of the samples ``half`` frames around a point.

    Only spans longer than ``min_samples`` are measured; others get 0.  ``samples`` has a dense
    ``idx`` per key, ``step`` samples per frame.
    """
    slim = points.select(*points.columns, F.col("idx").alias("_frame")).drop("idx")
    at = slim.withColumn("idx", F.col("_frame") * step)
    total = samples.groupBy(*keys).agg(F.count("*").alias("_total"))
    around = with_context(at.join(total, list(keys)), samples, keys, half * step, half * step, value)
    lo = F.greatest(F.lit(0), F.col("_frame") - half) * step
    hi = F.least(F.col("_total"), (F.col("_frame") + half) * step)
    cut_ = around.withColumn("_part", F.when(hi - lo > min_samples, _span(lo, hi))).drop("ctx", "ctx_lo", "_total", "idx")
    n = F.size("_part")
    mean = cut_.withColumn("_mean", _mean(F.col("_part")))
    signs = F.transform("_part", lambda x: F.signum(x - F.col("_mean")))
    crossings = F.size(
        F.filter(F.zip_with(F.slice(signs, 2, n - 1), F.slice(signs, 1, n - 1), lambda a, b: a != b), lambda c: c)
    )
    measured = mean.withColumn("zcr", F.when(F.col("_part").isNotNull(), crossings / (n - 1)).otherwise(0.0))
    spectrum = _spectrum(rate)
    long_ = measured.filter(F.col("_part").isNotNull()).withColumn("_s", spectrum("_part"))
    short = measured.filter(F.col("_part").isNull())
    keep = [c for c in slim.columns if c != "_frame"]
    base = [F.col("_frame").alias("idx"), *keep, "zcr"]
    return long_.select(*base, "_s.centroid", "_s.flatness").unionByName(
        short.select(*base, F.lit(0.0).alias("centroid"), F.lit(0.0).alias("flatness"))
    )


def formula_shape(points: DataFrame, frames: DataFrame, keys: Sequence[str], hop: float, value: str = "smooth") -> DataFrame:
    """The five shape values of the hand-made score; ``post4`` is the mean 1.5 to 4 s after."""
    rows = level_features(points, frames, keys, hop, value)
    return rows.withColumnRenamed("post2", "post4").select(
        *points.columns, "pre30", "post4", "signature", "recover", "peak"
    )


def landmarks(points: DataFrame, frames: DataFrame, keys: Sequence[str], half: int, value: str = "smooth") -> DataFrame:
    """Frame indices of five landmarks in ``[i - half, i + half)``; null when fewer than 5 frames."""
    rows = with_context(points, frames, keys, half, half, value)
    lo = F.greatest(F.lit(0), F.col("idx") - half)
    hi = F.least(F.col("n_frames"), F.col("idx") + half)
    rows = rows.withColumn("_lo", lo).withColumn("_w", F.when(hi - lo >= 5, _span(lo, hi)))
    n = F.size("_w")
    rows = rows.withColumn(
        "_d", F.zip_with(F.slice("_w", 2, n - 1), F.slice("_w", 1, n - 1), lambda b, a: b - a)
    ).withColumn("_med", _median(F.col("_w")))
    first = lambda arr, test: F.array_position(F.transform(arr, test), F.lit(True)) - 1
    top = F.array_max("_w")
    lifted = F.transform("_w", lambda x: F.greatest(x - F.col("_med"), F.lit(0.0)))
    weight = F.aggregate(lifted, F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(
        F.zip_with(F.sequence(F.lit(0), n - 1), lifted, lambda j, x: j * x), F.lit(0.0), lambda a, x: a + x
    )
    return rows.select(
        *points.columns,
        (F.col("_lo") + F.array_position("_w", top) - 1).alias("top_idx"),
        (F.col("_lo") + F.array_position("_d", F.array_max("_d")) - 1).alias("rise_idx"),
        (F.col("_lo") + F.array_position("_d", F.array_min("_d")) - 1).alias("fall_idx"),
        (F.col("_lo") + first(F.col("_w"), lambda x: x >= top - 3.0)).alias("onset_idx"),
        (F.col("_lo") + moment / F.greatest(weight, F.lit(1e-9))).alias("centre_idx"),
    )


def duration_status(tracks: DataFrame, duration: str, shortest: float = 3.0, reliable: float = 60.0) -> DataFrame:
    """Too-short tracks become rows with a reason instead of disappearing."""
    d = F.col(duration)
    reason = F.when(d < shortest, "too short").when(d < reliable, "under one minute").otherwise("ok")
    return tracks.withColumn("status", reason)


def candidate_table(
    frames: DataFrame,
    keys: Sequence[str],
    hop: float,
    min_gap: float = 8.0,
    smooth: int = 5,
    pct: float = 0.95,
    value: str = "level",
) -> DataFrame:
    """Every peak with its level, edge and rank features: the input of scoring and training.

    Written once: joins, folds and models measure and read the candidates several times.
    """
    smoothed, bound = smoothed_series(frames, keys, smooth, value)
    peaks = peaks_of(smoothed, keys, max(1, int(min_gap / hop)), pct, bound)
    series = unblock(smoothed).select(*keys, "idx", "smooth")
    rows = shape_features(peaks, series, keys, hop, bound=bound)
    return cut(rank_features(rows, keys, hop, bound=bound).withColumn("t", F.round(F.col("idx") * F.lit(hop), 2)))


def model_row(
    candidates: DataFrame,
    samples: DataFrame,
    segments: DataFrame,
    keys: Sequence[str],
    cues: Sequence[tuple[str, str, int]],
    step: int,
    half: int,
    rate: float,
    min_samples: int = 512,
    radius: float = 6.0,
) -> DataFrame:
    """The candidates of :func:`candidate_table` with all of ``FEATURES``: adds the three spectral ones and ``txt``,
    the strongest cue said within ``radius`` seconds."""
    rows = cut(spectral_features(candidates, samples, keys, step, half, rate, min_samples))
    told = best_cue(rows, segments, keys, cues, radius=radius).withColumnRenamed("cue", "txt")
    return told.drop("cue_tags")


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Mapping[str, float]) -> DataFrame:
    """Compare two computations of one table: rows missing on a side, largest error per column, verdict."""
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_in_b"))
    both = left.join(right, list(keys), "full_outer")
    stats = both.agg(
        F.count_if(F.col("_in_a").isNull()).alias("only_b"),
        F.count_if(F.col("_in_b").isNull()).alias("only_a"),
        *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(f"_e_{c}") for c in columns],
        *[F.count_if(F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull()).alias(f"_n_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_e_{c}").alias("max_error"),
                F.col(f"_n_{c}").alias("null_mismatches"),
                (F.coalesce(F.col(f"_e_{c}"), F.lit(0.0)) <= tol).alias("within"),
            )
            for c, tol in columns.items()
        ]
    )
    return stats.select("only_a", "only_b", F.inline(rows))

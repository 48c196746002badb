"""Alignment, detection and calibration reports.

Undefined ratios are null, never 0: a fold without output has no precision.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_nfkc
from tidemark.operators.joins import label_candidates, match_events, top_per_key
from tidemark.plans.blocks import fit, number_rows, quantiles, scan, unblock
from tidemark.plans.nearest import count_within, nearest, window_best

# Edges of the signed-error histogram and the absolute-error limits reported.
ERROR_BINS = [(-25, -15), (-15, -10), (-10, -5), (-5, 0), (0, 5), (5, 10), (10, 15), (15, 25)]
ERROR_LIMITS = [2, 5, 10, 15, 20]
SCORE_BINS = [(0.9, 1.01), (0.8, 0.9), (0.7, 0.8), (0.6, 0.7), (0.5, 0.6), (0.4, 0.5), (0.0, 0.4)]


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(F.lit(1e-9), p + r)


def pick_ranks(rows: DataFrame, keys: Sequence[str], value: str, tie: str, places: Mapping[str, float]) -> DataFrame:
    """Order statistics at 0-based place ``floor(n * q)`` per key."""
    order = [value, tie]
    ranked = unblock(number_rows(fit(rows.select(*keys, *order), keys, order), keys, order, "_rank"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    at = ranked.join(sizes, list(keys))
    return at.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rank") == F.floor(F.col("_n") * q), F.col(value))).alias(n) for n, q in places.items()]
    )


def alignment_report(matched: DataFrame, tie: str) -> DataFrame:
    """Hit rate, and mean, upper median, P90, mean absolute and largest shift of the matched rows."""
    hit = F.col("matched")
    one = matched.withColumn("_all", F.lit(1))
    base = one.groupBy("_all").agg(
        F.count("*").alias("ref_rows"),
        F.count_if(hit).alias("matched_rows"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.avg(F.when(hit, F.col("shift"))).alias("mean_shift"),
        F.avg(F.when(hit, F.abs("shift"))).alias("mean_abs"),
        F.max(F.when(hit, F.abs("shift"))).alias("max_abs"),
    )
    picks = pick_ranks(one.filter(hit), ["_all"], "shift", tie, {"median_shift": 0.5, "p90_shift": 0.9})
    rows = base.join(picks, "_all", "left").drop("_all")
    return rows.withColumn("hit_rate", share(F.col("matched_rows"), F.col("ref_rows")))


def text_compare_report(
    pairs: DataFrame, ours: str, theirs: str, reference: DataFrame | None = None, order: Sequence[str] = (), require: str = ".", keys: Sequence[str] = ()
) -> DataFrame:
    """Mean ratio of normalised lengths and share of identical lines (compatibility characters folded), one report
    for each of ``keys``.

    With ``reference`` a report is made only if its first row by ``order`` shows the pattern ``require`` in
    ``theirs``; otherwise it has no row.  Without pairs there is no row either.  Null keys are a key of their own.
    """
    a, b = normalize_nfkc(F.col(ours)), normalize_nfkc(F.col(theirs))
    rows = pairs.select(*keys, a.alias("_a"), b.alias("_b"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.avg(F.length("_a") / F.greatest(F.lit(1), F.length("_b"))).alias("length_ratio"),
        F.avg(F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0)).alias("same_share"),
    ).filter("pairs > 0")
    if reference is None:
        return out
    first = reference.groupBy(*keys).agg(F.min_by(theirs, F.struct(*order)).alias("_first")).filter(F.col("_first").rlike(require))
    named = first.select(F.lit(1).alias("_one"), *[F.col(k).alias(f"_key_{k}") for k in keys])
    same = F.col("_one_here") == F.col("_one")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return out.withColumn("_one_here", F.lit(1)).join(named, same, "left_semi").drop("_one_here")


def conversion_summary(rows: DataFrame) -> DataFrame:
    """Counts, bytes and time of a batch of conversions; lists of files stay rows (see ``conversion_issues``)."""
    done = F.col("ok") & ~F.col("skipped")
    out = rows.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("done"),
        F.count_if("skipped").alias("skipped"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(done, F.col("src_bytes"))), F.lit(0)).alias("src_bytes"),
        F.coalesce(F.sum(F.when(done, F.col("dst_bytes"))), F.lit(0)).alias("dst_bytes"),
        F.sum("elapsed").alias("elapsed"),
        F.count_if("resampled").alias("resampled"),
        F.count_if("capped").alias("capped"),
    )
    return out.withColumn("ratio", F.when(F.col("dst_bytes") > 0, F.col("src_bytes") / F.col("dst_bytes")).otherwise(0.0))


def conversion_issues(rows: DataFrame) -> DataFrame:
    """One row per file and issue: resampled, capped or failed."""
    issues = F.array(
        F.when(F.col("resampled"), F.lit("resampled")), F.when(F.col("capped"), F.lit("capped")), F.when(~F.col("ok"), F.lit("failed"))
    )
    return rows.select("src", F.explode(issues).alias("issue")).filter(F.col("issue").isNotNull())


def stage_report(rows: DataFrame, stage: str) -> DataFrame:
    """Speed per stage over rows that were not cached: media seconds and lines per second."""
    live = ~F.col("cached")
    spent = F.sum(F.when(live, F.col("sec")))
    return rows.groupBy(stage).agg(
        F.count("*").alias("files"),
        F.count_if("cached").alias("cached"),
        F.sum("dur").alias("duration"),
        share(F.sum(F.when(live, F.col("dur"))), spent).alias("speed"),
        share(F.sum(F.when(live, F.col("lines"))), spent).alias("lines_per_sec"),
    )


def fold_counts(hits: DataFrame, covered: DataFrame, folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Outputs, hits, truths, covered per fold, for every fold in ``folds``."""
    out = hits.groupBy(*by).agg(F.count("*").alias("outputs"), F.count_if("hit").alias("hits"))
    tru = covered.groupBy(*by).agg(F.count("*").alias("truths"), F.count_if("covered").alias("covered"))
    rows = folds.join(out, list(by), "left").join(tru, list(by), "left")
    return rows.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outputs", "hits", "truths", "covered")])


def precision_recall(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro (mean of folds, folds without output skipped) and micro (pooled) precision and recall."""
    rows = counts.withColumn("_p", share(F.col("hits"), F.col("outputs"))).withColumn(
        "_r", F.col("covered") / F.greatest(F.lit(1), F.col("truths"))
    )
    return rows.groupBy(*by).agg(
        F.avg("_p").alias("macro_precision"),
        F.avg("_r").alias("macro_recall"),
        share(F.sum("hits"), F.sum("outputs")).alias("micro_precision"),
        share(F.sum("covered"), F.sum("truths")).alias("micro_recall"),
        F.sum("outputs").alias("outputs"),
    )


def error_stats(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error and shares within 3 and 5 s over the hits."""
    within = lambda s: F.avg(F.when(F.col("dist") <= s, 1.0).otherwise(0.0))
    return hits.filter("hit").groupBy(*by).agg(
        F.count("*").alias("hits"), F.avg("dist").alias("mean_abs"), within(3).alias("within_3"), within(5).alias("within_5")
    )


def signed_error_report(errors: DataFrame, delta: str = "delta") -> DataFrame:
    """Mean, median and deviation of event minus truth, early/late counts and absolute limits."""
    one = errors.withColumn("_all", F.lit(1))
    d = F.col(delta)
    base = one.groupBy("_all").agg(
        F.count("*").alias("n"),
        F.avg(d).alias("mean_error"),
        F.stddev_pop(d).alias("std_error"),
        F.count_if(d > 0).alias("late"),
        F.count_if(d < 0).alias("early"),
        F.count_if(d == 0).alias("exact"),
        *[F.count_if(F.abs(d) <= s).alias(f"within_{s}") for s in ERROR_LIMITS],
    )
    return base.join(quantiles(one, ["_all"], delta, {"median_error": 0.5}), "_all").drop("_all")


def error_histogram(errors: DataFrame, delta: str = "delta", bins: Sequence[tuple[float, float]] = tuple(ERROR_BINS)) -> DataFrame:
    d, label = F.col(delta), None
    for lo, _ in bins:
        hit = F.lit(lo)
        label = F.when(d >= lo, hit) if label is None else F.when(d >= lo, hit).otherwise(label)
    inside = errors.filter((d >= bins[0][0]) & (d < bins[-1][1]))
    return inside.groupBy(label.alias("bin_from")).agg(F.count("*").alias("n"))


def error_by(errors: DataFrame, by: Sequence[str], delta: str = "delta") -> DataFrame:
    return errors.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(delta).alias("mean_error"), F.avg(F.abs(delta)).alias("mean_abs")
    )


def correlate(rows: DataFrame, features: Sequence[str], error: str, top: int = 6) -> DataFrame:
    """Features most correlated with the signed and the absolute error."""
    stats = rows.agg(
        *[F.corr(f, F.abs(error)).alias(f"_a_{f}") for f in features], *[F.corr(f, error).alias(f"_s_{f}") for f in features]
    )
    table = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"_a_{f}").alias("with_abs"), F.col(f"_s_{f}").alias("with_signed")) for f in features]
    )
    return stats.select(F.inline(table)).orderBy(F.abs("with_abs").desc_nulls_last(), "feature").limit(top)


def score_bin(score: Column, bins: Sequence[tuple[float, float]] = tuple(SCORE_BINS)) -> Column:
    label = F.lit(None).cast("double")
    for lo, hi in bins:
        label = F.when((score >= lo) & (score < hi), F.lit(float(lo))).otherwise(label)
    return label


def bucket_errors(hits: DataFrame, bucket: Column, name: str) -> DataFrame:
    """Error statistics of the hits per bucket (score bin, band or rank)."""
    rows = hits.filter("hit").withColumn(name, bucket).filter(F.col(name).isNotNull())
    within = lambda s: F.avg(F.when(F.col("dist") <= s, 1.0).otherwise(0.0))
    stats = rows.groupBy(name).agg(
        F.count("*").alias("hits"), F.avg("dist").alias("mean_abs"), *[within(s).alias(f"within_{s}") for s in (2, 3, 5)]
    )
    return stats.join(quantiles(rows, [name], "dist", {"median_abs": 0.5}), name)


def calibration_table(rows: DataFrame, score: str, hit: str, width: float = 0.1) -> DataFrame:
    """Per score bin: rows, hits, hit rate and mean score."""
    cell = F.least(F.floor(F.col(score) / F.lit(width)), F.lit(int(round(1 / width)) - 1)).cast("long")
    return rows.groupBy(cell.alias("bin")).agg(
        F.count("*").alias("n"),
        F.count_if(hit).alias("hits"),
        F.avg(F.when(F.col(hit), 1.0).otherwise(0.0)).alias("rate"),
        F.avg(score).alias("mean_score"),
    )


def brier(rows: DataFrame, scores: Sequence[str], hit: str) -> DataFrame:
    y = F.when(F.col(hit), 1.0).otherwise(0.0)
    return rows.agg(*[F.avg(F.pow(F.col(s) - y, 2)).alias(f"brier_{s}") for s in scores])


def auc(rows: DataFrame, keys: Sequence[str], score: str, hit: str) -> DataFrame:
    """Tie-aware AUC per key; null with one class only.

    Equal scores are counted together before anything is ordered, so ties and hot keys shrink first.
    """
    ties = rows.groupBy(*keys, score).agg(
        F.count_if(F.col(hit)).alias("_pos"), F.count_if(~F.col(hit)).alias("_neg")
    )
    ran = scan(fit(ties, keys, [score]), keys, [score], {"_below": ("sum", F.col("_neg"))}, inclusive=True)
    won = F.col("_pos") * (F.col("_below") - F.col("_neg") / 2)
    total = unblock(ran).groupBy(*keys).agg(F.sum(won).alias("_won"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    pairs = F.col("positives") * F.col("negatives")
    return total.select(*keys, "positives", "negatives", share(F.col("_won"), pairs).alias("auc"))


def peaks_near_truth(
    candidates: DataFrame, truth: DataFrame, keys: Sequence[str], ident: str, score: str, radius: float = 15.0
) -> DataFrame:
    """Per truth: number of candidates within ``radius``, the nearest one, and the best-scored one."""
    rows = count_within(truth, candidates, keys, "t", "t", radius, "peaks")
    rows = nearest(rows, candidates, keys, "t", "t", {"nearest_no": ident}, ident).drop("delta")
    rows = window_best(rows, candidates, keys, "t", "t", radius, F.col(score), F.col("t"), {"best_no": F.col(ident)})
    return rows.drop("best_score")


def standardised_difference(
    candidates: DataFrame, truth: DataFrame, keys: Sequence[str], ident: str, features: Sequence[str], radius: float = 15.0
) -> DataFrame:
    """Standardised mean difference between the candidate nearest to a truth and the others around it.

    A candidate counts once per truth in reach; instead of listing those pairs its moments are weighted
    by that number, and the nearest ones are subtracted.
    """
    around = count_within(candidates, truth, keys, "t", "t", radius, "_w")
    near = nearest(truth.select(*keys, "t"), candidates, keys, "t", "t", {f: f for f in features}, ident)
    near = near.filter(F.col("dist") <= radius)

    def moments(rows: DataFrame, weight: Column, tag: str) -> DataFrame:
        sums = [F.sum(weight).cast("double").alias(f"_n{tag}")]
        for f in features:
            sums += [F.sum(weight * F.col(f)).alias(f"_s{tag}_{f}"), F.sum(weight * F.col(f) * F.col(f)).alias(f"_q{tag}_{f}")]
        return rows.agg(*sums)

    sides = moments(around, F.col("_w"), "a").unionByName(moments(near, F.lit(1), "p"), allowMissingColumns=True)
    both = sides.agg(*[F.max(c).alias(c) for c in sides.columns])

    def entry(f: str) -> Column:
        n1, n2 = F.col("_np"), F.col("_na") - F.col("_np")
        m1, m2 = F.col(f"_sp_{f}") / n1, (F.col(f"_sa_{f}") - F.col(f"_sp_{f}")) / n2
        v1 = F.col(f"_qp_{f}") / n1 - m1 * m1
        v2 = (F.col(f"_qa_{f}") - F.col(f"_qp_{f}")) / n2 - m2 * m2
        d = (m1 - m2) / F.greatest(F.lit(1e-9), F.sqrt((v1 + v2) / 2))
        return F.struct(F.lit(f).alias("feature"), m1.alias("nearest_mean"), m2.alias("other_mean"), d.alias("difference"))

    return both.select(F.inline(F.array(*[entry(f) for f in features])))


def nearest_is_best_rate(per_truth: DataFrame, work: str) -> DataFrame:
    """Among truths with two or more candidates around: how often the nearest is the best; per work and in all."""
    rows = per_truth.filter(F.col("peaks") >= 2)
    return rows.rollup(work).agg(
        F.grouping(work).cast("int").alias("is_total"),
        F.count("*").alias("truths"),
        F.count_if(F.col("nearest_no") == F.col("best_no")).alias("wins"),
    )


def sweep(
    rows: DataFrame, grid: Sequence[float], name: str, run: Callable[[DataFrame, list[str]], DataFrame], keys: Sequence[str]
) -> DataFrame:
    """Run a selection for every setting at once: the setting becomes part of every key."""
    spread = rows.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return run(spread, [name, *keys])


def threshold_sweep(
    candidates: DataFrame,
    truth: DataFrame,
    labelled: DataFrame,
    keys: Sequence[str],
    work: str,
    grid: Sequence[float],
    select: Callable[[DataFrame, list[str]], DataFrame],
    tolerance: float = 20.0,
) -> DataFrame:
    """Precision, recall, F1, outputs per labelled track, share within 5 s and empty tracks per threshold."""
    name = "threshold"
    levels = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias(name)
    picked = sweep(
        candidates, grid, name, lambda rows, ks: select(rows.filter(F.col("score") >= F.col(name)), ks), keys
    )
    truths, tracks = truth.select("*", levels), labelled.select(*keys, levels)
    hits, covered = match_events(picked, truths, tracks, [name, *keys], tolerance)
    folds = truths.select(name, work).distinct()
    report = precision_recall(fold_counts(hits, covered, folds, [name, work]), [name])
    errors = error_stats(hits, [name]).select(name, "within_5")
    used = hits.select(name, *keys).distinct().groupBy(name).agg(F.count("*").alias("_used"))
    total = tracks.groupBy(name).agg(F.count("*").alias("_tracks"))
    out = report.join(total, name).join(used, name, "left").join(errors, name, "left")
    return out.select(
        name,
        F.col("macro_precision").alias("precision"),
        F.col("macro_recall").alias("recall"),
        f1(F.col("macro_precision"), F.col("macro_recall")).alias("f1"),
        (F.col("outputs") / F.col("_tracks")).alias("per_track"),
        "within_5",
        (F.col("_tracks") - F.coalesce("_used", F.lit(0))).alias("empty_tracks"),
    )


def distinct_steps(rows: DataFrame, score: str, hit: str) -> DataFrame:
    """Distinct calibrated values (4 decimals) with rows and hit rate: the only thresholds worth trying."""
    return rows.groupBy(F.bround(score, 4).alias("step")).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col(hit), 1.0).otherwise(0.0)).alias("rate")
    )


def prefix_optimum(rows: DataFrame, truths: DataFrame, work: str, score: str, hit: str, tie: str) -> DataFrame:
    """Best F1 over all score-ordered prefixes; recall counts hit candidates.

    Adding a row changes only its own work's precision, so the mean over works is a running sum of
    changes: one scan per work, then one over all rows.
    """
    goal = truths.groupBy(work).agg(F.count("*").alias("_goal"))
    works = goal.count()
    slim = rows.join(goal, work).select(work, score, hit, tie, "_goal").withColumn("_neg", -F.col(score))
    order = ["_neg", tie]
    mine = scan(
        fit(slim, [work], order),
        [work],
        order,
        {"_n": ("sum", F.lit(1).cast("long")), "_tp": ("sum", F.when(F.col(hit), 1).otherwise(0).cast("long"))},
    )
    h = F.when(F.col(hit), 1).otherwise(0)
    now = F.col("_tp") / F.col("_n")
    was = F.when(F.col("_n") > 1, (F.col("_tp") - h) / (F.col("_n") - 1)).otherwise(0.0)
    steps = unblock(mine).select(
        F.lit(1).alias("_all"), *order, score, (now - was).alias("_dp"), F.when(F.col("_n") == 1, 1).otherwise(0).cast("long").alias("_dw"),
        (h / F.greatest(F.lit(1), F.col("_goal"))).alias("_dr"),
    )
    ran = scan(
        fit(steps, ["_all"], order),
        ["_all"],
        order,
        {"_k": ("sum", F.lit(1).cast("long")), "_p": ("sum", F.col("_dp")), "_w": ("sum", F.col("_dw")), "_r": ("sum", F.col("_dr"))},
    )
    p, r = F.col("_p") / F.col("_w"), F.col("_r") / works
    scored = unblock(ran).select(
        F.col("_k").alias("k"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), F.col(score).alias("least_score")
    )
    return scored.agg(F.max_by(F.struct("*"), F.struct(F.round("f1", 9), -F.col("k"))).alias("_b")).select("_b.*")


def truth_counts(truth: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    per = truth.groupBy(*keys).agg(F.count("*").alias("_n"))
    return labelled.join(per, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("truths"))


def truth_count_distribution(truth: DataFrame, labelled: DataFrame, keys: Sequence[str], top: int = 3) -> DataFrame:
    """Tracks by number of truths, their share, and the precision a perfect output of ``top`` reaches."""
    sizes = truth_counts(truth, labelled, keys).groupBy("truths").agg(F.count("*").alias("tracks"))
    total = F.sum("tracks").over(Window.partitionBy())  # over one row per distinct count
    return sizes.select(
        "truths", "tracks", (F.col("tracks") / total).alias("track_share"),
        (F.least(F.lit(top), F.col("truths")) / F.lit(float(top))).alias("ceiling"),
    )


def pool_ceiling(hit_events: DataFrame, tracks: DataFrame, keys: Sequence[str], top: int = 3) -> DataFrame:
    """Tracks by number of distinct hit events available, and how many a perfect ranking could output."""
    per = hit_events.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = tracks.join(per, list(keys), "left").select(F.coalesce("_n", F.lit(0)).alias("hit_events"))
    return rows.groupBy("hit_events").agg(
        F.count("*").alias("tracks"), F.sum(F.least(F.lit(top), F.col("hit_events"))).alias("reachable")
    )


def pool_size_stats(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = candidates.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_all", F.lit(1))
    base = sizes.groupBy("_all").agg(
        F.count("*").alias("tracks"), F.avg("n").alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n")
    )
    return base.join(quantiles(sizes, ["_all"], "n", {"median_n": 0.5}), "_all").drop("_all")


def pair_profile(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per pair class: time and score differences, who comes first, and feature means of both members."""
    rows = pairs.withColumn("dt", F.col("t2") - F.col("t1")).withColumn("ds", F.abs(F.col("score1") - F.col("score2")))
    ratio = F.greatest("score1", "score2") / F.greatest(F.lit(1e-6), F.least("score1", "score2"))
    stats = rows.groupBy("kind").agg(
        F.count("*").alias("pairs"),
        F.avg("dt").alias("mean_dt"),
        F.avg("ds").alias("mean_gap"),
        F.avg(ratio).alias("mean_ratio"),
        F.count_if(F.col("score1") > F.col("score2")).alias("first_higher"),
        *[F.avg(f"{f}{i}").alias(f"mean_{f}{i}") for f in features for i in (1, 2)],
    )
    return stats.join(quantiles(rows, ["kind"], "dt", {"median_dt": 0.5}), "kind")


def class_counts(rows: DataFrame, by: str, hit: str, keys: Sequence[str], work: str) -> DataFrame:
    """Rows, positives, tracks and works per label source."""
    per_track = rows.groupBy(by, *keys).agg(F.count("*").alias("_n"), F.count_if(hit).alias("_p"))
    per_work = per_track.groupBy(by, work).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"), F.count("*").alias("_t"))
    return per_work.groupBy(by).agg(
        F.sum("_n").alias("n"), F.sum("_p").alias("positives"), F.sum("_t").alias("tracks"), F.count("*").alias("works")
    )


def model_overlap(rows: DataFrame, keys: Sequence[str], work: str, ident: str, a: str, b: str, top: int = 3) -> DataFrame:
    """Per work: shared share of the two models' top picks of each track."""
    first = top_per_key(rows, keys, [F.col(a).desc(), F.col(ident)], top, "_r").select(*keys, ident, F.lit(1).alias("_a"))
    second = top_per_key(rows, keys, [F.col(b).desc(), F.col(ident)], top, "_r").select(*keys, ident, F.lit(1).alias("_b"))
    both = first.join(second, [*keys, ident], "full_outer")
    return both.groupBy(work).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count("*").alias("union_size")
    ).withColumn("overlap", F.col("shared") / F.col("union_size"))


def correlation_matrix(rows: DataFrame, features: Sequence[str], at_least: float = 0.0) -> DataFrame:
    """Pearson correlation of every feature pair in one aggregate."""
    pairs = [(x, y) for i, x in enumerate(features) for y in features[i + 1 :]]
    stats = rows.agg(*[F.corr(x, y).alias(f"_{x}_{y}") for x, y in pairs])
    table = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{x}_{y}").alias("r")) for x, y in pairs])
    return stats.select(F.inline(table)).filter(F.abs("r") >= at_least)


def variance_inflation(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """VIF per feature from the inverse correlation matrix (features x features on the driver); infinite when singular."""
    import numpy as np

    k = len(features)
    m = np.eye(k)
    for row in correlation_matrix(rows, features).collect():
        i, j = features.index(row["a"]), features.index(row["b"])
        m[i, j] = m[j, i] = row["r"]
    if np.linalg.matrix_rank(m, tol=1e-9) < k:
        _, _, vt = np.linalg.svd(m)
        free = np.abs(vt[np.linalg.matrix_rank(m, tol=1e-9) :]).max(axis=0) > 1e-6
        inverse = np.linalg.pinv(m).diagonal()
        values = [float("inf") if free[i] else float(inverse[i]) for i in range(k)]
    else:
        values = [float(v) for v in np.linalg.inv(m).diagonal()]
    return rows.sparkSession.createDataFrame(list(zip(features, values)), "feature string, vif double")


def paired_fold_test(a: DataFrame, b: DataFrame, fold: str, value: str) -> DataFrame:
    """Fold-wise difference of two methods: mean, and folds won, lost and tied."""
    d = F.col("_a") - F.col("_b")
    rows = a.select(fold, F.col(value).alias("_a")).join(b.select(fold, F.col(value).alias("_b")), fold).filter(d.isNotNull())
    return rows.agg(
        F.count("*").alias("folds"),
        F.avg(d).alias("mean_difference"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d < 0).alias("losses"),
        F.count_if(d == 0).alias("ties"),
    )


def labelled_hits(candidates: DataFrame, truth: DataFrame, labelled: DataFrame, keys: Sequence[str], tolerance: float = 20.0) -> DataFrame:
    """Candidates of labelled tracks with ``hit`` and ``dist``."""
    ours = candidates.join(labelled.select(*keys).distinct(), list(keys), "left_semi")
    return label_candidates(ours, truth, keys, tolerance)


def parse_report(tracks: DataFrame, truth: DataFrame, files: DataFrame, keys: Sequence[str], work: str) -> DataFrame:
    """Per work and in total: labelled tracks, tracks with a file, tracks without truth, points, files."""
    per = truth_counts(truth, tracks, keys)
    found = files.groupBy(*keys).agg(F.count("*").alias("_files"))
    rows = per.join(found, list(keys), "left")
    return rows.rollup(work).agg(
        F.grouping(work).cast("int").alias("is_total"),
        F.count("*").alias("tracks"),
        F.count_if(F.col("_files").isNotNull()).alias("matched"),
        F.count_if(F.col("truths") == 0).alias("zero_tracks"),
        F.sum("truths").alias("points"),
        F.coalesce(F.sum("_files"), F.lit(0)).alias("files"),
    )

"""Reports over alignments, candidates, truths and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, r6, show, sql
from tidemark.catalog.events import E1, PAIRS, events, pairs, spaced_sql
from tidemark.catalog.events import fold_sql
from tidemark.catalog.joins import DATED, MATCH, OVERRIDE, dated, matched, overridden
from tidemark.catalog.signal import KEYS
from tidemark.catalog.text import CONVERSIONS, DIST, FLAGS, conversions
from tidemark.functions.scores import BANDS_PROBABILITY, band, conversion_flags
from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators import joins as jn
from tidemark.operators import metrics as mt
from tidemark.plans.folds import select_spaced

V3 = "v_cand v_truth v_labelled"


def cand(spark, base):
    return fx.candidates(spark, base)


def truth(spark, base):
    return fx.truth(spark, base)


def labelled(spark, base):
    return fx.labelled(spark, base)


def hits(spark, base):
    return mt.labelled_hits(cand(spark, base), truth(spark, base), labelled(spark, base), KEYS)


HITS = {
    "ev": MATCH["ev"],
    "hd": """SELECT e.*, d.dist, coalesce(d.dist <= 20, false) AS hit, d.delta FROM ev e LEFT JOIN (
      SELECT cand_no, min(abs(e.t - g.t)) AS dist, arg_min(e.t - g.t, (abs(e.t - g.t), g.t)) AS delta
      FROM ev e JOIN v_truth g USING (track_id) GROUP BY 1) d USING (cand_no)""",
}


def _a1(spark, base):
    out = mt.alignment_report(matched(spark, base), "ref_no")
    return show(out, *out.columns)


A1 = sql(
    "",
    """SELECT count(*) AS ref_rows, count(*) FILTER (m) AS matched_rows, min(t) AS first_t, max(t) AS last_t,
      round(avg(shift) FILTER (m), 6) + 0.0 AS mean_shift, round(avg(abs(shift)) FILTER (m), 6) AS mean_abs, max(abs(shift)) FILTER (m) AS max_abs,
      max(shift) FILTER (m AND rk = n // 2) AS median_shift, max(shift) FILTER (m AND rk = floor(n * 9e-1)) AS p90_shift,
      round(count(*) FILTER (m) / count(*)::DOUBLE, 6) AS hit_rate
    FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY shift, ref_no) - 1 AS rk, count(*) OVER (PARTITION BY m) AS n
      FROM (SELECT r.t, r.ref_no, shift, coalesce(abs(shift) <= 3, false) AS m FROM rf r LEFT JOIN nr USING (ref_no)))""",
    **DATED,
)


def _a2(spark, base):
    rows = matched(spark, base).filter("matched").withColumn("other", F.concat("own_text", F.lit("-Ａ①"), "ref_text"))
    out = mt.text_compare_report(rows, "other", "ref_text", dated(spark, base)[0], ["t", "ref_no"], "[A-Z]")
    return show(out, *out.columns)


def _reports(spark, base, asked):
    """Every second reference text begins with a sign; the tracks whose first one is as asked get a report."""
    ref = dated(spark, base)[0].withColumn("ref_text", F.when(F.col("ref_no") % 2 == 0, F.col("ref_text")).otherwise("1-none"))
    rows = matched(spark, base).filter("matched")
    return mt.text_compare_report(rows, "own_text", "ref_text", ref, ["t", "ref_no"], asked, ["track_id"]).select("track_id", "pairs")


def _a2_by_track(spark, base):
    return _reports(spark, base, "^1-none")


def _a2_gated(spark, base):
    """The tracks that the other query leaves out."""
    return _reports(spark, base, "^(?!1-none)")


A2 = sql(
    "",
    r"""SELECT count(*) AS pairs, round(avg(length(a) / greatest(1, length(b))::DOUBLE), 6) AS length_ratio, round(avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END), 6) AS same_share
    FROM (SELECT regexp_replace(own_text || '-A1' || ref_text, '[\s\-]+', '', 'g') AS a, regexp_replace(ref_text, '[\s\-]+', '', 'g') AS b
      FROM rf JOIN nr USING (ref_no) WHERE abs(shift) <= 3)""",
    **DATED,
)
def _reports_sql(rest):
    return sql(
        "",
        f"""SELECT track_id, count(*) AS pairs FROM rf JOIN nr USING (ref_no) WHERE abs(shift) <= 3
          AND (SELECT arg_min(f.ref_no, (f.t, f.ref_no)) % 2 FROM rf f WHERE f.track_id = rf.track_id) = {rest} GROUP BY 1""",
        **DATED,
    )


A2_BY_TRACK, A2_GATED = _reports_sql(1), _reports_sql(0)


def _a3(spark, base):
    out = mt.conversion_summary(conversion_flags(conversions(spark, base)))
    return show(out.withColumn("elapsed", F.round("elapsed", 3)), *out.columns)


A3 = sql(
    "",
    """SELECT count(*) AS total, count(*) FILTER (ok AND NOT skipped) AS done, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT ok) AS failed,
      sum(src_bytes) FILTER (ok AND NOT skipped)::BIGINT AS src_bytes, sum(dst_bytes) FILTER (ok AND NOT skipped)::BIGINT AS dst_bytes,
      round(sum(elapsed), 3) AS elapsed, count(*) FILTER (note LIKE 'resampled%') AS resampled, count(*) FILTER (note LIKE 'capped%') AS capped,
      round(sum(src_bytes) FILTER (ok AND NOT skipped) / (sum(dst_bytes) FILTER (ok AND NOT skipped))::DOUBLE, 6) AS ratio FROM fl""",
    cv=CONVERSIONS,
    fl=FLAGS,
)


def _a3_issues(spark, base):
    return mt.conversion_issues(conversion_flags(conversions(spark, base)))


def _a4(spark, base):
    rows = fx.table(spark, base, "lineitem").select(
        F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("dur"), (F.col("l_linenumber") * 1.0).alias("sec"),
        F.col("l_partkey").alias("lines"), (F.col("l_linestatus") == "F").alias("cached"),
    )
    out = mt.stage_report(rows, "stage")
    return show(out, *out.columns)


A4 = """SELECT l_returnflag AS stage, count(*) AS files, count(*) FILTER (c) AS cached, sum(l_quantity) AS duration,
    round(sum(l_quantity) FILTER (NOT c) / sum(l_linenumber) FILTER (NOT c), 6) AS speed,
    round(sum(l_partkey) FILTER (NOT c)::DOUBLE / sum(l_linenumber) FILTER (NOT c), 6) AS lines_per_sec
    FROM (SELECT *, l_linestatus = 'F' AS c FROM lineitem) GROUP BY 1"""


def detection(spark, base):
    return jn.match_events(events(spark, base), truth(spark, base), labelled(spark, base), KEYS)


def _a5(spark, base):
    h, c = detection(spark, base)
    counts = mt.fold_counts(h, c, labelled(spark, base).select("work_id").distinct(), ["work_id"])
    out = mt.precision_recall(counts)
    return show(out, *out.columns)


DETECTION = {
    **E1,
    "lx": "SELECT * FROM ax SEMI JOIN v_labelled USING (track_id)",
    "lg": MATCH["gt"],
    "xh": """SELECT x.*, (SELECT min(abs(g.t - x.t)) FROM lg g WHERE g.track_id = x.track_id) AS dist FROM lx x""",
    "gc": """SELECT g.*, coalesce((SELECT min(abs(g.t - x.t)) FROM lx x WHERE x.track_id = g.track_id) <= 20, false) AS covered FROM lg g""",
    "fo": """SELECT work_id, coalesce(o, 0) AS o, coalesce(h, 0) AS h, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM (SELECT DISTINCT work_id FROM v_labelled)
      LEFT JOIN (SELECT work_id, count(*) AS o, count(*) FILTER (dist <= 20) AS h FROM xh GROUP BY 1) USING (work_id)
      LEFT JOIN (SELECT work_id, count(*) AS n, count(*) FILTER (covered) AS c FROM gc GROUP BY 1) USING (work_id)""",
}
A5 = sql(
    V3,
    """SELECT round(avg(CASE WHEN o > 0 THEN h / o::DOUBLE END), 6) AS macro_precision, round(avg(c / greatest(1, n)::DOUBLE), 6) AS macro_recall,
      round(sum(h) / sum(o)::DOUBLE, 6) AS micro_precision, round(sum(c) / sum(n)::DOUBLE, 6) AS micro_recall, sum(o)::BIGINT AS outputs FROM fo""",
    **DETECTION,
)


def _a6(spark, base):
    h, _ = detection(spark, base)
    out = mt.error_stats(h)
    return show(out, *out.columns)


A6 = sql(
    V3,
    """SELECT count(*) AS hits, round(avg(dist), 6) AS mean_abs, round(avg(CASE WHEN dist <= 3 THEN 1e0 ELSE 0e0 END), 6) AS within_3,
    round(avg(CASE WHEN dist <= 5 THEN 1e0 ELSE 0e0 END), 6) AS within_5 FROM xh WHERE dist <= 20""",
    **DETECTION,
)


def errors(spark, base):
    from tidemark.plans.nearest import nearest

    rows = jn.labelled_only(cand(spark, base), labelled(spark, base), KEYS)
    return nearest(rows, truth(spark, base), KEYS, "t", "t", {}).filter("dist <= 20")


def _a7(spark, base):
    out = mt.signed_error_report(errors(spark, base))
    return show(out, *out.columns)


def err_sql(select):
    return sql(V3, f"SELECT {select} FROM hd WHERE hit", **HITS)


A7 = err_sql(
    """count(*) AS n, round(avg(delta), 6) AS mean_error, round(stddev_pop(delta), 6) AS std_error, count(*) FILTER (delta > 0) AS late,
    count(*) FILTER (delta < 0) AS early, count(*) FILTER (delta = 0) AS exact, """
    + ", ".join(f"count(*) FILTER (abs(delta) <= {s}) AS within_{s}" for s in mt.ERROR_LIMITS)
    + ", round(median(delta), 6) AS median_error"
)


def _a7_hist(spark, base):
    return mt.error_histogram(errors(spark, base)).select(F.col("bin_from").cast("long").alias("bin_from"), "n")


A7_HIST = sql(
    V3,
    """SELECT lo::BIGINT AS bin_from, count(*) AS n FROM hd JOIN (VALUES """
    + ", ".join(f"({a}, {b})" for a, b in mt.ERROR_BINS)
    + """) v(lo, up) ON delta >= lo AND delta < up WHERE hit GROUP BY 1""",
    **HITS,
)


def _a7_work(spark, base):
    out = mt.error_by(errors(spark, base), ["work_id"])
    return show(out, *out.columns)


FEATS = ["score", "peak", "ref_score", "t"]


def _a8(spark, base):
    out = mt.correlate(errors(spark, base), FEATS, "delta", 3)
    return show(out, *out.columns)


A8 = sql(
    V3,
    "SELECT feature, round(with_abs, 6) AS with_abs, round(with_signed, 6) AS with_signed FROM (SELECT unnest(["
    + ", ".join(f"{{'feature': '{f}', 'with_abs': a_{f}, 'with_signed': s_{f}}}" for f in FEATS)
    + "], recursive := true) FROM (SELECT "
    + ", ".join(f"corr({f}, abs(delta)) AS a_{f}, corr({f}, delta) AS s_{f}" for f in FEATS)
    + " FROM hd WHERE hit)) ORDER BY abs(with_abs) DESC, feature LIMIT 3",
    **HITS,
)


def _a9_score(spark, base):
    out = mt.bucket_errors(hits(spark, base), mt.score_bin(F.col("ref_score")), "bin_from")
    return show(out, *out.columns)


_BUCKET = """count(*) AS hits, round(avg(dist), 6) AS mean_abs, round(median(dist), 6) AS median_abs,
    round(avg(CASE WHEN dist <= 2 THEN 1e0 ELSE 0e0 END), 6) AS within_2, round(avg(CASE WHEN dist <= 3 THEN 1e0 ELSE 0e0 END), 6) AS within_3,
    round(avg(CASE WHEN dist <= 5 THEN 1e0 ELSE 0e0 END), 6) AS within_5"""
A9_SCORE = sql(
    V3,
    f"""SELECT lo::DOUBLE AS bin_from, {_BUCKET} FROM hd JOIN (VALUES (0.9, 1.01), (0.8, 0.9), (0.7, 0.8), (0.6, 0.7), (0.5, 0.6), (0.4, 0.5), (0.0, 0.4))
    v(lo, up) ON ref_score >= lo::DOUBLE AND ref_score < up::DOUBLE WHERE hit GROUP BY 1""",
    **HITS,
)


def _a9_band(spark, base):
    out = mt.bucket_errors(hits(spark, base), band(F.col("ref_score"), BANDS_PROBABILITY), "band")
    return show(out, *out.columns)


def _a9_rank(spark, base):
    h, _ = detection(spark, base)
    out = mt.bucket_errors(h, F.col("rank").cast("long"), "nth")
    return show(out, *out.columns)


def _a10(spark, base):
    out = mt.calibration_table(hits(spark, base), "ref_score", "hit")
    return show(out, *out.columns)


def _a11(spark, base):
    out = mt.brier(hits(spark, base), ["score", "ref_score"], "hit")
    return show(out, *out.columns)


def _a12(spark, base):
    out = mt.auc(hits(spark, base), ["work_id"], "score", "hit")
    return show(out, *out.columns)


A12 = sql(
    V3,
    """SELECT work_id, p AS positives, n AS negatives, CASE WHEN p * n > 0 THEN round((w - p * (p + 1) / 2e0) / (p * n), 6) END AS auc FROM (
      SELECT work_id, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS n, sum(avg_rank) FILTER (hit) AS w FROM (
        SELECT *, rank() OVER (PARTITION BY work_id ORDER BY score) + (count(*) OVER (PARTITION BY work_id, score) - 1) / 2e0 AS avg_rank FROM hd)
      GROUP BY 1)""",
    **HITS,
)


def _a13(spark, base):
    rows = jn.labelled_only(cand(spark, base), labelled(spark, base), KEYS)
    g = jn.labelled_only(truth(spark, base), labelled(spark, base), KEYS)
    out = mt.standardised_difference(rows, g, KEYS, "cand_no", ["score", "ref_score"])
    return show(out, *out.columns)


NEAR15 = {
    "ev": MATCH["ev"],
    "gt": MATCH["gt"],
    "pw": """SELECT g.work_id, g.truth_no, e.cand_no, e.score, e.ref_score,
      row_number() OVER (PARTITION BY g.truth_no ORDER BY abs(e.t - g.t), e.t, e.cand_no) AS near,
      row_number() OVER (PARTITION BY g.truth_no ORDER BY e.score DESC, e.t) AS best, count(*) OVER (PARTITION BY g.truth_no) AS peaks
      FROM gt g JOIN ev e USING (track_id) WHERE abs(e.t - g.t) <= 15""",
}
A13 = sql(
    V3,
    " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(avg({f}) FILTER (near = 1), 6) AS nearest_mean, round(avg({f}) FILTER (near > 1), 6) AS other_mean,
      round((avg({f}) FILTER (near = 1) - avg({f}) FILTER (near > 1)) / sqrt((var_pop({f}) FILTER (near = 1) + var_pop({f}) FILTER (near > 1)) / 2), 6)
      AS difference FROM pw"""
        for f in ("score", "ref_score")
    ),
    **NEAR15,
)


def _a14(spark, base):
    rows = jn.labelled_only(cand(spark, base), labelled(spark, base), KEYS)
    g = jn.labelled_only(truth(spark, base), labelled(spark, base), KEYS)
    return mt.nearest_is_best_rate(mt.peaks_near_truth(rows, g, KEYS, "cand_no", "score"), "work_id")


A14 = sql(
    V3,
    """SELECT work_id, grouping(work_id)::INTEGER AS is_total, count(*) AS truths, count(*) FILTER (best = 1) AS wins
    FROM pw WHERE near = 1 AND peaks >= 2 GROUP BY ROLLUP (work_id)""",
    **NEAR15,
)

GRID = [0.0, 0.2, 0.4, 0.6]


def _a15(spark, base):
    out = mt.threshold_sweep(
        cand(spark, base), truth(spark, base), labelled(spark, base), KEYS, "work_id", GRID,
        lambda rows, keys: ev.merge_candidates(rows, keys, "cand_no"),
    )
    return show(out, *out.columns)


def _a15_part(th, i):
    d = fold_sql(f"p{i}", f"ps{i}", "rn <= 4")
    return {
        f"ps{i}": f"SELECT * FROM v_cand WHERE score >= {th}::DOUBLE",
        **d,
        f"q{i}": f"SELECT {th}::DOUBLE AS threshold, * FROM p{i}x SEMI JOIN v_labelled USING (track_id)",
    }


_A15 = {}
for _i, _th in enumerate(GRID):
    _A15.update(_a15_part(_th, _i))
A15 = sql(
    V3,
    """SELECT threshold, round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / greatest(1e-9, p + r), 6) AS f1,
      round(outs / nt::DOUBLE, 6) AS per_track, round(w5, 6) AS within_5, nt - used AS empty_tracks FROM (
      SELECT threshold, avg(CASE WHEN o > 0 THEN h / o::DOUBLE END) AS p, avg(c / greatest(1, n)::DOUBLE) AS r, sum(o)::BIGINT AS outs,
        sum(h5) / nullif(sum(h), 0)::DOUBLE AS w5, (SELECT count(*) FROM v_labelled) AS nt FROM fo GROUP BY 1) JOIN us USING (threshold)""",
    **_A15,
    aq=" UNION ALL ".join(f"SELECT * FROM q{i}" for i in range(len(GRID))),
    lg=MATCH["gt"],
    us="SELECT threshold, count(DISTINCT track_id) AS used FROM aq GROUP BY 1",
    xh="SELECT x.*, (SELECT min(abs(g.t - x.t)) FROM lg g WHERE g.track_id = x.track_id) AS dist FROM aq x",
    th="SELECT DISTINCT threshold FROM aq",
    gc="""SELECT g.*, th.threshold, coalesce((SELECT min(abs(g.t - x.t)) FROM aq x WHERE x.track_id = g.track_id AND x.threshold = th.threshold) <= 20, false) AS covered
      FROM lg g CROSS JOIN th""",
    fo="""SELECT f.threshold, f.work_id, coalesce(o, 0) AS o, coalesce(h, 0) AS h, coalesce(h5, 0) AS h5, coalesce(n, 0) AS n, coalesce(c, 0) AS c
      FROM (SELECT DISTINCT threshold, work_id FROM th CROSS JOIN v_truth) f
      LEFT JOIN (SELECT threshold, work_id, count(*) AS o, count(*) FILTER (dist <= 20) AS h, count(*) FILTER (dist <= 5) AS h5 FROM xh GROUP BY 1, 2)
        o USING (threshold, work_id)
      LEFT JOIN (SELECT threshold, work_id, count(*) AS n, count(*) FILTER (covered) AS c FROM gc GROUP BY 1, 2) g USING (threshold, work_id)""",
)


def _a16(spark, base):
    out = mt.distinct_steps(hits(spark, base), "score", "hit")
    return show(out, *out.columns)


def _a17(spark, base):
    g = jn.labelled_only(truth(spark, base), labelled(spark, base), KEYS)
    out = mt.prefix_optimum(hits(spark, base), g, "work_id", "score", "hit", "cand_no")
    return show(out, *out.columns)


A17 = sql(
    V3,
    """SELECT k, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, round(score, 6) AS least_score FROM (
      SELECT k, score, p, r, 2 * p * r / greatest(1e-9, p + r) AS f FROM (
        SELECT k, any_value(score) AS score, avg(tp / n::DOUBLE) FILTER (n > 0) AS p, sum(tp / goal::DOUBLE) / count(*) AS r FROM st GROUP BY 1))
    ORDER BY round(f, 9) DESC, k LIMIT 1""",
    ev=HITS["ev"],
    hd=HITS["hd"],
    go="SELECT g.work_id, count(*) AS goal FROM v_truth g SEMI JOIN v_labelled USING (track_id) GROUP BY 1",
    rk="SELECT h.*, row_number() OVER (ORDER BY score DESC, cand_no) AS k FROM hd h SEMI JOIN go USING (work_id)",
    st="""SELECT r.k, r.score, g.work_id, g.goal, sum(CASE WHEN r.work_id = g.work_id THEN 1 ELSE 0 END) OVER w AS n,
      sum(CASE WHEN r.work_id = g.work_id AND r.hit THEN 1 ELSE 0 END) OVER w AS tp
      FROM rk r CROSS JOIN go g WINDOW w AS (PARTITION BY g.work_id ORDER BY r.k)""",
)


def _a18(spark, base):
    out = mt.truth_count_distribution(truth(spark, base), labelled(spark, base), KEYS)
    return show(out, *out.columns)


COUNTS = "SELECT l.work_id, l.track_id, count(g.t) AS truths FROM v_labelled l LEFT JOIN v_truth g USING (track_id) GROUP BY 1, 2"


def _a19_group(spark, base):
    groups = iv.group_by_gap(truth(spark, base), KEYS, "t", 30.0, "truth_no")
    return mt.pool_ceiling(groups, labelled(spark, base), KEYS)


def _a19_pool(spark, base):
    true_ones = hits(spark, base).filter("hit")
    found = ev.merge_candidates(true_ones, KEYS, "cand_no", top=99)
    return mt.pool_ceiling(found, labelled(spark, base), KEYS)


def ceiling_sql(views, source, **ctes):
    return sql(
        views,
        f"""SELECT n AS hit_events, count(*) AS tracks, sum(least(3, n))::BIGINT AS reachable FROM (
        SELECT l.track_id, count(x.track_id) AS n FROM v_labelled l LEFT JOIN ({source}) x USING (track_id) GROUP BY 1) GROUP BY 1""",
        **ctes,
    )


def _a20(spark, base):
    ideal = hits(spark, base).withColumn("ideal", F.coalesce(-F.col("dist"), F.col("t")))
    picked = select_spaced(ideal, KEYS, "t", "ideal", 30.0, 3, ["hit"])
    return show(picked.agg(F.count("*").alias("outputs"), F.count_if("hit").alias("hits")).withColumn("precision", F.col("hits") / F.col("outputs")),
                "outputs", "hits", "precision")


def _a21(spark, base):
    out = mt.pool_size_stats(cand(spark, base), KEYS)
    return show(out, *out.columns)


def _a22(spark, base):
    rows = pairs(spark, base)
    peak = cand(spark, base).select(F.col("cand_no"), "peak")
    for i in (1, 2):
        rows = rows.join(peak.select(F.col("cand_no").alias(f"id{i}"), F.col("peak").alias(f"peak{i}")), f"id{i}")
    out = mt.pair_profile(rows, ["peak"])
    return show(out, *out.columns)


A22 = sql(
    "v_cand v_truth",
    """SELECT kind, count(*) AS pairs, round(avg(t2 - t1), 6) AS mean_dt, round(avg(abs(score1 - score2)), 6) AS mean_gap,
      round(avg(greatest(score1, score2) / greatest(1e-6, least(score1, score2))), 6) AS mean_ratio, count(*) FILTER (score1 > score2) AS first_higher,
      round(avg(a.peak), 6) AS mean_peak1, round(avg(b.peak), 6) AS mean_peak2, round(median(t2 - t1), 6) AS median_dt
    FROM pr JOIN v_cand a ON a.cand_no = id1 JOIN v_cand b ON b.cand_no = id2 GROUP BY 1""",
    **PAIRS,
)


def _a23(spark, base):
    rows = jn.label_candidates(cand(spark, base), overridden(spark, base).select(*KEYS, "t"), KEYS)
    sources = overridden(spark, base).select(*KEYS, "label_source").distinct()
    return mt.class_counts(rows.join(sources, KEYS), "label_source", "hit", KEYS, "work_id")


A23 = sql(
    "v_cand v_truth v_done",
    """SELECT label_source, count(*) AS n, count(*) FILTER (d <= 20) AS positives, count(DISTINCT c.track_id) AS tracks, count(DISTINCT c.work_id) AS works
    FROM (SELECT c.*, (SELECT min(abs(o.t - c.t)) FROM ov o WHERE o.track_id = c.track_id) AS d FROM v_cand c) c
    JOIN (SELECT DISTINCT track_id, label_source FROM ov) s USING (track_id) GROUP BY 1""",
    **OVERRIDE,
)


def _a24(spark, base):
    out = mt.model_overlap(cand(spark, base), KEYS, "work_id", "cand_no", "score", "ref_score")
    return show(out, *out.columns)


A24 = sql(
    "v_cand",
    """SELECT work_id, count(*) FILTER (a <= 3 AND b <= 3) AS shared, count(*) AS union_size, round(count(*) FILTER (a <= 3 AND b <= 3) / count(*)::DOUBLE, 6) AS overlap
    FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, cand_no) AS a, row_number() OVER (PARTITION BY track_id ORDER BY ref_score DESC, cand_no) AS b
      FROM v_cand) WHERE a <= 3 OR b <= 3 GROUP BY 1""",
)


def _a25(spark, base):
    out = mt.correlation_matrix(cand(spark, base), FEATS)
    return show(out, *out.columns)


A25 = sql(
    "v_cand",
    " UNION ALL ".join(
        f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) + 0.0 AS r FROM v_cand"
        for i, x in enumerate(FEATS)
        for y in FEATS[i + 1 :]
    ),
)


def _a25_vif(spark, base):
    return mt.variance_inflation(cand(spark, base), ["score", "ref_score", "t"]).select("feature", F.round("vif", 6).alias("vif"))


def fold_precision(spark, base, score):
    picked = ev.merge_candidates(cand(spark, base).withColumn("score", F.col(score)), KEYS, "cand_no")
    h, _ = jn.match_events(picked, truth(spark, base), labelled(spark, base), KEYS)
    return h.groupBy("work_id").agg(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("precision"))


def _a26(spark, base):
    out = mt.paired_fold_test(fold_precision(spark, base, "score"), fold_precision(spark, base, "ref_score"), "work_id", "precision")
    return show(out, *out.columns)


_OTHER = fold_sql("b", "v_ref", "rn <= 4")
A26 = sql(
    V3,
    """SELECT count(*) AS folds, round(avg(d), 6) + 0.0 AS mean_difference, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, count(*) FILTER (d = 0) AS ties
    FROM (SELECT a.p - b.p AS d FROM pa a JOIN pb b USING (work_id))""",
    **E1,
    v_ref="SELECT * REPLACE (ref_score AS score) FROM v_cand",
    **_OTHER,
    lg=MATCH["gt"],
    **{
        f"p{x}": f"""SELECT work_id, avg(CASE WHEN (SELECT min(abs(g.t - x.t)) FROM lg g WHERE g.track_id = x.track_id) <= 20 THEN 1e0 ELSE 0e0 END) AS p
      FROM (SELECT * FROM {x}x SEMI JOIN v_labelled USING (track_id)) x GROUP BY 1"""
        for x in ("a", "b")
    },
)


def _a29(spark, base):
    files = cand(spark, base).filter("peak > 200").select(*KEYS)
    return mt.parse_report(labelled(spark, base), truth(spark, base), files, KEYS, "work_id")


A29 = sql(
    V3,
    """SELECT work_id, grouping(work_id)::INTEGER AS is_total, count(*) AS tracks, count(*) FILTER (f > 0) AS matched, count(*) FILTER (truths = 0) AS zero_tracks,
      sum(truths)::BIGINT AS points, sum(f)::BIGINT AS files FROM (SELECT tc.*, (SELECT count(*) FROM v_cand c WHERE c.track_id = tc.track_id AND peak > 200) AS f FROM tc)
    GROUP BY ROLLUP (work_id)""",
    tc=COUNTS,
)


def _a31(spark, base):
    a = cand(spark, base).filter("score > 0.3").select(*KEYS).distinct()
    b = truth(spark, base).select(*KEYS).distinct()
    tag = lambda df, name: df.select(F.lit(name).alias("op"), *KEYS)
    both = tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "only_a"))
    return both.unionByName(tag(a.union(b).distinct(), "either")).unionByName(tag(b.join(a, KEYS, "left_anti"), "only_b"))


A31 = sql(
    "v_cand v_truth",
    """SELECT 'both' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'either', * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'only_b', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    a="SELECT work_id, track_id FROM v_cand WHERE score > 0.3",
    b="SELECT work_id, track_id FROM v_truth",
)

SWEEP = [5.0, 15.0, 30.0]


def _a32(spark, base):
    """Spacing gap swept in one job: the gap is part of every key."""

    def run(rows, keys):
        parts = [select_spaced(rows.filter(F.col("gap") == g), keys, "t", "score", g, 3) for g in SWEEP]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    picked = mt.sweep(cand(spark, base), SWEEP, "gap", run, KEYS)
    levels = F.explode(F.array(*[F.lit(g) for g in SWEEP])).alias("gap")
    h, _ = jn.match_events(
        picked, truth(spark, base).select("*", levels), labelled(spark, base).select("*", levels), ["gap", *KEYS]
    )
    out = h.groupBy("gap").agg(F.count("*").alias("outputs"), F.count_if("hit").alias("hits"), F.avg(F.when(F.col("hit"), F.col("dist"))).alias("mean_abs"))
    return show(out, *out.columns)


_A32 = {}
for _g in SWEEP:
    _A32.update(spaced_sql(f"g{int(_g)}", "v_cand", "score", _g, 3))
A32 = sql(
    V3,
    """SELECT gap, count(*) AS outputs, count(*) FILTER (d <= 20) AS hits, round(avg(d) FILTER (d <= 20), 6) AS mean_abs FROM (
      SELECT x.*, (SELECT min(abs(g.t - x.t)) FROM lg g WHERE g.track_id = x.track_id) AS d FROM al x) GROUP BY 1""",
    **_A32,
    lg=MATCH["gt"],
    al=" UNION ALL ".join(f"SELECT {g}::DOUBLE AS gap, track_id, t FROM g{int(g)}p SEMI JOIN v_labelled USING (track_id)" for g in SWEEP),
)

CASES = {
    "a1_alignment_report": Case(_a1, A1),
    "a2_text_compare_report": Case(_a2, A2),
    "a2_text_compare_gated": Case(_a2_gated, A2_GATED),
    "a2_text_compare_by_track": Case(_a2_by_track, A2_BY_TRACK),
    "a3_conversion_summary": Case(_a3, A3),
    "a3_conversion_issues": Case(
        _a3_issues,
        sql(
            "",
            """SELECT src, 'resampled' AS issue FROM fl WHERE note LIKE 'resampled%' UNION ALL SELECT src, 'capped' FROM fl WHERE note LIKE 'capped%'
            UNION ALL SELECT src, 'failed' FROM fl WHERE NOT ok""",
            cv=CONVERSIONS,
            fl=FLAGS,
        ),
    ),
    "a4_stage_report": Case(_a4, A4),
    "a5_precision_recall": Case(_a5, A5),
    "a6_error_stats": Case(_a6, A6),
    "a7_signed_error_report": Case(_a7, A7),
    "a7_error_histogram": Case(_a7_hist, A7_HIST),
    "a7_error_by_work": Case(
        _a7_work,
        sql(
            V3,
            """SELECT work_id, count(*) AS n, round(avg(delta), 6) + 0.0 AS mean_error, round(avg(abs(delta)), 6) AS mean_abs FROM hd WHERE hit GROUP BY 1""",
            **HITS,
        ),
    ),
    "a8_correlate": Case(_a8, A8),
    "a9_bucket_error_by_score": Case(_a9_score, A9_SCORE),
    "a9_bucket_error_by_band": Case(
        _a9_band,
        sql(
            V3,
            f"""SELECT CASE WHEN ref_score >= 6e-1 THEN 'high' WHEN ref_score >= 3e-1 THEN 'mid' ELSE 'low' END AS band, {_BUCKET} FROM hd WHERE hit GROUP BY 1""",
            **HITS,
        ),
    ),
    "a9_bucket_error_by_rank": Case(
        _a9_rank, sql(V3, f"SELECT rank AS nth, {_BUCKET} FROM xh WHERE dist <= 20 GROUP BY 1", **DETECTION)
    ),
    "a10_calibration_table": Case(
        _a10,
        sql(
            V3,
            """SELECT least(floor(ref_score / 1e-1), 9)::BIGINT AS bin, count(*) AS n, count(*) FILTER (hit) AS hits,
            round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS rate, round(avg(ref_score), 6) AS mean_score FROM hd GROUP BY 1""",
            **HITS,
        ),
    ),
    "a11_brier": Case(
        _a11,
        sql(
            V3,
            """SELECT round(avg(pow(score - CASE WHEN hit THEN 1 ELSE 0 END, 2)), 6) AS brier_score,
            round(avg(pow(ref_score - CASE WHEN hit THEN 1 ELSE 0 END, 2)), 6) AS brier_ref_score FROM hd""",
            **HITS,
        ),
    ),
    "a12_auc": Case(_a12, A12),
    "a13_standardised_mean_difference": Case(_a13, A13),
    "a14_nearest_is_best_rate": Case(_a14, A14),
    "a15_threshold_sweep": Case(_a15, A15),
    "a16_distinct_steps": Case(
        _a16,
        sql(
            V3,
            """SELECT round(round_even(score, 4), 6) AS step, count(*) AS n, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS rate FROM hd GROUP BY 1""",
            **HITS,
        ),
    ),
    "a17_prefix_optimum": Case(_a17, A17),
    "a18_truth_count_distribution": Case(
        _a18,
        sql(
            "v_truth v_labelled",
            """SELECT truths, count(*) AS tracks, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS track_share,
            round(least(3, truths) / 3e0, 6) AS ceiling FROM tc GROUP BY 1""",
            tc=COUNTS,
        ),
    ),
    "a19_ceiling_grouped": Case(
        _a19_group,
        ceiling_sql(
            "v_truth v_labelled",
            "SELECT DISTINCT track_id, grp FROM gr",
            gr="""SELECT *, sum(CASE WHEN t - p <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t) AS grp
            FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t) AS p FROM v_truth)""",
        ),
    ),
    "a19_ceiling_pool": Case(
        _a19_pool,
        ceiling_sql(V3, "SELECT track_id FROM ze", **HITS, th="SELECT * FROM hd WHERE hit", **fold_sql("z", "th", "rn <= 100")),
    ),
    "a20_oracle_ranker": Case(
        _a20,
        sql(
            V3,
            """SELECT count(*) AS outputs, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS "precision" FROM oqp""",
            **HITS,
            oh="SELECT *, coalesce(-dist, t) AS ideal FROM hd",
            **spaced_sql("oq", "oh", "ideal", 30, 3),
        ),
    ),
    "a21_pool_size_stats": Case(
        _a21,
        sql(
            "v_cand",
            """SELECT count(*) AS tracks, round(avg(n), 6) AS mean_n, min(n) AS min_n, max(n) AS max_n, round(median(n), 6) AS median_n
            FROM (SELECT track_id, count(*) AS n FROM v_cand GROUP BY 1)""",
        ),
    ),
    "a22_pair_profile": Case(_a22, A22),
    "a23_class_counts": Case(_a23, A23),
    "a24_model_overlap": Case(_a24, A24),
    "a25_correlation_matrix": Case(_a25, A25),
    "a25_vif": Case(
        _a25_vif,
        sql(
            "v_cand",
            """SELECT unnest(['score', 'ref_score', 't']) AS feature, round(unnest([(1 - bt * bt) / d, (1 - st * st) / d, (1 - sb * sb) / d]), 6) AS vif
            FROM (SELECT *, 1 + 2 * sb * st * bt - sb * sb - st * st - bt * bt AS d FROM (SELECT corr(score, ref_score) AS sb, corr(score, t) AS st, corr(ref_score, t) AS bt FROM v_cand))""",
        ),
    ),
    "a26_paired_fold_test": Case(_a26, A26),
    "a29_parse_report": Case(_a29, A29),
    "a31_set_operations": Case(_a31, A31),
    "a32_parameter_sweep": Case(_a32, A32),
}

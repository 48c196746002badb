"""Frame series, peaks and shape features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.catalog.text import CUE_SQL, CUES
from tidemark.operators import signal as sg
from tidemark.plans.blocks import unblock
from tidemark.plans.folds import suppress

KEYS = fx.TRACK
HOP = 1.0
GAP = 8


def pcm(spark, base, block=64):
    """The sample view packed into fixed-size blocks."""
    rows = fx.samples(spark, base).withColumn("block_no", F.floor(F.col("idx") / block))
    packed = F.array_sort(F.collect_list(F.struct("idx", "x")))
    return rows.groupBy(*KEYS, "block_no").agg(F.transform(packed, lambda s: s["x"]).alias("samples"))


def _s12(spark, base):
    return show(sg.frames_from_pcm(pcm(spark, base), KEYS, 64, 8, 16), *KEYS, "idx", "level")


S12 = sql(
    "v_samples",
    """SELECT s.work_id, s.track_id, f AS idx, round(10.0::DOUBLE * log10(greatest(avg(x * x), 1e-12)), 6) + 0.0 AS level
    FROM (SELECT *, unnest([idx // 8 - 1, idx // 8]) AS f FROM v_samples) s
    JOIN n USING (track_id) WHERE f >= 0 AND f < greatest(1, (n - 16) // 8) GROUP BY 1, 2, 3""",
    n="SELECT track_id, count(*) AS n FROM v_samples GROUP BY 1",
)

SMOOTH = """SELECT *, sum(level) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5
    AS smooth FROM v_frames"""
LEVELS = """SELECT track_id, count(*) AS n_frames, quantile_cont(smooth, 0.5) AS median,
    quantile_cont(smooth, 0.95) AS threshold FROM sm GROUP BY 1"""
MAXIMA = """SELECT s.work_id, s.track_id, idx, smooth, median, n_frames FROM (
      SELECT *, lag(smooth) OVER w AS a, lead(smooth) OVER w AS b FROM sm WINDOW w AS (PARTITION BY track_id ORDER BY idx)) s
    JOIN lv USING (track_id) WHERE smooth >= a AND smooth > b AND smooth >= threshold"""
# greedy suppression: walk the maxima of a track best first, remembering the kept indices
RANKED = "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY smooth DESC, idx) AS rn FROM mx"
WALK = """SELECT track_id, rn, idx, [idx] AS kept, true AS keep FROM ranked WHERE rn = 1
    UNION ALL SELECT r.track_id, r.rn, r.idx,
      CASE WHEN len(list_filter(w.kept, lambda k: abs(k - r.idx) <= 8)) = 0 THEN list_append(w.kept, r.idx) ELSE w.kept END,
      len(list_filter(w.kept, lambda k: abs(k - r.idx) <= 8)) = 0
    FROM walk w JOIN ranked r ON r.track_id = w.track_id AND r.rn = w.rn + 1"""
PEAKS = "SELECT mx.* FROM mx JOIN walk USING (track_id, idx) WHERE keep"


def peak_sql(body, views="", **ctes):
    return sql(
        f"v_frames {views}", body, sm=SMOOTH, lv=LEVELS, mx=MAXIMA, ranked=RANKED, walk=WALK, pk=PEAKS, **ctes
    )


def smoothed(spark, base):
    return sg.moving_average(fx.frames(spark, base), KEYS, 5)


def peaks(spark, base):
    return sg.find_peaks(fx.frames(spark, base), KEYS, GAP)


def series_and_peaks(spark, base):
    """The smoothed series, written once, and its peaks."""
    series, bound = sg.smoothed_series(fx.frames(spark, base), KEYS, 5)
    return unblock(series).select(*KEYS, "idx", "smooth"), sg.peaks_of(series, KEYS, GAP, 0.95, bound), bound


def _w1(spark, base):
    return show(smoothed(spark, base), *KEYS, "idx", "smooth")


def _w1_even(spark, base):
    return show(sg.moving_average(fx.frames(spark, base), KEYS, 4), *KEYS, "idx", "smooth")


def _w2(spark, base):
    return show(sg.track_levels(unblock(smoothed(spark, base)), KEYS, "smooth"), *KEYS, "n_frames", "median", "threshold")


def _w2_approx(spark, base):
    sm = unblock(smoothed(spark, base))
    exact = sg.track_levels(sm, KEYS, "smooth")
    near = sg.approximate_levels(sm, KEYS, "smooth").select("track_id", F.col("median").alias("m"))
    both = exact.join(near, "track_id")
    return both.agg(F.count("*").alias("tracks"), F.count_if(F.abs(F.col("median") - F.col("m")) > 0.5).alias("far_off"))


def _maxima(spark, base):
    sm, _ = sg.smoothed_series(fx.frames(spark, base), KEYS, 5)
    return sg.local_maxima(sm, KEYS, "smooth", sg.track_levels(unblock(sm), KEYS, "smooth"))


def _w3(spark, base):
    return show(_maxima(spark, base), *KEYS, "idx", "smooth")


def _w4(spark, base):
    kept = suppress(_maxima(spark, base).select(*KEYS, "idx", "smooth"), KEYS, "idx", "smooth", GAP)
    return show(kept, *KEYS, "idx", "smooth")


def flagship(spark, base):
    """Three strongest peaks per track: smoothing, percentile, maxima, suppression, top-k."""
    from pyspark.sql import Window

    best = Window.partitionBy(*KEYS).orderBy(F.col("smooth").desc(), "idx")
    ranked = peaks(spark, base).withColumn("rank", F.row_number().over(best)).filter("rank <= 3")
    return show(ranked, *KEYS, "rank", "idx", "smooth")


def feature_rows(spark, base):
    sm, pk, bound = series_and_peaks(spark, base)
    return sg.shape_features(pk, sm, KEYS, HOP, bound=bound)


WIN = {k: (int(a), int(b)) for k, (a, b) in sg.WINDOWS.items()}
AROUND = "SELECT p.work_id, p.track_id, p.idx, p.smooth AS here, p.median, p.n_frames, f.idx AS j, f.smooth AS v FROM pk p JOIN sm f USING (track_id)"


def _mean_sql(a, b):
    lo = f"least(greatest(0, idx + {a}), n_frames - 1)"
    return f"avg(v) FILTER (j >= {lo} AND j < least(greatest({lo} + 1, idx + {b}), n_frames)) - median"


LEVEL_SQL = (
    "SELECT work_id, track_id, idx, here - median AS peak, median, n_frames, "
    + ", ".join(f"{_mean_sql(a, b)} AS {k}" for k, (a, b) in WIN.items())
    + """, coalesce(min(j - idx) FILTER (j >= idx AND j < idx + 60 AND v < median) * 1e0, 60e0) AS recover,
    here - median - (quantile_cont(v, 0.5) FILTER (j >= idx - 30 AND j < idx + 30) - median) AS prominence,
    avg(CASE WHEN v > median + (here - median) * 5e-1 THEN 1e0 ELSE 0e0 END) FILTER (j BETWEEN idx - 3 AND idx + 3) AS plateau
    FROM around GROUP BY work_id, track_id, idx, here, median, n_frames"""
)
EDGE_SQL = """SELECT work_id, track_id, idx, (idx - coalesce(max(j) FILTER (j <= idx AND v <= median + pre10 * 5e-1
      + (peak - pre10) * 5e-1), 0)) * 1e0 AS rise,
    (coalesce(min(j) FILTER (j >= idx AND v <= median + post2 + (peak - post2) * 5e-1), n_frames - 1) - idx) * 1e0 AS decay
    FROM around JOIN lf USING (work_id, track_id, idx, median, n_frames) GROUP BY work_id, track_id, idx, n_frames"""


def feats_sql(body, views="", **ctes):
    return peak_sql(body, views, around=AROUND, lf=LEVEL_SQL, ef=EDGE_SQL, **ctes)


def _r(*names):
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_LEVELS = ["peak", *WIN, "signature", "contrast"]


def _feature_case(*names):
    def run(spark, base):
        sm, pk, _ = series_and_peaks(spark, base)
        return show(sg.level_features(pk, sm, KEYS, HOP), *KEYS, "idx", *names)

    return Case(run, feats_sql(f"SELECT work_id, track_id, idx, {_r(*names)} FROM lf"))


def _w6(spark, base):
    sm, pk, _ = series_and_peaks(spark, base)
    return show(sg.level_features(pk, sm, KEYS, HOP), *KEYS, "idx", *_LEVELS)


def _edges(*names):
    def run(spark, base):
        return show(feature_rows(spark, base), *KEYS, "idx", *names)

    return Case(run, feats_sql(f"SELECT work_id, track_id, idx, {_r(*names)} FROM ef"))


def _ranks(*names):
    def run(spark, base):
        return show(sg.rank_features(peaks(spark, base), KEYS, HOP), *KEYS, "idx", *names)

    sql_text = {
        "rel_time": "round(idx / greatest(1e-6, n_frames * 1e0), 6) + 0.0 AS rel_time",
        "rank_energy": "row_number() OVER w - 1 AS rank_energy",
        "gap_prev": "coalesce((idx - lag(idx) OVER w) * 1e0, 0e0) AS gap_prev",
    }
    picked = ", ".join(sql_text[n] for n in names)
    return Case(
        run,
        peak_sql(
            f"SELECT work_id, track_id, idx, {picked} FROM pk WINDOW w AS (PARTITION BY track_id ORDER BY smooth DESC, idx)"
        ),
    )


def _w15(spark, base):
    points = sg.frames_from_pcm(pcm(spark, base), KEYS, 64, 8, 16).select(*KEYS, "idx")
    out = sg.spectral_features(points, fx.samples(spark, base), KEYS, 8, 4, 16000.0, min_samples=32)
    return show(out, *KEYS, "idx", "zcr")


W15 = sql(
    "v_samples",
    """SELECT work_id, track_id, f AS idx, CASE WHEN size > 32 THEN
      round(sum(CASE WHEN c <> p THEN 1 ELSE 0 END) / (size - 1)::DOUBLE, 6) ELSE 0e0 END AS zcr
    FROM (SELECT *, lag(c) OVER (PARTITION BY track_id, f ORDER BY j) AS p FROM signs) GROUP BY 1, 2, 3, size""",
    n="SELECT work_id, track_id, count(*) AS n FROM v_samples GROUP BY 1, 2",
    fr="SELECT *, unnest(range(greatest(1, (n - 16) // 8))) AS f FROM n",
    part="""SELECT fr.work_id, fr.track_id, f, s.idx AS j, x, count(*) OVER (PARTITION BY fr.track_id, f) AS size,
      avg(x) OVER (PARTITION BY fr.track_id, f) AS m FROM fr JOIN v_samples s ON s.track_id = fr.track_id
      AND s.idx >= greatest(0, f - 4) * 8 AND s.idx < least(n, (f + 4) * 8)""",
    signs="SELECT *, sign(x - m) AS c FROM part",
)


def _w15_spectrum(spark, base):
    points = sg.frames_from_pcm(pcm(spark, base), KEYS, 64, 8, 16).select(*KEYS, "idx")
    out = sg.spectral_features(points, fx.samples(spark, base), KEYS, 8, 4, 16000.0, min_samples=32)
    return show(out.withColumn("centroid", F.round("centroid", 3)), *KEYS, "idx", "centroid", "flatness")


def spectrum_ctes(points, step, half, least, rate=16000):
    """Spectral values of the samples around the points ``(track_id, f)``, by a direct Fourier sum."""
    turn = "2 * pi() * k * q / size"
    lifted = "(x - m) * (5e-1 - 5e-1 * cos(2 * pi() * q / (size - 1)))"
    return {
        "sn": "SELECT track_id, count(*) AS n FROM v_samples GROUP BY 1",
        "spt": f"""SELECT p.track_id, f, x, row_number() OVER w - 1 AS q, count(*) OVER g AS size, avg(x) OVER g AS m,
          sign(x - avg(x) OVER g) AS c FROM {points} p JOIN sn USING (track_id) JOIN v_samples s ON s.track_id = p.track_id
          AND s.idx >= greatest(0, f - {half}) * {step} AND s.idx < least(n, (f + {half}) * {step})
          WINDOW w AS (PARTITION BY p.track_id, f ORDER BY s.idx), g AS (PARTITION BY p.track_id, f)""",
        "szc": f"""SELECT track_id, f, sum(CASE WHEN c <> b THEN 1 ELSE 0 END) / (any_value(size) - 1)::DOUBLE AS zcr
          FROM (SELECT *, lag(c) OVER (PARTITION BY track_id, f ORDER BY q) AS b FROM spt WHERE size > {least}) GROUP BY 1, 2""",
        "sbn": f"""SELECT track_id, f, size, k, sqrt(sum({lifted} * cos({turn})) ** 2 + sum({lifted} * sin({turn})) ** 2) + 1e-12 AS mag
          FROM spt, range(0, {step * half + 1}) r(k) WHERE k <= size // 2 AND size > {least} GROUP BY 1, 2, 3, 4""",
        "spc": f"""SELECT track_id, f, sum(mag * k * {rate} / size) / sum(mag) AS centroid, exp(avg(ln(mag))) / avg(mag) AS flatness FROM sbn GROUP BY 1, 2""",
    }


W15_SPECTRUM = sql(
    "v_samples",
    """SELECT work_id, track_id, f AS idx, round(coalesce(centroid, 0), 3) + 0.0 AS centroid, round(coalesce(flatness, 0), 6) + 0.0 AS flatness
    FROM fr LEFT JOIN spc USING (track_id, f)""",
    n="SELECT work_id, track_id, count(*) AS n FROM v_samples GROUP BY 1, 2",
    fr="SELECT *, unnest(range(greatest(1, (n - 16) // 8))) AS f FROM n",
    pts="SELECT track_id, f FROM fr",
    **spectrum_ctes("pts", 8, 4, 32),
)


def _w16(spark, base):
    sm, pk, _ = series_and_peaks(spark, base)
    return show(
        sg.formula_shape(pk, sm, KEYS, HOP), *KEYS, "idx", "pre30", "post4", "signature", "recover", "peak"
    )


def _w17(spark, base):
    sm, pk, _ = series_and_peaks(spark, base)
    out = sg.landmarks(pk, sm, KEYS, 30)
    return show(out, *KEYS, "idx", "top_idx", "rise_idx", "fall_idx", "onset_idx", "centre_idx")


W17 = peak_sql(
    """SELECT work_id, track_id, idx, arg_min(j, (-v, j)) AS top_idx,
      arg_min(j, (-d, j)) FILTER (d IS NOT NULL) AS rise_idx, arg_min(j, (d, j)) FILTER (d IS NOT NULL) AS fall_idx,
      min(j) FILTER (v >= mx - 3) AS onset_idx,
      round(min(j) + sum((j - lo) * greatest(v - md, 0e0)) / greatest(1e-9, sum(greatest(v - md, 0e0))), 6) AS centre_idx
    FROM (SELECT *, lead(v) OVER p - v AS d, max(v) OVER q AS mx, min(j) OVER q AS lo, median(v) OVER q AS md FROM near
      WINDOW p AS (PARTITION BY track_id, idx ORDER BY j), q AS (PARTITION BY track_id, idx)) GROUP BY 1, 2, 3""",
    around=AROUND,
    near="SELECT * FROM around WHERE j >= idx - 30 AND j < idx + 30",
)


def candidates(spark, base):
    return sg.candidate_table(fx.frames(spark, base), KEYS, HOP)


_W18 = ["peak", *WIN, "signature", "contrast", "recover", "prominence", "plateau", "rise", "decay"]


def _w18(spark, base):
    rows = candidates(spark, base)
    return rows.select(
        *KEYS, F.round("t", 2).alias("t"), "rank_energy", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in _W18]
    )


W18 = feats_sql(
    "SELECT work_id, track_id, idx * 1e0 AS t, row_number() OVER (PARTITION BY track_id ORDER BY peak DESC, idx) - 1 AS rank_energy, "
    + ", ".join(
        f"round({ {'signature': 'pre30 - post2', 'contrast': 'peak - pre10'}.get(c, c)}, 3) + 0.0 AS {c}" for c in _W18
    )
    + " FROM lf JOIN ef USING (work_id, track_id, idx)"
)


def model_rows(spark, base):
    """Candidates with all 21 features; samples and frames of these tables share their index."""
    return sg.model_row(candidates(spark, base), fx.samples(spark, base), fx.conversation_segments(spark, base), KEYS, CUES, 1, 20, 16000.0, 16)


PLACES = {"rel_time": 6, "zcr": 6, "flatness": 6}


def _w18_full(spark, base):
    rows = model_rows(spark, base)
    return rows.select(*KEYS, "idx", *[(F.round(F.col(c).cast("double"), PLACES.get(c, 3)) + F.lit(0.0)).alias(c) for c in sg.FEATURES])


_RANKED = "rank_energy gap_prev rel_time".split()
W18_FULL = feats_sql(
    """SELECT work_id, track_id, idx, """
    + ", ".join(f"round(({ {'signature': 'pre30 - post2', 'contrast': 'peak - pre10'}.get(c, c)})::DOUBLE, 3) + 0.0 AS {c}" for c in _W18)
    + """, (row_number() OVER o - 1)::DOUBLE AS rank_energy, coalesce(idx - lag(idx) OVER o, 0)::DOUBLE AS gap_prev,
      round(idx / greatest(1e-6, n_frames), 6) + 0.0 AS rel_time, round(coalesce(zcr, 0), 6) + 0.0 AS zcr,
      round(coalesce(centroid, 0), 3) + 0.0 AS centroid, round(coalesce(flatness, 0), 6) + 0.0 AS flatness, coalesce(cue, 0)::DOUBLE AS txt
    FROM lf JOIN ef USING (work_id, track_id, idx) LEFT JOIN szc z ON z.track_id = lf.track_id AND z.f = lf.idx
      LEFT JOIN spc y ON y.track_id = lf.track_id AND y.f = lf.idx LEFT JOIN cu ON cu.track_id = lf.track_id AND cu.at = lf.idx
    WINDOW o AS (PARTITION BY lf.track_id ORDER BY peak DESC, idx)""",
    "v_samples v_conv",
    pts="SELECT track_id, idx AS f FROM lf",
    **spectrum_ctes("pts", 1, 20, 16),
    cw=f"""SELECT track_id, "start", {CUE_SQL.format(t='text')} AS w FROM v_conv""",
    cu="""SELECT p.track_id, p.f AS at, max(w) AS cue FROM pts p JOIN cw USING (track_id) WHERE w > 0 AND abs("start" - p.f) <= 6 GROUP BY 1, 2""",
)


def _j14(spark, base):
    ours = unblock(smoothed(spark, base)).select(*KEYS, "idx", "smooth")
    rows = fx.frames(spark, base)
    spread = rows.select(*KEYS, F.explode(F.sequence(F.col("idx") - 2, F.col("idx") + 2)).alias("idx"), "level")
    other = spread.groupBy(*KEYS, "idx").agg((F.sum("level") / 5).alias("smooth"))
    other = other.join(rows.select(*KEYS, "idx"), [*KEYS, "idx"], "left_semi")
    return show(
        sg.parity(ours, other, [*KEYS, "idx"], {"smooth": 1e-9}).withColumn("max_error", F.round("max_error", 6)),
        "only_a", "only_b", "column_name", "max_error", "null_mismatches", "within",
    )


CASES = {
    "s12_frames_from_pcm": Case(_s12, S12),
    "w1_moving_average": Case(_w1, sql("v_frames", "SELECT work_id, track_id, idx, round(smooth, 6) AS smooth FROM sm", sm=SMOOTH)),
    "w1_moving_average_even": Case(
        _w1_even,
        sql(
            "v_frames",
            """SELECT work_id, track_id, idx, round(sum(level) OVER (PARTITION BY track_id ORDER BY idx
            ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS smooth FROM v_frames""",
        ),
    ),
    "w2_track_median": Case(
        _w2,
        sql(
            "v_frames",
            f"SELECT work_id, track_id, n_frames, {_r('median', 'threshold')} FROM lv JOIN (SELECT DISTINCT work_id, track_id FROM sm) USING (track_id)",
            sm=SMOOTH,
            lv=LEVELS,
        ),
    ),
    "w2_approx_levels": Case(_w2_approx, "SELECT count(DISTINCT l_suppkey) AS tracks, 0::BIGINT AS far_off FROM lineitem"),
    "w3_local_maxima": Case(
        _w3,
        sql("v_frames", "SELECT work_id, track_id, idx, round(smooth, 6) AS smooth FROM mx", sm=SMOOTH, lv=LEVELS, mx=MAXIMA),
    ),
    "w4_suppress": Case(_w4, peak_sql("SELECT work_id, track_id, idx, round(smooth, 6) AS smooth FROM pk")),
    "w4_top_peaks": Case(
        flagship,
        peak_sql(
            """SELECT work_id, track_id, rank, idx, round(smooth, 6) AS smooth FROM (SELECT *, row_number() OVER (
            PARTITION BY track_id ORDER BY smooth DESC, idx) AS rank FROM pk) WHERE rank <= 3"""
        ),
    ),
    "w5_window_mean": _feature_case(*WIN),
    "w6_level_features": Case(
        _w6,
        feats_sql(
            "SELECT work_id, track_id, idx, "
            + _r("peak", *WIN)
            + ", round(pre30 - post2, 6) + 0.0 AS signature, round(peak - pre10, 6) + 0.0 AS contrast FROM lf"
        ),
    ),
    "w7_rise": _edges("rise"),
    "w8_decay": _edges("decay"),
    "w9_recover": _feature_case("recover"),
    "w10_prominence": _feature_case("prominence"),
    "w11_plateau": _feature_case("plateau"),
    "w12_rel_time": _ranks("rel_time"),
    "w13_rank_energy": _ranks("rank_energy"),
    "w14_gap_prev": _ranks("gap_prev"),
    "w15_zero_crossings": Case(_w15, W15),
    "w15_spectral_features": Case(_w15_spectrum, W15_SPECTRUM),
    "w16_shape_features_formula": Case(
        _w16,
        feats_sql(
            "SELECT work_id, track_id, idx, "
            + _r("pre30", "recover", "peak")
            + ", round(post2, 6) + 0.0 AS post4, round(pre30 - post2, 6) + 0.0 AS signature FROM lf"
        ),
    ),
    "w17_landmarks": Case(_w17, W17),
    "w18_candidate_context": Case(_w18, W18),
    "w18_model_row": Case(_w18_full, W18_FULL),
    "j14_tolerance_diff": Case(
        _j14,
        "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, 'smooth' AS column_name, 0e0 AS max_error, 0::BIGINT AS null_mismatches, true AS within",
    ),
}

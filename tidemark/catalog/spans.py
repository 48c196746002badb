"""Interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.operators import intervals as iv

KEYS = fx.TRACK


def voiced(spark, base):
    """Segments as intervals found at three thresholds of the no-speech score."""
    rows = fx.segments(spark, base).filter(F.col("end") > F.col("start"))
    grid = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(th).alias("threshold")) for i, th in enumerate([0.3, 0.6, 0.9])])
    return rows.select("*", F.inline(grid)).filter(F.col("no_speech_prob") <= F.col("threshold"))


def durations(spark, base):
    return fx.segments(spark, base).groupBy(*KEYS).agg(F.max("end").alias("duration"))


COVER = {
    "dur": 'SELECT work_id, track_id, max("end") AS duration FROM v_seg GROUP BY 1, 2',
    "grid": "SELECT * FROM (VALUES (0, 3e-1), (1, 6e-1), (2, 9e-1)) g(ord, threshold)",
    "cov": """SELECT d.work_id, d.track_id, ord, threshold, duration,
      coalesce(sum("end" - "start") FILTER (no_speech_prob <= threshold), 0) / greatest(duration, 1e-6) AS coverage
      FROM dur d CROSS JOIN grid LEFT JOIN v_seg s ON s.track_id = d.track_id GROUP BY 1, 2, 3, 4, 5""",
}


def _coverages(spark, base):
    grid = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(th).alias("threshold")) for i, th in enumerate([0.3, 0.6, 0.9])])
    per_level = durations(spark, base).select("*", F.inline(grid))
    return iv.coverage(voiced(spark, base), [*KEYS, "ord", "threshold"], per_level)


def _i1(spark, base):
    return show(_coverages(spark, base), *KEYS, "ord", "threshold", "coverage")


def _i2(spark, base):
    return show(iv.pick_threshold(_coverages(spark, base), KEYS, "ord", "threshold", 0.5), *KEYS, "threshold", "coverage")


def lengths(spark, base):
    return fx.intervals(spark, base).groupBy("track_id").agg((F.max("end") + 20 + F.col("track_id") % 30).alias("length"))


def _i3(spark, base):
    out = iv.gaps(fx.intervals(spark, base), ["track_id"], lengths(spark, base), 30, ["start", "item_no"])
    return out.select("track_id", "gap_start", "gap_end")


I3 = sql(
    "v_intervals",
    """SELECT track_id, gap_start, "start" AS gap_end FROM (SELECT *, greatest(0, coalesce(max("end") FILTER (tail = 0) OVER (PARTITION BY track_id
      ORDER BY tail, "start", item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gap_start FROM al) WHERE "start" - gap_start >= 30""",
    al="""SELECT track_id, item_no, "start", "end", 0 AS tail FROM v_intervals UNION ALL
      SELECT track_id, NULL, max("end") + 20 + track_id % 30, NULL, 1 FROM v_intervals GROUP BY track_id""",
)

RATE = dict(rate=8, target=40, floor_db=-6.0, frame=4, slack=16)


def base_chunks(spark, base):
    """Samples 100-160 and 300-420 of each track stand for detected speech."""
    tracks = fx.samples(spark, base).groupBy(*KEYS).agg((F.max("idx") + 1).alias("length"))
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in [(100, 160), (300, 420)]])
    return tracks, tracks.select(*KEYS, F.inline(spans))


def _i4(spark, base):
    tracks, _ = base_chunks(spark, base)
    spans = tracks.select(*KEYS, F.lit(0).cast("long").alias("lo"), F.col("length").alias("hi"))
    return iv.split_at_quiet(spans, fx.samples(spark, base), KEYS, **RATE)


def _i5(spark, base):
    tracks, chunks = base_chunks(spark, base)
    return iv.fill_gaps(chunks, fx.samples(spark, base), KEYS, tracks, 30, **RATE)


def _quiet_sql(spans):
    """The cutting rule as a recursive walk over spans."""
    window = """greatest(w."start" + 8, least(w.hi, w."start" + 40) - 16)"""
    return {
        "lv": """SELECT track_id, idx // 4 AS f, 20::DOUBLE * log10(greatest(sqrt(avg(x * x)), 1e-7)) AS db, count(*) AS n
          FROM v_samples GROUP BY 1, 2""",
        "sp": spans,
        "qw": f"""SELECT work_id, track_id, lo, hi, lo AS "start", NULL::BIGINT AS stop FROM sp
          UNION ALL SELECT work_id, track_id, lo, hi, greatest(e, "start" + 4), e FROM (
            SELECT w.work_id, w.track_id, w.lo, w.hi, w."start", CASE WHEN w."start" + 40 >= w.hi THEN w.hi ELSE
              least(w.hi, coalesce(greatest(w."start" + 8, least(w.hi, 4 * arg_min(l.f, (l.db, l.f)))), w."start" + 40)) END AS e
            FROM (SELECT * FROM qw WHERE "start" < hi) w LEFT JOIN lv l ON l.track_id = w.track_id AND l.n = 4
              AND l.f >= {window} // 4 AND l.f < greatest({window} // 4 + 1, least(w.hi, w."start" + 56) // 4)
            GROUP BY w.work_id, w.track_id, w.lo, w.hi, w."start")""",
        "pc": """SELECT work_id, track_id, lo, lag("start") OVER (PARTITION BY track_id, lo ORDER BY "start") AS "start", stop AS "end" FROM qw""",
        "kept": """SELECT p.work_id, p.track_id, p."start", p."end" FROM pc p JOIN v_samples s ON s.track_id = p.track_id
          AND s.idx >= p."start" AND s.idx < p."end" GROUP BY 1, 2, 3, 4 HAVING 20 * log10(greatest(1e-7, max(abs(x)))) >= -6""",
    }


WHOLE = "SELECT work_id, track_id, 0::BIGINT AS lo, count(*) AS hi FROM v_samples GROUP BY 1, 2"
GAPS = """SELECT work_id, track_id, lo, hi FROM (SELECT work_id, track_id, count(*) AS n FROM v_samples GROUP BY 1, 2),
    LATERAL (VALUES (0::BIGINT, 100::BIGINT), (160, 300), (420, n)) g(lo, hi) WHERE hi - lo >= 30"""


def _i6(spark, base):
    chunks = fx.segments(spark, base).filter((F.col("no_speech_prob") < 0.1) & (F.col("end") > F.col("start")))
    return show(iv.low_coverage_fallback(chunks, KEYS, durations(spark, base)), *KEYS, "start", "end", "kind")


I6 = sql(
    "v_seg",
    """SELECT work_id, track_id, round("start", 6) AS "start", round("end", 6) AS "end", 'chunk' AS kind FROM ch
      JOIN sh USING (work_id, track_id) WHERE share >= 0.1
    UNION ALL SELECT work_id, track_id, 0e0, round(d, 6), 'whole' FROM sh WHERE share < 0.1""",
    ch="""SELECT * FROM v_seg WHERE no_speech_prob < 0.1 AND "end" > "start" """,
    sh="""SELECT d.work_id, d.track_id, d.d, coalesce(sum(c."end" - c."start"), 0) / greatest(d.d, 1e-6) AS share
      FROM (SELECT work_id, track_id, max("end") AS d FROM v_seg GROUP BY 1, 2) d LEFT JOIN ch c ON c.track_id = d.track_id GROUP BY 1, 2, 3""",
)


def _i7(spark, base):
    return show(
        iv.group_by_gap(fx.truth(spark, base), KEYS, "t", 30.0, "truth_no"), *KEYS, "grp", "members", "first_t", "last_t", "mean_t"
    )


I7 = sql(
    "v_truth",
    """SELECT work_id, track_id, grp, count(*) AS members, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, round(avg(t), 6) AS mean_t
    FROM (SELECT *, sum(CASE WHEN t - p <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t)::BIGINT AS grp
      FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t) AS p FROM v_truth)) GROUP BY 1, 2, 3""",
)

CASES = {
    "i1_coverage": Case(
        _i1, sql("v_seg", "SELECT work_id, track_id, ord, threshold, round(coverage, 6) AS coverage FROM cov", **COVER)
    ),
    "i2_pick_threshold": Case(
        _i2,
        sql(
            "v_seg",
            """SELECT work_id, track_id, CASE WHEN count(*) FILTER (coverage >= 0.5) > 0 THEN arg_min(threshold, ord) FILTER (coverage >= 0.5)
              ELSE arg_max(threshold, (coverage, -ord)) END AS threshold,
            round(CASE WHEN count(*) FILTER (coverage >= 0.5) > 0 THEN arg_min(coverage, ord) FILTER (coverage >= 0.5)
              ELSE arg_max(coverage, (coverage, -ord)) END, 6) AS coverage FROM cov GROUP BY 1, 2""",
            **COVER,
        ),
    ),
    "i3_gaps": Case(_i3, I3),
    "i4_split_at_quiet": Case(
        _i4, sql("v_samples", 'SELECT work_id, track_id, "start", "end" FROM kept', **_quiet_sql(WHOLE))
    ),
    "i5_fill_gaps": Case(
        _i5,
        sql(
            "v_samples",
            """SELECT work_id, track_id, "start", "end", 'filled' AS kind FROM kept UNION ALL
            SELECT work_id, track_id, unnest([100, 300])::BIGINT, unnest([160, 420])::BIGINT, 'base' FROM (SELECT DISTINCT work_id, track_id FROM v_samples)""",
            **_quiet_sql(GAPS),
        ),
    ),
    "i6_low_coverage_fallback": Case(_i6, I6),
    "i7_merge_truth_groups": Case(_i7, I7),
}

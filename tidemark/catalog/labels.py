"""Label-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.catalog.joins import OVERRIDE, overridden
from tidemark.catalog.signal import KEYS
from tidemark.operators import labels as lb

LIVE = """SELECT DISTINCT audio, time FROM v_marks m WHERE action = 'add' AND NOT EXISTS (
    SELECT 1 FROM v_marks d WHERE d.audio = m.audio AND d.time = m.time AND d.action = 'del')"""
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audio, time ORDER BY line_no DESC) AS rn FROM v_feedback) WHERE rn = 1"
DONE = "SELECT audio, arg_max(done, line_no) AS done FROM v_done GROUP BY 1"


def _l6(spark, base):
    before = F.col("peak") > 200
    rows = fx.candidates(spark, base).withColumn("was_hit", before)
    out = lb.relabel(rows, overridden(spark, base).select(*KEYS, "t"), KEYS, "was_hit")
    return show(out, *KEYS, "cand_no", "dist", "hit", "changed")


def _a27(spark, base):
    marks, done = lb.live_marks(fx.marks(spark, base)), lb.done_flag(fx.done_log(spark, base)).filter("done")
    a = marks.agg(F.count("*").alias("n"), F.countDistinct("audio").alias("k"))
    rows = a.select(F.explode(F.array(F.struct(F.lit("live_points").alias("what"), F.col("n").alias("n")), F.struct(F.lit("tracks_marked").alias("what"), F.col("k").alias("n")))).alias("s"))
    return rows.select("s.*").unionByName(done.agg(F.lit("tracks_done").alias("what"), F.count("*").alias("n")))


CASES = {
    "l1_live_marks": Case(lambda s, b: lb.live_marks(fx.marks(s, b)), sql("v_marks", "SELECT * FROM live", live=LIVE)),
    "l2_latest_verdict": Case(
        lambda s, b: lb.latest_verdict(fx.feedback(s, b)), sql("v_feedback", "SELECT audio, time, verdict, line_no FROM l", l=LAST)
    ),
    "l3_done_flag": Case(lambda s, b: lb.done_flag(fx.done_log(s, b)), sql("v_done", DONE)),
    "l3b_done_any": Case(
        lambda s, b: lb.done_any(fx.done_log(s, b)), sql("v_done", "SELECT audio, bool_or(done) AS done FROM v_done GROUP BY 1")
    ),
    "l4_export_truth": Case(
        lambda s, b: lb.export_truth(fx.marks(s, b), fx.done_log(s, b), F.col("audio") % 10, F.col("audio")),
        sql(
            "v_marks v_done",
            "SELECT audio % 10 AS work_id, audio AS track_id, time AS t FROM live WHERE audio IN (SELECT audio FROM dn WHERE done)",
            live=LIVE,
            dn=DONE,
        ),
    ),
    "l5_export_feedback": Case(
        lambda s, b: lb.export_feedback(fx.feedback(s, b)).select("audio", "time", "verdict", F.col("feats")["peak"].alias("peak")),
        sql("v_feedback", "SELECT audio, time, verdict, peak FROM l WHERE verdict IS NOT NULL", l=LAST),
    ),
    "l6_relabel": Case(
        _l6,
        sql(
            "v_cand v_truth v_done",
            """SELECT work_id, track_id, cand_no, round(d, 6) AS dist, coalesce(d <= 20, false) AS hit, coalesce(d <= 20, false) <> (peak > 200) AS changed
            FROM (SELECT c.*, (SELECT min(abs(o.t - c.t)) FROM ov o WHERE o.track_id = c.track_id) AS d FROM v_cand c)""",
            **OVERRIDE,
        ),
    ),
    "a27_marks_stats": Case(
        _a27,
        sql(
            "v_marks v_done",
            """SELECT 'live_points' AS what, count(*) AS n FROM live UNION ALL SELECT 'tracks_marked', count(DISTINCT audio) FROM live
            UNION ALL SELECT 'tracks_done', count(*) FROM dn WHERE done""",
            live=LIVE,
            dn=DONE,
        ),
    ),
    "a28_feedback_stats": Case(
        lambda s, b: lb.latest_verdict(fx.feedback(s, b)).agg(
            F.count("*").alias("total"), F.count_if(F.col("verdict") == 1).alias("pos"), F.count_if(F.coalesce(F.col("verdict"), F.lit(0)) != 1).alias("neg")
        ),
        sql(
            "v_feedback",
            "SELECT count(*) AS total, count(*) FILTER (verdict = 1) AS pos, count(*) FILTER (verdict IS NULL OR verdict <> 1) AS neg FROM l",
            l=LAST,
        ),
    ),
}

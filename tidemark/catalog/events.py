"""Event selection queries and their recursive SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.catalog.text import CUE_SQL, CUES
from tidemark.catalog.signal import AROUND, EDGE_SQL, KEYS, LEVEL_SQL, LEVELS, MAXIMA, PEAKS, RANKED, SMOOTH, WALK
from tidemark.operators import events as ev
from tidemark.operators.joins import top_per_key
from tidemark.plans.folds import select_spaced
from tidemark.plans.pipelines import detect_events

NUMBERED = "SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, t, cand_no) AS rn FROM {source}"


def cand(spark, base):
    return fx.candidates(spark, base)


def fold_sql(prefix, source, where="true", top=None, gap=30, nearest=False, mode="mean", stops=False):
    """CTEs walking candidates best first with a list of representatives as the state."""
    reps = f"{prefix}w.reps"
    dist = f"list_transform({reps}, lambda r: abs(n.t - r.tm))"
    if nearest:
        at = f"CASE WHEN list_min({dist}) <= {gap} THEN list_position({dist}, list_min({dist})) ELSE 0 END"
    else:
        at = f"coalesce(list_position(list_transform({dist}, lambda d: d <= {gap}), true), 0)"
    time = {
        "mean": "(r.total + s.t) / (r.n + 1)",
        "best": "r.tm",
        "weighted": "(s.t * greatest(s.score, 1e-6) + r.total) / (greatest(s.score, 1e-6) + r.n)",
    }[mode]
    room = "true" if top is None else f"len(s.reps) < {top}"
    fresh = "{'tm': s.t, 'score': s.score, 'total': s.t, 'n': 1, 'best': s.cand_no}"
    joined = (
        f"list_transform(s.reps, lambda r, i: CASE WHEN i = s.at THEN {{'tm': {time}, 'score': r.score, 'total': r.total + s.t, "
        f"'n': r.n + 1, 'best': r.best}} ELSE r END)"
    )
    seed = "[{'tm': t, 'score': score, 'total': t, 'n': 1, 'best': cand_no}]"
    return {
        f"{prefix}n": f"SELECT * FROM ({NUMBERED.format(source=source)}) WHERE {where}",
        f"{prefix}w": f"""SELECT work_id, track_id, rn, {seed} AS reps, false AS closed FROM {prefix}n WHERE rn = 1
          UNION ALL SELECT s.work_id, s.track_id, s.rn, CASE WHEN s.closed THEN s.reps WHEN s.at > 0 THEN {joined}
            WHEN {room} THEN list_append(s.reps, {fresh}) ELSE s.reps END,
            s.closed OR ({'true' if stops else 'false'} AND s.at = 0 AND NOT {room})
          FROM (SELECT n.*, {prefix}w.reps, {prefix}w.closed, {at} AS at FROM {prefix}w JOIN {prefix}n n
            ON n.track_id = {prefix}w.track_id AND n.rn = {prefix}w.rn + 1) s""",
        f"{prefix}e": f"""SELECT work_id, track_id, unnest(range(len(reps))) AS i, unnest(reps) AS r FROM
          (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY rn DESC) AS back FROM {prefix}w) WHERE back = 1""",
        f"{prefix}x": f"""SELECT * FROM (SELECT work_id, track_id, row_number() OVER (PARTITION BY track_id ORDER BY r.score DESC, i) AS rank,
          r.best AS cand_no, r.tm AS t, r.score AS score, r.n AS merged FROM {prefix}e) WHERE rank <= {top or 3}""",
    }


OUT = """SELECT work_id, track_id, rank, cand_no, round(t, 6) AS t, round(score, 6) AS score, merged FROM {x}"""
E1 = fold_sql("a", "v_cand", "rn <= 4")


def events(spark, base):
    return ev.merge_candidates(cand(spark, base), KEYS, "cand_no")


_COLS = [*KEYS, "rank", "cand_no", "t", "score", "merged"]


def _e1(spark, base):
    return show(events(spark, base), *_COLS)


def _e2(spark, base):
    return show(ev.merge_scan_down(cand(spark, base), KEYS, "cand_no"), *_COLS)


def _e3(mode):
    return lambda spark, base: show(ev.merge_nearest_rep(cand(spark, base), KEYS, "cand_no", mode=mode), *_COLS)


SPACED = """SELECT track_id, rn, CASE WHEN true THEN [t] END AS kept, true AS keep FROM {n} WHERE rn = 1
    UNION ALL SELECT s.track_id, s.rn, CASE WHEN s.ok THEN list_append(s.kept, s.t) ELSE s.kept END, s.ok FROM (
      SELECT n.track_id, n.rn, n.t, w.kept, len(w.kept) < {top} AND len(list_filter(w.kept, lambda k: abs(k - n.t) <= {gap})) = 0 AS ok
      FROM {w} w JOIN {n} n ON n.track_id = w.track_id AND n.rn = w.rn + 1) s"""


def spaced_sql(prefix, source, score, gap, top):
    n, w = f"{prefix}n", f"{prefix}w"
    return {
        n: f"SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY {score} DESC, t) AS rn FROM {source}",
        w: SPACED.format(n=n, w=w, gap=gap, top=top),
        f"{prefix}p": f"""SELECT {n}.*, row_number() OVER (PARTITION BY track_id ORDER BY rn) AS rank FROM {n} JOIN {w} USING (track_id, rn) WHERE keep""",
    }


def _e4(spark, base):
    out = ev.merge_chain(cand(spark, base), KEYS, "cand_no", 2.0, 15.0)
    return show(out, *KEYS, "rank", "t", "score", "members")


CHAIN = {
    "isl": """SELECT *, sum(CASE WHEN t - p <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t) AS grp
      FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t) AS p FROM v_cand)""",
    "grp": "SELECT work_id, track_id, avg(t) AS t, max(score) AS score, count(*) AS members FROM isl GROUP BY work_id, track_id, grp",
}


def _e5(spark, base):
    return show(select_spaced(cand(spark, base), KEYS, "t", "score", 15.0, 3, ["cand_no"]), *KEYS, "rank", "cand_no", "t", "score")


def snap_sql(events_, by, window=12):
    return f"""SELECT e.*, coalesce(p.t2, e.t) AS moved FROM {events_} e LEFT JOIN (SELECT e.track_id, e.rank, arg_min(c.t, (-c.{by}, c.t)) AS t2
      FROM {events_} e JOIN v_cand c USING (track_id) WHERE abs(c.t - e.t) <= {window} GROUP BY 1, 2) p USING (track_id, rank)"""


SNAPPED = """SELECT work_id, track_id, rank, cand_no, round(moved, 6) AS t,
    CASE WHEN abs(moved - t) > 1e-6 THEN round(t, 6) END AS snapped_from FROM sn"""


def _snap(by, window=12.0):
    def run(spark, base):
        out = ev.snap(events(spark, base), cand(spark, base), KEYS, by, F.col("t"), window)
        return show(out, *KEYS, "rank", "cand_no", "t", "snapped_from")

    return run


def _e8(spark, base):
    return show(ev.threshold_filter(cand(spark, base), "score", 0.4), *KEYS, "cand_no", "score")


def _e9(spark, base):
    tracks = cand(spark, base).select(*KEYS).distinct()
    strong = events(spark, base).filter("score > 0.25")
    return show(ev.track_verdict(strong, tracks, KEYS, "score", ev.TRACK_MIN_PROBABILITY), *KEYS, "has_event", "max_score", "merged_total")


def kde_sql(source, h, kernel, power, prefix="k"):
    """Density per grid cell; sources without positive weight count every candidate as 1."""
    weight = f"CASE WHEN s.total > 0 THEN pow(greatest(score, 0), {power}) ELSE 1e0 END"
    u = f"abs(s.lo + g.cell * 5e-1 - c.t) / {h}::DOUBLE"
    shape = {"tri": f"greatest(1 - {u}, 0)", "gauss": f"exp(-5e-1 * ({u}) * ({u}))",
             "cos": f"CASE WHEN {u} < 1 THEN 5e-1 * (1 + cos(pi() * {u})) ELSE 0 END"}[kernel]
    return {
        f"{prefix}s": f"""SELECT work_id, track_id, min(t) - 5 * {h} AS lo, max(t) + 5 * {h} AS hi, sum(pow(greatest(score, 0), {power})) AS total
          FROM {source} GROUP BY 1, 2""",
        f"{prefix}g": f"SELECT *, unnest(range(ceil((hi - lo) / 5e-1)::BIGINT)) AS cell FROM {prefix}s",
        f"{prefix}d": f"""SELECT g.work_id, g.track_id, g.lo + g.cell * 5e-1 AS t, round(sum({weight} * {shape}), 9) AS density
          FROM {prefix}g g JOIN {prefix}s s ON s.track_id = g.track_id JOIN {source} c ON c.track_id = g.track_id GROUP BY 1, 2, 3""",
        # only the best cell of any 30 s stretch can be picked before others, but all cells stay in the walk
        **spaced_sql(f"{prefix}q", f"{prefix}d", "density", 30, 3),
    }


def _e10(kernel, h, power):
    def run(spark, base):
        return show(ev.kde_select(cand(spark, base), KEYS, h, kernel, power), *KEYS, "rank", "t")

    return run


def _e11(spark, base):
    out = ev.kde_hybrid(cand(spark, base), KEYS, "cand_no", 6, True, h=8.0, kernel="tri", power=2.0)
    return show(out, *KEYS, "rank", "t")


E11 = {
    "tk": f"SELECT * FROM ({NUMBERED.format(source='v_cand')}) WHERE rn <= 6",
    **kde_sql("tk", 8, "tri", 2),
    "sn": snap_sql("kqp", "peak"),
}


def _e12(relocate):
    def run(spark, base):
        out = ev.two_stage(cand(spark, base), KEYS, "cand_no", relocate, 15.0)
        return show(out, *KEYS, "rank", "t", "score")

    return run


def detected(spark, base):
    """The whole detector on the frame view: peaks, features, hand-made score, merge, snap."""
    return detect_events(fx.frames(spark, base), KEYS, 1.0, least=-1.0)


def _e13(spark, base):
    _, out = detected(spark, base)
    return show(out, *KEYS, "rank", "cand_no", "t", "score", "merged", "snapped_from")


def _e13_cues(spark, base):
    """The same with the transcript: the strongest cue said near a candidate is part of its score."""
    _, out = detect_events(fx.frames(spark, base), KEYS, 1.0, least=-1.0, segments=fx.conversation_segments(spark, base), cues=CUES)
    return show(out, *KEYS, "rank", "cand_no", "t", "score", "merged", "snapped_from")


DETECT = {
    "sm": SMOOTH, "lv": LEVELS, "mx": MAXIMA, "ranked": RANKED, "walk": WALK, "pk": PEAKS, "around": AROUND, "lf": LEVEL_SQL,
    "dc": """SELECT work_id, track_id, idx AS cand_no, idx * 1e0 AS t, peak,
      ((pre30 - post2) + 0.25) / 7.702 - (recover - 1.173) / 0.889 + 0.5 * (0 - 0.28) / 0.694 AS score FROM lf""",
    "dk": "SELECT * FROM dc WHERE score >= -1",
    **fold_sql("x", "dk", "rn <= 4"),
    "sn": """SELECT e.*, coalesce(p.t2, e.t) AS moved FROM xx e LEFT JOIN (SELECT e.track_id, e.rank, arg_min(c.t, (-c.peak, c.cand_no)) AS t2
      FROM xx e JOIN dk c USING (track_id) WHERE abs(c.t - e.t) <= 12 GROUP BY 1, 2) p USING (track_id, rank)""",
}


DETECT_CUES = {
    **{k: v for k, v in DETECT.items() if k in ("sm", "lv", "mx", "ranked", "walk", "pk", "around", "lf")},
    "cw": f"""SELECT track_id, "start", {CUE_SQL.format(t='text')} AS w FROM v_conv""",
    "cu": """SELECT lf.track_id, lf.idx, max(w) AS cue FROM lf JOIN cw USING (track_id) WHERE w > 0 AND abs("start" - lf.idx) <= 6 GROUP BY 1, 2""",
    "dc": DETECT["dc"].replace("(0 - 0.28)", "(coalesce(cue, 0) - 0.28)").replace("FROM lf", "FROM lf LEFT JOIN cu USING (track_id, idx)"),
    **{k: v for k, v in DETECT.items() if k not in ("sm", "lv", "mx", "ranked", "walk", "pk", "around", "lf", "dc")},
}
DETECTED = """SELECT work_id, track_id, rank, cand_no, round(moved, 6) AS t, round(score, 6) + 0.0 AS score, merged{wide} AS merged,
    CASE WHEN abs(moved - t) > 1e-6 THEN round(t, 6) END AS snapped_from FROM sn"""


def pairs(spark, base):
    return ev.closest_pairs(cand(spark, base), fx.truth(spark, base), KEYS, "cand_no")


def _e14(spark, base):
    return show(pairs(spark, base), *KEYS, "t1", "t2", "score1", "score2", "kind")


PAIRS = {
    "t3": f"SELECT * FROM ({NUMBERED.format(source='v_cand')}) WHERE rn <= 3",
    "nx": """SELECT work_id, track_id, t AS t1, score AS score1, cand_no AS id1, lead(t) OVER w AS t2, lead(score) OVER w AS score2,
      lead(cand_no) OVER w AS id2 FROM t3 WINDOW w AS (PARTITION BY track_id ORDER BY t)""",
    "pr": """SELECT p.work_id, p.track_id, t1, t2, score1, score2, id1, id2, CASE WHEN a > 0 AND b > 0 AND u >= 2 THEN 'two truths'
      WHEN a > 0 AND b > 0 THEN 'one truth split' ELSE 'contains miss' END AS kind FROM (
      SELECT p.*, count(g.t) FILTER (abs(t1 - g.t) <= 20) AS a, count(g.t) FILTER (abs(t2 - g.t) <= 20) AS b,
        count(DISTINCT g.t) FILTER (abs(t1 - g.t) <= 20 OR abs(t2 - g.t) <= 20) AS u
      FROM (SELECT * FROM nx WHERE t2 - t1 <= 60) p LEFT JOIN v_truth g USING (track_id)
      GROUP BY p.work_id, p.track_id, t1, score1, id1, t2, score2, id2) p""",
}


def _a30(spark, base):
    out = top_per_key(cand(spark, base), KEYS, [F.col("score").desc(), F.col("t")], 5)
    return show(out, *KEYS, "rank", "cand_no", "score")


CASES = {
    "e1_merge_candidates": Case(_e1, sql("v_cand", OUT.format(x="ax"), **E1)),
    "e2_merge_scan_down": Case(_e2, sql("v_cand", OUT.format(x="bx"), **fold_sql("b", "v_cand", top=3))),
    "e3_merge_nearest_rep": Case(
        _e3("mean"), sql("v_cand", OUT.format(x="cx"), **fold_sql("c", "v_cand", top=3, nearest=True, stops=True))
    ),
    "e3_merge_nearest_best": Case(
        _e3("best"), sql("v_cand", OUT.format(x="dx"), **fold_sql("d", "v_cand", top=3, nearest=True, mode="best", stops=True))
    ),
    "e3_merge_nearest_weighted": Case(
        _e3("weighted"),
        sql("v_cand", OUT.format(x="fx"), **fold_sql("f", "v_cand", top=3, nearest=True, mode="weighted", stops=True)),
    ),
    "e4_merge_chain": Case(
        _e4,
        sql(
            "v_cand",
            "SELECT work_id, track_id, rank, round(t, 6) AS t, round(score, 6) AS score, members FROM sp",
            **CHAIN,
            **spaced_sql("s", "grp", "score", 15, 3),
        ),
    ),
    "e5_select_spaced": Case(
        _e5,
        sql(
            "v_cand",
            "SELECT work_id, track_id, rank, cand_no, round(t, 6) AS t, round(score, 6) AS score FROM sp",
            **spaced_sql("s", "v_cand", "score", 15, 3),
        ),
    ),
    "e6_snap_to_level": Case(_snap("peak"), sql("v_cand", SNAPPED, **E1, sn=snap_sql("ax", "peak"))),
    "e7_snap_to_score": Case(_snap("ref_score"), sql("v_cand", SNAPPED, **E1, sn=snap_sql("ax", "ref_score"))),
    "e8_threshold_filter": Case(
        _e8, sql("v_cand", "SELECT work_id, track_id, cand_no, round(score, 6) AS score FROM v_cand WHERE score >= 4e-1")
    ),
    "e9_track_verdict": Case(
        _e9,
        sql(
            "v_cand",
            """SELECT t.work_id, t.track_id, coalesce(max(score) >= 3e-1, false) AS has_event, round(max(score), 6) AS max_score,
            coalesce(sum(merged), 0)::BIGINT AS merged_total FROM (SELECT DISTINCT work_id, track_id FROM v_cand) t
            LEFT JOIN (SELECT * FROM ax WHERE score > 0.25) a USING (track_id) GROUP BY 1, 2""",
            **E1,
        ),
    ),
    "e10_kde_select": Case(
        _e10("tri", 10.0, 1.0),
        sql("v_cand", "SELECT work_id, track_id, rank, round(t, 6) AS t FROM kqp", **kde_sql("v_cand", 10, "tri", 1)),
    ),
    "e10_kde_select_gauss": Case(
        _e10("gauss", 4.0, 2.0),
        sql("v_cand", "SELECT work_id, track_id, rank, round(t, 6) AS t FROM kqp", **kde_sql("v_cand", 4, "gauss", 2)),
    ),
    "e11_kde_hybrid": Case(_e11, sql("v_cand", "SELECT work_id, track_id, rank, round(moved, 6) AS t FROM sn", **E11)),
    "e12_two_stage": Case(
        _e12("ref_score"),
        sql(
            "v_cand",
            "SELECT work_id, track_id, rank, round(moved, 6) AS t, round(score, 6) AS score FROM sn",
            **E1,
            sn=snap_sql("ax", "ref_score", 15),
        ),
    ),
    "e12_two_stage_none": Case(
        _e12(None),
        sql("v_cand", "SELECT work_id, track_id, rank, round(t, 6) AS t, round(score, 6) AS score FROM ax", **E1),
    ),
    "e13_detect_events": Case(
        _e13,
        sql(
            "v_frames",
            """SELECT work_id, track_id, rank, cand_no, round(moved, 6) AS t, round(score, 6) + 0.0 AS score, merged,
            CASE WHEN abs(moved - t) > 1e-6 THEN round(t, 6) END AS snapped_from FROM sn""",
            **DETECT,
        ),
    ),
    "e13_detect_events_cues": Case(_e13_cues, sql("v_frames v_conv", DETECTED.format(wide="::BIGINT"), **DETECT_CUES)),
    "e14_closest_pairs": Case(
        _e14,
        sql(
            "v_cand v_truth",
            """SELECT work_id, track_id, round(t1, 6) AS t1, round(t2, 6) AS t2, round(score1, 6) AS score1, round(score2, 6) AS score2, kind FROM pr""",
            **PAIRS,
        ),
    ),
    "a30_top_k_per_group": Case(
        _a30,
        sql(
            "v_cand",
            """SELECT * FROM (SELECT work_id, track_id, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, t) AS rank, cand_no,
            round(score, 6) AS score FROM v_cand) WHERE rank <= 5""",
        ),
    ),
}

"""Sweeps of the rules that select events, each setting with its own SQL twin."""

from __future__ import annotations

from tidemark.catalog.base import Case, show, sql
from tidemark.catalog.events import E1, events, kde_sql, snap_sql, spaced_sql
from tidemark.catalog.joins import MATCH
from tidemark.catalog.metrics import V3, cand, labelled, truth
from tidemark.catalog.signal import KEYS
from tidemark.operators import sweeps as sw

MERGE = [(0.0, 15.0), (0.0, 60.0), (2.0, 15.0), (6.0, 15.0)]
WIDTHS, POWERS, KERNELS = [5.0, 10.0], [1.0, 3.0], ["tri", "cos"]
WINDOWS = [0.0, 6.0, 12.0, 25.0]
TOPS = [1, 2, 3]


def judged(spark, base, picked, settings):
    out = sw.judge_settings(picked, settings, truth(spark, base), labelled(spark, base), KEYS)
    return show(out, *settings, "outputs", "hits", "precision", "recall", "mean_abs", "within_5")


def _merge(spark, base):
    return judged(spark, base, sw.sweep_merge(cand(spark, base), KEYS, "cand_no", MERGE), ["mode", "merge", "gap"])


def _kernel(spark, base):
    return judged(spark, base, sw.sweep_kernel(cand(spark, base), KEYS, KERNELS, WIDTHS, POWERS), ["kernel", "h", "power"])


def _snap(spark, base):
    return judged(spark, base, sw.sweep_snap(events(spark, base), cand(spark, base), KEYS, "peak", WINDOWS), ["window"])


def _top(spark, base):
    return judged(spark, base, sw.sweep_top(events(spark, base), TOPS), ["top"])


def judged_sql(settings, parts, **ctes):
    """``parts`` are selects of (settings, track_id, t)."""
    names = ", ".join(f'"{s}"' for s in settings)
    return sql(
        V3,
        f"""SELECT {names}, outputs, hits, round(hits / outputs::DOUBLE, 6) AS precision, round(recall, 6) AS recall, round(mean_abs, 6) AS mean_abs, round(within_5, 6) AS within_5
          FROM (SELECT {names}, count(*) AS outputs, count(*) FILTER (d <= 20) AS hits, avg(d) FILTER (d <= 20) AS mean_abs,
            avg((d <= 5)::INT) FILTER (d <= 20) AS within_5 FROM (SELECT x.*, (SELECT min(abs(g.t - x.t)) FROM lg g WHERE g.track_id = x.track_id) AS d FROM al x) GROUP BY ALL)
          JOIN (SELECT {names}, avg(c::INT) AS recall FROM (SELECT l.*, EXISTS (SELECT 1 FROM al x WHERE {" AND ".join(f'x."{s}" = l."{s}"' for s in settings)}
            AND x.track_id = l.track_id AND abs(x.t - l.t) <= 20) AS c FROM (SELECT * FROM (SELECT DISTINCT {names} FROM al), lg) l) GROUP BY ALL) USING ({names})""",
        **ctes,
        lg=MATCH["gt"],
        al="SELECT * FROM (" + " UNION ALL ".join(parts) + ") SEMI JOIN v_labelled USING (track_id)",
    )


def merge_sql():
    ctes, parts = {}, []
    for i, (merge, gap) in enumerate(MERGE):
        ctes[f"i{i}"] = f"""SELECT *, sum(CASE WHEN t - p <= {merge} THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t, cand_no) AS grp
          FROM (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t, cand_no) AS p FROM v_cand)"""
        for mode, time in (("mean", "avg(t)"), ("best", "arg_max(t, (score, -t))")):
            name = f"{mode[0]}{i}"
            ctes[f"{name}g"] = f"SELECT work_id, track_id, {time} AS t, max(score) AS score FROM i{i} GROUP BY work_id, track_id, grp"
            ctes |= spaced_sql(f"{name}s", f"{name}g", "score", gap, 3)
            parts.append(f"SELECT '{mode}' AS mode, {merge}::DOUBLE AS merge, {gap}::DOUBLE AS gap, track_id, t FROM {name}sp")
    return judged_sql(["mode", "merge", "gap"], parts, **ctes)


def kernel_sql():
    ctes, parts = {}, []
    for k, kernel in enumerate(KERNELS):
        for i, h in enumerate(WIDTHS):
            for j, power in enumerate(POWERS):
                name = f"k{k}{i}{j}"
                ctes |= kde_sql("v_cand", h, kernel, power, name)
                parts.append(f"SELECT '{kernel}' AS kernel, {h}::DOUBLE AS h, {power}::DOUBLE AS power, track_id, t FROM {name}qp")
    return judged_sql(["kernel", "h", "power"], parts, **ctes)


def snaps_sql():
    ctes = {f"n{int(w)}": snap_sql("ax", "peak", w) for w in WINDOWS if w}
    parts = [f"SELECT {w}::DOUBLE AS \"window\", track_id, " + (f"moved AS t FROM n{int(w)}" if w else "t FROM ax") for w in WINDOWS]
    return judged_sql(["window"], parts, **E1, **ctes)


CASES = {
    "a32_sweep_merge": Case(_merge, merge_sql()),
    "a32_sweep_kernel": Case(_kernel, kernel_sql()),
    "a32_sweep_snap": Case(_snap, snaps_sql()),
    "a32_sweep_top": Case(_top, judged_sql(["top"], [f"SELECT {k}::BIGINT AS top, track_id, t FROM ax WHERE rank <= {k}" for k in TOPS], **E1)),
}

"""Model queries over labelled candidates; settings of learners are parameters, those of m6, m9 and m12 the shipped ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import Case, show, sql
from tidemark.catalog.events import DETECT, fold_sql
from tidemark.catalog.metrics import HITS, V3, hits
from tidemark.catalog.signal import KEYS, PLACES, W18_FULL, candidates, feats_sql, model_rows
from tidemark.functions.scores import distance_weight, hard_label, soft_target
from tidemark.operators import models as md
from tidemark.operators import ridge as rg
from tidemark.operators.metrics import auc
from tidemark.operators.signal import FEATURES
from tidemark.plans.pipelines import detect_with_model
from tidemark.session import cut, scratch_path

FEATS = ["score", "ref_score", "t"]
SMALL = {"numTrees": 10, "minInstancesPerNode": 5, "maxDepth": 4, "seed": 0}


def rows(spark, base):
    """The training table, written once: every fold and learner reads it again."""
    labels = F.when(F.col("hit"), 1.0).otherwise(0.0)
    return cut(hits(spark, base).withColumn("label", labels).withColumn("fold", F.col("work_id") % 3))


def logistic():
    return {"lr": md.classifiers()["lr"]}


def small():
    return md.classifiers(
        forest={"numTrees": 10, "minInstancesPerNode": 5, "maxDepth": 4}, boosting={"maxIter": 5, "stepSize": 0.1, "maxDepth": 3}
    )


def _m1(spark, base):
    out = md.training_set(
        candidates(spark, base), fx.truth(spark, base), fx.labelled(spark, base), KEYS, ["peak", "pre30", "signature", "rise"], 1.0
    )
    return show(out, *KEYS, "t", "peak", "pre30", "signature", "rise", "dist", "label")


M1 = feats_sql(
    """SELECT work_id, track_id, idx * 1e0 AS t, round(peak, 6) + 0.0 AS peak, round(pre30, 6) + 0.0 AS pre30, round(pre30 - post2, 6) + 0.0 AS signature,
      rise, round(d, 6) AS dist, CASE WHEN d <= 20 THEN 1e0 ELSE 0e0 END AS label
    FROM (SELECT lf.*, ef.rise, (SELECT min(abs(g.t - lf.idx)) FROM v_truth g WHERE g.track_id = lf.track_id) AS d FROM lf JOIN ef USING (work_id, track_id, idx)
      WHERE n_frames >= 60 AND lf.track_id IN (SELECT track_id FROM v_labelled))"""
)


def _m1_sql():
    extra = sql("v_truth v_labelled", "")
    return M1.replace("WITH RECURSIVE ", extra.strip() + ",\n", 1)


def _m1_full(spark, base):
    """All 21 features of every candidate of a labelled track."""
    out = md.training_set(model_rows(spark, base), fx.truth(spark, base), fx.labelled(spark, base), KEYS, FEATURES, 1.0)
    return show(out.select(*KEYS, "t", *[F.round(c, PLACES.get(c, 3)).alias(c) for c in FEATURES], "dist", "label"), *KEYS, "t", *FEATURES, "dist", "label")


M1_FULL = sql(
    "v_truth v_labelled",
    f"""SELECT work_id, track_id, idx * 1e0 AS t, {', '.join(FEATURES)}, round(d, 6) AS dist,
      CASE WHEN d <= 20 THEN 1e0 ELSE 0e0 END AS label
    FROM (SELECT r.*, (SELECT min(abs(g.t - r.idx)) FROM v_truth g WHERE g.track_id = r.track_id) AS d FROM fullrow r
      WHERE r.track_id IN (SELECT track_id FROM v_labelled) AND r.track_id IN (SELECT track_id FROM framecount WHERE c >= 60))""",
    framecount="SELECT track_id, count(*) AS c FROM (" + sql("v_frames", "SELECT track_id FROM v_frames") + ") GROUP BY 1",
    fullrow=W18_FULL,
)


def _fitted(spark, base):
    data = rows(spark, base)
    return data, md.fit_classifiers(data, FEATS, small())


def _m2(spark, base):
    """Probability of every learner, and their mean, at every candidate."""
    data, models = _fitted(spark, base)
    out = md.apply_models(data, models).withColumn("score", md.ensemble_score(["p_rf", "p_gbt", "p_lr"]))
    return out.select(*KEYS, "cand_no", "p_rf", "p_gbt", "p_lr", "score")


def _m3(spark, base):
    data = rows(spark, base)
    small_ = {"numTrees": 10, "minInstancesPerNode": 5, "maxDepth": 4}
    models = md.fit_refiners(data, FEATS, 5.0, small_, {"maxIter": 5, "maxDepth": 3})
    scored = md.apply_models(data, models, "r_").withColumn("refine", md.ensemble_score([f"r_{n}" for n in models]))
    return scored.select(*KEYS, "cand_no", "r_rf", "r_gbt", "r_ridge", "refine")


def _m4(spark, base):
    data = fx.candidates(spark, base).withColumn("mixed", md.ensemble_score(["score", "ref_score"], [1.0, 3.0]))
    return show(data, *KEYS, "cand_no", "mixed")


def _m5(spark, base):
    """Isotonic regression of the label on a coarse score, at every candidate."""
    data = rows(spark, base).withColumn("coarse", F.round(F.col("peak") / 20) * 20.0)
    out = md.calibrate(data, md.fit_calibrator(data, "coarse"), "coarse")
    return show(out, *KEYS, "cand_no", "probability")


M5 = sql(
    V3,
    """SELECT work_id, track_id, cand_no, round(least(greatest(c.v, 0), 95e-2), 6) + 0.0 AS probability
      FROM hd JOIN c ON c.x = round(hd.peak / 20) * 2e1""",
    **HITS,
    d="""SELECT round(peak / 20) * 2e1 AS x, sum(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS y, count(*) AS n FROM hd GROUP BY 1""",
    s="SELECT x, y, n, row_number() OVER (ORDER BY x) AS i, sum(y) OVER (ORDER BY x) AS sy, sum(n) OVER (ORDER BY x) AS sn FROM d",
    jk="SELECT j.i AS j, k.i AS k, (k.sy - j.sy + j.y) / (k.sn - j.sn + j.n) AS mean FROM s j JOIN s k ON k.i >= j.i",
    ji="SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM jk",
    c="SELECT s.x, max(low) AS v FROM ji JOIN s USING (i) GROUP BY 1",
)


def _held_out(spark, base):
    data = rows(spark, base)
    return md.leave_one_group_out(data, "work_id", md.scorer(FEATS, logistic))


def mean_label(training):
    """The plainest learner: every row gets the mean label of the training rows."""
    mean = training.agg(F.avg("label").alias("score"))
    return lambda held: held.drop("score").join(mean.withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k")).drop("_k")


def _m6(spark, base):
    out = md.leave_one_group_out(rows(spark, base), "work_id", mean_label)
    return show(out, *KEYS, "cand_no", "score")


M6 = sql(
    V3,
    """SELECT work_id, track_id, cand_no, round((hits_all - hits_own) / (rows_all - rows_own), 6) + 0.0 AS score
      FROM (SELECT work_id, track_id, cand_no, sum(hit::INT) OVER () AS hits_all, count(*) OVER () AS rows_all,
        sum(hit::INT) OVER (PARTITION BY work_id) AS hits_own, count(*) OVER (PARTITION BY work_id) AS rows_own FROM hd)
      WHERE hits_own > 0""",
    **HITS,
)


def _m6_learners(spark, base):
    """Score of every candidate by the ensemble as shipped, fitted on all other works; every work with labelled tracks is held out."""
    data = rows(spark, base)
    fit = md.scorer(FEATS, md.shipped_classifiers)

    def settled(training):
        score = fit(training)
        return lambda held: cut(score(held))  # so that the models of a fold go before the next one's come

    works = [r[0] for r in data.select("work_id").distinct().collect()]
    return md.leave_one_group_out(data, "work_id", settled, works, threads=spark.sparkContext.defaultParallelism).select(*KEYS, "cand_no", "score")


def standardised(training):
    """One feature, standardised by the training rows, through a sigmoid."""
    stats = training.agg(F.avg("peak").alias("_m"), F.stddev_pop("peak").alias("_s")).withColumn("_k", F.lit(1))
    score = 1 / (1 + F.exp(-(F.col("peak") - F.col("_m")) / F.col("_s")))
    return lambda held: held.join(stats, F.lit(1) == F.col("_k")).withColumn("score", score).drop("_k", "_m", "_s")


def _m7(spark, base):
    out = md.in_sample_vs_held_out(rows(spark, base), "fold", standardised)
    return show(out, "method", "positives", "negatives", "auc", "precision", "recall")


def _qualities(source):
    return f"""SELECT count(*) FILTER (hit) AS positives, count(*) FILTER (NOT hit) AS negatives,
        (SELECT avg(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 5e-1 ELSE 0e0 END) FROM {source} a JOIN {source} b ON a.hit AND NOT b.hit) AS auc,
        avg(hit::INT) FILTER (score >= 5e-1) AS precision, avg((score >= 5e-1)::INT) FILTER (hit) AS recall FROM {source}"""


_SIGMOID = "1 / (1 + exp(-(peak - m) / s))"
M7 = sql(
    V3,
    f"""SELECT method, positives, negatives, round(auc, 6) AS auc, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (
      SELECT 'in sample' AS method, * FROM ({_qualities('seen')}) UNION ALL SELECT 'held out', * FROM ({_qualities('unseen')}))""",
    **HITS,
    seen=f"SELECT hit, {_SIGMOID} AS score FROM hd, (SELECT avg(peak) AS m, stddev_pop(peak) AS s FROM hd)",
    unseen=f"""SELECT hit, {_SIGMOID} AS score FROM hd JOIN (SELECT f.fold, avg(peak) AS m, stddev_pop(peak) AS s
      FROM (SELECT DISTINCT work_id % 3 AS fold FROM hd) f JOIN hd ON hd.work_id % 3 <> f.fold GROUP BY 1) t ON t.fold = hd.work_id % 3""",
)


def _m8(spark, base):
    return md.ablate(rows(spark, base), "fold", FEATS, logistic, [["t"]])


def _m9(spark, base):
    return md.compare_algorithms(rows(spark, base), "fold", FEATS, "score", md.shipped_classifiers)


def _m9_baseline(spark, base):
    return show(md.single_feature_scores(rows(spark, base), "peak"), *KEYS, "cand_no", "score")


def _m10(spark, base):
    return md.train_modes(rows(spark, base), "fold", FEATS, logistic)


def _m11(spark, base):
    data = rows(spark, base)
    grid = {"numTrees": [5], "maxDepth": [2, 4]}
    return md.tune(data, "fold", FEATS, grid, [0, 1, 2])


def _m12(spark, base):
    """Importances in the forest as shipped, fitted on all rows."""
    models = md.fit_classifiers(fx.spread(rows(spark, base)), FEATS, {"rf": md.shipped_classifiers()["rf"]})
    return md.feature_importance(models["rf"], FEATS, spark)


def _m13(spark, base):
    out = md.rank_average(fx.candidates(spark, base), ["work_id"], ["score", "ref_score"], "cand_no", "mixed")
    return show(out, *KEYS, "cand_no", "mixed")


def _m13_stack(spark, base):
    data = rows(spark, base)
    weights = md.auc_weighted(data, ["score", "ref_score"])
    stacked = md.apply_models(data, {"s": md.stack_scores(data, ["score", "ref_score"])})
    blend = md.ensemble_score(["score", "ref_score"], [w + 1e-6 for w in weights])
    return stacked.select(*KEYS, "cand_no", F.col("p_s").alias("stacked"), blend.alias("blended"))


def _m13_grid(spark, base):
    """Area of the best blend on the grid; the single columns are among its points."""
    data = rows(spark, base).withColumn("_all", F.lit(1)).withColumn("hit", F.col("label") > 0)
    weights = md.best_grid_weights(data, ["score", "ref_score"], 4)
    out = auc(data.withColumn("_s", md.ensemble_score(["score", "ref_score"], weights)), ["_all"], "_s", "hit")
    return show(out, "auc")


M13_GRID = sql(
    V3,
    """SELECT round(max(auc), 6) AS auc FROM (SELECT w, avg(CASE WHEN a.s > b.s THEN 1e0 WHEN a.s = b.s THEN 5e-1 ELSE 0e0 END) AS auc
      FROM bl a JOIN bl b USING (w) WHERE a.hit AND NOT b.hit GROUP BY 1)""",
    **HITS,
    bl="SELECT hit, w, score * (w / 4e0) + ref_score * ((4 - w) / 4e0) AS s FROM hd, range(5) r(w)",
)


def _m14(spark, base):
    """Scores of a reloaded model against those of the model that was saved."""
    data = rows(spark, base)
    model = md.fit_classifiers(data, FEATS, logistic())["lr"]
    path = scratch_path(spark, "model")
    counts = data.agg(F.count("*").alias("rows"), F.sum("label").alias("positives")).first().asDict()
    held = md.quality(md.leave_one_group_out(data, "fold", md.scorer(FEATS, logistic))).first().asDict()
    info = {**counts, "held_out": held, "settings": {"c": md.LOGISTIC_C}}
    md.save_model(model, path, FEATS, info, spark)
    again, meta = md.load_model(path, FEATS, spark)
    both = md.apply_models(md.apply_models(data, {"lr": model}), {"lr": again}, "q_")
    told = [F.lit(float(v or 0.0)).alias(n) for n, v in (("rows", meta["rows"]), ("positives", meta["positives"]), ("held_out_auc", meta["held_out"]["auc"]))]
    return both.select(*KEYS, "cand_no", F.col("p_lr").alias("saved"), F.col("q_lr").alias("loaded"), *told)


def _m15(spark, base):
    data = rows(spark, base)
    model = md.fit_classifiers(data, FEATS, logistic())["lr"]
    record = md.quality(_held_out(spark, base)).first().asDict()
    return md.in_sample_audit(data, model, record)


# Closed-form learners: real values that SQL can repeat.

RIDGE = 0.1


def _m3_ridge(spark, base):
    """Refine score of every candidate: ridge regression on the soft distance target."""
    out = rg.fit_ridge(rows(spark, base), FEATS, soft_target(F.col("dist"), 5.0), RIDGE, out="refine")
    return show(out, *KEYS, "cand_no", "refine")


def _m6_ridge(spark, base):
    return show(rg.held_out_ridge(rows(spark, base), "work_id", FEATS, penalty=RIDGE), *KEYS, "cand_no", "score")


DROP = [["t"], ["score"], ["score", "t"]]


def _m8_ridge(spark, base):
    out = rg.ablate_ridge(rows(spark, base), "work_id", FEATS, DROP, RIDGE)
    return show(out, "features_used", "positives", "negatives", "auc", "precision", "recall")


def _m10_ridge(spark, base):
    """Plain training, weights that fade with the distance, and strict labels; always judged by the plain label."""
    data = rows(spark, base)
    soft = distance_weight(F.col("dist"), F.col("label") > 0, 5.0)
    modes = {"plain": (None, None), "weighted": (None, soft), "strict": (hard_label(F.col("dist"), 5.0), None)}
    parts = [rg.held_out_ridge(data, "work_id", FEATS, target, RIDGE, weight).withColumn("method", F.lit(name)) for name, (target, weight) in modes.items()]
    scored = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return show(rg.quality_by(scored, ["method"], 0.05), "method", "positives", "negatives", "auc", "precision", "recall")


def _ridge_sql(name, models, x=("score", "ref_score", "t")):
    """A ridge model for each row of ``models`` (g, excluded work or null, k1 to k3 features in use), solved by Cramer's rule: a(g, y, w)
    holds the training rows, ``name``_m the coefficients."""
    sums = ", ".join(f"sum(w * {c}) / sum(w) AS m{i}, sqrt(sum(w * {c} * {c}) / sum(w) - (sum(w * {c}) / sum(w)) ** 2) AS s{i}, sum(w * {c} * y) / sum(w) AS q{i}" for i, c in enumerate(x, 1))
    cross = ", ".join(f"sum(w * {x[i - 1]} * {x[j - 1]}) / sum(w) AS p{i}{j}" for i, j in ((1, 2), (1, 3), (2, 3)))
    return {
        f"{name}_g": models,
        f"{name}_s": f"SELECT g, any_value(k1) AS k1, any_value(k2) AS k2, any_value(k3) AS k3, sum(w * y) / sum(w) AS my, {sums}, {cross} FROM {name}_g GROUP BY g",
        f"{name}_r": f"""SELECT *, {1 + RIDGE} AS a, k1 * k2 * (p12 - m1 * m2) / (s1 * s2) AS r12, k1 * k3 * (p13 - m1 * m3) / (s1 * s3) AS r13,
          k2 * k3 * (p23 - m2 * m3) / (s2 * s3) AS r23, k1 * (q1 - m1 * my) / s1 AS c1, k2 * (q2 - m2 * my) / s2 AS c2, k3 * (q3 - m3 * my) / s3 AS c3 FROM {name}_s""",
        f"{name}_d": f"SELECT *, a * (a * a - r23 * r23) - r12 * (r12 * a - r23 * r13) + r13 * (r12 * r23 - a * r13) AS det FROM {name}_r",
        f"{name}_m": f"""SELECT g, my, m1, m2, m3, (c1 * (a * a - r23 * r23) - r12 * (c2 * a - r23 * c3) + r13 * (c2 * r23 - a * c3)) / det / s1 AS b1,
          (a * (c2 * a - r23 * c3) - c1 * (r12 * a - r23 * r13) + r13 * (r12 * c3 - c2 * r13)) / det / s2 AS b2,
          (a * (a * c3 - c2 * r23) - r12 * (r12 * c3 - c2 * r13) + c1 * (r12 * r23 - a * r13)) / det / s3 AS b3 FROM {name}_d""",
    }


_VALUE = "my + b1 * (h.score - m1) + b2 * (h.ref_score - m2) + b3 * (h.t - m3)"
_OTHERS = "FROM (SELECT DISTINCT work_id FROM hd WHERE hit) o JOIN hd ON hd.work_id <> o.work_id"
M3_RIDGE = sql(
    V3,
    f"SELECT work_id, track_id, cand_no, round({_VALUE}, 6) + 0.0 AS refine FROM hd h, r_m",
    **HITS,
    **_ridge_sql("r", "SELECT 1 AS g, 1 AS k1, 1 AS k2, 1 AS k3, hd.*, 1e0 AS w, coalesce(exp(-((dist / 5) ** 2)), 0) AS y FROM hd"),
)
M6_RIDGE = sql(
    V3,
    f"SELECT work_id, track_id, cand_no, round({_VALUE}, 6) + 0.0 AS score FROM hd h JOIN r_m ON g = work_id",
    **HITS,
    **_ridge_sql("r", f"SELECT o.work_id AS g, 1 AS k1, 1 AS k2, 1 AS k3, hd.*, 1e0 AS w, hit::INT::DOUBLE AS y {_OTHERS}"),
)


def _by_method(column, limit):
    """Qualities of rows ``sc(method, hit, v)``."""
    return f"""SELECT method AS {column}, count(*) FILTER (hit) AS positives, count(*) FILTER (NOT hit) AS negatives, round(any_value(area), 6) AS auc,
      round(avg(hit::INT) FILTER (v >= {limit}), 6) AS precision, round(avg((v >= {limit})::INT) FILTER (hit), 6) AS recall
      FROM sc JOIN (SELECT method, avg(CASE WHEN a.v > b.v THEN 1e0 WHEN a.v = b.v THEN 5e-1 ELSE 0e0 END) AS area FROM sc a JOIN sc b USING (method)
        WHERE a.hit AND NOT b.hit GROUP BY 1) USING (method) GROUP BY 1"""


M8_RIDGE = sql(
    V3,
    _by_method("features_used", "5e-1"),
    **HITS,
    ks="SELECT * FROM (VALUES ('all', 1, 1, 1), ('without t', 1, 1, 0), ('without score', 0, 1, 1), ('without score,t', 0, 1, 0)) k(method, k1, k2, k3)",
    **_ridge_sql("r", f"SELECT (method, o.work_id) AS g, k1, k2, k3, hd.*, 1e0 AS w, hit::INT::DOUBLE AS y {_OTHERS}, ks"),
    sc=f"SELECT method, hit, {_VALUE} AS v FROM hd h, ks JOIN r_m ON g = (method, h.work_id)",
)
M10_RIDGE = sql(
    V3,
    _by_method("method", "5e-2"),
    **HITS,
    ks="SELECT * FROM (VALUES ('plain'), ('weighted'), ('strict')) k(method)",
    **_ridge_sql(
        "r",
        f"""SELECT (method, o.work_id) AS g, 1 AS k1, 1 AS k2, 1 AS k3, hd.*, CASE WHEN method = 'weighted' AND hit THEN exp(-((dist / 5) ** 2)) ELSE 1e0 END AS w,
          CASE WHEN method = 'strict' THEN coalesce(dist <= 5, false) ELSE hit END::INT::DOUBLE AS y {_OTHERS}, ks""",
    ),
    sc=f"SELECT method, hit, {_VALUE} AS v FROM hd h, ks JOIN r_m ON g = (method, h.work_id)",
)


# The detector by models: ridge for the score and for the place, on the frame view.

SHAPES = ["peak", "pre30", "recover"]
LONG = 600


def _detected(spark, base):
    found = candidates(spark, base).withColumn("cand_no", F.col("idx"))
    trained = cut(md.training_set(found, fx.truth(spark, base), fx.labelled(spark, base), KEYS, SHAPES, 1.0))
    predict = rg.ridge_scorer(trained, SHAPES, F.col("label"), RIDGE)
    refine = rg.ridge_scorer(trained, SHAPES, soft_target(F.col("dist"), 5.0), RIDGE, out="ref_score")
    tracks = fx.frames(spark, base).groupBy(*KEYS).agg(F.count("*").alias("n_frames"))
    return detect_with_model(found, tracks, KEYS, 1.0, predict, refine=refine, least=0.05, shortest=LONG)


def _e13_model(spark, base):
    _, out, _ = _detected(spark, base)
    return show(out, *KEYS, "rank", "cand_no", "t", "score", "probability", "confidence", "merged", "snapped_from")


def _e13_verdicts(spark, base):
    _, _, out = _detected(spark, base)
    return show(out, *KEYS, "status", "has_event", "max_score", "merged_total")


_SHAPED = "my + b1 * (lf.peak - m1) + b2 * (lf.pre30 - m2) + b3 * (lf.recover - m3)"
DETECT_MODEL = {
    **{k: DETECT[k] for k in ("sm", "lv", "mx", "ranked", "walk", "pk", "around", "lf")},
    "tr": """SELECT lf.*, (SELECT min(abs(g.t - lf.idx)) FROM v_truth g WHERE g.track_id = lf.track_id) AS d FROM lf
      WHERE n_frames >= 60 AND track_id IN (SELECT track_id FROM v_labelled)""",
    **_ridge_sql("r", "SELECT 1 AS g, 1 AS k1, 1 AS k2, 1 AS k3, tr.*, 1e0 AS w, coalesce(d <= 20, false)::INT::DOUBLE AS y FROM tr", SHAPES),
    **_ridge_sql("q", "SELECT 1 AS g, 1 AS k1, 1 AS k2, 1 AS k3, tr.*, 1e0 AS w, coalesce(exp(-((d / 5) ** 2)), 0) AS y FROM tr", SHAPES),
    "sc": f"SELECT work_id, track_id, idx, {_SHAPED} AS score FROM lf, r_m WHERE n_frames >= {LONG}",
    "rf": f"SELECT track_id, idx, {_SHAPED} AS ref_score FROM lf, q_m",
    "dk": """SELECT work_id, track_id, idx AS cand_no, idx * 1e0 AS t, score, ref_score, least(greatest(score, 0), 95e-2) AS probability
      FROM sc JOIN rf USING (track_id, idx) WHERE least(greatest(score, 0), 95e-2) >= 5e-2""",
    **fold_sql("x", "dk", "rn <= 4"),
    "sn": """SELECT e.*, k.probability, coalesce(p.t2, e.t) AS moved FROM xx e JOIN dk k USING (track_id, cand_no) LEFT JOIN (
      SELECT e.track_id, e.rank, arg_min(c.t, (-c.ref_score, c.cand_no)) AS t2
      FROM xx e JOIN dk c USING (track_id) WHERE abs(c.t - e.t) <= 12 GROUP BY 1, 2) p USING (track_id, rank)""",
}
E13_MODEL = sql(
    "v_frames v_truth v_labelled",
    """SELECT work_id, track_id, rank, cand_no, round(moved, 6) AS t, round(score, 6) + 0.0 AS score, round(probability, 6) + 0.0 AS probability,
      CASE WHEN probability >= 6e-1 THEN 'high' WHEN probability >= 3e-1 THEN 'mid' ELSE 'low' END AS confidence, merged::BIGINT AS merged,
      CASE WHEN abs(moved - t) > 1e-6 THEN round(t, 6) END AS snapped_from FROM sn""",
    **DETECT_MODEL,
)
E13_VERDICTS = sql(
    "v_frames v_truth v_labelled",
    f"""SELECT f.work_id, f.track_id, CASE WHEN n >= {LONG} THEN 'ok' ELSE 'short' END AS status, coalesce(p >= 3e-1, false) AS has_event,
      round(p, 6) + 0.0 AS max_score, coalesce(m, 0)::BIGINT AS merged_total FROM (SELECT work_id, track_id, count(*) AS n FROM v_frames GROUP BY 1, 2) f
      LEFT JOIN (SELECT track_id, max(probability) AS p, sum(merged) AS m FROM sn GROUP BY 1) USING (track_id)""",
    **DETECT_MODEL,
)


CASES = {
    "e13_detect_with_model": Case(_e13_model, E13_MODEL),
    "e13_model_verdicts": Case(_e13_verdicts, E13_VERDICTS),
    "m1_build_training_set": Case(_m1, _m1_sql()),
    "m1_build_training_set_full": Case(_m1_full, M1_FULL),
    "m2_fit_classifiers": Case(_m2),
    "m3_fit_refiners": Case(_m3),
    "m3_refine_ridge": Case(_m3_ridge, M3_RIDGE),
    "m4_ensemble_score": Case(
        _m4, sql("v_cand", "SELECT work_id, track_id, cand_no, round((score + 3 * ref_score) / 4, 6) AS mixed FROM v_cand")
    ),
    "m5_calibrate": Case(_m5, M5),
    "m6_leave_one_group_out": Case(_m6, M6),
    "m6_leave_one_group_out_learners": Case(_m6_learners),
    "m6_leave_one_group_out_ridge": Case(_m6_ridge, M6_RIDGE),
    "m7_in_sample_vs_logo": Case(_m7, M7),
    "m8_ablate": Case(_m8),
    "m8_ablate_ridge": Case(_m8_ridge, M8_RIDGE),
    "m9_compare_algorithms": Case(_m9),
    "m9_single_feature_baseline": Case(
        _m9_baseline,
        sql(
            V3,
            """SELECT work_id, track_id, cand_no, round(1 / (1 + exp(-(peak - avg(peak) OVER ()) / stddev_pop(peak) OVER ())), 6) AS score FROM hd""",
            **HITS,
        ),
    ),
    "m10_train_modes": Case(_m10),
    "m10_train_modes_ridge": Case(_m10_ridge, M10_RIDGE),
    "m11_tune": Case(_m11),
    "m12_feature_importance": Case(_m12),
    "m13_rank_average": Case(
        _m13,
        sql(
            "v_cand",
            """SELECT work_id, track_id, cand_no, round(((row_number() OVER (PARTITION BY work_id ORDER BY score, cand_no) - 1)
              + (row_number() OVER (PARTITION BY work_id ORDER BY ref_score, cand_no) - 1)) / greatest(1, count(*) OVER (PARTITION BY work_id) - 1)::DOUBLE / 2, 6) AS mixed
            FROM v_cand""",
        ),
    ),
    "m13_ensembling_variants": Case(_m13_stack),
    "m13_grid_weights": Case(_m13_grid, M13_GRID),
    "m14_save_and_load": Case(_m14),
    "m15_in_sample_audit": Case(_m15),
}

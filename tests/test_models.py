"""Ridge from removable statistics against numpy, and learners against a baseline on planted labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.check import compare, duck
from tidemark.catalog import cases
from tidemark.operators import models as md
from tidemark.operators import ridge as rg

BASE = "/root/testdata/sf0.001"
FEATS = ["a", "b", "c"]


@pytest.mark.parametrize("name", "m3_refine_ridge m6_leave_one_group_out_ridge m8_ablate_ridge m10_train_modes_ridge e13_detect_with_model e13_model_verdicts".split())
def test_query_equals_sql(spark, name):
    case = cases()[name]
    assert compare(duck(BASE), case.run(spark, BASE), case.sql) is None


def planted(n, groups, seed=1):
    """Labels that follow two features, with noise; the third means nothing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(5, 2), rng.gauss(0, 1), rng.gauss(100, 30)
        label = 1.0 if a - 5 + 2 * b + rng.gauss(0, 0.5) > 1 else 0.0
        rows.append((i, i % groups, a, b, c, label, rng.uniform(0, 9)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g long, a double, b double, c double, label double, dist double").repartition(4)


def plain_ridge(x, y, w, penalty):
    mean, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z = (x - mean) / sd
    r = (z * w[:, None]).T @ z / w.sum()
    beta = np.linalg.solve(r + penalty * np.eye(len(sd)), (z * (w * (y - my))[:, None]).sum(axis=0) / w.sum()) / sd
    return lambda v: my + (v - mean) @ beta


def test_held_out_and_ablated_fits_equal_numpy(spark):
    rows = planted(400, 7)
    rows[3] = (*rows[3][:4], None, *rows[3][5:])  # left out of all fits, has no score
    weight = 1 / (1 + F.col("dist"))
    got = rg.held_out_ridge(frame(spark, rows), "g", FEATS, penalty=0.3, weight=weight, drop=[["b"], ["a", "c"]]).collect()
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows])
    y, g, w = (np.array([f(r) for r in rows]) for f in (lambda r: r[5], lambda r: r[1], lambda r: 1 / (1 + r[6])))
    for name, kept in (("all", [0, 1, 2]), ("without b", [0, 2]), ("without a,c", [1])):
        for fold in range(7):
            train = (g != fold) & ~np.isnan(x).any(axis=1)
            value = plain_ridge(x[train][:, kept], y[train], w[train], 0.3)
            for r in got:
                if r.features_used == name and r.g == fold and r.id != 3:
                    assert r.score == pytest.approx(float(value(x[r.id][kept])), abs=1e-9)
    assert {r.score for r in got if r.id == 3 and r.features_used == "all"} == {None}


def test_groups_without_positives_and_without_name_only_train(spark):
    rows = planted(60, 3)
    rows = [(i, None if i % 10 == 0 else g, a, b, c, 0.0 if g == 2 else label, d) for i, g, a, b, c, label, d in rows]
    out = rg.held_out_ridge(frame(spark, rows), "g", FEATS)
    assert {r.g for r in out.collect()} == {0, 1}
    constant = frame(spark, [(i, g, 4.0, b, c, label, d) for i, g, _, b, c, label, d in rows])
    assert all(np.isfinite(r.score) for r in rg.held_out_ridge(constant, "g", FEATS).collect())


def test_jobs_do_not_grow_with_groups(spark):
    counts = []
    for groups in (4, 200):
        df = frame(spark, planted(1000, groups))
        spark.sparkContext.setJobGroup(f"ridge-{groups}", "")
        assert rg.ablate_ridge(df, "g", FEATS, [["a"], ["b"], ["c"]]).count() == 4
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ridge-{groups}")))
    assert counts[0] == counts[1], counts


def area(rows):
    pos, neg = [s for s, y in rows if y > 0], [s for s, y in rows if y == 0]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark, planted(600, 3)).cache()


def test_every_learner_beats_one_feature(spark, data):
    base = area([(r.score, r.label) for r in md.single_feature_scores(data, "a").collect()])
    learners = md.classifiers(forest={"numTrees": 10, "maxDepth": 4}, boosting={"maxIter": 8, "maxDepth": 3})
    scored = md.apply_models(data, md.fit_classifiers(data, FEATS, learners)).collect()
    for name in ("p_rf", "p_gbt", "p_lr"):
        values = [r[name] for r in scored]
        assert all(0 <= v <= 1 for v in values)
        assert area([(r[name], r.label) for r in scored]) > base + 0.05, name
    held = rg.held_out_ridge(data, "g", FEATS).collect()
    assert area([(r.score, r.label) for r in held]) > base + 0.05


def test_refiners_follow_the_distance(spark, data):
    near = data.withColumn("dist", F.abs(F.col("a") - 5))
    models = md.fit_refiners(near.withColumn("a", F.abs(F.col("a") - 5)), FEATS, 2.0, {"numTrees": 10, "maxDepth": 4}, {"maxIter": 8, "maxDepth": 3})
    scored = md.apply_models(near.withColumn("a", F.abs(F.col("a") - 5)), models, "r_").collect()
    for name in ("r_rf", "r_gbt", "r_ridge"):
        assert np.corrcoef([r[name] for r in scored], [np.exp(-((r.dist / 2) ** 2)) for r in scored])[0, 1] > 0.8, name


def test_tables_of_qualities(spark, data):
    one = lambda: {"lr": md.classifiers()["lr"]}
    rows = {r.method: r for r in md.ablate(data, "g", FEATS, one, [["b"], ["c"]]).collect()}
    assert rows["without b"].auc < rows["all"].auc - 0.05 and abs(rows["without c"].auc - rows["all"].auc) < 0.03
    table = {r.method: r.auc for r in md.compare_algorithms(data, "g", FEATS, "c", one).collect()}
    assert table["lr"] > table["only c"] + 0.2 and table["svm"] > table["only c"] + 0.2
    tuned = md.tune(data, "g", FEATS, {"numTrees": [5], "maxDepth": [1, 4]}, [0, 1]).collect()
    assert {r.fold for r in tuned} == {"0", "1"} and all(r.auc > 0.7 for r in tuned)


def test_importance_goes_to_what_counts(spark, data):
    models = md.fit_classifiers(data, FEATS, {"rf": md.classifiers(forest={"numTrees": 10, "maxDepth": 4})["rf"]})
    found = {r.feature: r.importance for r in md.feature_importance(models["rf"], FEATS, spark).collect()}
    assert sum(found.values()) == pytest.approx(1) and found["c"] < min(found["a"], found["b"])

"""The queries of the shipped learners fit all of them with all of their settings; C is an inverse penalty."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_models import FEATS, frame, planted
from tidemark.catalog import models as cm
from tidemark.operators import models as md


def settings(learner):
    made = learner(1.0) if callable(learner) else learner
    return {p.name: v for p, v in made.extractParamMap().items()}


@pytest.fixture
def fitted(spark, monkeypatch):
    """Planted candidates of four works, one without a positive row, and the learners that a query fits, in quick versions."""
    rows = [(i, g, a, b, c, 0.0 if g == 3 else label, d) for i, g, a, b, c, label, d in planted(200, 4)]
    data = frame(spark, rows).select(
        F.col("g").alias("work_id"), F.col("g").alias("track_id"), F.col("id").alias("cand_no"), F.col("a").alias("score"),
        F.col("b").alias("ref_score"), F.col("c").alias("t"), "label", (F.col("g") % 3).alias("fold"),
    ).localCheckpoint()
    seen, whole, quick = [], md.fit_classifiers, md.classifiers({"numTrees": 3, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 2})

    def fit(training, features, learners=None, extra=None):
        seen.append(({n: settings(m) for n, (m, _) in (learners or md.classifiers()).items()}, {r[0] for r in training.select("work_id").distinct().collect()}))
        return whole(training, features, {n: quick.get(n, m) if n != "lr" else m for n, m in (learners or md.classifiers()).items()}, extra)

    monkeypatch.setattr(cm, "rows", lambda spark, base: data)
    monkeypatch.setattr(md, "fit_classifiers", fit)
    return seen


def is_whole(learners):
    forest, boosting = learners.get("rf"), learners.get("gbt")
    assert forest is None or (forest["numTrees"], forest["maxDepth"], forest["minInstancesPerNode"]) == (400, 10, 5)
    assert boosting is None or (boosting["maxIter"], boosting["maxDepth"], boosting["stepSize"]) == (300, 10, 0.06)
    assert "lr" not in learners or learners["lr"]["regParam"] == pytest.approx(1 / 0.3)


def test_all_learners_are_held_out_over_all_works(spark, fitted):
    out = cm._m6_learners(spark, "").collect()
    assert len(out) == 200 and {r.work_id for r in out} == {0, 1, 2, 3} and all(0 <= r.score <= 1 for r in out)
    assert len(fitted) == 4 and sorted(sorted({0, 1, 2, 3} - works) for _, works in fitted) == [[0], [1], [2], [3]]
    for learners, _ in fitted:
        assert set(learners) == {"rf", "gbt", "lr"}
        is_whole(learners)


def test_compared_learners_are_the_shipped_ones(spark, fitted):
    assert [r.method for r in cm._m9(spark, "").collect()] == ["only score", "rf", "gbt", "lr", "svm"]
    assert {n for learners, _ in fitted for n in learners} == {"rf", "gbt", "lr", "svm"}
    for learners, _ in fitted:
        is_whole(learners)


def test_importances_are_those_of_the_shipped_forest(spark, fitted):
    assert sum(r.importance for r in cm._m12(spark, "").collect()) == pytest.approx(1)
    assert fitted and all("rf" in learners and works == {0, 1, 2, 3} for learners, works in fitted)
    for learners, _ in fitted:
        is_whole(learners)


def test_c_is_the_inverse_of_the_penalty(spark):
    rows = planted(300, 3)
    models = md.fit_classifiers(frame(spark, rows), FEATS, {"lr": md.shipped_classifiers()["lr"]})
    got = {r.id: r.p_lr for r in md.apply_models(frame(spark, rows), models).collect()}
    x, y = np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows])
    z = np.c_[(x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.ones(len(x))]
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta, penalty = np.zeros(4), np.diag([1 / md.LOGISTIC_C] * 3 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (p - y)) + penalty @ beta)
    want = 1 / (1 + np.exp(-z @ beta))
    assert max(abs(got[r[0]] - want[i]) for i, r in enumerate(rows)) < 1e-3

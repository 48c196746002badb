"""Training, scoring, calibration and validation of candidate classifiers with MLlib."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scores import distance_weight, finite_or_zero, hard_label, soft_target
from tidemark.operators.joins import label_candidates
from tidemark.operators.metrics import auc
from tidemark.plans.blocks import fit as fit_blocks
from tidemark.plans.blocks import number_rows, unblock

# Settings of the shipped learners, highest calibrated probability, width of the soft target.
FOREST = {"numTrees": 400, "minInstancesPerNode": 5, "maxDepth": 10}
BOOSTING = {"maxIter": 300, "stepSize": 0.06, "maxDepth": 10, "minInstancesPerNode": 5}
LOGISTIC_C = 0.3
PROBABILITY_CAP = 0.95
SIGMA = 2.0
SHORTEST = 60.0


def training_set(
    candidates: DataFrame, truth: DataFrame, labelled: DataFrame, keys: Sequence[str], features: Sequence[str], hop: float, tolerance: float = 20.0
) -> DataFrame:
    """Candidates of labelled tracks of at least a minute with clean features, distance and label."""
    rows = candidates.filter(F.col("n_frames") * F.lit(hop) >= SHORTEST)
    rows = rows.join(labelled.select(*keys).distinct(), list(keys), "left_semi")
    rows = label_candidates(rows, truth, keys, tolerance)
    return rows.select(
        *keys, "t", *[finite_or_zero(F.col(f)).alias(f) for f in features], "dist", F.when(F.col("hit"), 1.0).otherwise(0.0).alias("label")
    )


def with_class_weight(rows: DataFrame, extra: Column | None = None) -> DataFrame:
    """``weight`` = n / (2 n_class), times an own weight: both classes count alike."""
    row = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("pos")).first()
    pos, neg = max(1, row["pos"]), max(1, row["n"] - row["pos"])
    share = F.when(F.col("label") > 0, row["n"] / (2.0 * pos)).otherwise(row["n"] / (2.0 * neg))
    return rows.withColumn("weight", share * (extra if extra is not None else F.lit(1.0)))


def _stages(features: Sequence[str], learner, scale: bool) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True))
        return Pipeline(stages=[*stages, learner.setFeaturesCol("_x")])
    return Pipeline(stages=[*stages, learner.setFeaturesCol("_raw")])


def classifiers(forest: Mapping | None = None, boosting: Mapping | None = None, c: float = LOGISTIC_C, seed: int = 0) -> dict:
    """The three learners of the ensemble: (learner, needs scaling)."""
    common = {"labelCol": "label", "weightCol": "weight"}
    return {
        "rf": (RandomForestClassifier(**common, seed=seed, **(forest or FOREST)), False),
        "gbt": (GBTClassifier(**common, seed=seed, **(boosting or BOOSTING)), False),
        "lr": (LogisticRegression(**common, regParam=c, maxIter=50), True),
    }


def shipped_classifiers() -> dict:
    """The three learners as they are shipped: 400 trees, 300 rounds of boosting, and a logistic model whose C is the inverse of its
    penalty beside the summed loss of all rows, so that the penalty fades with the rows."""

    def logistic(total: float) -> LogisticRegression:
        return LogisticRegression(labelCol="label", weightCol="weight", regParam=1 / (LOGISTIC_C * total), standardization=False, maxIter=3000)

    return {**classifiers(), "lr": (logistic, True)}


def fit_classifiers(rows: DataFrame, features: Sequence[str], learners: Mapping | None = None, extra: Column | None = None) -> dict[str, PipelineModel]:
    """A fitted pipeline per learner; a learner may be a function of the rows' summed weight."""
    weighted = with_class_weight(rows, extra)
    learners = learners or classifiers()
    total = weighted.agg(F.sum("weight")).first()[0] if any(callable(m) for m, _ in learners.values()) else None
    return {n: _stages(features, m(total) if callable(m) else m, s).fit(weighted) for n, (m, s) in learners.items()}


def fit_refiners(
    rows: DataFrame, features: Sequence[str], sigma: float = SIGMA, forest: Mapping | None = None, boosting: Mapping | None = None
) -> dict[str, PipelineModel]:
    """Regressors on the soft distance target, used to re-position events."""
    target = rows.withColumn("target", soft_target(F.col("dist"), sigma))
    learners = {
        "rf": (RandomForestRegressor(labelCol="target", **(forest or FOREST)), False),
        "gbt": (GBTRegressor(labelCol="target", **(boosting or BOOSTING)), False),
        "ridge": (LinearRegression(labelCol="target", regParam=1.0, elasticNetParam=0.0), True),
    }
    return {n: _stages(features, m, s).fit(target) for n, (m, s) in learners.items()}


_WORK = ["_raw", "_x", "prediction", "rawPrediction", "probability"]


def apply_models(rows: DataFrame, models: Mapping[str, PipelineModel], prefix: str = "p_") -> DataFrame:
    """One score column per model: P(1) of classifiers, the value of regressors."""
    out = rows
    for name, model in models.items():
        scored = model.transform(out)
        if "probability" in scored.columns:
            value = vector_to_array("probability")[1]
        elif "rawPrediction" in scored.columns:
            value = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        else:
            value = F.col("prediction")
        out = scored.withColumn(prefix + name, value).drop(*_WORK)
    return out


def ensemble_score(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    weights = list(weights or [1.0] * len(columns))
    return sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights)), F.lit(0.0)) / F.lit(float(sum(weights)))


def fit_calibrator(out_of_fold: DataFrame, score: str = "score", label: str = "label"):
    """Isotonic regression on out-of-fold scores (linear between its points)."""
    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="_cal").fit(
        out_of_fold.select(score, label)
    )


def calibrate(rows: DataFrame, calibrator, score: str = "score", out: str = "probability", cap: float = PROBABILITY_CAP) -> DataFrame:
    """Calibrated probability in [0, cap]; the raw score when there is no calibrator."""
    if calibrator is None:
        return rows.withColumn(out, F.col(score))
    shown = calibrator.transform(rows)
    return shown.withColumn(out, F.least(F.greatest(F.col("_cal"), F.lit(0.0)), F.lit(cap))).drop("_cal")


def leave_one_group_out(
    rows: DataFrame, group: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: Sequence | None = None, threads: int = 4
) -> DataFrame:
    """Out-of-fold scores: each group is scored by a model trained on all others.

    ``fit(training rows)`` returns a scoring function.  Groups given in ``folds`` are held out (by
    default those with a positive); others always train.  Folds are fitted side by side.
    """
    if folds is None:
        folds = [r[0] for r in rows.filter("label > 0").select(group).distinct().collect()]

    def one(fold):
        return fit(rows.filter(F.col(group) != F.lit(fold)))(rows.filter(F.col(group) == F.lit(fold)))

    if not folds:
        raise ValueError("no group with a positive row to hold out")
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, sorted(folds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scorer(features: Sequence[str], learners: Callable[[], Mapping] = classifiers, extra: Column | None = None):
    """A ``fit`` for :func:`leave_one_group_out`: train the learners, score with their mean."""

    def fit(training: DataFrame):
        models = fit_classifiers(training, features, learners(), extra)
        names = [f"p_{n}" for n in models]
        return lambda rows: apply_models(rows, models).withColumn("score", ensemble_score(names))

    return fit


def quality(scored: DataFrame) -> DataFrame:
    """AUC, and precision, recall at one half, of scored rows."""
    flagged = scored.withColumn("_all", F.lit(1)).withColumn("hit", F.col("label") > 0)
    area = auc(flagged, ["_all"], "score", "hit").drop("_all")
    yes = F.col("score") >= 0.5
    rates = flagged.agg(
        F.avg(F.when(yes, F.col("label"))).alias("precision"), F.avg(F.when(F.col("hit"), yes.cast("double"))).alias("recall")
    )
    one = [d.withColumn("_k", F.lit(1)) for d in (area, rates)]
    return one[0].join(one[1], "_k").drop("_k")


def labelled_quality(name: str, scored: DataFrame) -> DataFrame:
    return quality(scored).select(F.lit(name).alias("method"), "positives", "negatives", "auc", "precision", "recall")


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_sample_vs_held_out(rows: DataFrame, group: str, fit) -> DataFrame:
    """Quality on the training rows and on held-out groups: the overfit gap."""
    return _stack([labelled_quality("in sample", fit(rows)(rows)), labelled_quality("held out", leave_one_group_out(rows, group, fit))])


def ablate(rows: DataFrame, group: str, features: Sequence[str], learners: Callable[[], Mapping], drop: Sequence[Sequence[str]]) -> DataFrame:
    """Held-out quality with all features and without each listed set."""
    parts = []
    for gone in [[], *drop]:
        kept = [f for f in features if f not in gone]
        name = "all" if not gone else "without " + ",".join(gone)
        parts.append(labelled_quality(name, leave_one_group_out(rows, group, scorer(kept, learners))))
    return _stack(parts)


def single_feature_scores(rows: DataFrame, feature: str) -> DataFrame:
    """Baseline: the standardised feature through a sigmoid."""
    stats = rows.agg(F.avg(feature).alias("_m"), F.stddev_pop(feature).alias("_s")).withColumn("_k", F.lit(1))
    z = (F.col(feature) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-9))
    return rows.withColumn("_k", F.lit(1)).join(stats, "_k").withColumn("score", 1 / (1 + F.exp(-z))).drop("_k", "_m", "_s")


def compare_algorithms(rows: DataFrame, group: str, features: Sequence[str], baseline: str, learners: Callable[[], Mapping]) -> DataFrame:
    """Held-out quality of every learner alone, a linear SVM, and the one-feature baseline."""
    table = {
        **learners(),
        "svm": (LinearSVC(labelCol="label", weightCol="weight", maxIter=20, regParam=0.1), True),
    }

    def one(item):
        name, learner = item
        return labelled_quality(name, leave_one_group_out(rows, group, scorer(features, lambda: {name: learner})))

    with ThreadPoolExecutor(len(table)) as pool:  # side by side: small tables leave most cores idle
        parts = list(pool.map(one, table.items()))
    return _stack([labelled_quality(f"only {baseline}", single_feature_scores(rows, baseline)), *parts])


def train_modes(rows: DataFrame, group: str, features: Sequence[str], learners: Callable[[], Mapping], sigma: float = 5.0, tolerance: float = 5.0) -> DataFrame:
    """Held-out quality when training plainly, with distance weights, or with strict labels."""
    soft = distance_weight(F.col("dist"), F.col("label") > 0, sigma)

    def strict(training: DataFrame):
        relabelled = training.withColumn("label", hard_label(F.col("dist"), tolerance).cast("double"))
        return scorer(features, learners)(relabelled)

    modes = {"plain": scorer(features, learners), "weighted": scorer(features, learners, soft), "strict": strict}
    return _stack([labelled_quality(n, leave_one_group_out(rows, group, f)) for n, f in modes.items()])


def tune(rows: DataFrame, group: str, features: Sequence[str], grid: Mapping[str, Sequence], held_out: Sequence) -> DataFrame:
    """Nested choice: each held-out group is scored with the forest settings best on the other groups."""
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    forest = lambda s: {"rf": classifiers(forest=s)["rf"]}
    parts = []
    for fold in held_out:
        inner = rows.filter(F.col(group) != F.lit(fold))
        inner_folds = [r[0] for r in inner.filter("label > 0").select(group).distinct().orderBy(group).collect()]
        scored = [
            (quality(leave_one_group_out(inner, group, scorer(features, lambda s=s: forest(s)), inner_folds)).first()["auc"] or 0.0, i)
            for i, s in enumerate(settings)
        ]
        best = settings[max(scored, key=lambda x: (x[0], -x[1]))[1]]
        outer = scorer(features, lambda s=best: forest(s))(inner)(rows.filter(F.col(group) == F.lit(fold)))
        parts.append(
            quality(outer).select(F.lit(str(fold)).alias("fold"), F.lit(json.dumps(best, sort_keys=True)).alias("chosen"), "auc", "precision", "recall")
        )
    return _stack(parts)


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def rank_average(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], ident: str, out: str = "score") -> DataFrame:
    """Mean of the percent ranks of several score columns within a key."""
    ranked = rows
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    for c in columns:
        order = [c, ident]
        ranked = unblock(number_rows(fit_blocks(ranked, keys, order), keys, order, f"_r_{c}"))
    ranked = ranked.join(sizes, list(keys))
    share = sum((F.col(f"_r_{c}") / F.greatest(F.lit(1), F.col("_n") - 1) for c in columns), F.lit(0.0))
    return ranked.withColumn(out, share / F.lit(float(len(columns)))).select(*rows.columns, out)


def auc_weighted(rows: DataFrame, columns: Sequence[str]) -> list[float]:
    """One weight per score column: its AUC above chance."""
    flagged = rows.withColumn("_all", F.lit(1)).withColumn("hit", F.col("label") > 0)
    return [max(0.0, (auc(flagged, ["_all"], c, "hit").first()["auc"] or 0.5) - 0.5) for c in columns]


def best_grid_weights(rows: DataFrame, columns: Sequence[str], steps: int = 4) -> list[float]:
    """Weights on a simplex grid with the highest AUC."""
    flagged = rows.withColumn("_all", F.lit(1)).withColumn("hit", F.col("label") > 0)
    grid = [g for g in product(range(steps + 1), repeat=len(columns)) if sum(g) == steps]
    areas = []
    for g in grid:
        scored = flagged.withColumn("_s", ensemble_score(columns, [x / steps for x in g]))
        areas.append((auc(scored, ["_all"], "_s", "hit").first()["auc"] or 0.0, g))
    return [x / steps for x in max(areas)[1]]


def stack_scores(out_of_fold: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Logistic regression over out-of-fold scores."""
    return _stages(columns, LogisticRegression(labelCol="label", regParam=0.01), True).fit(out_of_fold)


def save_model(model: PipelineModel, path: str, features: Sequence[str], info: Mapping, spark: SparkSession) -> None:
    model.write().overwrite().save(f"{path}/model")
    meta = {"features": list(features), **info}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str, features: Sequence[str], spark: SparkSession) -> tuple[PipelineModel, dict]:
    """Load a model; refuse it when its feature order is not the expected one."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["features"] != list(features):
        raise ValueError("the model was trained on other features or another order")
    return PipelineModel.load(f"{path}/model"), meta


def in_sample_audit(rows: DataFrame, model: PipelineModel, record: Mapping[str, float]) -> DataFrame:
    """Quality of a shipped model on all labelled rows beside its recorded held-out quality."""
    scored = apply_models(rows, {"m": model}).withColumn("score", F.col("p_m"))
    return quality(scored).select(
        "auc", "precision", "recall", *[F.lit(float(record.get(n) or 0.0)).alias(f"recorded_{n}") for n in ("auc", "precision", "recall")]
    )

"""Ridge regression from removable statistics: every left-out group and dropped feature without another pass.

One aggregate gives each group's moments. A model without a group solves the sum of all moments less the group's own, one without
a feature the rows and columns that are left. So any number of groups and feature sets costs one reading of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import auc
from tidemark.session import cut

#: Penalty of the standardised coefficients, per unit of weight.
PENALTY = 0.1


def _usable(features: Sequence[str], target: Column, weight: Column) -> Column:
    held = target.isNotNull() & weight.isNotNull()
    for f in features:
        held = held & F.col(f).isNotNull()
    return held


def moments(rows: DataFrame, group: str, features: Sequence[str], target: Column, weight: Column | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``(group, moments)`` and the centre the features were moved by.

    The moments are weighted sums of 1, y, each x, each xy and each product of two x, in this order. Features are moved by
    their mean over all rows first, which keeps the sums small. Rows with a null in a feature, the target or the weight are left out.
    """
    w = F.lit(1.0) if weight is None else weight
    used = rows.select(group, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], target.cast("double").alias("_y"), w.cast("double").alias("_w"))
    used = used.filter(_usable([f"_x{i}" for i in range(len(features))], F.col("_y"), F.col("_w")))
    means = used.agg(*[F.avg(f"_x{i}") for i in range(len(features))]).first()
    centre = {f: float(m or 0.0) for f, m in zip(features, means)}
    x = [F.col(f"_x{i}") - F.lit(centre[f]) for i, f in enumerate(features)]
    pairs = [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
    parts = [F.lit(1.0), F.col("_y"), *x, *[c * F.col("_y") for c in x], *pairs]
    return used.groupBy(group).agg(F.array(*[F.sum(F.col("_w") * c) for c in parts]).alias("moments")), centre


def _solver(d: int, kept: Sequence[Sequence[int]], penalty: float):
    """For an array of moments, one array of an intercept and d coefficients for each feature set; null where nothing is left."""

    def solve(column):
        import numpy as np
        import pyarrow as pa

        out = []
        for row in column.to_pylist():
            if row is None or row[0] <= 0:
                out.append(None)
                continue
            s = np.array(row, dtype=np.float64)
            n, y, x, xy = s[0], s[1] / s[0], s[2 : 2 + d] / s[0], s[2 + d : 2 + 2 * d] / s[0]
            square = np.zeros((d, d))
            square[np.triu_indices(d)] = s[2 + 2 * d :] / n
            square = np.triu(square) + np.triu(square, 1).T - np.outer(x, x)
            size = np.sqrt(np.maximum(np.diag(square), 0.0))
            live = size > 1e-12 * np.sqrt(np.diag(square) + x * x + 1e-300)
            found = []
            for wanted in kept:
                at = [i for i in wanted if live[i]]
                beta = np.zeros(d)
                if at:
                    scale = size[at]
                    r = square[np.ix_(at, at)] / np.outer(scale, scale)
                    beta[at] = np.linalg.solve(r + penalty * np.eye(len(at)), (xy - x * y)[at] / scale) / scale
                found.append([y - float(beta @ x), *beta.tolist()])
            out.append(found)
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(solve, "array<array<double>>")


def _named(features: Sequence[str], drop: Sequence[Sequence[str]]) -> list[tuple[str, list[int]]]:
    sets = [("all", list(range(len(features))))]
    for gone in drop:
        sets.append(("without " + ",".join(gone), [i for i, f in enumerate(features) if f not in gone]))
    return sets


def _scored(rows: DataFrame, features: Sequence[str], centre: dict[str, float], out: str) -> DataFrame:
    value = F.element_at("_beta", 1)
    for i, f in enumerate(features):
        value = value + F.element_at("_beta", i + 2) * (F.col(f).cast("double") - F.lit(centre[f]))
    return rows.withColumn(out, value).drop("_beta")


def ridge_scorer(
    rows: DataFrame, features: Sequence[str], target: Column, penalty: float = PENALTY, weight: Column | None = None, out: str = "score"
) -> Callable[[DataFrame], DataFrame]:
    """A model of all rows, as a function that adds its value to any rows with these features."""
    table, centre = moments(rows.withColumn("_all", F.lit(1)), "_all", features, target, weight)
    solve = _solver(len(features), [list(range(len(features)))], penalty)
    model = cut(table.select(F.element_at(solve("moments"), 1).alias("_beta")))
    return lambda others: _scored(others.join(model, F.lit(True), "left"), features, centre, out)


def fit_ridge(rows: DataFrame, features: Sequence[str], target: Column, penalty: float = PENALTY, weight: Column | None = None, out: str = "score") -> DataFrame:
    """All rows with the value of a model of all of them."""
    return ridge_scorer(rows, features, target, penalty, weight, out)(rows)


def held_out_ridge(
    rows: DataFrame,
    group: str,
    features: Sequence[str],
    target: Column | None = None,
    penalty: float = PENALTY,
    weight: Column | None = None,
    drop: Sequence[Sequence[str]] = (),
    out: str = "score",
) -> DataFrame:
    """Rows of each group that has a positive label, with the value of a model of all other groups, once for each feature
    set: ``features_used`` is ``all`` or ``without a,b``.

    Other groups, and rows without a group, always train. ``label`` decides which groups are held out, ``target`` (the label by
    default) is what is fitted.
    """
    table, centre = moments(rows, group, features, F.col("label") if target is None else target, weight)
    size = 2 + 2 * len(features) + len(features) * (len(features) + 1) // 2
    total = table.agg(F.array(*[F.sum(F.element_at("moments", i + 1)) for i in range(size)]).alias("_total"))
    asked = rows.filter("label > 0").select(group).distinct().filter(F.col(group).isNotNull())
    own = asked.join(table, group, "left").join(total, F.lit(True), "left")
    rest = F.when(F.col("moments").isNull(), F.col("_total")).otherwise(F.zip_with("_total", "moments", lambda a, b: a - b))
    sets = _named(features, drop)
    solve = _solver(len(features), [k for _, k in sets], penalty)
    models = own.select(group, F.arrays_zip(F.array(*[F.lit(n) for n, _ in sets]).alias("name"), solve(rest).alias("beta")).alias("_m"))
    models = models.select(group, F.explode("_m").alias("_m")).select(group, F.col("_m.name").alias("features_used"), F.col("_m.beta").alias("_beta"))
    return _scored(rows.join(models, group), features, centre, out)


def quality_by(scored: DataFrame, keys: Sequence[str], limit: float = 0.5) -> DataFrame:
    """AUC, precision and recall at a limit of the scored rows of each key, in one pass over all keys."""
    flagged = scored.withColumn("hit", F.col("label") > 0)
    yes = F.col("score") >= F.lit(limit)
    rates = flagged.groupBy(*keys).agg(
        F.avg(F.when(yes, F.col("label"))).alias("precision"), F.avg(F.when(F.col("hit"), yes.cast("double"))).alias("recall")
    )
    return auc(flagged, list(keys), "score", "hit").join(rates, list(keys))


def ablate_ridge(rows: DataFrame, group: str, features: Sequence[str], drop: Sequence[Sequence[str]], penalty: float = PENALTY) -> DataFrame:
    """Held-out quality with all features and without each listed set, from one reading of the rows for all models."""
    return quality_by(held_out_ridge(rows, group, features, penalty=penalty, drop=drop), ["features_used"])

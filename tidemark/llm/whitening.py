"""Whitening of vectors by the covariance of their distinct values, weighted by one or by how often each stands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, stored

#: Units of a component of 1, and what is added so that usual vectors have no negative entries.
SCALE = 64
SHIFT = 1_000_000
#: Components whose variance is less than this part of the largest one have no direction of their own.
FLAT = 1e-13
#: Rows multiplied at once.
_ROWS = 2048
#: Integers that doubles and sums of squares hold exactly.
_EXACT = 1 << 52


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, x)`` of the rows whose vector is neither null nor holds a null or non-finite entry; x = floor(64 c) + 1000000.

    Entries whose x a double can't hold exactly (64 |c| of 2^52 or more) count as non-finite, and empty vectors have no
    components, so both kinds of rows go too.
    """
    c = F.col(vector)
    sound = F.coalesce(F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double")) * SCALE < float(_EXACT))), F.lit(False)) & (F.size(c) > 0)
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.select(F.col(key).alias("k"), F.when(sound, x).alias("x")).filter("x IS NOT NULL")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, rows and matrix of the vectors of each length in a batch whose first column is x."""
    x = batch.column(0)
    flat, sizes = x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for low in range(0, len(rows), _ROWS):
            part = rows[low : low + _ROWS]
            yield d, part, flat[begin[part][:, None] + np.arange(d)]


def _summed(distinct: DataFrame, block: Callable[[int, np.ndarray, np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """For each dimension the sum of one array over all distinct vectors: a task sends one row for each place of the array,
    places are added up by Spark, and the driver gets the sums."""
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column(1).to_numpy()
            for d, rows, x in _blocks(batch):
                one = block(d, x, weight[rows])
                held[d] = held[d] + one if d in held else one
        for d, total in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, d, dtype=np.int32)), pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel(), arrow)], ["d", "at", "v"]
            )

    # sums of longs are taken as decimals: no number of rows makes them wrap
    added = F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else "v")
    rows = map_arrow(distinct.select("x", "weight"), run, f"d int, at int, v {kind}").groupBy("d", "at").agg(added.alias("v")).orderBy("d", "at").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.d, []).append(int(r.v) if kind == "long" else r.v)
    return {d: np.array(v, dtype=object if kind == "long" else np.float64) for d, v in out.items()}


def _directions(covariance: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, their unit vectors as columns, and their parts of the trace."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    trace = float(np.trace(covariance))
    values = np.where(values > max(values[0], 0.0) * FLAT, values, 0.0)
    return values, vectors, values / trace if trace > 0 else np.zeros(len(values))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 16, weights: str = "one") -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of each row with a sound vector, see
    ``quantised``, and each component up to ``top``.

    Equal x vectors are one row of the fit list, with weight one, or with ``weights="count"`` as many as there are. n is
    the sum of weights, S the weighted sums of x; V is the weighted covariance with divisor n, summed over centred vectors.
    Components are V's unit eigenvectors by falling eigenvalue e. Each distinct vector is whitened once and
    joined back: ``whitened`` is x - S/n on the component over sqrt(e), ``explained`` is e over V's trace, ``deviation`` the
    exact sum of (n x - S)^2 over dimensions as decimal(38,0), and ``identity_error`` the largest absolute entry of the whitened
    list's covariance, measured over it, minus the identity. Components without variance (fewer different vectors than
    components) have ``whitened`` null and ``explained`` 0 and aren't part of the error. Vectors of other lengths have a
    fit of their own; an empty table gives none. A model of d dimensions costs d^2 numbers in each task and the
    driver, whatever the number of rows. A vector that very many rows share is one row before anything is shuffled
    but in the last join, which Spark splits.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are 'one' or 'count'")
    rows = stored(quantised(vectors, key, vector), "whiten-rows")
    one = F.count("*") if weights == "count" else F.lit(1).cast("long")
    distinct = stored(rows.groupBy("x").agg(one.alias("weight")), "whiten-list")
    sums = _summed(distinct, lambda d, x, w: np.append(w.sum(), w @ x), "long")
    n, total = {d: int(s[0]) for d, s in sums.items()}, {d: s[1:] for d, s in sums.items()}
    # S/n is split into a whole part and a rest, so that centring loses no digits however large the sums are
    whole = {d: np.array([int(t) // n[d] for t in s], dtype=np.int64) for d, s in total.items()}
    rest = {d: np.array([(int(t) % n[d]) / n[d] for t in s]) for d, s in total.items()}

    def centred(d: int, x: np.ndarray) -> np.ndarray:
        return (x - whole[d]).astype(np.float64) - rest[d]

    def spread(d: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        c = centred(d, x)
        return (c * w[:, None]).T @ c

    fits = {d: _directions(v.reshape(d, d) / n[d], top) for d, v in _summed(distinct, spread, "double").items()}
    axes = {d: vectors * np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1.0)), 0.0) for d, (values, vectors, _) in fits.items()}

    def check(d: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = centred(d, x) @ axes[d]
        return np.concatenate([(z * w[:, None]).sum(axis=0), ((z * w[:, None]).T @ z).ravel()])

    errors = {}
    for d, s in _summed(distinct, check, "double").items():
        k = axes[d].shape[1]
        mean, square = s[:k] / n[d], s[k:].reshape(k, k) / n[d]
        live = fits[d][0] > 0
        errors[d] = float(np.abs(square - np.outer(mean, mean) - np.diag(live.astype(float))).max(initial=0.0))

    def deviations(d: int, x: np.ndarray) -> list[int]:
        reach = max(int(np.abs(x - whole[d]).max(initial=0)) + 1, 1) * n[d]
        if reach * reach * d < 1 << 62:
            over = np.array([int(t) % n[d] for t in total[d]], dtype=np.int64)
            return (((x - whole[d]) * n[d] - over) ** 2).sum(axis=1).tolist()
        return [sum((n[d] * int(v) - int(t)) ** 2 for v, t in zip(row, total[d])) for row in x.tolist()]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _blocks(batch):
                live, k = fits[d][0] > 0, axes[d].shape[1]
                z = centred(d, x) @ axes[d]
                dead = np.broadcast_to(~live, z.shape).ravel()
                values = pa.array(z.ravel(), pa.float64(), mask=dead)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, dtype=np.int32)), values)
                digits = pa.array([str(v) for v in deviations(d, x)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), digits, listed], ["x", "deviation", "z"])

    told = [(d, n[d], fits[d][2].tolist(), errors[d]) for d in fits]
    models = vectors.sparkSession.createDataFrame(told, "d int, n long, explained array<double>, identity_error double")
    done = map_arrow(distinct.select("x"), project, "x array<long>, deviation string, z array<double>")
    done = stored(done.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")), "whiten-done")
    back = rows.join(done, "x").join(models, F.size("x") == F.col("d"))
    out = back.select(F.col("k").alias(key), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("z", "explained")).alias("component", "value"))
    return out.select(
        key, (F.col("component") + 1).alias("component"), "n", "deviation", F.col("value.z").alias("whitened"), F.col("value.explained").alias("explained"), "identity_error"
    )

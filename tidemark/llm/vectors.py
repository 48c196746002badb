"""Near-duplicate vectors by tiled comparison in the order of principal components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, stored
from tidemark.llm.graph import Forest, components

#: Vectors of one tile at most, and vectors that the split of the space is fitted on.
TILE = 4096
SAMPLE = 20_000
#: Components after which a comparison looks at what the rest can still add.
STEPS = (12, 24, 40)
#: Leading components that split the space.
AXES = 16
_SLACK = 1e-9


def _unit(rows: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    x = flat.reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch_rows: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.asarray(batch_rows.value_lengths())
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length d that occurs, an orthogonal d x d matrix: the directions of most energy first.

    Every task sums the products of its vectors; d * d sums for each length reach the driver.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, at in _by_length(batch.column(0)):
                x = _unit(batch.column(0).take(pa.array(at)))
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            n = d * d
            yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.ravel())], ["d", "cell", "v"])

    cells = map_arrow(vectors.select("vec"), sums, "d int, cell int, v double").groupBy("d", "cell").agg(F.sum("v").alias("v")).collect()
    moments: dict[int, np.ndarray] = {}
    for r in cells:
        moments.setdefault(r["d"], np.zeros(r["d"] ** 2))[r["cell"]] = r["v"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in moments.items()}


class Split:
    """A tree of median cuts along leading components: which leaf a vector is in, and the box of each leaf."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.cuts: list[tuple[int, float] | None] = []
        self.children: list[tuple[int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        axes = sample.shape[1]
        self._grow(sample, max(leaves, 1), np.full(axes, -np.inf), np.full(axes, np.inf))

    def _grow(self, sample: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> int:
        me = len(self.cuts)
        self.cuts.append(None)
        self.children.append((-1, -1))
        spread = sample.max(axis=0) - sample.min(axis=0) if len(sample) else np.zeros(len(low))
        axis = int(np.argmax(sample.var(axis=0))) if len(sample) else 0
        if leaves <= 1 or not len(sample) or spread[axis] == 0:
            self.children[me] = (-1, len(self.low))
            self.low.append(low)
            self.high.append(high)
            return me
        cut = float(np.median(sample[:, axis]))
        right = sample[:, axis] >= cut
        self.cuts[me] = (axis, cut)
        low_r, high_l = low.copy(), high.copy()
        high_l[axis] = low_r[axis] = cut
        a = self._grow(sample[~right], leaves // 2, low, high_l)
        b = self._grow(sample[right], leaves - leaves // 2, low_r, high)
        self.children[me] = (a, b)
        return me

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.cuts[node] is None:
                out[rows] = self.children[node][1]
                continue
            axis, cut = self.cuts[node]
            right = x[rows, axis] >= cut
            todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out

    def near(self, leaf: int, reach: float) -> np.ndarray:
        """Leaves from this one on whose boxes come within ``reach``."""
        low, high = np.array(self.low), np.array(self.high)
        gap = np.maximum(0, np.maximum(low - high[leaf], low[leaf] - high))
        near = np.flatnonzero((gap**2).sum(axis=1) <= reach**2)
        return near[near >= leaf]


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For a range of rows of ``a``: its first one, and which rows of ``b`` have cosine of at least the threshold.

    Products of the leading components are summed first. What the other components can add is at most the product
    of their norms; where even that stays below the threshold the comparison stops. The norm of the rest rides as
    one more component, so a bound is one matrix product. Pairs that pass every bound are decided by the vectors
    themselves.
    """
    ra, rb = a @ axes, b @ axes
    steps = [s for s in STEPS if s < a.shape[1]]
    rest = lambda r, s: np.sqrt(np.maximum(0, (r[:, s:] ** 2).sum(axis=1)))
    heads = [(np.column_stack([ra[:, :s], rest(ra, s)]), np.column_stack([rb[:, :s], rest(rb, s)])) for s in steps]
    for low in range(0, len(a), rows):
        high = min(low + rows, len(a))
        hits = np.zeros((high - low, len(b)), dtype=bool)
        i = j = None
        for x, y in heads:
            if i is None:
                i, j = np.nonzero(x[low:high] @ y.T >= threshold - _SLACK)
                if len(i) > hits.size // 32:  # many pairs are close: whole products are cheaper than lists
                    hits = a[low:high] @ b.T >= threshold
                    break
            else:
                near = np.einsum("ij,ij->i", x[low:high][i], y[j]) >= threshold - _SLACK
                i, j = i[near], j[near]
        else:
            if i is None:
                hits = a[low:high] @ b.T >= threshold
            else:
                near = np.einsum("ij,ij->i", a[low:high][i], b[j]) >= threshold
                hits[i[near], j[near]] = True
        if hits.any():
            yield low, hits


def _tile_links(vec: pa.Array, weight: np.ndarray, side: np.ndarray, whole: bool, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, Forest]:
    """Of one tile, or of two: how many vectors each one links with, and links that join the same groups."""
    x = _unit(vec)
    a = np.arange(len(x)) if whole else np.flatnonzero(side)
    b = a if whole else np.flatnonzero(~side)
    links, counts = Forest(len(x)), np.zeros(len(x), dtype=np.int64)
    for low, hits in compare_tiles(x[a], x[b], axes, threshold):
        if whole:
            hits &= np.arange(len(b))[None, :] > np.arange(low, low + len(hits))[:, None]
        counts[a[low : low + len(hits)]] += hits @ weight[b]
        counts[b] += weight[a[low : low + len(hits)]] @ hits
        for k in np.flatnonzero(hits.any(axis=1)):
            links.add(a[low + k], b[hits[k]])
    return counts, links


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold``; vectors of different
    lengths never do, nor do those that are null, empty, zero or hold null or non-finite components.
    ``component_id`` is the smallest key reachable. Rows that repeat a key are one node, with the links of all.

    Equal vectors are one row with a weight, so copies are never paired. The space is cut at medians of leading
    components, fitted on a bounded sample, until a leaf holds about ``tile`` vectors; fuller leaves are cut by hash.
    Tiles whose boxes are further apart than the threshold allows never meet. Two tiles meet in one group of at most
    about ``2 * tile`` rows, which returns counts and fewer links than rows, not pairs. Every other pair is compared.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    element = vectors.schema[vector].dataType.elementType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    sound = F.coalesce(F.forall("vec", finite) & F.exists("vec", lambda v: v != 0), F.lit(False))
    distinct = rows.filter(sound).groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w"))
    distinct = stored(distinct, "vectors")
    axes = principal_axes(distinct)
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    splits: dict[int, Split] = {}
    for d, n in sizes.items():
        few = distinct.filter(F.size("vec") == d).select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).toArrow()["vec"].combine_chunks()
        splits[d] = Split((_unit(few) @ axes[d])[:, :AXES], math.ceil(n / tile))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(0)
            d_of, leaf = np.zeros(len(vec), dtype=np.int32), np.zeros(len(vec), dtype=np.int32)
            for d, at in _by_length(vec):
                d_of[at] = d
                leaf[at] = splits[d].leaf((_unit(vec.take(pa.array(at))) @ axes[d])[:, :AXES])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d_of), pa.array(leaf)], ["vec", "rep", "w", "d", "leaf"])

    placed = stored(map_arrow(distinct.select("vec", "rep", "w"), place, f"vec array<{element}>, rep {kind}, w long, d int, leaf int"), "tiles")
    filled = placed.groupBy("d", "leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * tile)).cast("int").alias("m"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for d, leaf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(d, leaf, int(o)) for o in splits[d].near(leaf, reach)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32()) for i in range(3)], ["d", "x", "y"])

    pairs = map_arrow(filled.select("d", "leaf"), meet, "d int, x int, y int")
    chunks = lambda name: filled.select("d", F.col("leaf").alias(name), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias(f"{name}c"), F.col("m").alias(f"{name}m"))
    pairs = pairs.join(chunks("x"), ["d", "x"]).join(chunks("y"), ["d", "y"]).filter("x < y or xc <= yc")
    ends = lambda a, side: pairs.select("d", "x", "xc", "y", "yc", F.col(a).alias("leaf"), F.col(f"{a}c").alias("c"), F.lit(side).alias("side"))
    meetings = ends("x", True).unionByName(ends("y", False).filter("x < y or xc < yc"))
    cut = placed.join(filled, ["d", "leaf"]).withColumn("c", F.pmod(F.xxhash64("vec"), F.col("m")).cast("int"))
    order = ["d", "x", "xc", "y", "yc"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = cut.join(meetings, ["d", "leaf", "c"]).select(*order, "side", "rep", "w", "vec").repartition(n, *order).sortWithinPartitions(*order)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state: list[tuple | None] = [None]

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            rep = t["rep"].combine_chunks()
            counts, found = _tile_links(t["vec"].combine_chunks(), t["w"].to_numpy(), np.asarray(t["side"].to_numpy(zero_copy_only=False), dtype=bool), state[0][1:3] == state[0][3:5], axes[state[0][0]], threshold)
            some = np.flatnonzero(counts)
            i, j = found.ends()
            null = pa.nulls(len(some), rep.type)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([rep.take(pa.array(some)), rep.take(pa.array(i))]), pa.concat_arrays([null, rep.take(pa.array(j))]), pa.array(np.concatenate([counts[some], np.zeros(len(i), dtype=np.int64)]))],
                ["a", "b", "n"],
            )

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(5)])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                here = tuple(keys[low].tolist())
                if state[0] is not None and here != state[0]:
                    yield done()
                    held.clear()
                state[0] = here
                held.append(batch.slice(low, high - low))
        if held:
            yield done()

    found = stored(map_arrow(groups, links, f"a {kind}, b {kind}, n long"), "vector-links")
    near = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.filter("b is not null").select("a", "b"), "a", "b")
    named = distinct.join(near, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("c")
    )
    out = rows.filter(sound).join(named, "vec").select("id", "n", "c").unionByName(rows.filter(~sound).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"))

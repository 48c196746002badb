"""Connected components by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that has a link; the component is its smallest node.

    Each round moves every link to the smallest neighbour of its larger end (large star), then of its smaller
    ends (small star); the number of rounds grows with the logarithm of the longest path. Minima are combined
    before the shuffle and joined back by joins that Spark can split, so a node with very many links is no hot
    task. Self links, repeated links and null ends are dropped; an empty input gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    edges = links.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = stored(edges, "links")
    known = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = stored(small, "links")
        before, known = known, _digest(edges)
        if known == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _digest(edges: DataFrame) -> tuple[int, ...]:
    """How many links there are, and sums of two hashes of them: equal for equal sets."""
    hashes = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    return tuple(int(v or 0) for v in edges.agg(F.count("*"), *hashes).first())


class Forest:
    """Links among n nodes of one block that join the same groups as all links it is told of, fewer than n of them.

    Nodes of one ``label`` are in one group from the start.

    Every node keeps a group label, so a row whose links stay inside its group costs one look.
    """

    def __init__(self, n: int, label: np.ndarray | None = None) -> None:
        self.label = np.arange(n) if label is None else label
        self.links: list[tuple[int, int]] = []

    def add(self, i: int, others: np.ndarray) -> None:
        found, first = np.unique(self.label[others], return_index=True)
        new = found != self.label[i]
        if new.any():
            self.links += [(int(i), int(j)) for j in others[first[new]]]
            self.label[np.isin(self.label, found[new])] = self.label[i]

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(self.links, dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

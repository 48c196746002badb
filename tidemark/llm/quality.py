"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, hash_words, map_arrow, mixed, row_slices, stored, text_buffer

#: Buckets of one order of n-grams under one hash, orders, and labelled documents that the target model is fitted on.
#: Every n-gram has a bucket under each of two hashes, and counts for what both of them show.
BITS = 18
BUCKETS = 1 << BITS
ORDERS = 2
LABELS = 20_000
#: Divides log-weights before Gumbel noise is added; small values sample almost by weight alone.
TEMPERATURE = 0.02

_BLOCK = 1 << 13
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[128:] = 1
_KIND[[c for c in range(128) if chr(c).isalnum() or c == 0x5F]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def row_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and the two buckets of the distinct n-grams of each row, ordered by row.

    Tokens are runs of letters, digits and bytes above 127, or runs of other signs; A-Z are lower-cased. Buckets of
    the second order follow those of the first, buckets of the second hash those of the first.
    """
    kind = _KIND[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    new[edges] = True
    begin = np.flatnonzero(new)
    stop = np.concatenate([begin[1:], [len(data)]])[: len(begin)]
    solid = kind[begin] > 0
    begin, stop = begin[solid], stop[solid]
    row = np.searchsorted(offsets, begin, side="right") - 1
    h = hash_words(_LOWER[data], begin, stop)
    both = row[1:] == row[:-1]
    two = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[both]
    low = np.uint64((1 << 2 * BITS) - 1)
    grams = np.concatenate([h & low, (two & low) + np.uint64(1 << 2 * BITS)]).astype(np.int64)
    keys = np.sort(np.concatenate([row, row[1:][both]]) << (2 * BITS + 1) | grams)
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    order = (keys >> 2 * BITS & 1) << BITS
    first = order | (keys >> BITS & (BUCKETS - 1))
    return keys >> (2 * BITS + 1), first, (order | keys & (BUCKETS - 1)) + ORDERS * BUCKETS


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(column)
    for low, high in row_slices(offsets):
        part = offsets[low : high + 1]
        yield low, high, *row_grams(data[part[0] : part[-1]], part - part[0])


class Model(NamedTuple):
    """Log ratio of each bucket, documents counted in the corpus and in the target."""

    ratio: np.ndarray
    n_raw: int
    n_target: int


def gram_counts(marked: DataFrame) -> dict[str, np.ndarray]:
    """In how many documents each bucket occurs: of the corpus (``raw``) and of the target (``good`` is true). The
    last place counts documents.

    Every task adds up its documents in two tables of fixed size and hands them on in blocks; a block's sums are
    formed as its rows stream in, and only the sums reach the driver.
    """
    size = 2 * BUCKETS * ORDERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, size + _BLOCK), dtype=np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            for low, high, row, first, second in _grams(batch.column(0)):
                own = good[low:high]
                for bucket in (first, second):
                    np.add.at(tables[0], bucket, 1)
                    np.add.at(tables[1], bucket[own[row]], 1)
                tables[:, size] += (high - low, int(own.sum()))
        at = [(m, b) for m in range(2) for b in range(size // _BLOCK + 1) if tables[m, b * _BLOCK : (b + 1) * _BLOCK].any()]
        for low in range(0, len(at), 32):
            part = at[low : low + 32]
            blocks = [tables[m, b * _BLOCK : (b + 1) * _BLOCK].astype(np.int32).tobytes() for m, b in part]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in part], pa.int32()), pa.array([b for _, b in part], pa.int32()), pa.array(blocks, pa.binary())], ["m", "b", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for m, b, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums[m, b] = sums.get((m, b), 0) + np.frombuffer(counts, dtype=np.int32).astype(np.int64)
        for (m, b), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([b], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["m", "b", "counts"])

    schema = "m int, b int, counts binary"
    n = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = map_arrow(map_arrow(marked, count, schema).repartition(n, "m", "b"), add, schema)
    out = np.zeros((2, size + _BLOCK), dtype=np.int64)
    for r in sums.collect():
        out[r["m"], r["b"] * _BLOCK : (r["b"] + 1) * _BLOCK] = np.frombuffer(r["counts"], dtype=np.int64)
    return {"raw": out[0, : size + 1], "target": out[1, : size + 1]}


def log_ratios(counts: dict[str, np.ndarray]) -> Model:
    """Log ratio of target to corpus for each bucket; 0 where the counts could differ by chance or differ little.

    If the target were drawn from the corpus, a bucket would be expected in ``e`` of its documents. The chance of
    so few or so many is bounded by Chernoff, against all buckets that are expected often enough to tell.
    """
    raw, target = counts["raw"][:-1].astype(float), counts["target"][:-1].astype(float)
    n_raw, n_target = int(counts["raw"][-1]), int(counts["target"][-1])
    e = raw * (n_target / max(n_raw, 1))
    surprise = np.where(target > 0, target * np.log(np.maximum(target, 1) / np.maximum(e, 1e-9)), 0) - (target - e)
    telling = max(int((e >= 5).sum()) // 2, 1)
    ratio = np.log((target + 0.5) / (e + 0.5))
    sure = (surprise >= math.log(telling) + 1) & (np.abs(ratio) >= math.log(2))
    return Model(np.where(sure, ratio, 0).astype(np.float32), n_raw, n_target)


def log_weight(model: Model, text: Column) -> Column:
    """The log-weight of a text: the sum of the log ratios of its distinct n-grams. Null and empty texts have 0."""
    ratio = model.ratio

    def weigh(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for low, high, row, first, second in _grams(column):
            a, b = ratio[first], ratio[second]
            shown = np.where(a * b > 0, np.where(np.abs(a) < np.abs(b), a, b), 0)
            out[low:high] = np.bincount(row, weights=shown, minlength=high - low)
        return pa.array(np.round(out, 6))

    return F.arrow_udf(weigh, T.DoubleType())(text)


def _labelled(labels: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents, chosen by hash: the key and whether it is good and not toxic."""
    known = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = known.groupBy(key).agg(((F.min("quality") > 0) & (F.max("toxic") == 0)).alias("good"))
    return one.orderBy(F.xxhash64(F.col(key)), key).limit(limit)


def best_cut(scores: list[float], good: list[bool]) -> float:
    """The cut between two neighbouring scores that best tells the good from the others; minus infinity if nothing
    is gained by any cut."""
    order = np.argsort(scores, kind="stable")
    s, g = np.asarray(scores, dtype=float)[order], np.asarray(good, dtype=bool)[order]
    if g.all() or not g.any():
        return -math.inf
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    gain = caught - lost
    gain[1:-1][s[1:] == s[:-1]] = -1
    k = int(np.argmax(gain))
    if gain[k] <= 0 or k == 0:
        return -math.inf
    return float((s[k - 1] + s[k]) / 2) if k < len(s) else math.inf


def kth_largest(keyed: DataFrame, k: int, few: int = 5000) -> tuple[float, object]:
    """The k-th row of ``(score, id)`` by falling score and rising id, found by counting ever finer score ranges."""
    low, high = keyed.agg(F.min("score"), F.max("score")).first()
    above, bins = 0, 1024
    inside = keyed
    while True:
        n = inside.count()
        if n <= few or low == high:
            rows = inside.orderBy(F.desc("score"), "id").limit(k - above).collect() if n <= few else None
            if rows is not None:
                return rows[-1]["score"], rows[-1]["id"]
            return low, None
        width = (high - low) / bins
        place = F.least(F.floor((F.col("score") - low) / width), F.lit(bins - 1))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                low, high = counts[b][1], counts[b][2]
                inside = inside.filter(F.col("score").between(low, high))
                break
            above += counts[b][0]


class Selection(NamedTuple):
    """What decides over a document: the model, and the last row that the sample takes."""

    model: Model
    key: str
    text: str
    temperature: float
    cut: tuple[float, object] | None

    def score(self, weight: Column) -> Column:
        """Gumbel key: the tempered log-weight with noise that the document's key alone decides."""
        u = (F.xxhash64(F.col(self.key), F.lit(20)).cast("double") / F.lit(float(1 << 64))) + 0.5
        u = F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12))
        return weight / self.temperature - F.log(-F.log(u))

    def kept(self, score: Column) -> Column:
        if self.cut is None:
            return F.lit(True)
        least, last = self.cut
        tie = (score == least) & (F.col(self.key) <= F.lit(last)) if last is not None else score == least
        return F.coalesce((score > least) | tie, F.lit(False))


def fit_selection(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LABELS, temperature: float = TEMPERATURE) -> Selection:
    """Fit target and corpus models and draw the sample.

    The corpus model counts every document; the target model the good ones of at most ``limit`` labelled documents.
    The share to keep follows from the labelled documents: k is the number of documents in the corpus whose weight
    passes the cut that best tells good ones from the others. The k largest Gumbel keys are the sample without
    replacement. Without labels, or if no cut helps, every document is kept.
    """
    labelled = stored(_labelled(labels, key, limit), "labelled")
    lean = docs.select(F.col(key), F.col(text))
    # at most ``limit`` rows of key and flag
    marked = lean.join(F.broadcast(labelled), key, "left").select(text, "good")
    model = log_ratios(gram_counts(marked))
    draft = Selection(model, key, text, temperature, None)
    bounded_batches(docs.sparkSession)
    weights = stored(lean.select(key, log_weight(model, F.col(text)).alias("weight")), "weights")
    judged = weights.join(F.broadcast(labelled), key).select("weight", "good").limit(2 * limit).collect()
    cut = best_cut([r["weight"] for r in judged], [r["good"] for r in judged])
    k = weights.filter(F.col("weight") > cut).count() if cut > -math.inf else None
    if not k:
        return draft
    return draft._replace(cut=kth_largest(weights.select(draft.score(F.col("weight")).alias("score"), F.col(key).alias("id")), k))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(key, log_weight, score, kept)`` of every row. Repeated rows are judged alike; null keys are weighed, and
    kept if their score is. Other columns are not read."""
    chosen = fit_selection(docs, labels, key, text, **options)
    weighed = docs.select(key, log_weight(chosen.model, F.col(text)).alias("log_weight"))
    scored = weighed.withColumn("score", chosen.score(F.col("log_weight")))
    return scored.withColumn("kept", chosen.kept(F.col("score")))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that the sample takes, with their columns."""
    chosen = fit_selection(docs, labels, key, text, **options)
    return docs.filter(chosen.kept(chosen.score(log_weight(chosen.model, F.col(text)))))

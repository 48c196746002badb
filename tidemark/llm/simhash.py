"""SimHash fingerprints of word shingles and their near-duplicate groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, packed_words, row_slices, sent_if_small, stored, text_buffer, word_spans
from tidemark.llm.graph import Forest, components

#: Fingerprints that one block compares at most with each other.
BLOCK = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """The fingerprint of each row of a text buffer."""
    starts, ends, first = word_spans(data, offsets)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    if not len(starts):
        return out
    packed, begin, stop = packed_words(data, starts, ends)
    held = _LOWER[packed].tobytes()
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(n_words.dtype))
    owner = np.repeat(np.arange(len(out)), n_shingles)
    if not len(owner):
        return out
    at = np.cumsum(n_shingles) - n_shingles
    left = np.arange(len(owner)) - at[owner] + first[:-1][owner]
    right = np.minimum(left + shingle, first[1:][owner]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(held[a:b], seed) for a, b in zip(begin[left].tolist(), stop[right].tolist())], dtype=np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    rows = np.flatnonzero(n_shingles)
    ones = np.add.reduceat(bits, at[rows], axis=0, dtype=np.int32)
    major = np.packbits(ones * 2 > n_shingles[rows][:, None], axis=1)
    out[rows] = major.reshape(-1).view(">u8").astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(key, fp)``: the 64-bit SimHash of every text as a signed long.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles join ``shingle`` words by a space, repeats
    count. A bit is set if more than half of the shingles' XXH64 values have it. Fewer words make one shingle;
    null, empty and blank texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            found = [np.zeros(0, dtype=np.uint64)]
            for low, high in row_slices(offsets):
                part = offsets[low : high + 1]
                found.append(_fingerprints(data[part[0] : part[-1]], part - part[0], shingle, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], ["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, fp long").withColumnRenamed("k", key)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Vertical storage: row b holds bit b of all values, 64 values to a machine word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(values) % 64
    bits = np.pad(bits, ((0, pad), (0, 0)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _over(planes: Iterator[np.ndarray], shape: tuple[int, ...], radius: int, over: np.ndarray) -> np.ndarray | None:
    """Add planes of differing bits to carry-save counters, 64 distances to a machine word; a bit of the result is
    set once its distance passes the radius. None as soon as every distance of the block has passed it."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = radius.bit_length()
    counters = [np.zeros(shape, dtype=np.uint64) for _ in range(levels)]
    for bit, carry in enumerate(planes):
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if radius + 1 < 1 << levels:
            more = np.full(shape, full)
            for level in range(levels):
                if (radius + 1) >> level & 1:
                    more &= counters[level]
            over |= more
        if bit % 8 == 7 and (over == full).all():
            return None
    return over


def _padding(n: int) -> np.ndarray:
    """Machine words over n values whose unused bits are set."""
    words = np.zeros(-(-n // 64), dtype=np.uint64)
    if n % 64:
        words[-1] = np.uint64((1 << 64) - (1 << (n % 64)))
    return words


def near_rows(left: np.ndarray, right: np.ndarray, radius: int, queries: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For a range of positions in ``left``: its first one, and which of ``right`` differ in at most ``radius`` bits."""
    planes = bit_planes(right)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for low in range(0, len(left), queries):
        part = left[low : low + queries]
        shape = (len(part), planes.shape[1])
        differ = (planes[b][None, :] ^ np.where((part >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None] for b in range(64))
        over = _over(differ, shape, radius, np.broadcast_to(_padding(len(right)), shape).copy())
        if over is not None:
            yield low, np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(right)].astype(bool)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the given pairs differ in at most ``radius`` bits."""
    out = np.zeros(len(left), dtype=bool)
    for low in range(0, len(left), 1 << 16):
        planes = bit_planes(left[low : low + (1 << 16)] ^ right[low : low + (1 << 16)])
        n = min(len(left) - low, 1 << 16)
        over = _over(iter(planes), planes.shape[1:], radius, _padding(n))
        if over is not None:
            out[low : low + n] = np.unpackbits((~over).view(np.uint8), bitorder="little")[:n].astype(bool)
    return out


def _linked(values: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same groups as all near pairs of one block: within it, or between its two sides."""
    whole = side.all() or not side.any()
    a = np.arange(len(values)) if whole else np.flatnonzero(side)
    b = a if whole else np.flatnonzero(~side)
    links = Forest(len(values))
    for low, hits in near_rows(values[a], values[b], radius):
        for k in np.flatnonzero(hits.any(axis=1)):
            links.add(a[low + k], b[hits[k]])
    return links.ends()


#: Blocks of up to so many values are compared together, as one list of pairs.
SMALL = 32


def _block_links(values: np.ndarray, side: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many blocks, given by their bounds."""
    size = np.diff(bounds)
    left, right = [], []
    for n in np.unique(size[(size > 1) & (size <= SMALL)]):
        i, j = np.triu_indices(int(n), 1)
        starts = bounds[:-1][size == n]
        left.append((starts[:, None] + i[None, :]).ravel())
        right.append((starts[:, None] + j[None, :]).ravel())
    i = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
    j = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
    near = near_pairs(values[i], values[j], radius)
    left, right = [i[near]], [j[near]]
    for k in np.flatnonzero(size > SMALL):
        low, high = int(bounds[k]), int(bounds[k + 1])
        a, b = _linked(values[low:high], side[low:high], radius)
        left.append(a + low)
        right.append(b + low)
    return values[np.concatenate(left)], values[np.concatenate(right)]


def fingerprint_links(distinct: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the groups of fingerprints within ``radius`` bits of each other.

    ``distinct`` has one column ``fp`` without repeats. The 64 bits are cut into ``radius + 2`` parts; two values
    within the radius agree on at least two parts, so each pair of parts is a key under which they meet. Keys of
    one value are dropped. A key with more than ``block`` values is cut into chunks and every two chunks meet
    as a block of their own, so no task holds more than two chunks at once. Blocks return links, not all pairs.
    """
    parts = np.linspace(0, 64, radius + 3).astype(int).tolist()
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(parts, parts[1:])]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    keys = F.array(*[
        F.struct(F.lit(n).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(masks[x] | masks[y]))).alias("bits"))
        for n, (x, y) in enumerate(combinations(range(radius + 2), 2))
    ])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    shared = keyed.groupBy("part", "bits").count().filter("count > 1")
    found = keyed.join(shared, ["part", "bits"])
    chunks = F.ceil(F.col("count") / block).cast("int")
    found = found.withColumn("m", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda d: F.struct(F.least(F.col("c"), d).alias("x"), F.greatest(F.col("c"), d).alias("y")))
    placed = found.select("fp", "part", "bits", "c", F.explode(meets).alias("at")).select("part", "bits", "at.*", (F.col("c") == F.col("at.x")).alias("side"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "bits", "x", "y"]
    sorted_blocks = placed.repartition(n, *order).sortWithinPartitions(*order, "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in (*batches, None):
            table = None
            if batch is not None:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                table = cols if pending is None else [np.concatenate(x) for x in zip(pending, cols)]
            elif pending is not None:
                table = pending
            if table is None or not len(table[0]):
                continue
            edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in table[:4]])) + 1
            bounds = [0, *edges.tolist(), len(table[0])]
            last = bounds[-2] if batch is not None else bounds[-1]
            pending = [c[last:] for c in table] if batch is not None else None
            done = np.array([x for x in bounds if x <= last], dtype=np.int64)
            if len(done) > 1:
                found = _block_links(table[5].view(np.uint64), table[4].astype(bool), done, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

    return map_arrow(sorted_blocks, run, "a long, b long").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row; the component is the smallest key reachable by links.

    Rows of equal fingerprints are one node, so copies are never paired. Repeated keys stay repeated. Texts that
    are null, empty or blank share fingerprint zero and link like any other. Other columns are not read.
    """
    marked = stored(fingerprints(docs, key, text, shingle, seed), "simhash")
    nodes = stored(marked.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    groups = components(fingerprint_links(nodes.select("fp"), radius), "a", "b")
    grouped = nodes.join(groups, nodes.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The row of each of ``(key, component_id)`` groups that has the smallest key, and all rows without a key. Of rows that
    repeat that key the one of least hash stays, in every run."""
    kept = groups.filter(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("kept_key")).agg(F.count("*").alias("rows"))
    kept = stored(kept, "representatives")
    single, several = (sent_if_small(kept.filter(c)) for c in ("rows = 1", "rows > 1"))
    once = docs.join(single, docs[key] == single["kept_key"], "left_semi")
    # only rows that repeat a key are moved to be compared
    again = docs.join(several, docs[key] == several["kept_key"], "left_semi")
    hashed = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
    least = again.groupBy(F.col(key).alias("kept_key")).agg(F.min_by(F.struct(*docs.columns), hashed).alias("row")).select("row.*")
    found = once.unionByName(least)
    return found.unionByName(docs.filter(F.col(key).isNull()))


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group, the one of smallest key, with its columns; rows that repeat that key
    count as copies. Rows without a key stay as they are, for nothing names them."""
    return representatives(docs, near_groups(docs.filter(F.col(key).isNotNull()), key, text, **options), key)

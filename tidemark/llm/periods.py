"""Periodic runs of words: occurrences of dyadic blocks in neighbouring windows give periods, extension gives the runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_words, map_arrow, packed_words, row_slices, text_buffer, word_spans

#: Least exponent for which every run holds a block of the grid and its next occurrence.
LEAST_EXPONENT = 4


class WaveletMatrix:
    """Values of a sequence, one bit plane to a level, 64 values to a machine word; answers range successor queries."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level) & 1
            padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(int(len(bits) - bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places ``low`` to ``high`` (excluded) are less than ``bound``."""
        total = np.where(bound >= 1 << self.levels, high - low, 0)
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            one = (bound >> (self.levels - 1 - level)) & 1 == 1
            total += np.where(one & (bound < 1 << self.levels), (high - b) - (low - a), 0)
            low = np.where(one, self.zeros[level] + a, low - a)
            high = np.where(one, self.zeros[level] + b, high - b)
        return total

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank ``k`` (from 0) among those at places ``low`` to ``high``."""
        value = np.zeros(len(low), dtype=np.int64)
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            zeros = (high - b) - (low - a)
            one = k >= zeros
            k = np.where(one, k - zeros, k)
            value = (value << 1) | one
            low = np.where(one, self.zeros[level] + a, low - a)
            high = np.where(one, self.zeros[level] + b, high - b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least value of at least ``bound`` at places ``low`` to ``high``, -1 where there is none."""
        less = self.below(low, high, bound)
        out = np.full(len(low), -1, dtype=np.int64)
        some = less < high - low
        out[some] = self.smallest(low[some], high[some], less[some])
        return out


def _doubled(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array by prefix doubling, which positions start a pair of words that repeats, and for each block length
    from 2 on the grid positions whose block repeats with the range of their block in the suffix array.

    The last entry of every document is an id of its own, so equal blocks never cross the end of one. Sorting stops
    at blocks of ``longest`` words; the order of suffixes that are equal up to there is left open.
    """
    n = len(ids)
    slot = np.empty(n, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    slot[order] = np.arange(n)
    held = np.bincount(ids)
    left = np.cumsum(held) - held
    rank, size = left[ids], held[ids]
    active = order[size[order] > 1]
    grid, pairs, length = [], np.zeros(n, dtype=bool), 1
    while len(active) and length < longest:
        key = rank[active] * n + rank[active + length]
        by = np.argsort(key, kind="stable")
        s, key = active[by], key[by]
        old = rank[s]
        at = np.arange(len(s))
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(s)))
        slot[s] = old + at - group
        rank[s] = np.repeat(slot[s][starts], sizes)
        size[s] = np.repeat(sizes, sizes)
        active = s[size[s] > 1]
        length *= 2
        if length == 2:
            pairs[active] = True
        asked = active[active % max(1, length // 2) == 0]
        grid.append((length, asked, rank[asked], rank[asked] + size[asked]))
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[slot] = np.arange(n)
    return suffixes, pairs, grid


def _candidates(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """``(position, period)``: blocks whose next occurrence starts at most a block length on.

    Occurrences of a block in such a window form a progression; in a run whose period is at most the block's
    length its step is the period, and it starts with the next occurrence.
    """
    at = [np.flatnonzero(ids[1:] == ids[:-1])]
    period = [np.ones(len(at[0]), dtype=np.int64)]
    suffixes, pairs, grid = _doubled(ids, longest)
    kept = pairs[suffixes]
    if kept.any():
        place = np.append(0, np.cumsum(kept))
        tree = WaveletMatrix(suffixes[kept], len(ids))
        for length, asked, low, high in grid:
            found = tree.successor(place[low], place[high], asked + 1)
            near = (found >= 0) & (found <= asked + length)
            at.append(asked[near])
            period.append(found[near] - asked[near])
    return np.concatenate(at), np.concatenate(period)


def _reach(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How far the sequences from i and j agree, going forward (step 1) or backward (step -1)."""
    done, size = 0, 64
    while True:
        if step > 0:
            a, b = ids[i + done : i + done + size], ids[j + done : j + done + size]
        else:
            a, b = ids[max(0, i + 1 - done - size) : max(0, i + 1 - done)][::-1], ids[max(0, j + 1 - done - size) : max(0, j + 1 - done)][::-1]
        n = min(len(a), len(b))
        if not n:
            return done
        differ = a[:n] != b[:n]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + n, 2 * size


def word_runs(ids: np.ndarray, longest: int, least_length: int = 6, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows ``(start, length, period)``, sorted, of all runs of a sequence in which every document ends with an id of its own.

    ``longest`` is the number of words of the longest document.
    """
    at, period = _candidates(ids, max(1, 2 * longest // least_exponent))
    order = np.lexsort((at, period))
    found, known, until = [], 0, -1
    for i, q in zip(at[order].tolist(), period[order].tolist()):
        if q == known and i < until:
            continue
        known, until = q, i + _reach(ids, i, i + q, 1)
        start = i - _reach(ids, i - 1, i - 1 + q, -1) if i else 0
        length = until + q - start
        if length >= max(least_length, least_exponent * q):
            found.append((start, length, q))
    return np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 3)


def _of_slice(data: np.ndarray, offsets: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, its runs (rows and the first of each document), its kept words as bytes with their offsets."""
    starts, ends, first = word_spans(data, offsets)
    n_words, n_docs = np.diff(first), len(first) - 1
    names, words = np.unique(hash_words(data, starts, ends), return_inverse=True)
    owner = np.repeat(np.arange(n_docs), n_words)
    ids = np.empty(len(words) + n_docs, dtype=np.int64)
    ids[np.arange(len(words)) + owner] = words
    stops = first[1:] + np.arange(n_docs)
    ids[stops] = len(names) + np.arange(n_docs)
    runs = word_runs(ids, int(n_words.max(initial=0)), least_length, least_exponent)
    doc = np.searchsorted(stops, runs[:, 0])
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = (np.cumsum(step)[: len(ids)] == 0)[np.arange(len(words)) + owner]
    runs[:, 0] -= first[doc] + doc
    packed, _, stop = packed_words(data, starts[kept], ends[kept])
    last = np.searchsorted(owner[kept], np.arange(n_docs + 1))
    bound = np.append(0, stop + 1)[last]
    sizes = np.maximum(np.diff(bound) - 1, 0)
    solid = np.ones(len(packed), dtype=bool)
    solid[bound[1:][np.diff(bound) > 0] - 1] = False
    return n_words, runs, np.searchsorted(doc, np.arange(n_docs + 1)), packed[solid], np.append(0, np.cumsum(sizes))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``(key, n_words, runs, collapsed)`` of every row: its periodic runs and its text with each run cut to one period.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch whose smallest period q repeats at least
    ``least_exponent`` times over at least ``least_length`` words and that no neighbouring word extends; ``runs`` holds
    ``(start, length, period)`` by start, then period. ``collapsed`` joins by one space the words that no run contains
    after its first period. Null, empty and blank texts have no words, no runs and an empty text. Rows are looked at one
    by one, so repeated keys, null keys and other columns change nothing; nothing is shuffled. Memory is linear in the longest
    text. Exponents below 4 aren't found by the grid of blocks and raise an error. Words are compared by 64-bit hashes.
    """
    if least_exponent < LEAST_EXPONENT:
        raise ValueError(f"least_exponent must be at least {LEAST_EXPONENT}")
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for low, high in row_slices(offsets):
                part = offsets[low : high + 1]
                n_words, runs, first, packed, bounds = _of_slice(data[part[0] : part[-1]], part - part[0], least_length, least_exponent)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], fields)
                listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), rows)
                texts = pa.StringArray.from_buffers(high - low, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(packed))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n_words.astype(np.int64)), listed, texts], ["k", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    shape = f"k {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, shape).withColumnRenamed("k", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` where a tenth of the texts, chosen by a checksum of the key, goes on with a period from some word on.

    With h the CRC-32 of the key in decimal, g = floor(h / 10) and n words: if h % 10 = 0 and n > 0, each word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null key chooses nothing.
    """
    words = F.filter(F.split(F.col("t"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.crc32(F.col(key).cast("string").cast("binary")).alias("h"))
    chosen = F.col("h").isNotNull() & (F.col("h") % 10 == 0)
    rows = rows.withColumn("w", F.when(chosen, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    told = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(period, turns))), F.lit(1), F.col("n")), " ")
    return rows.select(F.col("k").alias(key), F.when(F.col("a").isNotNull(), told).otherwise(F.col("t")).alias(text))


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the one of greatest exact exponent (ties: smallest start, then period), and digests of runs and rest."""
    empty = F.lit(None).cast("struct<start: long, length: long, period: long>")
    higher = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    best = F.aggregate("runs", empty, lambda x, y: F.when(x.isNull() | higher(x, y), y).otherwise(x))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.select("*", best.alias("best"), lines.alias("lines"))
    return rows.withColumns({
        "n_runs": F.size("runs").cast("long"), "start": F.col("best.start"), "length": F.col("best.length"), "period": F.col("best.period"),
        "exponent_milli": F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long"),
        "runs_sha256": F.sha2("lines", 256), "collapsed_sha256": F.sha2("collapsed", 256),
    }).drop("best", "lines", "runs", "collapsed")

"""Benchmark passages in documents, found by latent semantic retrieval and checked by common subsequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_words, map_arrow, mixed, row_slices, stored, text_buffer

#: Hash buckets of words, latent dimensions, further dimensions of the random projection, power iterations.
BUCKETS = 1 << 15
RANK = 48
EXTRA = 8
POWER = 1
#: Added to squared singular values when directions are evened out, so that those of few passages stay as they are.
RIDGE = 10.0
#: Passages that the decomposition starts from, about, before all of them have their say, and the words of a passage. All passages
#: together weigh as many as these beside the items.
SAMPLE = 20_000
PASSAGE = 40
#: Least latent cosine of a candidate, step from one window length to the next, windows that begin in one length.
COSINE = 0.3
GROWTH = 1.5
STARTS = 4
#: Least share of an item's words in order, and the one that suffices if its answer is there too.
SHARE = 0.8
SHARE_WITH_ANSWER = 0.6

_SLICE_BYTES = 1 << 18
_STRETCH = 2048
_ITEMS = 256
_BLOCK = 1 << 10
_PART = 1 << 7
_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = True
_LETTER[[c for c in range(128) if chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, and the first word of each (n + 1 entries). Words are runs of letters, digits
    and bytes above 127; A-Z are lower-cased."""
    solid = _LETTER[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges] = False
    after[edges - 1] = False
    begin = np.flatnonzero(solid & ~before)
    return hash_words(_LOWER[data], begin, np.flatnonzero(solid & ~after) + 1), np.searchsorted(begin, offsets)


def _rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(column)
    for low, high in row_slices(offsets, _SLICE_BYTES):
        part = offsets[low : high + 1]
        yield low, high, *words_of(data[part[0] : part[-1]], part - part[0])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _summed_blocks(df: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Sums of the blocks ``(b, data)`` of double-precision arrays, formed as the rows stream in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[b] = sums.get(b, 0) + np.frombuffer(data, dtype=np.float64)
        for b, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["b", "data"])

    return {r["b"]: np.frombuffer(r["data"], dtype=np.float64) for r in map_arrow(df.repartition(n, "b"), add, "b int, data binary").collect()}


def _scan(docs: DataFrame, text: str, rate: float) -> DataFrame:
    """``(b, data)``: counts of documents by bucket in blocks, the numbers of documents and of passages as block -1, as block -2
    each passage whose content hash falls under the rate, and as block -3 all passages of a slice of rows."""
    least = np.uint64(min(int(rate * 2.0**64), (1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS)
        n = many = 0
        for batch in batches:
            passages, slices = [], []
            for _, _, h, first in _rows(batch.column(0)):
                b = _bucket(h)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                seen = np.sort(row * BUCKETS + b)
                if len(seen):
                    seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])]
                table += np.bincount(seen & (BUCKETS - 1), minlength=BUCKETS)
                at = np.concatenate([np.arange(x, y, PASSAGE) for x, y in zip(first[:-1], first[1:])]) if len(h) else np.zeros(0, dtype=np.int64)
                if len(at):
                    size = np.minimum(PASSAGE, first[1:][row[at]] - at)
                    sums = np.add.reduceat(mixed(h), at)
                    for k in np.flatnonzero(mixed(sums) <= least):
                        passages.append(b[at[k] : at[k] + size[k]].astype(np.int32).tobytes())
                    many += len(at)
                    slices.append(np.int32(len(at)).tobytes() + size.astype(np.uint8).tobytes() + b.astype(np.uint16).tobytes())
            n += batch.num_rows
            for kind, found in ((-2, passages), (-3, slices)):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.int32()), pa.array(found, pa.binary())], ["b", "data"])
        blocks = [(b, table[b * _BLOCK : (b + 1) * _BLOCK]) for b in range(BUCKETS // _BLOCK)] + [(-1, np.array([float(n), float(many)]))]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], ["b", "data"])

    return map_arrow(docs.select(text), run, "b int, data binary")


def _weighted(buckets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A passage as unit TF-IDF vector: its buckets and their weights."""
    b, n = np.unique(buckets, return_counts=True)
    w = n * idf[b]
    return b, w / max(float(np.linalg.norm(w)), 1e-12)


def randomized_svd(passages: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA, power: int = POWER) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (buckets x rank) and singular values of the TF-IDF matrix of ``(id, data)`` passages.

    The matrix stays distributed. Products with a narrow matrix on its right are formed row by row, products on its
    left as sums over tasks; only matrices of the sketch's width reach the driver: ``SAMPLE`` rows or ``BUCKETS`` rows.
    """
    spark = passages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = rank + extra

    def right(m: np.ndarray | None) -> np.ndarray:
        """The matrix times m, rows by id; without m times a random matrix that every task draws alike."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = np.random.default_rng(0).standard_normal((BUCKETS, width), dtype=np.float32) if m is None else m
            for batch in batches:
                out = []
                for data in batch.column(1).to_pylist():
                    b, w = _weighted(np.frombuffer(data, dtype=np.int32), idf)
                    out.append((w @ by[b]).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "data"])

        rows = map_arrow(passages, run, "id long, data binary").collect()
        out = np.zeros((len(rows), width))
        for r in rows:
            out[r["id"]] = np.frombuffer(r["data"], dtype=np.float64)
        return out

    def left(q: np.ndarray) -> np.ndarray:
        """The transposed matrix times q, rows by bucket; a task hands on the rows of the buckets it has met."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, width))
            for batch in batches:
                for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    b, w = _weighted(np.frombuffer(data, dtype=np.int32), idf)
                    total[b] += w[:, None] * q[i][None, :]
            met = np.flatnonzero(total.any(axis=1))
            for low in range(0, len(met), 4096):
                b = met[low : low + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array([x.tobytes() for x in total[b].astype(np.float32)], pa.binary())], ["b", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, width))
            for batch in batches:
                rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, width)
                np.add.at(total, batch.column(0).to_numpy(), rows)
            met = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array([x.tobytes() for x in total[met].astype(np.float32)], pa.binary())], ["b", "data"])

        schema = "b int, data binary"
        sums = map_arrow(map_arrow(passages, run, schema).repartition(n, "b"), add, schema)
        out = np.zeros((BUCKETS, width), dtype=np.float32)
        for r in sums.collect():
            out[r["b"]] = np.frombuffer(r["data"], dtype=np.float32)
        return out

    m = None
    for _ in range(power + 1):
        y = right(m)
        q = np.zeros_like(y, dtype=np.float32)  # fewer passages than columns leave some empty
        q[:, : min(y.shape)] = np.linalg.qr(y)[0]
        m = left(q)
    _, values, axes = np.linalg.svd(m.T.astype(np.float64), full_matrices=False)
    k = max(1, min(rank, int((values > 1e-5 * values[0]).sum())))
    return axes[:k].T, values[:k]


def _entries(data: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, bucket and weight of the entries of a slice's passages as unit TF-IDF vectors, in order of passage."""
    n = int(np.frombuffer(data, dtype=np.int32, count=1)[0])
    size = np.frombuffer(data, dtype=np.uint8, count=n, offset=4).astype(np.int64)
    key = np.sort(np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, size) + np.frombuffer(data, dtype=np.uint16, offset=4 + n))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    passage, bucket = np.divmod(key[at], BUCKETS)
    w = np.diff(np.append(at, len(key))) * idf[bucket]
    norm = np.sqrt(np.bincount(passage, w * w, minlength=n))
    return passage, bucket, w / np.maximum(norm, 1e-12)[passage]


def _times_gram(scanned: DataFrame, idf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The TF-IDF matrix of all passages, transposed, times itself times m; only sums of m's shape leave a task."""
    width, m = m.shape[1], np.ascontiguousarray(m, dtype=np.float32)
    n = int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, BUCKETS))
        for batch in batches:
            for data in batch.column(0):
                passage, bucket, w = _entries(data.as_py(), idf)
                rows = m.take(bucket, axis=0)
                rows *= w.astype(np.float32)[:, None]
                # no passage is empty, so passages are numbered as the rows of this
                y = np.add.reduceat(rows, np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])), axis=0)
                for column, part in zip(np.ascontiguousarray(y.T, dtype=np.float64), total):
                    part += np.bincount(bucket, column.take(passage) * w, BUCKETS)
        parts = np.ascontiguousarray(total.T).reshape(-1, _PART * width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["b", "data"])

    blocks = _summed_blocks(map_arrow(scanned.filter("b = -3").select("data"), run, "b int, data binary"), n)
    return np.concatenate([blocks.get(b, np.zeros(_PART * width)) for b in range(BUCKETS // _PART)]).reshape(BUCKETS, width)


def whole_svd(scanned: DataFrame, own: list[np.ndarray], idf: np.ndarray, axes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of the matrix of all passages, times the root of ``share``, and of the items' rows
    ``own`` (buckets), by a step of subspace iteration from ``axes``."""
    z = share * _times_gram(scanned, idf, axes)
    for buckets in own:
        b, w = _weighted(buckets, idf)
        z[b] += w[:, None] * (w @ axes[b])
    # z = G axes for the Gram matrix G; with axes' G axes = L L' the columns of z L'^-1 are those of A' q, q an orthonormal basis of A axes
    inner = axes.T @ z
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > 1e-10 * max(values[-1], 1e-300)
    u, s, _ = np.linalg.svd(z @ (turn[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    k = max(1, int((s > 1e-5 * s[0]).sum()))
    return u[:, :k], s[:k]


class Item(NamedTuple):
    """A benchmark passage: its words, those of its answer, and its latent direction."""

    item: object
    words: list[int]
    answer: list[int]


_SENTENCE = re.compile(r"[^.!?\n]*[^\W_][^.!?\n]*")


def item_of(key, text: str) -> Item | None:
    """The answer of an item is its last sentence or line, if that has three words and is less than half of it."""
    words = lambda s: words_of(*text_buffer(pa.array([s])))[0].tolist()
    own = words(text)
    if not own:
        return None
    sentences = _SENTENCE.findall(text)
    answer = words(sentences[-1]) if sentences else []
    return Item(key, own, answer if 3 <= len(answer) < len(own) / 2 else [])


def word_masks(item: list[int]) -> dict[int, int]:
    """For each word of an item the bits of its places there."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _in_order(hits: list[int], n: int) -> int:
    """Length of the longest common subsequence of an item of n words and a text, given the masks of the text's words that the item
    has, by bit-parallel rows."""
    row = full = (1 << n) - 1
    for m in hits:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence."""
    return _in_order([*filter(None, map(word_masks(item).get, text))], len(item))


def _holds(text: list[int], part: list[int]) -> bool:
    n = len(part)
    return any(text[i : i + n] == part for i, w in enumerate(text[: len(text) - n + 1]) if w == part[0])


class Finder:
    """Searches word sequences for benchmark items."""

    def __init__(self, items: list[Item], table: np.ndarray, idf: np.ndarray, cosine: float) -> None:
        self.items, self.table, self.cosine = items, np.ascontiguousarray(table), cosine  # rows are gathered
        self.masks = [word_masks(i.words) for i in items]
        scales = [8]
        longest = max((len(i.words) for i in items), default=0)
        while scales[-1] < longest:
            scales.append(max(scales[-1] + 1, round(scales[-1] * GROWTH)))
        self.groups: dict[int, list[int]] = {}
        for n, item in enumerate(items):
            self.groups.setdefault(min(scales, key=lambda s: abs(np.log(s / len(item.words)))), []).append(n)
        self.queries = np.concatenate([self._queries(own) for own in self.groups.values()])
        # if SHARE_WITH_ANSWER of an item is there, then so are that many of its rarest words: for each word, the items
        # it is rare for (as their places in ``order``), from ``begins`` on; a last word, rare nowhere, stands for all others
        self.order = np.array([n for own in self.groups.values() for n in own], dtype=np.int64)
        pairs, self.need = [], np.zeros(len(items), dtype=np.int32)
        for at, n in enumerate(self.order):
            words = np.array(items[n].words, dtype=np.uint64)
            rarest = np.unique(words[np.argsort(-idf[_bucket(words)], kind="stable")[: -(-len(words) * 3 // 5)]])
            pairs.append((rarest, np.full(len(rarest), at, dtype=np.int32)))
            self.need[at] = max(1, int(np.ceil(np.isin(words, rarest).sum() - (1 - SHARE_WITH_ANSWER) * len(words) - 1e-9)))
        rare, holder = np.concatenate([w for w, _ in pairs]), np.concatenate([i for _, i in pairs])
        by = np.argsort(rare, kind="stable")
        self.known, begins = np.unique(rare[by], return_index=True)
        self.begins, self.holders = np.concatenate([begins, [len(rare), len(rare)]]), holder[by]
        # blocks of items of bounded number: (first, last, length of their windows) in ``order``
        self.blocks: list[tuple[int, int, int]] = []
        low = 0
        for size, own in self.groups.items():
            for k in range(low, low + len(own), _ITEMS):
                self.blocks.append((k, min(k + _ITEMS, low + len(own)), size))
            low += len(own)

    def _queries(self, own: list[int]) -> np.ndarray:
        z = np.stack([self.table[_bucket(np.array(self.items[n].words, dtype=np.uint64))].sum(axis=0) for n in own])
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def _hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, item)`` of the words that are rare for an item, in order of place; items as places in ``order``."""
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        k = np.where(self.known[k] == h, k, len(self.known))
        n = self.begins[k + 1] - self.begins[k]
        upto = np.cumsum(n)
        return np.repeat(np.arange(len(h)), n), self.holders[np.arange(n.sum()) + np.repeat(self.begins[k] - upto + n, n)]

    def candidates(self, h: np.ndarray, first: np.ndarray, bounded: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: the first words of windows, and the items they are close to.

        A window's latent direction is the difference of two running sums, taken over stretches that stay in cache. If
        ``bounded``, candidates are left out that have too few of the item's rarest words around them to reach the least
        share. Their number is the difference of two running counts of the item's rare words, kept for a block of items.
        """
        stop = np.repeat(first[1:], np.diff(first))  # where the row of each word ends
        start = np.repeat(first[:-1], np.diff(first))
        reach = max(self.groups)
        bucket = _bucket(h)
        place = np.arange(len(h)) - start  # of each word in its row, where the grid begins
        hit_place, hit_item = self._hits(h) if bounded else (None, None)
        for begin in range(0, len(h), _STRETCH):
            end = min(begin + _STRETCH, len(h))
            far = min(end + reach, len(h))
            upto = np.zeros((far - begin + 1, self.table.shape[1]), dtype=np.float32)
            np.cumsum(self.table.take(bucket[begin:far], axis=0), axis=0, out=upto[1:])
            if bounded:
                back, ahead = max(begin - reach, 0), min(end + 2 * reach, len(h))
                part = slice(*np.searchsorted(hit_place, [back, ahead]))
                places, holders = hit_place[part] - (back - 1), hit_item[part]
            for low, high, size in self.blocks:
                step = max(size // STARTS, 1)
                at = begin + np.flatnonzero(place[begin:end] % step == 0)
                z = upto.take(np.minimum(at + size, stop[at]) - begin, axis=0) - upto.take(at - begin, axis=0)
                norm = np.sqrt(np.einsum("ij,ij->i", z, z))
                close = self.queries[low:high] @ z.T > self.cosine * norm
                live = np.arange(high - low)
                if bounded:
                    # counted only for items that are close somewhere and have enough of their rarest words in all of this
                    slot = np.full(high - low, -1)
                    own = (holders >= low) & (holders < high)
                    enough = np.bincount(holders[own] - low, minlength=high - low) >= self.need[low:high]
                    live = np.flatnonzero(enough & close.any(axis=1))
                    if not len(live):
                        continue
                    slot[live] = np.arange(len(live))
                    to, word = slot[holders[own] - low], places[own]
                    counts = np.zeros((len(live), ahead - back + 1), dtype=np.int16 if ahead - back < 1 << 15 else np.int32)
                    counts[to[to >= 0], word[to >= 0]] = 1
                    np.cumsum(counts, axis=1, dtype=counts.dtype, out=counts)
                    around = counts.take(np.minimum(at + 2 * size, stop[at]) - back, axis=1)
                    around -= counts.take(np.maximum(at - size, start[at]) - back, axis=1)
                    close = close[live] & (around >= self.need[low + live, None].astype(counts.dtype))
                q, w = np.divmod(np.flatnonzero(close), len(at))
                if len(w):
                    yield size, at[w], self.order[low + live[q]]

    def matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """``(row, item, words in order, share)`` of the items found in each row, at their best place."""
        best: dict[tuple[int, int], int] = {}
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, at, items in self.candidates(h, first, bounded=True):
            # around each window what an item of this length could cover, other words between its own included
            low = np.maximum(at - size, first[row[at]])
            high = np.minimum(at + 2 * size, first[row[at] + 1])
            for k in range(len(items)):
                n = int(items[k])
                item, here = self.items[n], (int(row[at[k]]), n)
                if best.get(here) == len(item.words):
                    continue
                text = h[low[k] : high[k]].tolist()
                hits = [*filter(None, map(self.masks[n].get, text))]
                if len(hits) / len(item.words) < SHARE_WITH_ANSWER:
                    continue  # no more words in order than words at all
                found = _in_order(hits, len(item.words))
                share = found / len(item.words)
                if share >= SHARE or (share >= SHARE_WITH_ANSWER and item.answer and _holds(text, item.answer)):
                    best[here] = max(best.get(here, 0), found)
        for (r, n), found in best.items():
            yield r, n, found, found / len(self.items[n].words)


def fit_finder(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", cosine: float = COSINE) -> Finder | None:
    """Count words over all documents, decompose all of their passages with all items, and place the items. The decomposition starts
    from that of a sample of passages.

    The benchmark is the set of queries and travels with the tasks; split a very large one and search part by part.
    """
    held = [i for r in benchmark.select(item, text).collect() if r[1] and (i := item_of(r[0], r[1]))]
    if not held:
        return None
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    scanned = stored(_scan(docs, text, SAMPLE * PASSAGE * 6 / max(size, 1)), "words")
    blocks = _summed_blocks(scanned.filter("b > -2"), n)
    count = blocks[-1][0] if -1 in blocks else 0.0
    df = np.concatenate([blocks.get(b, np.zeros(_BLOCK)) for b in range(BUCKETS // _BLOCK)])
    idf = np.log((count + 1) / (df + 1)) + 0.1
    buckets = [_bucket(np.array(i.words, dtype=np.uint64)) for i in held]
    own = docs.sparkSession.createDataFrame(pa.table({"data": pa.array([b.astype(np.int32).tobytes() for b in buckets], pa.binary())}))
    # ids from 0 on for the sketch's rows: the sample is bounded, copies of a passage being one, so one window over it is too
    both = scanned.filter("b = -2").select("data").distinct().unionByName(own)
    numbered = stored(both.selectExpr("data", "row_number() over (order by xxhash64(data)) - 1 as id").selectExpr("cast(id as long) as id", "data").repartition(n), "passages")
    axes, _ = randomized_svd(numbered, idf)
    many = blocks[-1][1] if -1 in blocks else 0.0
    axes, values = whole_svd(scanned, buckets, idf, axes, min(1.0, SAMPLE / max(many, 1.0)))
    return Finder(held, (axes / np.sqrt(values**2 + RIDGE) * idf[:, None]).astype(np.float32), idf, cosine)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", cosine: float = COSINE) -> DataFrame:
    """``(key, item, n_common, n_item, share)``: benchmark items that stand in a document.

    Every document is searched as a whole: windows of about each item's length, a quarter of it apart, are folded
    into the latent space; those close to an item, with enough of its rarest words around them, are checked by the longest common subsequence with the words around
    them. A share of ``SHARE`` of the item's words in order is a leak, a smaller one of ``SHARE_WITH_ANSWER`` if the
    item's answer stands there word for word. Null and empty texts and items give nothing, repeated rows each their
    own rows; an empty benchmark gives an empty result.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"k {kind}, i {item_kind}, n_common long, n_item long, share double"
    finder = fit_finder(docs, benchmark, text, item, cosine)
    item_type = pa.array([], pa.int64()).type if finder is None else benchmark.select(item).limit(1).toArrow().column(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for low, _, h, first in _rows(batch.column(1)):
                if finder and len(h):
                    rows += [(low + r, finder.items[n].item, found, len(finder.items[n].words), share) for r, n, found, share in finder.matches(h, first)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], item_type), *(pa.array([r[i] for r in rows], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64())))],
                ["k", "i", "n_common", "n_item", "share"],
            )

    if finder is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnsRenamed({"k": key, "i": item})
    return map_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, schema).withColumnsRenamed({"k": key, "i": item})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    finder = fit_finder(docs, benchmark, text, **options)
    if finder is None:
        return docs

    def leaks(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), dtype=bool)
        for low, _, h, first in _rows(column):
            if len(h):
                for r, *_ in finder.matches(h, first):
                    out[low + r] = True
        return pa.array(out)

    return docs.filter(~F.arrow_udf(leaks, "boolean")(F.col(text)))

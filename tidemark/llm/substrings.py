"""Removal of word spans that occur earlier in the corpus, by suffix automata over shards of repeated passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_words, map_arrow, mixed, packed_text, packed_words, row_slices, stored, text_buffer, unpacked_text, word_spans

#: Words of the runs whose least hash chooses the shard of a window.
ANCHOR = 8
#: Pieces of one anchor that one automaton takes; an anchor with more is cut into single windows.
SHARD_PIECES = 1024
#: What a digest holds for each document, besides its key.
DIGEST = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}


class SuffixAutomaton:
    """The suffix automaton of a growing sequence of words; it knows every run of words put in so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.last = 0

    def extend(self, word) -> None:
        at, p = len(self.size), self.last
        self.next.append({})
        self.size.append(self.size[p] + 1)
        self.link.append(0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = at
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.size[p] + 1 == self.size[q]:
                self.link[at] = q
            else:
                copy = len(self.size)
                self.next.append(dict(self.next[q]))
                self.size.append(self.size[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = self.link[at] = copy
        self.last = at

    def follow(self, state: int, length: int, word) -> tuple[int, int]:
        """The longest suffix of the matched run and ``word`` that occurs, as state and length."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0


def earlier_windows(pieces: list[list], window: int) -> list[list[bool]]:
    """For every window of every piece, whether it occurs in a piece before, or earlier in its own piece.

    The pieces stream through an automaton that holds what came before: each word first moves the match, whose
    length is the matching statistic, and then extends the automaton.
    """
    automaton, out = SuffixAutomaton(), []
    for n, words in enumerate(pieces):
        state = length = 0
        if n:
            automaton.extend(("", n))  # a word that no text has keeps pieces apart
        seen = []
        for i, word in enumerate(words):
            state, length = automaton.follow(state, length, word)
            automaton.extend(word)
            # a clone made just now may have split the matched state
            while state and automaton.size[automaton.link[state]] >= length:
                state = automaton.link[state]
            if i >= window - 1:
                seen.append(length >= window)
        out.append(seen)
    return out


class _Slice:
    """Words of a range of rows, and for each window of words the anchor that chooses its shard."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> None:
        self.data = data
        self.starts, self.ends, self.first = word_spans(data, offsets)
        n = len(self.starts)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        empty = np.zeros(0, dtype=np.int64)
        self.at, self.pick, self.hash = empty, empty, empty.view(np.uint64)
        if n < window:
            return
        grams = hash_words(data, self.starts, self.ends)
        size = 1
        factor = 0x9E3779B97F4A7C15
        while size < anchor:  # the anchor's size is a power of two
            grams = mixed(grams[:-size] * np.uint64(factor) + grams[size:])
            factor = factor * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1) | 1
            size *= 2
        span = window - anchor + 1
        whole = np.flatnonzero(self.row[: n - window + 1] == self.row[window - 1 :])
        self.at = whole  # first word of each window
        self.pick = whole + sliding_window_view(grams, span).argmin(axis=1)[whole]
        self.hash = grams[self.pick]


def _slices(column: pa.Array, window: int, anchor: int) -> Iterator[tuple[int, int, _Slice]]:
    data, offsets = text_buffer(column)
    for low, high in row_slices(offsets):
        part = offsets[low : high + 1]
        yield low, high, _Slice(data[part[0] : part[-1]], part - part[0], window, anchor)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def _anchor_counts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, s in _slices(batch.column(0), window, anchor):
                if len(s.pick):
                    own = s.hash[_changes(s.pick)[:-1]]
                    h, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return map_arrow(docs.select("t"), run, "h long, n long")


def _doc_anchors(docs: DataFrame, kind: str, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, s in _slices(batch.column(1), window, anchor):
                if len(s.pick):
                    begin = _changes(s.pick)[:-1]
                    row, h = s.row[s.pick[begin]], s.hash[begin]
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    one = _changes(row, h)[:-1]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[one] + low)), pa.array(h[one].view(np.int64))], ["k", "h"])

    return map_arrow(docs.select("k", "t"), run, f"k {kind}, h long")


def _shared_windows(s: _Slice, low: int, hashes: pa.Array) -> np.ndarray:
    """Of a slice's windows, those whose anchor is among the given ones of their row."""
    sizes = np.asarray(hashes.value_lengths().fill_null(0))
    flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    begin = _changes(s.pick)
    row, h = s.row[s.pick[begin[:-1]]], s.hash[begin[:-1]]
    n_rows = len(s.first) - 1
    owner = np.repeat(np.arange(n_rows), sizes[low : low + n_rows])
    mine = flat[upto[low] : upto[low + n_rows]]
    # one sorted list of (row, hash) in a mix of both; a stray match of 64-bit mixes only adds a candidate
    known = np.sort(mixed(mine + owner.astype(np.uint64)))
    asked = mixed(h + row.astype(np.uint64))
    place = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    hit = known[place] == asked if len(known) else np.zeros(len(asked), dtype=bool)
    return np.repeat(hit, np.diff(begin))


def _pieces(marked: DataFrame, kind: str, window: int, anchor: int) -> DataFrame:
    """``(h, piece, k, a)``: for every repeated anchor of a row the words of all its windows, and the first of them;
    equal pieces of a row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, s in _slices(unpacked_text(batch.column(1)), window, anchor):
                if not len(s.at):
                    continue
                keep = _shared_windows(s, low, batch.column(2))
                at, pick, h = s.at[keep], s.pick[keep], s.hash[keep]
                begin = _changes(pick)
                first, last = at[begin[:-1]], at[begin[1:] - 1] + window - 1 if len(at) else at
                if not len(at):
                    continue
                packed, start, stop = packed_words(s.data, s.starts, s.ends)
                held, row = packed.tobytes(), s.row[first]
                seen: set[tuple[int, bytes]] = set()
                rows, text = [], []
                for i, (r, x, y) in enumerate(zip(row.tolist(), start[first].tolist(), stop[last].tolist())):
                    piece = (r, held[x:y])
                    if piece not in seen:
                        seen.add(piece)
                        rows.append(i)
                        text.append(piece[1])
                rows = np.array(rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[begin[:-1]][rows].view(np.int64)),
                        pa.array(text, pa.binary()).cast(pa.string()),
                        batch.column(0).take(pa.array(row[rows] + low)),
                        pa.array(first[rows] - s.first[row[rows]]),
                    ],
                    ["h", "piece", "k", "a"],
                )

    return map_arrow(marked, run, f"h long, piece string, k {kind}, a long")


def _first_windows(pieces: list[list[bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each piece of one anchor, in corpus order, the runs ``(offset, count)`` of its windows that occur nowhere
    before."""
    if len(pieces) == 1 and len({tuple(pieces[0][i : i + window]) for i in range(len(pieces[0]) - window + 1)}) == len(pieces[0]) - window + 1:
        return [[(0, len(pieces[0]) - window + 1)]]
    out = []
    for seen in earlier_windows(pieces, window):
        runs, at = [], None
        for i, old in enumerate([*seen, True]):
            if not old and at is None:
                at = i
            elif old and at is not None:
                runs.append((at, i - at))
                at = None
        out.append(runs)
    return out


def _first_in_shards(pieces: DataFrame, kind: str, window: int) -> DataFrame:
    """``(k, a, n)``: runs of windows at their first place, from pieces that are sorted by anchor and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words, keys, places = None, [], [], []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for k, a, runs in zip(keys, places, _first_windows(words, window)):
                for offset, n in runs:
                    for held, value in zip(out, (k, a + offset, n)):
                        held.append(value)

        def emit() -> pa.RecordBatch:
            done = [pa.array(out[0], key_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())]
            for held in out:
                held.clear()
            return pa.RecordBatch.from_arrays(done, ["k", "a", "n"])

        key_type = None
        for batch in batches:
            key_type = batch.column(2).type
            for h, piece, k, a in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if h != shard:
                    if words:
                        close()
                    shard = h
                    words, keys, places = [], [], []
                words.append(piece.split(" "))
                keys.append(k)
                places.append(a)
            if out[0]:
                yield emit()
        if words:
            close()
            yield emit()

    return map_arrow(pieces.select("h", "piece", "k", "a"), run, f"k {kind}, a long, n long")


def _single_windows(pieces: DataFrame, kind: str, window: int) -> DataFrame:
    """The windows of pieces, one by one, at their first place: ``(k, a, n)`` with n = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text, at = [], [], []
            for i, (piece, a) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                words, seen = piece.split(" "), set()
                for j in range(len(words) - window + 1):
                    own = " ".join(words[j : j + window])
                    if own not in seen:
                        seen.add(own)
                        row.append(i)
                        text.append(own)
                        at.append(a + j)
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), batch.column(1).take(pa.array(row, pa.int32())), pa.array(at, pa.int64())], ["w", "k", "a"])

    windows = map_arrow(pieces.select("piece", "k", "a"), run, f"w string, k {kind}, a long")
    # of one document two pieces may hold the window: the earlier place counts
    own = windows.groupBy("w", "k").agg(F.min("a").alias("a"))
    return own.groupBy("w").agg(F.min("k").alias("k"), F.min_by("a", "k").alias("a")).select("k", "a", F.lit(1).cast("long").alias("n"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, anchor: int = ANCHOR, shard: int = SHARD_PIECES) -> DataFrame:
    """``(k, hashes, firsts)`` for documents with shared passages: the anchors they share, and the runs of windows
    ``(a, n)`` that are at their first place in the corpus. All other windows with a shared anchor are repeats.

    A window's anchor is the run of ``anchor`` words with the least hash in it, so equal windows have equal anchors.
    Automata of the whole corpus could only be broadcast shard by shard, every document passing each of them. Here
    each passage visits the one shard that can hold it: only windows with an anchor that occurs twice go on, equal
    pieces of text become one row before any shard sees them, and a shard is what shares an anchor. An anchor with
    more than ``shard`` different pieces is cut into windows, whose first places are minima combined before the
    shuffle. So no task holds more than a shard, whatever repeats.
    """
    kind = docs.schema[key].dataType.simpleString()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lean = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    counts = _anchor_counts(lean, window, anchor).groupBy("h").agg(F.sum("n").alias("n"))
    repeated = stored(counts.filter("n > 1").select("h"), "anchors")
    shared = stored(_doc_anchors(lean, kind, window, anchor).join(repeated, "h").groupBy("k").agg(F.collect_set("h").alias("hashes")), "shared")
    moved = lean.select("k", packed_text(F.col("t")).alias("t"))
    pieces = _pieces(moved.join(shared, "k").select("k", "t", "hashes"), kind, window, anchor)
    distinct = stored(pieces.groupBy("h", "piece").agg(F.min("k").alias("k"), F.min_by("a", "k").alias("a")), "pieces")
    crowded = stored(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > shard).select("h"), "crowded")
    shards = distinct.join(crowded, "h", "left_anti").repartition(n, "h").sortWithinPartitions("h", "k", "a")
    firsts = _first_in_shards(shards, kind, window).unionByName(_single_windows(distinct.join(crowded, "h", "left_semi"), kind, window))
    runs = firsts.groupBy("k").agg(F.collect_list(F.struct("a", "n")).alias("firsts"))
    return shared.join(runs, "k", "left")


def _covered(s: _Slice, low: int, batch: pa.RecordBatch, window: int) -> np.ndarray:
    """Which words of a slice lie in a repeated window."""
    over = np.zeros(len(s.starts) + 1, dtype=np.int64)
    if not len(s.at):
        return over[:-1].astype(bool)
    repeat = np.zeros(len(s.starts), dtype=bool)
    repeat[s.at[_shared_windows(s, low, batch.column(2))]] = True
    n_rows = len(s.first) - 1
    firsts = batch.column(3).slice(low, n_rows)
    sizes = np.asarray(firsts.value_lengths().fill_null(0))
    places, runs = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in firsts.flatten().flatten())
    owner = np.repeat(np.arange(n_rows), sizes)
    begin = places + s.first[owner]
    stop = np.minimum(begin + runs, s.first[owner + 1])
    begin = np.minimum(begin, s.first[owner + 1])
    kept = np.zeros(len(s.starts) + 1, dtype=np.int64)
    np.add.at(kept, begin, 1)
    np.subtract.at(kept, stop, 1)
    repeat &= np.cumsum(kept)[:-1] == 0
    at = np.flatnonzero(repeat)
    np.add.at(over, at, 1)
    np.subtract.at(over, np.minimum(at + window, len(s.starts)), 1)
    return np.cumsum(over)[:-1] > 0


def _outcome(s: _Slice, gone: np.ndarray, digest: bool) -> tuple[list, list, list]:
    """Words, removed words, and either the digest of the kept words or the text that remains, of each row."""
    n_words = np.diff(s.first)
    total = np.concatenate([[0], np.cumsum(gone)])
    n_gone = total[s.first[1:]] - total[s.first[:-1]]
    held = s.data.tobytes()
    if digest:
        packed, begin, stop = packed_words(s.data, s.starts, s.ends)
        whole = packed.tobytes()
    out = []
    for i, (a, b) in enumerate(zip(s.first[:-1].tolist(), s.first[1:].tolist())):
        if digest:
            if not n_gone[i]:
                kept = whole[begin[a] : stop[b - 1]] if b > a else b""
            else:
                kept = b" ".join(whole[begin[j] : stop[j]] for j in (np.flatnonzero(~gone[a:b]) + a).tolist())
            out.append(hashlib.sha256(kept).hexdigest())
        elif n_gone[i]:
            # runs of kept words keep the white space inside them; a space stands for what is cut out
            edges = np.flatnonzero(np.diff(np.concatenate([[1], gone[a:b].astype(np.int8), [1]])))
            runs = [held[s.starts[a + x] : s.ends[a + y - 1]] for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]
            out.append(b" ".join(runs))
        else:
            out.append(None)
    return n_words.tolist(), n_gone.tolist(), out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, anchor: int = ANCHOR, shard: int = SHARD_PIECES, digest: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that starts earlier in the corpus too.

    Words are ``[^\\x20\\x09-\\x0D]+``. Earlier means in a document of smaller key, or in the same one at an earlier
    word; windows are judged on the texts as they came. With ``digest`` one row per document holds the key,
    ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words joined by one space. Otherwise the input comes
    back with ``text`` shortened: kept runs of words keep their white space, a text without removals is unchanged.
    Null texts have no words and stay null, empty ones stay empty. Rows of a null key lose nothing and are no
    one's source. Rows that repeat a key are the same document: equal windows at equal places are not earlier.
    """
    spans = repeated_spans(docs, key, text, window, anchor, shard)
    others = [] if digest else [c for c in docs.columns if c not in (key, text)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest") if others else F.lit(None).cast("int").alias("rest")
    lean = docs.select(F.col(key).alias("k"), packed_text(F.col(text)).alias("t"), rest)
    joined = lean.join(spans, "k", "left").select("k", "t", "hashes", "firsts", "rest")
    types = joined.schema
    own = T.StructField("t", docs.schema[text].dataType)
    schema = T.StructType([types["k"], *(T.StructField(c, t) for c, t in DIGEST.items())] if digest else [types["k"], own, types["rest"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            texts = unpacked_text(batch.column(1))
            for low, _, s in _slices(texts, window, anchor):
                for held, more in zip(found, _outcome(s, _covered(s, low, batch, window), digest)):
                    held += more
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())], ["k", "n_words", "n_removed", "kept_sha256"])
            else:
                new = pa.array(found[2], pa.large_binary()).cast(texts.type)
                kept = pa.compute.if_else(pa.array([x is None for x in found[2]], pa.bool_()), texts, new)
                yield pa.RecordBatch.from_arrays([batch.column(0), kept.cast(pa.string()), batch.column(4)], ["k", "t", "rest"])

    out = map_arrow(joined, run, schema)
    if digest:
        return out.withColumnRenamed("k", key)
    return out.select(*[F.col("k").alias(key) if c == key else F.col("t").alias(text) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])

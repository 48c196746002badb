"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

#: Most frequent n-grams of a document and of a profile.
PROFILE = 400
UNDETERMINED = "und"
_SLICE_CHARS = 1 << 19
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point: 0 for a non-letter, else a 16-bit sign of its lower-case letter."""
    if not _letters:
        table = np.zeros(0x110000, dtype=np.uint16)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                v = ord(low) if len(low) == 1 else c
                table[c] = v if v < 0x10000 else 0xE000 + v % 0x1900
        _letters.append(table)
    return _letters[0]


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and count of the 1- to 3-grams of each text, ordered by row and n-gram.

    A gram is three 16-bit letters in one number; any run of non-letters is one blank, which may begin or end a
    gram but is none by itself.
    """
    lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    joined = "\n".join(t or "" for t in texts) + "\n"
    marks = _letter_table()[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    solid = marks > 0
    if not solid.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # of a run of non-letters its first
    marks, row = marks[keep].astype(np.int64), row[keep]
    marks = np.concatenate([[0], marks])  # a blank before the first letter
    row = np.concatenate([row[:1], row])
    marks[marks == 0] = 32
    letter = marks != 32
    one = (row[letter] << 48) | (marks[letter] << 32)
    a, b = marks[:-1], marks[1:]
    two = ((np.where(letter[:-1], row[:-1], row[1:]) << 48) | (a << 32) | (b << 16))[letter[:-1] | letter[1:]]
    three = ((row[1:-1] << 48) | (a[:-1] << 32) | (b[:-1] << 16) | marks[2:])[letter[1:-1]]
    codes = np.sort(np.concatenate([one, two, three]))
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(np.concatenate([first, [len(codes)]]))
    found = codes[first]
    return found >> 48, found & ((1 << 48) - 1), count


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= _SLICE_CHARS or i - low >= 30_000:
            yield low, texts[low : i + 1]
            low, size = i + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """``(lang, gram, rank)``: the most frequent n-grams of each language, most frequent first, ties by n-gram.

    All rows with a text and a language are counted. Counts are summed in each task, then over tasks; only the best
    of each task are ranked together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for low, part in _slices(batch.column(1).to_pylist()):
                row, gram, n = gram_counts(part)
                own = names[low : low + len(part)]
                for name in set(own):
                    mine = (own == name)[row]
                    keys, counts = held.setdefault(name, ([], []))
                    keys.append(gram[mine])
                    counts.append(n[mine])
                    if len(keys) > 32:
                        x, y = _summed(keys, counts)
                        keys[:], counts[:] = [x], [y]
        for name, (keys, counts) in held.items():
            x, y = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(x), pa.array(y)], ["lang", "gram", "n"])

    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"))
    sums = map_arrow(labelled, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("rank", rank - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def predict(texts: list[str | None], names: list[str], grams: np.ndarray, ranks: np.ndarray, size: int) -> tuple[list[str], list[float]]:
    """Nearest profile of each text and its closeness. ``ranks[g, l]`` is the place of a known n-gram in a profile,
    ``size`` if it isn't there; the last line stands for unknown n-grams."""
    labels, scores = [], []
    for _, part in _slices(texts):
        row, gram, n = gram_counts(part)
        label = [UNDETERMINED] * len(part)
        score = [0.0] * len(part)
        if len(row) and names:
            order = np.argsort((row << 32) - n, kind="stable")
            row, gram = row[order], gram[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
            top = place < size
            row, gram, place = row[top], gram[top], place[top]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            at = np.where(grams[at] == gram, at, len(grams))
            used = np.diff(np.concatenate([first, [len(row)]]))
            apart = np.empty((len(first), len(names)))
            for k in range(len(names)):
                there = ranks[at, k]
                out = np.where(there == size, size, np.abs(there - place))
                apart[:, k] = np.add.reduceat(out, first)
            best = apart.argmin(axis=1)
            near = 1 - apart[np.arange(len(first)), best] / (used * size)
            for i, k, s in zip(row[first].tolist(), best.tolist(), near.tolist()):
                label[i], score[i] = names[k], s
        labels += label
        scores += score
    return labels, scores


def identify(docs: DataFrame, profiles: DataFrame, key: str = "doc_id", text: str = "text", size: int = PROFILE) -> DataFrame:
    """``(key, lang_pred, score)`` for every row.

    The language is the profile with the smallest out-of-place distance to the text's own most frequent n-grams
    (ties: the first name); the score is 1 less the distance as a share of the largest possible one. Texts that are
    null or have no letter, and all texts if there is no profile, are ``und`` with score 0. Profiles are ``size``
    rows for each language, whatever the corpus holds, and travel with the tasks.
    """
    held = profiles.collect()
    names = sorted({r["lang"] for r in held})
    grams = np.array(sorted({r["gram"] for r in held}), dtype=np.int64)
    ranks = np.full((len(grams) + 1, len(names)), size, dtype=np.int64)
    for r in held:
        ranks[np.searchsorted(grams, r["gram"]), names.index(r["lang"])] = r["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = predict(batch.column(1).to_pylist(), names, grams, ranks, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["k", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_arrow(lean, run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    """Whether a document is kept from learning: checksum of its key, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))

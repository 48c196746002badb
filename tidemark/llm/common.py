"""What several operators share: Arrow batches of bounded size, words of text buffers, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_path

#: Rows and bytes of one Arrow batch; one text alone may be larger.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: Bytes of a row group of scratch tables.
ROW_GROUP = 32 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20
_powers: list[np.ndarray] = []


def bounded_batches(spark: SparkSession) -> None:
    """Limit the rows and bytes of the batches that go to Python workers."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    # small row groups: a writer holds one in memory, and texts fill the usual ones
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one or two numbers that a join may send to all tasks: some 4 MB.
SENT_ROWS = 250_000


def sent_if_small(table: DataFrame, limit: int = SENT_ROWS) -> DataFrame:
    """A stored table of few numbers a row, marked for broadcasting if its counted rows are at most ``limit``; else as it is."""
    return F.broadcast(table) if table.count() <= limit else table


def packed_text(text: Column) -> Column:
    """A text column compressed row by row, for joins that move whole texts."""

    def pack(column: pa.Array) -> pa.Array:
        compress = zstandard.ZstdCompressor(level=3).compress
        return pa.array([None if t is None else compress(t.encode()) for t in column.to_pylist()], pa.binary())

    return F.arrow_udf(pack, T.BinaryType())(text)


def unpacked_text(column: pa.Array) -> pa.Array:
    """The texts of a column made by ``packed_text``."""
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([None if t is None else expand(t) for t in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (n + 1 entries)."""
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        n = max(size, _SLICE + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    out = np.empty(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        origin = int(starts[low])
        high = max(int(np.searchsorted(ends, origin + _SLICE, side="right")), low + 1)
        size = int(ends[high - 1]) - origin
        up, down = _power_tables(size + 1)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((data[origin : origin + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
        a, b = starts[low:high] - origin, ends[low:high] - origin
        out[low:high] = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        low = high
    return out


def row_slices(offsets: np.ndarray, limit: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1, low + 1)
        yield low, high
        low = high


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words in one buffer with a space after each, and where each word begins and ends there."""
    length = ends - starts
    stop = np.cumsum(length + 1) - 1
    begin = stop - length
    packed = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, dtype=np.uint8)
    to = np.ones(len(packed), dtype=bool)
    to[stop] = False
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] = 1
    np.subtract.at(step, ends, 1)
    packed[to] = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    return packed, begin, stop

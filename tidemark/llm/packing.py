"""Harmonic packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, stored

#: Words whose ids a worker keeps, and the longest such word in bytes.
CACHE_WORDS = 600_000
CACHE_BYTES = 40

# the tokenizer always separates a letter (a-z, or Latin-1 in UTF-8) from one of these signs
_BEFORE_SIGN = re.compile(rb"(?=[.,;:!?%*$#&|])(?:(?<=[a-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# lower-case letters that normalization leaves as they are, and that make one token of the merge table
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_tokenizers: dict[str, tuple[object, dict[bytes, bytes]]] = {}


def _byte_signs() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_SIGNS = _byte_signs()


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    return _tokenizers[path]


def _pieces_of_text(text: str) -> list[bytes]:
    """Parts of a text whose ids, one after the other, are the ids of the text.

    White space separates parts for this tokenizer, and letters never join the signs above. Lower-casing A-Z early
    changes nothing unless a combining mark follows or a special string is spelled, so such texts stay as they are.
    """
    data = text.encode()
    if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
        data = _BEFORE_SIGN.sub(b" ", data.translate(_LOWER))
    return data.split()


def _word_ids(tokenizer, words: list[bytes]) -> dict[bytes, bytes]:
    """The ids of words: plain ones from the merge table at once, others by the whole tokenizer."""
    merge = tokenizer.model.tokenize
    found: dict[bytes, bytes] = {}
    other = []
    for word in words:
        if len(word) <= CACHE_BYTES and _PLAIN(word):
            found[word] = array("I", [t.id for t in merge(word.decode("latin-1").translate(_SIGNS))]).tobytes()
        else:
            other.append(word)
    for low in range(0, len(other), 4096):
        part = other[low : low + 4096]
        for word, encoded in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
            found[word] = array("I", encoded.ids).tobytes()
    return found


def token_bytes(path: str, texts: list[str | None]) -> list[bytes]:
    """The ids of every text as little-endian unsigned 32-bit values."""
    tokenizer, cache = _tokenizer(path)
    split = [_pieces_of_text(t) if t else [] for t in texts]
    found = _word_ids(tokenizer, list(set().union(*split).difference(cache)))
    cache.update(found)
    out = [b"".join(map(cache.__getitem__, words)) for words in split]
    room = CACHE_WORDS - len(cache) + len(found)
    for n, word in enumerate(found):
        if n >= room or len(word) > CACHE_BYTES:
            del cache[word]
    return out


def cut_lengths(n: int, capacity: int, whole: int, slack: int) -> list[int]:
    """Cut n tokens into pieces: full sequences first, then for the rest the largest reciprocal of the capacity
    that fits, until a piece is at most ``whole`` long or wastes at most ``slack`` of its sequence."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        per = capacity // rest
        if rest <= whole or capacity - per * rest <= slack:
            out.append(rest)
            break
        size = capacity // (per + 1)
        out.append(size)
        rest -= size
    return out


def _places(totals: list, capacity: int) -> tuple[pa.Table, pa.Table]:
    """Where the full sequences of each length begin, and the places of the pieces left over by them.

    Fewer than ``capacity // n`` pieces of length n are left over; they share sequences, longest first, each in the
    first one with room.
    """
    firsts: list[tuple[int, int, int]] = []
    left: list[tuple[int, int]] = []
    at = 0
    for length, n in sorted((r["length"], r["n"]) for r in totals):
        per = capacity // length
        firsts.append((length, at, n // per * per))
        at += n // per
        left += [(length, i) for i in range(n % per)]
    room: list[int] = []
    tail: list[tuple[int, int, int, int]] = []
    opened: dict[int, int] = {}  # for a length, sequences before this one have no room for it
    for length, i in sorted(left, key=lambda x: (-x[0], x[1])):
        k = opened.get(length, 0)
        while k < len(room) and room[k] < length:
            k += 1
        if k == len(room):
            room.append(capacity)
        opened[length] = k
        tail.append((length, i, at + k, capacity - room[k]))
        room[k] -= length
    table = lambda names, rows: pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(names)})
    return table(["length", "first", "filled"], firsts), table(["length", "left", "tail_sequence", "tail_offset"], tail)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all texts placed in sequences of ``capacity`` tokens.

    One row per piece: the key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.
    A document's tokens are its ids and ``end_id``; null and empty texts have that one token. A piece of length n
    belongs to the class ``capacity // n``: each of its sequences takes that many pieces of this length. Every worker
    counts its own pieces of each length, and learns only where its count begins among all workers; from there it
    fills its sequences by arithmetic. What is left over of each length, over the whole input, is less than a sequence
    and shares the last sequences with the other lengths. The pieces are written once, so that a repeated task can't renumber them. Repeated keys and
    rows are documents of their own; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, ids in enumerate(token_bytes(path, batch.column(1).to_pylist())):
                ids += end
                view, at, total = memoryview(ids), 0, len(ids) // 4
                for n in cut_lengths(total, capacity, capacity // 16, capacity // 64):
                    for held, value in zip(rows, (i, at, n, zlib.crc32(view[4 * at : 4 * (at + n)]), total, seen[n])):
                        held.append(value)
                    seen[n] += 1
                    at += n
            columns = [batch.column(0).take(pa.array(rows[0], pa.int32())), *(pa.array(x, pa.int64()) for x in rows[1:])]
            columns.append(pa.array([worker] * len(rows[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["k", "start", "length", "ids_crc32", "doc_tokens", "nth", "worker"])

    lean = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    pieces = stored(map_arrow(lean, run, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, worker int"), "pieces")
    counts = pieces.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("length", "worker", F.coalesce(before, F.lit(0)).alias("begin"))
    firsts, tail = _places(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect(), capacity)
    local = docs.sparkSession.createDataFrame
    # at most ``capacity`` rows, and at most ``capacity * (1 + ln(capacity))`` rows
    begins = begins.join(F.broadcast(local(firsts)), "length")
    at = F.col("begin") + F.col("nth")
    placed = pieces.join(begins, ["length", "worker"]).withColumn("at", at).withColumn("left", at - F.col("filled"))
    per = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    inside = F.col("left") < 0
    return placed.join(F.broadcast(local(tail)), ["length", "left"], "left").select(
        F.col("k").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        F.when(inside, F.col("first") + F.floor(F.col("at") / per).cast("long")).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(inside, F.col("at") % per * F.col("length")).otherwise(F.col("tail_offset")).alias("offset"),
    )

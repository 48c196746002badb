"""Token counts of whole texts with a public SentencePiece vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

#: Bytes of text that one call of the library encodes, and of a long text's segments.
CALL_BYTES = 1 << 20
SEGMENT_CHARS = 32_768

# one space between two characters that the vocabulary keeps apart (U+2581 stands for a space there)
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_models: dict[str, object] = {}


def _model(path: str):
    """The tokenizer of this worker, and whether texts may be split at single spaces."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        prefix = model.encode("a") == model.encode(" a")[-1:] or model.encode("a", out_type=str)[0].startswith("▁")
        _models[path] = (model, prefix and not crossing)
    return _models[path]


def segments(text: str, limit: int = SEGMENT_CHARS) -> list[str]:
    """Cut a text at single spaces into pieces of about ``limit`` characters; the space itself is left out,
    since the tokenizer puts one before each piece. A stretch without such a space stays whole."""
    out, at = [], 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.end()
    out.append(text[at:])
    return out


def _counted(path: str, texts: list[str | None]) -> list[int]:
    model, splits = _model(path)
    counts = [0] * len(texts)
    held: list[str] = []
    owner: list[int] = []
    size = 0

    def encode() -> None:
        for i, ids in zip(owner, model.encode(held, num_threads=1)):
            counts[i] += len(ids)

    for i, text in enumerate(texts):
        if not text:
            continue
        for part in segments(text) if splits and len(text) > SEGMENT_CHARS else [text]:
            held.append(part)
            owner.append(i)
            size += len(part)
            if size >= CALL_BYTES:
                encode()
                held, owner, size = [], [], 0
    encode()
    return counts


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    One row per input row (repeated keys stay repeated): the key, ``n_bytes``, ``n_tokens``, ``over_limit``. Null
    and empty texts count zero. Other columns, whatever their names, are not read. ``path`` is a SentencePiece
    file that every worker can open. Batches are bounded in bytes, each library call too, and only lengths come
    back. Texts of any length are cut where no vocabulary entry can join the two sides, so counts are exact; where
    a vocabulary has entries across spaces, texts stay whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counted(path, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["k", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    lean = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    out = map_arrow(lean, count, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

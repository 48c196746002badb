"""Collapse of conversation snapshots and rendering of what remains."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, stored

#: Marks around a turn; the same marks inside a text are broken up by a space.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with a digest of role and text; rows of no conversation are left out, null parts count as empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "digest", F.md5(F.concat_ws("\x1f", "role", "text"))
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rolling digests: each covers a turn and all turns before it."""
    for batch in batches:
        last, shorter = [], []
        for turns in batch.column(1).to_pylist():
            state, chain = b"", []
            for turn in turns:
                state = blake2b(state + turn["digest"].encode(), digest_size=16).digest()
                chain.append(state)
            last.append(chain[-1])
            shorter.append(chain[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last, pa.binary()), pa.array(shorter, pa.list_(pa.binary()))], ["conv_id", "whole", "shorter"])


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_logged)``: conversations that no other one continues; of equal ones the smallest id, with the
    number of conversations equal to it.

    Turns are ordered by turn number (null first), those of one number by digest; a row logged twice counts once.
    Only digests are shuffled. Equal conversations become one row before the prefixes are looked up, and prefixes
    are made distinct before the shuffle, so a conversation logged by a third of all rows is no hot key.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "digest"))).alias("turns"))
    chains = stored(map_arrow(turns, _chained, f"conv_id {kind}, whole binary, shorter array<binary>"), "chains")
    wholes = chains.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    prefixes = chains.select(F.explode("shorter").alias("whole")).distinct()
    return wholes.join(prefixes, "whole", "left_anti").select("conv_id", "n_logged")


def render_chat(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_logged, rendered)`` of every maximal conversation.

    Each turn is rendered as mark, role, line end, text, mark, line end. An empty table gives no rows; other columns
    are not read.
    """
    kept = maximal_conversations(conversations)
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turns = _turns(conversations).join(kept, "conv_id").groupBy("conv_id").agg(
        F.sort_array(F.collect_set(F.struct("turn", "digest", "role", "text"))).alias("turns"), F.first("n_logged").alias("n_logged")
    )
    line = lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(f"{CLOSE}\n"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_logged", F.array_join(F.transform("turns", line), "").alias("rendered"))

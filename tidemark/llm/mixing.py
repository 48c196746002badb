"""Mixing sources to target weights: repetition rates from token totals, whole copies, and one drawn copy for the fraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.plans.blocks import fit, number_rows, unblock

#: Shares of the sources in order, repeating, and the most that a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
#: A document of more than this part of its source draws with what earlier ones left over; a source has fewer than 1 / LARGE such.
LARGE = 0.001

_BITS = 52


def word_count(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded(key: str, seed: str) -> Column:
    """A number in [0, 1) from the digest of a key, the same in every run and engine."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") / F.lit(float(1 << _BITS))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` for a frame of ``(source, size)`` rows.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes by them. A target
    stops at ``most`` times its source's size; what is over goes to the others by weight, until none is above. Each round
    adds up the small table of sources; only three numbers reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked = number_rows(fit(totals, [], ["last", "source"]), [], ["last", "source"], "at")
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    table = stored(unblock(ranked).select("source", "source_size", turn.alias("weight")), "sources")
    cap = F.col("source_size") * most
    level, full = None, -1
    while True:
        # every source that the level of the round before puts above its stop stays there
        stopped = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum("source_size"), F.sum(F.when(stopped, cap)), F.sum(F.when(~stopped, F.col("weight"))), F.count(F.when(stopped, 1))
        ).first()
        if row[3] == full or not row[2]:
            break
        full = row[3]
        level = (row[0] - (row[1] or 0)) / row[2]
    share = F.col("weight") * F.lit(float(level or 0))
    return table.select("source", "source_size", F.when(cap < share, cap.cast("double")).otherwise(share).alias("target"))


def _draws(slim: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, DataFrame]:
    """``(source, source_size, target, whole, part)`` of each source, and ``(source, k, size, drawn)`` of its large rows."""
    targets = source_targets(slim.select("source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rated = stored(targets.withColumn("whole", F.floor(rate).cast("int")).withColumn("part", rate - F.floor(rate)), "mix-rates")
    large = _beside(slim, rated, ["source"]).filter(_large())
    alike = large.groupBy("source", "part", "size", "u", "k").count()
    one = F.struct((-F.col("size")).alias("neg"), "u", "k", "size", (F.col("size") * F.col("count")).alias("all"))
    rows = alike.groupBy("source", "part").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("drawn"))

    def draw(state: Column, x: Column) -> Column:
        due = state["owed"] + F.col("part") * x["all"]
        take = x["u"] * x["all"] < due
        return F.struct((due - F.when(take, x["all"]).otherwise(0)).alias("owed"), F.array_append(state["drawn"], take.cast("int")).alias("drawn"))

    drawn = rows.select("source", "rows", F.aggregate("rows", start, draw)["drawn"].alias("drawn"))
    listed = drawn.select("source", F.explode(F.arrays_zip("rows", "drawn")).alias("x"))
    return rated, stored(listed.select("source", "x.rows.k", "x.rows.size", "x.drawn"), "mix-draws")


def _large() -> Column:
    return F.col("size") > F.col("source_size") * F.lit(LARGE)


def _beside(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join in which nulls equal nulls."""
    met = F.lit(True)
    for c in on:
        met = met & rows[c].eqNullSafe(table[c])
    return rows.join(table, met, "left").select(*[rows[c] for c in rows.columns], *[table[c] for c in table.columns if c not in on])


def _taken(rows: DataFrame, rated: DataFrame, draws: DataFrame) -> DataFrame:
    """The rows with ``source_size``, ``target`` and ``copies``."""
    at = _beside(_beside(rows, rated, ["source"]), draws, ["source", "k", "size"])
    more = F.when(_large(), F.col("drawn")).otherwise((F.col("u") < F.col("part")).cast("int"))
    return at.select(*rows.columns, "source_size", "target", (F.col("whole") + more).alias("copies"))


def _keyed(docs: DataFrame, key: str, text: str, source: str, seed: str, *more: Column) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.col(source).alias("source"), word_count(text).alias("size"), seeded(key, seed).alias("u"), *more)


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``(key, source, size, source_size, target, copies)``: how often the mix takes each row.

    A source's rate is its target over its size. Every row is taken floor(rate) times and, with the fraction as probability,
    once more, drawn by a digest of its key: reruns agree, and rows that repeat a key and a size draw alike. Rows larger than
    ``LARGE`` of their source (of which there are fewer than 1000 different ones, so one fold in order of size) are drawn for their share and
    what the rows before them were owed, so that a few long documents don't carry a source far from its target. Null and
    empty texts have size 0 and are taken by the same rule; null sources are one source, null keys one key. An empty table
    gives none. Only keys, sources and sizes are shuffled.
    """
    slim = stored(_keyed(docs, key, text, source, seed), "mix-sizes")
    taken = _taken(slim, *_draws(slim, weights, most))
    return taken.select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mixed rows: every row as often as ``copies`` tells, with all its columns. Texts are read twice and never shuffled
    where the tables of sources and of large rows are small enough to be sent to the tasks."""
    rows = _keyed(docs, key, text, source, seed, F.struct(*docs.columns).alias("row"))
    taken = _taken(rows, *_draws(stored(rows.drop("row"), "mix-sizes"), weights, most))
    return taken.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies")))).select("row.*")

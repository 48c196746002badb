"""Views that shape the given tables into transcripts, signals, candidates, labels and logs.

Each function reads ``<dir>/<table>.parquet`` and derives one input relation; nothing is invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.blocks import fit, number_rows, scan, unblock

TRACK = ["work_id", "track_id"]


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input whose files give fewer splits than the cluster has cores; others stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return unblock(number_rows(fit(df, keys, order), keys, order, name))


def _samples(spark: SparkSession, base: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, base, "lineitem").select("l_suppkey", *order)
    return _numbered(rows, ["l_suppkey"], order, "idx").select(
        (F.col("l_suppkey") % 10).alias("work_id"), F.col("l_suppkey").alias("track_id"), "idx", "l_extendedprice"
    )


def frames(spark: SparkSession, base: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return _samples(spark, base).select(*TRACK, "idx", (F.lit(10.0) * F.log10(price * price)).alias("level"))


def samples(spark: SparkSession, base: str) -> DataFrame:
    return _samples(spark, base).select(*TRACK, "idx", (F.col("l_extendedprice") / F.lit(1e5)).alias("x"))


def hours(ts: str | Column = "ts") -> Column:
    """Hours since 2024-01-01, used as media seconds."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    col = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_micros(col.cast("timestamp")) - F.unix_micros(start)) / F.lit(3.6e9)


def _event_keys() -> list[Column]:
    return [(F.col("user_id") % 10).alias("work_id"), F.col("user_id").alias("track_id")]


def candidates(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "events").filter(F.col("event_type") != "purchase")
    return events.select(
        *_event_keys(),
        F.col("event_id").alias("cand_no"),
        hours().alias("t"),
        (F.col("value") / F.lit(5e2)).alias("score"),
        F.col("value").alias("peak"),
        ((F.col("event_id") * 7919 % 1000) / F.lit(1e3)).alias("ref_score"),
    )


def truth(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "events").filter((F.col("event_type") == "purchase") & (F.col("value") >= 100))
    return events.select(*_event_keys(), F.col("event_id").alias("truth_no"), hours().alias("t"))


def labelled(spark: SparkSession, base: str) -> DataFrame:
    users = table(spark, base, "events").select("user_id").distinct().filter(F.col("user_id") % 7 != 3)
    return users.select(*_event_keys())


def lines(spark: SparkSession, base: str) -> DataFrame:
    docs = spread(table(spark, base, "documents").select("doc_id", "text"))
    return docs.select(
        (F.col("doc_id") % 10).alias("work_id"),
        F.col("doc_id").alias("track_id"),
        F.posexplode(F.split("text", "\n")).alias("seg_no", "text"),
    )


def _timed(texts: DataFrame, one_row_per_track: bool) -> DataFrame:
    """Add start/end from text lengths: 0.1 s per character, pauses of 0.2, 0.5 or 1.5 s.

    Lines cut from one document row are a bounded group; other tracks are measured first.
    """
    rest = F.col("seg_no") % 3
    pause = F.when(rest == 0, 20).when(rest == 1, 50).otherwise(150)
    ticks = F.length("text").cast("long") * 10
    rows = texts.withColumn("seg_no", F.col("seg_no").cast("long"))
    if not one_row_per_track:
        rows = fit(rows, TRACK, ["seg_no"], position="seg_no")
    rows = unblock(scan(rows, TRACK, ["seg_no"], {"_ticks": ("sum", ticks + pause)}, inclusive=False))
    begin = F.coalesce(F.col("_ticks"), F.lit(0))
    return rows.select(
        *TRACK,
        "seg_no",
        (begin / F.lit(100.0)).alias("start"),
        ((begin + ticks) / F.lit(100.0)).alias("end"),
        "text",
        F.lit("").alias("translation"),
        ((F.col("seg_no") % 10) / F.lit(10.0)).alias("no_speech_prob"),
        (-(F.col("seg_no") % 7) / F.lit(10.0)).alias("avg_logprob"),
        F.lit("").alias("text_raw"),
    )


def segments(spark: SparkSession, base: str) -> DataFrame:
    return _timed(lines(spark, base), one_row_per_track=True)


def conversation_segments(spark: SparkSession, base: str) -> DataFrame:
    turns = table(spark, base, "conversations").select(
        (F.col("conv_id") % 10).alias("work_id"), F.col("conv_id").alias("track_id"), F.col("turn").alias("seg_no"), "text"
    )
    return _timed(turns, one_row_per_track=False)


def marks(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "events").filter(F.col("event_type").isin("click", "error"))
    return events.select(
        F.col("user_id").alias("audio"),
        F.round("value", 0).alias("time"),
        F.when(F.col("event_type") == "click", "add").otherwise("del").alias("action"),
        F.col("event_id").alias("line_no"),
    )


def done_log(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "events").filter(F.col("event_type") == "signup")
    return events.select(
        F.col("user_id").alias("audio"), (F.col("event_id") % 2 == 0).alias("done"), F.col("event_id").alias("line_no")
    )


def feedback(spark: SparkSession, base: str) -> DataFrame:
    rest = F.col("event_id") % 5
    return table(spark, base, "events").select(
        F.col("user_id").alias("audio"),
        F.round(F.col("value") / 10, 0).alias("time"),
        F.when(rest == 0, None).when(rest.isin(1, 2), 0).otherwise(1).alias("verdict"),
        F.create_map(F.lit("peak"), F.col("value"), F.lit("pre30"), F.col("value") / 2).alias("feats"),
        F.col("event_id").alias("line_no"),
    )


def intervals(spark: SparkSession, base: str) -> DataFrame:
    first = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, base, "orders").select(
        (F.col("o_custkey") % 200).alias("track_id"),
        F.col("o_orderkey").alias("item_no"),
        first.alias("start"),
        (first + 1 + F.col("o_orderkey") % 9).alias("end"),
    )


def names(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "part").select(F.col("p_partkey").alias("item_no"), F.col("p_name").alias("name"))


def paths(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pages").select(F.col("page_id").alias("item_no"), F.col("url").alias("path"))

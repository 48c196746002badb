"""Writers: subtitles, segment documents, events, logs, output plans and package manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.names import format_srt_ts, format_ts
from tidemark.functions.text import is_blank, strip
from tidemark.operators.segments import rename_with_map
from tidemark.plans.blocks import fit, number_rows, unblock

# File suffix per subtitle mode and the separator of the inline mode.
SUFFIX = {"source": ".ja.lrc", "translated": ".lrc", "both": ".lrc", "inline": ".lrc"}
INLINE = " ｜ "
COMMITTER = "mapreduce.fileoutputcommitter.algorithm.version"


def timed_lines(segments: DataFrame, keys: Sequence[str], mode: str, header: Column | None = None) -> DataFrame:
    """Subtitle lines in order: ``line_key`` (segment, part) and ``line``.

    ``both`` gives two lines per segment, source first; a header's first line is the title, others credits.
    """
    source = strip(F.col("text"))
    shown = F.when(is_blank(F.col("translation")), source).otherwise(strip(F.col("translation")))
    stamp = format_ts(F.col("start"))
    forms = {
        "source": [F.concat(stamp, source)],
        "translated": [F.concat(stamp, shown)],
        "both": [F.concat(stamp, source), F.concat(stamp, shown)],
        "inline": [F.concat(stamp, source, F.lit(INLINE), shown)],
    }[mode]
    body = segments.select(*keys, F.col("seg_no").cast("long").alias("seg_no"), F.posexplode(F.array(*forms)).alias("part", "line"))
    if header is None:
        return body
    tagged = F.transform(
        F.split(header, "\n"), lambda h, i: F.concat(F.when(i == 0, "[ti:").otherwise("[by:"), h, F.lit("]"))
    )
    heads = segments.select(*keys, tagged.alias("_h")).dropDuplicates(list(keys))
    top = heads.select(*keys, F.lit(-1).cast("long").alias("seg_no"), F.posexplode("_h").alias("part", "line"))
    return body.unionByName(top)


def srt_blocks(segments: DataFrame, keys: Sequence[str], bilingual: bool = True) -> DataFrame:
    """Numbered subtitle blocks: index, time range, one or two text lines."""
    rows = unblock(number_rows(fit(segments, keys, ["seg_no"]), keys, ["seg_no"], "_n"))
    has = ~is_blank(F.col("translation"))
    one = F.when(has, F.col("translation")).otherwise(F.col("text"))
    text = F.when(has, F.concat("text", F.lit("\n"), "translation")).otherwise(one) if bilingual else one
    index = F.col("_n") + 1
    block = F.concat(
        index.cast("string"), F.lit("\n"), format_srt_ts(F.col("start")), F.lit(" --> "), format_srt_ts(F.col("end")), F.lit("\n"), text, F.lit("\n")
    )
    return rows.select(*keys, index.alias("nth"), block.alias("block"))


def write_text(rows: DataFrame, path: str, track: str, order: Sequence[str], line: str = "line") -> None:
    """One folder per track; ranges keep a long track's lines in order over several part files.

    Tasks move their own files into place: the other way, one driver thread moves every track's files one by one.
    """
    # the folder's column must be what the rows are sorted by, or the writer sorts them again, by folder alone
    named = rows.withColumn(track, F.col(track).cast("string"))
    placed = named.repartitionByRange(F.col(track), *[F.col(c) for c in order]).sortWithinPartitions(track, *order)
    placed.select(track, line).write.mode("overwrite").option(COMMITTER, "2").partitionBy(track).text(path)


def segment_documents(segments: DataFrame, model: str, fingerprint: Column, part_rows: int = 100_000) -> DataFrame:
    """One document per track, in numbered parts of ``part_rows`` segments so that no row grows without end."""
    fields = ["seg_no", "start", "end", "text", "translation", "no_speech_prob", "avg_logprob", "text_raw"]
    rows = segments.withColumn("part", F.floor(F.col("seg_no") / part_rows).cast("int")).withColumn("_mark", fingerprint)
    return rows.groupBy("work_id", "track_id", "part").agg(
        F.lit(model).alias("model"),
        F.first("_mark").alias("fingerprint"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("segments"),
    )


def write_segments_json(segments: DataFrame, path: str, model: str, fingerprint: Column) -> None:
    segment_documents(segments, model, fingerprint).write.mode("overwrite").json(path)


def write_events_json(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def append_log(records: DataFrame, path: str, required: Sequence[str], allowed: dict[str, Sequence[str]] | None = None) -> None:
    """Append records that have every required field and only allowed values."""
    valid_records(records, required, allowed).write.mode("append").json(path)


def valid_records(records: DataFrame, required: Sequence[str], allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    rows = records
    for c in required:
        rows = rows.filter(F.col(c).isNotNull())
    for c, values in (allowed or {}).items():
        rows = rows.filter(F.col(c).isin(*values))
    return rows


def append_log_stream(
    records: DataFrame, path: str, state: str, required: Sequence[str], allowed: dict[str, Sequence[str]] | None = None
) -> StreamingQuery:
    """Start ``append_log`` as a stream. A micro-batch owns the folder of its number and writes it anew when it is repeated,
    so a batch that ran twice, or a stream that starts again from its first file, leaves no record twice."""

    def keep(batch: DataFrame, number: int) -> None:
        valid_records(batch, required, allowed).write.mode("overwrite").json(f"{path}/_batch={number}")

    return records.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()


def output_plan(wanted: DataFrame, existing: DataFrame, path: str = "dst", overwrite: bool = False) -> DataFrame:
    """What a run would do per output: skip what exists unless overwriting."""
    there = existing.select(F.col(path), F.lit(True).alias("_there")).distinct()
    rows = wanted.join(there, path, "left")
    skip = F.coalesce(F.col("_there"), F.lit(False)) & F.lit(not overwrite)
    return rows.withColumn("action", F.when(skip, "skip").otherwise("write")).drop("_there")


def package_manifest(
    subtitles: DataFrame, audio: DataFrame, extras: DataFrame, mapping: DataFrame | None = None, with_audio: bool = True, with_source: bool = True
) -> DataFrame:
    """(source, path in package, kind) for one choice of options; subtitles and audio follow the rename table."""
    parts = subtitles.select("src", "path", F.lit("subtitle").alias("kind"))
    if not with_source:
        parts = parts.filter(~F.col("path").endswith(".ja.lrc"))
    if with_audio:
        parts = parts.unionByName(audio.select("src", "path", F.lit("audio").alias("kind")))
    if mapping is not None:
        parts = rename_with_map(parts, "path", mapping).select("src", F.col("renamed").alias("path"), "kind")
    return parts.unionByName(extras.select("src", "path", F.lit("extra").alias("kind")))

"""Readers for text formats, logs and file listings."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.names import parent_dir
from tidemark.functions.text import strip
from tidemark.plans.blocks import fit, number_rows, scan, unblock

# Line formats of timed text (minutes, seconds, text), separators of rule files in
# priority, and the two layouts of truth files.
DIALECTS = {
    "compare": r"^\[(\d+):(\d+(?:[.:]\d+)?)\](.*)$",
    "keep": r"^\[(\d+):(\d+(?:\.\d+)?)\](.*)$",
    "player": r"^\[(\d{1,2}):(\d{2}(?:\.\d+)?)\]\s*(.*)$",
}
RULE_SEPARATORS = ["=>", "->", "→"]
TRUTH_HEADER = r"^【トラック\s*(\d+)】\s*(\d+)\s*回"
TRUTH_POINT = r"^[・·\-–]\s*(\d{1,2}):(\d{2})"
TRUTH_INLINE = r"^track\s*(\d+)\s*[_＿]"
TRUTH_BRACKET = r"\[\s*(\d{1,2}:\d{2})\s*\]"
BLOCK_WORDS = ("トラック", "【")
#: Setting: most tasks of a listing.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

SEGMENT_DOCUMENT = (
    "track_id bigint, work_id bigint, part int, model string, fingerprint string, "
    "segments array<struct<seg_no:bigint,start:double,end:double,text:string,translation:string,"
    "no_speech_prob:double,avg_logprob:double,text_raw:string>>"
)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are listed, let a task list many folders; by default each folder, up to 10 000, gets a task of its own."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_lines(spark: SparkSession, path: str, numbered: bool = False, parts: bool = False) -> DataFrame:
    """Lines of text files with ``file`` and an order key; ``numbered`` adds a dense ``line_no``.

    Large files are split between tasks: a line's place is its split's offset, then its place in it. With ``parts`` the files of
    one folder are one text in the order of their names, as ``write_text`` leaves them, and are numbered through.
    """
    with few_listing_tasks(spark):
        text = spark.read.text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_seq"),
        F.regexp_replace("value", "^\\x{FEFF}", "").alias("line"),
    )
    if not numbered:
        return rows
    place = ["_at", "_seq"]
    if not parts:
        return unblock(number_rows(fit(rows, ["file"], place), ["file"], place, "line_no")).drop(*place)
    order = ["file", *place]
    rows = rows.withColumn("_folder", parent_dir(F.col("file")))
    return unblock(number_rows(fit(rows, ["_folder"], order), ["_folder"], order, "line_no")).drop("_folder", *place)


def parse_timed_lines(lines: DataFrame, dialect: str = "compare", line: str = "line") -> DataFrame:
    """``[m:ss.x]text`` lines to ``t`` and ``text``; lines of another form are skipped.

    ``compare`` reads ``:`` as decimal separator too and drops empty texts, ``keep`` keeps them,
    ``player`` wants short minutes, drops empty texts and rounds to 0.01 s.
    """
    pattern = DIALECTS[dialect]
    raw = strip(F.col(line))
    rows = lines.withColumn("_raw", raw).filter(F.col("_raw").rlike(pattern))
    seconds = F.replace(F.regexp_extract("_raw", pattern, 2), F.lit(":"), F.lit(".")).try_cast("double")
    t = F.regexp_extract("_raw", pattern, 1).try_cast("double") * 60 + seconds
    out = rows.select(
        *[c for c in lines.columns if c != line],
        (F.bround(t, 2) if dialect == "player" else t).alias("t"),
        strip(F.regexp_extract("_raw", pattern, 3)).alias("text"),
    )
    return out if dialect == "keep" else out.filter(F.col("text") != "")


def read_timed_lines(spark: SparkSession, path: str, dialect: str = "compare") -> DataFrame:
    return parse_timed_lines(read_lines(spark, path), dialect)


def read_segments_json(spark: SparkSession, path: str) -> DataFrame:
    """Segment documents to segment rows, with the document's fingerprint."""
    docs = spark.read.schema(SEGMENT_DOCUMENT).json(path)
    return docs.select("work_id", "track_id", "fingerprint", F.inline("segments"))


def read_log(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines under a given schema; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def list_media(spark: SparkSession, paths: Sequence[str], extensions: Sequence[str], recursive: bool = True) -> DataFrame:
    """Files with one of the extensions, once per lower-cased path; contents are never read.

    A path that does not exist is left out with a warning.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    columns = ["path", "length", F.col("modificationTime").alias("modified")]
    rows = None
    for path in paths:
        try:
            with few_listing_tasks(spark):
                found = reader.load(path).select(*columns)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"no such path, left out: {path}", stacklevel=2)
            continue
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        rows = spark.createDataFrame([], "path string, length bigint, modified timestamp")
    wanted = F.lower("path").rlike(r"(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + r")$")
    return rows.filter(wanted).groupBy(F.lower("path").alias("_key")).agg(
        F.min_by(F.struct("path", "length", "modified"), "path").alias("_f")
    ).select("_f.*")


def count_media_by_dir(files: DataFrame, path: str = "path", recursive: bool = False) -> DataFrame:
    """Files per directory: direct children, or everything below."""
    folder = parent_dir(F.col(path))
    if not recursive:
        return files.groupBy(folder.alias("dir")).agg(F.count("*").alias("files"))
    parts = F.split(folder, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select(F.explode(ancestors).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))


def parse_rules(lines: DataFrame, order: str, line: str = "line") -> DataFrame:
    """``a=>b``, ``a->b`` or ``a→b`` lines to (``a``, ``b``); comments and empty left sides are dropped."""
    text = strip(F.regexp_replace(strip(F.col(line)), r"(?U)\s+#.*$", ""))
    rows = lines.withColumn("_s", text).filter((F.col("_s") != "") & ~strip(F.col(line)).startswith("#"))
    at = None
    for sep in reversed(RULE_SEPARATORS):
        place = F.instr(F.col("_s"), sep)
        pair = F.struct(
            strip(F.substr(F.col("_s"), F.lit(1), place - 1)).alias("a"),
            strip(F.substr(F.col("_s"), place + len(sep))).alias("b"),
        )
        at = F.when(place > 0, pair) if at is None else F.when(place > 0, pair).otherwise(at)
    found = rows.withColumn("_p", at).filter(F.col("_p").isNotNull() & (F.col("_p.a") != ""))
    return found.select(*[c for c in lines.columns if c != line], F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))


def parse_cues(lines: DataFrame, keys: Sequence[str], order: str, needed: int = 4, line: str = "line") -> DataFrame:
    """The first four non-comment lines of each file are its cue patterns; files with fewer give none."""
    text = strip(F.col(line))
    rows = lines.filter((text != "") & ~text.startswith("#"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = rows.select(*keys, order, text.alias("regex")).withColumn("nth", nth).filter(F.col("nth") <= needed)
    enough = first.groupBy(*keys).agg(F.max("nth").alias("_n")).filter(F.col("_n") == needed).select(*keys)
    return first.join(enough, list(keys), "left_semi").select(*keys, "nth", "regex")


def parse_truth_blocks(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(tracks, points) from header lines and the point lines below them.

    A header opens its track even with zero points; points before any header are ignored.
    """
    text = strip(F.col(line))
    header = F.nullif(F.regexp_extract(text, TRUTH_HEADER, 1), F.lit("")).try_cast("int")
    rows = lines.withColumn("_head", header).withColumn("_text", text)
    filled = unblock(scan(fit(rows, keys, [order]), keys, [order], {"track": ("last", F.col("_head"))}))
    tracks = filled.filter(F.col("_head").isNotNull()).select(*keys, "track").distinct()
    points = filled.filter(F.col("track").isNotNull() & F.col("_head").isNull() & F.col("_text").rlike(TRUTH_POINT))
    t = F.regexp_extract("_text", TRUTH_POINT, 1).try_cast("int") * 60 + F.regexp_extract("_text", TRUTH_POINT, 2).try_cast("int")
    return tracks, points.select(*keys, "track", t.alias("t"))


def parse_truth_inline(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(tracks, points) from ``trackNN_...`` lines: every ``[MM:SS]``; a track's last line counts."""
    text = strip(F.regexp_replace(strip(F.col(line)), '^"+|"+$', ""))
    rows = lines.withColumn("_text", text).filter(F.col("_text").rlike(TRUTH_INLINE))
    number = F.regexp_extract("_text", TRUTH_INLINE, 1).try_cast("int")
    last = rows.groupBy(*keys, number.alias("track")).agg(F.max_by("_text", order).alias("_text"))
    stamps = F.regexp_extract_all(F.col("_text"), F.lit(TRUTH_BRACKET), F.lit(1))
    minutes = lambda s: F.split_part(s, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(s, F.lit(":"), F.lit(2)).try_cast("int")
    return last.select(*keys, "track"), last.select(*keys, "track", F.explode(F.transform(stamps, minutes)).alias("t"))


def parse_truth(lines: DataFrame, keys: Sequence[str], order: str, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Choose the layout per text: blocks when both marker words occur, else inline lines."""
    words = lines.groupBy(*keys).agg(*[F.bool_or(F.contains(F.col(line), F.lit(w))).alias(f"_w{i}") for i, w in enumerate(BLOCK_WORDS)])
    blocky = words.filter(F.col("_w0") & F.col("_w1")).select(*keys)
    a = parse_truth_blocks(lines.join(blocky, list(keys), "left_semi"), keys, order, line)
    b = parse_truth_inline(lines.join(blocky, list(keys), "left_anti"), keys, order, line)
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


def parse_fold_results(docs: DataFrame, body: Column) -> DataFrame:
    """Nested ``{method: {auc, prec, rec, per_work: {work: [auc, prec, rec]}}}`` to one row per method and work."""
    schema = "map<string, struct<auc: double, prec: double, rec: double, per_work: map<string, array<double>>>>"
    methods = docs.select(*docs.columns, F.explode(F.from_json(body, schema)).alias("method", "_m"))
    return methods.select(
        *docs.columns, "method", F.col("_m.auc").alias("all_auc"), F.explode_outer("_m.per_work").alias("work", "_v")
    ).select(
        *docs.columns, "method", "all_auc", "work",
        *[F.try_element_at("_v", F.lit(i + 1)).alias(n) for i, n in enumerate(("auc", "prec", "rec"))],
    )

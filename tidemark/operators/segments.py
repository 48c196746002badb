"""Cleaning, merging, splitting and batching of timed text segments.

A segment row has ``seg_no`` (order within a track), ``start``, ``end``, ``text``, ``translation``,
``no_speech_prob``, ``avg_logprob`` and ``text_raw``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions import text as tx
from tidemark.plans.blocks import fit, islands, number_rows, scan, shift, unblock
from tidemark.plans.folds import greedy_groups
from tidemark.session import cut

# The three separator classes tried in turn when a long text is split.
SENTENCE_ENDS = "。！？!?…‥"
CLAUSE_ENDS = "、，,"
BLANKS = r"\s"


def duration() -> Column:
    return F.greatest(F.col("end") - F.col("start"), F.lit(0.0))


def drop_noise_segments(segments: DataFrame, patterns: Sequence[str], short: float = 2.5, silent: float = 0.35) -> DataFrame:
    return segments.filter(~tx.is_noise(F.col("text"), duration(), F.col("no_speech_prob"), patterns, short, silent))


def apply_fixes(segments: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace by rule; a changed row keeps its first original and loses its translation."""
    fixed = segments.withColumn("_new", tx.apply_rules(F.col("text"), rules))
    changed = F.col("_new") != F.col("text")
    first = F.coalesce(F.col("text_raw"), F.lit("")) == ""
    return fixed.select(
        *[c for c in segments.columns if c not in ("text", "translation", "text_raw")],
        F.col("_new").alias("text"),
        F.when(changed, "").otherwise(F.col("translation")).alias("translation"),
        F.when(changed & first, F.col("text")).otherwise(F.col("text_raw")).alias("text_raw"),
    ).select(*segments.columns)


def limit_runs(segments: DataFrame, keys: Sequence[str], max_run: int = 3) -> DataFrame:
    """Keep the first ``max_run`` of consecutive equal texts; blank texts never form a run."""
    rows = fit(segments.withColumn("_text", tx.strip(F.col("text"))), keys, ["seg_no"])
    rows = islands(
        rows, keys, ["seg_no"], lambda p: (F.col("_text") != p["text"]) | (F.col("_text") == ""), {"text": F.col("_text")}
    )
    ranked = number_rows(rows, [*keys, "island"], ["seg_no"], "_nth")
    return unblock(ranked.filter(F.col("_nth") < max_run)).drop("_text", "island", "_nth")


def merge_close_segments(segments: DataFrame, keys: Sequence[str], gap: float, max_chars: int) -> DataFrame:
    """Join a segment to its predecessor across pauses up to ``gap`` while the text stays within twice
    ``max_chars``.  Texts are trimmed first; the other fields come from the first member."""
    if gap <= 0:
        return segments
    trimmed = segments.withColumn("text", tx.strip(F.col("text")))
    rows = shift(fit(trimmed, keys, ["seg_no"]), keys, ["seg_no"], {"_end": F.col("end")})
    rows = greedy_groups(
        rows, keys, ["seg_no"], F.length("text"), F.col("start") - F.col("_end") <= gap, None, 2 * max_chars, "_group"
    )
    first = [c for c in segments.columns if c not in {*keys, "seg_no", "end", "text"}]
    parts = F.array_sort(F.collect_list(F.struct("seg_no", "text")))
    merged = rows.groupBy(*keys, "_group").agg(
        F.min("seg_no").alias("seg_no"),
        F.max_by("end", "seg_no").alias("end"),
        tx.strip(F.array_join(F.transform(parts, lambda x: x["text"]), "")).alias("text"),
        F.min_by(F.struct(*first), "seg_no").alias("_first"),
    )
    return merged.select(*[F.col(f"_first.{c}").alias(c) if c in first else F.col(c) for c in segments.columns])


def split_text(text: Column, max_chars: int, sentence_ends: str = SENTENCE_ENDS) -> Column:
    """Pieces of at most ``max_chars``: cut after sentence marks, else clause marks, else blanks, else anywhere.

    A piece one separator cannot cut small enough goes on to the next one.
    """
    separators = [f"(?<=[{sentence_ends}])", f"(?<=[{CLAUSE_ENDS}])", f"(?U)(?<=[{BLANKS}])"]

    def fixed(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(max_chars))
        return F.transform(starts, lambda i: F.substr(s, i, F.lit(max_chars)))

    def tier(s: Column, level: int) -> Column:
        if level == len(separators):
            return fixed(s)
        parts = F.filter(F.split(s, separators[level]), lambda p: p.rlike(r"(?U)\S"))

        def pack(acc: Column, p: Column) -> Column:
            done, open_ = acc["done"], acc["open"]
            closed = F.when(open_ == "", done).otherwise(F.array_append(done, open_))
            fits = F.length(open_) + F.length(p) <= max_chars
            long_ = F.length(p) > max_chars
            return F.struct(
                F.when(fits, done).when(long_, F.concat(closed, smaller(p, level + 1))).otherwise(closed).alias("done"),
                F.when(fits, F.concat(open_, p)).when(long_, F.lit("")).otherwise(p).alias("open"),
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        return F.aggregate(
            parts,
            start,
            pack,
            lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])),
        )

    def smaller(p: Column, level: int) -> Column:
        trimmed = tx.strip(p)
        return F.when(F.length(trimmed) <= max_chars, F.array(trimmed)).otherwise(tier(trimmed, level))

    whole = tx.strip(text)
    short = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return F.when(F.length(whole) <= max_chars, short).otherwise(tier(whole, 0))


def explode_pieces(
    segments: DataFrame, max_chars: int, sentence_ends: str = SENTENCE_ENDS, out: str = "part"
) -> DataFrame:
    """One row per piece of :func:`split_text`; blank texts, which have none, are dropped beforehand."""
    rows = segments.filter(~tx.is_blank(F.col("text"))).withColumn("_parts", split_text(F.col("text"), max_chars, sentence_ends))
    # the outer form of explode keeps the optimizer from evaluating the split a second time in a filter
    return rows.select(*segments.columns, F.posexplode_outer("_parts").alias("piece", out))


def resplit_segments(
    segments: DataFrame, keys: Sequence[str], max_chars: int, min_gap: float = 0.05, sentence_ends: str = SENTENCE_ENDS
) -> DataFrame:
    """Cut long segments with :func:`split_text`, sharing time by characters, each piece at least
    ``min_gap`` long but never past the end.  Adds ``piece``; cut rows lose translation and raw text."""
    rows = segments.withColumn("_parts", split_text(F.col("text"), max_chars, sentence_ends))
    end, text = F.col("end"), F.col("text")

    def place(acc: Column, c: Column) -> Column:
        cursor = acc["cursor"]
        share = (end - F.col("start")) * F.length(c) / acc["total"]
        raw = F.when(acc["left"] == 1, end).otherwise(F.least(end, cursor + share))
        stop = F.when(raw - cursor < min_gap, F.least(end, cursor + F.lit(min_gap))).otherwise(raw)
        piece = F.struct(cursor.alias("start"), stop.alias("end"), tx.strip(c).alias("text"))
        return F.struct(
            stop.alias("cursor"),
            acc["total"].alias("total"),
            (acc["left"] - 1).alias("left"),
            F.array_append(acc["out"], piece).alias("out"),
        )

    empty = F.array().cast("array<struct<start:double,end:double,text:string>>")
    init = F.struct(
        F.col("start").alias("cursor"),
        F.aggregate("_parts", F.lit(0), lambda a, c: a + F.length(c)).alias("total"),
        F.size("_parts").alias("left"),
        empty.alias("out"),
    )
    uncut = F.array(F.struct(F.col("start").alias("start"), end.alias("end"), text.alias("text")))
    pieces = F.when(F.size("_parts") <= 1, uncut).otherwise(F.aggregate("_parts", init, place, lambda acc: acc["out"]))
    # the outer form of explode keeps the optimizer from evaluating the split a second time in a filter
    flat = rows.withColumn("_pieces", pieces).select(
        *[c for c in segments.columns if c not in ("start", "end", "text")],
        (F.size("_pieces") == 1).alias("_whole"),
        F.posexplode_outer("_pieces").alias("piece", "_p"),
    )
    reset = lambda c: F.when(F.col("_whole"), F.col(c)).otherwise(F.lit(""))
    pick = {"start": F.col("_p.start"), "end": F.col("_p.end"), "text": F.col("_p.text"),
            "translation": reset("translation"), "text_raw": reset("text_raw")}
    return flat.select(*[pick.get(c, F.col(c)).alias(c) for c in segments.columns], "piece")


def allot_time_by_chars(parts: DataFrame, keys: Sequence[str], chunk: str, order: str, trust: float = 0.6) -> DataFrame:
    """Absolute times of sub-texts inside one chunk.

    ``parts`` has ``chunk_start``, ``chunk_end``, own relative ``start``/``end`` and ``text``.  A lone
    sub-text takes the chunk; own times count when they are ordered and reach past ``trust`` of the
    chunk; otherwise time follows the share of characters.  Blank sub-texts are dropped.
    """
    group = [*keys, chunk]
    rows = parts.filter(~tx.is_blank(F.col("text"))).withColumn("text", tx.strip(F.col("text")))
    stats = rows.groupBy(*group).agg(
        F.count("*").alias("_n"),
        F.sum(F.length("text")).alias("_total"),
        F.max_by("end", order).alias("_last"),
        F.bool_and(F.col("end") >= F.col("start")).alias("_ordered"),
    )
    rows = scan(
        fit(rows, group, [order]), group, [order], {"_done": ("sum", F.length("text").cast("long"))}, inclusive=True
    )
    rows = unblock(rows).join(stats, group)
    lo, hi = F.col("chunk_start"), F.col("chunk_end")
    span = hi - lo
    own = F.col("_ordered") & (F.col("_last") > trust * span)
    share = lambda n: lo + span * n / F.greatest(F.col("_total"), F.lit(1))
    single = F.col("_n") == 1
    begin = F.when(single, lo).when(own, lo + F.col("start")).otherwise(share(F.col("_done") - F.length("text")))
    stop = F.when(single, hi).when(own, F.least(hi, lo + F.col("end"))).otherwise(F.least(hi, share(F.col("_done"))))
    return rows.select(*group, order, begin.alias("start"), stop.alias("end"), "text")


def renumber(segments: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Dense ``seg_no`` in the given order."""
    rows = number_rows(fit(segments, keys, order), keys, order, "_no")
    return unblock(rows).withColumn("seg_no", F.col("_no")).drop("_no")


def clean_pipeline(
    segments: DataFrame,
    keys: Sequence[str],
    patterns: Sequence[str],
    rules: Sequence[tuple[str, str]],
    max_run: int = 3,
    gap: float = 0.8,
    max_chars: int = 60,
    sentence_ends: str = SENTENCE_ENDS,
) -> DataFrame:
    """Noise, runs, merging, splitting, fixes - in this order."""
    rows = drop_noise_segments(segments, patterns)
    rows = limit_runs(rows, keys, max_run)
    rows = merge_close_segments(rows, keys, gap, max_chars)
    rows = resplit_segments(rows, keys, max_chars, sentence_ends=sentence_ends)
    return apply_fixes(rows, rules)


def make_batches(segments: DataFrame, keys: Sequence[str], size: int = 8, chars: int = 600) -> DataFrame:
    """``batch_no``: position of the first row of a batch of at most ``size`` rows and ``chars`` characters."""
    rows = fit(segments, keys, ["seg_no"])
    return unblock(greedy_groups(rows, keys, ["seg_no"], F.length("text"), F.lit(True), size, chars, "batch_no"))


def batched_apply(
    batches: DataFrame,
    keys: Sequence[str],
    fn: Callable[[list[str]], list[str]],
    column: str = "text",
    out: str = "translation",
    tries: int = 3,
) -> DataFrame:
    """Call ``fn`` on each batch of texts; a wrong-sized or blank answer halves the batch.

    A single text is asked up to ``tries`` times and then left blank.  Batches, not tracks, are the
    unit of distribution.
    """
    group = [*keys, "batch_no"]
    kept = [c for c in batches.columns if c != out]
    names = [*kept, out]
    text_at = kept.index(column)
    group_at = [kept.index(c) for c in group]

    def ask(lines):
        try:
            answer = fn(lines)
        except Exception:  # noqa: BLE001  a failed call counts as a wrong answer
            return None
        good = answer is not None and len(answer) == len(lines) and all(a and a.strip() for a in answer)
        return list(answer) if good else None

    def solve(lines):
        answer = ask(lines)
        if answer is not None:
            return answer
        if len(lines) > 1:
            half = len(lines) // 2
            return solve(lines[:half]) + solve(lines[half:])
        for _ in range(tries):
            answer = ask(lines)
            if answer is not None:
                return answer
        return [""]

    def run(parts):
        import pyarrow as pa

        held = None
        for batch in parts:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys_now = list(zip(*[held.column(i).to_pylist() for i in group_at]))
            edge = len(keys_now)
            while edge and keys_now[edge - 1] == keys_now[-1]:
                edge -= 1
            if edge:
                yield from answered(held.slice(0, edge), keys_now[:edge])
                held = held.slice(edge)
        if held is not None and held.num_rows:
            yield from answered(held, list(zip(*[held.column(i).to_pylist() for i in group_at])))

    def answered(table, ids):
        import pyarrow as pa

        lines, out_values, at = table.column(text_at).to_pylist(), [], 0
        while at < len(ids):
            stop = at
            while stop < len(ids) and ids[stop] == ids[at]:
                stop += 1
            out_values += solve(lines[at:stop])
            at = stop
        full = table.append_column(out, pa.array(out_values, pa.string()))
        yield from full.to_batches()

    rows = batches.select(*kept)
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])
    spread = rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, "seg_no")
    return spread.mapInArrow(run, schema).select(*names)


def incremental_apply(
    segments: DataFrame,
    cache: DataFrame,
    keys: Sequence[str],
    fingerprint: Column,
    compute: Callable[[DataFrame], DataFrame],
    reuse: bool = True,
) -> DataFrame:
    """Compute translations only for non-blank rows without a reusable cached one.

    ``cache`` has the keys, ``seg_no``, ``text``, ``translation`` and ``fingerprint``; the asked ``fingerprint`` is
    a constant or follows from the keys.  Another
    fingerprint disables reuse; a missing one reuses with a warning flag.  Of several cached rows of a
    segment one with the fingerprint wins, then one without any, then the first translation.  Adds ``source``.
    """
    match = F.when(tx.is_blank(F.col("translation")), 3).when(F.col("fingerprint") == fingerprint, 0).when(F.col("fingerprint").isNull(), 1).otherwise(2)
    best = F.min(F.struct(match.alias("_m"), F.col("translation").alias("_old"), F.col("fingerprint").alias("_mark"))).alias("_best")
    old = cache.groupBy(*keys, "seg_no", "text").agg(best).select(
        *keys, "seg_no", "text", "_best._old", "_best._mark", F.lit(True).alias("_hit")
    )
    rows = cut(segments.join(old, [*keys, "seg_no", "text"], "left"))
    same = F.col("_mark").isNull() | (F.col("_mark") == fingerprint)
    usable = F.lit(reuse) & F.col("_hit").isNotNull() & same & ~tx.is_blank(F.col("_old"))
    rows = rows.withColumn("_use", F.coalesce(usable, F.lit(False)))
    blank = tx.is_blank(F.col("text"))
    fields = segments.columns
    reused = rows.filter(F.col("_use") & ~blank).select(
        *[F.col("_old").alias(c) if c == "translation" else F.col(c) for c in fields],
        F.when(F.col("_mark").isNull(), "reused without fingerprint").otherwise("reused").alias("source"),
    )
    empty = rows.filter(blank).select(*fields, F.lit("blank").alias("source"))
    todo = rows.filter(~F.col("_use") & ~blank).select(*fields)
    computed = compute(todo).select(*fields).withColumn("source", F.lit("computed"))
    return reused.unionByName(computed).unionByName(empty)


def timestamp_health(segments: DataFrame, keys: Sequence[str], tracks: DataFrame, shortest: float = 5.0, share: float = 0.5) -> DataFrame:
    """Flag tracks whose last segment ends before ``share`` of their duration."""
    last = segments.groupBy(*keys).agg(F.max("end").alias("last_end"))
    rows = tracks.join(last, list(keys), "left")
    suspect = (F.col("duration") > shortest) & (F.coalesce(F.col("last_end"), F.lit(0.0)) < share * F.col("duration"))
    return rows.withColumn("suspect", suspect)


def glossary_rules(lines: DataFrame, keys: Sequence[str], order: str, limit: int = 40) -> DataFrame:
    """The first ``limit`` lines of a glossary that are neither blank nor comments (a prompt-size rule)."""
    from pyspark.sql import Window

    text = tx.strip(F.col("text"))
    rules = lines.filter((text != "") & ~text.startswith("#"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rules.withColumn("nth", nth).filter(F.col("nth") <= limit)


def dedupe_names(rows: DataFrame, order: str, name: str, out: str = "unique_name") -> DataFrame:
    """Give repeated names `` (2)``, `` (3)`` ... in order, never producing a name already given.

    Names whose root never occurs with such a number are just numbered; only the others need the
    ordered walk.
    """
    numbered = r"^(.*?)(?: \(\d+\))+$"
    root = F.when(F.col(name).rlike(numbered), F.regexp_extract(name, numbered, 1)).otherwise(F.col(name))
    rooted = rows.withColumn("_root", root)
    risky = rooted.filter(F.col("_root") != F.col(name)).select("_root").distinct()
    plain = rooted.join(risky, "_root", "left_anti")
    plain = unblock(number_rows(fit(plain, [name], [order]), [name], [order], "_n"))
    label = F.concat(F.col(name), F.lit(" ("), (F.col("_n") + 1).cast("string"), F.lit(")"))
    plain = plain.select(*rows.columns, F.when(F.col("_n") == 0, F.col(name)).otherwise(label).alias(out))

    walk = rooted.join(risky, "_root", "left_semi")
    name_at, root_at = walk.columns.index(name), walk.columns.index("_root")

    def rename(batches):
        import pyarrow as pa

        current, taken, upcoming = None, set(), {}
        for batch in batches:
            given = []
            for r, base in zip(batch.column(root_at).to_pylist(), batch.column(name_at).to_pylist()):
                if r != current:
                    current, taken, upcoming = r, set(), {}
                v, n = base, upcoming.get(base, 2)
                while v in taken:
                    v = f"{base} ({n})"
                    n += 1
                upcoming[base] = n
                taken.add(v)
                given.append(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(given, pa.string())], names=[*batch.schema.names, out]
            )

    schema = StructType([*walk.schema.fields, StructField(out, StringType())])
    walked = walk.repartition(F.col("_root")).sortWithinPartitions("_root", order).mapInArrow(rename, schema)
    return plain.unionByName(walked.select(*rows.columns, out))


def rename_with_map(files: DataFrame, path: str, mapping: DataFrame, out: str = "renamed") -> DataFrame:
    """Replace a file's stem by its mapped name, keeping folder, suffix and a double ``.ja`` suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    ext = F.regexp_extract(name, r".((?:\.ja)?\.[^.]*)$", 1)
    base = F.substr(name, F.lit(1), F.length(name) - F.length(ext))
    keyed = files.withColumn("_stem", base).withColumn("_folder", folder).withColumn("_ext", ext)
    table = mapping.select(F.col("stem").alias("_stem"), F.col("new_name").alias("_new"))
    joined = keyed.join(table, "_stem", "left")
    new = F.when(F.coalesce(F.col("_new"), F.lit("")) == "", F.col(path)).otherwise(
        F.concat(F.col("_folder"), F.col("_new"), F.col("_ext"))
    )
    return joined.withColumn(out, new).select(*files.columns, out)

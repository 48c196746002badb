"""Alignment of texts, candidates, truths and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans.nearest import nearest, window_best


def nearest_text(points: DataFrame, segments: DataFrame, keys: Sequence[str], t: str = "t", radius: float = 6.0) -> DataFrame:
    """The non-blank text whose start is nearest to each point, within ``radius``; ties take the earlier row."""
    spoken = segments.filter(~tx.is_blank(F.col("text"))).select(*keys, F.col("start").alias("_s"), "seg_no", "text")
    rows = nearest(points, spoken, keys, t, "_s", {"_text": "text"}, tie="seg_no")
    near = F.col("dist") <= radius
    return rows.select(*points.columns, F.when(near, F.col("_text")).otherwise("").alias("text"))


def best_cue(
    points: DataFrame,
    segments: DataFrame,
    keys: Sequence[str],
    cues: Sequence[tuple[str, str, int]],
    t: str = "t",
    radius: float = 6.0,
) -> DataFrame:
    """Strongest cue within ``radius`` of each point: ``cue`` (never below 0) and ``cue_tags``."""
    total, tags = tx.cue_score(F.coalesce(F.col("text"), F.lit("")), cues)
    scored = segments.select(*keys, F.col("start").alias("_s"), "seg_no", total.alias("_w"), F.array_join(tags, ",").alias("_tags"))
    positive = scored.filter(F.col("_w") > 0)
    rows = window_best(points, positive, keys, t, "_s", radius, F.col("_w"), F.col("seg_no"), {"_tags": F.col("_tags")})
    return rows.select(
        *points.columns,
        F.coalesce(F.col("best_score"), F.lit(0.0)).cast("long").alias("cue"),
        F.coalesce(F.col("_tags"), F.lit("")).alias("cue_tags"),
    )


def nearest_match(
    reference: DataFrame, own: DataFrame, keys: Sequence[str], t_ref: str, t_own: str, tolerance: float, tie: str | None = None,
    payload: dict[str, str] | None = None,
) -> DataFrame:
    """Nearest own row per reference row: ``matched`` within tolerance, ``shift`` = own minus reference."""
    rows = nearest(reference, own, keys, t_ref, t_own, payload or {}, tie, coarse=True)
    return rows.withColumn("matched", F.coalesce(F.col("dist") <= tolerance, F.lit(False))).withColumn("shift", -F.col("delta"))


def reverse_coverage(reference: DataFrame, own: DataFrame, keys: Sequence[str], t_ref: str, t_own: str, tolerance: float) -> DataFrame:
    """How many own rows have a reference row within tolerance."""
    rows = nearest_match(own, reference, keys, t_own, t_ref, tolerance)
    return rows.agg(F.count("*").alias("own_rows"), F.count_if("matched").alias("covered_rows"))


def label_candidates(candidates: DataFrame, truth: DataFrame, keys: Sequence[str], tolerance: float = 20.0) -> DataFrame:
    """``dist`` to the nearest truth (null without truth on the track) and ``hit`` within tolerance."""
    rows = nearest(candidates, truth, keys, "t", "t", {})
    return rows.drop("delta").withColumn("hit", F.coalesce(F.col("dist") <= tolerance, F.lit(False)))


def labelled_only(events: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events of labelled tracks, including those labelled with no truth at all."""
    return events.join(labelled.select(*keys).distinct(), list(keys), "left_semi")


def match_events(
    events: DataFrame, truth: DataFrame, labelled: DataFrame, keys: Sequence[str], tolerance: float = 20.0
) -> tuple[DataFrame, DataFrame]:
    """(events with ``hit`` and ``dist``, truths with ``covered``), labelled tracks only, no pairs emitted."""
    ours = labelled_only(events, labelled, keys)
    theirs = labelled_only(truth, labelled, keys)
    hits = label_candidates(ours, theirs, keys, tolerance)
    covered = nearest(theirs, ours, keys, "t", "t", {}).withColumn(
        "covered", F.coalesce(F.col("dist") <= tolerance, F.lit(False))
    )
    return hits, covered.drop("dist", "delta")


def override_labels(official: DataFrame, own: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Official labels, replaced by the own ones on finished tracks that have own labels."""
    replaced = own.join(finished.select(*keys).distinct(), list(keys), "left_semi")
    tracks = replaced.select(*keys).distinct()
    return official.join(tracks, list(keys), "left_anti").withColumn("label_source", F.lit("official")).unionByName(
        replaced.select(*official.columns).withColumn("label_source", F.lit("own"))
    )


def prefer_existing_twin(files: DataFrame, extension: str = ".mp3") -> DataFrame:
    """Per file (``dir``, ``stem``, ``ext``): ready, ready from a twin in the same folder, or to convert."""
    ready = files.filter(F.lower("ext") == extension).select("dir", "stem", F.lit(True).alias("_twin")).distinct()
    rows = files.join(ready, ["dir", "stem"], "left")
    state = F.when(F.lower("ext") == extension, "ready").when(F.col("_twin"), "ready from twin").otherwise("to convert")
    return rows.withColumn("state", state).drop("_twin")


def pending_works(finished: DataFrame, marked: DataFrame, trained: DataFrame, keys: Sequence[str], work: str) -> DataFrame:
    """Works of finished and marked tracks that the model was not trained on."""
    ready = finished.join(marked.select(*keys).distinct(), list(keys), "left_semi").select(work).distinct()
    return ready.join(trained.select(work).distinct(), work, "left_anti")


def locate_transcript(tracks: DataFrame, files: DataFrame, suffixes: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Transcript file of each track: ``path``, and ``how`` it was found (exact, prefix, missing).

    ``tracks`` has ``track_id``, ``folder`` and ``stem``; ``files`` has ``folder`` and ``name``.  The own folder
    comes first, then the ``extra`` folders in their order; within a folder the stem with the first suffix that
    exists wins.  Failing that, the first file (extra folders in order, names sorted) with the first suffix whose
    lower-cased name begins with the lower-cased stem up to its first ``_``.
    """
    place = F.array_position(F.array(*[F.lit(e) for e in extra]).cast("array<string>"), F.col("folder"))
    ranked = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(s).alias("suffix")) for i, s in enumerate(suffixes)])
    named = files.select("folder", "name", F.explode(ranked).alias("_s")).filter(F.endswith("name", F.col("_s.suffix")))
    named = named.select(
        "folder", F.substr("name", F.lit(1), F.length("name") - F.length("_s.suffix")).alias("stem"), place.alias("_place"),
        F.col("_s.nth").alias("_nth"), F.concat("folder", F.lit("/"), "name").alias("path"),
    )
    own = named.groupBy("folder", "stem").agg(F.min(F.struct("_nth", "path")).alias("_own"))
    others = named.filter("_place > 0").groupBy("stem").agg(F.min(F.struct("_place", "_nth", "path")).alias("_other"))
    rows = tracks.withColumn("_key", F.lower(F.split_part("stem", F.lit("_"), F.lit(1))))
    rows = rows.join(own, ["folder", "stem"], "left").join(others, "stem", "left")
    # every beginning of a name under the lengths that are asked for; the first file of each is a map-side minimum
    lengths = rows.select(F.length("_key").alias("_n")).distinct()
    begins = files.withColumn("_place", place).filter(F.col("_place") > 0).filter(F.endswith("name", F.lit(suffixes[0])))
    begins = begins.select("_place", "name", F.concat("folder", F.lit("/"), "name").alias("path"), F.explode(F.sequence(F.lit(0), F.length("name"))).alias("_n"))
    begins = begins.join(lengths, "_n", "left_semi").select(
        F.substr(F.lower("name"), F.lit(1), F.col("_n")).alias("_key"), F.struct("_place", "name", "path").alias("_near")
    ).groupBy("_key").agg(F.min("_near").alias("_near"))
    rows = rows.join(begins, "_key", "left")
    exact = F.coalesce("_own.path", "_other.path")
    how = F.when(exact.isNotNull(), "exact").when(F.col("_near").isNotNull(), "prefix").otherwise("missing")
    return rows.select(*tracks.columns, F.coalesce(exact, "_near.path").alias("path"), how.alias("how"))


def match_files_by_track(wanted: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One file per (work, track): matched, ambiguous (copies of different size) or missing.

    Several copies of one size give the shortest path.
    """
    found = files.groupBy(*keys).agg(
        F.count("*").alias("copies"),
        (F.min("size") == F.max("size")).alias("_same"),
        F.min_by("path", F.struct("size", F.length("path"), F.col("path"))).alias("_path"),
    )
    rows = wanted.join(found, list(keys), "left")
    status = F.when(F.col("copies").isNull(), "missing").when(F.col("_same"), "matched").otherwise("ambiguous")
    return rows.select(
        *wanted.columns,
        F.coalesce("copies", F.lit(0)).alias("copies"),
        status.alias("status"),
        F.when(status == "matched", F.col("_path")).alias("path"),
    )


def require_all_matched(matched: DataFrame) -> DataFrame:
    """Gate before writing: fail when any row is missing or ambiguous."""
    bad = matched.filter(F.col("status") != "matched").count()
    if bad:
        raise ValueError(f"{bad} tracks without a unique file; nothing is written")
    return matched


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark prunes to ``k`` per task before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(rank, nth).filter(F.col(rank) <= k)

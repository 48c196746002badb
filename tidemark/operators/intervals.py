"""Coverage, gaps and cuts of intervals on a track."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.plans.blocks import fit, islands, scan, unblock


def coverage(chunks: DataFrame, keys: Sequence[str], durations: DataFrame) -> DataFrame:
    """Share of each track's ``duration`` covered by its intervals; 0 for a track without any."""
    sums = chunks.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    on = [k for k in keys if k in durations.columns]
    rows = durations.join(sums, on, "left")
    covered = F.coalesce(F.col("covered").cast("double"), F.lit(0.0))
    return rows.withColumn("covered", covered).withColumn(
        "coverage", covered / F.greatest(F.col("duration").cast("double"), F.lit(1e-6))
    )


def pick_threshold(coverages: DataFrame, keys: Sequence[str], order: str, threshold: str, target: float) -> DataFrame:
    """First threshold (in ``order``) reaching the target coverage, else the best one, first wins."""
    reached = F.col("coverage") >= target
    found = F.struct("coverage", F.col(threshold))
    rows = coverages.groupBy(*keys).agg(
        F.min_by(F.when(reached, found), F.when(reached, F.col(order))).alias("_ok"),
        F.max_by(found, F.struct("coverage", -F.col(order))).alias("_best"),
    )
    pick = F.coalesce(F.col("_ok"), F.col("_best"))
    return rows.select(*keys, pick[threshold].alias(threshold), pick["coverage"].alias("coverage"))


def gaps(spans: DataFrame, keys: Sequence[str], lengths: DataFrame, min_gap: float, order: Sequence[str]) -> DataFrame:
    """Uncovered stretches of at least ``min_gap``, also before the first and after the last interval.

    ``lengths`` gives each track's ``length``; the end of a track is one more row after all others.
    """
    body = spans.filter(F.col("end") > F.col("start")).select(*keys, *order, "start", "end", F.lit(0).alias("_tail"))
    on = list(keys)
    tails = lengths.select(
        *keys,
        *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in order if c not in ("start", "end")],
        F.col("length").cast(spans.schema["start"].dataType).alias("start"),
        F.col("length").cast(spans.schema["end"].dataType).alias("end"),
        F.lit(1).alias("_tail"),
    )
    rows = body.select(*on, *[c for c in order if c not in ("start", "end")], "start", "end", "_tail").unionByName(tails)
    by = ["_tail", "start", *[c for c in order if c not in ("start", "end")]]
    ends = F.when(F.col("_tail") == 0, F.col("end"))
    rows = scan(fit(rows, keys, by), keys, by, {"_reach": ("max", ends)}, inclusive=False)
    begin = F.greatest(F.coalesce(F.col("_reach"), F.lit(0)), F.lit(0))
    found = unblock(rows).withColumn("gap_start", begin).filter(F.col("start") - F.col("gap_start") >= min_gap)
    return found.select(*keys, "gap_start", F.col("start").alias("gap_end"))


class _Cuts:
    """The cutting rule on one block of frames: for each start where the next piece starts, and where its own ends.

    Starts are multiples of the greatest common divisor of frame, rate and target, plus the offset of their span's
    begin or plus nothing, so a block knows all starts that can occur in it.
    """

    def __init__(self, rate: int, target: int, frame: int, slack: int) -> None:
        self.rate, self.target, self.frame, self.slack = rate, target, frame, slack
        self.unit = math.gcd(frame, rate, target)
        #: Samples that a start lies at most behind the start before it, with a frame for the rounding of frames.
        self.reach = max(target + slack, rate, frame) + frame

    def starts(self, low: int, high: int, lo: int):
        """All possible starts from ``low`` to ``high``."""
        import numpy as np

        first = -(-low // self.unit) * self.unit
        plain = np.arange(first, high, self.unit)
        offset = lo % self.unit
        if not offset:
            return plain
        return np.union1d(plain, np.arange(low + (offset - low) % self.unit, high, self.unit))

    def ends(self, starts, hi: int, frames, levels):
        """End of the piece that begins at each start; ``frames`` are the complete frames around, in order."""
        import numpy as np

        goal = np.minimum(hi, starts + self.target)
        first = np.maximum(starts + self.rate, goal - self.slack)
        f0 = first // self.frame
        f1 = np.maximum(f0 + 1, np.minimum(hi, goal + self.slack) // self.frame)
        quiet = _least_in(levels, np.searchsorted(frames, f0), np.searchsorted(frames, f1))
        at = np.maximum(starts + self.rate, np.minimum(hi, np.append(frames, 0)[quiet] * self.frame))
        stop = np.where(goal < hi, np.where(quiet >= 0, at, goal), goal)
        return np.minimum(stop, hi)

    def following(self, starts, ends):
        import numpy as np

        return np.maximum(ends, starts + self.frame)


def _least_in(values, low, high):
    """Place of the first least value in each range, -1 for empty ranges, by a table of minima over powers of two."""
    import numpy as np

    out = np.full(len(low), -1, dtype=np.int64)
    size = high - low
    if not len(values) or not (size > 0).any():
        return out
    table = [np.arange(len(values))]
    while 2 << (len(table) - 1) <= int(size.max()):
        half = 1 << (len(table) - 1)
        a, b = table[-1][:-half], table[-1][half:]
        table.append(np.where(values[b] < values[a], b, a))
    some = np.flatnonzero(size > 0)
    step = np.frexp(size[some].astype(np.float64))[1] - 1
    for k in np.unique(step):
        at = some[step == k]
        a, b = table[k][low[at]], table[k][high[at] - (1 << int(k))]
        out[at] = np.where(values[b] < values[a], b, a)
    return out


def split_at_quiet(
    spans: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    rate: int,
    target: int,
    floor_db: float,
    frame: int,
    slack: int,
    value: str = "x",
) -> DataFrame:
    """Cut each span every ``target`` samples, moved to the quietest frame within ``slack``; drop silent pieces.

    Spans are in samples.  One cut depends on the one before, but where a piece ends depends on its start alone. So spans are
    cut into blocks of bounded length with the frames just behind them; every block maps each start with which it can be
    entered to the start with which it is left, these maps are followed along a span, and then each block marks its own
    pieces. The number of jobs doesn't depend on the length of a span, and no span's samples ever meet in one task.
    """
    from tidemark.plans.folds import sorted_groups
    from tidemark.session import block_rows, cut

    rule = _Cuts(rate, target, frame, slack)
    per_frame = samples.withColumn("_frame", F.floor(F.col("idx") / frame))
    levels = cut(
        per_frame.groupBy(*keys, "_frame").agg(
            F.sum(F.pow(F.col(value), 2)).alias("_power"), F.count("*").alias("_count"), F.max(F.abs(value)).alias("_peak")
        )
    )
    level = F.lit(20.0) * F.log10(F.greatest(F.sqrt(F.col("_power") / F.col("_count")), F.lit(1e-7)))
    # a block is longer than any step, so a step leaves it at most for the next one
    length = -(-max(block_rows(samples.sparkSession) * frame, 2 * rule.reach) // frame) * frame
    part = [*keys, "_lo", "_hi", "_b"]
    blocks = spans.filter(F.col("hi") > F.col("lo")).select(*keys, F.col("lo").cast("long").alias("_lo"), F.col("hi").cast("long").alias("_hi"))
    blocks = blocks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / length), F.floor((F.col("_hi") - 1) / length))))
    first = F.floor(F.greatest(F.col("_lo"), F.col("_b") * length) / frame)
    last = F.floor(F.least(F.col("_hi"), (F.col("_b") + 1) * length + rule.reach) / frame)
    near = blocks.withColumn("_frame", F.explode(F.sequence(first, last)))
    full = levels.filter(F.col("_count") == frame).select(*keys, "_frame", level.alias("_level"))
    framed = near.join(full, [*keys, "_frame"], "left").select(*part, "_frame", "_level")
    placed = cut(framed.repartition(*[F.col(c) for c in part]).sortWithinPartitions(*part, "_frame"))
    key_fields = [spans.schema[k] for k in keys]
    wide = StructType([*key_fields, *[StructField(c, LongType()) for c in ("_lo", "_hi", "_b")]])
    key_types = [to_arrow_type(f.dataType) for f in wide.fields]

    def of_block(key, held):
        import numpy as np

        *_, lo, hi, b = key
        some = ~np.isnan(held["_level"])
        return lo, hi, max(lo, b * length), min(hi, (b + 1) * length), held["_frame"][some], held["_level"][some]

    def rows(key, columns: Mapping):
        import pyarrow as pa

        n = len(next(iter(columns.values())))
        ids = [pa.array([v] * n, t) for v, t in zip(key, key_types)]
        return pa.RecordBatch.from_arrays([*ids, *columns.values()], names=[*wide.names[: len(key)], *columns])

    def exits(batches):
        import numpy as np
        import pyarrow as pa

        for key, held in sorted_groups(batches, part, ["_frame", "_level"]):
            lo, hi, low, high, frames, levels_ = of_block(key, held)
            starts = rule.starts(low, high, lo)
            leave = rule.following(starts, rule.ends(starts, hi, frames, levels_))
            # follow every start to the first one behind the block, by doubling
            at = np.searchsorted(starts, leave)
            inside = leave < high
            while inside.any():
                leave = np.where(inside, leave[np.minimum(at, len(at) - 1)], leave)
                at = np.searchsorted(starts, leave)
                inside = leave < high
            entered = starts < low + rule.reach if low > lo else starts == lo
            yield rows(key, {"_exits": pa.array([np.stack([starts[entered], leave[entered]], axis=1).ravel().tolist()], pa.list_(pa.int64()))})

    def follow(batches):
        import numpy as np
        import pyarrow as pa

        span, entry = None, None
        for batch in batches:
            ids = list(zip(*[batch.column(c).to_pylist() for c in part]))
            out = []
            for i, key in enumerate(ids):
                if key[:-1] != span:
                    span, entry = key[:-1], key[-3]
                out.append(entry)
                table = batch.column(len(part))[i].values.to_numpy().reshape(-1, 2)
                if entry < min(key[-2], (key[-1] + 1) * length):
                    entry = int(table[np.searchsorted(table[:, 0], entry), 1])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(part))], pa.array(out, pa.int64())], names=[*part, "_entry"])

    def mark(batches):
        import numpy as np
        import pyarrow as pa

        for key, held in sorted_groups(batches, part, ["_frame", "_level", "_entry"]):
            lo, hi, low, high, frames, levels_ = of_block(key, held)
            starts = rule.starts(low, high, lo)
            ends = rule.ends(starts, hi, frames, levels_)
            leave, at, found = rule.following(starts, ends), int(held["_entry"][0]), []
            while at < high:
                i = int(np.searchsorted(starts, at))
                found.append(i)
                at = int(leave[i])
            yield rows(key[: len(keys)], {"start": pa.array(starts[found]), "end": pa.array(ends[found])})

    table = placed.mapInArrow(exits, StructType([*wide.fields, StructField("_exits", ArrayType(LongType()))]))
    along = table.repartition(*[F.col(c) for c in part[:-1]]).sortWithinPartitions(*part)
    entries = along.mapInArrow(follow, StructType([*wide.fields, StructField("_entry", LongType())]))
    marked = placed.join(entries, part).repartition(*[F.col(c) for c in part]).sortWithinPartitions(*part, "_frame")
    pieces = marked.mapInArrow(mark, StructType([*key_fields, StructField("start", LongType()), StructField("end", LongType())]))
    return _loud_enough(cut(pieces), samples, keys, levels, frame, floor_db, value)


def _loud_enough(
    pieces: DataFrame, samples: DataFrame, keys: Sequence[str], levels: DataFrame, frame: int, floor_db: float, value: str
) -> DataFrame:
    """Pieces whose largest absolute sample reaches the floor: whole frames from the level table, edges from samples."""
    inner_lo, inner_hi = F.ceil(F.col("start") / frame), F.floor(F.col("end") / frame)
    rows = pieces.filter(F.col("end") > F.col("start")).select(*keys, "start", "end")
    whole = rows.filter(inner_hi > inner_lo).select(
        *keys, "start", "end", F.explode(F.sequence(inner_lo, inner_hi - 1)).alias("_frame")
    )
    inside = whole.join(levels.select(*keys, "_frame", "_peak"), [*keys, "_frame"]).select(*keys, "start", "end", "_peak")
    edge_ids = F.array_distinct(
        F.flatten(
            F.array(
                F.sequence(F.col("start"), F.least(F.col("end"), inner_lo * frame)),
                F.sequence(F.greatest(F.col("start"), F.least(inner_hi * frame, F.col("end"))), F.col("end")),
            )
        )
    )
    ids = rows.select(*keys, "start", "end", F.explode(edge_ids).alias("idx")).filter(F.col("idx") < F.col("end"))
    outside = ids.join(samples.select(*keys, "idx", value), [*keys, "idx"]).select(
        *keys, "start", "end", F.abs(value).alias("_peak")
    )
    peaks = inside.unionByName(outside).groupBy(*keys, "start", "end").agg(F.max("_peak").alias("_peak"))
    db = F.lit(20.0) * F.log10(F.greatest(F.lit(1e-7), F.col("_peak")))
    return peaks.filter(db >= floor_db).select(*keys, "start", "end")


def fill_gaps(
    chunks: DataFrame, samples: DataFrame, keys: Sequence[str], lengths: DataFrame, min_gap: int, **cutting
) -> DataFrame:
    """Base intervals plus energy-cut pieces of the gaps between them, with their ``kind``."""
    found = gaps(chunks, keys, lengths, min_gap, ["start", "end"])
    spans = found.select(*keys, F.col("gap_start").alias("lo"), F.col("gap_end").alias("hi"))
    extra = split_at_quiet(spans, samples, keys, **cutting)
    return chunks.select(*keys, "start", "end", F.lit("base").alias("kind")).unionByName(
        extra.select(*keys, "start", "end", F.lit("filled").alias("kind"))
    )


def low_coverage_fallback(chunks: DataFrame, keys: Sequence[str], durations: DataFrame, least: float = 0.1) -> DataFrame:
    """Tracks without intervals, or covered below ``least``, become one whole-track interval."""
    share = coverage(chunks, keys, durations).withColumn("_whole", F.col("coverage") < least)
    kept = chunks.join(share.filter(~F.col("_whole")).select(*keys), list(keys), "left_semi")
    whole = share.filter(F.col("_whole")).select(
        *keys, F.lit(0).cast(chunks.schema["start"].dataType).alias("start"),
        F.col("duration").cast(chunks.schema["end"].dataType).alias("end"), F.lit("whole").alias("kind"),
    )
    return kept.select(*keys, "start", "end", F.lit("chunk").alias("kind")).unionByName(whole)


def group_by_gap(
    points: DataFrame, keys: Sequence[str], t: str, gap: float, tie: str, aggregates: Sequence[Column] = ()
) -> DataFrame:
    """Sessions of points whose successive distance is at most ``gap``: count, first, last, mean."""
    rows = fit(points, keys, [t, tie])
    rows = islands(rows, keys, [t, tie], lambda p: F.col(t) - p["t"] > gap, {"t": F.col(t)}, "grp")
    return unblock(rows).groupBy(*keys, "grp").agg(
        F.count("*").alias("members"),
        F.min(t).alias("first_t"),
        F.max(t).alias("last_t"),
        F.avg(t).alias("mean_t"),
        *aggregates,
    )


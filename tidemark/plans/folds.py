"""Order-dependent rules: greedy grouping, best-first selection and suppression."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidemark.plans.blocks import fit, is_blocked, islands, largest_key, number_rows, scan, shift, unblock
from tidemark.plans.nearest import nearest, window_best
from tidemark.session import block_rows, cut


def sorted_groups(batches, part: Sequence[str], columns: Sequence[str]):
    """Yield (key, {column: array}) for each run of rows that agree in ``part``, from sorted Arrow batches."""
    import numpy as np

    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(k).to_pylist() for k in part]
        new = np.zeros(batch.num_rows, dtype=bool)
        for values in ids:
            new[1:] |= [a != b for a, b in zip(values, values[1:])]
        bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        arrays = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        for low, high in zip(bounds, bounds[1:]):
            here = tuple(values[low] for values in ids)
            if here != key:
                if key is not None:
                    yield key, {c: np.concatenate(v) for c, v in held.items()}
                key, held = here, {c: [] for c in columns}
            for c in columns:
                held[c].append(arrays[c][low:high])
    if key is not None:
        yield key, {c: np.concatenate(v) for c, v in held.items()}


def _next_starts(sizes, linked, max_rows: int | None, max_total: int):
    """For each row the row at which the next group begins, if a group begins at it."""
    import numpy as np

    n = len(sizes)
    place = np.arange(n)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    nxt = np.searchsorted(sums, sums[:-1] + max_total, side="right") - 1
    breaks = np.append(np.flatnonzero(~linked), n)
    if n:
        nxt = np.minimum(nxt, breaks[np.searchsorted(breaks, place, side="right")])
    if max_rows is not None:
        nxt = np.minimum(nxt, place + max_rows)
    return np.maximum(nxt, place + 1)


def greedy_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: Column,
    linked: Column,
    max_rows: int | None,
    max_total: int,
    name: str = "group_no",
) -> DataFrame:
    """Pack consecutive rows greedily; ``name`` is the dense position of the group's first row.

    A row joins the open group when ``linked`` holds, the group has fewer than ``max_rows`` rows and
    its size stays within ``max_total``.  Sizes may be 0.
    """
    rows = number_rows(df, keys, order, "_p")
    rows = rows.withColumn("_size", size.cast("long")).withColumn("_linked", F.coalesce(linked, F.lit(False)))
    if is_blocked(rows):
        return _greedy_blocks(rows, keys, max_rows, max_total, name)
    at = {c: rows.columns.index(c) for c in ("_p", "_size", "_linked")}
    key_at = [rows.columns.index(k) for k in keys]

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        last_key, start, count, total = None, 0, 0, 0
        for batch in batches:
            p, sizes = (batch.column(at[c]).to_numpy() for c in ("_p", "_size"))
            joined = batch.column(at["_linked"]).to_numpy(zero_copy_only=False)
            out = np.empty(len(p), dtype=np.int64)
            opens = np.flatnonzero(p == 0)  # positions are dense: a key begins where they do
            bounds = np.unique(np.concatenate([[0], opens, [len(p)]]))
            for low, high in zip(bounds, bounds[1:]):
                if low == high:
                    continue
                i = int(low)
                key = tuple(batch.column(c)[i].as_py() for c in key_at)
                if p[i] > 0 and key == last_key:
                    # go on with the group that the batch before left open
                    stops = ~joined[low:high] | (total + np.cumsum(sizes[low:high]) > max_total)
                    if max_rows is not None:
                        stops |= count + np.arange(high - low) >= max_rows
                    i = int(low + stops.argmax()) if stops.any() else int(high)
                    out[low:i] = start
                    count, total = count + i - int(low), total + int(sizes[low:i].sum())
                nxt = _next_starts(sizes[i:high], joined[i:high], max_rows, max_total) + i
                first = i
                while i < high:
                    stop = min(int(nxt[i - first]), int(high))
                    out[i:stop] = p[i]
                    start, count, total = int(p[i]), stop - i, int(sizes[i:stop].sum())
                    i = stop
                last_key = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    schema = StructType([*rows.schema.fields, StructField(name, LongType())])
    spread = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "_p")
    return spread.mapInArrow(pack, schema).drop("_p", "_size", "_linked")


def _greedy_blocks(rows: DataFrame, keys: Sequence[str], max_rows: int | None, max_total: int, name: str) -> DataFrame:
    """Greedy grouping of a key that spans many blocks.

    From every possible entry row (a group is at most ``cap`` rows long, so an entry is one of the
    first ``cap`` rows of a block) the exit row in the next block is computed in parallel; the small
    table of entry -> exit maps is then followed per key, and each block marks its group starts.

    Without ``max_rows`` a linked row of size 0 after another row of size 0 is always in that row's
    group, so such rows are left out and take the label of the row before.  What remains of a group
    has at most one row of size 0 before, after and between at most ``max_total`` others.
    """
    if max_rows is None:
        before = shift(rows, keys, ["_p"], {"_before": F.col("_size")})
        idle = F.col("_linked") & (F.col("_size") == 0) & (F.coalesce(F.col("_before"), F.lit(1)) == 0)
        spine = number_rows(before.filter(~idle).drop("_before"), keys, ["_p"], "_q")
        cap = 2 * max_total + 2
    else:
        spine, cap = rows.withColumn("_q", F.col("_p")), max_rows
    length = max(block_rows(rows.sparkSession), cap)
    slim = spine.select(*keys, F.floor(F.col("_q") / length).cast("long").alias("_b"), "_p", "_q", "_size", "_linked")
    part = [*keys, "_b"]
    slim = cut(slim.withColumn("_halo", F.lit(False)))
    halo = (
        slim.filter((F.col("_q") % length < cap) & (F.col("_b") > 0))
        .withColumn("_b", F.col("_b") - 1)
        .withColumn("_halo", F.lit(True))
    )
    key_fields = [rows.schema[k] for k in keys]
    part_types = [to_arrow_type(slim.schema[c].dataType) for c in part]

    def exits(batches):
        import pyarrow as pa

        for key, held in sorted_groups(batches, part, ["_size", "_linked", "_halo"]):
            own = int((~held["_halo"]).sum())
            nxt = _next_starts(held["_size"], held["_linked"], max_rows, max_total).tolist()
            out = [0] * own
            for i in range(own - 1, -1, -1):
                j = nxt[i]
                out[i] = j - own if j >= own else out[j]
            cols = [pa.array([v], t) for v, t in zip(key, part_types)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([out[:cap]], pa.list_(pa.int32()))], names=[*part, "_exits"]
            )

    exit_schema = StructType([*key_fields, StructField("_b", LongType())]).add("_exits", ArrayType(IntegerType()))
    table = (
        slim.unionByName(halo)
        .repartition(*[F.col(c) for c in part])
        .sortWithinPartitions(*part, "_q")
        .mapInArrow(exits, exit_schema)
    )

    def follow(batches):
        import pyarrow as pa

        key, entry = None, 0
        for batch in batches:
            data = batch.to_pydict()
            out = []
            for i, row_key in enumerate(zip(*[data[k] for k in keys])):
                if row_key != key:
                    key, entry = row_key, 0
                out.append(entry)
                steps = data["_exits"][i]
                entry = steps[entry] if entry < len(steps) else entry - len(steps)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in part], pa.array(out, pa.int32())], names=[*part, "_entry"]
            )

    entry_schema = StructType([*key_fields, StructField("_b", LongType()), StructField("_entry", IntegerType())])
    entries = (
        table.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*part).mapInArrow(follow, entry_schema)
    )

    def mark(batches):
        import pyarrow as pa

        for key, held in sorted_groups(batches, part, ["_p", "_size", "_linked", "_entry"]):
            n = len(held["_p"])
            nxt = _next_starts(held["_size"], held["_linked"], max_rows, max_total)
            starts, i = [], int(held["_entry"][0])
            while i < n:
                starts.append(i)
                i = int(nxt[i])
            cols = [pa.array([v] * len(starts), t) for v, t in zip(key[:-1], part_types)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(held["_p"][starts], pa.int64())], names=[*keys, "_p"])

    marked = (
        slim.drop("_halo")
        .join(entries, part)
        .repartition(*[F.col(c) for c in part])
        .sortWithinPartitions(*part, "_q")
        .mapInArrow(mark, StructType([*key_fields, StructField("_p", LongType())]))
    )
    labelled = rows.join(marked.withColumn("_open", F.lit(True)), [*keys, "_p"], "left")
    out = scan(labelled, keys, ["_p"], {name: ("last", F.when(F.col("_open"), F.col("_p")))})
    return out.drop("_p", "_size", "_linked", "_open")


def ranked_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: Sequence[str],
    init: Column,
    step: Callable[[Column, Column], Column],
    walk: Callable[[], Callable],
) -> DataFrame:
    """Fold each key's rows in ``order`` into one small state: (keys, state).

    ``order`` lists ascending columns and must be total.  Keys that fit a task are folded by ``step`` in one expression.
    Where one doesn't, the rows of a key stream past in order, sorted outside of Python, and ``walk`` states the same
    rule for them: it makes a function that takes the values of (order, item) and gives the state as plain values, or
    None where rows that follow change nothing any more.  So a key of any length is one pass in bounded memory.
    """
    fields = list(dict.fromkeys([*order, *item]))
    packed = F.array_sort(F.collect_list(F.struct(*fields)))
    rows = df.select(*keys, *fields)
    limit = block_rows(df.sparkSession)
    if not is_blocked(df) and largest_key(rows, keys)[0] <= limit:
        grouped = rows.groupBy(*keys).agg(packed.alias("_rows"))
        return grouped.select(*keys, F.aggregate("_rows", init, step).alias("state"))
    state_type = df.sparkSession.range(0).select(init.alias("s")).schema["s"].dataType
    schema = StructType([*[rows.schema[k] for k in keys], StructField("state", state_type)])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    n = len(keys)

    def fold(batches):
        import pyarrow as pa

        key, take, state, done = None, None, None, []

        def flush():
            out, done[:] = list(zip(*done)), []
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(out, types)], names=schema.names)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns):
                if values[:n] != key:
                    if key is not None:
                        done.append((*key, state))
                    key, take, state = values[:n], walk(), None
                if take is not None:
                    known, more = take(values[n:])
                    state = known
                    if not more:
                        take = None
            if len(done) > 1000:
                yield flush()
        if key is not None:
            done.append((*key, state))
        if done:
            yield flush()

    spread = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return spread.mapInArrow(fold, schema)


def suppress(
    df: DataFrame, keys: Sequence[str], at: str, score: str, gap: float, bound: int | None = None
) -> DataFrame:
    """Keep rows best first (score, then earlier ``at``), dropping any within ``gap`` of a kept one.

    ``at`` must be unique within a key.
    """
    rows = fit(df, keys, [at], bound=bound)
    if is_blocked(rows):
        return _suppress_rounds(unblock(rows), keys, at, score, gap)
    grouped = islands(rows, keys, [at], lambda p: F.col(at) - p["at"] > gap, {"at": F.col(at)})
    body = F.struct((-F.col(score)).alias("_neg"), F.col(at).alias("_at"), F.struct(*df.columns).alias("_row"))
    folded = grouped.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(body)).alias("_rows"))
    kept = F.aggregate(
        "_rows",
        F.filter("_rows", lambda _: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k["_at"] - x["_at"]) <= gap), acc).otherwise(
            F.array_append(acc, x)
        ),
    )
    return folded.select(F.explode(kept).alias("_k")).select("_k._row.*")


def _suppress_rounds(df: DataFrame, keys: Sequence[str], at: str, score: str, gap: float) -> DataFrame:
    """The same rule in parallel rounds: every row that beats all open neighbours is kept at once."""
    left = cut(df)
    kept = None
    while not left.isEmpty():
        best = window_best(
            left, left, keys, at, at, gap, F.col(score), F.col(at), {"_best_at": F.col(at)}
        )
        winners = cut(best.filter(F.col("_best_at") == F.col(at)).select(*df.columns))
        near = nearest(left, winners, keys, at, at, {})
        left = cut(near.filter(F.coalesce(F.col("dist") > gap, F.lit(True))).select(*df.columns))
        kept = winners if kept is None else kept.unionByName(winners)
    return kept if kept is not None else left


def select_spaced(
    df: DataFrame, keys: Sequence[str], at: str, score: str, gap: float | Column, top: int, extra: Sequence[str] = ()
) -> DataFrame:
    """Best-first picks more than ``gap`` apart, at most ``top`` per key; ties by earlier ``at``."""
    rows = df.withColumns({
        "_neg": -F.col(score).cast("double"), "_at": F.col(at).cast("double"), "_gap": (gap if isinstance(gap, Column) else F.lit(gap)).cast("double"),
    })
    item = ["_neg", "_at", *extra]
    empty = F.array().cast(f"array<{rows.select(F.struct(*item).alias('s')).schema['s'].dataType.simpleString()}>")

    def step(acc: Column, x: Column) -> Column:
        skip = (F.size(acc) >= top) | F.exists(acc, lambda k: F.abs(k["_at"] - x["_at"]) <= x["_gap"])
        return F.when(skip, acc).otherwise(F.array_append(acc, F.struct(*[x[c].alias(c) for c in item])))

    def walk():
        kept: list[dict] = []

        def take(values):
            row = dict(zip(["_neg", "_at", "_gap", *extra], values))
            t, width = row["_at"], row.pop("_gap")
            if t is None or not any(k["_at"] is not None and abs(k["_at"] - t) <= width for k in kept):
                kept.append(row)
            return kept, len(kept) < top

        return take

    state = ranked_fold(rows, keys, ["_neg", "_at"], ["_gap", *extra], empty, step, walk)
    picked = state.select(*keys, F.posexplode("state").alias("_rank", "_k"))
    return picked.select(
        *keys,
        (F.col("_rank") + 1).alias("rank"),
        F.col("_k._at").alias(at),
        (-F.col("_k._neg")).alias(score),
        *[F.col(f"_k.{c}").alias(c) for c in extra],
    )

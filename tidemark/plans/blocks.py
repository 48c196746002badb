"""Ordered windows whose tasks stay bounded however large one key is.

Every ordered operator starts with :func:`fit`.  It measures the largest key with one
map-side-combined count.  If each key fits one task the rows stay as they are and plain
``Window.partitionBy(keys)`` expressions run.  Otherwise the rows get a ``_blk`` column: consecutive
blocks in key order, each of bounded size.  :func:`scan` then works in two levels - running values
inside a block, and the running combination of the block totals - so no task ever sees a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import block_rows, cut

BLOCK = "_blk"


def is_blocked(df: DataFrame) -> bool:
    return BLOCK in df.columns


def unblock(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK)


def largest_key(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in all); only two numbers reach the driver."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


def position_bound(df: DataFrame, position: str) -> int:
    """Most rows a key can have, from its largest integer position: one number for a whole pipeline."""
    top = df.agg(F.max(position)).first()[0]
    return 0 if top is None else int(top) + 1


def fit(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: str | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Label rows with ``_blk`` when some key is too large for one task.

    ``bound`` is a known upper limit of rows per key (rows derived from a measured input); when it
    fits a task nothing is measured again.

    ``position`` names a non-negative integer column that is unique within a key (frame index, line
    number); blocks are then plain integer ranges.  Without it the rows are range-partitioned on
    (keys, order, row hash) - which also splits many rows at one instant - and the result is
    checkpointed because the range bounds come from a sample.
    """
    if is_blocked(df):
        return df
    limit = block_rows(df.sparkSession)
    if bound is not None and bound <= limit:
        return df
    if position is not None:
        if (position_bound(df, position) if bound is None else bound) <= limit:
            return df
        return df.withColumn(BLOCK, F.floor(F.col(position) / limit).cast("int"))
    largest, total = largest_key(df, keys)
    if largest <= limit:
        return df
    parts = max(2, -(-total // limit) * 2)
    hashed = df.withColumn("_tie", F.xxhash64(*[c for c in df.columns if not _is_map(df, c)]))
    ranged = hashed.repartitionByRange(parts, *keys, *order, "_tie").drop("_tie")
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id()))


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()


def window(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], reverse: bool = False):
    """Window spec over one key (or one block of it) in the given order."""
    part = [*keys, BLOCK] if is_blocked(df) else list(keys)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return Window.partitionBy(*part).orderBy(*[c.desc() if reverse else c.asc() for c in cols])


_TOTAL: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
}
_JOIN: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "max": F.greatest,
    "min": F.least,
    "last": lambda a, b: F.coalesce(b, a),
}


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    *,
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates from the start of each key (from its end with ``reverse``).

    ``values`` maps an output name to ``(kind, expression)`` with kind ``sum``, ``max``, ``min`` or
    ``last`` (latest non-null).  ``order`` must be total within a key.
    """
    frame = window(df, keys, order, reverse).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def local(kind: str, expr: Column) -> Column:
        return (F.last(expr, ignorenulls=True) if kind == "last" else _TOTAL[kind](expr)).over(frame)

    out = df.select("*", *[local(kind, e).alias(name) for name, (kind, e) in values.items()])
    if not is_blocked(df):
        return out

    place = F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    totals = df.groupBy(*keys, BLOCK).agg(
        *[
            (pick(F.when(e.isNotNull(), e), F.when(e.isNotNull(), place)) if kind == "last" else _TOTAL[kind](e))
            .alias(f"_t_{name}")
            for name, (kind, e) in values.items()
        ]
    )
    block = F.col(BLOCK)
    before = Window.partitionBy(*keys).orderBy(block.desc() if reverse else block.asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = totals.select(
        *keys,
        BLOCK,
        *[
            (F.last(f"_t_{name}", ignorenulls=True) if kind == "last" else _TOTAL[kind](F.col(f"_t_{name}")))
            .over(before)
            .alias(f"_c_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    joined = out.join(carry, [*keys, BLOCK], "left")
    kept = [c for c in out.columns if c not in values]
    merged = joined.select(
        *kept,
        *[_JOIN[kind](F.col(f"_c_{name}"), F.col(name)).alias(name) for name, (kind, _) in values.items()],
    )
    return cut(merged)


def shift(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    *,
    ahead: bool = False,
) -> DataFrame:
    """Value of the previous row (of the next one with ``ahead``) in key order."""
    if not is_blocked(df):
        move = F.lead if ahead else F.lag
        spec = window(df, keys, order)
        return df.select("*", *[move(e).over(spec).alias(name) for name, e in values.items()])
    packed = {"_shift": ("last", F.struct(*[e.alias(name) for name, e in values.items()]))}
    out = scan(df, keys, order, packed, reverse=ahead, inclusive=False)
    return out.select(*df.columns, *[F.col(f"_shift.{name}").alias(name) for name in values])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Dense 0-based position within a key."""
    if not is_blocked(df):
        return df.withColumn(name, (F.row_number().over(window(df, keys, order)) - 1).cast("long"))
    return scan(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Callable[[Mapping[str, Column]], Column],
    previous: Mapping[str, Column],
    name: str = "island",
) -> DataFrame:
    """Number maximal runs: a row opens a new one when ``starts`` holds or it has no predecessor.

    ``previous`` names expressions to read from the preceding row; ``starts`` gets them as columns.
    """
    probe = {f"_p_{k}": e for k, e in previous.items()}
    lagged = shift(df, keys, order, {**probe, "_p_any": F.lit(1)})
    opens = F.col("_p_any").isNull() | starts({k: F.col(f"_p_{k}") for k in previous})
    flagged = lagged.withColumn("_open", F.when(F.coalesce(opens, F.lit(False)), 1).otherwise(0).cast("long"))
    out = scan(flagged, keys, order, {name: ("sum", F.col("_open"))})
    return out.drop("_open", "_p_any", *probe)


def frame_windows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    before: int,
    after: int,
    values: Mapping[str, Callable[[object], Column]],
) -> DataFrame:
    """Fixed row frames over a dense integer position.

    ``values`` maps a name to a function from window spec (partitioned and ordered) to expression.
    In blocked data each block also receives the ``before``/``after`` rows around it, from as many blocks as
    they lie in, dropped afterwards.
    """
    if not is_blocked(df):
        spec = window(df, keys, [position])
        return df.select("*", *[f(spec).alias(n) for n, f in values.items()])
    size = block_rows(df.sparkSession)
    # a row serves every block whose frames reach it
    low = F.floor((F.col(position) - after) / size).cast("int")
    high = F.floor((F.col(position) + before) / size).cast("int")
    targets = F.sequence(F.greatest(low, F.lit(0)), high)
    spread = df.withColumn("_home", F.col(BLOCK)).withColumn(BLOCK, F.explode(targets))
    spec = window(spread, keys, [position])
    out = spread.select("*", *[f(spec).alias(n) for n, f in values.items()])
    return out.filter(F.col("_home") == F.col(BLOCK)).drop("_home")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    bound: int | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles per key with linear interpolation between neighbouring ranks.

    ``extra`` are plain aggregates to compute in the same pass.
    """
    present = df.select(*keys, value).filter(F.col(value).isNotNull())
    blocked = fit(present, keys, [value], bound=bound)
    if not is_blocked(blocked):
        # a sorted array of a key's values costs a fraction of the map of counts that ``percentile`` keeps
        held = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_s"), *extra)

        def between(p: float) -> Column:
            exact = (F.size("_s") - 1) * F.lit(p)
            low, high = F.floor(exact), F.ceil(exact)
            below, above = F.get("_s", low.cast("int")), F.get("_s", high.cast("int"))
            return F.when(low == high, below).otherwise((high - exact) * below + (exact - low) * above)

        picked = [F.when(F.size("_s") > 0, between(p)).alias(n) for n, p in wanted.items()]
        return held.select(*keys, *picked, *held.columns[len(keys) + 1 :])
    ranked = number_rows(blocked.withColumn("_tie", F.monotonically_increasing_id()), keys, [value, "_tie"], "_rank")
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("_n"))
    at = ranked.join(sizes, list(keys))

    def pick(p: float, low: bool) -> Column:
        exact = (F.col("_n") - 1) * F.lit(p)
        place = F.floor(exact) if low else F.ceil(exact)
        return F.max(F.when(F.col("_rank") == place, F.col(value)))

    picked = at.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[pick(p, True).alias(f"_lo_{n}") for n, p in wanted.items()],
        *[pick(p, False).alias(f"_hi_{n}") for n, p in wanted.items()],
    )

    def blend(name: str, p: float) -> Column:
        exact = (F.col("_n") - 1) * F.lit(p)
        share = exact - F.floor(exact)
        return F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * share

    out = picked.select(*keys, *[blend(n, p).alias(n) for n, p in wanted.items()])
    return out.join(df.groupBy(*keys).agg(*extra), list(keys)) if extra else out

"""Nearest and within-radius joins by sorted scans: no pair of rows is ever emitted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.plans.blocks import fit, scan, unblock


def _null(schema: StructType) -> Column:
    return F.lit(None).cast(schema)


def _whole(df: DataFrame, tie: str | None) -> Column:
    """A tie that can be negated: integers as exact decimals, other numbers as they are."""
    if tie is None:
        return F.lit(0)
    return F.col(tie).cast("decimal(20,0)") if df.schema[tie].dataType.simpleString() in _INTEGERS else F.col(tie).cast("double")


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _reversed(df: DataFrame, tie: Column) -> Column:
    kind = df.select(tie.alias("_tie")).schema["_tie"].dataType.simpleString()
    return -(tie.cast("decimal(20,0)") if kind in _INTEGERS else tie.cast("double"))


def _meet(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_first: bool
) -> DataFrame:
    """Union of both sides as (keys, _t, _side, _l, _r); at equal ``_t`` one side sorts first."""
    blank_r = _null(right.schema["_r"].dataType)
    blank_l = _null(left.schema["_l"].dataType)
    a = left.select(*keys, "_t", F.lit(0 if left_first else 1).alias("_side"), "_l", blank_r.alias("_r"))
    b = right.select(*keys, "_t", F.lit(1 if left_first else 0).alias("_side"), blank_l.alias("_l"), "_r")
    return a.unionByName(b)


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t_left: str,
    t_right: str,
    payload: Mapping[str, str],
    tie: str | None = None,
    coarse: bool = False,
) -> DataFrame:
    """Each left row with its nearest right row of the same key.

    Adds ``dist`` (absolute), ``delta`` (left minus right) and the ``payload`` columns
    (output name -> right column); all null when the key has no right row.  Equal distances take the
    earlier right row, equal right times the smallest ``tie``, compared in its own type.

    ``coarse`` is for times that many rows of a key share: the scan gets each (key, time) of either side once, and the left
    rows, which are then read twice, look their time up.
    """
    if coarse:
        at = F.col(t_left).cast("double")
        asked = left.select(*keys, at.alias("_at")).distinct()
        fewest = right.filter(F.col(t_right).isNotNull()).select(
            *keys, F.col(t_right).cast("double").alias("_on"),
            F.struct(_whole(right, tie).alias("_rank"), F.struct(*[F.col(c).alias(n) for n, c in payload.items()] or [F.lit(0).alias("_none")]).alias("_row")).alias("_r"),
        ).groupBy(*keys, "_on").agg(F.min("_r").alias("_r"))
        near = nearest(asked, fewest, keys, "_at", "_on", {"_r": "_r"})
        near = near.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_at").alias("_asked"), "dist", "delta", "_r")
        same = at.eqNullSafe(F.col("_asked"))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        found = left.join(near, same, "left")
        return found.select(*left.columns, "dist", "delta", *[F.col(f"_r._row.{n}").alias(n) for n in payload])
    rank = _whole(right, tie)
    carried = [F.col(c).alias(n) for n, c in payload.items()]
    cols = [c for c in left.columns]
    l_side = left.select(*keys, F.col(t_left).cast("double").alias("_t"), F.struct(*cols).alias("_l"))
    r_side = right.filter(F.col(t_right).isNotNull()).select(
        *keys,
        F.col(t_right).cast("double").alias("_t"),
        F.struct(F.col(t_right).cast("double").alias("_at"), rank.alias("_rank"), *carried).alias("_r"),
    )
    both = fit(_meet(l_side, r_side, keys, left_first=False), keys, ["_t", "_side"])
    order = ["_t", "_side"]
    r = F.col("_r")
    earlier = F.when(r.isNotNull(), F.struct(r["_at"].alias("_at"), (-r["_rank"]).alias("_neg"), r.alias("_row")))
    back = scan(both, keys, order, {"_b": ("max", earlier)})
    full = scan(back, keys, order, {"_f": ("min", r)}, reverse=True)
    before = F.col("_b._row")
    after = F.col("_f")
    t = F.col("_t")
    use_back = F.when(before.isNull(), False).otherwise(
        after.isNull() | (F.abs(t - before["_at"]) <= F.abs(t - after["_at"]))
    )
    hit = F.when(use_back, before).otherwise(after)
    found = full.filter(F.col("_l").isNotNull()).select("_l", t.alias("_t"), hit.alias("_hit"))
    return found.select(
        "_l.*",
        F.abs(F.col("_t") - F.col("_hit._at")).alias("dist"),
        (F.col("_t") - F.col("_hit._at")).alias("delta"),
        *[F.col(f"_hit.{n}").alias(n) for n in payload],
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t_left: str,
    t_right: str,
    payload: Mapping[str, str],
    slack: float = 0.0,
    tie: str | None = None,
) -> DataFrame:
    """Latest right row with ``t_right <= t_left + slack``; the largest ``tie`` wins at one instant."""
    rank = F.col(tie) if tie else F.lit(0)
    l_side = left.select(
        *keys, (F.col(t_left).cast("double") + F.lit(slack)).alias("_t"), F.struct(*left.columns).alias("_l")
    )
    r_side = right.select(
        *keys,
        F.col(t_right).cast("double").alias("_t"),
        F.struct(
            F.col(t_right).cast("double").alias("_at"), rank.alias("_rank"), *[F.col(c).alias(n) for n, c in payload.items()]
        ).alias("_r"),
    )
    both = fit(_meet(l_side, r_side, keys, left_first=False), keys, ["_t", "_side"])
    out = scan(both, keys, ["_t", "_side"], {"_hit": ("max", F.col("_r"))})
    return out.filter(F.col("_l").isNotNull()).select("_l.*", *[F.col(f"_hit.{n}").alias(n) for n in payload])


_TICKS = 1_000_000


def _tick(t: Column) -> Column:
    return F.round(t * F.lit(float(_TICKS))).cast("long")


def window_best(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t_left: str,
    t_right: str,
    radius: float,
    score: Column,
    tie: Column,
    payload: Mapping[str, Column],
) -> DataFrame:
    """Each left row with the best right row at most ``radius`` away (microsecond resolution).

    The best row has the largest ``score``, then the smallest ``tie``.  An interval of length
    ``2*radius`` meets two consecutive buckets of that length: it is a suffix of the first and a
    prefix of the second, so one running maximum from each end answers every left row.
    Adds ``best_score`` and the ``payload`` columns, null when nothing is near.
    """
    reach = int(round(radius * _TICKS))
    width = 2 * reach
    r_side = right.select(
        *keys,
        _tick(F.col(t_right)).alias("_t"),
        F.struct(
            score.cast("double").alias("_s"), _reversed(right, tie).alias("_n"), *[e.alias(n) for n, e in payload.items()]
        ).alias("_r"),
    )
    r_type = r_side.schema["_r"].dataType
    probe = left.select(*keys, _tick(F.col(t_left)).alias("_c"), F.struct(*left.columns).alias("_l")).withColumn(
        "_found", F.lit(None).cast(r_type)
    )
    bucketed = [*keys, "_bucket"]

    def sweep(rows: DataFrame, offset: int, suffix: bool) -> DataFrame:
        packed = rows.select(
            *keys, (F.col("_c") + F.lit(offset)).alias("_t"), F.struct("_c", "_l", "_found").alias("_l")
        )
        both = _meet(packed, r_side, keys, left_first=suffix).withColumn(
            "_bucket", F.floor(F.col("_t") / F.lit(width)).cast("long")
        )
        both = fit(both, bucketed, ["_t", "_side"])
        out = scan(both, bucketed, ["_t", "_side"], {"_m": ("max", F.col("_r"))}, reverse=suffix)
        return unblock(out).filter(F.col("_l").isNotNull()).select(
            *keys,
            F.col("_l._c").alias("_c"),
            F.col("_l._l").alias("_l"),
            F.greatest(F.col("_l._found"), F.col("_m")).alias("_found"),
        )

    found = sweep(sweep(probe, -reach, suffix=True), reach, suffix=False)
    return found.select(
        "_l.*", F.col("_found._s").alias("best_score"), *[F.col(f"_found.{n}").alias(n) for n in payload]
    )


def count_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], t_left: str, t_right: str, radius: float, name: str
) -> DataFrame:
    """How many right rows lie at most ``radius`` from each left row (microsecond resolution).

    The difference of two running counts: up to the right end, and before the left end.
    """
    reach = int(round(radius * _TICKS))
    r_side = right.select(*keys, _tick(F.col(t_right)).alias("_t"), F.lit(1).alias("_r"))
    r_side = r_side.select(*keys, "_t", F.struct("_r").alias("_r"))
    rows = left.select(*keys, _tick(F.col(t_left)).alias("_c"), F.struct(*left.columns).alias("_l"), F.lit(0).cast("long").alias("_n"))

    def sweep(rows: DataFrame, offset: int, before: bool) -> DataFrame:
        packed = rows.select(*keys, (F.col("_c") + F.lit(offset)).alias("_t"), F.struct("_c", "_l", "_n").alias("_l"))
        both = fit(_meet(packed, r_side, keys, left_first=before), keys, ["_t", "_side"])
        one = F.when(F.col("_r").isNotNull(), 1).otherwise(0).cast("long")
        out = unblock(scan(both, keys, ["_t", "_side"], {"_m": ("sum", one)})).filter(F.col("_l").isNotNull())
        seen = F.col("_m") if not before else -F.col("_m")
        return out.select(*keys, F.col("_l._c").alias("_c"), F.col("_l._l").alias("_l"), (F.col("_l._n") + seen).alias("_n"))

    found = sweep(sweep(rows, -reach, before=True), reach, before=False)
    return found.select("_l.*", F.col("_n").alias(name))

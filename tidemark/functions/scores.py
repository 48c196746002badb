"""Scores, bands, weights and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Band edges, mean and deviation of the three parts of the hand-made score, and the
# limits of a converted file's rates.
BANDS_SCORE = (2.5, 1.5)
BANDS_PROBABILITY = (0.6, 0.3)
FORMULA_NORM = {"signature": (-0.250, 7.702), "recover": (1.173, 0.889), "txt": (0.280, 0.694)}
TEXT_WEIGHT = 0.5
LOSSY_RATE, LOSSY_NOMINAL, CAPPED_TO = 24000, 160, 160
LOSSLESS = ["wav", "flac", "alac", "ape", "aiff", "pcm_s16le", "pcm_s24le"]


def band(value: Column, edges: tuple[float, float]) -> Column:
    return F.when(value >= edges[0], "high").when(value >= edges[1], "mid").otherwise("low")


def formula_score(signature: Column, recover: Column, txt: Column) -> Column:
    """Standardised signature minus standardised recover plus half the standardised text score."""
    z = {n: (c - F.lit(FORMULA_NORM[n][0])) / F.lit(FORMULA_NORM[n][1]) for n, c in
         {"signature": signature, "recover": recover, "txt": txt}.items()}
    return z["signature"] - z["recover"] + F.lit(TEXT_WEIGHT) * z["txt"]


def finite_or_zero(value: Column) -> Column:
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def distance_weight(distance: Column, positive: Column, sigma: float) -> Column:
    """Training weight: fades with a positive's distance; 1 for negatives and unknown distances."""
    return F.when(positive & distance.isNotNull(), F.exp(-F.pow(distance / sigma, 2))).otherwise(F.lit(1.0))


def soft_target(distance: Column, sigma: float) -> Column:
    return F.coalesce(F.exp(-F.pow(distance / sigma, 2)), F.lit(0.0))


def hard_label(distance: Column, tolerance: float) -> Column:
    return F.coalesce(distance <= tolerance, F.lit(False)).cast("int")


def conversion_flags(rows: DataFrame) -> DataFrame:
    """Ratio, notes and the flags read from them, for rows of converted files."""
    resampled = F.concat(F.lit("resampled:"), F.col("in_rate").cast("string"), F.lit("->"), F.col("out_rate").cast("string"))
    capped = F.concat(F.lit("capped:"), F.col("nominal").cast("string"), F.lit(f"->{CAPPED_TO}"))
    known = (F.col("in_rate") > 0) & (F.col("out_rate") > 0)
    note = F.when(known & (F.col("out_rate") != F.col("in_rate")), resampled).when(
        known & (F.col("out_rate") <= LOSSY_RATE) & (F.col("nominal") > LOSSY_NOMINAL), capped
    )
    ratio = F.when(F.col("dst_bytes") > 0, F.col("src_bytes") / F.col("dst_bytes")).otherwise(F.lit(0.0))
    out = rows.withColumn("ratio", ratio).withColumn("notes", F.when(note.isNull(), F.array().cast("array<string>")).otherwise(F.array(note)))
    has = lambda word: F.exists("notes", lambda n: n.startswith(word))
    return out.withColumn("resampled", has("resampled")).withColumn("capped", has("capped")).withColumn(
        "lossless", F.lower("codec").isin(*LOSSLESS)
    )


def blend_scores(rows: DataFrame, fold: str, a: str, b: str, alpha: float, out: str = "blended") -> DataFrame:
    """Min-max normalise two scores within a fold and mix them ``alpha : 1 - alpha``."""
    limits = rows.groupBy(fold).agg(
        *[f(c).alias(f"_{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    norm = lambda c: (F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.lit(1e-9), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    mixed = rows.join(limits, fold).withColumn(out, F.lit(alpha) * norm(a) + F.lit(1 - alpha) * norm(b))
    return mixed.select(*rows.columns, out)

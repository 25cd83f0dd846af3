"""Vector and signature expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colophon.functions.text import bind

# Fixed values of the score scale.
DEFAULT_BASELINE = 0.5
HIGH_PERCENT, MID_PERCENT = 70.0, 45.0
BASELINE_CAP, SCALE_CAP = 0.9, 0.95
SIGNATURE_BITS = 64
SAME_COVER_DISTANCE, STEADY_DISTANCE = 8, 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2_normalize(c: Column) -> Column:
    """Unit vector in double precision; a vector without length is returned unchanged."""
    scaled = lambda norm: F.transform(c, lambda x: F.when(norm < 1e-12, x.cast("double")).otherwise(x.cast("double") / norm))
    return bind(F.sqrt(dot(c, c)), scaled)


def score_percent(cosine: Column, baseline: Column) -> Column:
    """Cosine on a 0..100 scale whose zero is the catalogue's own baseline."""
    base = F.least(F.greatest(baseline, F.lit(0.0)), F.lit(SCALE_CAP))
    share = (cosine - base) / (1 - base)
    return 100 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def match_level(percent: Column) -> Column:
    return F.when(percent >= HIGH_PERCENT, "HIGH").when(percent >= MID_PERCENT, "MID").otherwise("LOW")


def median_signature(coeffs: Column) -> Column:
    """64 coefficients as a bit set: bit i tells whether coefficient i exceeds the median of 1..63."""
    median = F.array_sort(F.slice(coeffs, 2, SIGNATURE_BITS - 1))[31]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    powers = lambda m: F.transform(coeffs, lambda x, i: F.when(x > m, F.call_function("shiftleft", one, i)).otherwise(zero))
    return F.aggregate(bind(median, powers), zero, lambda acc, v: acc.bitwiseOR(v))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

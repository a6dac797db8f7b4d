"""Expressions over pixel values. Nodata is null everywhere; sentinels and NaN are turned into null at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale of stored vegetation indices, their least valid value, the quality bits and the value that means unusable; fixed values of the product.
SCALE, LEAST, QA_BITS, QA_BAD = 0.0001, -0.2, 3, 3


def to_null(value: Column, nodata: float | None = None, tolerance: float = 1e-8) -> Column:
    """Null for NaN, infinities and values within tolerance of ``nodata``."""
    good = ~F.isnan(value) & (F.abs(value) < float("inf"))
    if nodata is not None:
        good = good & ~(F.abs(value - nodata) <= tolerance + 1e-5 * abs(nodata))
    return F.when(good, value)


def quality(qa: Column) -> Column:
    return qa.bitwiseAND(F.lit(QA_BITS))


def vegetation_index(raw: Column, qa: Column) -> Column:
    """Scaled index; null where quality is unusable or the value is below the valid range."""
    v = raw.cast("double") * SCALE
    return F.when((quality(qa) != QA_BAD) & (v >= LEAST), v)


def normalised_difference(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def token_date(token: Column) -> Column:
    """Date of an ``AYYYYDDD`` token."""
    return F.to_date(F.substr(token, F.lit(2)), "yyyyDDD")


def season(month: Column) -> Column:
    """dry: February to May, monsoon: June to September, winter: October to January."""
    return F.when(month.between(2, 5), "dry").when(month.between(6, 9), "monsoon").when(month.isin(10, 11, 12, 1), "winter")


def clip(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounds that keep null (greatest and least alone would skip it)."""
    lit = lambda b: b if isinstance(b, Column) else F.lit(b)
    out = value
    if low is not None:
        out = F.greatest(out, lit(low))
    if high is not None:
        out = F.least(out, lit(high))
    return F.when(value.isNotNull(), out)


def guarded_divide(a: Column, b: Column, where: Column, default: float = 0.0) -> Column:
    return F.when(where, a / b).otherwise(F.lit(default))


def terrain_confidence(elevation: Column, coast_km: Column) -> Column:
    """LOW below sea level or at the shore, MEDIUM above 500 m, else HIGH (also if unknown)."""
    low = F.coalesce(elevation < 0, F.lit(False)) | F.coalesce(coast_km < 0.1, F.lit(False))
    return F.when(low, "LOW").when(F.coalesce(elevation > 500, F.lit(False)), "MEDIUM").otherwise("HIGH")


def flag(condition: Column) -> Column:
    """1 or 0; 0 if unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def coverage_status(valid: Column, total: Column) -> Column:
    """Status of a mosaic by its valid pixels. Below 500 of at least 99.9 % missing is expected (open sea); none at all otherwise is a failure.

    SKIPPED_VERY_LOW is a status of usable mosaics all the same; :data:`USABLE` holds those that count.
    """
    missing = 100.0 - valid / total * 100
    return (
        F.when((missing >= 99.9) & (valid < 500), "EXPECTED_EMPTY").when(valid == 0, "FAIL")
        .when(valid < 10_000, "SKIPPED_VERY_LOW").when(valid < 50_000, "LOW_COVERAGE_USED").when(valid < 100_000, "MEDIUM_COVERAGE").otherwise("HIGH_COVERAGE")
    )


USABLE = ("HIGH_COVERAGE", "MEDIUM_COVERAGE", "LOW_COVERAGE_USED", "SKIPPED_VERY_LOW")


def failure_category(message: Column, from_validation: Column) -> Column:
    """Category of a failed tile by its error text."""
    low = F.lower(message)
    return F.when(from_validation, "GIS_FAILURE").when(low.rlike("tiff|fillemptytiles"), "WARP_FAILURE").when(low.contains("memory"), "RESOURCE_FAILURE").otherwise("READ_FAILURE")


def in_range(value: Column, low: float, high: float) -> Column:
    """Whether a value is within its valid range; false if it is missing."""
    return F.coalesce(value.between(low, high), F.lit(False))

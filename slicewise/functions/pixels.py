"""Pixel columns: calibration, windows, plausibility and tissue masks.

Pixel blocks are row-major arrays. The expressions here are right for small
blocks and for SQL; :mod:`slicewise.operators.imaging` has the Arrow versions
for full-size slices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slicewise import constants as K


def encode(v: Column, low: float, high: float) -> Column:
    """One HU value -> [0, 1] inside a window."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.lit(low)) / F.lit(high - low)))


def window(hu: Column, low: float, high: float) -> Column:
    return F.transform(hu, lambda v: encode(v, low, high))


def stored_to_hu(values: Column) -> Column:
    """Undo the stored encoding."""
    return F.transform(values, lambda v: v * F.lit(K.STORED_RANGE) - F.lit(K.STORED_OFFSET))


def minmax(hu: Column) -> Column:
    """Scale a block by its own range; null when the range is below one HU."""
    low, high = F.array_min(hu), F.array_max(hu)
    scaled = F.transform(hu, lambda v: (v - low) / (high - low))
    return F.when(high - low >= 1.0, scaled)


def to_hu(pixels: Column, pixel_type: Column, slope: Column, intercept: Column) -> Column:
    """Raw pixels -> HU.

    With a slope or an intercept: linear (defaults 1 and 0). Without: float
    pixels are HU already, uint16 carries an offset of 1024, the rest is kept.
    """
    tagged = slope.isNotNull() | intercept.isNotNull()
    factor = F.when(tagged, F.coalesce(slope, F.lit(1.0))).otherwise(F.lit(1.0))
    shift = (F.when(tagged, F.coalesce(intercept, F.lit(0.0)))
             .when(pixel_type == "uint16", F.lit(-1024.0))
             .otherwise(F.lit(0.0)))
    return F.transform(pixels, lambda v: v * factor + shift)


def reject_rule(hu: Column, bits: Column, h: Column, w: Column) -> Column:
    """The first plausibility rule a block breaks, null when it breaks none."""
    low, high = F.array_min(hu), F.array_max(hu)
    return (F.when(bits.isNull() | ~bits.isin(*K.SUPPORTED_BITS), "unsupported_bits")
            .when(hu.isNull() | h.isNull() | w.isNull() | (F.size(hu) != h * w), "not_two_dimensional")
            .when(low > 200, "all_above_200")
            .when((low >= 0) & (high <= 400), "unconverted_range")
            .when((high > 4096) & (low >= 0), "intercept_not_applied")
            .when(high < 0, "no_tissue"))


def mask_count(hu: Column, low: float, high: float) -> Column:
    """How many values fall into [low, high]."""
    return F.size(F.filter(hu, lambda v: (v >= low) & (v <= high)))


def mask_share(hu: Column, low: float, high: float) -> Column:
    return F.try_divide(mask_count(hu, low, high), F.size(hu))

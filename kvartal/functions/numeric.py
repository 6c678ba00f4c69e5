"""Small numeric expressions and formatters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by a rational approximation of the error function (error below 1.5e-7)."""
    # Coefficients of the public approximation (Abramowitz and Stegun 7.1.26).
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` within bounds; NULL stays NULL."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.isNotNull(), F.greatest(as_col(low), F.least(as_col(high), x)))


def finite(x: Column) -> Column:
    """True for numbers that are neither NULL, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def null_unless_finite(x: Column) -> Column:
    return F.when(finite(x), x)


def signed_percent(x: Column) -> Column:
    return F.format_string("%+.1f%%", x)


def price_label(x: Column) -> Column:
    return F.concat(F.format_number(x, 0), F.lit(" AZN/m²"))


def probability_label(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def width_label(x: Column) -> Column:
    return F.concat(F.lit("±"), F.format_number(x / 2, 0), F.lit(" AZN/m²"))


def price_position(price: Column, low: Column, high: Column, middle: Column) -> Column:
    """Where a price lies in its cell's band."""
    known = low.isNotNull() & high.isNotNull() & (price > 0)
    mid = F.coalesce(F.when(middle != 0, middle), (low + high) / 2)
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(price < low, "underpriced").when(price > high, "overpriced").when(price < mid, "below average").otherwise("above average")


def price_percentile(price: Column, low: Column, high: Column) -> Column:
    """Place in the band from 0 to 100; 50 where there is none."""
    known = F.coalesce(low.isNotNull() & high.isNotNull() & (price > 0) & (low != high), F.lit(False))
    return F.when(known, clip((price - low) / (high - low) * 100, 0, 100)).otherwise(50.0)

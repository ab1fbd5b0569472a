"""Scalar expressions: guarded logarithms, normal distribution, calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal tail (Hart 1968, as given by West 2005).
NORMAL_NUMERATOR = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_DENOMINATOR = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
NORMAL_SPLIT, ROOT_TWO_PI = 7.07106781186547, 2.506628274631


def positive_ln(x: Column) -> Column:
    """Natural logarithm; null where ``x`` is not positive (no infinities reach a window)."""
    return F.when(x > 0, F.ln(x))


def floored_ln_abs(x: Column, floor: float = 1e-6) -> Column:
    return F.ln(F.abs(x) + floor)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_sf(x: Column) -> Column:
    """1 - Phi(x), native; about 1e-16 from exact."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    b = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    tail = F.when(a < NORMAL_SPLIT, e * _horner(a, NORMAL_NUMERATOR) / _horner(a, NORMAL_DENOMINATOR)).otherwise(e / (b * ROOT_TWO_PI))
    return F.when(x > 0, tail).otherwise(1 - tail)


def norm_cdf(x: Column) -> Column:
    return norm_sf(-x)


def weekday_dummy(d: Column, k: int) -> Column:
    """1.0 on weekday ``k`` (Monday 0), else 0.0."""
    return (F.weekday(d) == k).cast("double")


def reaction_day(ts: Column) -> Column:
    """Calendar day on which an announcement can move prices: from 16:00 the next one."""
    return F.date_add(F.to_date(ts), F.when(F.hour(ts) >= 16, 1).otherwise(0))


def announced(raw: Column) -> Column:
    """Local wall time of ``YYYY-MM-DD HH:MM:SS±HH:MM``: the offset is dropped, not applied."""
    return F.to_timestamp_ntz(F.substring(raw, 1, 19))


def new_york(ts_utc: Column) -> Column:
    """UTC wall time (timestamp_ntz) to New York wall time, with daylight saving."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts_utc)

"""Bands, and ratios that refuse rather than report zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: code: (better direction, healthy bound, slop bound)
THRESHOLDS = {
    "L1.1": ("higher", 10, 1), "L1.2": ("lower", 70, 85), "L1.3": ("higher", 12, 3), "L1.4": ("higher", 25, 5), "L1.5": ("higher", 60, 30),
    "L1.6": ("higher", 15, 5), "L1.7": ("higher", 20, 5), "L1.8": ("higher", 0.4, 0.1), "L1.10": ("higher", 5, 1), "L1.12": ("lower", 1, 5),
    "L1.13": ("lower", 3, 10), "L1.15": ("lower", 1, 5), "L1.16": ("lower", 0.5, 3), "L1.17": ("lower", 0.5, 2), "L1.18": ("lower", 15, 40),
}


def band(value: Column, healthy: float, slop: float, higher: bool) -> Column:
    """Healthy, Not Healthy or Slop of an unrounded value; n/a of none."""
    good, bad = (value >= healthy, value >= slop) if higher else (value < healthy, value < slop)
    return F.when(value.isNull(), "n/a").when(good, "Healthy").when(bad, "Not Healthy").otherwise("Slop")


def band_of(code: str, value: Column) -> Column:
    way, healthy, slop = THRESHOLDS[code]
    return band(value, healthy, slop, way == "higher")


def band_sql(value: str, healthy: float, slop: float, higher: bool) -> str:
    op = ">=" if higher else "<"
    return f"CASE WHEN {value} IS NULL THEN 'n/a' WHEN {value} {op} {healthy} THEN 'Healthy' WHEN {value} {op} {slop} THEN 'Not Healthy' ELSE 'Slop' END"


def band_of_sql(code: str, value: str) -> str:
    way, healthy, slop = THRESHOLDS[code]
    return band_sql(value, healthy, slop, way == "higher")


def guarded(numerator: Column, denominator: Column, scale: float = 100.0) -> Column:
    """The ratio times `scale`; NULL where there is nothing to divide by."""
    return F.when(denominator > 0, F.try_divide(numerator.cast("double"), denominator.cast("double")) * scale)


def coverage_band(value: Column) -> Column:
    """Strict at the top, unlike `band`."""
    return F.when(value.isNull(), "n/a").when(value > 90, "Healthy").when(value >= 60, "Not Healthy").otherwise("Slop")


def tally_band(passed: Column, runs: Column) -> Column:
    """All runs passed, all but one, or fewer."""
    return F.when(passed == runs, "Healthy").when(passed == runs - 1, "Not Healthy").otherwise("Slop")

"""Throughput and ratio columns, and the memory-counter log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bandwidth_gib_s(size_bytes: Column, millis: Column) -> Column:
    return size_bytes.cast("double") * F.lit(1000.0) / (F.lit(float(1 << 30)) * millis.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0."""
    return F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def per_unit(amount: Column, units: Column) -> Column:
    """amount / units, such as cycles an instruction; null where units is 0."""
    return amount.cast("double") / F.nullif(units.cast("double"), F.lit(0.0))


def mean_of(ratio: Column) -> Column:
    """The mean of ratios that are there, an aggregate; each counts once, whatever it was taken over."""
    return F.avg(ratio)


def clean_double(text: Column) -> Column:
    """Number from text padded with spaces, tabs or no-break spaces; null where it isn't one."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "").try_cast("double")


def millisecond_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")

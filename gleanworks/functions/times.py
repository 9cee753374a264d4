"""Instants, durations, retention arithmetic and backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks import fixed


def as_naive(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, independent of the session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), as_naive(ts))


def duration_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", as_naive(start), as_naive(end))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stamp(ts: Column) -> Column:
    """Second-precision text, the form used in result tables."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def date_path(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def plus_days(ts: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days, ts)


def age_days(ts: Column, now: Column) -> Column:
    return F.timestamp_diff("DAY", as_naive(ts), as_naive(now))


def parse_duration_seconds(literal: Column) -> Column:
    """``300s``, ``15m``, ``2h``, ``90d`` or ``7y`` as seconds; anything else is null."""
    amount = F.regexp_extract(literal, r"^(\d+)[smhdy]$", 1).try_cast("bigint")
    unit = F.regexp_extract(literal, r"^\d+([smhdy])$", 1)
    scale = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600)
        .when(unit == "d", 86400).when(unit == "y", 365 * 86400)
    )
    return amount * scale


def compliance_retention_days(policy: Column) -> Column:
    return F.when(policy == "compliance", fixed.ARCHIVE_DAYS).otherwise(fixed.STANDARD_DAYS)


def retention_literal(long_term: Column) -> Column:
    return F.when(long_term, fixed.RETENTION_LITERALS["regulatory"]).otherwise(
        fixed.RETENTION_LITERALS["default"]
    )


def backoff_ms(attempt: Column, base: float, factor: float, ceiling: float) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt - 1), F.lit(float(ceiling)))


def eta_seconds(elapsed: Column, progress: Column) -> Column:
    return F.try_divide(elapsed, progress) * (100 - progress)


def progress_stage(progress: Column) -> Column:
    return F.when(progress < 20, "PREPROCESSING").when(progress < 90, "RECOGNITION").otherwise("POSTPROCESSING")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))

"""Row selection: filter maps, ranges, tags, search, clearance and status gates."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks import fixed


def equals_all(conditions: dict) -> Column:
    """Every named column equals its value; no conditions keeps all rows."""
    return reduce(and_, (F.col(name) == value for name, value in conditions.items()), F.lit(True))


def matches(filters: dict | str) -> Column:
    """Scalars test equality, lists test membership. Accepts a dict or its JSON text."""
    chosen = json.loads(filters) if isinstance(filters, str) else filters
    if not isinstance(chosen, dict):
        raise ValueError("filters must be an object")
    tests = [
        F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value
        for name, value in chosen.items()
    ]
    return reduce(and_, tests, F.lit(True))


def parse_classifications(levels: str | list[str] | None) -> list[str]:
    names = levels.split(",") if isinstance(levels, str) else list(levels or ["PUBLIC"])
    names = [name.strip().upper() for name in names]
    unknown = [name for name in names if name not in fixed.CLASSIFICATIONS]
    if unknown:
        raise ValueError(f"unknown classification: {', '.join(unknown)}")
    return names


def in_classifications(column: Column, levels: str | list[str] | None = None) -> Column:
    return column.isin(*parse_classifications(levels))


def clearance_rank(level: Column) -> Column:
    """0 for the most open level upwards; unknown levels are null, so they never pass."""
    rank = F.lit(None).cast("int")
    for position, name in enumerate(fixed.CLASSIFICATIONS):
        rank = F.when(level == name, position).otherwise(rank)
    return rank


def cleared_for(record_level: Column, caller_level: Column) -> Column:
    return F.coalesce(clearance_rank(record_level) <= clearance_rank(caller_level), F.lit(False))


def between_dates(ts: Column, start: str, end: str) -> Column:
    if start > end:
        raise ValueError("start date must not be after end date")
    return ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def within_days(ts: Column, day: Column, start: str, end: str) -> Column:
    """Range test that also restricts the date partition column, so partitions are pruned."""
    return between_dates(ts, start, end) & day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def any_tag(tags: Column, wanted: list[str]) -> Column:
    if len(wanted) > fixed.MAX_TAGS:
        raise ValueError(f"at most {fixed.MAX_TAGS} tags")
    return F.arrays_overlap(tags, F.array(*[F.lit(tag) for tag in wanted]))


def text_search(column: Column, term: str) -> Column:
    if len(term) > fixed.MAX_SEARCH_LENGTH or not re.match(fixed.SEARCH_TEXT, term):
        raise ValueError("search term is too long or has characters outside the allowed set")
    return F.contains(F.lower(column), F.lit(term.lower()))


def metric_points(df: DataFrame, name: str, start: str, end: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Points of one metric in a time range whose labels have the given values."""
    chosen = df.where((F.col("name") == name) & between_dates(F.col("timestamp"), start, end))
    for key, value in (labels or {}).items():
        chosen = chosen.where(F.col("labels")[key] == value)
    return chosen


def without_metadata(df: DataFrame, include: bool) -> DataFrame:
    return df if include else df.drop("metadata")


def is_audited(method: Column, path: Column) -> Column:
    named = reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in fixed.AUDITED_PATHS))
    return method.isin(*fixed.AUDITED_METHODS) | named


def log_level(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def is_retryable(code: Column, kind: Column) -> Column:
    return code.isin(*fixed.RETRYABLE_CODES) | kind.isin(*fixed.RETRYABLE_TYPES)


def is_critical(kind: Column) -> Column:
    return kind.isin(*fixed.CRITICAL_TYPES)


def has_results(status: Column) -> Column:
    return status == "COMPLETED"


def can_stop(status: Column) -> Column:
    return ~status.isin("COMPLETED", "FAILED")

"""String expressions: white space, word and sentence counts, context windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks import fixed


def collapse_space(text: Column) -> Column:
    """Drop zero-width characters, turn each run of white space into one blank, trim."""
    visible = F.regexp_replace(text, fixed.ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(visible, f"[{fixed.SPACE_CLASS}]+", " "))


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def strip_empty_elements(html: Column) -> Column:
    """Remove attribute-free elements with nothing but blanks inside."""
    return F.regexp_replace(html, r"<([^>]+)>\s*</\1>", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{fixed.SPACE_CLASS}]+"), "")


def sentences(text: Column) -> Column:
    return F.array_remove(F.split(text, "[.!?]+"), "")


def lines(text: Column) -> Column:
    return F.array_remove(F.split(text, "\n"), "")



def item_count(text: Column) -> Column:
    """Pieces between white-space runs, counting empty ones at either end."""
    return F.size(F.split(text, f"[{fixed.SPACE_CLASS}]+"))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def context_window(text: Column, start: Column, end: Column, around: int = fixed.CONTEXT_CHARS) -> Column:
    """The span ``[start, end)`` (0-based) with up to ``around`` characters on each side."""
    first = F.greatest(start - around, F.lit(0))
    last = F.least(F.length(text), end + around)
    return F.substring(text, first + 1, last - first)


def contains_any(text: Column, keywords: list[str]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(lowered, F.lit(keyword))
    return found


def display_status(status: Column) -> Column:
    return F.initcap(F.lower(status))


def blank_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def ascii_edges(pattern: str) -> str:
    r"""The pattern with ``\b`` spelled out for ASCII words, as ECMAScript and RE2 read it.

    Java's own ``\b`` also counts accented letters as word characters in some releases.
    """
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def chunks(text: Column, size: int = fixed.CHUNK_SIZE) -> Column:
    """The text cut into consecutive pieces of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda at: F.substring(text, at + 1, F.lit(size)))

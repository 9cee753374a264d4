"""Quality and confidence formulas on one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions import text as tx


def text_completeness(text: Column) -> Column:
    """Words per sentence against twenty, capped at one; empty or null text scores zero."""
    words = F.coalesce(F.size(tx.words(text)).cast("double"), F.lit(0.0))
    full = F.size(tx.sentences(text)) * float(fixed.WORDS_PER_SENTENCE)
    # Without any sentence the ratio of a text with words is unbounded, that is, one.
    return F.least(words / F.greatest(full, F.lit(0.5)), F.lit(1.0))


def text_consistency(text: Column) -> Column:
    """One minus the coefficient of variation of the line lengths, floored at zero."""
    sizes = F.transform(tx.lines(text), F.length)
    moments = F.aggregate(
        sizes,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda acc, size: F.struct(
            (acc["n"] + 1.0).alias("n"),
            (acc["s"] + size).alias("s"),
            (acc["q"] + size.cast("double") * size).alias("q"),
        ),
        lambda acc: F.when(acc["n"] <= 1.0, 1.0).otherwise(
            F.greatest(
                F.lit(0.0),
                1.0 - F.sqrt(F.greatest(acc["n"] * acc["q"] - acc["s"] * acc["s"], F.lit(0.0))) / acc["s"],
            )
        ),
    )
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(moments)


def rule_accuracy(rules: dict[str, Column]) -> Column:
    """Share of the rules that a row keeps; a rule that cannot be decided is not kept. Without rules it is 1."""
    if not rules:
        return F.lit(1.0)
    kept = [F.coalesce(rule, F.lit(False)).cast("int") for rule in rules.values()]
    return reduce(lambda a, b: a + b, kept) / F.lit(float(len(kept)))


def freshness(at: Column, now: Column, minutes: int = fixed.MAX_TIMELINESS_MINUTES) -> Column:
    """1 for what is no older than ``minutes``, then that limit's share of the age; 0 without a time."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    limit = F.lit(minutes * 60_000_000.0)
    return F.coalesce(F.when(age <= limit, 1.0).otherwise(limit / age), F.lit(0.0))


def quality_average(*metrics: Column) -> Column:
    """Mean of metrics on the 0-1 scale, as a percentage rounded before any comparison."""
    total = metrics[0]
    for metric in metrics[1:]:
        total = total + metric
    return F.round(total / len(metrics) * 100, 6)


def quality_status(average: Column) -> Column:
    return (
        F.when(average >= fixed.VALID_SCORE, "VALID")
        .when(average >= fixed.PARTIAL_SCORE, "PARTIAL")
        .otherwise("INVALID")
    )


def field_completeness(present: list[Column]) -> Column:
    """Share of the given fields that are neither null nor empty; no fields counts as whole."""
    if not present:
        return F.lit(1.0)
    hits = sum((F.when(F.length(field) > 0, 1).otherwise(0) for field in present), F.lit(0))
    return hits / F.lit(float(len(present)))


def combined_confidence(entities: Column, categories: Column) -> Column:
    """Mean of the two mean confidences; a side with no members counts as zero."""
    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.coalesce(F.try_divide(total, F.size(values).cast("double")), F.lit(0.0))

    return (mean(entities) + mean(categories)) / 2


def entity_confidence(entity: Column, base: float | Column = fixed.DEFAULT_ENTITY_CONFIDENCE) -> Column:
    score = base if isinstance(base, Column) else F.lit(base)
    return score * F.least(F.length(entity) / F.lit(float(fixed.FULL_CONFIDENCE_LENGTH)), F.lit(1.0))


def unit_confidence(value: Column) -> Column:
    """Confidence on the 0-1 scale, whichever scale it came in."""
    return F.when(value > 1, value / 100).otherwise(value)


def items_progress(items: Column) -> Column:
    return F.least(F.round(100.0 * items / (items + 1)), F.lit(100.0)).cast("bigint")


def status_progress(status: Column) -> Column:
    progress = F.lit(0)
    for name, weight in fixed.PROGRESS_BY_STATUS.items():
        progress = F.when(status == name, weight).otherwise(progress)
    return progress

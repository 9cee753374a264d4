"""Alert conditions over aligned windows: thresholds, durations, suppression, incidents.

Inputs are already one row per series and window, so the windows partitioned by
series below are bounded by the number of windows, not by the number of points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions.times import epoch_seconds
from gleanworks.operators import ordered, percentiles
from gleanworks.operators.joins import rule_table
from gleanworks.sources import tables


def breaches(value: Column, comparison: str, threshold: float) -> Column:
    if comparison == "GT":
        return value > threshold
    if comparison == "LT":
        return value < threshold
    raise ValueError(f"unknown comparison {comparison!r}")


def breach_runs(windows: DataFrame, series: list[str], breach: Column, seconds: int) -> DataFrame:
    """Breaching windows with their position in an unbroken run of consecutive windows."""
    index = F.floor(epoch_seconds(F.col("window_start")) / seconds)
    by_series = Window.partitionBy(*series).orderBy("window_start")
    in_run = Window.partitionBy(*series, "_run").orderBy("window_start")
    return (
        windows.where(breach)
        .withColumn("_run", index - F.row_number().over(by_series))
        .withColumn("run_position", F.row_number().over(in_run))
        .drop("_run")
    )


def sustained(windows: DataFrame, series: list[str], breach: Column, seconds: int, duration: int) -> DataFrame:
    """The window at which a breach has lasted for the whole duration; one row per run."""
    needed = max(1, -(-duration // seconds))
    runs = breach_runs(windows, series, breach, seconds)
    return runs.where(F.col("run_position") == needed).drop("run_position")


def incidents(breaching: DataFrame, series: list[str], auto_close: int) -> DataFrame:
    """Merge breaching windows less than ``auto_close`` seconds apart into incidents."""
    by_series = Window.partitionBy(*series).orderBy("window_start")
    at = epoch_seconds(F.col("window_start"))
    opened = F.coalesce(at - F.lag(at).over(by_series) >= auto_close, F.lit(True))
    numbered = breaching.withColumn("_opens", opened.cast("int")).withColumn(
        "incident", F.sum("_opens").over(by_series.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*series, "incident").agg(
        F.min("window_start").alias("opened_at"),
        F.timestamp_add("SECOND", F.lit(auto_close), F.max("window_start")).alias("closes_at"),
        F.count("*").alias("windows"),
    )


def next_notification(last: int | None, at: int, period: int) -> bool:
    """Whether an alert at ``at`` notifies, given the last notification time."""
    return last is None or at - last >= period


def notifications(alerts: DataFrame, series: list[str], period: int) -> DataFrame:
    """Alerts that notify when at most one notification per ``period`` seconds is sent.

    Each decision depends on the one before, but not on how it came about: whichever alert notifies, the next to do so is
    the first at least a period later. So each alert points to that one (a running maximum over the series, cut into
    ranges), and pointers are doubled: after k rounds the chain from the first alert is known for 2**k steps. No series is
    walked, and a round joins alerts with pointers by (series, time), which no hot series makes uneven. ``alerts`` holds
    fired alerts (``window_start``); equal times count once, rows without a time never notify, null series are series.
    """
    times = alerts.select(*series, "window_start").where("window_start is not null").distinct()
    if period <= 0:
        return times
    times = tables.publish(times.withColumn("_at", epoch_seconds(F.col("window_start"))), "alert-times")
    spots = times.select(*series, (-F.col("_at")).alias("_back"), F.lit(0).alias("_asks")).union(
        times.select(*series, (-F.col("_at") - period).alias("_back"), F.lit(1)))
    seen = ordered.with_running_max(spots, series, ["_back", "_asks"], F.when(F.col("_asks") == 0, F.col("_back")), "_near")
    pointers = tables.publish(seen.where("_asks = 1 and _near is not null").select(*series, (-F.col("_back") - period).alias("_at"), (-F.col("_near")).alias("_next")), "alert-pointers")

    def follow(rows: DataFrame, at: str, steps: DataFrame) -> DataFrame:
        """``rows`` with the ``_to`` that ``steps`` lead to from their time ``at``."""
        to = steps.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(series)), F.col("_at").alias("_from"), F.col("_next").alias("_to"))
        return rows.join(to, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(series)], F.col(at) == F.col("_from")))

    chosen = tables.publish(times.groupBy(*series).agg(F.min("_at").alias("_at")), "alert-chosen")
    size = chosen.count()
    while size:
        grown = tables.publish(chosen.union(follow(chosen, "_at", pointers).select(*series, F.col("_to").alias("_at"))).distinct(), "alert-chosen")
        chosen, before, size = grown, size, grown.count()
        if size == before:
            break
        pointers = tables.publish(follow(pointers, "_next", pointers).select(*series, "_at", F.col("_to").alias("_next")), "alert-pointers")
    kept = chosen.select(*series, "_at", F.col("_at").alias("_next"))
    return follow(times, "_at", kept).select(*series, "window_start")


POLICY = ["policy", "seconds", "aligner", "comparison", "threshold", "duration", "auto_close", "period"]


def policy_table(spark: SparkSession, policies: dict[str, tuple] = fixed.ALERT_POLICIES) -> DataFrame:
    """Alert policies as rows: window, aligner, comparison, threshold, duration, auto close, notify period (0: none)."""
    rows = [(name, *policy[:-1], policy[-1] or 0) for name, policy in policies.items()]
    return rule_table(spark, rows, "policy string, seconds bigint, aligner string, comparison string, threshold double, "
                                   "duration bigint, auto_close bigint, period bigint")


def policy_windows(points: DataFrame, policies: DataFrame) -> DataFrame:
    """Metric points (metric, series, second, value) aligned as the policy of their metric says, with ``breach``.

    One pass for all policies: sums that combine before the shuffle, and exact percentiles for policies that ask for one.
    """
    chosen = points.join(policies.select("policy", "seconds", "aligner"), F.col("metric") == F.col("policy")).select(
        "policy", "series", (F.col("second") - F.pmod("second", "seconds")).alias("window_second"), "aligner", F.col("value").cast("double").alias("value"))
    keys = ["policy", "series", "window_second"]
    sums = chosen.where("aligner <> 'p95'").groupBy(*keys).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.sum("value").alias("sum"))
    high = percentiles.percentiles(chosen.where("aligner = 'p95'"), keys, F.col("value"), {"p95": 0.95})
    both = sums.unionByName(high, allowMissingColumns=True).join(policies, "policy")
    return judged(both)


def judged(aligned: DataFrame) -> DataFrame:
    """Policy windows with the value that their policy's aligner asks for, and whether it breaches the threshold."""
    value = F.when(F.col("aligner") == "mean", F.col("mean")).when(F.col("aligner") == "max", F.col("max")).when(
        F.col("aligner") == "rate", F.col("sum") / F.col("seconds")).otherwise(F.col("p95"))
    breach = F.when(F.col("comparison") == "LT", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return aligned.withColumn("value", value).select(
        "policy", "series", "window_second", "value", F.coalesce(breach, F.lit(False)).alias("breach"), *POLICY[1:])


def policy_fired(windows: DataFrame) -> DataFrame:
    """The windows at which a policy's breach has lasted for its whole duration; one row per unbroken run."""
    series = ["policy", "series"]
    run = F.col("window_second") / F.col("seconds") - F.row_number().over(Window.partitionBy(*series).orderBy("window_second"))
    runs = windows.where("breach").withColumn("_run", run).withColumn(
        "_position", F.row_number().over(Window.partitionBy(*series, "_run").orderBy("window_second")))
    needed = F.greatest(F.ceil(F.col("duration") / F.col("seconds")), F.lit(1))
    return runs.where(F.col("_position") == needed).select(*series, "window_second", "value")

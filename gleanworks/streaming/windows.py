"""Windowed statistics on streams. The window logic itself is shared with batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions.times import epoch_seconds
from gleanworks.operators import aggregates, alerts


def watermarked(stream: DataFrame, ts: str, delay: str = fixed.WATERMARK) -> DataFrame:
    """Event time with zone (streams need it) and the lateness bound."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def aligned(stream: DataFrame, series: list[str], ts: str, value: Column, seconds: int, how: str) -> DataFrame:
    return aggregates.align(watermarked(stream, ts), series, ts, value, seconds, how)


def over_limit(stream: DataFrame, key: list[str], ts: str, seconds: int, maximum: int) -> DataFrame:
    return aggregates.requests_over_limit(watermarked(stream, ts), key, ts, seconds, maximum)


def error_share(stream: DataFrame, ts: str, failed: Column, seconds: int = 10, step: int = 1,
                trip: float = fixed.BREAKER_ERROR_PERCENT) -> DataFrame:
    """Error percentage over sliding windows, with the breaker signal."""
    window = F.window(ts, f"{seconds} seconds", f"{step} seconds").alias("_w")
    return (
        watermarked(stream, ts).groupBy(window)
        .agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))
        .select(
            F.col("_w.start").alias("window_start"), "n", "errors",
            (F.col("errors") * 100.0 / F.col("n")).alias("error_percent"),
            (F.col("errors") * 100.0 / F.col("n") >= trip).alias("tripped"),
        )
    )


def alerts_per_minute(stream: DataFrame, ts: str, kind: str) -> DataFrame:
    return aggregates.error_alerts(watermarked(stream, ts), ts, kind, stream.sparkSession)


def policy_reach(policies: DataFrame) -> int:
    """Seconds of the longest window of the policies."""
    return policies.agg(F.max("seconds")).first()[0] or 0


def policy_windows(stream: DataFrame, policies: DataFrame, delay: str = fixed.WATERMARK) -> DataFrame:
    """A stream of metric points (metric, series, ts, value) aligned as the policy of their metric says, with ``breach``.

    The policy rows are joined to the stream, so each point gets the window length of its policy. Windows of several
    lengths share one watermark, on the window's end: it stays back by the delay and the longest window, and therefore
    passes no window whose points may still come. Same columns as ``alerts.policy_windows``.
    """
    names = policies.columns
    points = stream.select("metric", "series", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    # rows without a metric carry the clock only (ingest.drain_whole); they make windows of no policy
    joined = points.join(policies, F.col("metric") == F.col("policy"), "left").where("policy is not null or metric is null")
    second = epoch_seconds(F.col("ts"))
    start = second - F.pmod(second, F.coalesce("seconds", F.lit(1)))
    placed = joined.withColumn("window_second", start).withColumn("window_end", F.timestamp_seconds(F.col("window_second") + F.coalesce("seconds", F.lit(1))))
    amount, unit = delay.split()
    late = f"{int(amount) * {'second': 1, 'minute': 60, 'hour': 3600}[unit.rstrip('s')] + policy_reach(policies)} seconds"
    keys = ["series", "window_second", "window_end", *names]
    sums = placed.withWatermark("window_end", late).groupBy(*keys).agg(
        F.count("policy").alias("points"),
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.sum("value").alias("sum"),
        F.percentile(F.when(F.col("aligner") == "p95", F.col("value")), 0.95).alias("p95"))
    return alerts.judged(sums.where("points > 0"))  # a filter on the policy itself would be moved before the watermark

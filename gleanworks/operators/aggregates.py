"""Summaries, counters, histograms and aligned time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions import times
from gleanworks.operators import percentiles
from gleanworks.operators.joins import rule_table


def ordered_pages(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Page texts as rows, ordered by document and page: the form for documents of any length."""
    return pages.select(document, page, text).sort(document, page)


def page_rollup(pages: DataFrame, document: str, page: str, text: str, confidence: str, join_text: bool = False) -> DataFrame:
    """One row per document: pages, distinct page numbers, characters, mean and extreme confidence; aggregates combine.

    ``join_text`` adds the page texts in order as one string; only for documents that fit in a task's memory.
    """
    columns = [
        F.count("*").alias("pages"), F.countDistinct(page).alias("page_numbers"), F.sum(F.length(text)).alias("characters"),
        F.avg(confidence).alias("confidence"), F.min(confidence).alias("least_confidence"), F.max(confidence).alias("most_confidence"),
    ]
    if join_text:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("at"), F.col(text).alias("text"))))
        columns.append(F.trim(F.array_join(F.transform(ordered, lambda p: p["text"]), " ")).alias("text"))
    return pages.groupBy(document).agg(*columns)


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def list_summary(df: DataFrame, status: str, duration: str, failed: Column) -> DataFrame:
    """One row: total, count per status as a map, mean duration, failure rate."""
    return (
        df.groupBy(status)
        .agg(F.count("*").alias("n"), F.sum(duration).alias("t"), F.count(duration).alias("timed"),
             F.count_if(failed).alias("failed"))
        .agg(
            F.sum("n").alias("total"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), F.col("n"))))).alias("by_status"),
            F.try_divide(F.sum("t"), F.sum("timed")).alias("avg_duration"),
            F.try_divide(F.sum("failed"), F.sum("n")).alias("failure_rate"),
        )
    )


def batch_stats(items: DataFrame, batch: list[str], success: Column, duration: Column) -> DataFrame:
    return items.groupBy(*batch).agg(
        F.count_if(success).alias("succeeded"),
        F.count_if(~success).alias("failed"),
        F.sum(duration).alias("total_duration"),
        F.avg(duration).alias("avg_duration"),
    )


def job_metrics(requests: DataFrame, job: str, size: Column, response: Column, is_item: Column,
                is_error: Column, is_retry: Column) -> DataFrame:
    return requests.groupBy(job).agg(
        F.count("*").alias("request_count"),
        F.sum(size).alias("bytes_processed"),
        F.count_if(is_item).alias("items_scraped"),
        F.count_if(is_error).alias("error_count"),
        F.avg(response).alias("avg_response_time"),
        (F.count_if(~is_error) * 100.0 / F.count("*")).alias("success_rate"),
        (F.count_if(is_retry) * 100.0 / F.count("*")).alias("retry_rate"),
    )


def histogram(df: DataFrame, group: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts per group, one row per upper bound (plus infinity)."""
    marks = [str(bound) for bound in bounds] + ["+Inf"]
    counted = [F.count_if(value <= bound) for bound in bounds] + [F.count(value)]
    wide = df.groupBy(*group).agg(
        *[column.alias(f"_b{i}") for i, column in enumerate(counted)],
        F.sum(value).alias("total"), F.count(value).alias("n"),
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("le"), F.col(f"_b{i}").alias("count")) for i, m in enumerate(marks)])
    return wide.select(*group, F.inline(pairs), "total", "n") if group else wide.select(F.inline(pairs), "total", "n")


def last_value(df: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    """Latest gauge value per label set."""
    return df.groupBy(*labels).agg(
        F.max_by(value, F.struct(*order)).alias("value"), F.max(order[0]).alias("at")
    )


def align(df: DataFrame, series: list[str], ts: str, value: Column, seconds: int,
          how: str | list[str]) -> DataFrame:
    """Values per series and window: mean, max, min, sum, count or rate (sum per second).

    One aligner gives a column ``value``; a list gives one column per aligner.
    """
    choices = {
        "mean": F.avg(value), "max": F.max(value), "min": F.min(value), "sum": F.sum(value),
        "count": F.count(value).cast("double"), "rate": F.sum(value) / seconds,
    }
    columns = _chosen(choices, how)
    names = ["value"] if isinstance(how, str) else how
    return (
        df.groupBy(F.window(ts, f"{seconds} seconds").alias("_w"), *series).agg(*columns)
        .select(F.col("_w.start").alias("window_start"), *series, *names)
    )


def _chosen(choices: dict[str, Column], how: str | list[str]) -> list[Column]:
    unknown = [name for name in ([how] if isinstance(how, str) else how) if name not in choices]
    if unknown:
        raise ValueError(f"unknown function {unknown[0]!r}")
    return [choices[how].alias("value")] if isinstance(how, str) else [choices[name].alias(name) for name in how]


def align_percentile(df: DataFrame, series: list[str], ts: str, value: Column, seconds: int,
                     fraction: float) -> DataFrame:
    windowed = df.withColumn("window_start", F.window(ts, f"{seconds} seconds").getField("start"))
    return percentiles.percentiles(windowed, ["window_start", *series], value, {"value": fraction})


def reduce_series(aligned: DataFrame, group: list[str], how: str | list[str]) -> DataFrame:
    """Combine aligned series per window and group; several reducers give several columns."""
    value = F.col("value")
    choices = {"mean": F.avg(value), "max": F.max(value), "sum": F.sum(value), "count": F.count(value)}
    return aligned.groupBy("window_start", *group).agg(*_chosen(choices, how))


def error_rate(df: DataFrame, group: list[str], failed: Column) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("errors"),
        F.try_divide(F.count_if(failed), F.count("*")).alias("error_rate"),
    )


def hourly_throughput(df: DataFrame, ts: str, floor: int = fixed.MIN_DOCS_PER_HOUR) -> DataFrame:
    """Rows per clock hour from the first to the last, hours without any included."""
    counts = (
        df.groupBy(F.window(ts, "1 hour").alias("_w")).agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("hour"), "n")
    )
    span = counts.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    hours = span.select(F.explode(F.sequence("first", "last", F.expr("interval 1 hour"))).alias("hour"))
    filled = hours.join(counts, "hour", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("below_floor", F.col("n") < floor)


def daily_report(df: DataFrame, ts: str, failed: Column, duration: Column) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(failed).alias("errors"), F.avg(duration).alias("avg_duration"),
        F.max(duration).alias("max_duration"),
    )


def duplicates(df: DataFrame, content: Column, key: str) -> DataFrame:
    """Contents that occur more than once, with the number of copies and the first key."""
    return (
        df.groupBy(F.sha2(content, 256).alias("checksum"))
        .agg(F.count("*").alias("copies"), F.min(key).alias("first_key"))
        .where(F.col("copies") > 1)
    )


def requests_over_limit(df: DataFrame, key: list[str], ts: str, seconds: int, maximum: int) -> DataFrame:
    """Fixed windows in which a key made more requests than allowed."""
    return (
        df.groupBy(F.window(ts, f"{seconds} seconds").alias("_w"), *key)
        .agg(F.count("*").alias("n")).where(F.col("n") > maximum)
        .select(F.col("_w.start").alias("window_start"), *key, "n")
    )


def requests_over_rules(df: DataFrame, rule: str, key: list[str], ts: str,
                        rules: list[tuple[str, int, int]] = fixed.RATE_LIMITS) -> DataFrame:
    """As above for many rules at once: each row's rule gives its window length and maximum.

    Rows are counted per (rule, key, window) before the rule's maximum is compared, so a
    busy key is combined on the map side.
    """
    limits = rule_table(df.sparkSession, list(rules), f"{rule} string, seconds bigint, maximum bigint")
    at = times.epoch_seconds(F.col(ts))
    return (
        df.join(limits, rule).withColumn("window_second", at - F.pmod(at, F.col("seconds")))
        .groupBy(rule, "maximum", *key, "window_second").agg(F.count("*").alias("n"))
        .where(F.col("n") > F.col("maximum"))
    )


def error_alerts(df: DataFrame, ts: str, kind: str, spark) -> DataFrame:
    """Minutes in which an error type reached its alert threshold."""
    limits = rule_table(spark, fixed.ERROR_ALERTS, f"{kind} string, threshold int")
    counts = (
        df.groupBy(F.window(ts, "1 minute").alias("_w"), kind).agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), kind, "n")
    )
    # an outer join: an inner one would ask for a known type before the watermark, where the closing row of a stream has none
    return counts.join(limits, kind, "left").where(F.col("n") >= F.coalesce("threshold", F.lit((1 << 63) - 1)))


def timeliness(df: DataFrame, event: Column, processed: Column, minutes: int = fixed.MAX_TIMELINESS_MINUTES) -> DataFrame:
    """Delay of every row and whether it is within the target."""
    delay = times.duration_ms(event, processed)
    return df.withColumn("delay_ms", delay).withColumn("on_time", delay <= minutes * 60_000)

"""End-to-end flows: collected results and documents, from raw rows to stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions import scores, shapes, times
from gleanworks.operators import language, protection, validation
from gleanworks.sources import files, tables


@dataclass(frozen=True)
class Outcome:
    """Stored rows, the payload tables behind them, and rows set aside with their reasons."""

    stored: DataFrame
    raw: DataFrame
    processed: DataFrame
    quarantine: DataFrame


def scored(results: DataFrame, content: str) -> DataFrame:
    """Quality metrics, their average and the status they lead to."""
    text = F.col(content)
    return (
        results.withColumn("completeness", scores.text_completeness(text))
        .withColumn("consistency", scores.text_consistency(text))
        .withColumn("accuracy", F.lit(1.0)).withColumn("freshness", F.lit(1.0))
        .withColumn("average", scores.quality_average(*map(F.col, ("completeness", "accuracy", "consistency", "freshness"))))
        .withColumn("status", scores.quality_status(F.col("average")))
    )


def measured(results: DataFrame, content: str, rules: dict[str, Column], collected: Column, now: Column) -> DataFrame:
    """As ``scored``, with accuracy from the rules and freshness from the time of collection instead of their defaults, and
    the extraction as a step of the history: FAILURE where the status is INVALID."""
    text, names = F.col(content), ("completeness", "accuracy", "consistency", "freshness")
    scored_ = results.withColumn("completeness", scores.text_completeness(text)).withColumn("accuracy", scores.rule_accuracy(rules)).withColumn(
        "consistency", scores.text_consistency(text)).withColumn("freshness", scores.freshness(collected, now))
    rated = scored_.withColumn("average", scores.quality_average(*map(F.col, names))).withColumn("status", scores.quality_status(F.col("average")))
    return with_history(rated, "EXTRACT", now, F.col("status") == "INVALID")


def canonical(results: DataFrame) -> DataFrame:
    """The warehouse shape of a scored result."""
    return results.select(
        "id", F.col("jobId").alias("job_id"), F.col("sourceType").alias("source_type"),
        F.col("sourceUrl").alias("source_url"), "timestamp",
        F.struct("completeness", "accuracy", "consistency", "freshness").alias("quality"),
        F.col("status").alias("validation"), *[F.col(c) for c in results.columns if c == "history"],
    )


def step(operation: str, status: Column, at: Column, duration: Column, code: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.concat(F.lit(f"{operation.lower()}-"), F.unix_millis(at.cast("timestamp")).cast("string")).alias("stepId"),
        F.lit(operation).alias("operation"), at.alias("timestamp"), duration.alias("duration"), status.alias("status"),
        F.when(code.isNotNull(), F.struct(code.alias("code"))).alias("error") if code is not None
        else F.struct(none.alias("code")).alias("error"),
    )


def with_history(results: DataFrame, operation: str, at: Column, failed: Column, code: str = "VALIDATION_ERROR") -> DataFrame:
    """Append a SUCCESS or FAILURE step to ``history``."""
    outcome = F.when(failed, "FAILURE").otherwise("SUCCESS")
    new = step(operation, outcome, at, times.duration_ms(F.col("timestamp"), at), F.when(failed, F.lit(code)))
    steps = shapes.append_step(F.col("history"), new) if "history" in results.columns else F.array(new)
    return results.withColumn("history", steps)


def process_results(results: DataFrame, content: str, at: Column, label: str = "results") -> Outcome:
    """Validate, score, transform, land raw and processed payloads, store.

    Rows that fail the required-field rules go to quarantine with the rule ids. The scored
    rows are written once; the processed payload derives from that table, not from the texts.
    """
    checked = validation.check(results, validation.required_result_fields())
    good = checked.where("is_valid").drop("violations", "is_valid")
    bad = with_history(checked.where("not is_valid").drop("is_valid"), "TRANSFORM", at, F.lit(True))
    ready = with_history(scored(good, content), "TRANSFORM", at, F.lit(False))
    stored = tables.publish(canonical(ready), f"{label}-rows")
    return Outcome(
        stored=stored,
        raw=files.land_json(good, f"{label}-raw", "id", "timestamp"),
        processed=files.land_processed(stored, f"{label}-processed", "id"),
        quarantine=bad,
    )


def store_records(records: DataFrame, key: str, content: str, classification: str, rules: validation.Rules,
                  keys: dict[int, bytes], version: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Validate, check integrity, encrypt what is confidential, store by classification.

    Returns the stored table and the refused rows with the failed rule ids. ``content``
    is stored as bytes: ciphertext where ``encrypted`` is true, UTF-8 text elsewhere.
    """
    checks = {**rules, "classification": F.col(classification).isin(*fixed.CLASSIFICATIONS),
              "checksum": validation.checksum_matches(F.col(content), F.col("checksum"))}
    checked = validation.check(records, checks)
    good = tables.route(checked.where("is_valid").drop("violations", "is_valid"), classification)
    sealed = protection.encrypt(good, content, keys, version, F.col(key), "_sealed")
    rows = sealed.select(
        *[F.when(F.col("encrypt"), F.col("_sealed")).otherwise(F.encode(c, "UTF-8")).alias(c) if c == content else F.col(c)
          for c in records.columns],
        "location", F.col("encrypt").alias("encrypted"), "key_version",
    )
    return tables.publish(rows, label, [classification]), checked.where("not is_valid").drop("is_valid")


def opened_content(content: str, keys: dict[int, bytes], bind: Column) -> Column:
    """Text of a stored record, decrypted where it was encrypted."""
    return F.when(F.col("encrypted"), protection.decrypted(content, keys, bind)).otherwise(F.decode(content, "UTF-8"))


def process_documents(documents: DataFrame, key: str, text: str, started: Column, finished: Column,
                      label: str = "documents") -> DataFrame:
    """Analyse texts and store outcome, duration and trace id of each."""
    outcome = language.analyse(documents, key, text).select(
        F.col(key), "status", "reason", "confidence", "pii_detected",
        F.size("entities").alias("entities"), F.size("classifications").alias("classifications"),
        times.duration_ms(started, finished).alias("duration_ms"),
        shapes.uuid_from(F.col(key).cast("string")).alias("trace_id"),
    )
    return tables.publish(outcome, label)

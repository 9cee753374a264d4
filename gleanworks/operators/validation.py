"""Rule sets and the engine that applies them in one pass.

A rule set maps a rule id to a boolean column; a null verdict counts as a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions import privacy, shapes, times, urls

Rules = dict[str, Column]


# --- engine ----------------------------------------------------------------------

def holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def violations(rules: Rules) -> Column:
    """Ids of the failed rules, in rule order."""
    return F.array_compact(F.array(*[F.when(~holds(rule), F.lit(name)) for name, rule in rules.items()]))


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``violations`` and ``is_valid`` to every row."""
    return df.withColumn("violations", violations(rules)).withColumn("is_valid", F.size("violations") == 0)


def first_failure(stages: Rules) -> Column:
    """Name of the first failing stage, or null."""
    return F.coalesce(*[F.when(~holds(rule), F.lit(name)) for name, rule in stages.items()])


def completed_stages(stages: Rules) -> Column:
    """Stages passed before the first failure."""
    passed, still = [], F.lit(True)
    for name, rule in stages.items():
        still = still & holds(rule)
        passed.append(F.when(still, F.lit(name)))
    return F.array_compact(F.array(*passed))


def verdicts(df: DataFrame, key: str, rules: Rules) -> DataFrame:
    """One row per record and rule."""
    each = F.array(*[F.struct(F.lit(n).alias("rule_id"), holds(r).alias("ok")) for n, r in rules.items()])
    return df.select(key, F.inline(each))


def report(df: DataFrame, rules: Rules) -> DataFrame:
    """Checked and failed counts and pass rate per rule, all from one scan."""
    counts = [F.count_if(~holds(rule)).alias(f"_f{i}") for i, rule in enumerate(rules.values())]
    wide = df.agg(F.count("*").alias("checked"), *counts)
    each = F.array(*[
        F.struct(F.lit(name).alias("rule_id"), F.col(f"_f{i}").alias("failed")) for i, name in enumerate(rules)
    ])
    return wide.select(F.inline(each), "checked").select(
        "rule_id", "checked", "failed",
        F.try_divide(F.col("checked") - F.col("failed"), F.col("checked")).alias("pass_rate"),
    )


def within_error_budget(df: DataFrame, rules: Rules) -> DataFrame:
    """Share of rows with any violation against the allowed error rate."""
    bad = F.count_if(F.size(violations(rules)) > 0)
    return df.agg(F.count("*").alias("checked"), bad.alias("bad_rows")).withColumn(
        "error_rate", F.try_divide("bad_rows", "checked")
    ).withColumn("within_budget", F.col("error_rate") < fixed.MAX_ERROR_RATE)


# --- small tests -----------------------------------------------------------------

def filled(value: Column) -> Column:
    return value.isNotNull() & (F.length(value) > 0)


def one_of(value: Column, allowed: list[str]) -> Column:
    return value.isin(*allowed)


def unit_interval(value: Column) -> Column:
    return value.between(0.0, 1.0)


# --- collected results --------------------------------------------------------------

def required_result_fields() -> Rules:
    rules = {f"{name}_present": filled(F.col(name).cast("string")) for name in fixed.REQUIRED_RESULT_FIELDS}
    rules["timestamp_format"] = F.try_to_timestamp(F.col("timestamp").cast("string")).isNotNull()
    return rules


def result_schema() -> Rules:
    quality, storage = "metadata.qualityMetrics", "storage"
    return {
        "id_uuid": shapes.is_uuid(F.col("id")),
        "completeness": F.col(f"{quality}.completeness") >= fixed.MIN_COMPLETENESS,
        "accuracy": F.col(f"{quality}.accuracy") >= fixed.MIN_ACCURACY,
        "metadata_present": F.col("metadata.size").isNotNull() & F.col("metadata.itemCount").isNotNull()
        & filled(F.col("metadata.format")) & filled(F.col("metadata.contentType")) & filled(F.col("metadata.checksum")),
        "raw_size": F.col(f"{storage}.rawFile.size") > 0,
        "processed_size": F.col(f"{storage}.processedFile.size") > 0,
        "table_named": filled(F.col(f"{storage}.bigQueryTable")),
        "key_named": filled(F.col(f"{storage}.encryptionKey")),
    }


def result_metadata() -> Rules:
    quality = "metadata.qualityMetrics"
    return {
        "size": F.col("metadata.size") > 0,
        "item_count": F.col("metadata.itemCount") > 0,
        "status": one_of(F.col("metadata.validationStatus"), fixed.VALIDATION_STATUSES),
        **{f"{m}_range": unit_interval(F.col(f"{quality}.{m}"))
           for m in ("completeness", "accuracy", "consistency", "freshness")},
        "completeness_floor": F.col(f"{quality}.completeness") >= fixed.MIN_COMPLETENESS,
        "accuracy_floor": F.col(f"{quality}.accuracy") >= fixed.MIN_ACCURACY,
    }


def result_storage() -> Rules:
    rules = {}
    for file in ("rawFile", "processedFile"):
        rules[f"{file}_named"] = filled(F.col(f"storage.{file}.name")) & filled(F.col(f"storage.{file}.bucket"))
        rules[f"{file}_size"] = F.col(f"storage.{file}.size") > 0
    for name in ("bigQueryTable", "version", "compressionType", "encryptionKey"):
        rules[name] = filled(F.col(f"storage.{name}"))
    return rules


def all_of(rules: Rules) -> Column:
    verdict = F.lit(True)
    for rule in rules.values():
        verdict = verdict & holds(rule)
    return verdict


def result_stages() -> Rules:
    """Schema, metadata and storage stages in the order they are tried."""
    return {
        "schema": all_of({"id": shapes.is_uuid(F.col("id")), **required_result_fields()}),
        "metadata": all_of(result_metadata()),
        "storage": all_of(result_storage()),
    }


def stored_result() -> Rules:
    """Structure test before storing; quality metrics are on the 0-100 scale here."""
    quality = "metadata.qualityMetrics"
    return {
        "fields": filled(F.col("jobId")) & filled(F.col("sourceType")) & filled(F.col("sourceUrl")),
        "status": filled(F.col("metadata.validationStatus")),
        "size": F.col("metadata.size") > 0,
        **{m: F.col(f"{quality}.{m}").between(0, 100) for m in ("completeness", "accuracy", "consistency")},
    }


# --- jobs and configurations ----------------------------------------------------------

def job() -> Rules:
    details = "executionDetails"
    start, end = F.col(f"{details}.startTime"), F.col(f"{details}.endTime")
    return {
        "id_uuid": shapes.is_uuid(F.col("id")),
        "status": one_of(F.col("status"), fixed.JOB_STATUSES),
        "attempts": F.col(f"{details}.attempts") <= fixed.MAX_ATTEMPTS,
        "success_rate": F.col(f"{details}.metrics.successRate") >= fixed.MIN_SUCCESS_RATE,
        "times_ordered": start.isNull() | end.isNull() | (start < end),
    }


def _if_given(value: Column, rule) -> Column:
    return value.isNull() | (value == "") | rule(value)


def config(max_requests: int = 10) -> Rules:
    """Rules on a table of job configurations (columns as in ``SCRAPING_CONFIG``)."""
    selectors = F.map_values(F.col("source.selectors"))
    rate = F.col("options.rateLimit")
    return {
        "job_uuid": shapes.is_uuid(F.col("jobId")),
        "source_type": one_of(F.col("source.type"), fixed.SOURCE_TYPES),
        "url_length": F.length(F.col("source.url")) <= fixed.MAX_URL_LENGTH,
        "url_allowed": urls.is_allowed(F.col("source.url")),
        "selector_types": F.forall(selectors, lambda s: s["type"].isin(*fixed.SELECTOR_TYPES)),
        "selector_lengths": F.forall(selectors, lambda s: F.length(s["selector"]) <= 1000),
        "required_selectors": F.forall(selectors, lambda s: ~s["required"] | (F.length(s["selector"]) > 0)),
        "cron_present": ~F.col("schedule.enabled") | filled(F.col("schedule.cronExpression")),
        "cron_format": _if_given(F.col("schedule.cronExpression"), lambda c: c.rlike(fixed.CRON)),
        "timezone": _if_given(F.col("schedule.timezone"), lambda c: c.rlike(fixed.TIMEZONE)),
        "authentication_type": _if_given(F.col("source.authentication.type"), lambda c: c.isin(*fixed.AUTH_TYPES)),
        "retry_attempts": F.col("options.retryAttempts").between(0, 10),
        "timeout": F.col("options.timeout").between(1000, 300000),
        "rate_requests": rate["requests"].between(1, max_requests),
        "rate_period": rate["period"].between(1000, 60000),
    }


def url_policy(url: Column, https_only: bool = False) -> Rules:
    schemes = ["https"] if https_only else ["http", "https"]
    return {
        "scheme": urls.scheme(url).isin(*schemes),
        "host": urls.host(url) != "",
        "not_blocked": ~urls.is_blocked_host(urls.host(url)),
    }


# --- documents ----------------------------------------------------------------------

def document_metadata(now: Column, max_bytes: int = fixed.MAX_FILE_BYTES,
                      mimes: dict[str, str] | None = None, required_flags: list[str] = ()) -> Rules:
    """Rules on a ``metadata`` struct as in ``DOCUMENT_METADATA``."""
    allowed = mimes or fixed.MIME_EXTENSIONS
    name, mime = F.col("metadata.fileName"), F.col("metadata.mimeType")
    expected = F.lit(None).cast("string")
    for kind, ext in allowed.items():
        expected = F.when(mime == kind, F.lit(f".{ext}")).otherwise(expected)
    rules = {
        "file_name": name.rlike(fixed.FILE_NAME) & F.length(name).between(1, fixed.MAX_FILE_NAME),
        "mime": mime.isin(*allowed),
        "size": (F.col("metadata.size") > 0) & (F.col("metadata.size") <= max_bytes),
        "uploaded_at": F.col("metadata.uploadedAt") <= now,
        "extension": urls.extension(name) == expected,
    }
    for flag in required_flags:
        rules[f"flag_{flag}"] = F.array_contains(F.col("metadata.complianceFlags"), flag)
    return rules


def is_processable(now: Column, **options) -> Column:
    return all_of(document_metadata(now, **options))


def document_content(content: Column, mime: Column, max_bytes: int = fixed.MAX_FILE_BYTES) -> Rules:
    size = F.octet_length(content)
    return {
        "not_empty": size > 0,
        "size": size <= max_bytes,
        "signature": shapes.signature_matches(content, mime),
    }


def processing_result(now: Column) -> Rules:
    """Rules on a recognised document (columns as in ``OCR_RESULT``)."""
    pages = F.col("pageResults")
    return {
        **_document_rules(now),
        "text": filled(F.col("text")),
        "has_pages": F.size(pages) >= 1,
        "page_confidence": F.forall(pages, lambda p: p["confidence"].between(0.0, 1.0)),
        "unique_pages": F.size(F.array_distinct(F.transform(pages, lambda p: p["pageNumber"]))) == F.size(pages),
    }


def processing_summary(now: Column) -> Rules:
    """The same rules on a document whose pages are rolled up (columns as ``page_rollup`` gives them), however many."""
    return {
        **_document_rules(now),
        "text": F.col("characters") > 0,
        "has_pages": F.col("pages") >= 1,
        "page_confidence": (F.col("least_confidence") >= 0.0) & (F.col("most_confidence") <= 1.0),
        "unique_pages": F.col("page_numbers") == F.col("pages"),
    }


def _document_rules(now: Column) -> Rules:
    return {
        "id_uuid": shapes.is_uuid(F.col("documentId")),
        "confidence": F.col("confidence").between(fixed.MIN_PAGE_CONFIDENCE, 1.0),
        "not_future": F.col("processedAt") <= now,
        "cpu": F.col("metrics").isNull() | (F.col("metrics.cpuUtilization") <= fixed.MAX_CPU_PERCENT),
        "retries": F.col("metrics").isNull() | (F.col("metrics.retryCount") <= fixed.MAX_ATTEMPTS),
    }


def during_processing(error_rate: Column, elapsed_ms: Column) -> Rules:
    return {"error_rate": error_rate <= fixed.MAX_ERROR_RATE, "time": elapsed_ms <= fixed.MAX_PROCESSING_MS}


def after_processing(confidence: Column) -> Rules:
    return {"confidence": confidence >= fixed.MIN_RESULT_CONFIDENCE}


def text_processable(text: Column, confidence: Column) -> Column:
    return filled(text) & (confidence >= fixed.MIN_TEXT_CONFIDENCE)


# --- rows for the stores -------------------------------------------------------------

def job_row() -> Rules:
    return {
        "job_uuid": shapes.is_uuid(F.col("jobId")),
        "source_url": urls.is_http(F.col("source")),
        "status": one_of(F.col("status"), fixed.SCRAPING_JOB_ROW_STATUSES),
        "created": F.col("createdAt").isNotNull(),
        "updated": F.col("updatedAt").isNotNull(),
    }


def document_row() -> Rules:
    return {
        "doc_uuid": shapes.is_uuid(F.col("docId")),
        "content": F.col("content").isNotNull(),
        "status": one_of(F.col("processingStatus"), fixed.DOCUMENT_ROW_STATUSES),
        "created": F.col("createdAt").isNotNull(),
    }


def processed_row() -> Rules:
    """``content`` is a map; it must have at least one entry."""
    return {
        "data_uuid": shapes.is_uuid(F.col("dataId")),
        "source": F.col("sourceId").isNotNull(),
        "content": F.size(F.map_keys(F.col("content"))) > 0,
        "timestamp": F.col("timestamp").isNotNull(),
        "quality": unit_interval(F.col("quality")),
    }


def date_range(start: Column, end: Column, opens: int = 9 * 60, closes: int = 17 * 60) -> Rules:
    """Ordered, at most 365 days (rounded up), both ends within business hours."""
    days = F.ceil(times.duration_ms(start, end) / F.lit(86_400_000.0))
    start_minute = F.hour(start) * 60 + F.minute(start)
    end_minute = F.hour(end) * 60 + F.minute(end)
    return {
        "valid": start.isNotNull() & end.isNotNull(),
        "ordered": start < end,
        "length": days <= fixed.MAX_RANGE_DAYS,
        "start_hours": start_minute >= opens,
        "end_hours": end_minute <= closes,
    }


def data_record() -> Rules:
    meta = "metadata"
    return {
        "id": F.col("id").rlike(fixed.RECORD_ID),
        "content": F.size(F.map_keys(F.col("content"))) > 0,
        "source_id": F.length(F.col(f"{meta}.sourceId")).between(1, 255),
        "source_type": one_of(F.col(f"{meta}.sourceType"), fixed.RECORD_SOURCES),
        "classification": one_of(F.col(f"{meta}.classification"), fixed.CLASSIFICATIONS),
        "created": F.col(f"{meta}.createdAt").isNotNull(),
        "retention": F.col(f"{meta}.retentionPeriod") >= 1,
        "encryption": F.col(f"{meta}.encryptionStatus").isNotNull(),
        "jurisdiction": filled(F.col(f"{meta}.jurisdiction")),
        "modified": F.col(f"{meta}.lastModifiedAt").isNotNull() & filled(F.col(f"{meta}.lastModifiedBy")),
        "version": shapes.is_semver(F.col("version")),
        "checksum": shapes.is_sha256(F.col("checksum")),
    }


def checksum_matches(content: Column, stored: Column) -> Column:
    return F.sha2(content, 256) == F.lower(stored)


def restricted_approved(classification: Column, flags: Column) -> Column:
    return (classification != "RESTRICTED") | F.array_contains(flags, "APPROVED")


def metric_point(name: Column, value: Column, labels: Column) -> Rules:
    return {
        "name": filled(name),
        "value": value.isNotNull() & ~F.isnan(value),
        "labels": F.coalesce(F.size(F.map_keys(labels)), F.lit(0)) <= fixed.MAX_METRIC_LABELS,
    }


def dataset_quality(df: DataFrame, complete: Column, accurate: Column, timely: Column,
                    consistent: Column, key: str) -> DataFrame:
    """Each quality dimension of a whole table against its target, from one scan."""
    def share(test: Column) -> Column:
        return F.avg(holds(test).cast("double"))

    wide = df.agg(
        share(complete).alias("completeness"), share(accurate).alias("accuracy"),
        share(timely).alias("timeliness"), share(consistent).alias("consistency"),
        F.try_divide(F.count_distinct(key), F.count("*")).alias("uniqueness"),
    )
    each = F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(name).alias("score"), F.lit(goal).alias("target"))
        for name, goal in fixed.QUALITY_TARGETS.items()
    ])
    return wide.select(F.inline(each)).withColumn("met", F.col("score") >= F.col("target"))


def custom(checks: dict[str, Column]) -> Rules:
    """Rules supplied by the caller, checked for being columns."""
    for name, rule in checks.items():
        if not isinstance(rule, Column):
            raise TypeError(f"rule {name} is not a column")
    return dict(checks)

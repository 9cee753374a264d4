"""How the given tables stand in for the record kinds, in Spark and in SQL.

Each pair must say the same thing. The SQL side is used inside reference queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.functions import scores, shapes, text as tx, times
from gleanworks.plans.registry import Tables

NOW = "2024-02-01 00:00:00"
WORD_SQL = r"[^\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
GAP_SQL = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def naive(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def now() -> Column:
    """The fixed instant that stands for the time of a run."""
    return naive(NOW)


def one_of(column: Column, mapping: dict, default) -> Column:
    chosen = F.lit(default)
    for key, value in mapping.items():
        chosen = F.when(column == key, F.lit(value)).otherwise(chosen)
    return chosen


def one_of_sql(column: str, mapping: dict, default) -> str:
    def show(value):
        return f"'{value}'" if isinstance(value, str) else "NULL" if value is None else str(value)

    arms = " ".join(f"WHEN {column} = {show(k)} THEN {show(v)}" for k, v in mapping.items())
    return f"(CASE {arms} ELSE {show(default)} END)"


def uuid_sql(value: str) -> str:
    m = f"md5({value})"
    return (
        f"(substr({m},1,8)||'-'||substr({m},9,4)||'-4'||substr({m},14,3)||'-a'||substr({m},18,3)"
        f"||'-'||substr({m},21,12))"
    )


def stamp_sql(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


# --- text scores ----------------------------------------------------------------------

COMPLETENESS_SQL = f"""(CASE WHEN len(regexp_extract_all(text, '{WORD_SQL}')) = 0 THEN 0.0
  WHEN len(regexp_extract_all(text, '[^.!?]+')) = 0 THEN 1.0
  ELSE least(len(regexp_extract_all(text, '{WORD_SQL}'))::DOUBLE / len(regexp_extract_all(text, '[^.!?]+')) / 20, 1.0) END)"""
_LENGTHS = "list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: length(x))"
CONSISTENCY_SQL = f"""(CASE WHEN length(text) = 0 THEN 0.0 WHEN len({_LENGTHS}) <= 1 THEN 1.0
  ELSE greatest(0.0, 1 - list_stddev_pop({_LENGTHS}) / list_avg({_LENGTHS})) END)"""
SCORED_SQL = f"""SELECT *, round((completeness + 1.0 + consistency + 1.0) / 4 * 100, 6) AS average FROM (
  SELECT *, {COMPLETENESS_SQL} AS completeness, {CONSISTENCY_SQL} AS consistency FROM documents)"""
STATUS_SQL = "(CASE WHEN average >= 80 THEN 'VALID' WHEN average >= 56 THEN 'PARTIAL' ELSE 'INVALID' END)"


# --- collected results from documents ---------------------------------------------------

SOURCE_TYPE = {"en": "WEBSITE", "de": "API"}


def results(t: Tables) -> DataFrame:
    """Documents as collected results; Spanish ones lack their address."""
    d = t.documents
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", "lang", "text", "n_chars",
        shapes.uuid_from(F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("jobId"),
        one_of(F.col("lang"), SOURCE_TYPE, "DOCUMENT").alias("sourceType"),
        F.when(F.col("lang") == "es", "").otherwise(url).alias("sourceUrl"),
        F.timestamp_add("MINUTE", F.col("doc_id"), naive("2024-01-01 00:00:00")).alias("timestamp"),
    )


RESULTS_SQL = f"""SELECT doc_id, lang, text, n_chars, {uuid_sql('doc_id::VARCHAR')} AS id, source AS job_id,
  {one_of_sql('lang', SOURCE_TYPE, 'DOCUMENT')} AS source_type,
  CASE WHEN lang = 'es' THEN '' ELSE 'https://' || source || '.example.org/' || doc_id::VARCHAR END AS source_url,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS ts FROM documents"""


def full_results(t: Tables) -> DataFrame:
    """Results with metadata and storage structs; short texts have no processed file."""
    text, complete, consistent = F.col("text"), F.col("_complete"), F.col("_consistent")
    # One projection, so that the split of the text is shared by both counts.
    r = results(t).select(
        "*", scores.text_completeness(text).alias("_complete"), scores.text_consistency(text).alias("_consistent"),
        tx.item_count(text).cast("bigint").alias("_items"))
    average = scores.quality_average(complete, F.lit(1.0), consistent, F.lit(1.0))
    size = F.octet_length("text").cast("bigint")
    file = lambda name, bytes_: F.struct(
        F.concat("id", F.lit(f"/{name}.json")).alias("name"), F.lit(f"{name}-bucket").alias("bucket"), bytes_.alias("size")
    )
    return r.withColumn("metadata", F.struct(
        size.alias("size"), F.col("_items").alias("itemCount"),
        F.lit("text/plain").alias("format"), F.lit("text/plain").alias("contentType"),
        F.sha2("text", 256).alias("checksum"), scores.quality_status(average).alias("validationStatus"),
        F.struct(complete.alias("completeness"), F.lit(1.0).alias("accuracy"), consistent.alias("consistency"),
                 F.lit(1.0).alias("freshness")).alias("qualityMetrics"),
    )).withColumn("storage", F.struct(
        file("raw", size).alias("rawFile"),
        file("processed", F.when(F.col("n_chars") < 100, 0).otherwise(size)).alias("processedFile"),
        F.lit("results").alias("bigQueryTable"), F.lit("1.0.0").alias("version"), F.lit("GZIP").alias("compressionType"),
        F.when(F.col("lang") == "fr", "").otherwise("key-1").alias("encryptionKey"),
    )).drop("_complete", "_consistent", "_items")


FULL_RESULTS_SQL = f"""SELECT *, octet_length(encode(text)) AS size, len(regexp_split_to_array(text, '{GAP_SQL}')) AS item_count,
  CASE WHEN n_chars < 100 THEN 0 ELSE octet_length(encode(text)) END AS processed_size,
  CASE WHEN lang = 'fr' THEN '' ELSE 'key-1' END AS encryption_key,
  {COMPLETENESS_SQL} AS completeness, {CONSISTENCY_SQL} AS consistency FROM ({RESULTS_SQL})"""


# --- job status history from events --------------------------------------------------------

STATUS_BY_EVENT = {
    "view": "PENDING", "click": "RUNNING", "purchase": "COMPLETED", "error": "FAILED", "signup": "RETRYING",
}
STATUS_EVENT_SQL = one_of_sql("event_type", STATUS_BY_EVENT, None)


def history(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("job_id"), "ts", "event_id",
        one_of(F.col("event_type"), STATUS_BY_EVENT, None).alias("status"), "value",
    )


HISTORY_SQL = f"SELECT user_id AS job_id, ts, event_id, {STATUS_EVENT_SQL} AS status, value FROM events"


def metric_points(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("name"), "value", F.col("ts").alias("timestamp"),
        F.from_json("props", "map<string,string>").alias("labels"), "event_id",
    )


# --- documents as stored files ---------------------------------------------------------------

EXTENSION_BY_LANG = {"en": ".pdf", "de": ".png", "fr": ".JPEG"}
MIME_BY_LANG = {"en": "application/pdf", "de": "image/png", "fr": "image/jpeg", "es": "image/tiff"}


def document_files(t: Tables) -> DataFrame:
    """Documents with file name, type and upload time; Spanish ones have no extension."""
    name = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"),
                    one_of(F.col("lang"), EXTENSION_BY_LANG, ""))
    uploaded = F.timestamp_add("HOUR", F.col("doc_id"), naive("2024-01-01 00:00:00"))
    return t.documents.select(
        "doc_id", "text", "lang", "source", "n_chars",
        F.struct(
            name.alias("fileName"), one_of(F.col("lang"), MIME_BY_LANG, None).alias("mimeType"),
            F.octet_length("text").cast("bigint").alias("size"), uploaded.alias("uploadedAt"),
            F.when(F.col("n_chars") > 1000, F.array(F.lit("encrypted"), F.lit("APPROVED"))).otherwise(
                F.array(F.lit("standard"))).alias("complianceFlags"),
        ).alias("metadata"),
    )


DOCUMENT_FILES_SQL = f"""SELECT *, source || '-' || doc_id::VARCHAR || {one_of_sql('lang', EXTENSION_BY_LANG, '')} AS file_name,
  {one_of_sql('lang', MIME_BY_LANG, None)} AS mime_type, octet_length(encode(text)) AS size,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS uploaded_at,
  CASE WHEN n_chars > 1000 THEN ['encrypted', 'APPROVED'] ELSE ['standard'] END AS flags FROM documents"""


# --- customers as classified records and job configurations ------------------------------------

LEVELS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"]
LEVEL_BY_REMAINDER = dict(enumerate(LEVELS))


def level_of(key: Column) -> Column:
    return one_of(F.pmod(key, F.lit(4)), LEVEL_BY_REMAINDER, None)


def level_sql(key: str) -> str:
    return one_of_sql(f"({key} % 4)", LEVEL_BY_REMAINDER, None)


def classified(t: Tables) -> DataFrame:
    return t.customer.withColumn("classification", level_of(F.col("c_custkey")))


CLASSIFIED_SQL = f"SELECT *, {level_sql('c_custkey')} AS classification FROM customer"


# Documents with a note, so that every kind of mention and every outcome of the analysis occurs; every seventh is unreadable.
MENTIONS = {
    0: " Aspirin tablets forte 1500 mg twice daily.", 1: " Enrolled in clinical trial NCT01234567.", 2: " It interacts with warfarin sodium.",
    4: " Severe headache with nausea after 20 mg.", 5: " Write to someone.long@example.com about the study.",
}
MENTIONED_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN '' ELSE text || {one_of_sql('(doc_id % 7)', MENTIONS, '')} END AS text FROM documents"""


def mentioned(documents):
    number = F.pmod("doc_id", F.lit(7))
    return documents.select("doc_id", F.when(number == 3, "").otherwise(F.concat("text", one_of(number, MENTIONS, ""))).alias("text"))

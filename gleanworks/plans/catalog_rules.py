"""Registered queries: rule sets over whole tables, reported per rule or per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks.functions import scores, shapes, times, urls
from gleanworks.operators import aggregates as ag, joins, ordered, validation as v
from gleanworks.plans import standins as st
from gleanworks.plans.registry import Tables, query

UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def report_sql(source: str, rules: dict[str, str]) -> str:
    arms = [
        f"SELECT '{name}' AS rule_id, count(*) AS checked, count(*) FILTER (NOT coalesce({rule}, false)) AS failed FROM s"
        for name, rule in rules.items()
    ]
    return f"WITH s AS ({source}) " + " UNION ALL ".join(arms)


def report(df, rules):
    return v.report(df, rules).select("rule_id", "checked", "failed")


def text_time():
    """Collected results whose time is text, malformed for long French documents."""
    good = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return F.when((F.col("lang") == "fr") & (F.col("n_chars") > 1000), "not a time").otherwise(good)


V01_SOURCE = f"""SELECT *, CASE WHEN lang = 'fr' AND n_chars > 1000 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM ({st.RESULTS_SQL})"""


@query("v01_required_fields", report_sql(V01_SOURCE, {
    "id_present": "id <> ''", "jobId_present": "job_id <> ''", "sourceType_present": "source_type <> ''",
    "sourceUrl_present": "source_url <> ''", "timestamp_present": "t <> ''", "timestamp_format": "try_cast(t AS TIMESTAMP) IS NOT NULL"}))
def v01(spark, sf):
    return report(st.results(Tables(spark, sf)).withColumn("timestamp", text_time()), v.required_result_fields())


@query("v02_result_schema", report_sql(st.FULL_RESULTS_SQL, {
    "id_uuid": f"regexp_matches(id, '{UUID}')", "completeness": "completeness >= 0.95", "accuracy": "true", "metadata_present": "true",
    "raw_size": "size > 0", "processed_size": "processed_size > 0", "table_named": "true", "key_named": "encryption_key <> ''"}))
def v02(spark, sf):
    return report(st.full_results(Tables(spark, sf)), v.result_schema())


METADATA_SQL = {
    "size": "size > 0", "item_count": "item_count > 0", "status": "true", "completeness_range": "completeness BETWEEN 0 AND 1",
    "accuracy_range": "true", "consistency_range": "consistency BETWEEN 0 AND 1", "freshness_range": "true",
    "completeness_floor": "completeness >= 0.95", "accuracy_floor": "true"}
STORAGE_SQL = {
    "rawFile_named": "true", "rawFile_size": "size > 0", "processedFile_named": "true", "processedFile_size": "processed_size > 0",
    "bigQueryTable": "true", "version": "true", "compressionType": "true", "encryptionKey": "encryption_key <> ''"}


@query("v03_result_metadata", report_sql(st.FULL_RESULTS_SQL, METADATA_SQL))
def v03(spark, sf):
    return report(st.full_results(Tables(spark, sf)), v.result_metadata())


@query("v04_result_storage", report_sql(st.FULL_RESULTS_SQL, STORAGE_SQL))
def v04(spark, sf):
    return report(st.full_results(Tables(spark, sf)), v.result_storage())


@query("v05_stages", f"""SELECT doc_id, CASE WHEN NOT schema THEN 'schema' WHEN NOT meta THEN 'metadata' WHEN NOT storage THEN 'storage' END AS failed_stage,
  CASE WHEN NOT schema THEN '' WHEN NOT meta THEN 'schema' WHEN NOT storage THEN 'schema,metadata' ELSE 'schema,metadata,storage' END AS completed
FROM (SELECT doc_id, source_url <> '' AS schema, size > 0 AND item_count > 0 AND completeness >= 0.95 AS meta,
  size > 0 AND processed_size > 0 AND encryption_key <> '' AS storage FROM ({st.FULL_RESULTS_SQL}))""")
def v05(spark, sf):
    stages = v.result_stages()
    return st.full_results(Tables(spark, sf)).select(
        "doc_id", v.first_failure(stages).alias("failed_stage"), F.array_join(v.completed_stages(stages), ",").alias("completed"))


@query("v06_stored_result", report_sql(st.FULL_RESULTS_SQL, {
    "fields": "job_id <> '' AND source_type <> '' AND source_url <> ''", "status": "true", "size": "size > 0",
    "completeness": "completeness BETWEEN 0 AND 100", "accuracy": "true", "consistency": "consistency BETWEEN 0 AND 100"}))
def v06(spark, sf):
    return report(st.full_results(Tables(spark, sf)), v.stored_result())


JOB_SOURCE = f"""SELECT user_id, {st.uuid_sql('user_id::VARCHAR')} AS id, arg_max({st.STATUS_EVENT_SQL}, ts) AS status,
  min(ts) AS a, max(ts) AS b, count(*) FILTER (event_type = 'signup') AS attempts,
  1 - count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS success FROM events GROUP BY user_id"""


def jobs(t: Tables):
    h = st.history(t)
    summary = h.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("a"), F.max("ts").alias("b"),
        F.count_if(F.col("status") == "RETRYING").alias("attempts"),
        (1 - F.count_if(F.col("status") == "FAILED") / F.count("*")).alias("success"))
    return summary.select(
        shapes.uuid_from(F.col("job_id").cast("string")).alias("id"), "status",
        F.struct(F.col("a").alias("startTime"), F.col("b").alias("endTime"), "attempts",
                 F.struct(F.col("success").alias("successRate")).alias("metrics")).alias("executionDetails"))


@query("v07_jobs", report_sql(JOB_SOURCE, {
    "id_uuid": f"regexp_matches(id, '{UUID}')", "status": "status IN ('PENDING','RUNNING','COMPLETED','FAILED','RETRYING')",
    "attempts": "attempts <= 3", "success_rate": "success >= 0.999", "times_ordered": "a < b"}))
def v07(spark, sf):
    return report(jobs(Tables(spark, sf)), v.job())


HOSTS = {0: "https://site.example.org/a", 1: "http://10.1.2.3/x", 2: "ftp://files.example.org/", 3: "http://172.20.0.1/", 4: "https://172.32.0.1/"}
TYPES = {"HOUSEHOLD": "WEBSITE", "MACHINERY": "API", "FURNITURE": "DOCUMENT", "BUILDING": "FEED"}
CONFIG_SOURCE = f"""SELECT *, {st.one_of_sql('(c_custkey % 5)', HOSTS, None)} AS url, {st.one_of_sql('c_mktsegment', TYPES, 'WEBSITE')} AS type FROM customer"""


def configs(t: Tables):
    """Customers as job configurations with a spread of good and bad settings."""
    n = F.col("c_nationkey").cast("bigint")
    selector = F.struct(
        F.when(n % 5 == 0, "").otherwise("h1").alias("selector"), F.when(n % 7 == 0, "regex").otherwise("css").alias("type"),
        (n % 2 == 0).alias("required"))
    return t.customer.select(
        "c_custkey", shapes.uuid_from(F.col("c_custkey").cast("string")).alias("jobId"),
        F.struct(
            st.one_of(F.col("c_mktsegment"), TYPES, "WEBSITE").alias("type"),
            st.one_of(F.pmod("c_custkey", F.lit(5)), HOSTS, None).alias("url"),
            F.create_map(F.lit("title"), selector).alias("selectors"),
            F.struct(F.when(n % 6 == 0, "DIGEST").otherwise("BASIC").alias("type")).alias("authentication")).alias("source"),
        F.struct((n % 3 > 0).alias("enabled"), F.when(n > 4, F.when(n % 11 == 1, "every day").otherwise("0 0 * * *")).alias("cronExpression"),
                 F.when(n % 4 == 0, "UTC").otherwise("Europe/Paris").alias("timezone")).alias("schedule"),
        F.struct((n - 2).alias("retryAttempts"), (n * 20000).alias("timeout"),
                 F.struct((n / 2).cast("bigint").alias("requests"), (n * 3000).alias("period")).alias("rateLimit")).alias("options"))


@query("v08_configs", report_sql(CONFIG_SOURCE, {
    "job_uuid": "true", "source_type": "type IN ('WEBSITE', 'API', 'DOCUMENT')", "url_length": "length(url) <= 2048",
    "url_allowed": "c_custkey % 5 IN (0, 4)", "selector_types": "c_nationkey % 7 <> 0", "selector_lengths": "true",
    "required_selectors": "NOT (c_nationkey % 2 = 0 AND c_nationkey % 5 = 0)", "cron_present": "c_nationkey % 3 = 0 OR c_nationkey > 4",
    "cron_format": "NOT (c_nationkey > 4 AND c_nationkey % 11 = 1)", "timezone": "c_nationkey % 4 <> 0", "authentication_type": "c_nationkey % 6 <> 0",
    "retry_attempts": "c_nationkey - 2 BETWEEN 0 AND 10", "timeout": "c_nationkey * 20000 BETWEEN 1000 AND 300000",
    "rate_requests": "c_nationkey // 2 BETWEEN 1 AND 10", "rate_period": "c_nationkey * 3000 BETWEEN 1000 AND 60000"}))
def v08(spark, sf):
    return report(configs(Tables(spark, sf)), v.config())


@query("v09_url_policy", f"""SELECT scheme_ok, not_blocked, https_ok, count(*) AS n FROM (
  SELECT regexp_matches(url, '^https?:') AS scheme_ok, NOT regexp_matches(host, '^localhost$|^127\\.|^192\\.168\\.|^10\\.|^172\\.(1[6-9]|2[0-9]|3[0-1])\\.') AS not_blocked,
    url LIKE 'https:%' AS https_ok FROM (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM (
      SELECT url FROM pages UNION ALL SELECT {st.one_of_sql('(c_custkey % 5)', HOSTS, None)} FROM customer))) GROUP BY 1, 2, 3""")
def v09(spark, sf):
    t = Tables(spark, sf)
    addresses = t.pages.select("url").unionByName(t.customer.select(st.one_of(F.pmod("c_custkey", F.lit(5)), HOSTS, None).alias("url")))
    rules, strict = v.url_policy(F.col("url")), v.url_policy(F.col("url"), https_only=True)
    return addresses.select(
        rules["scheme"].alias("scheme_ok"), rules["not_blocked"].alias("not_blocked"), strict["scheme"].alias("https_ok"),
    ).groupBy("scheme_ok", "not_blocked", "https_ok").agg(F.count("*").alias("n"))


@query("v11_document_metadata", report_sql(st.DOCUMENT_FILES_SQL, {
    "file_name": "regexp_matches(file_name, '^[\\w\\-. ]+$') AND length(file_name) BETWEEN 1 AND 255",
    "mime": "mime_type IS NOT NULL", "size": "size > 0 AND size <= 52428800", "uploaded_at": f"uploaded_at <= TIMESTAMP '{st.NOW}'",
    "extension": "lower(regexp_extract(file_name, '(\\.[^./]*)$', 1)) = CASE mime_type WHEN 'application/pdf' THEN '.pdf' WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpeg' ELSE '.tiff' END",
    "flag_APPROVED": "list_contains(flags, 'APPROVED')"}))
def v11(spark, sf):
    return report(st.document_files(Tables(spark, sf)), v.document_metadata(st.now(), required_flags=["APPROVED"]))


@query("v12_content", report_sql("""SELECT *, octet_length(encode(text)) AS size, CASE WHEN doc_id % 4 = 0 THEN '%PDF' ELSE '' END || text AS body,
  CASE WHEN lang = 'en' THEN 'application/pdf' WHEN lang = 'de' THEN 'image/png' ELSE 'text/plain' END AS mime FROM documents""", {
    "not_empty": "length(body) > 0", "size": "size <= 52428800",
    "signature": "CASE mime WHEN 'application/pdf' THEN body LIKE '\\%PDF%' ESCAPE '\\' WHEN 'image/png' THEN false ELSE true END"}))
def v12(spark, sf):
    body = F.encode(F.concat(F.when(F.pmod("doc_id", F.lit(4)) == 0, "%PDF").otherwise(""), "text"), "UTF-8")
    mime = st.one_of(F.col("lang"), {"en": "application/pdf", "de": "image/png"}, "text/plain")
    rows = Tables(spark, sf).documents.select(body.alias("content"), mime.alias("mime"))
    return report(rows, v.document_content(F.col("content"), F.col("mime")))


OCR_SOURCE = f"""SELECT conv_id, {st.uuid_sql('conv_id::VARCHAR')} AS id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS pages,
  count(DISTINCT turn // 2) AS numbers, avg(least(length(text) / 1000.0, 1.0)) AS confidence FROM conversations GROUP BY conv_id"""


def recognised(t: Tables):
    """Conversations as recognised documents, rolled up; every two turns share a page number."""
    pages = t.conversations.select(
        "conv_id", F.floor(F.col("turn") / 2).alias("page"), "text", F.least(F.length("text") / F.lit(1000.0), F.lit(1.0)).alias("confidence"))
    return ag.page_rollup(pages, "conv_id", "page", "text", "confidence").select(
        "*", shapes.uuid_from(F.col("conv_id").cast("string")).alias("documentId"),
        F.timestamp_add("HOUR", F.col("conv_id"), st.naive("2024-01-28 00:00:00")).alias("processedAt"),
        F.struct((F.col("conv_id") % 100).alias("cpuUtilization"), (F.col("conv_id") % 5).alias("retryCount")).alias("metrics"))


@query("v13_processing_result", report_sql(OCR_SOURCE, {
    "id_uuid": "true", "text": "length(text) > 0", "confidence": "confidence BETWEEN 0.6 AND 1", "has_pages": "pages >= 1", "page_confidence": "true",
    "not_future": f"TIMESTAMP '2024-01-28 00:00:00' + to_hours(conv_id) <= TIMESTAMP '{st.NOW}'", "cpu": "conv_id % 100 <= 95",
    "retries": "conv_id % 5 <= 3", "unique_pages": "numbers = pages"}))
def v13(spark, sf):
    return report(recognised(Tables(spark, sf)), v.processing_summary(st.now()))


@query("v14_during_processing", """SELECT user_id, e <= 0.001 AS error_rate_ok, t <= 300000 AS time_ok FROM (
  SELECT user_id, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS e, max(value) * 1000 AS t FROM events GROUP BY 1)""")
def v14(spark, sf):
    rows = Tables(spark, sf).events.groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("e"), (F.max("value") * 1000).alias("t"))
    rules = v.during_processing(F.col("e"), F.col("t"))
    return rows.select("user_id", rules["error_rate"].alias("error_rate_ok"), rules["time"].alias("time_ok"))


@query("v15_after_processing", f"SELECT conv_id, confidence >= 0.8 AS ok FROM ({OCR_SOURCE})")
def v15(spark, sf):
    rows = Tables(spark, sf).conversations.groupBy("conv_id").agg(
        F.avg(F.least(F.length("text") / F.lit(1000.0), F.lit(1.0))).alias("confidence"))
    return rows.select("conv_id", v.after_processing(F.col("confidence"))["confidence"].alias("ok"))


@query("v16_store_rows", f"""SELECT 'job' AS kind, count(*) AS checked, count(*) FILTER (NOT (o_orderstatus IN ('F', 'P'))) AS bad FROM orders
UNION ALL SELECT 'document', count(*), count(*) FILTER (lang NOT IN ('en', 'de', 'fr')) FROM documents
UNION ALL SELECT 'processed', count(*), count(*) FILTER (NOT (c_acctbal / 10000.0 BETWEEN 0 AND 1 AND c_nationkey <> 3)) FROM customer""")
def v16(spark, sf):
    t = Tables(spark, sf)
    order_status = {"F": "failed", "P": "pending"}
    job_rows = t.orders.select(
        shapes.uuid_from(F.col("o_orderkey").cast("string")).alias("jobId"), F.lit("https://example.org/x").alias("source"),
        st.one_of(F.col("o_orderstatus"), order_status, "open").alias("status"),
        F.col("o_orderdate").alias("createdAt"), F.col("o_orderdate").alias("updatedAt"))
    doc_status = {"en": "queued", "de": "completed", "fr": "error"}
    doc_rows = t.documents.select(
        shapes.uuid_from(F.col("doc_id").cast("string")).alias("docId"), F.col("text").alias("content"),
        st.one_of(F.col("lang"), doc_status, "lost").alias("processingStatus"), st.now().alias("createdAt"))
    entry = F.create_map(F.lit("name"), F.col("c_name"))
    data_rows = t.customer.select(
        shapes.uuid_from(F.col("c_custkey").cast("string")).alias("dataId"), F.col("c_mktsegment").alias("sourceId"),
        F.when(F.col("c_nationkey") == 3, F.map_filter(entry, lambda k, _: k == "")).otherwise(entry).alias("content"),
        st.now().alias("timestamp"), (F.col("c_acctbal") / 10000.0).alias("quality"))

    def bad(df, kind, rules):
        return df.agg(F.count("*").alias("checked"), F.count_if(~v.all_of(rules)).alias("bad")).select(F.lit(kind).alias("kind"), "checked", "bad")

    return bad(job_rows, "job", v.job_row()).unionByName(bad(doc_rows, "document", v.document_row())).unionByName(
        bad(data_rows, "processed", v.processed_row()))


@query("v17_date_range", report_sql("""SELECT ts AS a, ts + to_hours((value * 40)::BIGINT - 100) AS b FROM events""", {
    "valid": "true", "ordered": "a < b", "length": "ceil(date_diff('millisecond', a, b) / 86400000.0) <= 365",
    "start_hours": "hour(a) * 60 + minute(a) >= 540", "end_hours": "hour(b) * 60 + minute(b) <= 1020"}))
def v17(spark, sf):
    rows = Tables(spark, sf).events.select(
        F.col("ts").alias("a"), F.timestamp_add("HOUR", F.round(F.col("value") * 40).cast("bigint") - 100, F.col("ts")).alias("b"))
    return report(rows, v.date_range(F.col("a"), F.col("b")))


RECORD_SOURCE = f"""SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'bad id ' ELSE 'c-' END || c_custkey::VARCHAR AS id,
  CASE WHEN c_nationkey = 1 THEN '1.0' ELSE '1.0.' || c_nationkey::VARCHAR END AS version, {st.level_sql('c_custkey')} AS classification FROM customer"""


def records(t: Tables):
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        "c_custkey",
        F.concat(F.when(F.col("c_custkey") % 5 == 0, "bad id ").otherwise("c-"), key).alias("id"),
        F.create_map(F.lit("name"), F.col("c_name")).alias("content"),
        F.struct(
            F.col("c_mktsegment").alias("sourceId"), F.when(F.col("c_mktsegment") == "BUILDING", "FEED").otherwise("API").alias("sourceType"),
            st.level_of(F.col("c_custkey")).alias("classification"), st.now().alias("createdAt"),
            F.col("c_nationkey").cast("bigint").alias("retentionPeriod"), (F.col("c_acctbal") > 0).alias("encryptionStatus"),
            F.lit("US").alias("jurisdiction"), st.now().alias("lastModifiedAt"), F.lit("loader").alias("lastModifiedBy")).alias("metadata"),
        F.when(F.col("c_nationkey") == 1, "1.0").otherwise(F.concat(F.lit("1.0."), F.col("c_nationkey").cast("string"))).alias("version"),
        F.sha2("c_name", 256).alias("checksum"))


@query("v18_data_record", report_sql(RECORD_SOURCE, {
    "id": "c_custkey % 5 <> 0", "content": "true", "source_id": "true", "source_type": "c_mktsegment <> 'BUILDING'", "classification": "true",
    "created": "true", "retention": "c_nationkey >= 1", "encryption": "true", "jurisdiction": "true", "modified": "true",
    "version": "c_nationkey <> 1", "checksum": "true"}))
def v18(spark, sf):
    return report(records(Tables(spark, sf)), v.data_record())


@query("v20_checksum", """SELECT doc_id, NOT (lang = 'es') AS intact FROM documents""")
def v20(spark, sf):
    stored = F.upper(F.sha2(F.concat(F.when(F.col("lang") == "es", "x").otherwise(""), "text"), 256))
    return Tables(spark, sf).documents.select("doc_id", v.checksum_matches(F.col("text"), stored).alias("intact"))


PAIRS = """(VALUES ('PENDING','RUNNING'),('PENDING','FAILED'),('RUNNING','COMPLETED'),('RUNNING','FAILED'),('RUNNING','RETRYING'),
  ('RETRYING','RUNNING'),('RETRYING','FAILED'),('FAILED','RETRYING')) p(a, b)"""
PREVIOUS_SQL = f"SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM ({st.HISTORY_SQL})"


def status_changes(t: Tables):
    # A low floor, so that the cut of hot keys is also at work on small tables.
    return ordered.with_previous(
        st.history(t), ["job_id"], ["ts", "event_id"], F.col("status"), "previous")


@query("v21_transitions", f"SELECT event_id, previous, status FROM ({PREVIOUS_SQL}) WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {PAIRS} WHERE a = previous AND b = status)")
def v21(spark, sf):
    return joins.invalid_transitions(status_changes(Tables(spark, sf)), spark).select("event_id", "previous", "status")


@query("v22_restricted_approval", f"""SELECT doc_id, NOT (doc_id % 4 = 3) OR n_chars > 1000 AS allowed FROM documents""")
def v22(spark, sf):
    rows = st.document_files(Tables(spark, sf))
    return rows.select("doc_id", v.restricted_approved(st.level_of(F.col("doc_id")), F.col("metadata.complianceFlags")).alias("allowed"))


@query("v23_metric_points", report_sql("SELECT CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS name, CASE WHEN value < 1 THEN NULL ELSE value END AS v FROM events", {
    "name": "name <> ''", "value": "v IS NOT NULL", "labels": "true"}))
def v23(spark, sf):
    points = st.metric_points(Tables(spark, sf))
    name = F.when(F.col("name") == "view", "").otherwise(F.col("name"))
    value = F.when(F.col("value") >= 1, F.col("value")).otherwise(F.lit(float("nan")))
    return report(points, v.metric_point(name, value, F.col("labels")))


@query("v24_text_processable", "SELECT doc_id, length(text) > 0 AND least(n_chars / 500.0, 1.0) >= 0.75 AS processable FROM documents")
def v24(spark, sf):
    confidence = F.least(F.col("n_chars") / F.lit(500.0), F.lit(1.0))
    return Tables(spark, sf).documents.select("doc_id", v.text_processable(F.col("text"), confidence).alias("processable"))


@query("v25_rule_report", f"""WITH s AS ({st.FULL_RESULTS_SQL}), r AS (SELECT doc_id, unnest(list_filter([
  CASE WHEN NOT source_url <> '' THEN 'address' END, CASE WHEN NOT completeness >= 0.95 THEN 'completeness' END,
  CASE WHEN NOT encryption_key <> '' THEN 'key' END], lambda x: x IS NOT NULL)) AS rule_id FROM s)
SELECT rule_id, count(*) AS failed, round(1 - count(*)::DOUBLE / (SELECT count(*) FROM s), 6) AS pass_rate FROM r GROUP BY 1""")
def v25(spark, sf):
    rules = {
        "address": v.filled(F.col("sourceUrl")), "completeness": F.col("metadata.qualityMetrics.completeness") >= 0.95,
        "key": v.filled(F.col("storage.encryptionKey"))}
    return v.report(st.full_results(Tables(spark, sf)), rules).where("failed > 0").select(
        "rule_id", "failed", F.round("pass_rate", 6).alias("pass_rate"))


@query("v25_row_violations", f"""SELECT doc_id, concat_ws(',', CASE WHEN NOT source_url <> '' THEN 'address' END, CASE WHEN NOT completeness >= 0.95 THEN 'completeness' END,
  CASE WHEN NOT encryption_key <> '' THEN 'key' END) AS violations FROM ({st.FULL_RESULTS_SQL})""")
def v25_rows(spark, sf):
    rules = {
        "address": v.filled(F.col("sourceUrl")), "completeness": F.col("metadata.qualityMetrics.completeness") >= 0.95,
        "key": v.filled(F.col("storage.encryptionKey"))}
    checked = v.check(st.full_results(Tables(spark, sf)), rules)
    return checked.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("v26_dataset_quality", """SELECT dimension, round(score, 6) AS score, score >= target AS met FROM (
  SELECT 'completeness' AS dimension, avg((n_chars > 0)::INT) AS score, 0.999 AS target FROM documents
  UNION ALL SELECT 'accuracy', avg((n_chars = length(text))::INT), 0.98 FROM documents
  UNION ALL SELECT 'timeliness', avg((n_chars < 5000)::INT), 1.0 FROM documents
  UNION ALL SELECT 'consistency', avg((lang IN ('en', 'de', 'fr', 'es'))::INT), 1.0 FROM documents
  UNION ALL SELECT 'uniqueness', count(DISTINCT sha256(text))::DOUBLE / count(*), 1.0 FROM documents)""")
def v26(spark, sf):
    rows = Tables(spark, sf).documents.withColumn("checksum", F.sha2("text", 256))
    scored = v.dataset_quality(
        rows, complete=F.col("n_chars") > 0, accurate=F.col("n_chars") == F.length("text"), timely=F.col("n_chars") < 5000,
        consistent=F.col("lang").isin("en", "de", "fr", "es"), key="checksum")
    return scored.select("dimension", F.round("score", 6).alias("score"), "met")


# --- scalar functions the rules rest on ---------------------------------------------------


@query("f06_url_parts", """SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def f06(spark, sf):
    url = F.col("url")
    return Tables(spark, sf).pages.select("page_id", urls.scheme(url).alias("scheme"), urls.host(url).alias("host"), urls.path(url).alias("path"))


@query("f08_identifier_tests", f"""SELECT doc_id, regexp_matches(u, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$') AS is_uuid,
  regexp_matches(v, '^\\d+\\.\\d+\\.\\d+$') AS is_semver, regexp_matches(h, '^[a-fA-F0-9]{{64}}$') AS is_hash
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN {st.uuid_sql('doc_id::VARCHAR')} ELSE md5(doc_id::VARCHAR) END AS u,
  CASE WHEN lang = 'de' THEN '1.2' ELSE '1.2.' || doc_id::VARCHAR END AS v, CASE WHEN lang = 'fr' THEN md5(text) ELSE sha256(text) END AS h FROM documents)""")
def f08(spark, sf):
    key = F.col("doc_id").cast("string")
    ident = F.when(F.col("lang") == "en", shapes.uuid_from(key)).otherwise(F.md5(key))
    version = F.when(F.col("lang") == "de", "1.2").otherwise(F.concat(F.lit("1.2."), key))
    digest = F.when(F.col("lang") == "fr", F.md5("text")).otherwise(shapes.checksum(F.col("text")))
    return Tables(spark, sf).documents.select(
        "doc_id", shapes.is_uuid_v4(ident).alias("is_uuid"), shapes.is_semver(version).alias("is_semver"), shapes.is_sha256(digest).alias("is_hash"))


@query("f21_durations", """SELECT event_id, date_diff('millisecond', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) AS queue_ms FROM events""")
def f21(spark, sf):
    start = st.naive("2024-01-01 00:00:00")
    second = F.timestamp_add("SECOND", times.epoch_seconds(F.col("ts")), st.naive("1970-01-01 00:00:00"))
    return Tables(spark, sf).events.select("event_id", times.duration_ms(start, second).alias("queue_ms"))


@query("f22_eta", """SELECT event_id, round(value / nullif(k, 0) * (100 - k), 6) AS eta, CASE WHEN k < 20 THEN 'PREPROCESSING' WHEN k < 90 THEN 'RECOGNITION' ELSE 'POSTPROCESSING' END AS stage
FROM (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def f22(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return Tables(spark, sf).events.select(
        "event_id", F.round(times.eta_seconds(F.col("value"), k), 6).alias("eta"), times.progress_stage(k).alias("stage"))


@query("f25_entity_confidence", """SELECT p_partkey, round(0.8 * least(length(p_name || p_brand) / 20.0, 1.0), 6) AS confidence FROM part""")
def f25(spark, sf):
    return Tables(spark, sf).part.select(
        "p_partkey", F.round(scores.entity_confidence(F.concat("p_name", "p_brand")), 6).alias("confidence"))

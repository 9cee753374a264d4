"""Registered queries: sources, sinks and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gleanworks import schemas
from gleanworks.functions import times
from gleanworks.operators import paging
from gleanworks.plans import standins as st
from gleanworks.plans.registry import Tables, query
from gleanworks.session import new_location
from gleanworks.sources import files, keyed, tables
from gleanworks.streaming import ingest

@query("s01_land_raw", """SELECT event_id::VARCHAR AS id, event_type, value, strftime(ts, '%Y-%m-%d') AS ingest_day FROM events""")
def s01(spark, sf):
    landed = files.land_json(Tables(spark, sf).events, "s01", "event_id", "ts")
    row = F.from_json("payload", "event_type string, value double")
    return landed.select("id", row["event_type"].alias("event_type"), row["value"].alias("value"),
                         F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_day"))


@query("s02_land_processed", """SELECT doc_id::VARCHAR AS id, lang, n_chars, md5(text) AS digest, '1.0.0' AS schema_version FROM documents""")
def s02(spark, sf):
    landed = files.land_processed(Tables(spark, sf).documents.select("doc_id", "lang", "n_chars", "text"), "s02", "doc_id")
    row = F.from_json("payload", "lang string, n_chars bigint, text string")
    return landed.select("id", row["lang"].alias("lang"), row["n_chars"].alias("n_chars"), F.md5(row["text"]).alias("digest"), "schema_version")


@query("s03_append", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def s03(spark, sf):
    orders, location = Tables(spark, sf).orders, new_location(spark, "s03")
    tables.append(orders.where("o_orderstatus = 'O'"), location, orders.schema)
    tables.append(orders.where("o_orderstatus <> 'O'"), location, orders.schema)
    stored = spark.read.schema(orders.schema).parquet(location)
    return stored.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s04_create_table", """SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance FROM customer""")
def s04(spark, sf):
    location = new_location(spark, "s04")
    schema = tables.create(spark, location, [
        {"name": "id", "type": "INTEGER", "mode": "REQUIRED"}, {"name": "name", "type": "STRING"},
        {"name": "balance", "type": "FLOAT"},
    ])
    rows = Tables(spark, sf).customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    tables.append(rows, location, schema)
    return spark.read.schema(schema).parquet(location)


@query("s05_day_layout", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(max(value), 6) AS top
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def s05(spark, sf):
    laid = tables.by_day(Tables(spark, sf).events, "ts", ["event_type", "user_id"])
    stored = tables.publish(laid, "s05", ["day"])
    chosen = stored.where(F.col("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-19").cast("date")))
    return chosen.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))


@query("s06_list_files", """SELECT source, 'text/plain' AS content_type, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes FROM documents GROUP BY 1""")
def s06(spark, sf):
    location = new_location(spark, "s06")
    texts = Tables(spark, sf).documents.select("source", F.coalesce("text", F.lit("")).alias("text"))
    texts.repartition("source").write.partitionBy("source").text(location)
    listed = files.list_files(spark, location, "*.txt")
    return listed.groupBy(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), "content_type").agg(F.sum("size").alias("bytes"))


@query("s07_read_files", """SELECT quality, count(*) AS lines FROM labels GROUP BY 1""")
def s07(spark, sf):
    location = new_location(spark, "s07")
    Tables(spark, sf).labels.repartitionByRange("quality", "doc_id").write.partitionBy("quality").json(location)
    content = files.read_files(spark, location, "*.json").select(
        F.regexp_extract("path", "/quality=([^/]+)/", 1).cast("int").alias("quality"),
        F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n")).cast("bigint").alias("lines"))
    return content.groupBy("quality").agg(F.sum("lines").alias("lines"))


@query("s08_ingest_documents", f"""SELECT doc_id, sha256(text) AS checksum, {st.uuid_sql('sha256(text)')} AS document_id FROM documents""")
def s08(spark, sf):
    return tables.with_identity(Tables(spark, sf).documents, "text").select("doc_id", "checksum", "document_id")


@query("s09_landing_record", f"""SELECT 'doc-1706745600000-' || base64(encode(url)) AS document_id, url AS source,
  CASE WHEN tail = '' THEN 'unknown' ELSE tail END AS file_name, octet_length(encode(html)) AS size, sha256(html) AS checksum,
  'standard' AS retention_policy, '2024-05-01 00:00:00' AS retention_expiry,
  'PHI_SCAN_REQUIRED,REGULATORY_DOCUMENT' AS compliance_flags
FROM (SELECT *, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS tail FROM pages)""")
def s09(spark, sf):
    at = F.lit("2024-02-01 00:00:00 UTC").cast("timestamp")
    landed = files.landing_record(Tables(spark, sf).pages, "url", "html", at)
    expiry = F.date_format(F.timestamp_add("DAY", F.lit(90), st.now()), "yyyy-MM-dd HH:mm:ss")
    return landed.withColumn("retention_expiry", expiry).withColumn(
        "compliance_flags", F.array_join("compliance_flags", ","))


@query("s10_config_pages", """SELECT 'job-' || c_custkey::VARCHAR AS job_id, c_mktsegment AS type, c_nationkey::BIGINT AS max_frequency
FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40""")
def s10(spark, sf):
    location = new_location(spark, "s10")
    configs = Tables(spark, sf).customer.select(
        F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("jobId"), F.col("c_custkey").alias("n"),
        F.struct(F.col("c_mktsegment").alias("type")).alias("source"),
        F.struct(F.struct(F.col("c_nationkey").cast("bigint").alias("maxFrequency")).alias("validation")).alias("schedule"))
    files.export_json(configs, location)
    read = files.read_json(spark, location, schemas.SCRAPING_CONFIG).withColumn(
        "n", F.regexp_extract("jobId", r"(\d+)$", 1).cast("bigint"))
    return paging.page_of(read, [F.col("n").asc()], 3, 20).select(
        F.col("jobId").alias("job_id"), F.col("source.type").alias("type"),
        F.col("schedule.validation.maxFrequency").alias("max_frequency"))


@query("s12_parametrised_sql", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000.0""")
def s12(spark, sf):
    return tables.query(
        spark, "SELECT o_orderkey, o_totalprice FROM s12_orders WHERE o_orderpriority = :priority AND o_totalprice > :floor",
        {"priority": "1-URGENT", "floor": 300000.0}, s12_orders=Tables(spark, sf).orders)


@query("s13_export_json", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""")
def s13(spark, sf):
    location = new_location(spark, "s13")
    files.export_json(Tables(spark, sf).orders, location)
    return spark.read.schema("o_orderkey bigint, o_orderstatus string, o_totalprice double").json(location)


@query("s14_export_csv", """SELECT page_id::VARCHAR AS page_id, url AS address_url, '' AS address_note FROM pages""")
def s14(spark, sf):
    location = new_location(spark, "s14")
    nested = Tables(spark, sf).pages.select(
        "page_id", F.struct(F.col("url"), F.lit(None).cast("string").alias("note")).alias("address"))
    files.export_csv(nested, location)
    stored = spark.read.schema("page_id string, address_url string, address_note string").option("header", True).csv(location)
    return stored.select("page_id", "address_url", F.coalesce("address_note", F.lit("")).alias("address_note"))


UPSERT_SQL = """WITH c AS (
  SELECT o_orderkey, 'U' AS o_orderstatus, o_totalprice + 1 AS p, o_orderdate + INTERVAL 1 DAY AS d FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'S', o_totalprice - 1, o_orderdate - INTERVAL 1 DAY FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey + 1000000000, 'N', o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 400000
  UNION ALL SELECT o_orderkey + 1000000000, 'M', o_totalprice, o_orderdate + INTERVAL 1 HOUR FROM orders WHERE o_totalprice > 450000)
SELECT o_orderkey, o_orderstatus, round(p, 2) AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY d DESC) AS rn FROM (
    SELECT o_orderkey, o_orderstatus, o_totalprice AS p, o_orderdate AS d FROM orders UNION ALL SELECT * FROM c)) WHERE rn = 1"""


def order_changes(spark, sf):
    base = Tables(spark, sf).orders.select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("updated_at"))
    at, key = F.col("updated_at"), F.col("o_orderkey")

    def version(rows, status, price, when, shift=0):
        return rows.select((key + shift).alias("o_orderkey"), F.lit(status).alias("o_orderstatus"), price.alias("price"), when.alias("updated_at"))

    price, far = F.col("price"), 1000000000
    changes = reduce(lambda a, b: a.unionByName(b), [
        version(base.where("o_orderstatus = 'P'"), "U", price + 1, F.timestamp_add("DAY", F.lit(1), at)),
        version(base.where("o_orderstatus = 'F'"), "S", price - 1, F.timestamp_add("DAY", F.lit(-1), at)),
        version(base.where("price > 400000"), "N", price, at, far),
        version(base.where("price > 450000"), "M", price, F.timestamp_add("HOUR", F.lit(1), at), far),
    ])
    return base, changes


@query("s15_upsert", UPSERT_SQL)
def s15(spark, sf):
    base, changes = order_changes(spark, sf)
    return tables.upsert(base, changes, "o_orderkey", ["updated_at"]).select(
        "o_orderkey", "o_orderstatus", F.round("price", 2).alias("price"))


@query("s15_upsert_indexed", UPSERT_SQL)
def s15_indexed(spark, sf):
    base, changes = order_changes(spark, sf)
    table = keyed.upsert(keyed.create(base, "o_orderkey", "s15", 4096), changes, ["updated_at"], "s15")
    return table.rows().select("o_orderkey", "o_orderstatus", F.round("price", 2).alias("price"))


@query("s16_delete_cascade", """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS table_name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)""")
def s16(spark, sf):
    t = Tables(spark, sf)
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"))
    lost = orders.join(gone, "key", "left_semi").select(F.col("o_orderkey").alias("key"))
    kept = {
        **tables.delete_keys({"customer": t.customer.select(F.col("c_custkey").alias("key")), "orders": orders}, gone, "key"),
        **tables.delete_keys({"lineitem": t.lineitem.select(F.col("l_orderkey").alias("key"))}, lost, "key"),
    }
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, rows in kept.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("s16_delete_indexed", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)")
def s16_indexed(spark, sf):
    t = Tables(spark, sf)
    gone = t.customer.where("c_acctbal < -900").select(F.col("c_custkey").alias("o_custkey"))
    return keyed.delete(keyed.create(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "s16", 4096), gone, "s16").rows()


FLAGGED_SQL = f"""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) AS archived,
  CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) THEN '{st.NOW}' END AS archived_at FROM orders"""


@query("s17_flag_indexed", FLAGGED_SQL)
def s17_indexed(spark, sf):
    t = Tables(spark, sf)
    keys = t.lineitem.where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    base = t.orders.select("o_orderkey", F.lit(False).alias("archived"), F.lit(None).cast("timestamp_ntz").alias("archived_at"))
    return keyed.flag(keyed.create(base, "o_orderkey", "s17", 4096), keys, st.now(), "s17").rows().withColumn("archived_at", times.stamp(F.col("archived_at")))


@query("s17_flag_archived", f"""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) AS archived,
  CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) THEN '{st.NOW}' END AS archived_at FROM orders""")
def s17(spark, sf):
    t = Tables(spark, sf)
    keys = t.lineitem.where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.flag_archived(t.orders.select("o_orderkey"), keys, "o_orderkey", st.now()).withColumn(
        "archived_at", times.stamp(F.col("archived_at")))


@query("s18_archive_tier", """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'archive' ELSE 'active' END AS tier,
  CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN strftime(TIMESTAMP '2024-02-01 00:00:00' + to_days(2555), '%Y-%m-%d %H:%M:%S') END AS expiry
FROM orders""")
def s18(spark, sf):
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate")
    archived, active = tables.move_to_archive(orders, F.col("o_orderdate") < st.naive("1998-01-01 00:00:00"), st.now())
    archived = tables.publish(archived, "s18")
    return archived.select("o_orderkey", F.lit("archive").alias("tier"), times.stamp(F.col("retention_expiry")).alias("expiry")).unionByName(
        active.select("o_orderkey", F.lit("active").alias("tier"), F.lit(None).cast("string").alias("expiry")))


KIND = {"1-URGENT": "raw", "2-HIGH": "processed", "3-MEDIUM": "system_logs", "4-NOT SPECIFIED": "audit_logs"}


@query("s19_retention", f"""SELECT o_orderkey, kind, age_days, CASE WHEN age_days >= d THEN 'DELETE' WHEN age_days >= a THEN 'ARCHIVE' ELSE 'ACTIVE' END AS action
FROM (SELECT o_orderkey, {st.one_of_sql('o_orderpriority', KIND, 'other')} AS kind,
        date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS age_days FROM orders)
LEFT JOIN (VALUES ('raw', 90, 365), ('processed', 180, 730), ('system_logs', 30, 365), ('audit_logs', 365, 2555)) p(k, a, d) ON kind = k""")
def s19(spark, sf):
    orders = Tables(spark, sf).orders.withColumn("kind", st.one_of(F.col("o_orderpriority"), KIND, "other"))
    acted = tables.retention_actions(orders, "kind", "o_orderdate", st.naive("2001-08-01 00:00:00"))
    return acted.select("o_orderkey", "kind", "age_days", "action")


@query("s20_lifecycle", """SELECT o_orderkey, newer_versions, CASE WHEN age >= 90 AND newer_versions >= 3 THEN 'DELETE' WHEN age >= 365 THEN 'COLD' ELSE 'KEEP' END AS action
FROM (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS age,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS newer_versions FROM orders)""")
def s20(spark, sf):
    acted = tables.lifecycle_actions(
        Tables(spark, sf).orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], st.naive("2001-08-01 00:00:00"))
    return acted.select("o_orderkey", "newer_versions", "action")


@query("s21_storage_path", f"""SELECT doc_id, 'documents/' || tail AS path, 'backup/' || tail AS backup_path, storage_class FROM (
  SELECT doc_id, strftime(uploaded_at, '%Y/%m/%d') || '/' || md5(file_name) || lower(regexp_extract(file_name, '(\\.[^./]*)$', 1)) AS tail,
    CASE WHEN n_chars > 1000 THEN 'ARCHIVE' ELSE 'STANDARD' END AS storage_class FROM ({st.DOCUMENT_FILES_SQL}))""")
def s21(spark, sf):
    place = tables.storage_path(F.col("metadata.fileName"), F.col("metadata.uploadedAt"), F.col("n_chars") > 1000)
    return st.document_files(Tables(spark, sf)).select("doc_id", place.alias("p")).select("doc_id", "p.*")


OPERATION = {"R": "DELETE", "A": "ARCHIVE", "N": "PROCESS"}


@query("s22_batch_outcomes", f"""SELECT operation, status, count(*) AS n FROM (
  SELECT {st.one_of_sql('l_returnflag', OPERATION, None)} AS operation,
    CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM lineitem)
GROUP BY 1, 2""")
def s22(spark, sf):
    t = Tables(spark, sf)
    requests = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), st.one_of(F.col("l_returnflag"), OPERATION, None).alias("operation"))
    outcome = tables.batch_outcomes(requests, t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")
    return outcome.groupBy("operation", "status").agg(F.count("*").alias("n"))


@query("s23_incremental_load", """SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def s23(spark, sf):
    rows = Tables(spark, sf).documents.select("doc_id", "lang", "n_chars")
    source, target, progress = (new_location(spark, f"s23-{part}") for part in ("source", "target", "progress"))
    for arrival in (rows.where("lang = 'en'"), rows.where("lang <> 'en'")):
        tables.append(arrival, source)
        ingest.load_available(ingest.read_stream(spark, source, rows.schema), target, progress)
    return spark.read.schema(rows.schema).parquet(target).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("s24_metric_log", """SELECT event_type AS name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def s24(spark, sf):
    stored = tables.publish(tables.by_day(st.metric_points(Tables(spark, sf)), "timestamp", ["name"]), "s24", ["day"])
    return stored.groupBy("name", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


UNIFIED_SQL = """SELECT 'SCRAPING' AS source_type, page_id AS record_id, url, NULL AS lang FROM pages
UNION ALL SELECT 'DOCUMENT', doc_id, NULL, lang FROM documents"""


def unified(spark, sf):
    t = Tables(spark, sf)
    return tables.unify(
        t.pages.select(F.col("page_id").alias("record_id"), "url"), t.documents.select(F.col("doc_id").alias("record_id"), "lang"))


query("s25_unify", UNIFIED_SQL)(unified)


@query("s26_parquet_tables", """SELECT doc_id, source, lang, length(text) AS chars, md5(text) AS digest FROM documents""")
def s26(spark, sf):
    stored = tables.publish(Tables(spark, sf).documents, "s26")
    return stored.select("doc_id", "source", "lang", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("s27_route", f"""SELECT classification, CASE WHEN secure THEN 'secure/' ELSE 'standard/' END || lower(classification) AS location, secure AS encrypt, count(*) AS n
FROM (SELECT *, classification IN ('CONFIDENTIAL', 'RESTRICTED') AS secure FROM ({st.CLASSIFIED_SQL})) GROUP BY 1, 2, 3""")
def s27(spark, sf):
    routed = tables.route(st.classified(Tables(spark, sf)), "classification")
    stored = tables.publish(routed, "s27", ["classification"])
    return stored.groupBy("classification", "location", "encrypt").agg(F.count("*").alias("n"))


@query("s28_new_jobs", f"""SELECT c_custkey AS job_id, 'PENDING' AS status, 1 AS version, '{st.NOW}' AS created_at, 0 AS request_count, 0 AS error_count FROM customer""")
def s28(spark, sf):
    jobs = tables.new_jobs(Tables(spark, sf).customer.select(F.col("c_custkey").alias("job_id")), st.now())
    return jobs.select("job_id", "status", "version", times.stamp(F.col("created_at")).alias("created_at"), "request_count", "error_count")


MOVE = {0: "RUNNING", 1: "COMPLETED", 2: "FAILED"}


@query("s29_status_update", f"""SELECT c_custkey AS job_id, s AS status, CASE WHEN s = 'COMPLETED' THEN 'rejected' ELSE 'accepted' END AS outcome,
  CASE WHEN s = 'COMPLETED' THEN 1 ELSE 2 END AS version FROM (SELECT c_custkey, {st.one_of_sql('(c_nationkey % 3)', MOVE, None)} AS s FROM customer)""")
def s29(spark, sf):
    customers = Tables(spark, sf).customer
    log = tables.new_jobs(customers.select(F.col("c_custkey").alias("job_id")), st.now())
    updates = customers.select(
        F.col("c_custkey").alias("job_id"), st.one_of(F.pmod("c_nationkey", F.lit(3)), MOVE, None).alias("status"), st.now().alias("updated_at"))
    accepted, rejected = tables.status_update(log, updates, "job_id", "updated_at")
    return accepted.select("job_id", "status", F.lit("accepted").alias("outcome"), "version").unionByName(
        rejected.select("job_id", "status", F.lit("rejected").alias("outcome"), F.lit(1).alias("version")))


@query("s29_updates_in_order", """WITH RECURSIVE u AS (SELECT o_custkey AS job_id, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' ELSE 'RETRYING' END AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT job_id, o_orderkey, status, n, status IN ('RUNNING', 'FAILED') AS accepted, CASE WHEN status IN ('RUNNING', 'FAILED') THEN status ELSE 'PENDING' END AS now,
    CASE WHEN status IN ('RUNNING', 'FAILED') THEN 2 ELSE 1 END AS version FROM u WHERE n = 1
  UNION ALL SELECT job_id, o_orderkey, status, n, a, CASE WHEN a THEN status ELSE now END, CASE WHEN a THEN version + 1 ELSE version END FROM (
    SELECT u.job_id, u.o_orderkey, u.status, u.n, f.now, f.version, (f.now || '-' || u.status) IN ('PENDING-RUNNING', 'PENDING-FAILED', 'RUNNING-COMPLETED', 'RUNNING-FAILED', 'RUNNING-RETRYING',
      'RETRYING-RUNNING', 'RETRYING-FAILED', 'FAILED-RETRYING') AS a FROM f JOIN u ON u.job_id = f.job_id AND u.n = f.n + 1))
SELECT job_id, o_orderkey, status, version FROM f WHERE accepted""")
def s29_in_order(spark, sf):
    t = Tables(spark, sf)
    log = tables.new_jobs(t.customer.select(F.col("c_custkey").alias("job_id")), st.now())
    moves = {0: "RUNNING", 1: "COMPLETED", 2: "FAILED", 3: "RETRYING"}
    updates = t.orders.select(F.col("o_custkey").alias("job_id"), st.one_of(F.pmod("o_orderkey", F.lit(4)), moves, None).alias("status"), "o_orderkey")
    accepted, _ = tables.status_update(log, updates, "job_id", "o_orderkey")
    return accepted.select("job_id", "o_orderkey", "status", "version")


@query("u02_union_datasets", "SELECT source_type, count(*) AS n, count(url) AS with_url FROM (" + UNIFIED_SQL + ") GROUP BY 1")
def u02(spark, sf):
    return unified(spark, sf).groupBy("source_type").agg(F.count("*").alias("n"), F.count("url").alias("with_url"))


@query("a08_filter_values", """SELECT DISTINCT 'status' AS filter, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders""")
def a08(spark, sf):
    orders = Tables(spark, sf).orders
    each = F.array(
        F.struct(F.lit("status").alias("filter"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("filter"), F.col("o_orderpriority").alias("value")))
    return orders.select(F.inline(each)).distinct()

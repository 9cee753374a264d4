"""Registered queries: predicates, projections, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions import privacy, shapes, text as tx, times
from gleanworks.operators import joins, ordered, paging, predicates, validation
from gleanworks.plans import flows
from gleanworks.plans import standins as st
from gleanworks.plans.registry import Tables, query
from gleanworks.sources import tables, text_index

STAMPED = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("p01_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def p01(spark, sf):
    rule = predicates.equals_all({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return Tables(spark, sf).orders.where(rule).select("o_orderkey", "o_totalprice")


@query("p02_filter_map", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p02(spark, sf):
    rule = predicates.matches('{"o_orderstatus": "O", "o_orderpriority": ["1-URGENT", "2-HIGH"]}')
    return Tables(spark, sf).orders.where(rule).select("o_orderkey")


@query("p04_classification", f"SELECT c_custkey, classification FROM ({st.CLASSIFIED_SQL}) WHERE classification IN ('PUBLIC', 'INTERNAL')")
def p04(spark, sf):
    rows = st.classified(Tables(spark, sf))
    return rows.where(predicates.in_classifications(F.col("classification"), "PUBLIC,INTERNAL")).select("c_custkey", "classification")


@query("p05_clearance", f"""SELECT c_custkey, classification, {st.level_sql('c_nationkey')} AS caller FROM ({st.CLASSIFIED_SQL})
WHERE c_custkey % 4 <= c_nationkey % 4""")
def p05(spark, sf):
    rows = st.classified(Tables(spark, sf)).withColumn("caller", st.level_of(F.col("c_nationkey")))
    return rows.where(predicates.cleared_for(F.col("classification"), F.col("caller"))).select("c_custkey", "classification", "caller")


ROLE = {"HOUSEHOLD": "ADMIN", "MACHINERY": "DEVELOPER", "FURNITURE": "DATA_ENGINEER", "BUILDING": "API_CONSUMER"}
RESOURCE = {0: "scraping", 1: "documents", 2: "data", 3: "config"}
ACTION = {0: "create", 1: "read", 2: "export"}
REQUESTS_SQL = f"""SELECT c_custkey, {st.one_of_sql('c_mktsegment', ROLE, 'GUEST')} AS role,
  {st.one_of_sql('(c_nationkey % 4)', RESOURCE, None)} AS resource, {st.one_of_sql('(c_custkey % 3)', ACTION, None)} AS action FROM customer"""
GRANTS_SQL = """(VALUES ('ADMIN','scraping','full'),('ADMIN','documents','full'),('ADMIN','data','full'),('ADMIN','config','full'),
 ('DEVELOPER','scraping','create'),('DEVELOPER','scraping','read'),('DEVELOPER','documents','create'),('DEVELOPER','documents','read'),
 ('DEVELOPER','data','read'),('DEVELOPER','config','read'),('DATA_ENGINEER','scraping','read'),('DATA_ENGINEER','documents','create'),
 ('DATA_ENGINEER','documents','read'),('DATA_ENGINEER','data','read'),('DATA_ENGINEER','data','export'),('DATA_ENGINEER','config','read'),
 ('API_CONSUMER','data','read')) g(role, resource, action)"""


def access_requests(t: Tables):
    return t.customer.select(
        "c_custkey", st.one_of(F.col("c_mktsegment"), ROLE, "GUEST").alias("role"),
        st.one_of(F.pmod("c_nationkey", F.lit(4)), RESOURCE, None).alias("resource"),
        st.one_of(F.pmod("c_custkey", F.lit(3)), ACTION, None).alias("action"))


@query("p06_role_access", f"""SELECT c_custkey, role, resource, action FROM ({REQUESTS_SQL}) r WHERE EXISTS (
  SELECT 1 FROM {GRANTS_SQL} WHERE g.role = r.role AND g.resource = r.resource AND (g.action = r.action OR g.action = 'full'))""")
def p06(spark, sf):
    return joins.permitted(access_requests(Tables(spark, sf)), spark)


@query("p07_date_range", f"""SELECT o_orderkey, {STAMPED.format('o_orderdate')} AS day FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-06-30'""")
def p07(spark, sf):
    rows = Tables(spark, sf).orders.where(predicates.between_dates(F.col("o_orderdate"), "1997-03-01 00:00:00", "1997-06-30 00:00:00"))
    return rows.select("o_orderkey", times.stamp(F.col("o_orderdate")).alias("day"))


@query("p08_metric_fetch", """SELECT event_id, value FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '5'
AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
def p08(spark, sf):
    points = st.metric_points(Tables(spark, sf))
    return predicates.metric_points(points, "click", "2024-01-05 00:00:00", "2024-01-25 00:00:00", {"k": "5"}).select("event_id", "value")


@query("p08_day_table", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-06 18:00:00'")
def p08_days(spark, sf):
    by_day = tables.publish(Tables(spark, sf).events.withColumn("day", F.to_date("ts")), "p08", ["day"])
    return by_day.where(predicates.within_days(F.col("ts"), F.col("day"), "2024-01-05 06:00:00", "2024-01-06 18:00:00")).select("event_id", "value")


@query("p09_tags", "SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'bolt'])")
def p09(spark, sf):
    return Tables(spark, sf).part.where(predicates.any_tag(F.split("p_name", " "), ["red", "bolt"])).select("p_partkey", "p_name")


@query("p10_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def p10(spark, sf):
    return Tables(spark, sf).part.where(predicates.text_search(F.col("p_name"), "Ring")).select("p_partkey", "p_name")


@query("p10_search_indexed", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def p10_indexed(spark, sf):
    table = text_index.create(Tables(spark, sf).documents.select("doc_id", "source", "text"), "text", "p10", 1000, ["doc_id"])
    return text_index.search(table, "License").select("doc_id", "source")


@query("p11_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def p11(spark, sf):
    return Tables(spark, sf).orders.where(predicates.equals_all({"o_orderstatus": "P"})).select("o_orderkey")


@query("p12_jurisdiction", """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'MACHINERY' AND n_regionkey = 1""")
def p12(spark, sf):
    t = Tables(spark, sf)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where(predicates.matches({"c_mktsegment": "MACHINERY", "n_regionkey": 1})).select("c_custkey", "n_name")


@query("p13_without_metadata", "SELECT event_id, event_type FROM events")
def p13(spark, sf):
    rows = Tables(spark, sf).events.select("event_id", "event_type", F.col("props").alias("metadata"))
    return predicates.without_metadata(rows, False)


@query("p14_transform", f"""SELECT id, job_id, source_type, source_url, {STAMPED.format('ts')} AS ts,
  round(completeness, 6) AS completeness, round(consistency, 6) AS consistency,
  CASE WHEN average >= 80 THEN 'VALID' WHEN average >= 56 THEN 'PARTIAL' ELSE 'INVALID' END AS validation
FROM (SELECT *, round((completeness + consistency + 2) / 4 * 100, 6) AS average FROM ({st.FULL_RESULTS_SQL}))""")
def p14(spark, sf):
    rows = flows.canonical(flows.scored(st.results(Tables(spark, sf)), "text"))
    return rows.select(
        "id", "job_id", "source_type", "source_url", times.stamp(F.col("timestamp")).alias("ts"),
        F.round("quality.completeness", 6).alias("completeness"), F.round("quality.consistency", 6).alias("consistency"), "validation")


@query("p15_table_row", f"""SELECT id, job_id, source_type, source_url, {STAMPED.format('ts')} AS timestamp,
  id || '/raw.json' AS storage_name, size AS metadata_size FROM ({st.FULL_RESULTS_SQL})""")
def p15(spark, sf):
    return st.full_results(Tables(spark, sf)).select(
        "id", F.col("jobId").alias("job_id"), F.col("sourceType").alias("source_type"), F.col("sourceUrl").alias("source_url"),
        times.stamp(F.col("timestamp")).alias("timestamp"), F.col("storage.rawFile.name").alias("storage_name"),
        F.col("metadata.size").alias("metadata_size"))


@query("p16_coerce", """SELECT p_partkey, trim(v) AS as_text, CASE WHEN trim(v) = '' THEN 0.0 ELSE try_cast(trim(v) AS DOUBLE) END AS as_number,
  v <> '' AS as_boolean FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ' ' || p_size::VARCHAR || ' ' WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS v FROM part)""")
def p16(spark, sf):
    size = F.col("p_size").cast("string")
    value = (
        F.when(F.pmod("p_size", F.lit(3)) == 0, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(F.pmod("p_size", F.lit(3)) == 1, F.col("p_brand")).otherwise("")
    )
    text, number = shapes.number_or_text(F.col("v"))
    return Tables(spark, sf).part.withColumn("v", value).select(
        "p_partkey", text.alias("as_text"), number.alias("as_number"), shapes.truthy(F.col("v")).alias("as_boolean"))


@query("p18_mask_keys", """SELECT event_id, '[SENSITIVE]' AS token, user_id::VARCHAR AS owner FROM events""")
def p18(spark, sf):
    entries = F.create_map(F.lit("Token"), F.col("props"), F.lit("owner"), F.col("user_id").cast("string"))
    masked = privacy.mask_keys(entries, ["token", "password"], "[SENSITIVE]")
    return Tables(spark, sf).events.select("event_id", masked.alias("m")).select(
        "event_id", F.col("m")["Token"].alias("token"), F.col("m")["owner"].alias("owner"))


@query("p19_label_keys", """SELECT event_id, event_type || '_k_ratio' AS label, json_extract_string(props, '$.k') AS value FROM events""")
def p19(spark, sf):
    labels = F.create_map(F.concat("event_type", F.lit("-k.ratio")), F.get_json_object("props", "$.k"))
    clean = privacy.sanitise_label_keys(labels)
    return Tables(spark, sf).events.select("event_id", F.explode(clean).alias("label", "value"))


METHOD = {"click": "GET", "purchase": "POST", "error": "GET", "view": "GET", "signup": "PUT"}
CODE = {"click": 404, "error": 503, "signup": 201}
PATH_SQL = "CASE user_id % 3 WHEN 0 THEN '/api/v1/data/7' WHEN 1 THEN '/auth/login' ELSE '/api/v1/documents' END"


def access_log(t: Tables):
    path = st.one_of(F.pmod("user_id", F.lit(3)), {0: "/api/v1/data/7", 1: "/auth/login"}, "/api/v1/documents")
    return t.events.select(
        "event_id", "ts", "user_id", "value", st.one_of(F.col("event_type"), METHOD, None).alias("method"), path.alias("path"),
        st.one_of(F.col("event_type"), CODE, 200).alias("status_code"))


@query("p20_audit", f"""SELECT event_id, method, path FROM (SELECT event_id, {st.one_of_sql('event_type', METHOD, None)} AS method, {PATH_SQL} AS path FROM events)
WHERE method IN ('POST', 'PUT', 'DELETE', 'PATCH') OR contains(path, '/api/v1/data') OR contains(path, '/auth')""")
def p20(spark, sf):
    log = access_log(Tables(spark, sf))
    return log.where(predicates.is_audited(F.col("method"), F.col("path"))).select("event_id", "method", "path")


@query("p21_log_level", f"""SELECT event_id, CASE WHEN c >= 500 THEN 'error' WHEN c >= 400 THEN 'warn' ELSE 'info' END AS level
FROM (SELECT event_id, {st.one_of_sql('event_type', CODE, 200)} AS c FROM events)""")
def p21(spark, sf):
    return access_log(Tables(spark, sf)).select("event_id", predicates.log_level(F.col("status_code")).alias("level"))


LATEST_SQL = f"SELECT job_id, arg_max(status, ts) AS status FROM ({st.HISTORY_SQL}) GROUP BY 1"


def latest_status(t: Tables):
    return ordered.latest_per_key(st.history(t), ["job_id"], ["ts", "event_id"])


@query("p22_result_gate", f"SELECT job_id, status FROM ({LATEST_SQL}) WHERE status = 'COMPLETED'")
def p22(spark, sf):
    return latest_status(Tables(spark, sf)).where(predicates.has_results(F.col("status"))).select("job_id", "status")


@query("p23_stop_gate", f"SELECT job_id, status FROM ({LATEST_SQL}) WHERE status NOT IN ('COMPLETED', 'FAILED')")
def p23(spark, sf):
    return latest_status(Tables(spark, sf)).where(predicates.can_stop(F.col("status"))).select("job_id", "status")


@query("p24_processable", f"""SELECT doc_id, coalesce(regexp_matches(file_name, '^[\\w\\-. ]+$') AND length(file_name) BETWEEN 1 AND 255 AND size > 0 AND size <= 52428800
  AND uploaded_at <= TIMESTAMP '{st.NOW}' AND list_contains(flags, 'encrypted')
  AND ((mime_type = 'application/pdf' AND file_name LIKE '%.pdf') OR (mime_type = 'image/png' AND file_name LIKE '%.png') OR (mime_type = 'image/jpeg' AND lower(file_name) LIKE '%.jpeg')), false) AS processable
FROM ({st.DOCUMENT_FILES_SQL})""")
def p24(spark, sf):
    verdict = validation.is_processable(st.now(), required_flags=["encrypted"])
    return st.document_files(Tables(spark, sf)).select("doc_id", verdict.alias("processable"))


ERROR_CODE = {"error": "INTERNAL", "click": "NOT_FOUND", "view": "DEADLINE_EXCEEDED"}
ERROR_TYPE = {"signup": "TIMEOUT", "purchase": "VALIDATION", "click": "AUTHENTICATION_ERROR"}


@query("p25_retryable", f"""SELECT event_id, code IN ('DEADLINE_EXCEEDED', 'INTERNAL', 'RESOURCE_EXHAUSTED', 'SERVICE_UNAVAILABLE') OR type IN ('NETWORK', 'TIMEOUT', 'PARSING') AS retryable
FROM (SELECT event_id, {st.one_of_sql('event_type', ERROR_CODE, 'UNKNOWN')} AS code, {st.one_of_sql('event_type', ERROR_TYPE, 'NONE')} AS type FROM events)""")
def p25(spark, sf):
    code, kind = st.one_of(F.col("event_type"), ERROR_CODE, "UNKNOWN"), st.one_of(F.col("event_type"), ERROR_TYPE, "NONE")
    return Tables(spark, sf).events.select("event_id", predicates.is_retryable(code, kind).alias("retryable"))


@query("p26_critical", f"SELECT event_id FROM events WHERE {st.one_of_sql('event_type', ERROR_TYPE, 'NONE')} IN ('AUTHENTICATION_ERROR', 'INTERNAL_ERROR')")
def p26(spark, sf):
    kind = st.one_of(F.col("event_type"), ERROR_TYPE, "NONE")
    return Tables(spark, sf).events.where(predicates.is_critical(kind)).select("event_id")


@query("p27_lookup", """SELECT k AS o_orderkey, o_orderstatus, o_orderdate IS NOT NULL AS found FROM (
  SELECT DISTINCT l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderstatus = 'P') LEFT JOIN orders ON k = orders.o_orderkey""")
def p27(spark, sf):
    t = Tables(spark, sf)
    wanted = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().unionByName(
        t.orders.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey")))
    return joins.look_up(t.orders, wanted, "o_orderkey").select(
        "o_orderkey", "o_orderstatus", F.col("o_orderdate").isNotNull().alias("found"))


# --- ordering and paging ----------------------------------------------------------------

PAGED = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey"


def listing(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("fileSize"), F.col("o_orderstatus").alias("status"),
                           F.col("o_orderdate").alias("createdAt"))


@query("l01_sort", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders
QUALIFY position <= 100""")
def l01(spark, sf):
    keys = paging.sort_keys("createdAt", "desc", "o_orderkey")
    rows = paging.page_of(listing(Tables(spark, sf)), keys, 1, 100)
    position = F.row_number().over(Window.orderBy(*keys)).cast("bigint")
    return rows.select("o_orderkey", "createdAt").select("o_orderkey", position.alias("position"))


@query("l02_page", f"{PAGED} LIMIT 20 OFFSET 60")
def l02(spark, sf):
    rows = listing(Tables(spark, sf)).where("status = 'F'")
    return paging.page_of(rows, paging.sort_keys("fileSize", "desc", "o_orderkey"), 4, 20).select(
        "o_orderkey", F.col("fileSize").alias("o_totalprice"))


@query("l02_deep_page", f"{PAGED} LIMIT 20 OFFSET 2400")
def l02_deep(spark, sf):
    rows = listing(Tables(spark, sf)).where("status = 'F'")
    pages = paging.directory(rows, paging.sort_keys("fileSize", "desc", "o_orderkey"), "l02", 1000)
    return paging.page_from(pages, 121, 20).select("o_orderkey", F.col("fileSize").alias("o_totalprice"))


@query("l03_envelope", f"""SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, 2 AS page, 25 AS page_size,
  50 < (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS has_next FROM ({PAGED} LIMIT 25 OFFSET 25)""")
def l03(spark, sf):
    asked = paging.DataQuery(filters={"status": "F"}, page=2, page_size=25, sort_field="fileSize", order="desc")
    return paging.run(listing(Tables(spark, sf)), asked, "o_orderkey").select("o_orderkey", "total", "page", "page_size", "has_next")


@query("l04_keyset", """SELECT o_orderkey, o_totalprice, n > 50 AS has_next, CASE WHEN n > 50 THEN max(o_totalprice) OVER () END AS next_sort FROM (
  SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders WHERE o_totalprice > 250000.0 OR (o_totalprice = 250000.0 AND o_orderkey > 10))
WHERE place <= 50""")
def l04(spark, sf):
    page = paging.after_cursor(Tables(spark, sf).orders, "o_totalprice", "o_orderkey", (250000.0, 10), 50)
    return page.select("o_orderkey", "o_totalprice", "has_next", "next_sort")


@query("l04_keyset_down", """SELECT o_orderkey, v, n > 40 AS has_next FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY v DESC NULLS LAST, o_orderkey) AS place FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS v FROM orders) WHERE v IS NULL OR v < 100000.0 OR (v = 100000.0 AND o_orderkey > 10)) WHERE place <= 40""")
def l04_down(spark, sf):
    rows = Tables(spark, sf).orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("v"))
    return paging.after_cursor(rows, "v", "o_orderkey", (100000.0, 10), 40, "desc").select("o_orderkey", "v", "has_next")


@query("l05_export_cap", "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000")
def l05(spark, sf):
    return paging.export_rows(Tables(spark, sf).orders, "o_orderdate", "o_orderkey", fixed.EXPORT_CAP).select("o_orderkey", "o_orderstatus", "total")


@query("l06_content_limits", """SELECT doc_id, length(text) > 1000000 AS over_text, length(text) > 10485760 AS over_html, md5(substr(text, 1, 5000)) AS kept, length(text) > 5000 AS cut FROM documents""")
def l06(spark, sf):
    limited = paging.within_limit(F.col("text"), 5000)
    return Tables(spark, sf).documents.select(
        "doc_id", (F.length("text") > fixed.MAX_TEXT_LENGTH).alias("over_text"), (F.length("text") > fixed.MAX_HTML_SIZE).alias("over_html"),
        F.md5(limited["text"]).alias("kept"), limited["cut"].alias("cut"))


@query("a09_page_totals", "SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM orders WHERE o_orderstatus = 'P'")
def a09(spark, sf):
    return paging.page_totals(Tables(spark, sf).orders.where("o_orderstatus = 'P'"), 20)


@query("f14_context_window", """SELECT doc_id, CASE WHEN p IS NOT NULL THEN substr(text, greatest(p - 1 - 50, 0) + 1, least(length(text), p - 1 + 4 + 50) - greatest(p - 1 - 50, 0)) END AS context
FROM (SELECT doc_id, text, nullif(strpos(text, 'the '), 0) AS p FROM documents)""")
def f14(spark, sf):
    at = F.nullif(F.instr(F.col("text"), "the "), F.lit(0)) - 1  # no hit: no context
    return Tables(spark, sf).documents.select("doc_id", F.when(at.isNotNull(), tx.context_window(F.col("text"), at, at + 4)).alias("context"))

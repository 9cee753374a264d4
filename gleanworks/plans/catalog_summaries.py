"""Registered queries: joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.functions import scores, shapes, urls
from gleanworks.operators import aggregates as ag, joins, percentiles
from gleanworks.plans import flows, standins as st
from gleanworks.plans.catalog_rows import GRANTS_SQL, LATEST_SQL, ROLE, latest_status
from gleanworks.plans.catalog_rules import PREVIOUS_SQL, status_changes
from gleanworks.plans.registry import Tables, query

HOUR = "strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S')"


def stamped(df, column="window_start"):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


# --- quality -----------------------------------------------------------------------------


@query("a01_quality_status", f"""SELECT lang, {st.STATUS_SQL} AS status, count(*) AS n, round(avg(average), 4) AS avg_score
FROM ({st.SCORED_SQL}) GROUP BY 1, 2""")
def a01(spark, sf):
    rows = flows.scored(Tables(spark, sf).documents.select("lang", "text"), "text")
    return rows.groupBy("lang", "status").agg(F.count("*").alias("n"), F.round(F.avg("average"), 4).alias("avg_score"))


@query("a02_text_completeness", f"SELECT doc_id, round({st.COMPLETENESS_SQL}, 6) AS completeness FROM documents")
def a02(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.round(scores.text_completeness(F.col("text")), 6).alias("completeness"))


@query("a03_text_consistency", f"SELECT doc_id, round({st.CONSISTENCY_SQL}, 6) AS consistency FROM documents")
def a03(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.round(scores.text_consistency(F.col("text")), 6).alias("consistency"))


PARTS = {"title": "(?is)<title[^>]*>(.*?)</title>", "h1": "(?is)<h1[^>]*>(.*?)</h1>", "table": "(?is)<table[^>]*>(.*?)</table>"}


@query("a04_required_fields", "SELECT page_id, round((" + " + ".join(
    f"(length(regexp_extract(html, '{p}', 1)) > 0)::INT" for p in PARTS.values()) + ") / 3.0, 6) AS completeness FROM pages")
def a04(spark, sf):
    fields = [F.regexp_extract("html", pattern, 1) for pattern in PARTS.values()]
    return Tables(spark, sf).pages.select("page_id", F.round(scores.field_completeness(fields), 6).alias("completeness"))


@query("a05_confidence", """SELECT p_partkey, round((coalesce(list_avg(list_transform(string_split(p_name, ' '), lambda x: 0.8::DOUBLE * least(length(x) / 20.0::DOUBLE, 1.0))), 0)
  + CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 0.95 ELSE 0 END) / 2, 6) AS confidence FROM part""")
def a05(spark, sf):
    entities = F.transform(F.split("p_name", " "), lambda word: scores.entity_confidence(word))
    none = F.array().cast("array<double>")
    categories = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), F.array(F.lit(0.95))).otherwise(none)
    return Tables(spark, sf).part.select("p_partkey", F.round(scores.combined_confidence(entities, categories), 6).alias("confidence"))


SCORED_PAGES_SQL = "SELECT *, least(length(text) / 1000.0::DOUBLE, 1.0) AS confidence FROM conversations"


def scored_pages(t: Tables):
    return t.conversations.withColumn("confidence", F.least(F.length("text") / F.lit(1000.0), F.lit(1.0)))


@query("a06_page_rollup", f"""SELECT conv_id, trim(string_agg(text, ' ' ORDER BY turn)) AS text, round(avg(confidence), 6) AS confidence,
  count(*) AS pages FROM ({SCORED_PAGES_SQL}) GROUP BY 1""")
def a06(spark, sf):
    rows = ag.page_rollup(scored_pages(Tables(spark, sf)), "conv_id", "turn", "text", "confidence", join_text=True)
    return rows.select("conv_id", "text", F.round("confidence", 6).alias("confidence"), "pages")


@query("a06_page_summary", f"""SELECT conv_id, count(*) AS pages, count(DISTINCT turn) AS page_numbers, sum(length(text))::BIGINT AS characters, round(avg(confidence), 6) AS confidence,
  min(confidence) AS least_confidence, max(confidence) AS most_confidence FROM ({SCORED_PAGES_SQL}) GROUP BY 1""")
def a06_summary(spark, sf):
    return ag.page_rollup(scored_pages(Tables(spark, sf)), "conv_id", "turn", "text", "confidence").withColumn("confidence", F.round("confidence", 6))


@query("a06_ordered_pages", "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn")
def a06_pages(spark, sf):
    return ag.ordered_pages(Tables(spark, sf).conversations, "conv_id", "turn", "text")


# --- counts and summaries ------------------------------------------------------------------


@query("a07_list_summary", """SELECT sum(n)::BIGINT AS total, '{' || string_agg('"' || o_orderstatus || '":' || n::VARCHAR, ',' ORDER BY o_orderstatus) || '}' AS by_status,
  round(sum(t) / sum(n), 2) AS avg_duration, round(sum(CASE WHEN o_orderstatus = 'F' THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS failure_rate
FROM (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1)""")
def a07(spark, sf):
    summary = ag.list_summary(Tables(spark, sf).orders, "o_orderstatus", "o_totalprice", F.col("o_orderstatus") == "F")
    return summary.select("total", F.to_json("by_status").alias("by_status"), F.round("avg_duration", 2).alias("avg_duration"),
                          F.round("failure_rate", 6).alias("failure_rate"))


@query("a10_batch_stats", """SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS succeeded, count(*) FILTER (l_returnflag = 'R') AS failed,
  round(sum(l_quantity), 4) AS total_duration, round(avg(l_quantity), 4) AS avg_duration FROM lineitem GROUP BY 1""")
def a10(spark, sf):
    stats = ag.batch_stats(Tables(spark, sf).lineitem, ["l_orderkey"], F.col("l_returnflag") != "R", F.col("l_quantity"))
    return stats.withColumns({c: F.round(c, 4) for c in ("total_duration", "avg_duration")})


@query("a11_job_metrics", """SELECT user_id, count(*) AS request_count, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS bytes_processed,
  count(*) FILTER (event_type = 'purchase') AS items_scraped, count(*) FILTER (event_type = 'error') AS error_count, round(avg(value), 6) AS avg_response_time,
  round(count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*), 6) AS success_rate, round(count(*) FILTER (event_type = 'signup') * 100.0::DOUBLE / count(*), 6) AS retry_rate
FROM events GROUP BY 1""")
def a11(spark, sf):
    kind = F.col("event_type")
    metrics = ag.job_metrics(
        Tables(spark, sf).events, "user_id", F.get_json_object("props", "$.k").cast("bigint"), F.col("value"), kind == "purchase",
        kind == "error", kind == "signup")
    return metrics.withColumns({c: F.round(c, 6) for c in ("avg_response_time", "success_rate", "retry_rate")})


PROGRESS = {"view": "PENDING", "click": "PROCESSING", "signup": "VALIDATING", "purchase": "COMPLETED", "error": "FAILED"}


@query("a12_progress", f"""SELECT user_id, least(round(100.0 * items / (items + 1)), 100)::BIGINT AS by_items,
  {st.one_of_sql('last', {"click": 50, "signup": 75, "purchase": 100}, 0)} AS by_status
FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS items, arg_max(event_type, ts) AS last FROM events GROUP BY 1)""")
def a12(spark, sf):
    rows = Tables(spark, sf).events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("items"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return rows.select("user_id", scores.items_progress(F.col("items")).alias("by_items"),
                       scores.status_progress(st.one_of(F.col("last"), PROGRESS, None)).alias("by_status"))


@query("a13_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a13(spark, sf):
    return ag.status_counts(Tables(spark, sf).events, "event_type")


@query("a14_histogram", """SELECT event_type, le, count(*) FILTER (value / 100 <= b) AS count, round(sum(value / 100), 4) AS total, count(*) AS n
FROM events, (VALUES ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1.0), ('1.5', 1.5), ('2.0', 2.0), ('5.0', 5.0), ('+Inf', 1e300)) v(le, b) GROUP BY 1, 2""")
def a14(spark, sf):
    rows = ag.histogram(Tables(spark, sf).events, ["event_type"], F.col("value") / 100, fixed.LATENCY_BUCKETS)
    return rows.withColumn("total", F.round("total", 4))


@query("a14_size_histogram", """SELECT le, count(*) FILTER (size <= b) AS count, sum(size)::BIGINT AS total, count(*) AS n
FROM (SELECT octet_length(encode(text)) AS size FROM documents), (VALUES ('512.0', 512), ('1024.0', 1024), ('5120.0', 5120), ('10240.0', 10240), ('51200.0', 51200), ('102400.0', 102400), ('+Inf', 1000000000000)) v(le, b) GROUP BY 1""")
def a14_size(spark, sf):
    return ag.histogram(Tables(spark, sf).documents, [], F.octet_length("text").cast("bigint"), fixed.SIZE_BUCKETS)


@query("a15_last_gauge", """SELECT user_id, event_type, arg_max(value, ts) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1, 2""")
def a15(spark, sf):
    return stamped(ag.last_value(Tables(spark, sf).events, ["user_id", "event_type"], "value", ["ts", "event_id"]), "at")


@query("a16_distinct_pages", "SELECT conv_id, count(*) AS pages, count(DISTINCT turn // 2) AS numbers FROM conversations GROUP BY 1")
def a16(spark, sf):
    return Tables(spark, sf).conversations.groupBy("conv_id").agg(
        F.count("*").alias("pages"), F.count_distinct(F.floor(F.col("turn") / 2)).alias("numbers"))


@query("a17_percentiles", """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2""")
def a17(spark, sf):
    rows = Tables(spark, sf).events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    found = percentiles.percentiles(rows, ["event_type", "day"], F.col("value"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.withColumns({p: F.round(p, 6) for p in ("p50", "p95", "p99")})


@query("a17_price_percentiles", """SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1""")
def a17_prices(spark, sf):
    found = percentiles.percentiles(Tables(spark, sf).orders, ["o_orderstatus"], F.col("o_totalprice"), {"p50": 0.5, "p99": 0.99})
    return found.withColumns({p: F.round(p, 4) for p in ("p50", "p99")})


@query("a18_nearest_rank", """SELECT event_type, list_sort(list(value))[greatest(ceil(0.95 * count(*)), 1)::BIGINT] AS nearest, list_sort(list(value))[least(floor(0.95 * count(*)) + 1, count(*))::BIGINT] AS by_floor
FROM events GROUP BY 1""")
def a18(spark, sf):
    events = Tables(spark, sf).events
    nearest = percentiles.percentiles(events, ["event_type"], F.col("value"), {"nearest": 0.95}, "nearest")
    by_floor = percentiles.percentiles(events, ["event_type"], F.col("value"), {"by_floor": 0.95}, "floor")
    return nearest.join(by_floor, "event_type")


# --- aligned series --------------------------------------------------------------------------


@query("a19_reducers", f"""SELECT window_start, event_type, round(avg(v), 8) AS mean, max(v) AS max, round(sum(v), 6) AS sum, count(*) AS count
FROM (SELECT {HOUR} AS window_start, event_type, user_id, max(value) AS v FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def a19(spark, sf):
    series = ag.align(Tables(spark, sf).events, ["event_type", "user_id"], "ts", F.col("value"), 3600, "max")
    rows = ag.reduce_series(series, ["event_type"], ["mean", "max", "sum", "count"])
    return stamped(rows.withColumn("mean", F.round("mean", 8)).withColumn("sum", F.round("sum", 6)))


@query("a20_aligners", f"""SELECT {HOUR} AS window_start, event_type, round(avg(value), 8) AS mean, max(value) AS max, round(sum(value), 6) AS sum, round(sum(value) / 3600, 6) AS rate
FROM events GROUP BY 1, 2""")
def a20(spark, sf):
    rows = ag.align(Tables(spark, sf).events, ["event_type"], "ts", F.col("value"), 3600, ["mean", "max", "sum", "rate"])
    return stamped(rows.withColumns({c: F.round(c, 8 if c == "mean" else 6) for c in ("mean", "sum", "rate")}))


@query("a20_percentile_aligner", f"SELECT {HOUR} AS window_start, event_type, round(quantile_cont(value, 0.95), 6) AS value FROM events GROUP BY 1, 2")
def a20_percentile(spark, sf):
    rows = ag.align_percentile(Tables(spark, sf).events, ["event_type"], "ts", F.col("value"), 3600, 0.95)
    return stamped(rows.withColumn("value", F.round("value", 6)))


@query("a21_error_rate", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_rate FROM events GROUP BY 1""")
def a21(spark, sf):
    return ag.error_rate(Tables(spark, sf).events, ["user_id"], F.col("event_type") == "error").withColumn("error_rate", F.round("error_rate", 6))


@query("a22_daily_report", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS avg_duration, max(value) AS max_duration FROM events GROUP BY 1""")
def a22(spark, sf):
    rows = ag.daily_report(Tables(spark, sf).events, "ts", F.col("event_type") == "error", F.col("value"))
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("avg_duration", F.round("avg_duration", 6))


@query("a23_throughput", f"""SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(n, 0) AS n, coalesce(n, 0) < 3 AS below_floor
FROM (SELECT unnest(generate_series(min(time_bucket(INTERVAL 1 HOUR, ts)), max(time_bucket(INTERVAL 1 HOUR, ts)), INTERVAL 1 HOUR)) AS h FROM events)
LEFT JOIN (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, count(*) AS n FROM events GROUP BY 1) ON h = b""")
def a23(spark, sf):
    return stamped(ag.hourly_throughput(Tables(spark, sf).events, "ts", floor=3), "hour")


@query("a24_active_jobs", f"SELECT 'source-' || (job_id % 5)::VARCHAR AS source, count(*) AS active FROM ({LATEST_SQL}) WHERE status = 'RUNNING' GROUP BY 1")
def a24(spark, sf):
    running = latest_status(Tables(spark, sf)).where("status = 'RUNNING'")
    source = F.concat(F.lit("source-"), F.pmod("job_id", F.lit(5)).cast("string"))
    return running.groupBy(source.alias("source")).agg(F.count("*").alias("active"))


@query("a25_duplicates", "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1")
def a25(spark, sf):
    return ag.duplicates(Tables(spark, sf).documents, F.col("text"), "doc_id")


# --- joins ------------------------------------------------------------------------------------


@query("j01_merge", """SELECT d.doc_id, md5(d.text) AS raw, l.quality AS processed, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def j01(spark, sf):
    t = Tables(spark, sf)
    raw = t.documents.select("doc_id", F.md5("text").alias("raw"))
    return joins.merge_by_id(raw, t.labels.select("doc_id", F.col("quality").alias("processed")), t.documents.select("doc_id", "source"), "doc_id")


@query("j02_lineage", """SELECT c_custkey, count(DISTINCT o_orderkey) AS raw_records, count(*) AS processed, round(sum(l_quantity), 2) AS quantity
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def j02(spark, sf):
    t = Tables(spark, sf)
    raw = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    # Quantities are combined per order before the join, so a customer's lines never gather row by row.
    processed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    chain = joins.lineage(t.customer.select("c_custkey"), raw, processed, "c_custkey", "o_orderkey")
    return chain.groupBy("c_custkey").agg(
        F.count("*").alias("raw_records"), F.sum("n").alias("processed"), F.round(F.sum("q"), 2).alias("quantity"))


@query("j03_document_chain", """SELECT d.doc_id, c.turn, l.quality FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def j03(spark, sf):
    t = Tables(spark, sf)
    ocr = t.conversations.select(F.col("conv_id").alias("doc_id"), "turn")
    return joins.lineage(t.documents.select("doc_id"), ocr, t.labels.select("doc_id", "quality"), "doc_id", "doc_id", "left")


@query("j04_job_results", f"SELECT j.job_id, e.event_id FROM ({LATEST_SQL}) j JOIN events e ON e.user_id = j.job_id WHERE j.status = 'COMPLETED'")
def j04(spark, sf):
    t = Tables(spark, sf)
    done = latest_status(t).where("status = 'COMPLETED'").select("job_id")
    results = t.events.select(F.col("user_id").alias("job_id"), "event_id")
    return joins.salted_join(results, done, ["job_id"], F.col("event_id"))


@query("j05_scheduled_jobs", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def j05(spark, sf):
    t = Tables(spark, sf)
    active = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.having(t.customer.select("c_custkey"), active, "c_custkey")


@query("j06_effective_permissions", f"""SELECT c_custkey, resource, action FROM (SELECT c_custkey, {st.one_of_sql('c_mktsegment', ROLE, 'GUEST')} AS r FROM customer) JOIN {GRANTS_SQL} ON role = r""")
def j06(spark, sf):
    users = Tables(spark, sf).customer.select("c_custkey", st.one_of(F.col("c_mktsegment"), ROLE, "GUEST").alias("role"))
    return users.join(joins.permissions_table(spark), "role").select("c_custkey", "resource", "action")


@query("j07_orphans", """SELECT 'documents' AS kind, doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'customers', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j07(spark, sf):
    t = Tables(spark, sf)
    documents = joins.orphans(t.documents.select("doc_id"), t.labels, "doc_id")
    customers = joins.orphans(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return documents.select(F.lit("documents").alias("kind"), F.col("doc_id").alias("key")).unionByName(
        customers.select(F.lit("customers").alias("kind"), F.col("c_custkey").alias("key")))


@query("j08_invalid_pairs", f"""SELECT previous, status, count(*) AS n FROM ({PREVIOUS_SQL}) WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM
 (VALUES ('PENDING','RUNNING'),('PENDING','FAILED'),('RUNNING','COMPLETED'),('RUNNING','FAILED'),('RUNNING','RETRYING'),('RETRYING','RUNNING'),('RETRYING','FAILED'),('FAILED','RETRYING')) p(a, b)
 WHERE a = previous AND b = status) GROUP BY 1, 2""")
def j08(spark, sf):
    bad = joins.invalid_transitions(status_changes(Tables(spark, sf)), spark, strict=False)
    return bad.groupBy("previous", "status").agg(F.count("*").alias("n"))


@query("j09_policy_join", """SELECT rule, limit_n, count(*) AS n FROM events JOIN (VALUES ('click', 'query', 100), ('purchase', 'write', 50), ('error', 'delete', 20)) p(t, rule, limit_n) ON event_type = t GROUP BY 1, 2""")
def j09(spark, sf):
    kind = st.one_of(F.col("event_type"), {"click": "query", "purchase": "write", "error": "delete"}, None)
    rules = joins.rule_table(spark, fixed.RATE_LIMITS, "rule string, seconds int, limit_n int")
    counts = Tables(spark, sf).events.withColumn("rule", kind).groupBy("rule").agg(F.count("*").alias("n"))
    return counts.join(rules, "rule").select("rule", "limit_n", "n")


@query("j10_mime_lookup", f"""SELECT doc_id, CASE lower(regexp_extract(file_name, '\\.([^./]*)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg'
  ELSE 'application/octet-stream' END AS mime FROM ({st.DOCUMENT_FILES_SQL})""")
def j10(spark, sf):
    ext = F.regexp_replace(urls.extension(F.col("metadata.fileName")), r"^\.", "")
    return st.document_files(Tables(spark, sf)).select("doc_id", shapes.mime_for_extension(ext).alias("mime"))


@query("j11_cascade_keys", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def j11(spark, sf):
    t = Tables(spark, sf)
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = joins.orphans(t.lineitem.select("l_orderkey", "l_returnflag"), gone, "l_orderkey")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("j12_config_defaults", """SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN c_nationkey ELSE 3 END AS retries, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'WEBSITE' END AS type, 30000 AS timeout FROM customer""")
def j12(spark, sf):
    own = Tables(spark, sf).customer.select(
        "c_custkey", F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")).alias("retries"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("type"))
    return joins.with_defaults(own, {"retries": 3, "type": "WEBSITE", "timeout": 30000})


@query("j13_batch_requests", "SELECT l_orderkey, l_linenumber, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) AS success FROM lineitem")
def j13(spark, sf):
    t = Tables(spark, sf)
    requests = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.batch_outcome(requests, t.orders.where("o_totalprice > 100000"), "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")

"""Registered queries: pages, texts, protection and the end-to-end flows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanworks import fixed
from gleanworks.functions import privacy, scores, shapes, text as tx, times, urls
from gleanworks.operators import html, language, protection, validation
from gleanworks.plans import extensions, flows, standins as st
from gleanworks.plans.catalog_sources import unified
from gleanworks.plans.registry import Tables, query
from gleanworks.sources import files

PII_SQL = "(" + " OR ".join(f"regexp_matches(text, '{pattern}')" for pattern in fixed.PII_DETECT.values()) + ")"


def _mentions_sql() -> str:
    """All mentions of a text as a list of (text, type, confidence), floor applied."""
    lists = [
        f"list_transform(regexp_extract_all(text, '{rule.pattern}'), lambda x: {{'e': x, 'kind': '{rule.kind}', "
        f"'p': {fixed.DEFAULT_ENTITY_CONFIDENCE if rule.score is None else rule.score}::DOUBLE * least(length(x) / 20.0::DOUBLE, 1.0)}})"
        for rule in language.ENTITY_RULES
    ]
    return f"list_filter(flatten([{', '.join(lists)}]), lambda m: m.p >= {fixed.MIN_ENTITY_CONFIDENCE})"


ENTITIES_SQL = f"list_transform({_mentions_sql()}, lambda m: m.p)"
CLASSES_SQL = """list_filter([CASE WHEN contains(lower(text), 'mg') OR contains(lower(text), 'dosage') THEN 0.95::DOUBLE END,
  CASE WHEN contains(lower(text), 'trial') OR contains(lower(text), 'study') THEN 0.90::DOUBLE END], lambda x: x IS NOT NULL)"""


def unescape_sql(value: str) -> str:
    # HTML reads these four names with or without the closing semicolon.
    pairs = [("&quot;?", '"'), ("&middot;?", "·"), ("&copy;?", "©"), ("&amp;?", "&")]
    for name, mark in pairs:
        value = f"regexp_replace({value}, '{name}', '{mark}', 'g')"
    return value


# --- pages -----------------------------------------------------------------------------------


@query("x01_selectors", f"""SELECT page_id, 'heading' AS name, trim({unescape_sql("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")}) AS content, 1 AS matches, NULL AS error, length(html) AS size FROM pages
UNION ALL SELECT page_id, 'title', trim({unescape_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}), 1, NULL, length(html) FROM pages
UNION ALL SELECT page_id, 'menu', trim({unescape_sql("list_aggregate(regexp_extract_all(html, '<a href=[^>]*>([^<]*)</a>', 1), 'string_agg', '')")}), len(regexp_extract_all(html, '<a href=[^>]*>([^<]*)</a>', 1))::INTEGER, NULL, length(html) FROM pages
UNION ALL SELECT page_id, 'advert', trim({unescape_sql("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}), 1, NULL, length(html) FROM pages
UNION ALL SELECT page_id, 'price', '', 0, 'REQUIRED_MISSING', length(html) FROM pages""")
def x01(spark, sf):
    return html.extract_selectors(Tables(spark, sf).pages, "page_id", "html", {
        "heading": {"selector": "article h1", "required": True}, "title": "title", "menu": "nav ul a", "advert": "div.ad",
        "price": {"selector": "#price", "required": True}})


def _rewritten_sql(value: str, *steps: tuple[str, str]) -> str:
    for pattern, put in steps:
        value = f"regexp_replace({value}, '{pattern}', '{put}', 'g')"
    return value


# The given pages use few tags; only bold paragraphs stay open, and a browser closes them before what follows their line break.
CLEAN_SQL = _rewritten_sql(
    "html", ("[\\s\\p{Z}]+", " "), ("(?s)<!--.*?-->|<style>.*?</style>|<script>.*?</script>", ""), ("<br>(</p>)?(<p>|</article>|<footer>|$)", "<br /></b></p>\\2"),
    ("</?(html|head|meta|title|body|nav|article|footer)[^>]*>|<!DOCTYPE html>", ""),
    ('<a href="([^"]*)">', '<a href="\\1" target="_blank" rel="noopener noreferrer">'), ("&quot;", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&nbsp;?", " "))


@query("x02_sanitise", f"SELECT page_id, trim({CLEAN_SQL}) AS clean_html FROM pages")
def x02(spark, sf):
    return html.sanitise(Tables(spark, sf).pages, "html").select("page_id", "clean_html")


@query("x02_sanitised_shape", f"""SELECT page_id, len(regexp_extract_all(html, '<a href="[^"]*"')) AS links, len(regexp_extract_all(html, '<li>')) AS items, false AS unsafe,
  contains(html, '<h1>') AS headed, false AS commented FROM pages""")
def x02_shape(spark, sf):
    clean = F.col("clean_html")
    rows = html.sanitise(Tables(spark, sf).pages, "html")
    return rows.select(
        "page_id", F.regexp_count(clean, F.lit('<a href="[^"]*" target="_blank" rel="noopener noreferrer">')).cast("bigint").alias("links"),
        F.regexp_count(clean, F.lit("<li>")).cast("bigint").alias("items"), clean.rlike("(?i)<(script|style|title|meta|article|nav)").alias("unsafe"),
        F.contains(clean, F.lit("<h1>")).alias("headed"), F.contains(clean, F.lit("<!--")).alias("commented"))


@query("x03_content_metadata", f"""SELECT doc_id, octet_length(encode(text)) AS size, len(regexp_split_to_array(text, '{st.GAP_SQL}')) AS item_count, 'text/html' AS format,
  'text/html; charset=utf-8' AS content_type, sha256(text) AS checksum, 'VALID' AS validation_status, round({st.COMPLETENESS_SQL}, 6) AS completeness, 1.0::DOUBLE AS accuracy,
  round({st.CONSISTENCY_SQL}, 6) AS consistency, 1.0::DOUBLE AS freshness FROM documents""")
def x03(spark, sf):
    rows = Tables(spark, sf).documents.select("doc_id", html.content_metadata(F.col("text")).alias("m")).select("doc_id", "m.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("completeness", "consistency")})


# Accuracy: the share of three rules kept; freshness: results came minute by minute, the run is two thousand minutes in.
MEASURED_NOW = "2024-01-02 09:20:00"
MEASURED_SQL = f"""WITH m AS (SELECT doc_id, {st.COMPLETENESS_SQL} AS completeness, {st.CONSISTENCY_SQL} AS consistency,
    ((CASE WHEN lang <> 'es' THEN 1 ELSE 0 END) + (CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END) + (CASE WHEN contains(text, '@') THEN 0 ELSE 1 END)) / 3.0::DOUBLE AS accuracy,
    CASE WHEN 2000 - doc_id <= 15 THEN 1.0::DOUBLE ELSE 15.0::DOUBLE / (2000 - doc_id) END AS freshness FROM documents),
  a AS (SELECT *, round((completeness + accuracy + consistency + freshness) / 4 * 100, 6) AS average FROM m)
SELECT doc_id, round(accuracy, 6) AS accuracy, round(freshness, 6) AS freshness, round(average, 4) AS average, {st.STATUS_SQL} AS status,
  'EXTRACT' AS operation, CASE WHEN {st.STATUS_SQL} = 'INVALID' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome FROM a"""


@query("x03_measured_quality", MEASURED_SQL)
def x03_measured(spark, sf):
    rules = {"address": F.col("sourceUrl") != "", "long_enough": F.col("n_chars") >= 200, "no_address_in_text": ~F.contains("text", F.lit("@"))}
    rows = flows.measured(st.results(Tables(spark, sf)), "text", rules, F.col("timestamp"), st.naive(MEASURED_NOW))
    last = F.element_at("history", -1)
    return rows.select("doc_id", F.round("accuracy", 6).alias("accuracy"), F.round("freshness", 6).alias("freshness"), F.round("average", 4).alias("average"), "status",
                       last["operation"].alias("operation"), last["status"].alias("outcome"))


LINKS_SQL = """SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS position FROM (
  SELECT page_id, link, min(i) AS first FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || array_to_string(list_transform(string_split(h, ''), lambda c: CASE WHEN strlen(c) > 1 THEN url_encode(c) ELSE c END), '') AS link, i FROM (
    SELECT page_id, url, unnest(hrefs) AS h, unnest(range(len(hrefs))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))) GROUP BY 1, 2)"""


@query("x04_links", LINKS_SQL)
def x04(spark, sf):
    rows = html.extract_links(Tables(spark, sf).pages, "page_id", "html", "url")
    return rows.select("page_id", "link", F.col("position").cast("bigint").alias("position"))


@query("u01_distinct_links", f"SELECT DISTINCT link FROM ({LINKS_SQL})")
def u01(spark, sf):
    return html.extract_links(Tables(spark, sf).pages, "page_id", "html", "url").select("link").distinct()


TABLED = "<table><tr><th>Page</th><th>Address</th></tr><tr><td>{0}</td><td>{1}</td></tr><tr></tr><tr><td>end</td></tr></table>"


@query("x05_tables", """SELECT page_id, 0 AS table_no, 0 AS row_no, 'Page' AS header, page_id::VARCHAR AS cell FROM pages
UNION ALL SELECT page_id, 0, 0, 'Address', trim(url) FROM pages UNION ALL SELECT page_id, 0, 1, 'Page', 'end' FROM pages""")
def x05(spark, sf):
    before, between, after = TABLED.replace("{1}", "{0}").split("{0}")
    table = F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit(between), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(after))
    pages = Tables(spark, sf).pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), table)))
    rows = html.extract_tables(pages, "page_id", "html")
    return rows.select("page_id", "table_no", "row_no", F.explode("cells").alias("header", "cell"))


# --- texts -----------------------------------------------------------------------------------


@query("x06_entities", f"""SELECT doc_id, m.e AS text, m.kind AS type, round(m.p, 6) AS confidence, length(m.e) AS span, m.kind = 'EMAIL' AS is_pii, true AS in_context
FROM (SELECT doc_id, unnest({_mentions_sql()}) AS m FROM ({st.MENTIONED_SQL}))""")
def x06(spark, sf):
    found = language.extract_entities(st.mentioned(Tables(spark, sf).documents), "doc_id", "text")
    return found.select("doc_id", "text", "type", F.round("confidence", 6).alias("confidence"), (F.col("end") - F.col("start")).alias("span"), "is_pii",
                        F.contains("context", F.col("text")).alias("in_context"))


TURN_NOTE = {"user": " A Study.", "assistant": " Take 5 MG."}
CLASSIFIED_TEXT = f"""SELECT conv_id AS key, turn, text || {st.one_of_sql('role', TURN_NOTE, '')} AS text FROM conversations
UNION ALL SELECT doc_id, -1, text FROM documents"""


@query("x07_classify", f"""SELECT key, turn, c AS category, p::DOUBLE AS confidence, s AS subcategories FROM ({CLASSIFIED_TEXT}), (VALUES ('DRUG_INFORMATION', 0.95, 'DOSAGE,INTERACTIONS', 'mg', 'dosage'),
  ('CLINICAL_TRIALS', 0.9, 'METHODOLOGY,RESULTS', 'trial', 'study')) r(c, p, s, a, b) WHERE contains(lower(text), a) OR contains(lower(text), b)""")
def x07(spark, sf):
    t = Tables(spark, sf)
    noted = F.concat("text", st.one_of(F.col("role"), TURN_NOTE, ""))
    texts = t.conversations.select(F.col("conv_id").alias("key"), "turn", noted.alias("text")).unionByName(
        t.documents.select(F.col("doc_id").alias("key"), F.lit(-1).alias("turn"), "text"))
    return texts.select("key", "turn", F.explode(language.categories(F.col("text"))).alias("c")).select(
        "key", "turn", "c.category", "c.confidence", F.array_join("c.subcategories", ",").alias("subcategories"))


@query("x08_pii_flag", f"SELECT doc_id, {PII_SQL} AS pii FROM documents")
def x08(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", privacy.has_pii(F.col("text")).alias("pii"))


MASKED_SQL = """CASE WHEN regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') THEN '[REDACTED email]' WHEN regexp_matches(text, '(\\+\\d{1,3}[- ]?)?\\d{10}') THEN '[REDACTED phone]'
  WHEN regexp_matches(text, '\\d{3}-\\d{2}-\\d{4}') THEN '[REDACTED ssn]' WHEN regexp_matches(text, '\\d{4}[- ]?\\d{4}[- ]?\\d{4}[- ]?\\d{4}') THEN '[REDACTED creditCard]' ELSE text END"""


@query("x09_redact", f"SELECT doc_id, md5({MASKED_SQL}) AS digest, {MASKED_SQL} LIKE '[REDACTED%' AS redacted FROM documents")
def x09(spark, sf):
    masked = protection.redacted(Tables(spark, sf).documents, ["text"])
    return masked.select("doc_id", F.md5("text").alias("digest"), F.col("text").startswith("[REDACTED").alias("redacted"))


@query("x09_redact_spans", """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '[REDACTED email]', 'g'),
  '(\\+\\d{1,3}[- ]?)?\\d{10}', '[REDACTED phone]', 'g'), '\\d{3}-\\d{2}-\\d{4}', '[REDACTED ssn]', 'g'), '\\d{4}[- ]?\\d{4}[- ]?\\d{4}[- ]?\\d{4}', '[REDACTED creditCard]', 'g')) AS digest FROM documents""")
def x09_spans(spark, sf):
    return protection.redacted(Tables(spark, sf).documents, ["text"], spans_only=True).select("doc_id", F.md5("text").alias("digest"))


ANALYSED_SQL = f"""SELECT doc_id, confidence, pii, CASE WHEN length(text) = 0 THEN 'UNREADABLE' WHEN confidence < 0.8 THEN 'LOW_CONFIDENCE' END AS reason FROM (
  SELECT *, (coalesce(list_avg({ENTITIES_SQL}), 0) + coalesce(list_avg({CLASSES_SQL}), 0)) / 2 AS confidence, {PII_SQL} AS pii FROM ({st.MENTIONED_SQL}))"""


@query("x10_nlp_gate", f"""SELECT doc_id, round(confidence, 6) AS confidence, pii AS pii_detected, reason, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM ({ANALYSED_SQL})""")
def x10(spark, sf):
    rows = language.analyse(st.mentioned(Tables(spark, sf).documents), "doc_id", "text")
    return rows.select("doc_id", F.round("confidence", 6).alias("confidence"), "pii_detected", "reason", "status")


@query("x11_chunks", """SELECT doc_id, i AS chunk_no, md5(substr(text, i * 2048 + 1, 2048)) AS digest FROM (
  SELECT doc_id, text, unnest(range(greatest((length(text) + 2047) // 2048, 1))) AS i FROM documents)""")
def x11(spark, sf):
    pieces = Tables(spark, sf).documents.select("doc_id", F.posexplode(tx.chunks(F.col("text"), 2048)).alias("chunk_no", "chunk"))
    return pieces.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("digest"))


@query("x12_document_metadata", f"""SELECT doc_id, file_name, CASE lower(regexp_extract(file_name, '\\.([^./]*)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg'
  ELSE 'application/octet-stream' END AS mime_type, octet_length(encode(text)) AS size, sha256(text) AS checksum, CASE WHEN n_chars > 1000 THEN '7y' ELSE '90d' END AS retention_policy,
  concat_ws(',', 'checksum-verified', CASE WHEN lang = 'en' THEN 'encrypted' END, CASE WHEN lang <> 'fr' THEN 'audit-enabled' END) AS compliance_flags FROM ({st.DOCUMENT_FILES_SQL})""")
def x12(spark, sf):
    rows = files.document_metadata(
        st.document_files(Tables(spark, sf)), "text", F.col("metadata.fileName"), F.col("n_chars") > 1000, F.col("lang") == "en", F.col("lang") != "fr")
    return rows.select("doc_id", "file_name", "mime_type", "size", "checksum", "retention_policy", F.array_join("compliance_flags", ",").alias("compliance_flags"))


# --- protection --------------------------------------------------------------------------------


def demonstration_keys() -> dict[int, bytes]:
    """Keys for these queries only; real ones come from the caller."""
    return {version: hashlib.sha256(f"key {version}".encode()).digest() for version in (1, 2)}


def sealed(t: Tables):
    keys, bind = demonstration_keys(), F.col("c_custkey")
    old = protection.encrypt(t.customer.where("c_nationkey < 12"), "c_name", keys, 1, bind)
    return old.unionByName(protection.encrypt(t.customer.where("c_nationkey >= 12"), "c_name", keys, 2, bind))


@query("x13_encrypt", "SELECT c_custkey, c_name AS opened, CASE WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS key_version, true AS hidden FROM customer")
def x13(spark, sf):
    opened = protection.decrypted("c_name", demonstration_keys(), F.col("c_custkey"))
    hidden = F.instr(F.hex("c_name"), F.hex(F.encode(F.lit("Customer"), "UTF-8"))) == 0
    return sealed(Tables(spark, sf)).select("c_custkey", opened.alias("opened"), "key_version", hidden.alias("hidden"))


@query("x14_decrypt_guard", "SELECT c_custkey, NULL::VARCHAR AS moved, NULL::VARCHAR AS wrong_key FROM customer")
def x14(spark, sf):
    keys = demonstration_keys()
    moved = protection.decrypted("c_name", keys, F.col("c_custkey") + 1)
    swapped = protection.decrypted("c_name", {1: keys[2], 2: keys[1]}, F.col("c_custkey"))
    return sealed(Tables(spark, sf)).select("c_custkey", moved.alias("moved"), swapped.alias("wrong_key"))


@query("x15_rotate_keys", "SELECT c_custkey, c_name AS opened, 2 AS key_version, c_nationkey < 12 AS rotated FROM customer")
def x15(spark, sf):
    keys, bind = demonstration_keys(), F.col("c_custkey")
    rows = protection.rotate(sealed(Tables(spark, sf)), "c_name", keys, 2, bind)
    return rows.select("c_custkey", protection.decrypted("c_name", keys, bind).alias("opened"), "key_version", "rotated")


@query("s27_store_records", f"""SELECT c_custkey, CASE WHEN secure THEN 'secure/' ELSE 'standard/' END || lower(classification) AS location, secure AS encrypted, c_name AS opened, '' AS refused
FROM (SELECT *, classification IN ('CONFIDENTIAL', 'RESTRICTED') AS secure FROM ({st.CLASSIFIED_SQL})) WHERE c_nationkey <> 3 AND c_acctbal > 0
UNION ALL SELECT c_custkey, NULL, NULL, NULL, concat_ws(',', CASE WHEN c_acctbal <= 0 THEN 'balance' END, CASE WHEN c_nationkey = 3 THEN 'checksum' END) FROM customer WHERE NOT (c_nationkey <> 3 AND c_acctbal > 0)""")
def s27_store(spark, sf):
    named = F.when(F.col("c_nationkey") == 3, F.concat("c_name", F.lit("?"))).otherwise(F.col("c_name"))
    rows = st.classified(Tables(spark, sf)).select("c_custkey", "c_name", "c_acctbal", "classification", F.sha2(named, 256).alias("checksum"))
    keys = demonstration_keys()
    stored, refused = flows.store_records(rows, "c_custkey", "c_name", "classification", {"balance": F.col("c_acctbal") > 0}, keys, 2, "s27")
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return stored.select("c_custkey", "location", "encrypted", flows.opened_content("c_name", keys, F.col("c_custkey")).alias("opened"), F.lit("").alias("refused")).unionByName(
        refused.select("c_custkey", text.alias("location"), flag.alias("encrypted"), text.alias("opened"), F.array_join("violations", ",").alias("refused")))


# --- terms -------------------------------------------------------------------------------------


@query("x16_key_phrases", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank, term, score FROM (
  SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS score FROM tf JOIN df USING (term))) WHERE rank <= 5""")
def x16(spark, sf):
    rows = language.key_phrases(Tables(spark, sf).documents, "doc_id", "text")
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


POLARITY = {"the": 0.5, "and": 0.25, "not": -1.0, "que": -0.25, "die": 0.125, "los": -0.5}


@query("x17_sentiment", """SELECT d.doc_id, round(coalesce(avg(p), 0), 6) AS polarity, count(p) AS hits FROM documents d LEFT JOIN (
  SELECT doc_id, p FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents)
  JOIN (VALUES ('the', 0.5::DOUBLE), ('and', 0.25), ('not', -1.0), ('que', -0.25), ('die', 0.125), ('los', -0.5)) l(w, p) ON w = term) h ON h.doc_id = d.doc_id GROUP BY 1""")
def x17(spark, sf):
    rows = language.sentiment(Tables(spark, sf).documents, "doc_id", "text", POLARITY)
    return rows.withColumn("polarity", F.round("polarity", 6))


# --- flows -------------------------------------------------------------------------------------


@query("x18_history", """SELECT doc_id, 'EXTRACT,TRANSFORM' AS operations, 'SUCCESS,' || CASE WHEN lang = 'es' THEN 'FAILURE' ELSE 'SUCCESS' END AS statuses,
  CASE WHEN lang = 'es' THEN 'VALIDATION_ERROR' END AS code FROM documents""")
def x18(spark, sf):
    rows = flows.with_history(st.results(Tables(spark, sf)), "EXTRACT", st.now(), F.lit(False))
    rows = flows.with_history(rows, "TRANSFORM", st.now(), F.col("sourceUrl") == "")
    return rows.select(
        "doc_id", F.array_join(F.transform("history", lambda s: s["operation"]), ",").alias("operations"),
        F.array_join(F.transform("history", lambda s: s["status"]), ",").alias("statuses"), F.col("history")[1]["error"]["code"].alias("code"))


@query("x19_process_results", f"""SELECT 'stored' AS part, id, {st.STATUS_SQL} AS status FROM (
  SELECT *, round((completeness + consistency + 2) / 4 * 100, 6) AS average FROM ({st.FULL_RESULTS_SQL})) WHERE source_url <> ''
UNION ALL SELECT 'raw', id, 'landed' FROM ({st.RESULTS_SQL}) WHERE source_url <> ''
UNION ALL SELECT 'processed', id, '1.0.0' FROM ({st.RESULTS_SQL}) WHERE source_url <> ''
UNION ALL SELECT 'quarantine', id, 'sourceUrl_present' FROM ({st.RESULTS_SQL}) WHERE source_url = ''""")
def x19(spark, sf):
    done = flows.process_results(st.results(Tables(spark, sf)), "text", st.now(), "x19")
    return (
        done.stored.select(F.lit("stored").alias("part"), "id", F.col("validation").alias("status"))
        .unionByName(done.raw.select(F.lit("raw").alias("part"), "id", F.lit("landed").alias("status")))
        .unionByName(done.processed.select(F.lit("processed").alias("part"), "id", F.col("schema_version").alias("status")))
        .unionByName(done.quarantine.select(F.lit("quarantine").alias("part"), "id", F.array_join("violations", ",").alias("status")))
    )


@query("x20_process_documents", f"""SELECT doc_id, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, 60000::BIGINT AS duration_ms, {st.uuid_sql('doc_id::VARCHAR')} AS trace_id FROM ({ANALYSED_SQL})""")
def x20(spark, sf):
    finished = F.timestamp_add("MINUTE", F.lit(1), st.now())
    rows = flows.process_documents(st.mentioned(Tables(spark, sf).documents), "doc_id", "text", st.now(), finished, "x20")
    return rows.select("doc_id", "status", "duration_ms", "trace_id")


# --- extension points ----------------------------------------------------------------------------


@query("e01_collectors", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url LIKE 'https:%' AS allowed FROM pages")
def e01(spark, sf):
    collectors = extensions.Collectors()
    collectors.register(
        "WEBSITE", lambda pages: pages.select("page_id", "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title")),
        lambda rows: rows.withColumn("allowed", urls.is_allowed(F.col("url"), https_only=True)).drop("url"))
    return collectors.run("WEBSITE", Tables(spark, sf).pages)


@query("e02_selector_config", f"""SELECT page_id, trim({unescape_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS content FROM pages""")
def e02(spark, sf):
    config = {"heading": {"selector": "h1", "type": "css", "required": True}}
    return html.extract_selectors(Tables(spark, sf).pages, "page_id", "html", config).select("page_id", "content")


JOB_SELECTORS = [
    (0, "heading", "article > h1", True), (0, "inner", "article > b", False), (0, "menu", "nav li > a[href^='/']", False),
    (1, "heading", "title", True), (1, "both", "nav > ul > li:first, h1", False), (1, "advert", "div[class~=ad], #none", False),
    (2, "price", "span.price[data-unit=eur]", True), (2, "encoding", "meta[charset], title", False),
]


@query("e02_job_selectors", f"""WITH p AS (SELECT page_id, page_id % 4 AS job, html, trim({unescape_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) AS h1, trim({unescape_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title,
  regexp_extract_all(html, '<a href=./[^>]*>([^<]*)</a>', 1) AS links, trim({unescape_sql("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")}) AS ad FROM pages)
SELECT page_id, job, 'heading' AS name, h1 AS content, 1 AS matches, NULL AS error FROM p WHERE job = 0 UNION ALL SELECT page_id, job, 'inner', '', 0, NULL FROM p WHERE job = 0
UNION ALL SELECT page_id, job, 'menu', trim({unescape_sql("list_aggregate(links, 'string_agg', '')")}), len(links)::INTEGER, NULL FROM p WHERE job = 0
UNION ALL SELECT page_id, job, 'heading', title, 1, NULL FROM p WHERE job = 1 UNION ALL SELECT page_id, job, 'both', '', 0, 'BAD_SELECTOR' FROM p WHERE job = 1
UNION ALL SELECT page_id, job, 'advert', ad, 1, NULL FROM p WHERE job = 1 UNION ALL SELECT page_id, job, 'price', '', 0, 'REQUIRED_MISSING' FROM p WHERE job = 2
UNION ALL SELECT page_id, job, 'encoding', title, 2, NULL FROM p WHERE job = 2""")
def e02_jobs(spark, sf):
    pages = Tables(spark, sf).pages.withColumn("job", F.col("page_id") % 4)
    selectors = spark.createDataFrame(JOB_SELECTORS, "job long, name string, selector string, required boolean")
    return html.extract_by_job(pages, "page_id", "html", "job", selectors)


@query("e03_text_extractor", """SELECT doc_id, md5(text) AS digest, round(least(1.0, octet_length(encode(text)) / 1000.0), 6) AS confidence, octet_length(encode(text)) // 2000 + 1 AS pages FROM documents""")
def e03(spark, sf):
    extractors = extensions.TextExtractors()
    size = F.octet_length(F.col("content"))
    extractors.register("text/plain", F.decode("content", "UTF-8"), F.least(F.lit(1.0), size / 1000), (F.floor(size / 2000) + 1).cast("bigint"))
    files_ = Tables(spark, sf).documents.select("doc_id", F.encode("text", "UTF-8").alias("content"), F.lit("text/plain").alias("mime"))
    rows = extractors.run(files_, "mime").where("extracted.supported")
    return rows.select("doc_id", F.md5("extracted.text").alias("digest"), F.round("extracted.confidence", 6).alias("confidence"), "extracted.pages")


@query("e04_text_step", "SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS letters, n_chars FROM documents")
def e04(spark, sf):
    steps = extensions.TextSteps()
    steps.add("letters", lambda text: (F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))).cast("bigint"))
    return steps.run(Tables(spark, sf).documents, "text").select("doc_id", "letters", "n_chars")


@query("e05_custom_metrics", "SELECT doc_id, round(n_chars / 1000.0, 6) AS kilo, (lang = 'en')::INT::DOUBLE AS english FROM documents")
def e05(spark, sf):
    rows = extensions.custom_metrics(Tables(spark, sf).documents, {"kilo": F.col("n_chars") / 1000, "english": F.col("lang") == "en"})
    return rows.select("doc_id", F.round(F.col("custom_metrics")["kilo"], 6).alias("kilo"), F.col("custom_metrics")["english"].alias("english"))


@query("e06_custom_rules", """SELECT rule_id, count(*) AS checked, count(*) FILTER (NOT ok) AS failed FROM (
  SELECT 'long_enough' AS rule_id, n_chars >= 200 AS ok FROM documents UNION ALL SELECT 'known_language', lang IN ('en', 'de') FROM documents) GROUP BY 1""")
def e06(spark, sf):
    rules = validation.custom({"long_enough": F.col("n_chars") >= 200, "known_language": F.col("lang").isin("en", "de")})
    return validation.report(Tables(spark, sf).documents, rules).select("rule_id", "checked", "failed")


# --- scalar functions ------------------------------------------------------------------------------


@query("f01_collapse_space", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '{st.GAP_SQL}', ' ', 'g'))) AS digest FROM documents")
def f01(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.md5(tx.collapse_space(F.col("text"))).alias("digest"))


@query("f02_strip_markup", "SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS without_comments FROM pages")
def f02(spark, sf):
    return Tables(spark, sf).pages.select("page_id", F.md5(tx.strip_comments(F.col("html"))).alias("without_comments"))


EMPTIED = ["p", "b", "li", "ul", "a", "h1", "div", "title", "nav", "article", "body", "head", "html", "footer", "script", "style"]


@query("f02_empty_elements", "SELECT page_id, (" + " + ".join(
    f"coalesce(list_sum(list_transform(regexp_extract_all(body, '<{tag}>[ \\t\\n\\x0B\\f\\r]*</{tag}>'), lambda x: length(x))), 0)" for tag in EMPTIED)
    + ")::BIGINT AS removed FROM (SELECT page_id, replace(replace(html, '<b>', '<b> </b><b>'), '</article>', '<p></p></article>') AS body FROM pages)")
def f02_empty(spark, sf):
    body = F.replace(F.replace("html", F.lit("<b>"), F.lit("<b> </b><b>")), F.lit("</article>"), F.lit("<p></p></article>"))
    removed = F.length(body) - F.length(tx.strip_empty_elements(body))
    return Tables(spark, sf).pages.select("page_id", removed.cast("bigint").alias("removed"))


@query("f03_split_counts", f"""SELECT doc_id, len(regexp_extract_all(text, '{st.WORD_SQL}')) AS words, len(regexp_extract_all(text, '[^.!?]+')) AS sentences,
  len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS lines FROM documents""")
def f03(spark, sf):
    text = F.col("text")
    counts = {"words": tx.words(text), "sentences": tx.sentences(text), "lines": tx.lines(text)}
    return Tables(spark, sf).documents.select("doc_id", *[F.size(c).cast("bigint").alias(n) for n, c in counts.items()])


@query("f04_byte_length", "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents")
def f04(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", tx.byte_length(F.col("text")).cast("bigint").alias("bytes"))


@query("f05_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def f05(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", shapes.checksum(F.col("text")).alias("sha"), F.md5("text").alias("md"))


@query("f07_extension", f"SELECT doc_id, lower(regexp_extract(file_name, '(\\.[^./]*)$', 1)) AS ext FROM ({st.DOCUMENT_FILES_SQL})")
def f07(spark, sf):
    return st.document_files(Tables(spark, sf)).select("doc_id", urls.extension(F.col("metadata.fileName")).alias("ext"))


@query("f09_pii_kinds", f"SELECT doc_id, regexp_matches(text, '{fixed.PII_DETECT['email']}') AS email, regexp_matches(text, '{fixed.PII_DETECT['phone']}') AS phone, regexp_matches(text, '{fixed.PII_DETECT['ssn']}') AS ssn FROM documents")
def f09(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", *[F.col("text").rlike(p).alias(n) for n, p in fixed.PII_DETECT.items()])


@query("f10_mask_value", f"SELECT doc_id, md5({MASKED_SQL}) AS shown FROM documents")
def f10(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.md5(privacy.mask_value(F.col("text"))).alias("shown"))


@query("f11_redact_fields", """SELECT c_custkey, '{"name":"' || c_name || '","token":"[REDACTED]","nested":{"apiKey":"[REDACTED]","segment":"' || c_mktsegment || '"}}' AS body FROM customer""")
def f11(spark, sf):
    kind = StructType.fromDDL("name string, token string, nested struct<apiKey:string,segment:string>")
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("t").alias("token"), F.struct(F.lit("k").alias("apiKey"), F.col("c_mktsegment").alias("segment")).alias("nested")))
    return Tables(spark, sf).customer.select("c_custkey", privacy.redact_json(body, kind).alias("body"))


@query("f12_json_round_trip", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, props IS NOT NULL AS kept FROM events")
def f12(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return Tables(spark, sf).events.select("event_id", parsed["k"].alias("k"), (F.to_json(parsed) == F.replace("props", F.lit(" "), F.lit(""))).alias("kept"))


@query("f13_dotted_path", "SELECT event_id, json_extract_string(props, '$.k') AS found, NULL::VARCHAR AS absent FROM events")
def f13(spark, sf):
    body = F.concat(F.lit('{"a":{"b":'), F.col("props"), F.lit("}}"))
    return Tables(spark, sf).events.select("event_id", shapes.json_value(body, "a.b.k").alias("found"), shapes.json_value(body, "a.c.k").alias("absent"))


@query("f15_keywords", "SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'que') AS found FROM documents")
def f15(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", tx.contains_any(F.col("text"), ["the", "que"]).alias("found"))


@query("f16_base64", "SELECT page_id, base64(encode(url)) AS encoded FROM pages")
def f16(spark, sf):
    return Tables(spark, sf).pages.select("page_id", shapes.base64_text(F.col("url")).alias("encoded"))


@query("f17_display_status", "SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS shown FROM customer")
def f17(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", tx.display_status(F.col("c_mktsegment")).alias("shown"))


@query("f18_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y/%m/%d') AS path FROM events")
def f18(spark, sf):
    return Tables(spark, sf).events.select("event_id", times.iso(F.col("ts")).alias("iso"), times.date_path(F.col("ts")).alias("path"))


@query("f19_plus_days", "SELECT o_orderkey, strftime(o_orderdate + to_days(90), '%Y-%m-%d %H:%M:%S') AS expiry FROM orders")
def f19(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", times.stamp(times.plus_days(F.col("o_orderdate"), F.lit(90))).alias("expiry"))


@query("f20_retention_policy", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 2555 ELSE 365 END AS days, CASE WHEN c_acctbal > 5000 THEN '7y' ELSE '90d' END AS literal FROM customer")
def f20(spark, sf):
    policy = F.when(F.col("c_mktsegment") == "BUILDING", "compliance").otherwise("standard")
    return Tables(spark, sf).customer.select(
        "c_custkey", times.compliance_retention_days(policy).alias("days"), times.retention_literal(F.col("c_acctbal") > 5000).alias("literal"))


@query("f23_clamp", "SELECT event_id, least(greatest(value, 5.0), 100.0) AS clamped, round(sqrt(value), 6) AS root, round(pow(value, 2.0), 4) AS square FROM events")
def f23(spark, sf):
    value = F.col("value")
    return Tables(spark, sf).events.select("event_id", times.clamp(value, 5.0, 100.0).alias("clamped"), F.round(F.sqrt(value), 6).alias("root"), F.round(F.pow(value, F.lit(2.0)), 4).alias("square"))


@query("f24_backoff", "SELECT event_id, least(500.0 * pow(1.5, k - 1), 20000.0)::DOUBLE AS delay_ms FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events)")
def f24(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return Tables(spark, sf).events.select("event_id", times.backoff_ms(k, 500, 1.5, 20000).alias("delay_ms"))


@query("f26_arrays", """SELECT p_partkey, len(w) AS size, len(list_filter(w, lambda x: length(x) > 4)) AS long_words, list_aggregate(list_transform(w, lambda x: upper(x)), 'string_agg', '-') AS shouted,
  list_bool_and(list_transform(w, lambda x: length(x) > 3)) AS every_long, w[1] AS first FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def f26(spark, sf):
    w = F.split("p_name", " ")
    return Tables(spark, sf).part.select(
        "p_partkey", F.size(w).cast("bigint").alias("size"), F.size(F.filter(w, lambda x: F.length(x) > 4)).cast("bigint").alias("long_words"),
        F.array_join(F.transform(w, F.upper), "-").alias("shouted"), F.forall(w, lambda x: F.length(x) > 3).alias("every_long"), w[0].alias("first"))


@query("f27_maps", "SELECT p_partkey, 'brand,size' AS keys, p_brand AS brand, p_size::VARCHAR AS size, 1 AS chosen FROM part")
def f27(spark, sf):
    defaults = F.create_map(F.lit("brand"), F.lit("none"), F.lit("size"), F.col("p_size").cast("string"))
    merged = shapes.merge_maps(defaults, F.create_map(F.lit("brand"), F.col("p_brand")))
    return Tables(spark, sf).part.select("p_partkey", merged.alias("m")).select(
        "p_partkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size"),
        F.size(F.map_keys(shapes.keys_matching(F.col("m"), "^br"))).alias("chosen"))


@query("f28_array_append", "SELECT p_partkey, p_brand || '>' || p_type AS history FROM part")
def f28(spark, sf):
    history = shapes.append_step(F.array("p_brand"), F.col("p_type"))
    return Tables(spark, sf).part.select("p_partkey", F.array_join(history, ">").alias("history"))


@query("f29_durations", """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN c_nationkey WHEN 1 THEN c_nationkey * 86400 WHEN 2 THEN c_nationkey * 31536000 END::BIGINT AS seconds FROM customer""")
def f29(spark, sf):
    unit = st.one_of(F.pmod("c_nationkey", F.lit(4)), {0: "s", 1: "d", 2: "y"}, "w")
    return Tables(spark, sf).customer.select("c_custkey", times.parse_duration_seconds(F.concat(F.col("c_nationkey").cast("string"), unit)).alias("seconds"))


@query("f30_blank_nulls", "SELECT source_type, record_id, coalesce(url, '') AS url, coalesce(lang, '') AS lang FROM (SELECT 'SCRAPING' AS source_type, page_id AS record_id, url, NULL AS lang FROM pages UNION ALL SELECT 'DOCUMENT', doc_id, NULL, lang FROM documents)")
def f30(spark, sf):
    rows = unified(spark, sf)
    return rows.select("source_type", "record_id", tx.blank_if_null(F.col("url")).alias("url"), tx.blank_if_null(F.col("lang")).alias("lang"))


@query("f25_kept_entities", "SELECT doc_id, round(c, 6) AS confidence FROM (SELECT doc_id, 0.8::DOUBLE * least(length(source || lang || doc_id::VARCHAR || 'abcdefghijk') / 20.0::DOUBLE, 1.0) AS c FROM documents) WHERE c >= 0.75")
def f25_kept(spark, sf):
    entity = F.concat("source", "lang", F.col("doc_id").cast("string"), F.lit("abcdefghijk"))
    rows = Tables(spark, sf).documents.select("doc_id", scores.entity_confidence(entity).alias("confidence")).where("confidence >= 0.75")
    return rows.withColumn("confidence", F.round("confidence", 6))

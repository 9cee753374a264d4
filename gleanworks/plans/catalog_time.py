"""Registered queries: ordered histories, alerts, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanworks import fixed, schemas
from gleanworks.functions import times
from gleanworks.operators import aggregates as ag, alerts, ordered
from gleanworks.plans import standins as st
from gleanworks.plans.catalog_rules import PREVIOUS_SQL, status_changes
from gleanworks.plans.catalog_summaries import HOUR, stamped
from gleanworks.plans.registry import Tables, query
from gleanworks.sources import tables
from gleanworks.streaming import ingest, state, windows

BY_TIME = ["ts", "event_id"]


# --- histories ------------------------------------------------------------------------------


@query("w01_previous_status", f"SELECT event_id, job_id, status, previous FROM ({PREVIOUS_SQL})")
def w01(spark, sf):
    return status_changes(Tables(spark, sf)).select("event_id", "job_id", "status", "previous")


# Versions count the events of a job; one of a small value is followed by a gap.
@query("w02_version_steps", f"""SELECT event_id, version, version - lag(version) OVER (PARTITION BY job_id ORDER BY ts, event_id) = 1 AS by_one FROM (
  SELECT *, sum(CASE WHEN value < 5 THEN 2 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM ({st.HISTORY_SQL}))""")
def w02(spark, sf):
    step = F.when(F.col("value") < 5, 2).otherwise(1).cast("bigint")
    versions = ordered.with_running_total(st.history(Tables(spark, sf)), ["job_id"], BY_TIME, step, "version")
    stored = tables.publish(versions.select("job_id", "ts", "event_id", "version"), "w02")
    steps = ordered.with_previous(stored, ["job_id"], BY_TIME, F.col("version"), "before")
    return steps.select("event_id", "version", (F.col("version") - F.col("before") == 1).alias("by_one"))


@query("w03_latest", f"SELECT job_id, max(event_id) AS event_id, arg_max(status, ts) AS status FROM ({st.HISTORY_SQL}) h WHERE ts = (SELECT max(ts) FROM events WHERE user_id = job_id) GROUP BY 1")
def w03(spark, sf):
    return ordered.latest_per_key(st.history(Tables(spark, sf)), ["job_id"], BY_TIME).select("job_id", "event_id", "status")


@query("w04_newer_versions", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) - 1 AS newer FROM orders")
def w04(spark, sf):
    numbered = ordered.with_position(
        Tables(spark, sf).orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "n", descending=True)
    return numbered.select("o_orderkey", (F.col("n") - 1).alias("newer"))


# Hourly maximum per event type above 40, sustained for two hours.
HOURLY_SQL = "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, max(value) AS v FROM events GROUP BY 1, 2"
RUNS_SQL = f"""SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY w) AS pos FROM (
  SELECT *, epoch(w)::BIGINT // 3600 - row_number() OVER (PARTITION BY event_type ORDER BY w) AS run FROM ({HOURLY_SQL}) WHERE v > 40)"""
FIRED_SQL = f"SELECT event_type, w FROM ({RUNS_SQL}) WHERE pos = 2"


def hourly(t: Tables):
    return ag.align(t.events, ["event_type"], "ts", F.col("value"), 3600, "max")


def above():
    return alerts.breaches(F.col("value"), "GT", 40.0)


def fired(t: Tables):
    return alerts.sustained(hourly(t), ["event_type"], above(), 3600, 7200)


@query("w05_sustained", f"SELECT event_type, {st.stamp_sql('w')} AS window_start FROM ({FIRED_SQL})")
def w05(spark, sf):
    return stamped(fired(Tables(spark, sf)).select("event_type", "window_start"))


@query("w06_suppression", f"""WITH RECURSIVE f AS ({FIRED_SQL}), n AS (
  SELECT event_type, min(w) AS w FROM f GROUP BY 1
  UNION ALL SELECT n.event_type, (SELECT min(f.w) FROM f WHERE f.event_type = n.event_type AND f.w >= n.w + INTERVAL 6 HOUR) FROM n WHERE n.w IS NOT NULL)
SELECT event_type, {st.stamp_sql('w')} AS window_start FROM n WHERE w IS NOT NULL""")
def w06(spark, sf):
    return stamped(alerts.notifications(fired(Tables(spark, sf)), ["event_type"], 6 * 3600))


@query("w07_incidents", f"""SELECT event_type, {st.stamp_sql('min(w)')} AS opened_at, {st.stamp_sql('max(w) + INTERVAL 2 HOUR')} AS closes_at, count(*) AS windows FROM (
  SELECT *, sum(o) OVER (PARTITION BY event_type ORDER BY w) AS incident FROM (
    SELECT *, CASE WHEN epoch(w) - lag(epoch(w)) OVER (PARTITION BY event_type ORDER BY w) < 7200 THEN 0 ELSE 1 END AS o FROM ({HOURLY_SQL}) WHERE v > 40))
GROUP BY event_type, incident""")
def w07(spark, sf):
    breaching = hourly(Tables(spark, sf)).where(above())
    return stamped(stamped(alerts.incidents(breaching, ["event_type"], 7200).drop("incident"), "opened_at"), "closes_at")


@query("w08_schedule", f"""SELECT job_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (gap < 3600) AS too_close, count(*) > 24 AS too_many FROM (
  SELECT *, date_diff('second', date_trunc('second', lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)), date_trunc('second', ts)) AS gap FROM ({st.HISTORY_SQL}) WHERE status = 'RUNNING') GROUP BY 1, 2""")
def w08(spark, sf):
    runs = st.history(Tables(spark, sf)).where("status = 'RUNNING'")
    gaps = ordered.with_previous(runs, ["job_id"], BY_TIME, times.epoch_seconds(F.col("ts")), "before")
    gap = times.epoch_seconds(F.col("ts")) - F.col("before")
    return gaps.groupBy("job_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("runs"), F.count_if(gap < 3600).alias("too_close"), (F.count("*") > 24).alias("too_many"))


@query("w09_attempts", f"""SELECT event_id, attempt, least(1000.0 * pow(2.0, attempt - 1), 30000.0) AS delay_ms FROM (
  SELECT event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt FROM ({st.HISTORY_SQL}) WHERE status = 'FAILED')""")
def w09(spark, sf):
    failures = st.history(Tables(spark, sf)).where("status = 'FAILED'")
    numbered = ordered.with_position(failures, ["job_id"], BY_TIME, "attempt")
    return numbered.select("event_id", "attempt", times.backoff_ms(F.col("attempt"), 1000, 2, 30000).alias("delay_ms"))


@query("w10_rolling_error", """SELECT s AS second, count(*) FILTER (k) AS n, sum(total)::BIGINT AS total, sum(failed)::BIGINT AS failed, round(sum(failed)::DOUBLE / sum(total), 6) AS share FROM (
  SELECT a.s, b.n AS total, b.f AS failed, a.s = b.s AS k FROM (SELECT epoch(ts)::BIGINT AS s FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1) a
  JOIN (SELECT epoch(ts)::BIGINT AS s, count(*) AS n, count(*) FILTER (event_type = 'error') AS f FROM (SELECT date_trunc('second', ts) AS ts, event_type FROM events) GROUP BY 1) b
    ON b.s BETWEEN a.s - 600 AND a.s) GROUP BY 1""")
def w10(spark, sf):
    events = Tables(spark, sf).events.withColumn("everything", F.lit(1))
    share = ordered.trailing_share(events, ["everything"], times.epoch_seconds(F.col("ts")), F.col("event_type") == "error", 600)
    return share.select("second", F.lit(1).cast("bigint").alias("n"), "total", "failed", F.round("share", 6).alias("share"))


@query("w10_breaker_per_user", """SELECT a.user_id, a.s AS second, round(sum(b.f)::DOUBLE / sum(b.n), 6) AS share, sum(b.f) * 100.0 / sum(b.n) >= 50 AS tripped
FROM (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events GROUP BY 1, 2) a
JOIN (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, count(*) AS n, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1, 2) b
  ON a.user_id = b.user_id AND b.s BETWEEN a.s - 3600 AND a.s GROUP BY 1, 2""")
def w10_users(spark, sf):
    share = ordered.trailing_share(
        Tables(spark, sf).events, ["user_id"], times.epoch_seconds(F.col("ts")), F.col("event_type") == "error", 3600)
    return share.select("user_id", "second", F.round("share", 6).alias("share"), (F.col("share") * 100 >= 50).alias("tripped"))


# Metric points from events: an hour becomes a minute, so that windows of all policies hold points.
METRICS = {"click": ("processing_time", 8.0), "view": ("memory_usage", 2.0), "purchase": ("throughput", 60.0), "error": ("scraping_errors", 0.001),
           "signup": ("response_time", 15.0)}
POINTS_SQL = " UNION ALL ".join(
    f"SELECT '{metric}' AS metric, epoch(date_trunc('second', ts))::BIGINT // 60 AS second, value * {factor}::DOUBLE AS value FROM events WHERE event_type = '{kind}'"
    for kind, (metric, factor) in METRICS.items())
POLICIES_SQL = "(VALUES " + ", ".join(
    f"('{name}', {w}, '{aligner}', '{comparison}', {threshold}::DOUBLE, {duration})"
    for name, (w, aligner, comparison, threshold, duration, *_) in fixed.ALERT_POLICIES.items()) + ") p(policy, seconds, aligner, comparison, threshold, duration)"
ALIGNED_SQL = f"""SELECT *, CASE comparison WHEN 'LT' THEN value < threshold ELSE value > threshold END AS breach FROM (
  SELECT policy, second - second % seconds AS window_second, CASE aligner WHEN 'mean' THEN avg(value) WHEN 'max' THEN max(value) WHEN 'rate' THEN sum(value) / seconds
    ELSE quantile_cont(value, 0.95) END AS value, seconds, comparison, threshold, duration FROM ({POINTS_SQL}) JOIN {POLICIES_SQL} ON policy = metric
  GROUP BY policy, second - second % seconds, aligner, seconds, comparison, threshold, duration)"""


def policy_aligned(t: Tables):
    kind, second = F.col("event_type"), F.floor(times.epoch_seconds(F.col("ts")) / 60)
    factor = st.one_of(kind, {k: f for k, (_, f) in METRICS.items()}, 0.0)
    points = t.events.select(
        st.one_of(kind, {k: m for k, (m, _) in METRICS.items()}, "").alias("metric"), F.lit("all").alias("series"), second.alias("second"),
        (F.col("value") * factor).alias("value"))
    return alerts.policy_windows(points, alerts.policy_table(t.spark))


@query("t02_policy_breaches", f"SELECT policy, window_second, round(value, 6) AS value FROM ({ALIGNED_SQL}) WHERE breach")
def t02_policies(spark, sf):
    return policy_aligned(Tables(spark, sf)).where("breach").select("policy", "window_second", F.round("value", 6).alias("value"))


@query("w05_policy_alerts", f"""SELECT policy, window_second FROM (SELECT *, row_number() OVER (PARTITION BY policy, run ORDER BY window_second) AS place FROM (
  SELECT *, window_second // seconds - row_number() OVER (PARTITION BY policy ORDER BY window_second) AS run FROM ({ALIGNED_SQL}) WHERE breach))
WHERE place = greatest(ceil(duration / seconds::DOUBLE), 1)""")
def w05_policies(spark, sf):
    return alerts.policy_fired(policy_aligned(Tables(spark, sf))).select("policy", "window_second")


# --- streams ----------------------------------------------------------------------------------
# Append mode emits a window once the watermark (ten minutes behind the newest row) passes its end; at the end of the
# input a closing step emits those that are still open.


def event_stream(spark, sf):
    return ingest.read_stream(spark, Tables(spark, sf).stream_path("events"), schemas.EVENTS)


def whole(spark, sf, make, label: str, seconds: int):
    """Every window of the stream of events."""
    return ingest.drain_whole(spark, Tables(spark, sf).stream_path("events"), schemas.EVENTS, make, label, seconds)


def bucket(seconds: int) -> str:
    return f"time_bucket(INTERVAL {seconds} SECOND, ts)"


def windowed_sql(seconds: int, select: str, having: str = "") -> str:
    return f"SELECT {st.stamp_sql(bucket(seconds))} AS window_start, {select} FROM events GROUP BY {bucket(seconds)}, event_type {having}"


@query("t01_tumbling", windowed_sql(300, "event_type, round(avg(value), 6) AS value"))
def t01(spark, sf):
    rows = whole(spark, sf, lambda s: windows.aligned(s, ["event_type"], "ts", F.col("value"), 300, "mean"), "t01", 300)
    return stamped(rows.withColumn("value", F.round("value", 6)))


@query("t02_thresholds", windowed_sql(3600, "event_type, round(avg(value), 8) AS value", "HAVING avg(value) > 25"))
def t02(spark, sf):
    def high(stream):
        means = windows.aligned(stream, ["event_type"], "ts", F.col("value"), 3600, "mean")
        return means.where(alerts.breaches(F.col("value"), "GT", 25.0))

    rows = whole(spark, sf, high, "t02", 3600)
    return stamped(rows.withColumn("value", F.round("value", 8)))


# The life cycle of alerts, by the policy of each metric; a quarter of the users makes a series.
SERIES_POINTS_SQL = " UNION ALL ".join(
    f"SELECT '{metric}' AS metric, 's' || user_id % 4 AS series, epoch(date_trunc('second', ts))::BIGINT AS second, value * {factor}::DOUBLE AS value FROM events WHERE event_type = '{kind}'"
    for kind, (metric, factor) in METRICS.items())
CYCLES_SQL = "(VALUES " + ", ".join(
    f"('{name}', {w}, '{aligner}', '{comparison}', {threshold}::DOUBLE, {duration}, {close}, {period or 0})"
    for name, (w, aligner, comparison, threshold, duration, close, period) in fixed.ALERT_POLICIES.items()) + ") p(policy, seconds, aligner, comparison, threshold, duration, auto_close, period)"
SERIES_SQL = f"""SELECT *, CASE comparison WHEN 'LT' THEN value < threshold ELSE value > threshold END AS breach FROM (
  SELECT policy, series, second - second % seconds AS w, CASE aligner WHEN 'mean' THEN avg(value) WHEN 'max' THEN max(value) WHEN 'rate' THEN sum(value) / seconds
    ELSE quantile_cont(value, 0.95) END AS value, seconds, aligner, comparison, threshold, duration, auto_close, period FROM ({SERIES_POINTS_SQL}) JOIN {CYCLES_SQL} ON policy = metric
  GROUP BY policy, series, second - second % seconds, aligner, seconds, comparison, threshold, duration, auto_close, period)"""
# Runs of consecutive breaching windows, incidents (breaches less than the auto-close time apart), and notifications: the
# first window of a run that has lasted long enough, unless the last notification is less than a period ago.
LIFE_SQL = f"""WITH RECURSIVE h AS ({SERIES_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY policy, series, run ORDER BY w) AS pos, greatest(ceil(duration / seconds::DOUBLE), 1) AS needed FROM (
  SELECT *, w // seconds - row_number() OVER (PARTITION BY policy, series ORDER BY w) AS run FROM h WHERE breach)),
i AS (SELECT *, sum(o) OVER (PARTITION BY policy, series ORDER BY w) AS incident FROM (
  SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY policy, series ORDER BY w) < auto_close THEN 0 ELSE 1 END AS o FROM r)),
s AS (SELECT policy, series, incident, min(CASE WHEN pos >= needed THEN w END) AS opened, max(w) AS last, max(auto_close) AS auto_close FROM i GROUP BY 1, 2, 3),
f AS (SELECT policy, series, w, period FROM r WHERE pos = needed),
n AS (SELECT policy, series, min(w) AS w, max(period) AS period FROM f GROUP BY 1, 2
  UNION ALL SELECT policy, series, (SELECT min(f.w) FROM f WHERE f.policy = n.policy AND f.series = n.series AND f.w > n.w AND f.w >= n.w + n.period), period FROM n WHERE n.w IS NOT NULL),
e AS (SELECT policy, series, opened AS "at", 'OPEN' AS event FROM s WHERE opened IS NOT NULL
  UNION ALL SELECT policy, series, last + auto_close, 'CLOSE' FROM s WHERE opened IS NOT NULL AND (last + auto_close <= (SELECT max(w) - 600 FROM h)
    OR EXISTS (SELECT 1 FROM h WHERE h.policy = s.policy AND h.series = s.series AND h.w >= s.last + s.auto_close))
  UNION ALL SELECT policy, series, w, 'NOTIFY' FROM n WHERE w IS NOT NULL)
SELECT policy, series, e."at"::BIGINT AS "at", event FROM e"""


def series_points(events):
    kind = F.col("event_type")
    factor = st.one_of(kind, {k: f for k, (_, f) in METRICS.items()}, 0.0)
    return events.select(
        st.one_of(kind, {k: m for k, (m, _) in METRICS.items()}, None).cast("string").alias("metric"), F.concat(F.lit("s"), F.col("user_id") % 4).alias("series"),
        "ts", (F.col("value") * factor).alias("value"))


def policy_stream(spark, sf, label: str) -> str:
    """All policy windows of the stream of events, written as a table that a further stream reads."""
    policies = alerts.policy_table(spark)
    delay = f"{600 + windows.policy_reach(policies)} seconds"
    return ingest.drain_whole_to(spark, Tables(spark, sf).stream_path("events"), schemas.EVENTS,
                                 lambda s: windows.policy_windows(series_points(s), policies), label, 1, delay=delay)


def life_cycle(spark, sf, label: str):
    table = policy_stream(spark, sf, f"{label}-windows")
    stream = ingest.read_stream(spark, table, spark.read.parquet(table).schema)
    return ingest.drain(state.policy_transitions_stream(stream), label)


@query("t03_alert_state", LIFE_SQL)
def t03(spark, sf):
    return life_cycle(spark, sf, "t03")


@query("t03_alert_state_batch", LIFE_SQL)
def t03_batch(spark, sf):
    points = series_points(Tables(spark, sf).events).withColumn("second", times.epoch_seconds(F.col("ts"))).where("metric is not null")
    aligned = tables.publish(alerts.policy_windows(points, alerts.policy_table(spark)), "t03-windows")
    until = aligned.agg(F.max("window_second") - 600).first()[0]
    return state.policy_transitions(aligned, until)


@query("t04_notifications", f"SELECT policy, series, \"at\" FROM ({LIFE_SQL}) WHERE event = 'NOTIFY'")
def t04(spark, sf):
    return life_cycle(spark, sf, "t04").where("event = 'NOTIFY'").select("policy", "series", "at")


@query("t05_rate_limit", windowed_sql(900, "event_type, count(*) AS n", "HAVING count(*) > 2"))
def t05(spark, sf):
    return stamped(whole(spark, sf, lambda s: windows.over_limit(s, ["event_type"], "ts", 900, 2), "t05", 900))


RULE = {"click": "query", "view": "query", "purchase": "write", "signup": "write", "error": "delete"}
RULES = [("query", 7200, 6), ("write", 3600, 4), ("delete", 1800, 2)]


@query("t05_rate_rules", f"""SELECT rule, maximum, s - s % seconds AS window_second, count(*) AS n FROM (
  SELECT {st.one_of_sql('event_type', RULE, None)} AS r, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
JOIN (VALUES ('query', 7200::BIGINT, 6::BIGINT), ('write', 3600, 4), ('delete', 1800, 2)) p(rule, seconds, maximum) ON rule = r
GROUP BY 1, 2, 3 HAVING count(*) > maximum""")
def t05_rules(spark, sf):
    typed = Tables(spark, sf).events.withColumn("rule", st.one_of(F.col("event_type"), RULE, None))
    return ag.requests_over_rules(typed, "rule", [], "ts", RULES)


@query("t06_sliding_errors", """SELECT strftime(w, '%Y-%m-%d') AS day, count(*) AS windows, count(*) FILTER (e * 100.0 / n >= 50) AS tripped FROM (
  SELECT w, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM (
    SELECT event_type, time_bucket(INTERVAL 1 SECOND, ts) - to_seconds(k) AS w FROM events, (SELECT unnest(range(10)) AS k)) GROUP BY 1)
GROUP BY 1""")
def t06(spark, sf):
    shares = whole(spark, sf, lambda s: windows.error_share(s, "ts", F.col("event_type") == "error"), "t06", 10)
    return shares.groupBy(F.date_format("window_start", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("windows"), F.count_if("tripped").alias("tripped"))


@query("t07_file_ingest", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def t07(spark, sf):
    t = Tables(spark, sf)
    arriving = ingest.read_stream(spark, t.stream_path("documents"), t.documents.schema).select("source", "n_chars")
    return ingest.drain(arriving, "t07").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("t08_stream_dedup", "SELECT event_id, event_type, value FROM events")
def t08(spark, sf):
    once = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = once.unionByName(event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return ingest.drain(ingest.without_repeats(twice, ["event_id"], "ts").select("event_id", "event_type", "value"), "t08")


@query("t09_timeliness", """SELECT event_id, (value::DECIMAL(18, 2) * 10000)::BIGINT AS delay_ms, value * 10000 <= 900000 AS on_time FROM events""")
def t09(spark, sf):
    seconds = F.round(F.col("value") * 10000).cast("bigint")
    rows = event_stream(spark, sf).withColumn("processed", F.timestamp_add("MILLISECOND", seconds, F.col("ts")))
    return ingest.drain(ag.timeliness(rows, F.col("ts"), F.col("processed")).select("event_id", "delay_ms", "on_time"), "t09")


ERROR_TYPES = {"click": "NETWORK", "view": "RATE_LIMIT", "error": "SYSTEM", "signup": "AUTHENTICATION", "purchase": "VALIDATION"}


@query("t10_error_alerts", f"""SELECT window_start, error_type, n, threshold FROM (
  SELECT {st.stamp_sql(bucket(60))} AS window_start, {st.one_of_sql('event_type', ERROR_TYPES, None)} AS error_type, count(*) AS n FROM events GROUP BY 1, 2)
JOIN (VALUES ('NETWORK', 5), ('RATE_LIMIT', 10), ('AUTHENTICATION', 3), ('VALIDATION', 5), ('SYSTEM', 1)) p(k, threshold) ON k = error_type WHERE n >= threshold""")
def t10(spark, sf):
    def per_minute(stream):
        typed = stream.withColumn("error_type", st.one_of(F.col("event_type"), ERROR_TYPES, None))
        return windows.alerts_per_minute(typed, "ts", "error_type").select("window_start", "error_type", "n", "threshold")

    return stamped(whole(spark, sf, per_minute, "t10", 60))


@query("t11_gauge_max", f"SELECT policy, series, w AS window_second, round(value, 6) AS value, threshold FROM ({SERIES_SQL}) WHERE aligner = 'max' AND breach")
def t11(spark, sf):
    table = policy_stream(spark, sf, "t11")
    return spark.read.parquet(table).where("aligner = 'max' and breach").select("policy", "series", "window_second", F.round("value", 6).alias("value"), "threshold")


LOCKOUT_SQL = """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, g, event_type = 'error' ORDER BY ts, event_id) AS streak FROM (
  SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events WHERE event_type IN ('error', 'purchase')))
WHERE event_type = 'error' AND streak = 3"""


def failed():
    return F.col("event_type") == "error"


def succeeded():
    return F.col("event_type") == "purchase"


@query("t12_lockout", LOCKOUT_SQL)
def t12(spark, sf):
    locked = state.lockouts_stream(event_stream(spark, sf), "user_id", BY_TIME, failed(), succeeded(), "t12")
    return locked.select("event_id", "user_id")


# With a streak forgotten after a day without a sign-in.
FORGET_SQL = """SELECT event_id, user_id FROM (SELECT *, sum(hit) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM (
  SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS hit, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
    SELECT *, CASE WHEN event_type = 'purchase' OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type IN ('error', 'purchase'))))
WHERE hit = 1 AND streak = 2"""


@query("t12_lockout_forgotten", FORGET_SQL)
def t12_forgotten(spark, sf):
    locked = state.lockouts_stream(event_stream(spark, sf), "user_id", BY_TIME, failed(), succeeded(), "t12", limit=2, forget=86_400)
    return locked.select("event_id", "user_id")


@query("t12_lockout_forgotten_batch", FORGET_SQL)
def t12_forgotten_batch(spark, sf):
    rows = state.lockouts(Tables(spark, sf).events, "user_id", BY_TIME, failed(), succeeded(), limit=2, forget=86_400)
    return rows.select("event_id", "user_id")


@query("t12_lockout_batch", LOCKOUT_SQL)
def t12_batch(spark, sf):
    rows = state.lockouts(Tables(spark, sf).events, "user_id", BY_TIME, failed(), succeeded())
    return rows.select("event_id", "user_id")


# Events arrive week by week, each tenth two weeks after its own.
ARRIVAL_SQL = "SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) // 7 + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS arrival FROM events"
LATE_SQL = f"""WITH a AS ({ARRIVAL_SQL}), d AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a GROUP BY arrival),
l AS (SELECT a.*, coalesce(ts < before - INTERVAL 15 MINUTE, false) AS late FROM a JOIN d USING (arrival))"""


def by_arrival(spark, sf):
    """On-time and late rows of the events, streamed week by week as they arrived."""
    events = Tables(spark, sf).events
    arrival = F.floor(F.unix_date(F.to_date("ts")) / 7) + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    arrived = ingest.in_arrival_order(events, arrival)
    return ingest.split_late(ingest.read_stream(spark, arrived, schemas.EVENTS, 1), "ts", "t09", "15 minutes")


@query("t09_late_rows", f"{LATE_SQL} SELECT event_id, event_type, late FROM l")
def t09_late(spark, sf):
    on_time, late = by_arrival(spark, sf)
    return on_time.withColumn("late", F.lit(False)).union(late.withColumn("late", F.lit(True))).select("event_id", "event_type", "late")


@query("t09_on_time_windows", f"""{LATE_SQL}, w AS (SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM l GROUP BY 1, 2)
SELECT event_type, hour, n, late FROM w""")
def t09_windows(spark, sf):
    on_time, late = by_arrival(spark, sf)
    return (on_time.withColumn("_late", F.lit(0)).union(late.withColumn("_late", F.lit(1)))
            .groupBy("event_type", (F.floor(times.epoch_seconds(F.col("ts")) / 3600) * 3600).alias("hour"))
            .agg(F.count_if(F.col("_late") == 0).alias("n"), F.count_if(F.col("_late") == 1).alias("late")))

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanworks.operators import aggregates, alerts, ordered
from gleanworks.session import new_location
from gleanworks.sources import tables
from gleanworks.streaming import ingest, state, windows

T0 = datetime(2024, 1, 1)


def series(spark, flags, seconds=60, name="s"):
    rows = [(name, T0 + timedelta(seconds=seconds * i), bool(f)) for i, f in enumerate(flags) if f is not None]
    return spark.createDataFrame(rows, "series string, window_start timestamp_ntz, bad boolean")


@pytest.mark.parametrize("flags, fired", [
    ([1, 1, 1, 1, 1, 0], [4]), ([1, 1, 1, 1, 0, 1], []), ([1] * 12, [4]), ([1, 1, 1, None, 1, 1, 1, 1, 1], [8]),
    ([1] * 5 + [0] + [1] * 5, [4, 10]),
])
def test_sustained(spark, flags, fired):
    rows = alerts.sustained(series(spark, flags), ["series"], F.col("bad"), 60, 300).collect()
    assert sorted((r.window_start - T0).seconds // 60 for r in rows) == fired


def test_suppression(spark):
    times = [(name, T0 + timedelta(seconds=s)) for name in ("a", "b") for s in (0, 200, 400, 700)]
    df = spark.createDataFrame(times, "series string, window_start timestamp_ntz")
    sent = alerts.notifications(df, ["series"], 300).collect()
    assert sorted((r.series, (r.window_start - T0).seconds) for r in sent) == [(n, s) for n in "ab" for s in (0, 400, 700)]


def test_suppression_equals_the_walk(spark):
    """Chains of any length in hot, short, null and single series; equal times count once."""
    rng = random.Random(12)
    rows = [("hot", T0 + timedelta(seconds=rng.randrange(200_000))) for _ in range(4000)] + [(None, T0 + timedelta(seconds=60 * k)) for k in range(300)]
    rows += [(f"s{k}", T0 + timedelta(seconds=rng.randrange(5000))) for k in range(40) for _ in range(k % 6)] + [("s1", None)]
    df = spark.createDataFrame(rows + rows[:50], "series string, window_start timestamp_ntz")
    for period in (0, 1, 700, 10**6):
        want, last = set(), {}
        for name, at in sorted(set(rows), key=lambda r: (r[1] or T0, str(r[0]))):
            if at is not None and (name not in last or (at - last[name]).total_seconds() >= period):
                want.add((name, at))
                last[name] = at
        got = [tuple(r) for r in alerts.notifications(df, ["series"], period).collect()]
        assert len(got) == len(want) and set(got) == want
    assert alerts.notifications(df.where("false"), ["series"], 60).count() == 0


def test_incidents(spark):
    df = series(spark, [1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1]).where("bad")
    got = alerts.incidents(df, ["series"], 300).orderBy("opened_at").collect()
    assert [((r.opened_at - T0).seconds, (r.closes_at - T0).seconds, r.windows) for r in got] == [(0, 540, 3), (600, 900, 1)]


BASE = 3_600_000


def by_policy(spark, flags, name="p", key="s", seconds=60, duration=120, auto_close=180, period=600):
    rows = [(name, key, BASE + seconds * i, 1.0, bool(f), seconds, "max", "GT", 0.0, duration, auto_close, period) for i, f in enumerate(flags) if f is not None]
    return spark.createDataFrame(rows, "policy string, series string, window_second bigint, value double, breach boolean, seconds bigint, aligner string, "
                                       "comparison string, threshold double, duration bigint, auto_close bigint, period bigint")


def test_alert_life_cycle(spark):
    got = state.policy_transitions(by_policy(spark, [1, 1, 1, 0, 0, 0, 0, 1, 1, 1])).collect()
    assert sorted((r.at - BASE, r.event) for r in got) == [(60, "NOTIFY"), (60, "OPEN"), (300, "CLOSE"), (480, "OPEN")]


@pytest.mark.parametrize("parts", [1, 3])
def test_alert_stream_equals_batch(spark, parts):
    """Open, quiet, silent and short-lived series of two policies, in one batch and in several; timers close the silent ones."""
    rng = random.Random(parts)
    rows = by_policy(spark, [0, 0, 1, 1, 1])
    for k in range(6):
        flags = [rng.choice([0, 1, 1, 1, None]) for _ in range(90 - 10 * k)]
        rows = rows.union(by_policy(spark, flags, key=f"k{k}")).union(by_policy(spark, flags, name="q", key=f"k{k}", duration=300, auto_close=60, period=0))
    rows = rows.union(by_policy(spark, [1] * 4 + [None] * 200 + [0], key="far"))
    location = ingest.in_arrival_order(rows, F.floor((F.col("window_second") - BASE) * parts / (205 * 60)))
    found = ingest.drain(state.policy_transitions_stream(ingest.read_stream(spark, location, rows.schema, 1), "3 minutes"), "a")
    want = sorted(tuple(r) for r in state.policy_transitions(rows, until=BASE + 204 * 60 - 180).collect())
    assert sorted(tuple(r) for r in found.collect()) == want
    assert ("p", "s", BASE + 240 + 180, "CLOSE") in want and ("p", "far", BASE + 180 + 180, "CLOSE") in want


def test_policy_stream_windows_equal_batch(spark):
    """Windows of several lengths and aligners from one stream, the open ones too; points of no policy and of none at all go."""
    table = {"mean60": (60, "mean", "GT", 5.0, 60, 60, None), "max300": (300, "max", "GT", 9.0, 60, 60, None), "rate3600": (3600, "rate", "LT", 1.0, 60, 60, None),
             "p95": (60, "p95", "GT", 5.0, 60, 60, None)}
    policies = alerts.policy_table(spark, table)
    rng = random.Random(2)
    rows = [(rng.choice([*table, "other", None]), f"s{rng.randrange(3)}", T0 + timedelta(seconds=11 * i), float(i % 13) if i % 9 else None) for i in range(1500)]
    points = spark.createDataFrame(rows, "metric string, series string, ts timestamp_ntz, value double")
    location = ingest.in_time_order(points, "ts", 5)
    found = ingest.drain_whole(spark, location, points.schema, lambda s: windows.policy_windows(s, policies), "p", 1, delay=f"{600 + 3600} seconds", files_per_trigger=1)
    batch = alerts.policy_windows(points.select("metric", "series", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), "value"), policies)
    flat = lambda df: sorted((r.policy, r.series, r.window_second, None if r.value is None else round(r.value, 9), r.breach, r.seconds) for r in df.collect())
    assert flat(found) == flat(batch) and len(flat(found)) > 300


def test_windows_open_at_the_end_are_emitted(spark, feed):
    rows = ingest.drain_whole(spark, feed[1], feed[0].schema, lambda s: windows.aligned(s, ["user_id"], "ts", F.col("value"), 300, "sum"), "w", 300, files_per_trigger=1)
    batch = aggregates.align(feed[0], ["user_id"], "ts", F.col("value"), 300, "sum")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, batch.collect()))
    late = feed[0].where("event_id >= 390").withColumn("ts", F.col("ts") - F.expr("INTERVAL 5 HOURS"))
    newest = feed[0].where("event_id = 399")
    location = ingest.in_arrival_order(feed[0].withColumn("n", F.lit(0)).union(newest.withColumn("n", F.lit(1))).union(late.withColumn("n", F.lit(2))), "n")
    with pytest.raises(ValueError, match="behind the watermark"):
        ingest.drain_whole(spark, location, feed[0].schema, lambda s: windows.aligned(s, ["user_id"], "ts", F.col("value"), 300, "sum"), "w", 300, files_per_trigger=1)
    empty = ingest.in_time_order(feed[0].where("false"), "ts", 2)
    assert ingest.drain_whole(spark, empty, feed[0].schema, lambda s: windows.aligned(s, ["user_id"], "ts", F.col("value"), 300, "sum"), "w", 300).count() == 0


def test_late_rows_are_split_off(spark):
    """Rows arrive in five batches, some hours after their time; lateness is that of the watermark, none is lost, restarts go on."""
    rng = random.Random(4)
    rows = [(i, T0 + timedelta(seconds=20 * i), i // 200 + (rng.randrange(3) if i % 10 == 0 else 0)) for i in range(1000)] + [(5000, None, 1)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, arrival int")
    location, root = ingest.in_arrival_order(df, "arrival"), new_location(spark, "late-root")
    read = lambda: ingest.read_stream(spark, location, df.schema, 1)
    on_time, late = ingest.split_late(read(), "ts", "late", root=root)
    newest, want = {}, set()
    for _, ts, arrival in rows:
        newest[arrival] = max(newest.get(arrival, T0), ts or T0)
    for i, ts, arrival in rows:
        before = [newest[a] for a in newest if a < arrival]
        if ts and before and ts < max(before) - timedelta(minutes=10):
            want.add(i)
    assert len(want) > 20 and {r.event_id for r in late.collect()} == want
    assert sorted(r.event_id for r in on_time.union(late).collect()) == sorted(r[0] for r in rows)
    tables.append(spark.createDataFrame([(7000, T0, 9), (7001, T0 + timedelta(days=1), 9)], df.schema), location)
    on_time, late = ingest.split_late(read(), "ts", "late", root=root)
    assert {r.event_id for r in late.collect()} == want | {7000} and on_time.where("event_id = 7001").count() == 1
    empty = ingest.in_time_order(df.where("false"), "ts", 2)
    assert [t.count() for t in ingest.split_late(ingest.read_stream(spark, empty, df.schema), "ts", "none")] == [0, 0]


def events(spark, count=400):
    rows = [(i, T0 + timedelta(seconds=37 * i), f"u{i % 3 if i % 2 else 0}", "bad" if i % 5 else "good", float(i % 11)) for i in range(count)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id string, kind string, value double")


@pytest.fixture(scope="module")
def feed(spark):
    """The events as a table that arrived in four time-ordered files."""
    df, location = events(spark), new_location(spark, "feed")
    for part in range(4):
        tables.append(df.where((F.col("event_id") >= part * 100) & (F.col("event_id") < part * 100 + 100)).coalesce(1), location)
    return df, location


def stream(spark, feed, files=1):
    return ingest.read_stream(spark, feed[1], feed[0].schema, files)


def test_stream_windows_equal_batch(spark, feed):
    streamed = ingest.drain(windows.aligned(stream(spark, feed), ["user_id"], "ts", F.col("value"), 300, "sum"), "w")
    closed = feed[0].agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    batch = aggregates.align(feed[0], ["user_id"], "ts", F.col("value"), 300, "sum")
    want = {(r.window_start, r.user_id, r.value) for r in batch.collect() if r.window_start + timedelta(seconds=300) <= closed}
    assert {(r.window_start, r.user_id, r.value) for r in streamed.collect()} == want


def test_rate_limits_equal_batch(spark, feed):
    streamed = ingest.drain(windows.over_limit(stream(spark, feed), ["user_id"], "ts", 900, 8), "r")
    batch = aggregates.requests_over_limit(feed[0], ["user_id"], "ts", 900, 8)
    closed = feed[0].agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    want = {tuple(r) for r in batch.collect() if r.window_start + timedelta(seconds=900) <= closed}
    assert want and {tuple(r) for r in streamed.collect()} == want


@pytest.mark.parametrize("files", [1, 4])
def test_lockouts_carry_over_batches(spark, feed, files):
    bad, good = F.col("kind") == "bad", (F.col("kind") == "good") & (F.col("value") > 8)
    order = ["ts", "event_id"]
    streamed = state.lockouts_stream(stream(spark, feed, files), "user_id", order, bad, good, "l", limit=6)
    batch = state.lockouts(feed[0], "user_id", order, bad, good, limit=6)
    streak, want = {}, set()
    for r in sorted(feed[0].collect(), key=lambda r: (r.ts, r.event_id)):
        if r.kind == "good" and r.value > 8:
            streak[r.user_id] = 0
        elif r.kind == "bad":
            streak[r.user_id] = streak.get(r.user_id, 0) + 1
            if streak[r.user_id] == 6:
                want.add(r.event_id)
    assert want
    assert {r.event_id for r in batch.collect()} == want
    assert {r.event_id for r in streamed.collect()} == want


def streaks(rows, limit, forget=None):
    """Event ids of lockouts, one row after the other."""
    open_, last, found = {}, {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[3] not in ("bad", "good"):
            continue
        if forget and r[2] in last and (r[1] - last[r[2]]).total_seconds() >= forget:
            open_[r[2]] = 0
        last[r[2]] = r[1]
        open_[r[2]] = 0 if r[3] == "good" else open_.get(r[2], 0) + 1
        if r[3] == "bad" and open_[r[2]] == limit:
            found.add(r[0])
    return found


@pytest.mark.parametrize("files, forget", [(1, None), (5, None), (5, 600), (1, 600)])
def test_hot_user_and_forgotten_streaks(spark, files, forget):
    """A third of the rows is one user's, one user has no name; streaks run over slices and batches, some are forgotten."""
    rng = random.Random(files)
    rows, at = [], T0
    for i in range(1500):
        at += timedelta(seconds=rng.choice([5, 20, 400]))
        rows.append((i, at, rng.choice(["hot", "a", "b", None]) if i % 3 else "hot", rng.choice(["bad", "bad", "bad", "good", "other"]) if i % 7 else "bad", 0.0))
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id string, kind string, value double")
    bad, good, order = F.col("kind") == "bad", F.col("kind") == "good", ["ts", "event_id"]
    location = ingest.in_time_order(df, "ts", files)
    got = state.lockouts_stream(ingest.read_stream(spark, location, df.schema, 1), "user_id", order, bad, good, "hot", limit=4, forget=forget)
    want = streaks(rows, 4, forget)
    assert len(want) > 30 and sorted(r.event_id for r in got.collect()) == sorted(want)
    assert sorted(r.event_id for r in state.lockouts(df, "user_id", order, bad, good, limit=4, forget=forget).collect()) == sorted(want)


def test_slices_merge_as_one(spark):
    """Summaries of any cuts of a history give the same streaks and the same lockouts."""
    rng = random.Random(3)
    for _ in range(300):
        kinds, limit = [rng.choice("bbbg") for _ in range(14)], rng.randrange(1, 5)
        whole = streaks([(i, T0 + timedelta(seconds=i), "u", "bad" if k == "b" else "good") for i, k in enumerate(kinds)], limit)
        cuts, streak, last, found = sorted({0, 14, *rng.sample(range(14), 4)}), 0, state.NEVER, set()
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = kinds[a:b]
            first = part.index("g") if "g" in part else len(part)
            open_hits = len(part) - 1 - max((i for i, k in enumerate(part) if k == "g"), default=-1)
            streak, last, reached = state.merged_streak(streak, last, {"begins": a, "ends": b, "first_hits": first, "has_reset": "g" in part, "open_hits": open_hits}, limit, None)
            if reached is not None:
                found.add(a + reached - 1)
            run = 0
            for i, k in enumerate(part):
                run = 0 if k == "g" else run + 1
                if i > first and k == "b" and run == limit:
                    found.add(a + i)
        assert found == whole


def test_lockouts_resume_from_their_folder(spark):
    """Streaks survive between two runs over one folder, as after a lost driver."""
    bad, good = F.col("kind") == "bad", F.col("kind") == "good"
    source, root = new_location(spark, "resume"), new_location(spark, "resume-state")
    rows = [(i, T0 + timedelta(seconds=i), "u", "bad", 0.0) for i in range(4)]
    schema = "event_id bigint, ts timestamp_ntz, user_id string, kind string, value double"
    for part in (rows[:2], rows[2:]):
        tables.append(spark.createDataFrame(part, schema), source)
        arriving = ingest.read_stream(spark, source, spark.createDataFrame([], schema).schema)
        found = state.lockouts_stream(arriving, "user_id", ["ts", "event_id"], bad, good, "r", root=root)
    assert [r.event_id for r in found.collect()] == [2]


def test_repeats_are_dropped(spark, feed):
    rows = stream(spark, feed, 4).withColumn("ts", F.col("ts").cast("timestamp"))
    once = ingest.drain(ingest.without_repeats(rows.unionByName(rows), ["event_id"], "ts"), "d")
    assert once.count() == feed[0].count()


def test_incremental_runs_load_each_file_once(spark):
    source, target, progress = (new_location(spark, n) for n in ("src", "dst", "chk"))
    for low in (0, 10):
        tables.append(spark.range(low, low + 10), source)
        ingest.load_available(ingest.read_stream(spark, source, spark.range(1).schema), target, progress)
        assert spark.read.parquet(target).count() == low + 10
    ingest.load_available(ingest.read_stream(spark, source, spark.range(1).schema), target, progress)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(20))


def test_hours_without_rows_count_as_zero(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(hours=3),)], "ts timestamp_ntz")
    rows = aggregates.hourly_throughput(df, "ts", floor=1).orderBy("hour").collect()
    assert [(r.n, r.below_floor) for r in rows] == [(1, False), (0, True), (0, True), (1, False)]


def test_rollup(spark):
    pages = spark.createDataFrame([(1, i, t, c) for i, (t, c) in enumerate([("x", 90.0), ("y", 80.0)])], "d int, p int, t string, c double")
    row = aggregates.page_rollup(pages, "d", "p", "t", "c", join_text=True).first()
    assert (row.text, row.confidence, row.pages, row.page_numbers, row.characters, row.least_confidence) == ("x y", 85.0, 2, 2, 2, 80.0)
    long = spark.range(10_004).select(F.lit(7).alias("d"), F.col("id").alias("p"), F.lit("t").alias("t"), F.lit(0.9).alias("c"))
    assert [(r.d, r.pages) for r in aggregates.page_rollup(long, "d", "p", "t", "c").collect()] == [(7, 10_004)]


def test_policies_open_notify_and_close(spark):
    table = {"hot": (60, "mean", "GT", 10.0, 120, 180, 300), "slow": (60, "p95", "LT", 1.0, 60, 120, None)}
    points = [("hot", "a", s, 20.0) for s in (0, 60, 120, 500)] + [("hot", "b", s, 1.0) for s in (0, 60)] + [("slow", "a", 0, 0.5), ("slow", "a", 10, 0.6), ("other", "a", 0, 9.0)]
    windows = alerts.policy_windows(spark.createDataFrame(points, "metric string, series string, second bigint, value double"), alerts.policy_table(spark, table))
    assert {(r.policy, r.series, r.window_second) for r in alerts.policy_fired(windows).collect()} == {("hot", "a", 60), ("slow", "a", 0)}
    events = sorted(tuple(r) for r in state.policy_transitions(windows, until=1000).collect())
    assert events == sorted([("hot", "a", 60, "OPEN"), ("hot", "a", 60, "NOTIFY"), ("hot", "a", 300, "CLOSE"),
                             ("slow", "a", 0, "OPEN"), ("slow", "a", 0, "NOTIFY"), ("slow", "a", 120, "CLOSE")])


def by_windows(df, seconds=300):
    closed = df.agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    rows = aggregates.align(df, ["user_id"], "ts", F.col("value"), seconds, "sum").collect()
    return {(r.window_start, r.user_id, r.value) for r in rows if r.window_start + timedelta(seconds=seconds) <= closed}


def by_stream(stream):
    rows = ingest.drain(windows.aligned(stream, ["user_id"], "ts", F.col("value"), 300, "sum"), "w").collect()
    return {(r.window_start, r.user_id, r.value) for r in rows}


def test_more_files_than_a_thousand_in_any_order(spark):
    df, location = events(spark, 1040), new_location(spark, "many")
    df.repartition(1040, "event_id").write.option("maxRecordsPerFile", 1).parquet(location)
    assert by_stream(ingest.read_stream(spark, location, df.schema)) == by_windows(df)


def test_shuffled_files_in_small_batches(spark):
    df, location = events(spark), new_location(spark, "shuffled")
    for part in (2, 0, 3, 1):
        tables.append(df.where(F.col("event_id") % 4 == part).coalesce(1), location)
    backlog = spark.read.parquet(location)
    ordered_files = ingest.in_time_order(backlog, "ts", 6)
    small = ingest.read_stream(spark, ordered_files, df.schema, 1)
    assert by_stream(small) == by_windows(df)
    stamped = small.withColumn("ts", F.col("ts").cast("timestamp"))
    assert ingest.drain(ingest.without_repeats(stamped, ["event_id"], "ts"), "d").count() == df.count()
    bad, good, order = F.col("kind") == "bad", (F.col("kind") == "good") & (F.col("value") > 8), ["ts", "event_id"]
    want = {r.event_id for r in state.lockouts(df, "user_id", order, bad, good, limit=6).collect()}
    assert want and {r.event_id for r in state.lockouts_stream(small, "user_id", order, bad, good, "l", limit=6).collect()} == want
    with pytest.raises(ValueError, match="behind the watermark"):
        by_stream(ingest.read_stream(spark, location, df.schema, 1))
    assert by_stream(ingest.read_stream(spark, ingest.in_time_order(df.where("false"), "ts", 3), df.schema, 1)) == set()


class _State:
    """The state of one user, as a task sees it."""

    def __init__(self, timed_out=False, **held):
        self.hasTimedOut, self.exists, self.get, self.timer = timed_out, bool(held), held.get("get"), None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, at):
        self.timer = at

    def getCurrentWatermarkMs(self):
        return 0


def test_users_without_lockout_build_no_frame():
    """Most users reach no limit, and time out later: neither costs a frame."""
    columns = ["slice", "number", "begins", "ends", "has_reset", "first_hits", "open_hits"]
    frames = [pd.DataFrame([(1, 0, 50_000_000, 60_000_000, False, 1, 1)], columns=columns), pd.DataFrame([(0, 0, 1, 2, True, 0, 0)], columns=columns)]
    fresh, gone, hit = _State(), _State(True, get=(1, 5)), _State(get=(1, 5))
    assert list(state.merged_user((7,), iter(frames), fresh, "u", 2, 100)) == [] and fresh.get == (1, 60_000_000) and fresh.timer == 160_000
    assert list(state.merged_user((7,), iter(()), gone, "u", 2, 100)) == [] and not gone.exists
    (out,) = state.merged_user((7,), iter(frames[:1]), hit, "u", 2, 100)
    assert out.to_dict("records") == [{"u": 7, "number": 0, "slice": 1, "reached": 1}] and hit.get == (2, 60_000_000)

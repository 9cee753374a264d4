"""Per-key state: alert life cycle, notification limits, lockouts.

The step functions are plain and shared by the batch and the streaming form, so both
give the same transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanworks import fixed
from gleanworks.operators import ordered
from gleanworks.operators.alerts import next_notification
from gleanworks.session import new_location
from gleanworks.streaming import ingest

NEVER = -1
# run length, last window, last breach, open flag, last notification (seconds; -1 is never)
ALERT_STATE = "run bigint, last bigint, breach bigint, is_open int, notified bigint"
FRESH = (0, NEVER, NEVER, 0, NEVER)


def alert_step(state: tuple, at: int, breach: bool, seconds: int, duration: int, auto_close: int,
               period: int) -> tuple[tuple, list[tuple[int, str]]]:
    """Advance one window; returns the new state and (time, event) transitions."""
    run, last, last_breach, is_open, notified = state
    events: list[tuple[int, str]] = []
    if is_open and at - last_breach >= auto_close:
        events.append((last_breach + auto_close, "CLOSE"))
        is_open = 0
    if breach:
        run = run + 1 if run and at - last == seconds else 1
        last_breach = at
        if run * seconds >= duration:
            if not is_open:
                events.append((at, "OPEN"))
                is_open = 1
            if next_notification(None if notified == NEVER else notified, at, period) and (
                run == max(1, -(-duration // seconds))
            ):
                events.append((at, "NOTIFY"))
                notified = at
    else:
        run = 0
    return (run, at, last_breach, is_open, notified), events


def _walk(state: tuple, frame: pd.DataFrame, **policy) -> tuple[tuple, list[tuple[int, str]]]:
    events = []
    for at, breach in frame.sort_values("at")[["at", "breach"]].itertuples(index=False):
        state, new = alert_step(state, int(at), bool(breach), **policy)
        events += new
    return state, events


def policy_transitions(windows: DataFrame, until: int | None = None) -> DataFrame:
    """OPEN, CLOSE and NOTIFY events per policy and series, each by its own policy (rows of ``alerts.policy_windows``).

    With ``until`` (seconds), a series that fell silent is closed once its auto-close time is over by then.
    """
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        policy = {name: int(frame[name].iloc[0]) for name in ("seconds", "duration", "auto_close", "period")}
        now, events = _walk(FRESH, frame.rename(columns={"window_second": "at"}), **policy)
        if until is not None and now[3] and until - now[2] >= policy["auto_close"]:
            events.append((now[2] + policy["auto_close"], "CLOSE"))
        return pd.DataFrame([(*key, at, event) for at, event in events], columns=["policy", "series", "at", "event"])

    return windows.groupBy("policy", "series").applyInPandas(run, "policy string, series string, at bigint, event string")


def policy_transitions_stream(windows: DataFrame, delay: str = fixed.WATERMARK) -> DataFrame:
    """The same events from a stream of policy windows; state survives restarts.

    An open alert has an event-time timer at the end of its auto-close time: a series that falls silent is closed once
    the watermark (``delay`` behind the newest window's start) gets there, without another row of it. So the events equal
    those of ``policy_transitions`` with ``until`` at the last watermark.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, auto_close, events = (state.get[:5], state.get[5], []) if state.exists else (FRESH, 0, [])
        if not state.hasTimedOut:
            frame = pd.concat(frames).rename(columns={"window_second": "at"})
            policy = {name: int(frame[name].iloc[0]) for name in ("seconds", "duration", "auto_close", "period")}
            auto_close = policy["auto_close"]
            now, events = _walk(now, frame, **policy)
        closes = now[2] + auto_close
        if now[3] and state.getCurrentWatermarkMs() >= closes * 1000:
            events.append((closes, "CLOSE"))
            now = (*now[:3], 0, now[4])
        state.update((*now, auto_close))
        if now[3]:
            state.setTimeoutTimestamp(max(closes * 1000 - 1, state.getCurrentWatermarkMs() + 1))  # fires once the watermark is past it
        yield pd.DataFrame([(*key, at, event) for at, event in events], columns=["policy", "series", "at", "event"])

    rows = windows.withColumn("_at", F.timestamp_seconds("window_second")).withWatermark("_at", delay)
    return rows.groupBy("policy", "series").applyInPandasWithState(
        run, "policy string, series string, at bigint, event string", f"{ALERT_STATE}, auto_close bigint", "append", GroupStateTimeout.EventTimeTimeout)


def lockouts(events: DataFrame, user: str, order: list[str], failed: Column, succeeded: Column,
             limit: int = fixed.LOCKOUT_FAILURES, forget: int | None = None) -> DataFrame:
    """Rows at which a user reaches ``limit`` failures since the last success, or since ``forget`` seconds without a row."""
    if forget is None:
        counted = ordered.with_streak(events.where(failed | succeeded), [user], order, failed, succeeded, "streak")
        return counted.where(failed & (F.col("streak") == limit)).select(*events.columns)
    rows = ordered.with_previous(events.where(failed | succeeded), [user], order, F.col(order[0]), "_last_row")
    gap = F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(F.col("_last_row").cast("timestamp"))
    # a streak that is forgotten is a reset of its own, just before the row that comes so late
    marked = rows.withColumn("_turn", F.explode(F.when(gap >= forget * 1_000_000, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    counted = ordered.with_streak(marked.drop("_last_row"), [user], [*order, "_turn"], failed & (F.col("_turn") == 1), succeeded | (F.col("_turn") == 0), "streak")
    return counted.where(failed & (F.col("_turn") == 1) & (F.col("streak") == limit)).select(*events.columns)


def merged_streak(streak: int, last: int, part: dict, limit: int, forget: int | None) -> tuple[int, int, int | None]:
    """A user's open streak after one more slice: the streak, the time of its last row, and which of the slice's first
    failures reaches the limit with what was open before (counted from 1), if any.

    A slice is summed up by its first and last time (microseconds), its failures before its first reset (``first_hits``),
    whether it has a reset, and its failures since the last one (``open_hits``); sums of neighbouring slices merge the
    same way, so their number and cuts do not matter.
    """
    if last != NEVER and forget is not None and part["begins"] - last >= forget * 1_000_000:
        streak = 0
    reached = limit - streak if streak < limit <= streak + part["first_hits"] else None
    return part["open_hits"] if part["has_reset"] else streak + part["open_hits"], part["ends"], reached


def merged_user(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, user: str, limit: int, forget: int | None) -> Iterator[pd.DataFrame]:
    """One user's new slices merged into the state; a frame only if a slice reaches the limit."""
    held = ("slice", "number", "begins", "ends", "has_reset", "first_hits", "open_hits")
    if state.hasTimedOut:
        state.remove()
        return
    streak, last = state.get if state.exists else (0, NEVER)
    # most users have a slice or two in a batch and no lockout: nothing is built for them
    parts = [dict(zip(held, part, strict=True)) for frame in frames for part in zip(*(frame[c].tolist() for c in held), strict=True)]
    found = []
    for part in sorted(parts, key=lambda p: (p["number"], p["slice"])):
        streak, last, reached = merged_streak(streak, last, part, limit, forget)
        if reached is not None:
            found.append((key[0], part["number"], part["slice"], reached))
    if streak:
        state.update((int(streak), int(last)))
        if forget is not None:
            state.setTimeoutTimestamp(max(last // 1000 + forget * 1000, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if found:
        yield pd.DataFrame(found, columns=[user, "number", "slice", "reached"])


def lockouts_stream(stream: DataFrame, user: str, order: list[str], failed: Column, succeeded: Column, label: str,
                    limit: int = fixed.LOCKOUT_FAILURES, root: str | None = None, forget: int | None = None) -> DataFrame:
    """Lockout rows from a stream; the open streak of each user is keyed state.

    Every micro-batch is cut into slices of users' rows, so a busy user does not end up in one task. What happens within
    a slice is written at once; each slice leaves a summary of a few numbers and its first failures. A second stream
    reads the summaries and merges them into the state of their user: one row per user in RocksDB, changed only where the
    user has rows, and dropped when the streak ends or, by an event-time timer, when it is forgotten. All output is
    written per batch id, so a repeated batch replaces its own. Pass the same ``root`` again to resume after the driver
    was lost. Later batches must be later in time: read a backlog in one batch, or from ``ingest.in_time_order``.
    """
    spark = stream.sparkSession
    root = root or new_location(spark, label)
    ts = order[0]

    def handle(batch: DataFrame, number: int) -> None:
        rows = ordered.streak_slices(batch, [user], order, failed, succeeded, limit, ts, forget)
        place = f"{root}/slices/batch={number}"
        rows.where(failed & F.col("closed") & (F.col("streak") == limit)).select(*stream.columns).write.mode("overwrite").parquet(f"{root}/within/batch={number}")
        rows.where(failed & ~F.col("closed") & (F.col("streak") <= limit)).write.mode("overwrite").parquet(f"{root}/first/batch={number}")
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        rows.groupBy(user, "slice").agg(
            F.lit(number).cast("bigint").alias("number"), F.min(at).alias("begins"), F.max(at).alias("ends"), F.max("closed").alias("has_reset"),
            F.count_if(failed & ~F.col("closed")).alias("first_hits"), F.max_by("streak", F.struct(*order)).alias("open_hits")).write.mode("overwrite").parquet(place)

    (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).start().awaitTermination()
    )

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from merged_user(key, frames, state, user, limit, forget)

    kind = stream.schema[user].dataType.simpleString()
    slices = f"`{user}` {kind}, slice int, number bigint, begins bigint, ends bigint, has_reset boolean, first_hits bigint, open_hits bigint"
    spark.createDataFrame([], slices).coalesce(1).write.mode("ignore").parquet(f"{root}/slices/batch=-1")
    summaries = spark.readStream.schema(spark.createDataFrame([], slices).schema).parquet(f"{root}/slices/batch=*")
    reached = summaries.withColumn("_at", F.timestamp_micros("ends")).withWatermark("_at", fixed.WATERMARK).groupBy(user).applyInPandasWithState(
        merge, f"`{user}` {kind}, number bigint, slice int, reached bigint", "streak bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    ingest.refuse_late(ingest.load_available(reached, f"{root}/reached", f"{root}/reached-progress"), label)
    hits = spark.read.schema(reached.schema).parquet(f"{root}/reached").select(F.col(user).alias("_user"), "number", F.col("slice").alias("_slice"), "reached")
    empty = spark.createDataFrame([], stream.schema)
    for part in ("within", "first"):
        extra = empty if part == "within" else empty.withColumn("slice", F.lit(0)).withColumn("streak", F.lit(0).cast("bigint")).withColumn("closed", F.lit(False))
        extra.coalesce(1).write.mode("ignore").parquet(f"{root}/{part}/batch=-1")
    first = spark.read.option("basePath", f"{root}/first").parquet(f"{root}/first/batch=*")
    across = first.join(hits, F.col(user).eqNullSafe(F.col("_user")) & (F.col("batch") == F.col("number")) & (F.col("slice") == F.col("_slice")) & (F.col("streak") == F.col("reached")))
    within = spark.read.schema(stream.schema).option("basePath", f"{root}/within").parquet(f"{root}/within/batch=*")
    return within.select(*stream.columns).union(across.select(*stream.columns))

"""Order-dependent results per key that stay parallel when one key is hot.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task. Here rows are dealt out once by ranges of
(key, order) and written, with the number of their range. Rows are then windowed per (key, range), and one summary row
per key and range carries the state from range to range. The ranges have about equal sizes whatever the keys, so a hot
key, a null key and a burst of equal times all spread; there is one path for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.session import new_location

_KEY, _RANGE, _CARRY, _INNER = "_key", "_range", "_carry", "_inner"


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with their key as one value (never null itself) and the number of their range, from a written table."""
    spark = df.sparkSession
    placed = df.withColumn(_KEY, F.struct(*keys)).repartitionByRange(*keys, *order).withColumn(_RANGE, F.spark_partition_id())
    location = new_location(spark, "ordered")
    placed.write.parquet(location)
    return spark.read.schema(placed.schema).parquet(location)


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows, written once, with the number of their ``slice``: a range of a key's rows that lies before the next one's."""
    return _ranged(df, keys, order).select(*df.columns, F.col(_RANGE).alias("slice"))


def _across(descending: bool):
    return Window.partitionBy(_KEY).orderBy(F.col(_RANGE).desc() if descending else F.col(_RANGE).asc())


def _combine(df, keys, order, inner, summary, carried, result, name) -> DataFrame:
    rows = _ranged(df, keys, order)
    ends = rows.groupBy(_KEY, _RANGE).agg(summary.alias(_CARRY)).select(_KEY, _RANGE, carried.alias(_CARRY))
    return rows.withColumn(_INNER, inner).join(ends, [_KEY, _RANGE]).withColumn(name, result).select(*df.columns, name)


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the previous row's ``value`` within each key; null on the first row."""
    box = F.struct(value.alias("v"))
    return _combine(
        df, keys, order,
        inner=F.lag(box).over(Window.partitionBy(_KEY, _RANGE).orderBy(*order)),
        summary=F.max_by(box, F.struct(*order)),
        carried=F.lag(_CARRY).over(_across(False)),
        result=F.coalesce(F.col(_INNER), F.col(_CARRY)).getField("v"),
        name=name,
    )


def with_running_total(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str,
                       descending: bool = False) -> DataFrame:
    """Add the sum of ``amount`` from the first row of the key up to and including this one."""
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return _combine(
        df, keys, order,
        inner=F.sum(amount).over(Window.partitionBy(_KEY, _RANGE).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)),
        summary=F.sum(amount),
        carried=F.sum(_CARRY).over(_across(descending).rowsBetween(Window.unboundedPreceding, -1)),
        result=F.coalesce(F.col(_INNER) + F.col(_CARRY), F.col(_INNER), F.col(_CARRY)),
        name=name,
    )


def with_running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the largest ``value`` from the first row of the key up to and including this one."""
    return _combine(
        df, keys, order,
        inner=F.max(value).over(Window.partitionBy(_KEY, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)),
        summary=F.max(value),
        carried=F.max(_CARRY).over(_across(False).rowsBetween(Window.unboundedPreceding, -1)),
        result=F.greatest(F.col(_INNER), F.col(_CARRY)),  # null-tolerant: takes the one that is set
        name=name,
    )


def with_streak(df: DataFrame, keys: list[str], order: list[str], hit: Column, reset: Column, name: str) -> DataFrame:
    """Add the number of hits since the last reset row of the key, this row included.

    ``<name>_closed`` tells whether the key has had a reset up to this row.
    """
    inside = Window.partitionBy(_KEY, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _ranged(df, keys, order).withColumn("_hits", F.sum(hit.cast("bigint")).over(inside)).withColumn(
        "_at_reset", F.max(F.when(reset, F.col("_hits"))).over(inside)
    )
    earlier = _across(False).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(_KEY, _RANGE).agg(F.sum(hit.cast("bigint")).alias("_sum"), F.max("_at_reset").alias("_last"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .withColumn("_base", F.max(F.col("_before") + F.col("_last")).over(earlier))
        .select(_KEY, _RANGE, "_before", "_base")
    )
    joined = rows.join(carried, [_KEY, _RANGE])
    open_streak = F.col("_hits") + F.col("_before") - F.coalesce(F.col("_base"), F.lit(0))
    streak = F.when(F.col("_at_reset").isNotNull(), F.col("_hits") - F.col("_at_reset")).otherwise(open_streak)
    closed = F.col("_at_reset").isNotNull() | F.col("_base").isNotNull()
    return joined.withColumn(name, streak).withColumn(f"{name}_closed", closed).select(*df.columns, name, f"{name}_closed")


def streak_slices(df: DataFrame, keys: list[str], order: list[str], hit: Column, reset: Column, limit: int, ts: str,
                  forget: int | None = None) -> DataFrame:
    """Rows that are a hit or a reset, with their slice and what that slice alone knows of the streak.

    Slices are the ranges of a key's rows, so a hot key has many. Adds ``slice``, ``streak`` (hits since the slice's last
    reset, or since its begin) and ``closed`` (the slice has had a reset up to this row). With ``forget`` (seconds) a row
    so long after the one before it starts a new streak.
    """
    inside = Window.partitionBy(_KEY, _RANGE).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = _ranged(df.where(hit | reset), keys, order)
    rows = rows.withColumn("_hits", F.sum(hit.cast("bigint")).over(upto))
    starts = F.when(reset, F.col("_hits"))
    if forget is not None:
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        starts = starts.when(at - F.lag(at).over(inside) >= forget * 1_000_000, F.col("_hits") - 1)
    rows = rows.withColumn("_start", starts).withColumn("_base", F.max("_start").over(upto))
    return rows.select(*df.columns, F.col(_RANGE).alias("slice"), (F.col("_hits") - F.coalesce("_base", F.lit(0))).alias("streak"),
                       F.col("_base").isNotNull().alias("closed"))


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str, descending: bool = False) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return with_running_total(df, keys, order, F.lit(1).cast("bigint"), name, descending)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def trailing_share(df: DataFrame, keys: list[str], second: Column, hit: Column, seconds: int,
                   name: str = "share") -> DataFrame:
    """Share of hits per key over the trailing ``seconds``, once per second with activity.

    Rows are first reduced to one per (key, second). Each second is then copied into
    the following time block when that block's frame reaches back to it, so frames
    are complete although every block is its own window partition.
    """
    block = max(seconds * 60, 3600)
    counts = df.groupBy(*keys, second.alias("second")).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits")
    )
    home = F.floor(F.col("second") / block)
    reach = F.floor((F.col("second") + seconds) / block)
    spread = counts.withColumn("_block", F.explode(F.sequence(home, reach)))
    frame = Window.partitionBy(*keys, "_block").orderBy("second").rangeBetween(-seconds, 0)
    return (
        spread.withColumn("total", F.sum("n").over(frame))
        .withColumn("failed", F.sum("hits").over(frame))
        .where(F.col("_block") == home)
        .withColumn(name, F.col("failed") / F.col("total"))
        .select(*keys, "second", "total", "failed", name)
    )

"""File streams in, tables out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from gleanworks import fixed
from gleanworks.session import new_location


def read_stream(spark: SparkSession, location: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a table, present and future, as a stream under a declared schema.

    ``location`` is a folder of part files; a glob also allows a single file. All files that are there form one
    micro-batch, so that no row of a backlog is late, in whatever order its files lie. With ``files_per_trigger`` a batch
    holds at most so many files, oldest first: what depends on event time then needs files in time order (``in_time_order``).
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(location)


def in_time_order(rows: DataFrame, ts: str, files: int, label: str = "in-time-order") -> str:
    """A backlog written again as at most ``files`` files, each later in time and written later than the one before.

    Returns the new table's location. A stream reads it in small batches without a late row, as equal times share a file.
    """
    spark = rows.sparkSession
    ranged, target = new_location(spark, f"{label}-ranges"), new_location(spark, label)
    dealt = rows.repartitionByRange(files, ts).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(ranged)
    held = spark.read.schema(dealt.schema).parquet(ranged)
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(target)
    for (number,) in sorted(held.select("_range").distinct().collect()):  # one write each, so that ages follow times
        held.where(F.col("_range") == number).select(*rows.columns).coalesce(1).write.mode("append").parquet(target)
    return target


def run_available(stream: DataFrame, target: str, checkpoint: str) -> list[dict]:
    """Append everything that has arrived since the last run to ``target``, exactly once; the progress of each batch.

    The checkpoint holds what is done: a rerun after a lost driver or executor resumes where the last committed batch ended.
    """
    conf, kept = stream.sparkSession.conf, "spark.sql.streaming.numRecentProgressUpdates"
    before = conf.get(kept)
    conf.set(kept, 1 << 30)  # the progress of all batches, not of the last hundred
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", target).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        conf.set(kept, before)
    query.awaitTermination()
    return query.recentProgress


def _late(progress: list) -> int:
    return sum(operator.numRowsDroppedByWatermark for batch in progress for operator in batch.stateOperators)


def load_available(stream: DataFrame, target: str, checkpoint: str) -> int:
    """As ``run_available``; returns how many rows stateful operators dropped because they lay behind the watermark,
    counted as the operators see them (aggregates combine before)."""
    return _late(run_available(stream, target, checkpoint))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all available input into a fresh table and return that table; late rows are an error."""
    return stream.sparkSession.read.schema(stream.schema).parquet(drain_to(stream, label))


def drain_to(stream: DataFrame, label: str) -> str:
    """As ``drain``, returning the table's location, which a further stream can read."""
    spark = stream.sparkSession
    target, checkpoint = new_location(spark, f"{label}-table"), new_location(spark, f"{label}-progress")
    refuse_late(load_available(stream, target, checkpoint), label)
    return target


def refuse_late(late: int, label: str) -> None:
    """Fail if rows were dropped behind the watermark."""
    if late:
        raise ValueError(f"{label}: {late} rows lay behind the watermark; read all files in one batch, in_time_order, or split_late first")


def drain_whole(spark: SparkSession, location: str, schema: StructType, make: Callable[[DataFrame], DataFrame], label: str,
                seconds: int, ts: str = "ts", delay: str = fixed.WATERMARK, files_per_trigger: int | None = None) -> DataFrame:
    """All results of ``make(stream)`` over a table's files, windows that are still open at its end too.

    A closing step follows the last batch. It reads one row more that has nothing but an event time, later than the newest
    by the delay and ``seconds`` (the longest window), so the watermark passes each window left in the state and the
    operators emit it themselves. The row's own window has null keys and stays open. ``make`` may join and filter, but
    rows without any value but ``ts`` must get through to its watermark, and ``delay`` is that watermark's; a watermark that
    does not move and late rows are errors. The input is at its end afterwards: to go on later, use ``run_available``.
    """
    target = drain_whole_to(spark, location, schema, make, label, seconds, ts, delay, files_per_trigger)
    return spark.read.schema(make(read_stream(spark, location, schema)).schema).parquet(target)


def drain_whole_to(spark: SparkSession, location: str, schema: StructType, make: Callable[[DataFrame], DataFrame], label: str,
                   seconds: int, ts: str = "ts", delay: str = fixed.WATERMARK, files_per_trigger: int | None = None) -> str:
    """As ``drain_whole``, returning the table's location, which a further stream can read."""
    target, checkpoint, marks = (new_location(spark, f"{label}-{part}") for part in ("table", "progress", "marks"))
    spark.createDataFrame([], schema).coalesce(1).write.parquet(marks)
    result = make(read_stream(spark, location, schema, files_per_trigger).unionByName(read_stream(spark, marks, schema)))
    progress = run_available(result, target, checkpoint)
    newest = [batch.eventTime["max"] for batch in progress if "max" in batch.eventTime]
    if newest:
        amount, unit = delay.split()
        wait = timedelta(**{unit if unit.endswith("s") else f"{unit}s": int(amount)}) + timedelta(seconds=seconds + 1)
        end = datetime.fromisoformat(max(newest)) + wait
        others = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema if field.name != ts]
        mark = spark.range(1, numPartitions=1).select(F.timestamp_seconds(F.lit(int(end.timestamp()) + 1)).cast(schema[ts].dataType).alias(ts), *others)
        mark.select(*schema.names).write.mode("append").parquet(marks)
        closing = run_available(result, target, checkpoint)
        if not any(datetime.fromisoformat(batch.eventTime["watermark"]) >= datetime.fromisoformat(max(newest)) for batch in closing if "watermark" in batch.eventTime):
            raise ValueError(f"{label}: the closing row did not reach the watermark")
        progress = [*progress, *closing]
    refuse_late(_late(progress), label)
    return target


def in_arrival_order(rows: DataFrame, arrival: Column | str, label: str = "in-arrival-order") -> str:
    """A backlog written again with one file set per value of ``arrival``, in ascending order; the new table's location.

    Streamed by its files it arrives as it once did. The values of ``arrival`` are few (days, hours): each is one write.
    """
    spark = rows.sparkSession
    dealt, target = new_location(spark, f"{label}-dealt"), new_location(spark, label)
    arranged = rows.withColumn("_arrival", arrival if isinstance(arrival, Column) else F.col(arrival))
    arranged.repartition("_arrival").write.partitionBy("_arrival").parquet(dealt)
    held = spark.read.schema(arranged.schema).parquet(dealt)
    spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(target)
    for (value,) in sorted(held.select("_arrival").distinct().collect()):
        held.where(F.col("_arrival") == value).select(*rows.columns).coalesce(1).write.mode("append").parquet(target)
    return target


def split_late(stream: DataFrame, ts: str, label: str, delay: str = fixed.WATERMARK, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables of the rows of a stream that are on time and of those behind the watermark, which stateful operators would drop.

    The watermark of a batch is the newest event time of the batches before it, less the delay (Spark's operators drop rows
    behind that of one batch earlier, so what is on time here is never dropped there). Each batch is
    written once, dealt by lateness under its batch number, and the newest event time is observed in that same write and
    kept beside it; a repeated batch replaces its own rows. Rows without an event time are on time. Pass the same
    ``root`` again to go on after the driver was lost, or when more files have arrived.
    """
    spark = stream.sparkSession
    root = root or new_location(spark, label)
    clock = "newest timestamp"

    def handle(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(clock).parquet(f"{root}/clock/batch={number - 1}").first()["newest"] if number else None
        limit = F.lit(known).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts).cast("timestamp") < limit, F.lit(False))
        seen = Observation()
        batch.withColumn("_late", late).observe(seen, F.max(F.col(ts).cast("timestamp")).alias("newest")).write.mode("overwrite").partitionBy("_late").parquet(f"{root}/rows/batch={number}")
        newest = max((t for t in (known, seen.get["newest"]) if t is not None), default=None)
        spark.createDataFrame([(newest,)], clock).coalesce(1).write.mode("overwrite").parquet(f"{root}/clock/batch={number}")

    spark.createDataFrame([], stream.schema).coalesce(1).write.mode("ignore").parquet(f"{root}/rows/batch=-1/_late=false")  # so that there is a table before the first batch
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination())
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", StringType()), StructField("_late", BooleanType())])).option(
        "basePath", f"{root}/rows").parquet(f"{root}/rows/batch=*")
    on_time, behind = (found.where(c).select(*stream.columns) for c in ("not _late", "_late"))
    return on_time, behind


def without_repeats(stream: DataFrame, keys: list[str], ts: str, delay: str = fixed.WATERMARK) -> DataFrame:
    """Drop repeated keys that arrive within the watermark delay of the first; state is dropped once the watermark passes it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)

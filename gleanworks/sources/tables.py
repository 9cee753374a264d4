"""Tables on shared storage: creation, appends, layout, keyed changes, retention.

Changes never overwrite the path they read. Each returns the new state as a
DataFrame; ``publish`` writes it to a new location.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType,
)

from gleanworks import fixed
from gleanworks.functions import shapes, times, urls
from gleanworks.operators import joins, ordered, transitions
from gleanworks.session import new_location

# Warehouse type names and the matching Spark types.
FIELD_TYPES = {
    "STRING": StringType(), "INTEGER": LongType(), "FLOAT": DoubleType(), "BOOLEAN": BooleanType(),
    "TIMESTAMP": TimestampType(), "DATE": DateType(), "JSON": StringType(),
}


def schema_of(fields: list[dict]) -> StructType:
    """Schema from a field list of ``name``, ``type`` and optional ``mode`` (REQUIRED)."""
    return StructType([
        StructField(f["name"], FIELD_TYPES[f["type"]], f.get("mode", "NULLABLE") != "REQUIRED") for f in fields
    ])


def create(spark: SparkSession, location: str, fields: list[dict], partitions: list[str] = ()) -> StructType:
    """Create an empty table; an existing one is an error."""
    schema = schema_of(fields)
    spark.createDataFrame([], schema).write.mode("errorifexists").partitionBy(*partitions).parquet(location)
    return schema


def append(df: DataFrame, location: str, schema: StructType | None = None, partitions: list[str] = ()) -> None:
    """Append rows, in the column order and types of ``schema`` when one is given."""
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]) if schema else df
    rows.write.mode("append").partitionBy(*partitions).parquet(location)


def publish(df: DataFrame, label: str, partitions: list[str] = ()) -> DataFrame:
    """Write to a location no run has used before and read the table back."""
    spark = df.sparkSession
    location = new_location(spark, label)
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(location)
    return spark.read.schema(df.schema).parquet(location)


def by_day(df: DataFrame, ts: str, cluster: list[str], day: str = "day") -> DataFrame:
    """Lay rows out for a day-partitioned, clustered table.

    Ranges follow (day, cluster columns, time), so a heavy day or a heavy cluster key
    spreads over several tasks, and files stay sorted for row-group skipping.
    """
    order = [day, *cluster, ts]
    return df.withColumn(day, F.to_date(ts)).repartitionByRange(*order).sortWithinPartitions(*order)


def query(spark: SparkSession, sql: str, parameters: list | dict, **views: DataFrame) -> DataFrame:
    """Parametrised SQL; values are bound, never spliced into the text."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=parameters)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Whole-row replacement by key, last write wins; ``base`` holds each key once.

    The base is not re-aggregated: it meets only the latest change per key, which AQE
    broadcasts when it proves small at run time.
    """
    latest = ordered.latest_per_key(changes.select(*base.columns), [key], order)
    packed = latest.select(key, F.struct(*base.columns).alias("_new"))
    own = F.struct(*base.columns)
    newer = F.col("_new").isNotNull() & (
        F.struct(*[F.col(f"_new.{c}") for c in order]) >= F.struct(*order)
    )
    kept = base.join(packed, key, "left").select(F.when(newer, F.col("_new")).otherwise(own).alias("_row")).select("_row.*")
    added = latest.join(base.select(key), key, "left_anti").select(*base.columns)
    return kept.select(*base.columns).unionByName(added)


def delete_keys(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the given keys."""
    gone = keys.select(key).distinct()
    return {name: table.join(gone, key, "left_anti").select(*table.columns) for name, table in tables.items()}


def flag_archived(df: DataFrame, keys: DataFrame, key: str, at: Column) -> DataFrame:
    """Mark rows of the given keys as archived with the archive time."""
    marked = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        df.join(marked, key, "left")
        .withColumn("archived", F.col("_hit").isNotNull())
        .withColumn("archived_at", F.when(F.col("_hit"), at))
        .drop("_hit")
    )


def move_to_archive(df: DataFrame, chosen: Column, now: Column, days: int = fixed.ARCHIVE_DAYS) -> tuple[DataFrame, DataFrame]:
    """(archived rows with their expiry, rows that stay)."""
    pick = F.coalesce(chosen, F.lit(False))
    archived = df.where(pick).withColumn("retention_expiry", times.plus_days(now, F.lit(days)))
    return archived, df.where(~pick)


def retention_actions(df: DataFrame, kind: str, ts: str, now: Column,
                      policy: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """ACTIVE, ARCHIVE or DELETE per row by the age limits of its data type."""
    rules = joins.rule_table(
        df.sparkSession, policy or fixed.RETENTION_DAYS, f"{kind} string, active_days int, delete_days int"
    )
    age = times.age_days(F.col(ts), now)
    action = (
        F.when(age >= F.col("delete_days"), "DELETE").when(age >= F.col("active_days"), "ARCHIVE").otherwise("ACTIVE")
    )
    return df.join(rules, kind, "left").withColumn("age_days", age).withColumn("action", action)


def lifecycle_actions(df: DataFrame, name: list[str], order: list[str], now: Column) -> DataFrame:
    """DELETE versions old enough and superseded often enough; COLD storage by age alone."""
    numbered = ordered.with_position(df, name, order, "newest_first", descending=True)
    age = times.age_days(F.col(order[0]), now)
    newer = F.col("newest_first") - 1
    expired = (age >= fixed.LIFECYCLE_AGE_DAYS) & (newer >= fixed.LIFECYCLE_NEWER_VERSIONS)
    action = F.when(expired, "DELETE").when(age >= fixed.COLD_AGE_DAYS, "COLD").otherwise("KEEP")
    return numbered.withColumn("newer_versions", newer).withColumn("action", action).drop("newest_first")


def storage_path(file_name: Column, uploaded: Column, long_term: Column) -> Column:
    """Primary path, backup path and storage class of a document."""
    tail = F.concat(times.date_path(uploaded), F.lit("/"), F.md5(file_name), urls.extension(file_name))
    return F.struct(
        F.concat(F.lit("documents/"), tail).alias("path"),
        F.concat(F.lit("backup/"), tail).alias("backup_path"),
        F.when(long_term, "ARCHIVE").otherwise("STANDARD").alias("storage_class"),
    )


def batch_outcomes(requests: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Outcome row per requested operation; unknown documents and operations fail."""
    outcome = joins.batch_outcome(requests, documents, key)
    return outcome.withColumn("success", F.col("success") & F.col("operation").isin("PROCESS", "DELETE", "ARCHIVE")).withColumn(
        "status", F.when(F.col("success"), "COMPLETED").otherwise("FAILED")
    )


def unify(scraped: DataFrame, documents: DataFrame) -> DataFrame:
    """One structured table of both kinds, with a source type column; missing columns are null."""
    return scraped.withColumn("source_type", F.lit("SCRAPING")).unionByName(
        documents.withColumn("source_type", F.lit("DOCUMENT")), allowMissingColumns=True
    )


def new_jobs(configs: DataFrame, at: Column) -> DataFrame:
    """First row of each job in the status log: pending, version one, counters at zero."""
    zeros = {name: F.lit(0) for name in ("request_count", "bytes_processed", "items_scraped", "error_count", "retry_count")}
    return configs.withColumns({
        "status": F.lit("PENDING"), "version": F.lit(1), "created_at": at, "updated_at": at, **zeros,
    })


def status_update(log: DataFrame, updates: DataFrame, job: str, at: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted log rows, rejected updates); the updates of one job are applied in order of time, then status.

    The current row of each job is the latest of the append-only log. An accepted update raises the version by one and
    is what the next one is checked against; a rejected one changes nothing. Updates of one job spread over tasks, however
    many they are (``transitions.fold``).
    """
    current = ordered.latest_per_key(log, [job], ["version"]).select(job, F.col("status").alias("previous"), "version")
    pairs = fixed.STRICT_TRANSITIONS + ([] if strict else fixed.SCHEDULING_TRANSITIONS)
    folded = transitions.fold(updates.select(job, "status", at), job, [at, "status"], "status", current, pairs)
    version = F.col("version").cast(log.schema["version"].dataType).alias("version")
    return (folded.where("accepted").select(job, "status", version, F.col(at)),
            folded.where("not accepted").select(job, "previous", "status", F.col(at)))


def route(records: DataFrame, classification: str) -> DataFrame:
    """Storage area of each record: confidential and restricted data live apart."""
    secured = F.col(classification).isin("CONFIDENTIAL", "RESTRICTED")
    area = F.when(secured, F.concat(F.lit("secure/"), F.lower(classification))).otherwise(
        F.concat(F.lit("standard/"), F.lower(classification))
    )
    return records.withColumn("location", area).withColumn("encrypt", secured)



def with_identity(df: DataFrame, content: str) -> DataFrame:
    """Ingested documents: checksum and an identifier derived from it."""
    return df.withColumn("checksum", shapes.checksum(F.col(content))).withColumn(
        "document_id", shapes.uuid_from(F.col("checksum"))
    )

"""Files: listings, binary content, JSON configurations, exports and landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from gleanworks import fixed
from gleanworks.functions import shapes, times, urls
from gleanworks.functions.text import blank_if_null
from gleanworks.session import new_location


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(folder)
    )


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Name, size, time and type of the files under a folder; contents are not read."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = shapes.mime_for_extension(F.regexp_replace(urls.extension(name), r"^\.", ""))
    return _files(spark, folder, pattern).select(
        name.alias("name"), "path", F.col("length").alias("size"),
        F.col("modificationTime").alias("updated"), kind.alias("content_type"),
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Content of the matching files with checksum and derived identifier."""
    return _files(spark, folder, pattern).select(
        "path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"),
        shapes.uuid_from(F.col("path")).alias("document_id"),
    )


def read_json(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Line-delimited JSON under a declared schema; a malformed line is kept in ``_corrupt``."""
    return (
        spark.read.schema(schema.add("_corrupt", "string") if "_corrupt" not in schema.names else schema)
        .option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    )


def land_json(df: DataFrame, label: str, key: str, ts: str) -> DataFrame:
    """Write rows as gzip JSON by ingest date and read them back as (key, payload, date)."""
    spark = df.sparkSession
    location = new_location(spark, label)
    payload = df.select(
        F.col(key).cast("string").alias("id"), F.to_json(F.struct(*df.columns)).alias("payload"),
        F.to_date(ts).alias("ingest_date"),
    )
    ranged = payload.repartitionByRange("ingest_date", "id")
    ranged.write.partitionBy("ingest_date").option("compression", "gzip").json(location)
    return spark.read.schema("id string, payload string, ingest_date date").json(location)


def land_processed(df: DataFrame, label: str, key: str, version: str = "1.0.0") -> DataFrame:
    """Write processed payloads with their schema version as Parquet and read them back."""
    location = new_location(df.sparkSession, label)
    df.select(
        F.col(key).cast("string").alias("id"), F.to_json(F.struct(*df.columns)).alias("payload"),
        F.lit(version).alias("schema_version"),
    ).write.parquet(location)
    return df.sparkSession.read.schema("id string, payload string, schema_version string").parquet(location)


def export_json(df: DataFrame, location: str) -> None:
    df.write.mode("errorifexists").json(location)


def flatten(df: DataFrame) -> DataFrame:
    """Structs become dotted-name columns, arrays and maps JSON text, nulls empty strings."""
    def leaves(kind: StructType, prefix: str) -> list[Column]:
        found = []
        for field in kind.fields:
            path = f"{prefix}.`{field.name}`" if prefix else f"`{field.name}`"
            name = path.replace("`", "").replace(".", "_")
            if isinstance(field.dataType, StructType):
                found += leaves(field.dataType, path)
            elif isinstance(field.dataType, (ArrayType, MapType)):
                found.append(blank_if_null(F.to_json(F.col(path))).alias(name))
            else:
                found.append(blank_if_null(F.col(path)).alias(name))
        return found

    return df.select(*leaves(df.schema, ""))


def export_csv(df: DataFrame, location: str) -> None:
    flatten(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(location)


def landing_record(pages: DataFrame, url: str, content: str, at: Column) -> DataFrame:
    """Landing row of a collected document: identity, name, checksum, retention, flags."""
    return pages.select(
        F.concat(F.lit("doc-"), (F.unix_millis(at.cast("timestamp"))).cast("string"), F.lit("-"),
                 shapes.base64_text(F.col(url))).alias("document_id"),
        F.col(url).alias("source"),
        urls.last_segment(F.col(url)).alias("file_name"),
        F.octet_length(content).cast("bigint").alias("size"),
        shapes.checksum(F.col(content)).alias("checksum"),
        F.lit("standard").alias("retention_policy"),
        times.plus_days(at, F.lit(fixed.LANDING_RETENTION_DAYS)).alias("retention_expiry"),
        F.array(*map(F.lit, fixed.LANDING_FLAGS)).alias("compliance_flags"),
    )


def document_metadata(df: DataFrame, content: str, file_name: Column, long_term: Column, encrypted: Column,
                      audited: Column) -> DataFrame:
    """Name, type, size, checksum, retention and compliance flags of stored documents."""
    ext = F.regexp_replace(urls.extension(file_name), r"^\.", "")
    return df.withColumns({
        "file_name": file_name,
        "mime_type": shapes.mime_for_extension(ext),
        "size": F.octet_length(content).cast("bigint"),
        "checksum": F.sha2(F.col(content), 256),
        "retention_policy": times.retention_literal(long_term),
        "compliance_flags": F.array_compact(F.array(
            F.lit("checksum-verified"), F.when(encrypted, F.lit("encrypted")), F.when(audited, F.lit("audit-enabled")),
        )),
        "version": F.lit("1.0"),
    })

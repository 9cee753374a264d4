"""Joins the records need. Sides without a proven bound are never forced to broadcast."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanworks import fixed

RULE_ROWS_LIMIT = 10_000


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A configuration table, marked for broadcast while it is small; a larger one is joined as the planner sees fit."""
    names = StructType.fromDDL(schema).names
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    table = spark.createDataFrame(pa.table(columns), StructType.fromDDL(schema))
    return F.broadcast(table) if len(rows) <= RULE_ROWS_LIMIT else table


def salted_join(facts: DataFrame, lookup: DataFrame, keys: list[str], spread: Column,
                salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi join that splits every key of ``facts`` over ``salts`` tasks.

    ``lookup`` holds few rows per key and is repeated once per salt; ``spread`` is a
    well-distributed column of ``facts``. The join always shuffles: size estimates behind
    an explode are far too low, and a side broadcast on their word may not fit.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep the fact side can be salted")
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def merge_by_id(raw: DataFrame, processed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Raw payload, processed payload and table row of each id; incomplete ids drop out."""
    return raw.join(processed, key).join(rows, key)


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Every child with its parent, and parents without children once, with nulls.

    The same rows as a left join from ``parents``. A left join cannot split a parent with
    very many children over tasks; an inner join can, and the childless parents are found
    against the distinct child keys.
    """
    matched = parents.join(children, key)
    childless = parents.join(children.select(key).distinct(), key, "left_anti")
    return matched.unionByName(childless, allowMissingColumns=True)


def lineage(jobs: DataFrame, raw: DataFrame, processed: DataFrame, job_key: str, raw_key: str,
            how: str = "inner") -> DataFrame:
    """Follow job to raw record to processed record along shared key columns.

    ``left`` keeps jobs without raw records and raw records without processed ones.
    """
    if how == "left":
        return with_children(with_children(jobs, raw, job_key), processed, raw_key)
    return jobs.join(raw, job_key).join(processed, raw_key)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose key no parent has. Repeated parent keys fall away before the join."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def having(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs among the others, however often."""
    return rows.join(others.select(key).distinct(), key, "left_semi")


def permissions_table(spark: SparkSession, roles: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [
        (role, *permission.split(":"))
        for role, granted in (roles or fixed.ROLE_PERMISSIONS).items()
        for permission in granted
    ]
    return rule_table(spark, rows, "role string, resource string, action string")


def permitted(requests: DataFrame, spark: SparkSession, roles: dict[str, list[str]] | None = None) -> DataFrame:
    """Requests (role, resource, action) their role allows; ``full`` covers every action."""
    granted = permissions_table(spark, roles).select(
        F.col("role").alias("_role"), F.col("resource").alias("_resource"), F.col("action").alias("_action")
    )
    rule = (
        (F.col("role") == F.col("_role")) & (F.col("resource") == F.col("_resource"))
        & ((F.col("action") == F.col("_action")) | (F.col("_action") == "full"))
    )
    return requests.join(granted, rule, "left_semi")


def allowed_transitions(spark: SparkSession, strict: bool = True) -> DataFrame:
    pairs = fixed.STRICT_TRANSITIONS + ([] if strict else fixed.SCHEDULING_TRANSITIONS)
    return rule_table(spark, pairs, "previous string, status string")


def invalid_transitions(changes: DataFrame, spark: SparkSession, strict: bool = True) -> DataFrame:
    """Rows whose (previous, status) pair is not allowed. First rows have no previous status."""
    moves = changes.where(F.col("previous").isNotNull())
    return moves.join(allowed_transitions(spark, strict), ["previous", "status"], "left_anti")


def with_defaults(overrides: DataFrame, defaults: dict) -> DataFrame:
    """Fill null columns from the default configuration; an override wins where present."""
    columns = [
        F.coalesce(F.col(name), F.lit(defaults[name])).alias(name) if name in defaults else F.col(name)
        for name in overrides.columns
    ]
    extra = [F.lit(value).alias(name) for name, value in defaults.items() if name not in overrides.columns]
    return overrides.select(*columns, *extra)


def batch_outcome(requests: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Each requested id with whether a record exists for it."""
    known = records.select(key).distinct().withColumn("_found", F.lit(True))
    return requests.join(known, key, "left").withColumn("success", F.col("_found").isNotNull()).drop("_found")


def look_up(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row per wanted key; keys without a record keep null columns."""
    return wanted.join(records, key, "left")

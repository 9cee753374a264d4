"""Tables whose keyed changes write only those files again that can hold a changed key.

A table is a set of files, each with the least and the greatest key in it and a Bloom filter of its keys. Files of one
writing (a generation) are ranges of the key and overlap at most in a key that ends one and begins the next. A changed key
is looked up in each generation by its place among the files' ranges, then in the filter of the files it falls into; only
files where both say yes are read,
changed and written as a new generation. All others stay as they are, under their names. A filter errs on one side only:
it may ask for a file that does not hold the key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.operators import ordered
from gleanworks.session import new_location
from gleanworks.sources import tables

ROWS_PER_FILE = 1_000_000
#: Rows that one task sorts and writes as files: tasks, and so the blocks between them, do not grow in number with small files.
ROWS_PER_TASK = 1_000_000
#: Bits of a file's filter per row it may hold, and bits set per key: about one in fifty absent keys is asked for in vain.
BITS_PER_ROW, HASHES = 8, 4


@dataclass(frozen=True)
class KeyedTable:
    """``files``: file, generation, low, high, n; ``bits``: the words of the files' filters (file, word, bits)."""

    files: DataFrame
    bits: DataFrame
    key: str
    schema: object
    rows_per_file: int

    def names(self) -> list[str]:
        return sorted(r["file"] for r in self.files.select("file").collect())

    def rows(self) -> DataFrame:
        return _read(self.files.sparkSession, self.names(), self.schema)


def _read(spark, files: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _positions(key: Column, rows_per_file: int) -> Column:
    """The bits of a key's filter entry, as (word, bit) pairs."""
    size = 1 << max(6, (rows_per_file * BITS_PER_ROW - 1).bit_length())
    spots = [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(size)) for k in range(HASHES)]
    return F.array(*(F.struct(F.shiftright(s, 6).cast("int").alias("word"), s.bitwiseAND(F.lit(63)).cast("int").alias("bit")) for s in spots))


def create(df: DataFrame, key: str, label: str = "keyed", rows_per_file: int = ROWS_PER_FILE, generation: int = 0) -> KeyedTable:
    """The rows written as ranges of ``key`` of at most ``rows_per_file`` rows, with their index. A null key is the least."""
    spark, place = df.sparkSession, new_location(df.sparkSession, label)
    n = df.count()
    count = max(1, -(-n // ROWS_PER_TASK), min(-(-n // rows_per_file), spark.sparkContext.defaultParallelism))
    df.repartitionByRange(count, key).sortWithinPartitions(key).write.option("maxRecordsPerFile", rows_per_file).parquet(place)
    held = spark.read.schema(df.schema).parquet(place).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col(key).alias("k")).alias("k"))
    files = held.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"))
    spots = held.select("file", F.explode(_positions(F.col("k.k"), rows_per_file)).alias("p"))
    bits = spots.groupBy("file", "p.word").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
    return KeyedTable(tables.publish(files.withColumn("generation", F.lit(generation)), f"{label}-files"), tables.publish(bits, f"{label}-bits"), key, df.schema, rows_per_file)


def touched(table: KeyedTable, keys: DataFrame) -> list[str]:
    """The files that can hold one of the keys (a frame with the key's column)."""
    wanted = keys.select(F.struct(F.col(table.key).alias("k")).alias("k")).distinct()
    generations = [r["generation"] for r in table.files.select("generation").distinct().collect()]
    if not generations:
        return []
    asked = wanted.select(F.explode(F.array(*map(F.lit, generations))).alias("generation"), "k")
    held = table.files.select("generation", F.col("low").alias("k"), F.struct("low", "high", "file").alias("f"))
    begun = asked.join(held, ["generation", "k"]).select("k", "f.file")  # a key with many rows can begin several files
    both = held.withColumn("asks", F.lit(1)).unionByName(asked.withColumn("asks", F.lit(0)), allowMissingColumns=True)
    near = ordered.with_running_max(both, ["generation"], ["k", "asks"], F.col("f"), "in")
    inside = near.where((F.col("asks") == 0) & (F.col("k") <= F.col("in.high"))).select("k", "in.file").unionByName(begun)
    spots = inside.select("file", "k", F.explode(_positions(F.col("k.k"), table.rows_per_file)).alias("p")).select("file", "k", "p.word", "p.bit")
    seen = spots.join(table.bits, ["file", "word"], "left").groupBy("file", "k").agg(
        F.min(F.coalesce(F.expr("shiftright(bits, bit) & 1"), F.lit(0))).alias("all"))
    return sorted(r["file"] for r in seen.where("all = 1").select("file").distinct().collect())


def change(table: KeyedTable, keys: DataFrame, edit: Callable[[DataFrame], DataFrame], label: str = "keyed") -> KeyedTable:
    """The table after ``edit`` of the rows of all files that can hold one of the keys; the other files stay."""
    spark, names = table.files.sparkSession, touched(table, keys)
    newest = (table.files.agg(F.max("generation")).first()[0] or 0) + 1
    edited = tables.publish(edit(_read(spark, names, table.schema)), f"{label}-edited")  # made once; its ranges take several looks
    new = create(edited, table.key, label, table.rows_per_file, newest)
    gone = spark.createDataFrame([(n,) for n in names], "file string")
    files, bits = (old.join(gone, "file", "left_anti").unionByName(more) for old, more in ((table.files, new.files), (table.bits, new.bits)))
    return KeyedTable(tables.publish(files, f"{label}-files"), tables.publish(bits, f"{label}-bits"), table.key, new.schema, table.rows_per_file)


def upsert(table: KeyedTable, changes: DataFrame, order: list[str], label: str = "keyed") -> KeyedTable:
    """Whole rows replaced by key, the last write wins; keys that no file holds are added."""
    return change(table, changes, lambda rows: tables.upsert(rows, changes, table.key, order), label)


def delete(table: KeyedTable, keys: DataFrame, label: str = "keyed") -> KeyedTable:
    """The table without the rows of the keys."""
    return change(table, keys, lambda rows: tables.delete_keys({"t": rows}, keys, table.key)["t"], label)


def flag(table: KeyedTable, keys: DataFrame, at: Column, label: str = "keyed") -> KeyedTable:
    """Rows of the keys marked as archived; the table has the columns ``archived`` and ``archived_at``."""
    plain = [c for c in table.schema.names if c not in ("archived", "archived_at")]

    def mark(rows: DataFrame) -> DataFrame:
        marked = tables.flag_archived(rows.select(*plain), keys, table.key, at).select(table.key, F.col("archived").alias("_now"), F.col("archived_at").alias("_at"))
        met = rows.join(marked.distinct(), table.key, "left")
        hit = F.coalesce("_now", F.lit(False))
        return met.select(*plain, (F.col("archived") | hit).alias("archived"), F.when(hit, F.col("_at")).otherwise(F.col("archived_at")).alias("archived_at"))

    return change(table, keys, mark, label)

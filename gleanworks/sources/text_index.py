"""Free-text search that opens only files that can match.

Each file of a table has a bitmap of the hashed three-byte groups of its lower-case texts. A text that holds the term holds
all groups of the term, so a file whose bitmap lacks one of them has no match and is not read. The bitmaps have a fixed
size, whatever the file holds; a bit shared by two groups only lets a file through in vain, and the rows of the files
that are read are tested in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.operators import predicates
from gleanworks.session import new_location
from gleanworks.sources import tables

ROWS_PER_FILE = 100_000
#: log2 of the bits of a file's bitmap (128 kB).
BITS = 20


@dataclass(frozen=True)
class TextTable:
    """``bits``: the words of the files' bitmaps that are not empty (file, word, bits); ``files``: all files."""

    files: list[str]
    bits: DataFrame
    text: str
    schema: object


def _groups(data: np.ndarray) -> np.ndarray:
    """The bit of each three-byte group of a byte string."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint64)
    code = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        owner, texts = files.indices.to_numpy(), batch.column("text").to_pylist()
        for k, name in enumerate(files.dictionary.to_pylist()):
            joined = b"\0\0".join((texts[i] or "").encode() for i in np.flatnonzero(owner == k).tolist())
            held = np.unique(_groups(np.frombuffer(joined, np.uint8)))
            if len(held):
                words, first = np.unique(held >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (held & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words)), pa.array(words, pa.int32()), pa.array(bits.view(np.int64))], ["file", "word", "bits"])


def create(df: DataFrame, text: str, label: str = "text-index", rows_per_file: int = ROWS_PER_FILE, by: list[str] | None = None) -> TextTable:
    """The rows written as files of about ``rows_per_file`` rows, ranged by ``by`` if given, with their bitmaps."""
    spark, place = df.sparkSession, new_location(df.sparkSession, label)
    count = max(1, -(-df.count() // rows_per_file))
    (df.repartitionByRange(count, *by) if by else df.repartition(count)).write.parquet(place)
    held = spark.read.schema(df.schema).parquet(place).select(F.col("_metadata.file_path").alias("file"), F.lower(F.col(text)).alias("text"))
    bits = tables.publish(held.mapInArrow(_bitmaps, "file string, word int, bits long").groupBy("file", "word").agg(F.bit_or("bits").alias("bits")), f"{label}-bits")
    files = [r["file"] for r in held.select("file").distinct().collect()]
    return TextTable(sorted(files), bits, text, df.schema)


def candidates(table: TextTable, term: str) -> list[str]:
    """The files that can hold the term; terms of less than three bytes can be anywhere."""
    wanted: dict[int, int] = {}
    for bit in _groups(np.frombuffer(term.lower().encode(), np.uint8)).tolist():
        wanted[bit >> 6] = wanted.get(bit >> 6, 0) | 1 << (bit & 63)
    if not wanted:
        return table.files
    spark = table.bits.sparkSession
    asked = spark.createDataFrame([(w, b - (1 << 64) if b >> 63 else b) for w, b in wanted.items()], "word int, need long")  # as many rows as the term has groups
    met = table.bits.join(F.broadcast(asked), "word").where(F.col("bits").bitwiseAND(F.col("need")) == F.col("need"))
    return sorted(r["file"] for r in met.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file").collect())


def search(table: TextTable, term: str) -> DataFrame:
    """The rows whose text holds the term, whatever its case."""
    files, spark = candidates(table, term), table.bits.sparkSession
    rows = spark.read.schema(table.schema).parquet(*files) if files else spark.createDataFrame([], table.schema)
    return rows.where(predicates.text_search(F.col(table.text), term))

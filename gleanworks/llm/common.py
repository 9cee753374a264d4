"""Helpers shared by the corpus operators: intermediate tables, byte views of Arrow text, linked groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators import ordered
from gleanworks.session import new_location

WHITE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: One run of the white space that separates words, as a Java and DuckDB pattern.
WHITE_RUN = r"[\x20\x09-\x0D]+"
WHITE = np.zeros(256, bool)
WHITE[list(WHITE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a task looks at together.
SLICE_BYTES = 8 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: later plans start from files that survive lost executors."""
    path = new_location(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder for files that tasks write themselves."""
    return new_location(spark, f"llm-{label}")


def keyed(docs: DataFrame, key: str = "row") -> DataFrame:
    """The rows with a number of their own: the ``doc_id``, or for rows that share one or have none, a number after all ids.

    Only the rows that need a number are ranked, so a table with unique ids costs one count of its ids. Each step that
    goes back from an operator's answers to rows does so by this number.
    """
    several = stored(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("doc_id is null or _n > 1").select(F.col("doc_id").alias("_id")), "shared-ids")
    if several.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    met = F.col("doc_id").eqNullSafe(F.col("_id"))
    alone = docs.join(several, met, "left_anti").withColumn(key, F.col("doc_id").cast("long"))
    others = ordered.with_position(docs.join(several, met, "left_semi").withColumn("_all", F.lit(0)), ["_all"], docs.columns, key)
    return stored(alone.unionByName(others.drop("_all").withColumn(key, F.col(key) + F.lit(max(last, 0)))), "keyed")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of the text column, or one row."""
    for batch in batches:
        text = batch.column(column)
        if len(text) == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin, n = 0, len(text)
        while begin < n:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def byte_view(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins (one more entry for the end). Null counts as empty."""
    text = pc.fill_null(text, "")
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], width)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that are not white space, and the number of words before each row."""
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads], last[tails] = solid[heads], solid[tails]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def pieces(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The byte strings between consecutive bounds, without copying the data."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_pieces(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as binary values: the data without what lies between them, viewed through new bounds."""
    lengths = ends - begins
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    packed = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return pieces(packed, np.concatenate(([0], np.cumsum(lengths))))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the groups of linked positions in place; a group's label is its smallest position."""
    while len(left):
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            return
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def linked_groups(links: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every linked node, from links (a, b) between numbers.

    Alternating large-star and small-star rounds, each written to the shared folder; nothing is gathered but three
    numbers per round. Null ends and self-links are ignored. Returns (node, root) for nodes that are not their own root.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(ends.where("a is not null and b is not null and a <> b").distinct(), f"{label}-links")
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.union(floor.select("a", F.col("m").alias("b"))).distinct(), f"{label}-links")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"{label}: groups are still joining after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Token ids in binary files of patched frame-of-reference blocks.

File: magic; blocks; block starts (unsigned 64-bit); document ids (64-bit), null marks (a byte each) and id counts
(64-bit); trailer with the offsets of these parts and the counts; magic. A block holds BLOCK ids: its minimum (32 bits),
the bit width (8), the number of exceptions (16), the low bits of all differences to the minimum, then for each
exception its place (8) and its high bits (32). The last block is filled up with its minimum. All little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.llm.common import byte_view, folder, ragged, slices, stored
from gleanworks.llm.tokens import encoder, with_end

MAGIC = b"GWPFOR01"
BLOCK = 256
#: Share of a block's values that fit the width; the rest are exceptions.
PERCENTILE = 0.9
#: Bytes of text per file.
FILE_BYTES = 32 << 20
_HEAD = 7
_TRAILER = struct.Struct("<QQQQ")
_STEP = 2048


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value of the rows, as bytes."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(low.astype(f"<u{width // 8}")).view(np.uint8)
    bits = ((low[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(low), -1), axis=1, bitorder="little")


def _unpacked(packed: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(packed).view(f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    out = np.zeros((len(packed), BLOCK), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the blocks of some ids, and the size of each block. The last block is filled up."""
    n = -(-len(ids) // BLOCK)
    rows = np.zeros(n * BLOCK, np.uint32)
    rows[:len(ids)] = ids
    if n and len(ids) % BLOCK:
        rows[len(ids):] = ids[(n - 1) * BLOCK:].min()
    rows = rows.reshape(n, BLOCK)
    least = rows.min(axis=1, initial=2**32 - 1) if n else np.zeros(0, np.uint32)
    away = rows - least[:, None]
    needed = np.frexp(away.astype(np.float64))[1]
    k = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(needed, k, axis=1)[:, k] if n else np.zeros(0, np.int64)
    odd = needed > width[:, None]
    odds = odd.sum(axis=1)
    body = (BLOCK * width + 7) // 8
    sizes = (_HEAD + body + 5 * odds).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(n, np.dtype([("least", "<u4"), ("width", "u1"), ("odds", "<u2")]))
    head["least"], head["width"], head["odds"] = least, width, odds
    out[starts[:, None] + np.arange(_HEAD)] = head.view(np.uint8).reshape(n, _HEAD)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if w:
            packed = _packed(away[mine] & np.uint32((1 << int(w)) - 1), int(w))
            out[starts[mine][:, None] + _HEAD + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(odd)
    at = ragged(starts + _HEAD + body, odds)
    out[at] = place
    high = (away[row, place] >> width[row].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[ragged(starts + _HEAD + body + odds, 4 * odds)] = high.ravel()
    return out, sizes


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``, one row per block."""
    head = data[starts[:, None] + np.arange(_HEAD)].reshape(-1).view(np.dtype([("least", "<u4"), ("width", "u1"), ("odds", "<u2")]))
    width, odds = head["width"].astype(np.int64), head["odds"].astype(np.int64)
    body = (BLOCK * width + 7) // 8
    rows = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            rows[mine] = _unpacked(data[starts[mine][:, None] + _HEAD + np.arange((BLOCK * int(w) + 7) // 8)], int(w))
    row = np.repeat(np.arange(len(starts)), odds)
    place = data[ragged(starts + _HEAD + body, odds)]
    high = data[ragged(starts + _HEAD + body + odds, 4 * odds)].view("<u4")
    rows[row, place] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return rows + head["least"][:, None]


class Writer:
    """Writes ids of documents to one file, holding a bounded number of them."""

    def __init__(self, path: str) -> None:
        system, inner = pa.fs.FileSystem.from_uri(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(inner)
        self.file.write(MAGIC)
        self.rest, self.sizes, self.docs, self.counts, self.n_ids = np.zeros(0, np.uint32), [], [], [], 0

    def add(self, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(docs)
        self.counts.append(counts)
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for k in range(0, whole, _STEP * BLOCK):
            self._write(ids[k:min(whole, k + _STEP * BLOCK)])
        self.rest = ids[whole:]

    def _write(self, ids: np.ndarray) -> None:
        data, sizes = encode_blocks(ids)
        self.file.write(data.tobytes())
        self.sizes.append(sizes)

    def close(self) -> int:
        if len(self.rest):
            self._write(self.rest)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        ends = len(MAGIC) + np.cumsum(sizes)
        docs = pa.chunked_array(self.docs, pa.int64()).combine_chunks()
        index = len(MAGIC) + int(sizes.sum())
        self.file.write((ends - sizes).astype("<u8").tobytes())
        self.file.write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.file.write(docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        self.file.write(np.concatenate([np.zeros(0, np.int64), *self.counts]).astype("<u8").tobytes())
        self.file.write(_TRAILER.pack(index, len(sizes), len(docs), self.n_ids) + MAGIC)
        self.file.close()
        return self.n_ids


class Reader:
    """Reads any range of ids of a file by the index of block starts."""

    def __init__(self, path: str) -> None:
        system, inner = pa.fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        tail = self.file.read_at(_TRAILER.size + len(MAGIC), self.file.size() - _TRAILER.size - len(MAGIC))
        if tail[-len(MAGIC):] != MAGIC:
            raise ValueError(f"{path} is not a whole token file")
        self.index, blocks, docs, self.n_ids = _TRAILER.unpack(tail[:_TRAILER.size])
        raw = self.file.read_at(8 * blocks + 17 * docs, self.index)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks).astype(np.int64), self.index)
        ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        null = np.frombuffer(raw, np.uint8, docs, 8 * blocks + 8 * docs).astype(bool)
        self.docs = pa.array(ids.astype(np.int64), mask=null)
        self.counts = np.frombuffer(raw, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def read(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from position ``first``; only their blocks are read."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        begin, end = first // BLOCK, -(-(first + count) // BLOCK)
        data = np.frombuffer(self.file.read_at(int(self.starts[end] - self.starts[begin]), int(self.starts[begin])), np.uint8)
        ids = decode_blocks(data, self.starts[begin:end] - self.starts[begin]).ravel()
        return ids[first - begin * BLOCK:first - begin * BLOCK + count]


def write_token_files(docs: DataFrame, tokenizer: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all texts and write them in ascending id order; returns the list of files (part, path, n_ids).

    Texts are dealt by ranges of ``doc_id``, sorted, and each task writes one file. A task that is run again writes
    another file; only files of tasks that ended well are listed, and the list is a written table.
    """
    spark, where = docs.sparkSession, folder(docs.sparkSession, "token-files")
    chosen = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, task = None, TaskContext.get()
        for part in slices(batches):
            if writer is None:
                path = f"{where}/part-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
                writer = Writer(path)
            ids, starts = with_end(*encoder(tokenizer).encode(*byte_view(part.column("text"))))
            writer.add(part.column("doc_id"), ids, np.diff(starts))
        if writer:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [path], "n_ids": [writer.close()]},
                                             pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())]))

    dealt = chosen.repartitionByRange(int(files), "doc_id").sortWithinPartitions("doc_id")
    return stored(dealt.mapInArrow(write, "part int, path string, n_ids long"), "token-list")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all earlier documents), n_tokens, ids_crc32, read back from the files by their indexes."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                reader = Reader(path)
                ends = np.cumsum(reader.counts)
                k = 0
                while k < len(ends):  # as many documents at a time as fill a step, or one
                    begin = int(ends[k - 1]) if k else 0
                    last = max(k + 1, int(np.searchsorted(ends, begin + _STEP * BLOCK, "right")))
                    data = memoryview(reader.read(begin, int(ends[last - 1]) - begin).astype("<u4").tobytes())
                    bounds = np.concatenate(([begin], ends[k:last])) - begin
                    checks = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [reader.docs[k:last], pa.array(first + begin + bounds[:-1]), pa.array(reader.counts[k:last]), pa.array(checks, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = last

    return placed.repartition(max(1, files.count())).select("path", "first").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, tokenizer: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all documents to token files and return what reading them back gives, a row per document.

    Input: ``doc_id`` and ``text``; other columns are ignored. Null and empty texts have the end id only. Rows with a
    null id come first; repeated ids follow each other. An empty table writes no file and gives no rows.
    """
    return read_token_files(write_token_files(docs, tokenizer, file_bytes))

"""Words of windows that an earlier document holds too, by super-k-mer partitioning.

A window is a fixed number of consecutive words, and its minimiser the smallest hash of the shorter word groups in it.
Consecutive windows with one minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket. There the
windows are named by sorting their words, so that equal names are equal words, and each window meets the smallest
document that has it. Equal windows have equal minimisers, so no pair of windows is missed.

Two bitmaps of fixed size decide what travels. Minimisers of one document only cannot hold a shared window; they stay
home. Minimisers met very often would make one large bucket; their windows travel singly and are combined before the
shuffle, and only the first holder of each is reported back. A bit that two minimisers share sends more rows along
either way, or more windows singly; it never changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import byte_view, discard, ragged, slices, stored, word_pieces, word_spans

WINDOW = 13
#: Words of a group whose hash may be a minimiser.
GROUP = 4
#: Windows of one packed string at most, so that a text of one repeated word does not travel as one string.
PACKED_WINDOWS = 32
#: Longer words travel as a mark and their digest, which keeps every packed string small.
LONG_WORD = 64
#: log2 of the bits of both bitmaps: 32 MB together, whatever the input.
FILTER_BITS = 27
#: Super-k-mers of a bucket beyond which its windows travel singly.
CROWDED = 4096
#: Bytes of packed strings that are sorted together.
SORT_BYTES = 8 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LAST = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its length and its first LONG_WORD bytes, eight bytes at a time."""
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    lengths = ends - begins
    hashes, open_ = _mixed(lengths.astype(np.uint64) * _SPREAD), np.arange(len(begins))
    for at in range(0, LONG_WORD, 8):
        open_ = open_[lengths[open_] > at]
        if not len(open_):
            break
        lane = lanes[begins[open_] + at] & _LOW_BYTES[np.minimum(lengths[open_] - at, 8)]
        hashes[open_] = _mixed((hashes[open_] ^ lane) * _SPREAD)
    return hashes


def minimisers(hashes: np.ndarray, window: int, group: int) -> np.ndarray:
    """The smallest hash of ``group`` neighbouring words in the window that begins at each word."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.uint64)
    groups = hashes[:n - group + 1]
    for k in range(1, group):
        groups = groups * _SPREAD + hashes[k:n - group + 1 + k]
    least, size, wanted = _mixed(groups), 1, window - group + 1
    while 2 * size <= wanted:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[:len(least) - (wanted - size)], least[wanted - size:]) if size < wanted else least


class Texts:
    """Words, windows and super-k-mers of a batch of texts."""

    def __init__(self, column: pa.Array, window: int, group: int, packed_windows: int = PACKED_WINDOWS) -> None:
        self.data, self.offsets = byte_view(column)
        self.begins, self.ends, self.before = word_spans(self.data, self.offsets)
        self.words = np.diff(self.before)
        counts = np.maximum(self.words - window + 1, 0)
        self.starts, self.owner = ragged(self.before[:-1], counts), np.repeat(np.arange(len(counts)), counts)
        self.keys = minimisers(word_hashes(self.data, self.begins, self.ends), window, group)[self.starts].view(np.int64)
        new = np.ones(len(self.starts), bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]) | (self.owner[1:] != self.owner[:-1])
        heads = np.flatnonzero(new)
        within = np.arange(len(new)) - np.repeat(heads, np.diff(np.append(heads, len(new))))
        self.heads = np.flatnonzero(within % packed_windows == 0)  # the first window of each super-k-mer
        self.sizes = np.diff(np.append(self.heads, len(new)))  # its number of windows

    def packed(self, first: np.ndarray, words: np.ndarray) -> pa.Array:
        """The strings of ``words`` words from word ``first`` on, joined by one space."""
        lengths = self.ends - self.begins
        texts, lengths_out = self.data, np.minimum(lengths, LONG_WORD + 1)
        at = ragged(first, words)
        size = lengths_out[at]
        bounds = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.full(int(bounds[-1]), 0x20, np.uint8)
        short = lengths[at] <= LONG_WORD
        out[ragged(bounds[:-1][short], size[short])] = texts[ragged(self.begins[at[short]], size[short])]
        for k in np.flatnonzero(~short).tolist():
            word = texts[self.begins[at[k]]:self.ends[at[k]]].tobytes()
            out[bounds[k]:bounds[k] + LONG_WORD + 1] = np.frombuffer(b"\0" + hashlib.sha256(word).hexdigest().encode(), np.uint8)
        edges = bounds[np.concatenate(([0], np.cumsum(words)))]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges), pa.py_buffer(out))


def named(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of numbers that are not negative."""
    name, bits = columns[0], int(columns[0].max(initial=0)).bit_length()
    for column in columns[1:]:
        more = int(column.max(initial=0)).bit_length()
        if bits + more > 62:
            name = np.unique(name, return_inverse=True)[1]
            bits = int(name.max(initial=0)).bit_length()
        name, bits = (name << more) | column, bits + more
    return np.unique(name, return_inverse=True)[1]


def window_names(text: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each window of the packed strings, equal for equal words; its string; windows per string."""
    data, offsets = byte_view(text)
    begins, ends, before = word_spans(data, offsets)
    ids = word_pieces(data, begins, ends).dictionary_encode().indices.to_numpy().astype(np.int64)
    counts = np.diff(before) - window + 1
    starts = ragged(before[:-1], counts)
    wide = 4 if window >= 4 else 1
    groups = named(*(ids[k:len(ids) - wide + 1 + k] for k in range(wide))) if wide > 1 else ids
    whole = range(0, window - wide + 1, wide)
    parts = [groups[starts + k] for k in whole] + [ids[starts + k] for k in range(whole[-1] + wide, window)]
    return named(*parts), np.repeat(np.arange(len(counts)), counts), counts


def settle_buckets(batches: Iterator[pa.RecordBatch], window: int, sort_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with an earlier holder, for a stream of super-k-mers sorted by bucket."""
    waiting, held = [], 0

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = rows["packed"].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code, strings = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        place = rows["place"].to_numpy()
        names, owner, counts = window_names(strings, window)
        first_of_string = np.full(len(strings), _LAST, np.int64)
        np.minimum.at(first_of_string, code, place)
        first = np.full(int(names.max(initial=-1)) + 1, _LAST, np.int64)
        np.minimum.at(first, names, first_of_string[owner])
        at = ragged((np.cumsum(counts) - counts)[code], counts[code])
        row = np.repeat(np.arange(len(code)), counts[code])
        gone = first[names[at]] < place[row]
        starts, stops = gone.copy(), gone.copy()
        starts[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
        stops[:-1] &= ~gone[1:] | (row[1:] != row[:-1])
        heads, tails = np.flatnonzero(starts), np.flatnonzero(stops)
        if len(heads):
            of = row[heads]
            offset = rows["begin"].to_numpy()[of] - (np.cumsum(counts[code]) - counts[code])[of]
            yield pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(pa.array(of)) for c in ("place", "row")),
                                              pa.array(heads + offset, pa.int32()), pa.array(tails + offset, pa.int32())], ["place", "row", "first", "last"])

    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        held += batch.column("packed").nbytes
        if held >= sort_bytes:
            rows = pa.Table.from_batches(waiting)
            bucket = rows["bucket"].to_numpy()
            edge = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
            if edge:  # the last bucket may go on in the next batch
                yield from settle(rows.slice(0, edge))
                waiting = rows.slice(edge).combine_chunks().to_batches()
                held = sum(b.column("packed").nbytes for b in waiting)
    if waiting:
        yield from settle(pa.Table.from_batches(waiting))


def bitmap(keys: DataFrame, bits: int) -> Broadcast:
    """A broadcast bitmap of 2**bits bits with those of the keys set, by the key's low bits; its size is fixed by ``bits``."""
    low = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << max(bits - 6, 0), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def without_shared_windows(docs: DataFrame, window: int = WINDOW, group: int = GROUP, crowded: int = CROWDED,
                           filter_bits: int = FILTER_BITS, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every whole text, without the words that an earlier document has.

    Input: ``doc_id`` and ``text``; other columns are ignored. A word goes if a window of ``window`` words that covers it
    also starts in a document with a smaller doc_id. Windows repeated only within one document stay. Null and empty
    texts have no words, and texts shorter than a window stay whole. A null doc_id comes after all numbers below 2**63 - 1;
    rows of one doc_id (null too) are no earlier than each other. Each repeated row gets the same answer. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(_LAST))).withColumn("row", F.xxhash64("doc_id", "text"))
    key = ["place", "row"]  # rows of one key are copies of one row: whatever is found in one holds for all
    texts = rows.select(*key, "text").where(F.octet_length("text") >= 2 * window - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            t = Texts(part.column("text"), window, group)
            yield pa.RecordBatch.from_arrays([pa.array(t.keys[t.heads]), part.column("place").take(pa.array(t.owner[t.heads]))], ["key", "place"])

    marks = texts.mapInArrow(mark, "key long, place long")
    shared = stored(marks.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
                    .where("low < high").select("key", "n"), "shared-minimisers")
    travels, single = (bitmap(keys, filter_bits) for keys in (shared, shared.where(F.col("n") > crowded)))
    some_single = bool(single.value.any())
    discard(shared)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            t = Texts(part.column("text"), window, group)
            keys = t.keys[t.heads]
            go = in_bitmap(travels.value, keys)
            apart = go & in_bitmap(single.value, keys)
            together = go & ~apart
            alone = ragged(t.heads[apart], t.sizes[apart])
            first = np.concatenate((t.heads[together], alone))
            words = np.concatenate((t.sizes[together], np.ones(len(alone), np.int64))) + window - 1
            owner, begin = t.owner[first], t.starts[first] - t.before[t.owner[first]]
            is_single = np.arange(len(first)) >= int(together.sum())
            for k in range(0, len(first), 16384):
                piece = slice(k, k + 16384)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(owner[piece])) for c in key), pa.array(t.keys[first[piece]]), pa.array(is_single[piece]),
                     pa.array(begin[piece], pa.int32()), t.packed(t.starts[first[piece]], words[piece])], [*key, "bucket", "single", "begin", "packed"])

    sent = stored(texts.mapInArrow(send, "place long, row long, bucket long, single boolean, begin int, packed string"), "super-k-mers")
    together = sent.where("not single").select(*key, "bucket", "begin", "packed")
    found = together.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: settle_buckets(batches, window, sort_bytes), "place long, row long, first int, last int")
    apart = sent.where("single").select(*key, "begin", "packed")
    holders = apart.groupBy("packed").agg(F.min("place").alias("place"))
    stays = apart.join(holders, ["packed", "place"]).select(*key, "begin")  # windows that travelled singly stay in their first holder
    none, run = F.lit(None).cast("int"), F.struct("first", "last")
    told = stored(found.select(*key, run.alias("run"), none.alias("stay"))
                  .unionByName(stays.select(*key, F.lit(None).cast("struct<first:int,last:int>").alias("run"), F.col("begin").alias("stay")))
                  .groupBy(*key).agg(F.collect_set("run").alias("runs"), F.collect_set("stay").alias("stays")), "window-runs")
    discard(sent)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            t = Texts(part.column("text"), window, group)
            runs, owner = _listed(part.column("runs"))
            edge = np.zeros(len(t.begins) + len(part) + 1, np.int64)  # one more place after each text, where its last run may end
            base = t.before[:-1] + np.arange(len(part))
            np.add.at(edge, base[owner] + runs.field("first").to_numpy(), 1)
            np.add.at(edge, base[owner] + runs.field("last").to_numpy() + window, -1)
            if some_single:
                gone = in_bitmap(travels.value, t.keys) & in_bitmap(single.value, t.keys)
                stays, owner = _listed(part.column("stays"))
                first_window = np.concatenate(([0], np.cumsum(np.maximum(t.words - window + 1, 0))))
                gone[first_window[owner] + stays.to_numpy()] = False
                at = t.starts[gone] + t.owner[gone]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
            left = np.cumsum(edge)[np.arange(len(t.begins)) + np.repeat(np.arange(len(part)), t.words)] == 0
            lengths = (t.ends - t.begins)[left]
            bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
            out = np.full(int(bounds[-1]) + 1, 0x20, np.uint8)
            out[ragged(bounds[:-1], lengths)] = t.data[ragged(t.begins[left], lengths)]
            upto = np.concatenate(([0], np.cumsum(left)))[t.before]
            kept = np.diff(upto)
            whole, edges = out.tobytes(), bounds[upto].tolist()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(t.words), pa.array(t.words - kept),
                 pa.array([whole[a:b - 1] if b > a else b"" for a, b in zip(edges, edges[1:], strict=False)], pa.large_binary()).cast(pa.large_string())],
                ["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.join(told, key, "left").select("doc_id", "text", "runs", "stays").mapInArrow(
        drop, "doc_id long, n_words long, n_removed long, kept_text string")


def _listed(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and the row of each; a null list is empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten(), np.repeat(np.arange(len(column)), lengths)


SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
    s AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM p),
    f AS (SELECT win, min(doc_id) AS low FROM s GROUP BY win),
    g AS (SELECT DISTINCT r, i + k AS spot FROM s JOIN f USING (win), range(0, 13) AS o(k) WHERE coalesce(f.low < s.doc_id, f.low IS NOT NULL)),
    q AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM d),
    k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS kept FROM q ANTI JOIN g USING (r, spot) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS kept_text FROM d LEFT JOIN k USING (r)
"""

"""Byte strings of a fixed length that occur more than once, found with difference-cover suffix sorting.

Every string of ``length`` bytes has an anchor: its byte group (of ANCHOR bytes) with the smallest hash, the last of
equals. Equal strings have equal anchors at the same place, so strings need only be compared within an anchor's shard,
and only around anchors that occur at least twice. A shard's suffixes are sorted by the difference cover {1, 2} modulo 3:
triples at sampled positions are sorted and named, the names are sorted by recursion (until they tell all apart or cover
``length`` bytes), the remaining suffixes are merged in, and adjacent suffixes are compared over ``length`` bytes.

A shard with very many distinct contexts is trimmed first: its strings are counted by hash, and a context keeps only
those whose hash occurs again. A line in many surroundings leaves nothing, a passage leaves itself, once. Shards that are
still large are split. Equal strings lie equally far before their anchor; the strings of a range of such distances share
a core, so they are dealt out by range and core, in ranges half as wide each time until every shard is small. A range of
one distance has the whole string as its core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import byte_view, discard, ragged, slices, stored
from gleanworks.llm.windows import bitmap, in_bitmap

LENGTH = 400
#: Bytes of an anchor.
ANCHOR = 40
#: Bytes of contexts that are sorted together; a single larger shard is sorted on its own.
SORT_BYTES = 1 << 19
#: Distinct contexts of a shard that are sorted in one task; shards with more are split.
SHARD_CONTEXTS = 1024
#: log2 of the bits of the map that holds the hashes met again: 16 MB whatever the input. A bit that a single string
#: shares keeps that string for the sort; it loses none.
FILTER_BITS = 27
_MULTIPLY = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def group_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position on."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, taken = np.zeros(n, np.uint64), 0
        power, size = data.astype(np.uint64) + np.uint64(1), 1  # hashes of ``size`` bytes, doubled in each turn
        while True:
            if width & size:
                total = total * np.uint64(pow(_MULTIPLY, size, 2**64)) + power[taken:taken + n]
                taken += size
            if taken == width:
                return _mixed(total)
            power = power[:-size] * np.uint64(pow(_MULTIPLY, size, 2**64)) + power[size:]
            size *= 2


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Text, hash, place, first and last string of each anchor: strings are named by where they start in the text."""
    window = length - anchor + 1
    hashes = group_hashes(data, anchor)
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    # smallest hash of each window, the last of equals: hash and (reversed) place in one number, least of blocks from both sides
    marked = np.full(-(-len(hashes) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 27) - 1)
    marked[:len(hashes)] = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    rows = marked.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[:n], ahead[window - 1:window - 1 + n])
    place = (low - (best & low)).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    start = ragged(offsets[:-1], counts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = place[start]
    head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))) if len(start) else np.zeros(0, np.int64)
    tail = np.concatenate((head[1:], [len(start)])) - 1 if len(head) else head
    owner = text[head]
    return owner, hashes[place[head]].view(np.int64), place[head] - offsets[owner], start[head] - offsets[owner], start[tail] - offsets[owner]


def _named(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of numbers."""
    name = columns[0]
    for column in columns[1:]:
        if int(name.max(initial=0)).bit_length() + int(column.max(initial=0)).bit_length() > 62:
            name = np.unique(name, return_inverse=True)[1]
        name = (name << int(column.max(initial=0)).bit_length()) | column
    return np.unique(name, return_inverse=True)[1]


def suffix_ranks(symbols: np.ndarray, wanted: int, covered: int = 1) -> np.ndarray:
    """How many suffixes are smaller than each suffix, looking at ``wanted`` bytes at least.

    A symbol stands for ``covered`` bytes. Suffixes that agree in ``wanted`` bytes or more may share a rank.
    """
    n = len(symbols)
    s = np.concatenate((symbols.astype(np.int64) + 1, np.zeros(3, np.int64)))
    zero, one, two = np.arange(0, n, 3), np.arange(1, n, 3), np.arange(2, n, 3)
    sampled = np.concatenate((one, two))
    name = _named(s[sampled], s[sampled + 1], s[sampled + 2]) if len(sampled) else sampled
    if 3 * covered < wanted and len(sampled) and int(name.max()) + 1 < len(sampled):
        deep = suffix_ranks(np.concatenate((name[:len(one)] + 1, [0], name[len(one):] + 1)), wanted, 3 * covered)
        name = np.concatenate((deep[:len(one)], deep[len(one) + 1:]))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = name + 1
    # merge: suffixes at places 0 meet those at 1 by (symbol, rank of the rest), and those at 2 by two symbols and the rest
    short = _packed(s[:n], rank[1:n + 1])
    if 2 * int(s.max()).bit_length() + int(rank.max()).bit_length() <= 62:
        long_zero, long_two = (_packed(_packed(s[at], s[at + 1], s), rank[at + 2], rank) for at in (zero, two))
    else:
        pairs = _named(np.concatenate((s[zero], s[two])), np.concatenate((s[zero + 1], s[two + 1])))
        long_zero, long_two = _packed(pairs[:len(zero)], rank[zero + 2], rank), _packed(pairs[len(zero):], rank[two + 2], rank)
    zeros_before_zero, ones_before_zero, zeros_before_one = _smaller(short[zero], short[one])
    _, twos_before_zero, zeros_before_two = _smaller(long_zero, long_two)
    held = np.bincount(name) if len(name) else name
    sampled_before = (np.cumsum(held) - held)[name]
    out = np.zeros(n, np.int64)
    out[zero] = zeros_before_zero + ones_before_zero + twos_before_zero
    out[one] = sampled_before[:len(one)] + zeros_before_one
    out[two] = sampled_before[len(one):] + zeros_before_two
    return out


def _packed(high: np.ndarray, low: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Pairs of numbers as one number each; ``of`` holds all values that ``low`` may have."""
    return (high << int((low if of is None else of).max(initial=0)).bit_length()) | low


def _smaller(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of ``a`` are smaller than each of ``a``, of ``b`` than each of ``a``, and of ``a`` than each of ``b``."""
    kinds, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    of_a, of_b = (np.bincount(x, minlength=len(kinds)) for x in (place[:len(a)], place[len(a):]))
    before_a, before_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    return before_a[place[:len(a)]], before_b[place[:len(a)]], before_a[place[len(a):]]


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at ``starts`` equal another of them."""
    found = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return found
    order = np.argsort(suffix_ranks(data, length)[starts], kind="stable")
    sorted_starts = starts[order]
    same = np.arange(len(order) - 1)
    full = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.lib.stride_tricks.sliding_window_view(full, 8)[:len(data)].copy().view(np.uint64).ravel()
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else range(0, length if length < 8 else 0))]:
        source = lanes if length >= 8 else full
        a, b = source[sorted_starts[same] + at], source[sorted_starts[same + 1] + at]
        same = same[a == b]
        if not len(same):
            return found
    found[order[same]] = found[order[same + 1]] = True
    return found


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2].tolist(), edges[1::2].tolist()


def sort_shards(batches: Iterator[pa.RecordBatch], length: int, sort_bytes: int) -> Iterator[pa.RecordBatch]:
    """Repeated strings of each context, for a stream of contexts sorted by shard: runs [first, last) of string numbers."""
    waiting, held, last = [], 0, None

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(c) for _, _, c, _ in rows], np.int64)
        data = np.frombuffer(b"".join(c for _, _, c, _ in rows), np.uint8)
        begin = np.cumsum(sizes) - sizes
        own = sizes - length + 1
        shard = np.array([s for s, *_ in rows], np.int64)
        lone = np.ones(len(rows), bool)
        lone[1:] &= shard[1:] != shard[:-1]
        lone[:-1] &= shard[:-1] != shard[1:]
        several = np.array([n > 1 for *_, n in rows])
        flags = np.repeat(several, own)
        heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        settled = np.repeat(np.minimum.reduceat(several, heads), np.diff(np.append(heads, len(shard))))
        todo = np.flatnonzero(~lone & ~settled)  # contexts with another one in their shard, unless each occurs twice anyway
        if len(todo):
            part = data[ragged(begin[todo], sizes[todo])]
            at = ragged(np.cumsum(sizes[todo]) - sizes[todo], own[todo])
            flags[ragged((np.cumsum(own) - own)[todo], own[todo])] |= repeated_starts(part, at, length)
        where = np.cumsum(own) - own
        out = [(key, *_runs(flags[w:w + o])) for (_, key, _, _), w, o in zip(rows, where.tolist(), own.tolist(), strict=True) if flags[w:w + o].any()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in out], pa.binary()), pa.array([f for _, f, _ in out], pa.list_(pa.int32())),
                                              pa.array([t for *_, t in out], pa.list_(pa.int32()))], ["context_key", "first", "last"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "context_key", "context", "n")), strict=True):
            if held >= sort_bytes and row[0] != last:
                yield from flush(waiting)
                waiting, held = [], 0
            waiting.append(row)
            held, last = held + len(row[2]), row[0]
    if waiting:
        yield from flush(waiting)


def _context_key(context: bytes, ahead: int) -> bytes:
    """The same for equal contexts whose anchor begins ``ahead`` bytes after them."""
    return hashlib.blake2b(context, digest_size=12, salt=int(ahead).to_bytes(8, "little")).digest()


_PARTS = "root binary, shift int, ahead int, shard long, context_key binary, context binary, n long"


def _part_batch(rows: list) -> pa.RecordBatch:
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      ["root", "shift", "ahead", "shard", "context_key", "context", "n"])


def _string_hashes(contexts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each string of each context, the context of each, and its number there."""
    data, offsets = byte_view(contexts.view(pa.string()))
    hashes, counts = group_hashes(data, length), np.diff(offsets) - length + 1
    return hashes[ragged(offsets[:-1], counts)], np.repeat(np.arange(len(counts)), counts), ragged(np.zeros(len(counts), np.int64), counts)


def trim_contexts(full: DataFrame, length: int, filter_bits: int) -> DataFrame:
    """The contexts cut down to the strings whose hash is met again among all of them, each stretch a context of its own."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "context", 1 << 18):
                hashes, of, _ = _string_hashes(part.column("context"), length)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), part.column("n").take(pa.array(of))], ["key", "n"])

    again = stored(full.select("context", "n").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "strings-again")
    seen = bitmap(again, filter_bits)
    discard(again)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "context", 1 << 18):
                hashes, of, at = _string_hashes(part.column("context"), length)
                met = np.flatnonzero(in_bitmap(seen.value, hashes))
                if not len(met):
                    continue
                new = np.concatenate(([True], (np.diff(met) > 1) | (of[met][1:] != of[met][:-1])))
                heads, tails = met[new], met[np.append(new[1:], True)]
                columns = [part.column(c).to_pylist() for c in ("root", "shift", "ahead", "shard", "context", "n")]
                rows = []
                for k, first, last in zip(of[heads].tolist(), at[heads].tolist(), at[tails].tolist(), strict=True):
                    root, shift, ahead, shard, context, n = (c[k] for c in columns)
                    piece = context[first:last + length]
                    rows.append((root, shift + first, ahead - first, shard, _context_key(piece, ahead - first), piece, n))
                yield _part_batch(rows)

    return full.mapInArrow(trim, _PARTS)


def split_contexts(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """The parts of each context that hold its strings of a range of ``width`` distances to the anchor, sharded by range and core."""
    for part in batches:
        rows = []
        for root, shift, ahead, shard, context, n in zip(*(part.column(c).to_pylist() for c in ("root", "shift", "ahead", "shard", "context", "n")), strict=True):
            nearest = ahead - (len(context) - length)  # the last string's distance; the first one's is ``ahead``
            for k in range(nearest // width, ahead // width + 1):
                near, far = max(nearest, k * width), min(ahead, k * width + width - 1)
                core = context[ahead - k * width:ahead - k * width - width + 1 + length]  # in all strings of the whole range
                piece = context[ahead - far:ahead - near + length]
                name = hashlib.blake2b(core, digest_size=8, salt=k.to_bytes(8, "little"), person=shard.to_bytes(8, "little", signed=True)).digest()
                rows.append((root, shift + ahead - far, far, int.from_bytes(name, "little", signed=True), _context_key(piece, far), piece, n))
                if len(rows) == 2048:
                    yield _part_batch(rows)
                    rows = []
        if rows:
            yield _part_batch(rows)


def repeated_runs(placed: DataFrame, length: int, sort_bytes: int, shard_contexts: int, filter_bits: int, anchor: int) -> tuple[DataFrame, list[DataFrame]]:
    """Runs of repeated strings by context_key (several rows for a context that was cut), and the tables they are read from.

    Contexts marked ``large`` lie in shards that may hold more than ``shard_contexts`` distinct ones. Equal contexts are
    counted before anything else; shards that do are trimmed, and split if they still do.
    """
    plain = placed.where("not large").groupBy("context_key").agg(F.first("shard").alias("shard"), F.first("context").alias("context"), F.count("*").alias("n"))
    combined = placed.where("large").groupBy("context_key").agg(*(F.first(c).alias(c) for c in ("ahead", "shard", "context")), F.count("*").alias("n"))
    parts = stored(combined.select(F.col("context_key").alias("root"), F.lit(0).alias("shift"), "ahead", "shard", "context_key", "context", "n"), "large-contexts")
    found, tables, width, trimmed = None, [parts], length - anchor + 1, False
    while True:
        full = None
        if width > 1:
            held = parts.select("shard", "context_key").distinct().groupBy("shard").agg(F.count("*").alias("n"))
            full = stored(held.where(F.col("n") > shard_contexts).select("shard"), "full-shards")
            tables.append(full)
            full = None if full.isEmpty() else full
        small = parts if full is None else parts.join(full, "shard", "left_anti")
        counted = small.groupBy("context_key").agg(F.first("shard").alias("shard"), F.first("context").alias("context"), F.sum("n").alias("n"))
        counted = counted.unionByName(plain) if found is None else counted
        runs = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(
            lambda batches: sort_shards(batches, length, sort_bytes), "context_key binary, first array<int>, last array<int>")
        if found is None:
            found = runs
        else:
            moved = small.select("context_key", "root", "shift").join(runs, "context_key")
            found = found.union(moved.select("root", *(F.transform(c, lambda x: x + F.col("shift")) for c in ("first", "last"))))
        if full is None:
            return found, tables
        distinct = parts.join(full, "shard", "left_semi")
        if not trimmed:
            parts, trimmed = stored(trim_contexts(distinct, length, filter_bits), "context-parts"), True
        else:
            width = -(-width // 2)
            distinct = distinct.groupBy("root", "shift").agg(*(F.first(c).alias(c) for c in ("ahead", "shard", "context")), F.sum("n").alias("n"))
            parts = stored(distinct.mapInArrow(lambda batches, width=width: split_contexts(batches, length, width), _PARTS), "context-parts")
        tables.append(parts)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, sort_bytes: int = SORT_BYTES,
                   shard_contexts: int = SHARD_CONTEXTS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (bytes left) and kept_text of every whole text, without all bytes of repeated strings.

    Input: ``doc_id`` and ``text``; other columns are ignored. A byte goes if any string of ``length`` bytes that covers
    it also starts elsewhere, in the same text or another; strings never cross texts. Null counts as empty; texts shorter
    than ``length`` stay whole. Rows that repeat are copies of each other. An empty table gives no rows. A run may begin or
    end inside a character; what is left of it is U+FFFD in ``kept_text``, while the digest is that of the bytes left.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    key = ["row", "size"]  # rows of one key are copies of one row: whatever is found in one holds for all

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            owner, hashes, place, first, last = anchors(*byte_view(part.column("text")), length, anchor)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(owner)) for c in key), pa.array(hashes), *(pa.array(x, pa.int32()) for x in (place, first, last))],
                [*key, "shard", "place", "first", "last"])

    marks = stored(rows.select(*key, "text").where(F.col("size") >= length).mapInArrow(
        find, "row long, size int, shard long, place int, first int, last int"), "anchors")
    # a table of its own, so that both sides of the join are shuffled and a shard with very many anchors can be split
    often = stored(marks.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "anchors-often")
    wanted = marks.join(often.select("shard", (F.col("n") > shard_contexts).alias("large")), "shard").groupBy(*key).agg(
        F.collect_set(F.struct("shard", "place", "first", "last", "large")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = byte_view(part.column("text"))
            column = part.column("marks")
            inner = column.flatten()
            owner = np.repeat(np.arange(len(part)), np.diff(column.offsets.to_numpy()))
            shard, place, first, last = (inner.field(c).to_numpy() for c in ("shard", "place", "first", "last"))
            begin = offsets[owner] + first
            raw = data.tobytes()
            contexts = [raw[a:b] for a, b in zip(begin.tolist(), (offsets[owner] + last + length).tolist(), strict=True)]
            ahead = place - first
            keys = [_context_key(c, a) for c, a in zip(contexts, ahead.tolist(), strict=True)]
            for k in range(0, len(contexts), 8192):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(owner[k:k + 8192])) for c in key), pa.array(shard[k:k + 8192]), inner.field("large").slice(k, 8192), pa.array(first[k:k + 8192]), pa.array(ahead[k:k + 8192]),
                     pa.array(keys[k:k + 8192], pa.binary()), pa.array(contexts[k:k + 8192], pa.binary())],
                    [*key, "shard", "large", "begin", "ahead", "context_key", "context"])

    texts = stored(rows.join(wanted, key, "left").select("doc_id", *key, "text", "marks"), "marked-texts")
    marked = texts.where("marks is not null")  # no other text can lose anything
    discard(marks, often)
    placed = stored(marked.mapInArrow(
        cut, "row long, size int, shard long, large boolean, begin int, ahead int, context_key binary, context binary"), "contexts")
    found, tables = repeated_runs(placed, length, sort_bytes, shard_contexts, filter_bits, anchor)
    spans = stored(placed.select(*key, "begin", "context_key").join(found, "context_key").groupBy(*key).agg(
        F.collect_set(F.struct("begin", "first", "last")).alias("found")), "repeat-spans")

    discard(placed, *tables)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = byte_view(part.column("text"))
            found_ = part.column("found")
            inner = found_.flatten()
            row = np.repeat(np.arange(len(part)), np.diff(found_.offsets.to_numpy()))
            first, last = inner.field("first"), inner.field("last")
            begin = np.repeat(offsets[row] + row + inner.field("begin").to_numpy(), np.diff(first.offsets.to_numpy()))
            edge = np.zeros(len(data) + len(part), np.int32)  # one more place after each text, where its last run may end
            np.add.at(edge, begin + first.flatten().to_numpy(), 1)
            np.add.at(edge, begin + last.flatten().to_numpy() + length - 1, -1)
            gone = np.cumsum(edge) > 0
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            heads = offsets[:-1] + np.arange(len(part))
            gone_by, starts_by = np.add.reduceat(gone, heads, dtype=np.int64), np.add.reduceat(starts, heads, dtype=np.int64)
            kept = data[~gone[ragged(heads, np.diff(offsets))]].tobytes()
            ends = np.cumsum(np.diff(offsets) - gone_by)
            left = [kept[a:b] for a, b in zip((ends - np.diff(offsets) + gone_by).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("size"), pa.array(gone_by), pa.array(starts_by), pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                 pa.array([x.decode("utf-8", "replace") for x in left])],
                ["doc_id", "size", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    none = F.array().cast(spans.schema["found"].dataType)
    changed = marked.join(spans, key, "left").select("doc_id", "size", "text", F.coalesce("found", none).alias("found")).mapInArrow(
        drop, "doc_id long, size int, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    zero = F.lit(0).cast("long")
    whole = texts.where("marks is null").select(
        "doc_id", "size", zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept_text"))
    return changed.unionByName(whole).select(
        "doc_id", F.col("size").cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256",
        (F.col("size") - F.col("n_removed")).alias("n_kept"), "kept_text")

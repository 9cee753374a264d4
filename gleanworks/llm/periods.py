"""Stretches of words that repeat with a period, found octave by octave in tiles of the document.

A stretch with period q of at least four periods holds, in the octave P <= q < 2P, a boundary (a multiple of P) whose
next P words come again q words later. So per octave only boundaries are compared with the periods of that octave, all at
once by block hashes. Where a boundary and a period agree, the values of two Z-functions at the boundary (how far the
words agree with those q later, onward from it and back from it) give a fragment of the stretch, exactly, on word
numbers. Neighbouring boundaries lie P apart and reach P back and 2P onward, so fragments of one stretch touch.

Documents of one tile are solved where they are read. Longer ones are exploded into tiles, one set for all small octaves
and one per larger octave with tiles as much longer; tiles are dealt out over the tasks, and their fragments are shuffled
by document and period and stitched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.llm.common import byte_view, ragged, slices, stored, word_pieces, word_spans

#: Words between the first and the last boundary of a tile of the small octaves; a document with fewer is one tile.
TILE_WORDS = 8192
#: A tile is at least so many times as long as the period its octave begins with.
TILE_PERIODS = 16
#: A run has at least so many periods and so many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Words compared at once when Z-values are counted.
CHUNK = 32
_LAST = (1 << 63) - 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _z(ids: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``at`` on (or before it) equal those ``period`` later, counting at most ``room``."""
    out, open_, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    step = np.arange(CHUNK)
    while len(open_):
        left = room[open_] - done
        place = at[open_][:, None] + (-1 - done - step if back else done + step)
        inside = step < left[:, None]
        place = np.where(inside, place, at[open_][:, None] - back)
        same = (ids[place] == ids[np.minimum(place + period[open_][:, None], len(ids) - 1)]) & inside
        first = np.where(same.all(axis=1), CHUNK, same.argmin(axis=1))
        out[open_] += first
        open_ = open_[(first == CHUNK) & (left > CHUNK)]
        done += CHUNK
    return out


def _primitive(hashes: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of the blocks of ``period`` words at ``at`` are no repetition of a shorter block (by 64-bit hashes)."""
    top = int(period.max(initial=1))
    least_factor = np.arange(top + 1)
    for p in range(2, int(top**0.5) + 1):
        if least_factor[p] == p:
            least_factor[p * p::p] = np.minimum(least_factor[p * p::p], p)
    alive, rest = np.ones(len(at), bool), period.copy()
    while True:
        some = np.flatnonzero(alive & (rest > 1))
        if not len(some):
            return alive
        factor = least_factor[rest[some]]
        rest[some] //= factor
        shift = period[some] // factor
        span = period[some] - shift  # words that would agree with those ``shift`` later
        level = np.frexp(span.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            of = np.flatnonzero(level == k)
            b, d, h = at[some[of]], shift[of], hashes[k]
            end = b + span[of] - (1 << k)
            alive[some[of]] = ~((h[b] == h[b + d]) & (h[end] == h[end + d]))


def fragments(ids: np.ndarray, bounds: np.ndarray, first: np.ndarray, stop: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tile, period, begin and end of fragments: words from begin up to end equal those one period later.

    Tile k holds words ``bounds[k]`` up to ``bounds[k + 1]``; its boundaries are the multiples of the octave's P from
    ``first[k]`` up to ``stop[k]`` (places in the tile), and it answers for the octaves ``low[k]`` to ``high[k]``.
    Touching fragments of one tile and period are joined. What ends within the tile and is too short for a run is left out.
    """
    found, sizes = [], np.diff(bounds)
    hashes = [(ids.astype(np.uint64) + np.uint64(1)) * _SPREAD]  # of blocks of 1, 2, 4, ... words; ends are filled up
    octave = 0
    while len(sizes) and (1 << octave) * LEAST_PERIODS <= sizes.max():
        p = 1 << octave
        if octave:
            before, half = hashes[-1], p >> 1
            after = np.concatenate((before[half:], np.zeros(min(half, len(before)), np.uint64)))
            mixed = (before ^ (before >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + after
            hashes.append((mixed ^ (mixed >> np.uint64(29))) * _SPREAD)
        tiles = np.flatnonzero((low <= octave) & (octave <= high) & (sizes >= 2 * p))
        start = -(-first[tiles] // p) * p
        counts = np.maximum(-(-(np.minimum(stop[tiles], sizes[tiles] - 2 * p + 1) - start) // p), 0)
        tile = np.repeat(tiles, counts)
        boundary = bounds[tile] + np.repeat(start, counts) + (np.arange(len(tile)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
        h, some = hashes[octave], []
        for k in range(0, len(boundary), max(1, (1 << 20) // p)):
            b = boundary[k:k + max(1, (1 << 20) // p)]
            later = b[:, None] + p + np.arange(p)
            room = bounds[tile[k:k + len(b)] + 1][:, None] - p
            row, q = np.nonzero((later <= room) & (h[np.minimum(later, len(h) - 1)] == h[b][:, None]))
            some.append((row + k, q + p))
        at, period = (np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.int64),) * 2
        alive = _primitive(hashes, boundary[at], period)
        at, period = at[alive], period[alive]
        if len(at):
            t, b = tile[at], boundary[at]
            onward = _z(ids, b, period, np.minimum(2 * p, bounds[t + 1] - b - period), False)
            back = _z(ids, b, period, np.minimum(p, b - bounds[t]), True)
            found.append((t, period, b - back - bounds[t], b + onward - bounds[t]))
        octave += 1
    if not found:
        return (np.zeros(0, np.int64),) * 4
    t, q, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((begin, q, t))
    t, q, begin, end = t[order], q[order], begin[order], end[order]
    # join touching fragments: the largest end so far, per tile and period
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (q[1:] != q[:-1])
    lane = np.cumsum(new) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lane)
    new[1:] |= (begin + lane)[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    t, q, begin, end = t[heads], q[heads], begin[heads], np.maximum.reduceat(end, heads)
    keep = (end - begin + q >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)) | (begin < first[t]) | (end >= stop[t])  # long, or may go on in a neighbour
    return t[keep], q[keep], begin[keep], end[keep]


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Words of a batch of texts as numbers, equal for equal words, and where each text begins; and the words' spans."""
    data, offsets = byte_view(column)
    begins, ends, before = word_spans(data, offsets)
    return word_pieces(data, begins, ends).dictionary_encode().indices.to_numpy().astype(np.int64), before, (data, begins, ends)


def _collapsed(spans: tuple, before: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """The texts without the words that a run holds after its first period, joined by one space."""
    data, begins, ends = spans
    edge = np.zeros(len(begins) + len(before), np.int64)  # one more place after each text, where its last run may end
    base = before[owner] + owner + start
    np.add.at(edge, base + period, 1)
    np.add.at(edge, base + length, -1)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    left = np.cumsum(edge)[np.arange(len(begins)) + text] == 0
    lengths = (ends - begins)[left]
    edges = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = np.full(int(edges[-1]) + 1, 0x20, np.uint8)
    out[ragged(edges[:-1], lengths)] = data[ragged(begins[left], lengths)]
    whole, cut = out.tobytes(), edges[np.concatenate(([0], np.cumsum(left)))[before]].tolist()
    return pa.array([whole[a:b - 1] if b > a else b"" for a, b in zip(cut, cut[1:], strict=False)], pa.large_binary()).cast(pa.large_string())


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _answer(part: pa.RecordBatch, before: np.ndarray, spans: tuple, owner: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((period, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32()),
                                      pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])).cast(_RUNS)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(before)), listed, _collapsed(spans, before, owner, start, length, period)],
                                      ["doc_id", "n_words", "runs", "collapsed_text"])


_RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def periodic_runs(docs: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_text of every whole text.

    Input: ``doc_id`` and ``text``; other columns are ignored. A run is a stretch of words with smallest period q, at
    least four periods and six words long, that neither neighbour extends. The collapsed text lacks each word that a run
    holds after its first q words. Null and empty texts have no words and no runs. Repeated rows, null and shared ids
    each get the answer of their own text. An empty table gives no rows. ``tile_words`` is a power of two, 64 or more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one_tile = F.octet_length("text") <= 2 * tile_words  # so many bytes hold at most tile_words words
    small = tile_words.bit_length() - 1 - (TILE_PERIODS.bit_length() - 1)  # the last octave of the shared tiles

    def solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            ids, before, spans = _numbers(part.column("text"))
            none = np.zeros(len(part), np.int64)
            owner, period, begin, end = fragments(ids, before, none, np.diff(before), none, none + 62)
            long = end - begin + period >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            yield _answer(part, before, spans, owner[long], begin[long], (end - begin + period)[long], period[long])

    short = rows.where(one_tile).mapInArrow(solve_whole, _RESULT)
    texts = rows.where(~one_tile).withColumn("place", F.coalesce("doc_id", F.lit(_LAST))).withColumn("row", F.xxhash64("doc_id", "text"))
    key = ["place", "row"]  # rows of one key are copies of one row: whatever is found in one holds for all

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            ids, before, _ = _numbers(part.column("text"))
            for k in range(len(part)):
                words = ids[before[k]:before[k + 1]]
                words = np.unique(words, return_inverse=True)[1].astype(np.uint32)  # numbers within the document
                words = words.astype(np.uint16) if words.max(initial=0) < 1 << 16 else words
                low = 0
                while (1 << low) * LEAST_PERIODS <= len(words):
                    high = small if low == 0 else low
                    p = 1 << high
                    core = TILE_PERIODS * p
                    begins = [b for b in range(0, len(words), core) if len(words) - b >= 2 << low]
                    for j in range(0, len(begins), 64):
                        some = begins[j:j + 64]
                        froms, upto = [max(0, b - p) for b in some], [min(len(words), b + core + 4 * p) for b in some]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array([part.column(c)[k].as_py()] * len(some), pa.int64()) for c in key), pa.array([low] * len(some), pa.int32()), pa.array([high] * len(some), pa.int32()),
                             pa.array(froms, pa.int64()), pa.array([b - f for b, f in zip(some, froms, strict=True)], pa.int64()), pa.array([core] * len(some), pa.int64()),
                             pa.array([words.itemsize] * len(some), pa.int32()), pa.array([words[f:u].tobytes() for f, u in zip(froms, upto, strict=True)], pa.binary())],
                            [*key, "low", "high", "at", "first", "core", "width", "words"])
                    low = high + 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "words", 1 << 20):
                tiles = [np.frombuffer(w, np.uint16 if n == 2 else np.uint32) for w, n in zip(part.column("words").to_pylist(), part.column("width").to_pylist(), strict=True)]
                bounds = np.concatenate(([0], np.cumsum([len(w) for w in tiles])))
                first = part.column("first").to_numpy()
                tile, period, begin, end = fragments(np.concatenate(tiles).astype(np.int64), bounds, first, first + part.column("core").to_numpy(),
                                                     part.column("low").to_numpy(), part.column("high").to_numpy())
                at = part.column("at").to_numpy()[tile]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(tile)) for c in key), *(pa.array(x) for x in (period, begin + at, end + at))],
                                                 [*key, "period", "begin", "end"])

    tiles = texts.select(*key, "text").mapInArrow(explode, "place long, row long, low int, high int, at long, first long, core long, width int, words binary")
    found = tiles.repartition(*key, "low", "at").mapInArrow(solve, "place long, row long, period long, begin long, end long")
    stretch = Window.partitionBy(*key, "period").orderBy("begin", "end")
    reach = F.max("end").over(stretch.rowsBetween(Window.unboundedPreceding, -1))
    stitched = (found.withColumn("new", F.coalesce(F.col("begin") > reach, F.lit(True)).cast("long"))
                .withColumn("part", F.sum("new").over(stretch.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(*key, "period", "part").agg(F.min("begin").alias("start"), (F.max("end") - F.min("begin") + F.col("period")).alias("length"))
                .where((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period"))))
    runs = stored(stitched.groupBy(*key).agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")), "period-runs")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            _, before, spans = _numbers(part.column("text"))
            column = part.column("runs")
            inner, owner = column.flatten(), np.repeat(np.arange(len(part)), np.asarray(column.value_lengths().fill_null(0)))
            yield _answer(part, before, spans, owner, *(inner.field(c).to_numpy() for c in ("start", "length", "period")))

    return short.unionByName(texts.join(runs, key, "left").select("doc_id", "text", "runs").mapInArrow(collapse, _RESULT))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; of each tenth document (by h, the crc32 of its id) the words from a on repeat with period p."""
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            texts = part.column("text").to_pylist()
            for k, h in enumerate(part.column("h").to_pylist()):
                words = re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "") if h is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    period = words[a:a + 1 + (n - a) // (3 + g % 8)]
                    texts[k] = " ".join(words[:a] + (period * (-(-(n - a) // len(period))))[:n - a])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.large_string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h")).mapInArrow(
        plant, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """The runs of each document as counts and digests; the longest run's facts (ties: smallest start, then period)."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.shorter) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))

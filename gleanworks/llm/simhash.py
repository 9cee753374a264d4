"""Near duplicates by SimHash fingerprints, searched exactly with vantage-point trees.

Two fingerprints with at most ``distance`` differing bits differ by at most ``distance // bands`` in one of their bit
bands. For each band a vantage-point tree deals the fingerprints out: a node splits by Hamming distance to its vantage
value, and the triangle inequality says which children a query ball overlaps, so boundary fingerprints go to several
shards. Inside a shard the same splitting goes on in memory; what is left is compared bit by bit over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import LOWER, byte_view, join_labels, linked_groups, ragged, slices, stored, word_spans

SHINGLE = 4
DISTANCE = 4
BANDS = 4
SEED = 42
#: Fingerprints per shard that the depth of the sharding tree aims at.
SHARD_ROWS = 16384
MAX_DEPTH = 12
#: Fingerprints looked at to choose vantage points and radii; results do not depend on them, only balance does.
SAMPLE = 4096
#: Comparisons of one block of a leaf.
BLOCK = 1 << 20
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a byte view's texts, the text of each, and how many each text has."""
    begins, ends, before = word_spans(data, offsets)
    lengths = ends - begins
    packed = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)  # words with one space after each
    ends_at = np.cumsum(lengths + 1)
    begins_at = ends_at - lengths - 1
    packed[ragged(begins_at, lengths)] = LOWER[data[ragged(begins, lengths)]]
    words = np.diff(before)
    counts = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first = ragged(before[:-1], counts)
    rows = np.repeat(np.arange(len(words)), counts)
    last = first + np.minimum(words[rows], shingle) - 1
    text, digest = packed.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begins_at[first].tolist(), (ends_at[last] - 1).tolist(), strict=True)),
                         np.uint64, len(first))
    return hashes, rows, counts


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text of a byte view."""
    hashes, rows, counts = shingle_hashes(data, offsets, shingle)
    result = np.zeros(len(counts), np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8) if len(hashes) else np.zeros((0, 8), np.uint8)
    for k in range(8):
        seen = np.bincount(rows * 256 + octets[:, k], minlength=len(counts) * 256).reshape(len(counts), 256) @ _BITS
        over = seen * 2 > counts[:, None]
        result |= (over.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return result


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            found = fingerprints_of(*byte_view(part.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _band(values: np.ndarray, band: int, bands: int) -> np.ndarray:
    width = 64 // bands
    return (values >> np.uint64(width * band)) & np.uint64((1 << width) - 1)


def _split(values: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage value and radius that divide the values, the more evenly the better; None if they are all alike."""
    best = None
    for k in range(4):
        vantage = values[(seed * 7919 + k * 104729) % len(values)]
        away = np.bitwise_count(values ^ vantage)
        radius = int(np.partition(away, (len(away) - 1) // 2)[(len(away) - 1) // 2])
        for r in (radius, radius - 1):
            inner = int((away <= r).sum())
            if 0 < inner < len(values) and (best is None or abs(2 * inner - len(values)) < best[0]):
                best = abs(2 * inner - len(values)), vantage, r
    return best and (best[1], best[2])


def _tree(values: np.ndarray, depth: int) -> list[tuple[np.uint64, int] | None]:
    """Vantage value and radius of each inner node of a complete binary tree, in level order."""
    nodes: list[tuple[np.uint64, int] | None] = [None] * ((1 << depth) - 1)
    held = {0: values}
    for node in range(len(nodes)):
        mine = held.pop(node)
        nodes[node] = _split(mine, node + 1) if len(mine) else None
        if nodes[node] is None:
            held[2 * node + 1], held[2 * node + 2] = mine, mine[:0]
        else:
            inner = np.bitwise_count(mine ^ nodes[node][0]) <= nodes[node][1]
            held[2 * node + 1], held[2 * node + 2] = mine[inner], mine[~inner]
    return nodes


def _shards(values: np.ndarray, nodes: list, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which leaves each value's ball of the radius overlaps: index of the value, leaf, and whether it is its home."""
    row, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    for level in range(depth):
        rows, at, homes = [], [], []
        for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
            here = node == k
            if nodes[k] is None:
                rows.append(row[here]), homes.append(home[here]), at.append(np.full(here.sum(), 2 * k + 1))
                continue
            vantage, mu = nodes[k]
            away = np.bitwise_count(values[row[here]] ^ vantage).astype(np.int64)
            for child, goes, lives in ((2 * k + 1, away - radius <= mu, away <= mu), (2 * k + 2, away + radius > mu, away > mu)):
                rows.append(row[here][goes]), homes.append((home[here] & lives)[goes]), at.append(np.full(goes.sum(), child))
        row, node, home = np.concatenate(rows), np.concatenate(at), np.concatenate(homes)
    return row, node - ((1 << depth) - 1), home


def joined_in_shard(full: np.ndarray, home: np.ndarray, band: int, bands: int, distance: int) -> np.ndarray:
    """Group labels (smallest position) of a shard's fingerprints: homes are linked with all that lie near."""
    labels, radius, values = np.arange(len(full)), distance // bands, _band(full, band, bands)
    todo = [(np.flatnonzero(home), np.arange(len(full)), 1)]
    while todo:
        own, near, seed = todo.pop()
        cut = _split(values[own], seed) if len(own) * len(near) > BLOCK and len(own) > 64 else None
        if cut is None:
            step = max(1, BLOCK // max(1, len(near)))
            for k in range(0, len(own), step):
                a, b = np.nonzero(np.bitwise_count(full[own[k:k + step], None] ^ full[near]) <= distance)
                join_labels(labels, own[k:k + step][a], near[b])
            continue
        vantage, mu = cut
        inner = np.bitwise_count(values[own] ^ vantage) <= mu
        away = np.bitwise_count(values[near] ^ vantage).astype(np.int64)
        todo.append((own[inner], near[away - radius <= mu], 2 * seed))
        todo.append((own[~inner], near[away + radius > mu], 2 * seed + 1))
    return labels


def near_links(prints: DataFrame, distance: int = DISTANCE, bands: int = BANDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints reachable over steps of at most ``distance`` bits.

    ``prints`` has distinct ``fp`` values. Each shard emits at most one link per fingerprint it holds (to the smallest of
    its group there), never all pairs, so a dense group costs its size.
    """
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, prints.count()) / shard_rows)))))
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [_tree(_band(sample, k, bands), depth) for k in range(bands)]
    radius = distance // bands

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = batch.column(0).to_numpy().view(np.uint64)
            for band, tree in enumerate(trees):
                row, leaf, home = _shards(_band(full, band, bands), tree, depth, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((band << depth) + leaf, pa.int32()), pa.array(full[row].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def search(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("fp")
        full = shard["fp"].to_numpy().view(np.uint64)
        labels = joined_in_shard(full, shard["home"].to_numpy(), int(key[0]) >> depth, bands, distance)
        linked = labels != np.arange(len(labels))
        return pd.DataFrame({"a": full[linked].view(np.int64), "b": full[labels[linked]].view(np.int64)})

    return prints.select("fp").mapInArrow(deal, "shard int, fp long, home boolean").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bands: int = BANDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over linked fingerprints).

    Input: ``doc_id`` and ``text``; other columns are ignored. A null or empty text has no words: its fingerprint is zero
    and is linked like any other. Texts with fewer than ``shingle`` words hash as one sequence. Equal fingerprints are
    one node, so thousands of copies cost one comparison; repeated rows each get a row. A row with a null id takes part
    in linking but names no component; a component without any id has a null component_id. Empty tables give no rows.
    """
    prints = stored(fingerprints(docs, shingle), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "print-classes")
    links = linked_groups(stored(near_links(classes, distance, bands), "print-links"), "prints")
    member = links.union(links.select("root", "root").distinct())
    first = member.join(classes, member["node"] == classes["fp"]).groupBy("root").agg(F.min("first_id").alias("least_id"))
    moved = member.join(first, "root").select(F.col("node").alias("fp"), "least_id")
    named = stored(classes.join(moved, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "print-components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

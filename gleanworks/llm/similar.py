"""Texts that share most of their word shingles: bands of MinHash values find candidates, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import byte_view, discard, linked_groups, slices, stored
from gleanworks.llm.simhash import shingle_hashes

SHINGLE = 5
LEAST = 0.8
#: Two texts meet if all ROWS values of one band agree: at similarity 0.8 they miss each other once in 20 million pairs.
BANDS, ROWS = 32, 4
#: Members of a block; two blocks are compared in one task.
BLOCK = 256
_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One key per band of each text that has shingles (``counts`` without zeros)."""
    begins = np.cumsum(counts) - counts
    keys = np.zeros((len(counts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((hashes ^ _MASKS[k]) * _FACTORS[k], begins)
            keys[:, k // ROWS] = (keys[:, k // ROWS] ^ (least >> np.uint64(7)) ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return keys


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=4 << 20):
        hashes, _, counts = shingle_hashes(*byte_view(part.column("text")), shingle)
        sets = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(left, "a").join(right, "b").where(both >= F.lit(least) * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _compare_blocks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Verified links of whole blocks: members of one tile (sorted together) with different roots, each pair of roots once.

    A tile holds the members of two blocks of a band (or one block with itself); its own members meet the others only.
    """
    def settle(rows: list[tuple]) -> list[tuple[int, int]]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        links, other = [], rows[0][2] != rows[0][3]
        for i, (_, side, low, high, node, root, mine) in enumerate(rows):
            for _, side_, _, _, node_, root_, theirs in rows[:i]:
                if other and side == side_ or top(root) == top(root_) or min(len(mine), len(theirs)) < least * max(len(mine), len(theirs)):
                    continue
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if both >= least * (len(mine) + len(theirs) - both):
                    links.append((node_, node))
                    parent[top(root)] = top(root_)
        return links

    waiting, last = [], None
    found: list[tuple[int, int]] = []
    for batch in batches:
        sets = batch.column("shingles")
        edges, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("band", "side", "low", "high", "node", "root")]
        for k, row in enumerate(zip(*columns, strict=True)):
            tile = (row[0], row[2], row[3])
            if tile != last and waiting:
                found += settle(waiting)
                waiting = []
            last = tile
            waiting.append((*row, values[edges[k]:edges[k + 1]].copy()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
            found = []
    found = settle(waiting) if waiting else []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def similar_groups(texts: DataFrame, least: float = LEAST, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(node, root): texts (``node`` a unique number, ``text``) linked by similar shingle sets, with the smallest node reachable.

    Texts without a shingle and null texts are linked with nothing. No band is expanded into its pairs:

    1. Each member of a band meets the band's smallest member, and one chosen by a second order. What is similar enough
       is linked; a band whose members are all in one group by then is done.
    2. The members of the other bands are dealt into blocks of ``block``, and each two blocks are compared in one task, which
       only looks at pairs of different groups. Its rows are members, not pairs.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            hashes, _, counts = shingle_hashes(*byte_view(part.column("text")), shingle)
            some = counts > 0
            if some.any():
                node = part.column("node").to_numpy()[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS)), pa.array(band_keys(hashes, counts[some]).ravel().view(np.int64))], ["node", "band"])

    texts = texts.where("text is not null").select("node", "text")
    bands = stored(texts.mapInArrow(sign, "node long, band long"), "similar-bands")
    second = F.xxhash64(F.col("node"), F.lit(1))
    shared = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", second).alias("other")).where("low <> high")
    members = stored(bands.join(shared.drop("high"), "band"), "similar-members")
    discard(bands)
    pairs = members.select(F.col("low").alias("a"), F.col("node").alias("b")).union(members.select(F.least("other", "node").alias("a"), F.greatest("other", "node").alias("b")))
    pairs = stored(pairs.where("a <> b").distinct(), "similar-pairs")
    wanted = members.select("node").distinct()
    sets = stored(texts.join(wanted, "node", "left_semi").mapInArrow(lambda batches: _shingle_sets(batches, shingle), "node long, shingles array<long>"), "similar-sets")
    links = stored(_verified(pairs, sets, least), "similar-links")
    groups = linked_groups(links, "similar")
    rooted = stored(members.select("band", "node").join(groups, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "similar-rooted")
    open_ = stored(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
                   .select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "similar-open")
    discard(pairs, members)
    more = rooted.join(open_, "band").withColumn("own", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    tiles = more.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", (F.col("own") > F.col("with")).cast("int").alias("side"), F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "node", "root")
    met = tiles.join(sets, "node").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "root", "node")
    late = stored(met.select("band", "side", "low", "high", "node", "root", "shingles").mapInArrow(lambda batches: _compare_blocks(batches, least), "a long, b long"), "similar-late")
    out = stored(linked_groups(links.union(late), "similar") if not late.isEmpty() else groups, "similar-groups")
    discard(rooted, open_, sets, links, late)
    return out


def without_similar(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """Of each group of texts linked by similarity, the one with the smallest ``doc_id`` stays; all other rows stay.

    ``doc_id`` is a number of its own for each row (``common.keyed`` makes one). Null, empty and white texts are similar to
    nothing and stay; a text with fewer words than a shingle is one shingle. Other columns, whatever their names, are
    kept. An empty table stays empty.
    """
    groups = similar_groups(docs.select(F.col("doc_id").alias("node"), "text"), least, shingle)
    return docs.join(groups.select(F.col("node").alias("_gone")), F.col("doc_id") == F.col("_gone"), "left_anti")

"""Near duplicates of embeddings: an exact metric range join over cells around pivots.

A vector lives in the cell of its nearest pivot (angle, a metric). With the search angle t, a partner in the cell of
pivot q can only lie near x if angle(x, q) <= radius(q) + t and angle(x, q) - angle(x, own pivot) <= 2 t, both by the
triangle inequality. Those two bounds say to which cells x is replicated; then every cell is joined on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import join_labels, linked_groups, stored

COSINE = 0.9
#: Vectors of a cell that are held at once; larger cells are cut into slices of about this many.
CELL_ROWS = 4096
#: Pivots at most; with their radii they are broadcast (1,024 vectors).
MAX_PIVOTS = 1024
#: Vectors looked at to choose pivots; results do not depend on them.
SAMPLE = 1024
#: What rounding may add to an angle or take from a single-precision product; what is within is decided in double precision.
SLACK = 1e-6
SCREEN = 1e-4
_CHUNK = 1 << 16


def _unit_rows(values: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id with ``value``, the components as doubles in bytes; null for vectors that can link with nothing.

    Those are null, empty, all-zero ones and ones with a null or non-finite component or an infinite norm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column("embedding"), []
            offsets = column.offsets.to_numpy()
            inner = column.values
            values = inner.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            missing = column.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                for k in range(len(column)):
                    row = values[offsets[k]:offsets[k + 1]]
                    size = float(np.sqrt(np.dot(row, row))) if len(row) and not missing[k] else 0.0
                    out.append(row.tobytes() if 0 < size < math.inf else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "value"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, value binary")


def choose_pivots(values: list[bytes], count: int) -> dict[int, np.ndarray]:
    """Unit pivots per vector length, each far from those before it."""
    chosen: dict[int, np.ndarray] = {}
    for size in sorted({len(v) for v in values}):
        rows = _unit_rows([v for v in values if len(v) == size])
        take, closest = [0], rows @ rows[0]
        while len(take) < min(count, len(rows)):
            far = int(np.argmin(closest))
            take.append(far)
            closest = np.maximum(closest, rows @ rows[far])
        chosen[size] = rows[take]
    return chosen


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _linked(own: np.ndarray, other: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with at least that cosine, in bounded chunks: screened in single, decided in double precision."""
    step = max(1, (1 << 22) // max(1, len(other)))
    own32, other32 = own.astype(np.float32), other.astype(np.float32)
    for k in range(0, len(own), step):
        a, b = np.nonzero(own32[k:k + step] @ other32.T >= cosine - SCREEN)
        for c in range(0, len(a), _CHUNK):
            i, j = a[c:c + _CHUNK] + k, b[c:c + _CHUNK]
            good = np.einsum("ij,ij->i", own[i], other[j]) >= cosine
            yield i[good], j[good]


class _Cell:
    """Residents of one cell, with the weight linked to each and their groups; visitors pass by in batches."""

    def __init__(self, ids: np.ndarray, mass: np.ndarray, rows: np.ndarray, cosine: float) -> None:
        self.ids, self.mass, self.rows, self.cosine = ids, mass, rows, cosine
        self.gain, self.labels, self.members = np.zeros(len(ids), np.int64), np.arange(len(ids)), ids
        for i, j in _linked(rows, rows, cosine):
            i, j = i[i < j], j[i < j]
            np.add.at(self.gain, i, mass[j])
            np.add.at(self.gain, j, mass[i])
            join_labels(self.labels, i, j)

    def visit(self, ids: np.ndarray, mass: np.ndarray, rows: np.ndarray) -> None:
        gain, mine, theirs = np.zeros(len(ids), np.int64), [], []
        for i, j in _linked(self.rows, rows, self.cosine):
            np.add.at(self.gain, i, mass[j])
            np.add.at(gain, j, self.mass[i])
            fresh = np.unique(self.labels[i] * len(ids) + j)  # one link to each group is enough
            mine.append(fresh // len(ids)), theirs.append(fresh % len(ids))
        hit = np.flatnonzero(gain)
        if len(hit):
            place = np.zeros(len(ids), np.int64)
            place[hit] = len(self.members) + np.arange(len(hit))
            self.labels = np.concatenate([self.labels, place[hit]])
            self.members, self.gain = np.concatenate([self.members, ids[hit]]), np.concatenate([self.gain, gain[hit]])
            join_labels(self.labels, np.concatenate(mine), place[np.concatenate(theirs)])

    def result(self) -> pa.RecordBatch:
        least = self.members.copy()
        np.minimum.at(least, self.labels, self.members)
        hit = self.gain > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(self.members[hit]), pa.array(self.gain[hit]), pa.array(least[self.labels][hit])], ["node", "links", "root"])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links (other vectors with at least that cosine), component_id (smallest reachable vec_id), kept.

    Input: ``vec_id`` and ``embedding`` (array of numbers); other columns, labels too, are ignored. Vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing, not even with their like: n_links 0,
    component_id their own id, kept. Vectors of different length do not link. Equal vectors are one class, counted by
    its size, so copies are never paired up; repeated rows each count. A row with a null id links, but names no
    component. Empty tables give no rows.

    Cells hold a bounded number of residents (large ones are cut into slices) and read visitors as a stream. In high
    dimension with few near neighbours the triangle bounds prune little and most vectors visit most cells: then the join
    does n * n / 2 products, in matrix blocks.
    """
    angle = math.acos(cosine)
    given = stored(usable_vectors(vectors), "vectors")
    classes = stored(given.where("value is not null").groupBy("value").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("mass"))
                     .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    wanted = min(MAX_PIVOTS, math.ceil(classes.count() / cell_rows))
    pivots = choose_pivots([r[0] for r in classes.select("value").orderBy(F.xxhash64("value")).limit(SAMPLE).collect()], wanted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            size, pivot, away = np.array([len(v) for v in values], np.int32), np.full(len(values), -1, np.int32), np.zeros(len(values))
            for length in np.unique(size):
                if int(length) in pivots:
                    here = np.flatnonzero(size == length)
                    angles = _angles(_unit_rows([values[k] for k in here]), pivots[int(length)])
                    pivot[here], away[here] = angles.argmin(axis=1), angles.min(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "mass", "value")), pa.array(size), pa.array(pivot), pa.array(away)],
                                             ["node", "mass", "value", "size", "pivot", "away"])

    placed = stored(classes.select("node", "mass", "value").mapInArrow(
        assign, "node long, mass long, value binary, size int, pivot int, away double"), "vector-cells")
    facts = {(r["size"], r["pivot"]): (r["radius"], math.ceil(r["n"] / cell_rows)) for r in placed.where("pivot >= 0").groupBy("size", "pivot").agg(
        F.max("away").alias("radius"), F.count("*").alias("n")).collect()}  # at most MAX_PIVOTS rows per sampled vector length

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, pivot, away = (batch.column(c).to_numpy() for c in ("node", "size", "pivot", "away"))
            values = batch.column("value")

            def rows(index: np.ndarray, p: int, part: np.ndarray, visitor: bool) -> pa.RecordBatch:
                taken = batch.take(pa.array(index))
                return pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in ("node", "mass", "value", "size")), pa.array(np.full(len(index), p, np.int32)),
                     pa.array(part.astype(np.int32)), pa.array(np.full(len(index), visitor))],
                    ["node", "mass", "value", "size", "pivot", "slice", "visitor"])

            for length, p in sorted(set(zip(size.tolist(), pivot.tolist(), strict=True))):
                here = np.flatnonzero((size == length) & (pivot == p))
                parts = facts[length, p][1] if p >= 0 else 1
                part = (node[here] * 2654435761 % 4294967296) % parts
                yield rows(here, p, part, False)
                for later in range(1, parts):
                    yield rows(here[part < later], p, np.full((part < later).sum(), later), True)
                if p < 0:
                    continue
                angles = _angles(_unit_rows([values[k].as_py() for k in here]), pivots[length])
                for q in range(p + 1, len(pivots[length])):
                    if (length, q) in facts:
                        radius, slices_ = facts[length, q]
                        near = (angles[:, q] <= radius + angle + SLACK) & (angles[:, q] - away[here] <= 2 * angle + SLACK)
                        for k in range(slices_):
                            yield rows(here[near], q, np.full(near.sum(), k), True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, cell = [], None
        for batch in batches:
            ids, mass, visitor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "mass", "visitor"))
            rows = _unit_rows(batch.column("value").to_pylist())
            if not visitor.all():
                if cell is not None:
                    raise RuntimeError("residents of a cell must come before its visitors")
                waiting.append((ids[~visitor], mass[~visitor], rows[~visitor]))
            if visitor.any() and waiting:
                cell = cell or _Cell(*(np.concatenate(x) for x in zip(*waiting, strict=True)), cosine)
                cell.visit(ids[visitor], mass[visitor], rows[visitor])
        if waiting:
            yield (cell or _Cell(*(np.concatenate(x) for x in zip(*waiting, strict=True)), cosine)).result()

    dealt = placed.mapInArrow(deal, "node long, mass long, value binary, size int, pivot int, slice int, visitor boolean")
    key = ["size", "pivot", "slice"]
    found = stored(dealt.repartition(*key).sortWithinPartitions(*key, "visitor").groupBy(*key).applyInArrow(
        join, "node long, links long, root long"), "vector-links")
    total = found.groupBy("node").agg(F.sum("links").alias("linked"))
    groups = linked_groups(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    member = groups.union(groups.select("root", "root").distinct())
    first = member.join(classes, "node").groupBy("root").agg(F.min("first_id").alias("least_id"))
    moved = member.join(first, "root").select("node", "least_id")
    named = stored(classes.join(total, "node", "left").join(moved, "node", "left").select(
        "value", (F.col("mass") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id")),
        "vector-groups")
    linked = given.where("value is not null").join(named, "value").select("vec_id", "n_links", "component_id")
    alone = given.where("value is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Packing documents into token sequences of fixed length by the linear grouping scheme.

Only counts per length (at most ``capacity`` numbers) come to the driver, where the plan is made: lengths above a share of
the capacity are rounded up within groups of equal cardinality, the few rounded sizes are packed by a linear program over
configurations, real lengths take the places of the rounded ones, and what is left is packed best-fit, small ones last.
The plan says for each length which ranks go where; ranks are then dealt to the real documents on the cluster.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.llm.common import byte_view, slices, stored
from gleanworks.llm.tokens import encoder, with_end

CAPACITY = 2048
#: Pieces longer than this share of the capacity are grouped; shorter ones fill gaps.
LARGE_SHARE = 1 / 3
#: Groups of equal cardinality at most.
GROUPS = 48
#: Parts of a length; the rows of a part are ranked together, so a hot length spreads over as many tasks.
PARTS = 512


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each whole text: ids, an end id, cut only where longer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, starts = with_end(*encoder(tokenizer).encode(*byte_view(part.column("text"))))
            total = np.diff(starts)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(capacity, total[row] - piece * capacity)
            data, begin = memoryview(ids.astype("<u4").tobytes()), starts[row] + piece * capacity
            checks = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(checks, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Rows (length, first rank, first sequence, pieces per sequence, offset): a run of equal pieces in equal sequences."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def best_configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int, most: int = 5000) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many pieces of each size share a sequence) with their numbers: the linear program of cutting
    stock, by column generation. Sizes and wanted counts are positive; the number of sizes is small."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, amount = np.linalg.inv(basis), wanted / (capacity // sizes)
    for turn in range(most):
        price = np.maximum(inverse.sum(axis=0), 0.0)
        value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.argsort(sizes)
        small, worth = sizes[order], price[order]
        for c in range(int(small[0]), capacity + 1):  # best value of a sequence of c tokens
            fits = np.searchsorted(small, c, "right")
            gain = value[c - small[:fits]] + worth[:fits]
            best = int(gain.argmax())
            if gain[best] > value[c - 1] + 1e-12:
                value[c], taken[c] = gain[best], best
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if taken[c] < 0:
                c -= 1
                continue
            column[order[taken[c]]] += 1
            c -= int(small[taken[c]])
        move = inverse @ column
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1.0), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * move, 0.0)
        amount[out] = step
        basis[:, out] = column
        if turn % 100 == 99:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ wanted, 0.0)
        else:
            pivot = inverse[out] / move[out]
            inverse = inverse - np.outer(move, pivot)
            inverse[out] = pivot
    return [(basis[:, j].astype(int), float(amount[j])) for j in range(k) if amount[j] > 1e-9]


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, large_share: float = LARGE_SHARE, groups: int = GROUPS) -> Plan:
    """Where the pieces of each length go, from the number of pieces per length."""
    plan = Plan()
    full = counts.get(capacity, 0)
    if full:
        plan.rows.append((capacity, 0, 0, 1, 0))
        plan.sequences = full
    # groups of equal cardinality over the large lengths, longest first; each holds runs (length, first rank, count)
    large = [(s, n) for s, n in sorted(counts.items(), reverse=True) if large_share * capacity < s < capacity and n]
    total = sum(n for _, n in large)
    wanted_groups = min(groups, total)
    queues: list[list[list[int]]] = []
    share, left = -(-total // wanted_groups) if total else 0, 0
    for size, n in large:
        rank = 0
        while rank < n:
            if left == 0:
                queues.append([])
                left = share
            take = min(left, n - rank)
            queues[-1].append([size, rank, take])
            rank, left = rank + take, left - take
    merged: list[list[list[int]]] = []  # groups that round up to the same size are one size
    for queue in queues:
        if merged and merged[-1][0][0] == queue[0][0]:
            merged[-1].extend(queue)
        else:
            merged.append(queue)
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, number)
    if merged:
        sizes = np.array([q[0][0] for q in merged])
        wanted = np.array([sum(run[2] for run in q) for q in merged], float)
        for config, amount in best_configurations(sizes, wanted, capacity):
            number = int(amount + 1e-6)
            if number:
                for first, n, used in _substitute(config, number, merged, plan):
                    open_runs[capacity - used].append((first, n))
    rest = [tuple(run) for q in merged for run in q if run[2]]
    rest += [(s, 0, n) for s, n in sorted(counts.items(), reverse=True) if s <= large_share * capacity and n]
    _best_fit(sorted(rest, key=lambda r: (-r[0], r[1])), open_runs, capacity, plan)
    return plan


def _substitute(config: np.ndarray, number: int, queues: list, plan: Plan) -> list[tuple[int, int, int]]:
    """Put real pieces on the places of ``number`` sequences of one configuration; runs (first, number, tokens used).

    The last (smallest) place of several stays open: rounding guarantees that a piece fits there, and the best-fit pass
    finds one that fits closely, where any piece of the group would waste what rounding added.
    """
    runs = [(plan.sequences, number, 0)]
    plan.sequences += number
    places = np.repeat(np.arange(len(config)), config)
    for group in places[:max(1, len(places) - 1)]:
        after = []
        for first, n, used in runs:
            while n and queues[group]:
                run = queues[group][0]
                take = min(n, run[2])
                plan.rows.append((run[0], run[1], first, 1, used))
                after.append((first, take, used + run[0]))
                first, n = first + take, n - take
                run[1], run[2] = run[1] + take, run[2] - take
                if not run[2]:
                    queues[group].pop(0)
            if n:
                after.append((first, n, used))
        runs = after
    return runs


def _best_fit(pieces_: list[tuple[int, int, int]], open_runs: dict[int, list[tuple[int, int]]], capacity: int, plan: Plan) -> None:
    """Place runs of equal pieces, longest first, each into the sequence with the least room that holds it."""
    rooms = sorted(r for r in open_runs if open_runs[r])
    for size, rank, n in pieces_:
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                open_runs[capacity].append((plan.sequences, -(-n // per)))
                plan.sequences += -(-n // per)
                rooms.append(capacity)
                continue
            room = rooms[at]
            first, number = open_runs[room].pop()
            if not open_runs[room]:
                rooms.pop(at)
            per = room // size
            whole, some = min(number, n // per), 0
            if whole:
                plan.rows.append((size, rank, first, per, capacity - room))
                _open(open_runs, rooms, room - per * size, first, whole)
                rank, n = rank + whole * per, n - whole * per
            if n and whole < number:  # fewer than fill one sequence: all of them go into the next
                plan.rows.append((size, rank, first + whole, n, capacity - room))
                _open(open_runs, rooms, room - n * size, first + whole, 1)
                rank, n, some = rank + n, 0, 1
            if whole + some < number:
                _open(open_runs, rooms, room, first + whole + some, number - whole - some)


def _open(open_runs: dict, rooms: list[int], room: int, first: int, number: int) -> None:
    if room:
        if not open_runs[room]:
            bisect.insort(rooms, room)
        open_runs[room].append((first, number))


def place_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int")
    cut = cut.withColumn("part", part)
    parts = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity``
    rows = np.array(sorted(make_plan(counts, capacity).rows), np.int64).reshape(-1, 5)
    keys = (rows[:, 0] << 44) + rows[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            nth = rank - rows[row, 1]
            sequence, offset = rows[row, 2] + nth // rows[row, 3], rows[row, 4] + nth % rows[row, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    earlier = Window.partitionBy("p_length").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("length").alias("p_length"), F.col("part").alias("p_part"), "n").withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = cut.withColumn("inside", F.row_number().over(inside)).join(
        before, (F.col("length") == F.col("p_length")) & (F.col("part") == F.col("p_part"))).withColumn("rank", F.col("before") + F.col("inside") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and offset where each goes, in few sequences of at most ``capacity``.

    Input: ``doc_id`` and ``text``; other columns are ignored. A null or empty text is its end id alone. Documents longer
    than the capacity are cut, all others stay whole. Rows that repeat, or share an id, or have a null id are packed each
    on its own. Reruns place equal tables alike. An empty table gives no rows.
    """
    return place_pieces(stored(cut_pieces(docs, tokenizer, capacity), "pieces"), capacity)

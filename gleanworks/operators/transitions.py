"""Moves of a finite automaton per key, folded in parallel.

Which state a move finds depends on all moves before it, yet a range of moves acts on the state as a whole: it sends each
possible state to one state and accepts a number of moves on the way. Such maps compose. So rows are dealt out by ranges
of (key, order); each range is walked once for all states together, the few maps of a key are composed to the state that
each range begins with, and each range is walked once more from there. A key with very many moves has many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.operators import ordered


class _Steps:
    """The walk for all states at once; a vector of states and a move give the next vector, which is looked up."""

    def __init__(self, states: list[str], pairs: set[tuple[str, str]]) -> None:
        self.states, self.pairs, self.known = tuple(states), pairs, {}

    def step(self, vector: tuple, move: str) -> tuple[tuple, list[int]]:
        if (vector, move) not in self.known:
            moved = [k for k, state in enumerate(vector) if (state, move) in self.pairs]
            self.known[vector, move] = (tuple(move if k in moved else state for k, state in enumerate(vector)), moved)
        return self.known[vector, move]


def fold(moves: DataFrame, key: str, order: list[str], move: str, current: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``moves`` with the state each one finds (``previous``), whether it is a valid pair (``accepted``), and the ``version``
    after it: that of ``current`` (key, previous, version; one row per key) raised by one per accepted move.

    A move that is not accepted changes nothing. Keys that ``current`` lacks have a null state, from which no move goes;
    a null key is a key of its own. Moves of equal order follow each other in any way.
    """
    valid, states = set(pairs), sorted({a for a, _ in pairs} | {b for _, b in pairs})
    rows = ordered.sliced(moves.withColumn("_name", F.when(F.col(key).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(key).cast("string")))), [key], order)

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, last, vector, counts, out = _Steps(states, valid), None, (), [], []
        for batch in batches:
            for name, part, status in zip(batch["_name"], batch["slice"], batch["_move"], strict=True):
                if (name, part) != last:
                    if last is not None:
                        out.append((*last, list(vector), counts))
                    last, vector, counts = (name, part), steps.states, [0] * len(states)
                vector, moved = steps.step(vector, status)
                for k in moved:
                    counts[k] += 1
            if len(out) > 1024:
                yield pd.DataFrame(out, columns=["_name", "slice", "ends", "counts"])
                out = []
        if last is not None:
            out.append((*last, list(vector), counts))
        yield pd.DataFrame(out, columns=["_name", "slice", "ends", "counts"])

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now, version = None, None, None
        for batch in batches:
            begins, versions = [], []
            for name, ends, counts, previous, first in zip(*(batch[c] for c in ("_name", "ends", "counts", "previous", "version")), strict=True):
                if name != last:
                    last, now, version = name, previous, first
                begins.append(now)
                versions.append(version)
                if now in states:
                    k = states.index(now)
                    now, version = ends[k], version + int(counts[k])
            yield pd.DataFrame({"_name": batch["_name"], "slice": batch["slice"], "previous": begins, "version": pd.array(versions, dtype="Int64")})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now, version = None, None, None
        for batch in batches:
            before, accepted, versions = [], [], []
            for name, part, status, known, first in zip(*(batch[c] for c in ("_name", "slice", "_move", "previous", "version")), strict=True):
                if (name, part) != last:
                    last, now, version = (name, part), known, first
                before.append(now)
                accepted.append((now, status) in valid)
                if accepted[-1]:
                    now, version = status, version + 1
                versions.append(version)
            yield batch.drop(columns=["_name", "slice", "_move"]).assign(previous=before, version=pd.array(versions, dtype="Int64"), accepted=accepted)

    placed = rows.withColumn("_move", F.col(move).cast("string"))
    by_slice = placed.select("_name", "slice", "_move", *[c for c in order if c not in ("_name", "slice", "_move")]).repartition("_name", "slice").sortWithinPartitions("_name", "slice", *order)
    mapped = by_slice.mapInPandas(maps, "_name string, slice int, ends array<string>, counts array<bigint>")
    known = current.select(F.col(key).alias("_known"), F.col("previous").cast("string").alias("previous"), F.col("version").cast("bigint").alias("version"))
    named = known.withColumn("_name", F.when(F.col("_known").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("_known").cast("string")))).drop("_known")
    begun = mapped.join(named, "_name", "left").repartition("_name").sortWithinPartitions("_name", "slice").mapInPandas(
        starts, "_name string, slice int, previous string, version bigint")
    met = placed.join(begun, ["_name", "slice"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moves.schema.fields)
    dealt = met.select(*moves.columns, "_name", "slice", "_move", "previous", "version").repartition("_name", "slice").sortWithinPartitions("_name", "slice", *order)
    return dealt.mapInPandas(walk, f"{schema}, previous string, version bigint, accepted boolean")

"""Mixing sources to target weights by entropy balancing.

Each document gets a rate as close as possible (in relative entropy) to one copy, so that the rates times the sizes of a
source add up to its target and no rate exceeds the cap. The optimum is an exponential tilt, rate = min(cap, exp(lam *
size)), with one multiplier per source from Newton steps on the convex dual; rates are then rounded into whole copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.llm.common import byte_view, discard, slices, stored, word_spans

#: Weights of the sources in code point order (null last), repeating; fixed values.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
NEWTON_STEPS = 60
#: Relative distance from the target at which the dual counts as solved.
TOLERANCE = 1e-9
#: Parts of a (source, size) cell; rows of one part are ranked together, so a hot cell spreads over as many tasks.
PARTS = 1024


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``size``, the number of words of the whole text (null: 0)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = byte_view(part.column("text"))
            _, _, before = word_spans(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), pa.array(np.diff(before), pa.int64())], ["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, source string, size long")


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes dealt by weight, at most ``cap`` times a source's size.

    The excess of capped sources is dealt again by weight until none is above. The level (words per unit of weight)
    only rises, so each round needs one number: a combining aggregate over the table of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    sources = (cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)))
    sources = stored(sources, "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    limit, level = F.col("source_size") * F.lit(float(cap)), 0.0
    while True:
        full = F.col("weight") * F.lit(level) > limit
        taken, open_ = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        risen = (share * total - (taken or 0.0)) / open_ if open_ else level
        if risen <= level:
            break
        level = risen
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), limit).alias("target"))


def tilts(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``lam`` per source: the multiplier of the exponential tilt, from Newton steps on the dual, all sources at once.

    A step is one combining aggregate over the (source, size) cells; the multipliers stay a table. The dual's slope,
    sum of n * size * min(cap, exp(lam * size)), rises with lam, so a bracket guards each step. Sizes are scaled by the
    source's mean. A source whose target is zero or its cap needs no tilt; its ``lam`` is null.
    """
    log_cap = float(np.log(cap))
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean_size"))
    state = stored(targets.join(mean, targets["source"].eqNullSafe(mean["source"])).select(
        targets["source"], "target", "mean_size", F.lit(0.0).alias("lam"), F.lit(-4000.0).alias("low"), F.lit(4000.0).alias("high"),
        ((F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * cap)).alias("done")), "mix-dual")
    for _ in range(NEWTON_STEPS):
        if state.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean_size")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(log_cap)))
        weighed = cells.where("size > 0").join(
            state.where("not done").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        slopes = weighed.groupBy("of").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(F.col("lam") * x < log_cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("bend"))
        gap = F.col("target") - F.col("got")
        low, high = F.when(gap > 0, F.col("lam")).otherwise(F.col("low")), F.when(gap <= 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") + gap / F.col("bend")
        middle = (low + high) / 2
        stepped = F.when((F.col("bend") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        solved = (F.abs(gap) <= F.col("target") * TOLERANCE) | (high - low < 1e-13)
        after = state.join(slopes, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "target", "mean_size", F.when(F.col("done") | solved, F.col("lam")).otherwise(stepped).alias("lam"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | solved).alias("done"))
        after = stored(after.coalesce(1), "mix-dual")
        discard(state)
        state = after
    return state.select("source", F.when(F.col("target") > 0, F.col("lam") / F.col("mean_size")).alias("lam"))


def _rounded(cells: pd.DataFrame, cap: float = CAP) -> pd.DataFrame:
    """Whole copies per cell of one source, largest sizes first; what rounding leaves is carried to the next cell in words."""
    cells = cells.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for size, n, rate in zip(cells["size"].to_numpy(), cells["n"].to_numpy(), cells["rate"].to_numpy(), strict=True):
        wish = carry + n * rate * size
        take = min(max(round(wish / size), 0), int(n) * int(cap)) if size else int(n)
        carry = wish - take * size
        copies.append(take)
    return cells.assign(copies=copies)[["source", "size", "n", "rate", "copies"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """How often the mix takes each document.

    Input: ``doc_id``, ``text``, ``source``; other columns are ignored. Returns doc_id, size (words), source_size,
    target (the source's), taken (size times copies), copies, rate, source. Null texts have size 0; documents without
    words keep their one copy, which costs nothing. A null source is a source of its own, last in order. Ties and
    repeated rows count each; which documents of one source and size get the extra copy depends on a hash of the id
    only, so reruns agree. An empty table gives no rows.

    Rates depend on (source, size) alone, so all heavy work is on counted cells. A source has at most sqrt(2 * its
    words) different sizes, which bounds the groups of the rounding step however hot the source. Rounding is sequential
    within a source, largest sizes first, so the last carry is below the smallest sizes.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    sized = stored(word_counts(docs).withColumn("part", part), "mix-sizes")
    parts = stored(sized.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "mix-parts")
    cells = stored(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-cells")
    targets = stored(source_targets(cells, weights, share, cap).coalesce(1), "mix-targets")
    lam = tilts(cells, targets, cap).withColumnRenamed("source", "of")
    goal = targets.select(F.col("source").alias("to"), "target", "source_size")
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size"), F.lit(5.0))))
    rated = (cells.join(lam, F.col("source").eqNullSafe(F.col("of"))).join(goal, F.col("source").eqNullSafe(F.col("to")))
             .withColumn("rate", F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0)
                         .when(F.col("target") >= F.col("source_size") * cap, float(cap)).otherwise(tilted)))
    rounded = rated.groupBy("source").applyInPandas(
        lambda frame: _rounded(frame, cap), "source string, size long, n long, rate double, copies long")
    copies = stored(rounded.select(F.col("source").alias("r_source"), F.col("size").alias("r_size"), "n", "rate", "copies"), "mix-copies")
    # a document's place in its cell: its rank in its part plus the documents of earlier parts
    inside = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    earlier = Window.partitionBy("p_source", "p_size").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = (parts.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), F.col("n").alias("p_n"))
            .withColumn("before", F.coalesce(F.sum("p_n").over(earlier), F.lit(0)))
            .join(copies, F.col("p_source").eqNullSafe(F.col("r_source")) & (F.col("p_size") == F.col("r_size")))
            .join(targets.select(F.col("source").alias("t_source"), "source_size", "target"), F.col("p_source").eqNullSafe(F.col("t_source"))))
    place = F.col("before") + F.row_number().over(inside) - 1
    each = F.floor(F.col("copies") / F.col("n"))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")))
    return (joined.withColumn("place", place)
            .withColumn("copies", (each + F.when(F.col("place") < F.col("copies") - each * F.col("n"), 1).otherwise(0)).cast("long"))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate", "source"))

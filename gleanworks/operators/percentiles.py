"""Exact percentiles of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here values are counted, the counts are
dealt out by ranges of (group, value), and only the ranges that hold a wanted rank are looked into. Ranges are of about
equal size, however narrow the values of a group lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks.operators.ordered import _KEY, _RANGE, _ranged

def _ranks(n: Column, fraction: float, method: str) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and interpolation weight (ranks start at 1)."""
    if method == "continuous":
        position = F.lit(fraction) * (n - 1)
        return F.floor(position) + 1, F.ceil(position) + 1, position - F.floor(position)
    if method == "nearest":
        rank = F.greatest(F.ceil(F.lit(fraction) * n), F.lit(1))
    elif method == "floor":
        rank = F.least(F.floor(F.lit(fraction) * n) + 1, n)
    else:
        raise ValueError(f"unknown method {method!r}")
    return rank, rank, F.lit(0.0)


def percentiles(df: DataFrame, group: list[str], value: Column, fractions: dict[str, float],
                method: str = "continuous") -> DataFrame:
    """One row per group with a column per named fraction.

    ``continuous`` interpolates, ``nearest`` takes rank ``ceil(p*n)``, ``floor`` takes
    rank ``floor(p*n)+1``. Null values are left out and NaN ranks last. A null in the group columns is a
    group of its own; a group without values has null percentiles.
    """
    counts = df.select(*group, value.cast("double").alias("_v")).groupBy(*group, "_v").agg(F.count("_v").alias("_c"))
    rows = _ranged(counts, group, ["_v"])
    before = Window.partitionBy(_KEY).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy(_KEY, _RANGE).agg(F.sum("_c").alias("_inside"))
        .withColumn("_before", F.coalesce(F.sum("_inside").over(before), F.lit(0)))
        .withColumn("_n", F.sum("_inside").over(Window.partitionBy(_KEY)))
    )
    wanted = []
    for name, fraction in fractions.items():
        low, high, weight = _ranks(F.col("_n"), fraction, method)
        wanted.append(F.struct(F.lit(name).alias("p"), low.alias("rank"), (1 - weight).alias("w")))
        wanted.append(F.struct(F.lit(name).alias("p"), high.alias("rank"), weight.alias("w")))
    here = F.filter(F.array(*wanted), lambda t: (t["w"] > 0) & (t["rank"] > F.col("_before"))
                    & (t["rank"] <= F.col("_before") + F.col("_inside")))
    needed = ranges.withColumn("_wanted", here).where(F.size("_wanted") > 0).drop("_inside", "_n")
    inside = Window.partitionBy(_KEY, _RANGE).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        rows.where("_c > 0").join(needed, [_KEY, _RANGE])
        .withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_hits", F.filter("_wanted", lambda t: (t["rank"] > F.col("_to") - F.col("_c")) & (t["rank"] <= F.col("_to"))))
    )
    picked = ranked.select(_KEY, "_v", F.explode("_hits").alias("_t"))
    columns = [
        F.sum(F.when(F.col("_t.p") == name, F.col("_v") * F.col("_t.w"))).alias(name) for name in fractions
    ]
    return ranges.select(_KEY).distinct().join(picked.groupBy(_KEY).agg(*columns), _KEY, "left").select(f"{_KEY}.*", *fractions)

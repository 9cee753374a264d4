"""Sliced ordered operators and percentiles against brute force, with one hot key."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.operators import ordered, percentiles

ROWS = 600


@pytest.fixture(autouse=True, params=[1, 8], ids=["one range", "eight ranges"])
def ranges(spark, request):
    """How many ranges rows are dealt to: adaptive execution would join small ones into one."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(5)
    rows = [("hot" if i % 3 == 0 else f"k{random.randrange(40)}", random.randrange(0, 5000), i, random.randrange(-9, 10)) for i in range(ROWS)]
    return rows, spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")


def by_key(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return {k: sorted(g, key=lambda r: (r[1], r[2])) for k, g in groups.items()}


def test_previous(skewed):
    rows, df = skewed
    got = {r.i: r.before for r in ordered.with_previous(df, ["k"], ["t", "i"], F.col("v"), "before").collect()}
    want = {}
    for group in by_key(rows).values():
        for before, row in zip([None] + group[:-1], group):
            want[row[2]] = before and before[3]
    assert got == want


def test_previous_keeps_null_values(spark):
    df = spark.createDataFrame([("a", 1, 1, None), ("a", 300, 2, 5)], "k string, t bigint, i bigint, v bigint")
    rows = ordered.with_previous(df, ["k"], ["t", "i"], F.col("v"), "before").orderBy("t").collect()
    assert [r.before for r in rows] == [None, None]


@pytest.mark.parametrize("descending", [False, True])
def test_position_and_total(skewed, descending):
    rows, df = skewed
    total = ordered.with_running_total(df, ["k"], ["t", "i"], F.col("v"), "total", descending)
    placed = ordered.with_position(total, ["k"], ["t", "i"], "n", descending)
    got = {r.i: (r.total, r.n) for r in placed.collect()}
    want = {}
    for group in by_key(rows).values():
        sequence = group[::-1] if descending else group
        for n, row in enumerate(sequence, 1):
            want[row[2]] = (sum(r[3] for r in sequence[:n]), n)
    assert got == want


def test_running_max(skewed):
    rows, df = skewed
    got = {r.i: r.top for r in ordered.with_running_max(df, ["k"], ["t", "i"], F.when(F.col("v") > 0, F.col("v")), "top").collect()}
    want = {}
    for group in by_key(rows).values():
        for n, row in enumerate(group, 1):
            want[row[2]] = max((r[3] for r in group[:n] if r[3] > 0), default=None)
    assert got == want


def test_streak(skewed):
    rows, df = skewed
    hit, reset = F.col("v") > 0, F.col("v") < -6
    got = {r.i: (r.n, r.n_closed) for r in ordered.with_streak(df, ["k"], ["t", "i"], hit, reset, "n").collect()}
    want = {}
    for group in by_key(rows).values():
        n, closed = 0, False
        for row in group:
            n = n + 1 if row[3] > 0 else 0 if row[3] < -6 else n
            closed = closed or row[3] < -6
            want[row[2]] = (n, closed)
    assert got == want


def test_hot_null_key_and_burst(spark):
    """A third of the rows have no key, and another third share one key and one time: both spread over ranges."""
    rows = [(None if i % 3 == 0 else "burst" if i % 3 == 1 else f"k{i}", 7 if i % 3 == 1 else i % 50, i) for i in range(ROWS)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    got = {r.i: (r.n, r.before) for r in ordered.with_previous(
        ordered.with_position(df, ["k"], ["t", "i"], "n"), ["k"], ["t", "i"], F.col("i"), "before").collect()}
    want = {}
    for group in by_key([(str(k), t, i) for k, t, i in rows]).values():
        for n, row in enumerate(group, 1):
            want[row[2]] = (n, group[n - 2][2] if n > 1 else None)
    assert got == want
    if spark.conf.get("spark.sql.shuffle.partitions") == "8":
        spread = ordered._ranged(df, ["k"], ["t", "i"]).groupBy("_range").count().collect()
        assert max(r["count"] for r in spread) < ROWS / 4


def test_latest(skewed):
    rows, df = skewed
    got = {r.k: (r.t, r.i, r.v) for r in ordered.latest_per_key(df, ["k"], ["t", "i"]).collect()}
    assert got == {k: g[-1][1:] for k, g in by_key(rows).items()}


def test_trailing_share(skewed):
    rows, df = skewed
    got = {(r.k, r.second): (r.total, r.failed) for r in ordered.trailing_share(df, ["k"], F.col("t"), F.col("v") < 0, 60).collect()}
    want = {}
    for k, group in by_key(rows).items():
        for row in group:
            frame = [r for r in group if row[1] - 60 <= r[1] <= row[1]]
            want[(k, row[1])] = (len(frame), sum(r[3] < 0 for r in frame))
    assert got == want


@pytest.mark.parametrize("method, numpy_method", [("continuous", "linear"), ("nearest", "inverted_cdf")])
def test_percentiles(spark, method, numpy_method):
    random.seed(9)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", random.choice([0.0, -3.5, 1e6, random.gauss(0, 50), random.random()])) for i in range(900)]
    df = spark.createDataFrame([*rows, ("empty", None), ("one", 4.0)], "g string, v double")
    points = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0, "p0": 0.0}
    got = {r.g: [r[p] for p in points] for r in percentiles.percentiles(df, ["g"], F.col("v"), points, method).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    groups["one"] = [4.0]
    assert got.keys() == groups.keys() | {"empty"} and got.pop("empty") == [None] * 5
    for g, values in groups.items():
        want = [np.quantile(values, p, method=numpy_method) for p in points.values()]
        assert got[g] == pytest.approx(want)


def test_percentiles_of_nan_null_groups_and_narrow_ranges(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", nan), (None, 3.0), (None, 5.0), ("none", None)], "g string, v double")
    got = {r.g: (r.p50, r.p100) for r in percentiles.percentiles(df, ["g"], F.col("v"), {"p50": 0.5, "p100": 1.0}).collect()}
    assert got["a"][0] == 2.0 and got["a"][1] != got["a"][1] and got[None] == (4.0, 5.0) and got["none"] == (None, None)
    narrow = spark.range(5000).select(F.lit("x").alias("g"), (F.lit(1.7e9) + F.col("id") / 1000).alias("v"))
    assert percentiles.percentiles(narrow, ["g"], F.col("v"), {"p50": 0.5}).first().p50 == pytest.approx(1.7e9 + 2.4995)

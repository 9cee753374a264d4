import random

import pytest
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.operators import transitions

PAIRS = fixed.STRICT_TRANSITIONS
STATES = ["PENDING", "RUNNING", "RETRYING", "FAILED", "NEW", None]


def walk(rows, current, pairs):
    out, now = [], {}
    for i, job, at, status in sorted(rows, key=lambda r: r[2]):
        state, version = now.get(job, current.get(job, (None, None)))
        ok = (state, status) in pairs
        out.append((i, job, state, version + 1 if ok else version, ok))
        if ok:
            now[job] = (status, version + 1)
    return sorted(out)


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_fold_equals_the_walk(spark, hot):
    """Jobs of any heat, the null job, unknown jobs and unknown states; the fold by ranges gives what the walk gives."""
    rng = random.Random(int(hot * 10))
    jobs = [None, "a", "b", "c", "unknown"]
    rows = [(i, "hot" if rng.random() < hot else rng.choice(jobs), i, rng.choice(STATES if i % 50 == 0 else ["RUNNING", "RETRYING", "PENDING", None])) for i in range(4000)]
    current = {"hot": ("PENDING", 3), "a": ("RUNNING", 1), "b": ("odd", 5)} | {None: ("PENDING", 1), "c": (None, 4)}
    moves = spark.createDataFrame(rows, "id int, job string, at int, status string")
    known = spark.createDataFrame([(k, *v) for k, v in current.items()], "job string, previous string, version bigint")
    got = transitions.fold(moves, "job", ["at"], "status", known, PAIRS).collect()
    assert sorted((r.id, r.job, r.previous, r.version, r.accepted) for r in got) == walk(rows, current, set(PAIRS))
    assert sum(r.accepted for r in got) > 100


def test_one_job_spreads_over_tasks(spark):
    """A job with very many updates: its rows lie in all tasks of the walk, none has more than its share."""
    n = 200_000
    status = F.element_at(F.array(*(F.lit(s) for s in ("RUNNING", "RETRYING", "FAILED", "RETRYING"))), F.col("id").cast("int") % 4 + 1)
    moves = spark.range(n).select(F.lit(7).alias("job"), F.col("id").alias("at"), status.alias("status"))
    known = spark.createDataFrame([(7, "PENDING", 1)], "job int, previous string, version bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be joined into one task
    try:
        folded = transitions.fold(moves, "job", ["at"], "status", known, PAIRS)
        shares = [r.n for r in folded.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 1 and max(shares) < 0.6 * n
    last = folded.agg(F.max("version"), F.count_if("accepted")).first()
    assert tuple(last) == (n + 1, n)


def test_empty(spark):
    moves = spark.createDataFrame([], "job int, at int, status string")
    known = spark.createDataFrame([], "job int, previous string, version bigint")
    assert transitions.fold(moves, "job", ["at"], "status", known, PAIRS).count() == 0

import random

import pytest
from pyspark.sql import functions as F

from gleanworks.sources import keyed

SCHEMA = "id long, value string, at long"


@pytest.fixture(scope="module")
def table(spark):
    """Even keys from 0 to 3998 in files of about 200 rows, and a row without a key."""
    rows = [(k, f"v{k}", 1) for k in range(0, 4000, 2)] + [(None, "none", 1)]
    return keyed.create(spark.createDataFrame(rows, SCHEMA), "id", "k", rows_per_file=200), {k: (v, a) for k, v, a in rows}


def content(table):
    return {r.id: (r.value, r.at) for r in table.rows().collect()}


def test_index_finds_each_key(spark, table):
    files, want = table
    assert len(files.names()) > 5 and content(files) == want
    for keys in ([0], [3998], [None], [100, 102, 3000], list(range(0, 4000, 200))):
        asked = spark.createDataFrame([(k,) for k in keys], "id long")
        names = keyed.touched(files, asked)
        held = {r.id for r in spark.read.parquet(*names).collect()}
        assert set(keys) <= held and len(names) <= len(keys)
    absent = spark.createDataFrame([(k,) for k in range(1, 400, 2)] + [(10**9,), (-5,)], "id long")
    lone = [keyed.touched(files, spark.createDataFrame([(k,)], "id long")) for k in (1, 3, 5, 7, 10**9, -5)]
    assert sum(map(len, lone)) <= 3 and len(keyed.touched(files, absent)) <= 3  # outside all ranges, or refused by the filter


def test_changes_leave_other_files_alone(spark, table):
    """Upserts, deletes and flags over several generations; files without a changed key keep their names."""
    files, want = table
    rng = random.Random(1)
    want = dict(want)
    for step in range(3):
        near = [k for k in rng.sample(range(200 * step, 200 * step + 400, 2), 5)]
        changes = [(k, f"s{step}", 2 + step) for k in near] + [(k, "old", 0) for k in near[:2]] + [(5001 + step, "new", 9)] + ([(None, "named", 9)] if step == 2 else [])
        after = keyed.upsert(files, spark.createDataFrame(changes, SCHEMA), ["at"])
        for k, v, a in changes:
            if k is not None and (k not in want or a >= want[k][1]):
                want[k] = (v, a)
        touched = set(files.names()) - set(after.names())
        assert len(touched) <= 6 and len(set(files.names()) & set(after.names())) >= len(files.names()) - 6
        files = after
        assert {k: v for k, v in content(files).items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    gone = [0, 2, 5001, 7777]
    after = keyed.delete(files, spark.createDataFrame([(k,) for k in gone], "id long"))
    assert set(content(after)) == set(want) - set(gone)
    assert len(set(after.names()) & set(files.names())) >= len(files.names()) - 4
    nothing = keyed.delete(after, spark.createDataFrame([], "id long"))
    assert set(after.names()) <= set(nothing.names()) and content(nothing) == content(after)


def test_flags(spark):
    rows = spark.range(1000).select("id", F.lit(False).alias("archived"), F.lit(None).cast("timestamp_ntz").alias("archived_at"))
    table = keyed.create(rows, "id", "f", rows_per_file=100)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    once = keyed.flag(table, spark.createDataFrame([(5,), (7,), (7,)], "id long"), at)
    twice = keyed.flag(once, spark.createDataFrame([(7,), (700,), (5000,)], "id long"), at)
    assert sorted(r.id for r in twice.rows().where("archived and archived_at is not null").collect()) == [5, 7, 700] and twice.rows().count() == 1000
    assert len(set(table.names()) & set(twice.names())) >= 7


def test_a_key_of_many_rows_spans_files(spark):
    """Files hold no more rows than asked for, written by few tasks; every file of a key is found and changed."""
    rows = [(k, str(k), 1) for k in range(0, 300, 2)] + [(100, f"more{n}", 1) for n in range(500)] + [(None, f"none{n}", 1) for n in range(250)]
    table = keyed.create(spark.createDataFrame(rows, SCHEMA), "id", "m", rows_per_file=100)
    assert max(r.n for r in table.files.collect()) <= 100 and len(table.names()) >= 9
    for key in (100, None):
        names = keyed.touched(table, spark.createDataFrame([(key,)], "id long"))
        met = F.col("id").eqNullSafe(F.lit(key))
        assert spark.read.parquet(*names).where(met).count() == table.rows().where(met).count()
    after = keyed.delete(table, spark.createDataFrame([(100,)], "id long"))
    assert after.rows().count() == len(rows) - 501 and after.rows().where("id = 100").count() == 0
    many = keyed.create(spark.range(30000), "id", "t", rows_per_file=100)
    tasks = {name.split("part-")[1].split("-")[0] for name in many.names()}
    assert len(many.names()) >= 300 and len(tasks) <= spark.sparkContext.defaultParallelism


def test_empty_table(spark):
    table = keyed.create(spark.createDataFrame([], SCHEMA), "id", "e")
    assert content(table) == {}
    assert content(keyed.upsert(table, spark.createDataFrame([(1, "a", 1)], SCHEMA), ["at"])) == {1: ("a", 1)}

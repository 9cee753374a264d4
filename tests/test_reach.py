"""What need not be read: files without a match, ranges outside a page."""

import random

import pytest
from pyspark.sql import functions as F

from gleanworks.operators import paging
from gleanworks.sources import text_index


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"{rng.choice('abc')}{k // 100}x{rng.randrange(40)}" for _ in range(20)) + (" Zürich Needle-9" if k == 333 else "")) for k in range(1000)]
    rows += [(1000, None), (1001, ""), (1002, "ab"), (1003, "other NEEDLE")]
    return text_index.create(spark.createDataFrame(rows, "id long, body string"), "body", "t", 100, ["id"]), rows


@pytest.mark.parametrize("term", ["A5x7", "rich needle-9", "ab", "x", "nowhere at all", "NEEDLE", "c9x1 b9x"])
def test_search_reads_only_files_that_can_match(spark, table, term):
    files, rows = table
    got = sorted(r.id for r in text_index.search(files, term).collect())
    assert got == sorted(k for k, t in rows if t is not None and term.lower() in t.lower())
    opened = text_index.candidates(files, term)
    held = spark.read.parquet(*files.files).select("id", F.col("_metadata.file_path").alias("f")).where(F.col("id").isin(got)) if got else None
    assert {r.f for r in held.collect()} <= set(opened) if got else True
    if term in ("rich needle-9", "NEEDLE", "A5x7"):
        assert len(opened) <= 2 < len(files.files)
    if term == "nowhere at all":
        assert opened == []


def test_empty_text_table(spark):
    empty = text_index.create(spark.createDataFrame([], "id long, body string"), "body", "e")
    assert text_index.search(empty, "term").count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(50)]), f"r{k}") for k in range(5000)]
    df = spark.createDataFrame(rows, "id long, size int, name string")
    keys = [F.col("size").desc(), F.col("id").asc()]
    return df, keys, paging.directory(df, keys, "p", 400)


@pytest.mark.parametrize("page, size", [(1, 20), (2, 20), (40, 100), (250, 20), (251, 20), (999, 20), (3, 999)])
def test_deep_pages_equal_sorted_pages(pages, page, size):
    df, keys, made = pages
    assert paging.page_from(made, page, size).collect() == paging.page_of(df, keys, page, size).collect()


def test_rows_read_do_not_grow_with_the_page(pages):
    _, _, made = pages
    largest = max(r.n for r in made.ranges.collect())
    read = [sum(r["n"] for r in paging.ranges_of_page(made, page, 20)) for page in range(1, 251)]
    assert max(read) <= 2 * largest < 2000 and min(read) > 0 and paging.ranges_of_page(made, 251, 20) == []


def test_pages_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, size int")
    assert paging.page_from(paging.directory(df, [F.col("size").desc(), F.col("id").asc()]), 1).collect() == []

"""Ordering, pages, cursors and the result envelope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanworks import fixed
from gleanworks.operators import predicates
from gleanworks.session import new_location


@dataclass(frozen=True)
class DataQuery:
    """What a caller may ask for. Column names are those of the queried table."""

    filters: dict = field(default_factory=dict)
    page: int = 1
    page_size: int = fixed.DEFAULT_PAGE_SIZE
    sort_field: str = "createdAt"
    order: str = "desc"
    classification: tuple[str, ...] = ("PUBLIC",)
    include_metadata: bool = True

    def __post_init__(self) -> None:
        if self.page < 1:
            raise ValueError("page starts at 1")
        if not 1 <= self.page_size <= fixed.MAX_PAGE_SIZE:
            raise ValueError(f"page size must be 1 to {fixed.MAX_PAGE_SIZE}")
        if self.order not in ("asc", "desc"):
            raise ValueError("order must be asc or desc")
        predicates.parse_classifications(list(self.classification))


def sort_keys(sort_field: str, order: str, key: str, allowed: list[str] | None = None) -> list[Column]:
    """Sort columns with the row key as tie-break, so every order is total."""
    if sort_field not in (allowed or fixed.SORT_FIELDS):
        raise ValueError(f"cannot sort by {sort_field}")
    column = F.col(sort_field)
    return [column.desc() if order == "desc" else column.asc(), F.col(key).asc()]


def page_of(df: DataFrame, keys: list[Column], page: int = 1, size: int = fixed.DEFAULT_PAGE_SIZE) -> DataFrame:
    return df.orderBy(*keys).offset((page - 1) * size).limit(size)


@dataclass(frozen=True)
class Directory:
    """A table in page order: ``rows`` by numbered range, and for each ``_range`` its ``start`` and number of rows ``n``."""

    rows: DataFrame
    ranges: DataFrame
    keys: list[Column]


def directory(df: DataFrame, keys: list[Column], label: str = "pages", rows_per_range: int = 100_000) -> Directory:
    """The rows sorted once into ranges of the page order, with a count of what stands before each range.

    Every later page opens only the ranges it lies in, so the thousandth page costs what the first one does.
    """
    spark, place = df.sparkSession, new_location(df.sparkSession, label)
    count = max(1, -(-df.count() // rows_per_range))
    dealt = df.repartitionByRange(count, *keys).withColumn("_range", F.spark_partition_id())
    dealt.sortWithinPartitions(*keys).write.partitionBy("_range").parquet(place)
    rows = spark.read.schema(dealt.schema).parquet(place)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counted = rows.groupBy("_range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = new_location(spark, f"{label}-ranges")
    counted.write.parquet(ranges)
    return Directory(rows, spark.read.schema(counted.schema).parquet(ranges), keys)


def ranges_of_page(pages: Directory, page: int, size: int) -> list:
    """The ranges that a page lies in, as rows of ``_range``, ``n`` and ``start``."""
    first = (page - 1) * size
    return sorted(pages.ranges.where((F.col("start") < first + size) & (F.col("start") + F.col("n") > first)).collect(), key=lambda r: r["start"])


def page_from(pages: Directory, page: int, size: int = fixed.DEFAULT_PAGE_SIZE) -> DataFrame:
    """The rows of a page, as ``page_of`` gives them; only the page's own ranges are opened."""
    inside = ranges_of_page(pages, page, size)
    skip = (page - 1) * size - inside[0]["start"] if inside else 0
    opened = pages.rows.where(F.col("_range").isin([r["_range"] for r in inside])).drop("_range")
    return opened.orderBy(*pages.keys).offset(skip).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """Full row count and the number of pages it makes."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.ceil(F.col("total") / size).cast("bigint").alias("pages")
    )


def with_envelope(rows: DataFrame, source: DataFrame, page: int, size: int) -> DataFrame:
    """Attach total, page, page size and has-next to each row of a page."""
    total = source.agg(F.count("*")).scalar()
    return rows.select(
        "*", total.alias("total"), F.lit(page).alias("page"), F.lit(size).alias("page_size"),
        (F.lit(page * size) < total).alias("has_next"),
    )


def run(df: DataFrame, query: DataQuery, key: str, allowed: list[str] | None = None,
        classification: str | None = None) -> DataFrame:
    """Filter, order, cut one page and wrap it. Predicates reach the scan."""
    chosen = df.where(predicates.matches(query.filters))
    if classification:
        chosen = chosen.where(predicates.in_classifications(F.col(classification), list(query.classification)))
    rows = page_of(chosen, sort_keys(query.sort_field, query.order, key, allowed), query.page, query.page_size)
    return with_envelope(predicates.without_metadata(rows, query.include_metadata), chosen, query.page, query.page_size)


def after_cursor(df: DataFrame, sort: str, key: str, cursor: tuple | None, size: int, order: str = "asc") -> DataFrame:
    """Keyset page: the next ``size`` rows after the (sort, key) cursor, in either direction.

    Nulls of the sort column come last in both directions. One extra row is read; ``has_next`` tells on each row
    whether a further page exists, and ``next_sort``, ``next_key`` are the cursor to go on with (of the page's last row).
    """
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    down = order == "desc"
    chosen = df
    if cursor is not None:
        value, identity = cursor
        if value is None:
            chosen = df.where(F.col(sort).isNull() & (F.col(key) > F.lit(identity)))
        else:
            at = F.lit(value)
            further = F.col(sort) < at if down else F.col(sort) > at
            reach = F.col(sort) <= at if down else F.col(sort) >= at  # a plain conjunct, by which the scan can skip
            chosen = df.where((reach | F.col(sort).isNull()) & (further | F.col(sort).isNull() | (F.col(key) > F.lit(identity))))
    keys = [F.col(sort).desc_nulls_last() if down else F.col(sort).asc_nulls_last(), F.col(key).asc()]
    rows = chosen.orderBy(*keys).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*keys))  # at most size + 1 rows
    whole = Window.partitionBy()
    numbered = rows.withColumn("_place", place)
    last = F.struct(F.col(sort).alias("s"), F.col(key).alias("k"))
    ended = numbered.withColumn("has_next", F.count("*").over(whole) > size).withColumn(
        "_last", F.max(F.when(F.col("_place") == size, last)).over(whole))
    return ended.where(F.col("_place") <= size).orderBy("_place").select(
        *df.columns, "has_next", F.when(F.col("has_next"), F.col("_last.s")).alias("next_sort"), F.when(F.col("has_next"), F.col("_last.k")).alias("next_key"))


def next_cursor(rows: list) -> tuple | None:
    """Cursor of the page after the fetched rows, or None on the last page."""
    return (rows[-1]["next_sort"], rows[-1]["next_key"]) if rows and rows[-1]["has_next"] else None


def export_rows(df: DataFrame, created: str, key: str, cap: int) -> DataFrame:
    """The newest ``cap`` rows, with the number of rows there are in all, so that a cut is seen."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(F.col(created).desc(), F.col(key).asc()).limit(cap).withColumn("total", total)


def within_limit(text: Column, maximum: int) -> Column:
    """Text cut at a limit that the caller asks for, and whether it was cut."""
    over = F.coalesce(F.length(text) > maximum, F.lit(False))
    return F.struct(F.when(over, F.substring(text, 1, maximum)).otherwise(text).alias("text"), over.alias("cut"))

"""Global ranks without a single task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to a range; up to so many are ranked in one task.
RANGE_ROWS = 500_000
#: Rows looked at to choose the borders of the ranges.
SAMPLE = 20_000


def global_rank(df: DataFrame, score: str, ties: list[str], to: str, n: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the 1-based rank by ``score`` descending, then ``ties`` ascending, which together are unique.

    Rows are dealt to ranges by borders that are chosen once, so each run deals alike; a rank is the place in the range and the
    rows of the ranges before. The borders come from a bounded sample of keys.
    """
    n = df.count() if n is None else n
    order = [F.desc(score), *ties]
    if n <= range_rows:
        return df.withColumn(to, F.row_number().over(Window.orderBy(*order)))
    key = F.struct((-F.col(score)).alias("s"), *ties)
    share = max(1, n // SAMPLE)
    picked = df.where(F.pmod(F.xxhash64(*ties), F.lit(share)) == 0).select(key.alias("k")).limit(4 * SAMPLE).orderBy("k").collect()
    step = max(1, len(picked) // -(-n // range_rows))
    borders = [r["k"] for r in picked[step::step]]
    dtype = df.select(key.alias("k")).schema["k"].dataType
    edges = df.sparkSession.createDataFrame([([b for b in borders],)], f"edges array<{dtype.simpleString()}>")
    placed = df.join(F.broadcast(edges)).withColumn("_range", F.size(F.filter("edges", lambda e: e <= key))).drop("edges")  # one row
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(to, (F.col("_before") + F.col("_inside")).cast("int")).drop("_range", "_inside", "_before")


def top(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_in(df: DataFrame, by: list[str], order: list[Column | str], k: int, to: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(to) <= k)


def interleave(df: DataFrame, group: str, group_rank: str, order: list[Column | str], k: int) -> DataFrame:
    """Round robin over groups: the first of each group in order of the groups, then the second of each, up to k rows."""
    placed = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.orderBy("turn", group_rank).limit(k)


def first_seen(values: str, order: list[str]) -> Column:
    """An aggregate: the different values in order of first appearance."""
    each = F.array_sort(F.collect_list(F.struct(*order, values)))
    return F.array_distinct(F.transform(each, lambda x: x[values]))


#: Lines to a bucket of ``by_bucket``.
LINES = 64


def by_bucket(spans: DataFrame, start: str, end: str, to: str) -> DataFrame:
    """A row for each bucket of lines that a span meets, so that what holds a line is found by equality on file and bucket."""
    return spans.where(F.col(end) >= F.col(start)).withColumn(to, F.explode(F.sequence(bucket_of(F.col(start)), bucket_of(F.col(end)))))


def bucket_of(line: Column) -> Column:
    return F.floor(line / LINES).cast("long")

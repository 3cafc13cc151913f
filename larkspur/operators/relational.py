"""Scan, join, aggregation, ordering: thin forms of the DataFrame API with the dialect's names, left to Catalyst to plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.scratch import scratch_dir

#: Bytes, as the planner estimates them from file sizes and columns, of a side that may be sent to every executor.
SMALL_BYTES = 16 << 20


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet scan; columns and filter reach the reader (ReadSchema, PushedFilters)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | None, how: str = "inner") -> DataFrame:
    """Equal keys are extracted by Catalyst, which picks the strategy from sizes at run time and splits skewed partitions.

    A condition without equal keys needs one side on every executor: that side's size is checked first, and a larger one
    is planned as a partitioned nested loop.
    """
    if on is None or how == "cross":
        return left.crossJoin(_checked(right))
    return left.join(right, on, how)


def theta_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A join on any condition. A small side is broadcast and looped over; with two large sides the pairs come from a
    partitioned nested loop, and an outer join adds the rows that no pair has, found by their numbers."""
    if how == "right" and small(left):
        return F.broadcast(left).join(right, on, how)
    if how in ("inner", "left") and small(right):
        return left.join(F.broadcast(right), on, how)
    if how == "full" and (small(left) or small(right)):
        return left.join(F.broadcast(right), on, how) if small(right) else F.broadcast(left).join(right, on, how)
    if how == "inner":
        return left.crossJoin(right).where(on)
    a, b = _numbered(left, "left_"), _numbered(right, "right_")
    pairs = a.crossJoin(b).where(on)
    out = pairs
    if how in ("left", "full"):
        alone = a.join(pairs.select("left_").distinct(), "left_", "left_anti").select(*a.columns)
        out = out.unionByName(alone, allowMissingColumns=True)
    if how in ("right", "full"):
        alone = b.join(pairs.select("right_").distinct(), "right_", "left_anti").select(*b.columns)
        out = out.unionByName(alone, allowMissingColumns=True)
    return out.drop("left_", "right_")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number that stays, as they are written down."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame) -> bool:
    """Whether the planner's estimate of the frame's bytes is at most SMALL_BYTES. No job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BYTES


def _checked(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if it is small."""
    return F.broadcast(df) if small(df) else df


def aggregate(df: DataFrame, keys: Sequence[str | Column], *aggs: Column) -> DataFrame:
    """Partial and final hash aggregation; without keys one row, also on empty input."""
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def having(grouped: DataFrame, condition: Column) -> DataFrame:
    return grouped.where(condition)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    """NULL is the smallest value: first ascending, last descending, unless a key says otherwise."""
    return df.orderBy(*keys)


def ranked(df: DataFrame, *keys: Column | str, name: str = "place") -> DataFrame:
    """The frame in order, with each row's place in it, from 1. Rows are dealt by ranges of the keys and numbered within
    each; the rows before a range are counted apart, so no task sees more than its range."""
    path = f"{scratch_dir(df.sparkSession)}/ranges"
    df.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    sizes = rows.groupBy("range_").agg(F.count("*").alias("size_"))
    before = sizes.select("range_", (F.sum("size_").over(Window.orderBy("range_")) - F.col("size_")).alias("before_"))
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*keys))
    return sort(rows.join(F.broadcast(before), "range_").withColumn(name, (own + F.col("before_")).cast("long")).drop("range_", "before_"), name)


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


def top_k(df: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    """The k first rows of an order without sorting all (TakeOrderedAndProject)."""
    return df.orderBy(*keys).limit(k)

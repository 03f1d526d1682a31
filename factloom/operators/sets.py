"""Ordered merges, partition checks and bag comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_lanes(lanes: list[DataFrame], query: list[str], item: str, rank: str) -> DataFrame:
    """Ordered union of ranked lists: lanes in order, each item once, at its first appearance."""
    tagged = [l.select(*query, item, F.lit(i).alias("lane"), F.col(rank).alias("lane_rank")) for i, l in enumerate(lanes)]
    union = reduce(DataFrame.unionByName, tagged)
    first = union.groupBy(*query, item).agg(F.min(F.struct("lane", "lane_rank")).alias("first"))
    w = Window.partitionBy(*query).orderBy("first.lane", "first.lane_rank", item)
    return first.select(*query, item, F.col("first.lane").alias("lane"), F.row_number().over(w).alias("position"))


def partition_check(candidates: DataFrame, included: DataFrame, excluded: DataFrame, key: str,
                    source: str | None = None) -> DataFrame:
    """Is candidates = included + excluded, disjoint and without repeats? Optionally per source."""
    by = [source] if source else []
    tagged = (
        candidates.select(key, *by, F.lit(1).alias("c"), F.lit(0).alias("i"), F.lit(0).alias("x"))
        .unionByName(included.select(key, *by, F.lit(0).alias("c"), F.lit(1).alias("i"), F.lit(0).alias("x")))
        .unionByName(excluded.select(key, *by, F.lit(0).alias("c"), F.lit(0).alias("i"), F.lit(1).alias("x")))
    )
    flags = tagged.groupBy(*by, key).agg(*[F.sum(c).alias(c) for c in "cix"])
    out = flags.groupBy(*by).agg(
        F.sum("c").alias("candidates"), F.sum("i").alias("included"), F.sum("x").alias("excluded"),
        F.count_if((F.col("i") > 0) & (F.col("x") > 0)).alias("overlapping"),
        F.count_if((F.col("c") > 0) & (F.col("i") + F.col("x") == 0)).alias("missing"),
        F.count_if((F.col("c") == 0)).alias("unknown"),
        F.count_if((F.col("c") > 1) | (F.col("i") > 1) | (F.col("x") > 1)).alias("repeated"),
    )
    return out.withColumn("holds", (F.col("overlapping") + F.col("missing") + F.col("unknown") + F.col("repeated")) == 0)


def bags_equal(a: Column, b: Column) -> Column:
    """Equality of two small arrays as bags."""
    return F.array_sort(a) == F.array_sort(b)


def multiset_diff(actual: DataFrame, expected: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key: are the two value bags equal, and does the actual one contain the expected one?

    Bags are compared as counts per value, so a very frequent value is one row.
    """
    counts = (
        actual.select(*key, value, F.lit(1).alias("a"), F.lit(0).alias("e"))
        .unionByName(expected.select(*key, value, F.lit(0).alias("a"), F.lit(1).alias("e")))
        .groupBy(*key, value).agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    )
    return counts.groupBy(*key).agg(
        F.bool_and(F.col("a") == F.col("e")).alias("equal"),
        F.bool_and(F.col("a") >= F.col("e")).alias("contains"),
    )


def set_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0

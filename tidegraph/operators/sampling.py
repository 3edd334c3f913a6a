"""Reproducible samples, splits and folds: the order is that of a hash of id and seed, so it does not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.loops import settled


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with one more column, the place of each row in that order, from 1.

    Spark sorts in ranges, and a row's place is that in its range after the rows of the ranges before; only the sizes of ranges, one for each task, meet in one window.
    """
    placed = settled(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(before), "__part").withColumn(name, place).drop("__part", "__at", "__before")


def shuffled(cascades: DataFrame, seed: int) -> DataFrame:
    """cascade_id and place, from 1."""
    by = F.md5(F.concat(F.col("cascade_id").cast("string"), F.lit(str(seed))))
    return numbered(cascades.select("cascade_id").distinct(), "place", by, "cascade_id")


def sample(cascades: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return shuffled(cascades, seed).where(F.col("place") <= n).select("cascade_id")


def train_test(cascades: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """cascade_id, split: round(share * n), half to even, are test."""
    ordered = shuffled(cascades, seed)
    total = ordered.agg(F.bround(F.count(F.lit(1)) * share).cast("int").alias("k"))
    return ordered.crossJoin(F.broadcast(total)).select("cascade_id", F.when(F.col("place") <= F.col("k"), "test").otherwise("training").alias("split"))  # total: one row


def folds(cascades: DataFrame, k: int = 3) -> DataFrame:
    """cascade_id, fold: contiguous folds of ceil(n / k) by id."""
    ordered = numbered(cascades.select("cascade_id").distinct(), "n", "cascade_id")
    total = ordered.agg(F.ceil(F.count(F.lit(1)) / k).alias("size"))
    return ordered.crossJoin(F.broadcast(total)).select("cascade_id", F.floor((F.col("n") - 1) / F.col("size")).cast("int").alias("fold"))

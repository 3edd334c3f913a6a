"""Attributes, filters and statistics of cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attributes(pc: DataFrame) -> DataFrame:
    """cascade_id, size (different authors), count (posts), first_time, last_time: one pass."""
    return pc.groupBy("cascade_id").agg(
        F.count_distinct("author_id").alias("size"), F.count(F.lit(1)).alias("count"), F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time")
    )


def with_depth(cascades: DataFrame, nodes: DataFrame) -> DataFrame:
    """cascades and their trees' depth, 0 where there is none."""
    depth = nodes.groupBy("cascade_id").agg(F.max("depth").alias("depth"))
    return cascades.join(depth, "cascade_id", "left").fillna(0, ["depth"])


def filtered(cascades: DataFrame, min_size: int | None = None, max_size: int | None = None, min_depth: int | None = None) -> DataFrame:
    """Each bound is optional."""
    bounds: list[Column] = []
    if min_size is not None:
        bounds.append(F.col("size") >= min_size)
    if max_size is not None:
        bounds.append(F.col("size") <= max_size)
    if min_depth is not None:
        bounds.append(F.col("depth") >= min_depth)
    for b in bounds:
        cascades = cascades.where(b)
    return cascades


def size_histogram(cascades: DataFrame, bins: int = 100) -> DataFrame:
    """bin, low, high, n: equal widths from the least size to the largest, the last bin closed on the right."""
    ends = cascades.where("size is not null").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    which = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("size") - F.col("lo")) / width), F.lit(bins - 1)))
    counted = cascades.where("size is not null").crossJoin(F.broadcast(ends)).groupBy(which.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))  # ends: one row
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def size_summary(cascades: DataFrame) -> DataFrame:
    return cascades.agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), F.count("size").alias("n"))


def project_stats(nodes: DataFrame) -> DataFrame:
    """One row: users, cascades, and the range of sizes and depths of trees."""
    by = nodes.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("size"), F.max("depth").alias("depth"))
    users = nodes.agg(F.count_distinct("user_id").alias("n_users"))
    stats = by.agg(F.count(F.lit(1)).alias("n_cascades"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))
    return stats.crossJoin(F.broadcast(users))  # a row each


def missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Users of non-trivial trees that the graph lacks: empty when the graph was made from those trees."""
    known = edges.select(F.col("src").alias("user_id")).union(edges.select("dst")).distinct()
    tied = nodes.where("parent_id is not null").select("user_id").distinct()
    return tied.join(known, "user_id", "left_anti")


def new_only(found: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of found whose key is not there yet."""
    return found.join(existing.select(*key).distinct(), key, "left_anti")


def upserted(base: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """base with the values of change where it has the key and a value; columns that base lacks are added."""
    values = [c for c in change.columns if c not in key]
    renamed = change.select(*key, *[F.col(c).alias(f"__new_{c}") for c in values])
    out = base.join(renamed, key, "left")
    keep = [F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns]
    return out.select(*keep, *[F.col(f"__new_{c}").alias(c) for c in values if c not in base.columns])

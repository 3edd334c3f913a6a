"""Directed graphs of users as rows (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import trees as T


def from_trees(nodes: DataFrame) -> DataFrame:
    return T.edges(nodes).select("src", "dst").distinct()


def vertices(nodes: DataFrame) -> DataFrame:
    """All users of trees, those without an edge too."""
    return nodes.select(F.col("user_id").alias("id")).distinct()


def from_reshares(reshares: DataFrame, pc: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Edges of reshares whose posts have a cascade in common, one of train (cascade_id) if given."""
    r = T.cascade_reshares(reshares, pc)
    if train is not None:
        r = r.join(train.select("cascade_id"), "cascade_id", "left_semi")
    return r.select(F.col("ref_user_id").alias("src"), F.col("user_id").alias("dst")).distinct()


def from_all_reshares(reshares: DataFrame) -> DataFrame:
    """Every reshare, those of one's own posts too."""
    return reshares.select(F.col("ref_user_id").alias("src"), F.col("user_id").alias("dst")).distinct()


def from_targets(reshares: DataFrame, posts: DataFrame) -> DataFrame:
    """Edges of reshares whose own post is one of posts: enough where a post has one cascade."""
    return from_all_reshares(reshares.where("user_id <> ref_user_id").join(posts.select("post_id"), "post_id", "left_semi"))


def degrees(edges: DataFrame) -> DataFrame:
    """user_id, in_degree, out_degree, total; edges that several trees have count for each."""
    both = edges.select(F.col("src").alias("user_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return both.groupBy("user_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("total"))


def low_degree(nodes: DataFrame, least: int) -> DataFrame:
    """user_id of those with fewer than ``least`` edges in all trees."""
    d = degrees(T.edges(nodes).select("src", "dst"))
    return vertices(nodes).join(d.select(F.col("user_id").alias("id"), "total"), "id", "left").where(F.coalesce("total", F.lit(0)) < least).select(F.col("id").alias("user_id"))


def without(edges: DataFrame, users: DataFrame) -> DataFrame:
    gone = users.select(F.col("user_id").alias("src")).distinct()
    return edges.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")


def restricted(edges: DataFrame, users: DataFrame) -> DataFrame:
    kept = users.select(F.col("user_id").alias("src")).distinct()
    return edges.join(kept, "src", "left_semi").join(kept.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def neighbours(edges: DataFrame) -> DataFrame:
    """user_id, predecessors and successors as sorted arrays."""
    p = edges.groupBy(F.col("dst").alias("user_id")).agg(F.array_sort(F.collect_set("src")).alias("predecessors"))
    s = edges.groupBy(F.col("src").alias("user_id")).agg(F.array_sort(F.collect_set("dst")).alias("successors"))
    return p.join(s, "user_id", "full")

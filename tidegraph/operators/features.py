"""Observation sequences of receivers and the features that sequence models read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.sequences import at_receivers
from tidegraph.plans.loops import gathered


def parent_index(edges: DataFrame) -> DataFrame:
    """v, u, pos (from 1), d: sources of each user by ascending id, and how many."""
    w = Window.partitionBy("dst").orderBy("src")
    d = Window.partitionBy("dst")
    return edges.select(F.col("dst").alias("v"), F.col("src").alias("u"), F.row_number().over(w).alias("pos"), F.count(F.lit(1)).over(d).alias("d"))


def evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cascade_id, v, depth, active (positions of the sources that act at that depth), d, state.

    Steps of a user end at its own depth, except for roots and users outside the cascade. The last step of a user who acts later has the
    state 1 + index of its parent, i.e. its position; 0 if it never acts or its parent is no source; binary states are state > 0.
    """
    idx = parent_index(edges)
    src = nodes.select("cascade_id", F.col("user_id").alias("u"), "depth")
    own = gathered(nodes.select("cascade_id", F.col("user_id").alias("v"), F.col("depth").alias("own"), F.col("parent_id").alias("p")), "v")
    seen = at_receivers(src, idx, ()).join(own.hint("shuffle_hash"), ["cascade_id", "v"], "left")
    seen = seen.where("own is null or own = 0 or depth < own")
    step = seen.groupBy("cascade_id", "v", "depth").agg(F.array_sort(F.collect_list("pos")).alias("active"), F.first("d").alias("d"), F.first("own").alias("own"), F.max(F.when(F.col("u") == F.col("p"), F.col("pos"))).alias("parent_here"))
    w = Window.partitionBy("cascade_id", "v")
    whole = step.withColumns({"last": F.max("depth").over(w), "parent": F.max("parent_here").over(w)})
    state = F.when((F.col("depth") == F.col("last")) & (F.col("own") > 0), F.coalesce("parent", F.lit(0))).otherwise(0)
    return whole.select("cascade_id", "v", "depth", "active", "d", state.cast("int").alias("state"))


def observed(ev: DataFrame) -> DataFrame:
    """Evidence with obs, an array of booleans over the sources."""
    return ev.withColumn("obs", F.transform(F.sequence(F.lit(1), F.col("d").cast("int")), lambda i: F.array_contains("active", i)))


def active_users(ev: DataFrame) -> DataFrame:
    """v with a state other than 0 somewhere."""
    return ev.groupBy("v").agg(F.max("state").alias("m")).where("m > 0").select("v")


def ever_active(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The active_users of evidence(nodes, edges), without its steps: a state other than 0 stands for a parent that is a source and acts before."""
    child = nodes.where("depth > 0 and parent_id is not null").select("cascade_id", F.col("user_id").alias("v"), F.col("parent_id").alias("u"), F.col("depth").alias("own"))
    above = nodes.select("cascade_id", F.col("user_id").alias("u"), "depth")
    told = child.join(above, ["cascade_id", "u"]).where("depth < own").select("u", "v").distinct()
    return told.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_semi").select("v").distinct()


def bin_features(ev: DataFrame) -> DataFrame:
    """Cumulative OR of the observations, and a slack so that features sum to d + 1."""
    w = Window.partitionBy("cascade_id", "v").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list("active").over(w))))
    out = ev.withColumn("seen", seen)
    return out.select("cascade_id", "v", "depth", "state", "d", "seen", (F.col("d") + 1 - F.size("seen")).alias("slack"))


def long_features(ev: DataFrame, most: int | None = None) -> DataFrame:
    """Indices of all observations so far, the newest first: position + lag * d, and the slack to lags * d + 1; lags is the longest sequence of
    the receiver. With ``most``, only the last ``most`` observations, and lags is ``most``."""
    w = Window.partitionBy("cascade_id", "v").orderBy("depth").rowsBetween(Window.unboundedPreceding if most is None else -(most - 1), 0)
    if most is None:
        longest = ev.groupBy("cascade_id", "v").count().groupBy("v").agg(F.max("count").cast("int").alias("lags"))
        ev = ev.join(longest, "v")
    else:
        ev = ev.withColumn("lags", F.lit(most))
    hist = ev.withColumn("hist", F.reverse(F.collect_list("active").over(w)))
    flat = F.flatten(F.transform("hist", lambda a, lag: F.transform(a, lambda p: (p + lag * F.col("d")).cast("int"))))
    out = hist.withColumn("on", F.array_sort(flat))
    return out.select("cascade_id", "v", "depth", "state", "d", "on", "lags", (F.col("lags") * F.col("d") + 1 - F.size("on")).alias("slack"))


def decayed(ev: DataFrame, td: float) -> DataFrame:
    """cascade_id, v, depth, pos, x: the sum of td ** lag over the earlier steps in which the source acts. A step makes its sums from a list of the steps before it."""
    w = Window.partitionBy("cascade_id", "v").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    past = ev.select("cascade_id", "v", "depth", F.collect_list("active").over(w).alias("past"))
    lag = lambda m: F.size("past") - 1 - m
    every = past.select("cascade_id", "v", "depth", F.flatten(F.transform("past", lambda a, m: F.transform(a, lambda p: F.struct(p.alias("pos"), F.pow(F.lit(td), lag(m)).alias("x"))))).alias("every"))
    names = F.array_distinct("every.pos")
    summed = F.transform(names, lambda p: F.struct(p.alias("pos"), F.aggregate(F.filter("every", lambda e: e["pos"] == p), F.lit(0.0), lambda s, e: s + e["x"]).alias("x")))
    return every.select("cascade_id", "v", "depth", F.inline(F.when(F.size(names) == F.size("every"), F.col("every")).otherwise(summed)))


def reduced_parents(ev: DataFrame) -> DataFrame:
    """v, pos: sources that ever act; the others need no feature."""
    return ev.select("v", F.explode("active").alias("pos")).distinct()

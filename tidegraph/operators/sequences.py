"""Activation sequences and the joins that models of spreading are fitted on. Times are months of 30 days since the cascade began."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.scalar import months_between
from tidegraph.operators.sampling import numbered
from tidegraph.plans.loops import gathered


def activations(pc: DataFrame, cascades: DataFrame) -> DataFrame:
    """cascade_id, user_id, t, max_t: the first post of each author; posts without a time do not count."""
    first = pc.where("datetime is not null").groupBy("cascade_id", F.col("author_id").alias("user_id")).agg(F.min("datetime").alias("datetime"))
    span = cascades.select("cascade_id", "first_time", "last_time")
    return first.join(span, "cascade_id").select("cascade_id", "user_id", months_between(F.col("datetime"), F.col("first_time")).alias("t"), months_between(F.col("last_time"), F.col("first_time")).alias("max_t"))


def arrays(act: DataFrame) -> DataFrame:
    """cascade_id, users and times in the order of time."""
    seq = F.array_sort(F.collect_list(F.struct("t", "user_id")))
    return act.groupBy("cascade_id").agg(seq.alias("s")).select("cascade_id", F.col("s.user_id").alias("users"), F.col("s.t").alias("times"))


def at_receivers(rows: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, cascade_id, u, ...) of sources beside each of their receivers: the same and the columns of edges (by, u, v, ...), hashed by v.

    An edge is shuffled with a list of its source's rows, not once for each of them.
    """
    rest = [c for c in rows.columns if c not in (*by, "u")]
    lists = rows.groupBy(*by, "u").agg(F.collect_list(F.struct(*rest)).alias("__x"))
    met = gathered(edges.join(lists, [*by, "u"]), "v")
    return met.select(*edges.columns, F.inline("__x"))


def _ends(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"))


def active_parents(act: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """cascade_id, u, v, dt: edges whose ends are both active, the source not later. by: columns of both tables that keep cases (folds of a sample, say) apart."""
    u = act.select(*by, "cascade_id", F.col("user_id").alias("u"), F.col("t").alias("t_u"))
    v = gathered(act.select(*by, "cascade_id", F.col("user_id").alias("v"), F.col("t").alias("t_v")), "v")
    return at_receivers(u, _ends(edges, by), by).join(v.hint("shuffle_hash"), [*by, "cascade_id", "v"]).where("t_u <= t_v").select(*by, "cascade_id", "u", "v", (F.col("t_v") - F.col("t_u")).alias("dt"))


def exposed(act: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """cascade_id, u, v, dt: active sources of users who never act in the cascade; dt is the time left."""
    u = act.select(*by, "cascade_id", F.col("user_id").alias("u"), (F.col("max_t") - F.col("t")).alias("dt"))
    never = gathered(act.select(*by, "cascade_id", F.col("user_id").alias("v")), "v")
    return at_receivers(u, _ends(edges, by), by).join(never.hint("shuffle_hash"), [*by, "cascade_id", "v"], "left_anti").select(*by, "cascade_id", "u", "v", "dt")


def rond_set(act: DataFrame, edges: DataFrame) -> DataFrame:
    """cascade_id, v: inactive users next to an active one."""
    return exposed(act, edges).select("cascade_id", "v").distinct()


def inactive_parents(act: DataFrame, edges: DataFrame) -> DataFrame:
    """cascade_id, v, u: for users of the rond set, their inactive sources.

    Edges are shuffled with lists of the cascades (as numbers) of their sources, and the rows of the result are made last, where a receiver's edges lie.
    """
    codes = numbered(act.select("cascade_id").distinct(), "c", "cascade_id").select("cascade_id", F.col("c").cast("int").alias("c"))
    lists = act.join(codes, "cascade_id").groupBy(F.col("user_id").alias("u")).agg(F.collect_list("c").alias("active"))
    none = F.array().cast("array<int>")
    met = gathered(_ends(edges, ()).join(lists, "u", "left"), "v")
    own = gathered(lists.withColumnsRenamed({"u": "v", "active": "own"}), "v")
    near = met.select("v", F.explode("active").alias("c")).distinct().groupBy("v").agg(F.collect_list("c").alias("near"))
    rond = near.join(own.hint("shuffle_hash"), "v", "left").select("v", F.array_except("near", F.coalesce("own", none)).alias("rond"))
    out = met.join(rond.hint("shuffle_hash"), "v").select("u", "v", F.explode(F.array_except("rond", F.coalesce("active", none))).alias("c"))
    return out.join(F.broadcast(codes), "c").select("cascade_id", "v", "u")  # a row for each cascade


def trials(act: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """u, v, n_pos, n_neg: cascades in which v acts after u, and in which u acts and v does not."""
    pos = active_parents(act, edges, by).groupBy(*by, "u", "v").agg(F.count(F.lit(1)).alias("n_pos"))
    neg = exposed(act, edges, by).groupBy(*by, "u", "v").agg(F.count(F.lit(1)).alias("n_neg"))
    return pos.join(neg, [*by, "u", "v"], "full").fillna(0, ["n_pos", "n_neg"])


def pruned(act: DataFrame, drop: DataFrame, nodes: DataFrame) -> DataFrame:
    """act without the users of drop (user_id), of the cascades that pruned trees (nodes) still have; max_t is the last time that is left."""
    kept = act.join(drop.select("user_id").distinct(), "user_id", "left_anti").join(nodes.select("cascade_id").distinct(), "cascade_id", "left_semi")
    last = kept.groupBy("cascade_id").agg(F.max("t").alias("max_t"))
    return kept.drop("max_t").join(last, "cascade_id").select("cascade_id", "user_id", "t", "max_t")

"""Trees of who reached whom first, as rows: cascade_id, user_id, parent_id (null for roots), act_time, depth.

Who is whose child is decided by the first reshare that touches a user, which takes two aggregations and no sequential state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.loops import settled


def cascade_reshares(reshares: DataFrame, pc: DataFrame) -> DataFrame:
    """Reshares between two posts of one cascade, with that cascade's id, without users who reshare themselves."""
    a = pc.select(F.col("post_id").alias("reshared_post_id"), "cascade_id")
    b = pc.select("post_id", "cascade_id")
    return reshares.where("user_id <> ref_user_id").join(a, "reshared_post_id").join(b, ["post_id", "cascade_id"])


def first_touch(reshares: DataFrame, pc: DataFrame | None = None) -> DataFrame:
    """Nodes without depth, from reshares with cascade_id. pc: authors who are in no reshare become roots at their first post."""
    key = F.struct("datetime", "post_id")
    r = reshares.where("user_id <> ref_user_id")
    child = r.groupBy("cascade_id", "user_id").agg(F.min(F.struct(key.alias("k"), "ref_user_id", "datetime")).alias("c"))
    parent = r.groupBy("cascade_id", F.col("ref_user_id").alias("user_id")).agg(F.min(F.struct(key.alias("k"), "ref_datetime")).alias("p"))
    both = child.join(parent, ["cascade_id", "user_id"], "full")
    is_child = F.col("c.k").isNotNull() & (F.col("p.k").isNull() | (F.col("c.k") < F.col("p.k")))
    nodes = both.select("cascade_id", "user_id", F.when(is_child, F.col("c.ref_user_id")).alias("parent_id"), F.when(is_child, F.col("c.datetime")).otherwise(F.col("p.ref_datetime")).alias("act_time"))
    if pc is None:
        return nodes
    alone = pc.groupBy("cascade_id", F.col("author_id").alias("user_id")).agg(F.min("datetime").alias("act_time")).join(nodes.select("cascade_id", "user_id"), ["cascade_id", "user_id"], "left_anti")
    return nodes.unionByName(alone.withColumn("parent_id", F.lit(None).cast(nodes.schema["parent_id"].dataType)))


def with_depth(nodes: DataFrame) -> DataFrame:
    """nodes and their depth, by doubling the length of the jump towards the root: rounds grow with the logarithm of the depth."""
    now = nodes.withColumns({"__up": F.col("parent_id"), "depth": F.when(F.col("parent_id").isNull(), 0).otherwise(1)})
    while True:
        now = settled(now)
        if now.where("__up is not null").isEmpty():
            return now.drop("__up")
        above = now.select("cascade_id", F.col("user_id").alias("__up"), F.col("__up").alias("__top"), F.col("depth").alias("__more"))
        now = now.join(above, ["cascade_id", "__up"], "left").select(*nodes.columns, F.col("__top").alias("__up"), (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth"))


def trees(reshares: DataFrame, pc: DataFrame) -> DataFrame:
    """Nodes of the trees of all cascades."""
    return with_depth(first_touch(cascade_reshares(reshares, pc), pc))


def truncated(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.where(F.col("depth") <= depth)


def edges(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """cascade_id, src, dst; of children down to max_depth if given."""
    e = nodes.where("parent_id is not null")
    if max_depth is not None:
        e = e.where(F.col("depth") <= max_depth)
    return e.select("cascade_id", F.col("parent_id").alias("src"), F.col("user_id").alias("dst"))


def leaves(nodes: DataFrame) -> DataFrame:
    inner = nodes.select("cascade_id", F.col("parent_id").alias("user_id")).where("user_id is not null").distinct()
    return nodes.join(inner, ["cascade_id", "user_id"], "left_anti")


def summary(nodes: DataFrame) -> DataFrame:
    """cascade_id, size, height, n_roots and n_leaves."""
    by = nodes.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("size"), F.max("depth").alias("height"), F.count_if(F.col("parent_id").isNull()).alias("n_roots"))
    return by.join(leaves(nodes).groupBy("cascade_id").agg(F.count(F.lit(1)).alias("n_leaves")), "cascade_id")


def at_depth(nodes: DataFrame) -> DataFrame:
    """cascade_id, depth and the number of nodes there."""
    return nodes.groupBy("cascade_id", "depth").agg(F.count(F.lit(1)).alias("n"))


def to_reshares(nodes: DataFrame) -> DataFrame:
    """The inverse: a post per node, a reshare per edge."""
    parent = nodes.select("cascade_id", F.col("user_id").alias("ref_user_id"), F.col("act_time").alias("ref_datetime"))
    child = nodes.where("parent_id is not null").select("cascade_id", "user_id", F.col("parent_id").alias("ref_user_id"), F.col("act_time").alias("datetime"))
    post = lambda user: F.concat_ws("/", "cascade_id", F.col(user).cast("string"))
    return child.join(parent, ["cascade_id", "ref_user_id"]).select(post("user_id").alias("post_id"), post("ref_user_id").alias("reshared_post_id"), "cascade_id", "user_id", "ref_user_id", "datetime", "ref_datetime")


def with_edges(nodes: DataFrame) -> DataFrame:
    """nodes of the cascades that have an edge."""
    return nodes.join(nodes.where("parent_id is not null").select("cascade_id").distinct(), "cascade_id", "left_semi")


def pruned(nodes: DataFrame, drop: DataFrame) -> DataFrame:
    """nodes without the users of drop (user_id) and all that hangs below them."""
    marked = nodes.join(drop.select("user_id", F.lit(True).alias("__gone")).distinct(), "user_id", "left")
    # up: the nearest ancestor not looked at yet; gone: whether one up to there is dropped
    now = marked.select(*nodes.columns, F.coalesce("__gone", F.lit(False)).alias("__gone"), F.col("parent_id").alias("__up"))
    while True:
        now = settled(now)
        if now.where("__up is not null and not __gone").isEmpty():
            return now.where("not __gone").select(*nodes.columns)
        above = now.select("cascade_id", F.col("user_id").alias("__up"), F.col("__up").alias("__top"), F.col("__gone").alias("__lost"))
        now = now.join(above, ["cascade_id", "__up"], "left").select(*nodes.columns, (F.col("__gone") | F.coalesce("__lost", F.lit(False))).alias("__gone"), F.col("__top").alias("__up"))


def reply_cascades(tweets: DataFrame) -> DataFrame:
    """tweet_id, cascade_id for tweets (tweet_id, user_id, datetime, reply_to_id) in the order of time.

    A reply whose parent has a cascade joins it only if its user is new there; any other reply to a known tweet opens a cascade of two. Within
    a component of replies the order matters, so each component is walked by itself; components never meet.
    """
    import pandas as pd

    root = _components_of_replies(tweets)

    def walk(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["datetime", "tweet_id"], kind="stable")
        user = dict(zip(df["tweet_id"], df["user_id"], strict=True))
        owner: dict[int, int] = {}
        members: dict[int, set] = {}
        out = []
        for tweet, who, up in zip(df["tweet_id"], df["user_id"], df["reply_to_id"], strict=True):
            if pd.isna(up) or up not in user or up == tweet:
                continue
            up = int(up)
            cascade = owner.get(up)
            if cascade is not None:
                if who not in members[cascade]:
                    members[cascade].add(who)
                    owner[tweet] = cascade
                    out.append((tweet, cascade, up))
            elif who != user[up]:
                owner[up] = owner[tweet] = up
                members[up] = {user[up], who}
                out += [(up, up, None), (tweet, up, up)]
        return pd.DataFrame(out, columns=["tweet_id", "cascade_id", "reply_to_id"]).astype("Int64")

    return root.groupBy("root").applyInPandas(walk, "tweet_id long, cascade_id long, reply_to_id long")


def _components_of_replies(tweets: DataFrame) -> DataFrame:
    """tweets and the root of their chain of replies: each tweet replies to one other at most, so jumps double upwards."""
    known = tweets.select(F.col("tweet_id").alias("reply_to_id"), F.lit(True).alias("__known"))
    now = tweets.join(known, "reply_to_id", "left").select(*tweets.columns, F.when(F.col("__known"), F.col("reply_to_id")).alias("__up"), F.col("tweet_id").alias("root"))
    now = now.withColumn("root", F.coalesce("__up", "root"))
    while True:
        now = settled(now)
        above = now.select(F.col("tweet_id").alias("root"), F.col("root").alias("__top"))
        nxt = now.join(above, "root").withColumn("__moved", F.col("__top") != F.col("root")).select(*tweets.columns, F.col("__up"), F.col("__top").alias("root"), "__moved")
        nxt = settled(nxt)
        if nxt.where("__moved").isEmpty():
            return nxt.drop("__up", "__moved")
        now = nxt.drop("__moved")


def first_per_author(pc: DataFrame) -> DataFrame:
    """The first post of each author in each cascade."""
    w = Window.partitionBy("cascade_id", "author_id").orderBy("datetime", "post_id")
    return pc.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

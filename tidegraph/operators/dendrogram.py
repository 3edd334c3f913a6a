"""Agglomeration of a weighted graph by reciprocal nearest neighbours, in rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.sampling import numbered
from tidegraph.plans.loops import written

#: Name of the tables between rounds. They are written, not checkpointed: a checkpoint keeps the estimated size of its plan, and estimates of joins multiply from round to round.
NAME = "dendrogram"

#: Similarities are counted in units of 2^-30, so that sums of weights are exact in any order.
UNIT = 1 << 30

_MERGE = "a {id}, b {id}, distance double, size long, round int"


def _kept(df: DataFrame) -> DataFrame:
    return written(df, NAME)


def merges(pairs: DataFrame) -> DataFrame:
    """a, b, distance, size, round: the dendrogram of pairs (i, j, sim), a row for each merge.

    A cluster goes by its smallest id; b is taken into a, and size is that of both. The distance of two clusters is w_a w_b / w_ab W: weights of all pairs between them
    (w_ab), of all pairs of either (w_a, w_b) and of all ids (W). A merge never brings a third cluster nearer than the nearer of the two was, so all pairs of clusters that are
    nearest to each other can merge in one round, and the rows by distance are those of merging the nearest pair time after time. Equal distances: smaller ids first.

    Pairs with equal or null ids, and with a null similarity or one under half a unit, are left out; repeated pairs add up. Clusters without a pair between them stay
    apart. A round reads the pairs that are left and joins them with the merges of the round; a hub that all others are nearest to takes in one of them in each round.
    """
    kind = pairs.schema["i"].dataType.simpleString()
    once = pairs.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.round(F.col("sim") * UNIT).cast("decimal(38,0)").alias("w"))
    once = _kept(once.where("w > 0").groupBy("a", "b").agg(F.sum("w").cast("decimal(38,0)").alias("w")))
    ends = once.select(F.col("a").alias("c"), "w").union(once.select("b", "w"))
    weight = ends.groupBy("c").agg(F.sum("w").cast("decimal(38,0)").alias("weight"))
    total = weight.agg(F.coalesce(F.sum("weight").cast("double"), F.lit(1.0)).alias("t")).first()["t"]
    one = F.lit(1).cast("long")
    now = once.join(weight.select(F.col("c").alias("a"), F.col("weight").alias("wa")), "a").join(weight.select(F.col("c").alias("b"), F.col("weight").alias("wb")), "b")
    now = _kept(now.select("a", "b", "w", "wa", "wb", one.alias("sa"), one.alias("sb")))
    done: list[DataFrame] = []
    while True:
        distance = F.col("wa").cast("double") * F.col("wb").cast("double") / F.col("w").cast("double") / F.lit(total)
        rank = F.struct(distance.alias("distance"), "a", "b", (F.col("sa") + F.col("sb")).alias("size"), (F.col("wa") + F.col("wb")).cast("decimal(38,0)").alias("weight"))
        wishes = now.select(F.explode(F.array("a", "b")).alias("c"), rank.alias("best")).groupBy("c").agg(F.min("best").alias("best")).select("best.*")
        both = _kept(wishes.groupBy("a", "b", "distance", "size", "weight").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n"))
        if both.isEmpty():
            break
        done.append(both.select("a", "b", "distance", "size", F.lit(len(done)).alias("round")))
        moved = both.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("to"), "weight", "size")
        x = moved.select(F.col("old").alias("a"), F.col("to").alias("a_"), F.col("weight").alias("wa_"), F.col("size").alias("sa_"))
        y = moved.select(F.col("old").alias("b"), F.col("to").alias("b_"), F.col("weight").alias("wb_"), F.col("size").alias("sb_"))
        left = F.struct(F.coalesce("a_", "a").alias("c"), F.coalesce("wa_", "wa").alias("w"), F.coalesce("sa_", "sa").alias("s")).alias("l")
        right = F.struct(F.coalesce("b_", "b").alias("c"), F.coalesce("wb_", "wb").alias("w"), F.coalesce("sb_", "sb").alias("s")).alias("r")
        renamed = now.join(x, "a", "left").join(y, "b", "left").select("w", left, right).where("l.c <> r.c")
        first, last = F.least("l", "r"), F.greatest("l", "r")  # structs compare by their first field, the id
        summed = renamed.groupBy(first.alias("l"), last.alias("r")).agg(F.sum("w").cast("decimal(38,0)").alias("w"))
        now = _kept(summed.select(F.col("l.c").alias("a"), F.col("r.c").alias("b"), "w", F.col("l.w").alias("wa"), F.col("r.w").alias("wb"), F.col("l.s").alias("sa"), F.col("r.s").alias("sb")))
    empty = pairs.sparkSession.createDataFrame([], _MERGE.format(id=kind))
    return reduce(DataFrame.unionByName, done, empty)


def roots(up: DataFrame) -> DataFrame:
    """b, a: for each b of a forest of rows (b, a), a the parent of b, its root. Rounds grow with the logarithm of the depth."""
    up = _kept(up.select("b", "a"))
    while True:
        over = up.select(F.col("b").alias("a"), F.col("a").alias("top"))
        jumped = _kept(up.join(over, "a", "left").select("b", F.coalesce("top", "a").alias("a"), F.col("top").isNotNull().alias("moved")))
        up = jumped.select("b", "a")
        if jumped.where("moved").isEmpty():
            return up


def cut(dendrogram: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """cascade_id, label (0 ..): the k clusters after all merges but the last by distance, numbered by their smallest id.

    With fewer than k ids each is a cluster. If more than k clusters have no pair between them, the first of them by id count as one, as many as leave k.
    """
    ids = ids.select("cascade_id").distinct()
    need = max(0, ids.count() - k)
    kept = numbered(dendrogram, "place", "distance", "round", "a").where(F.col("place") <= need)
    top = roots(kept)
    named = _kept(ids.join(top.withColumnRenamed("b", "cascade_id"), "cascade_id", "left").select("cascade_id", F.coalesce("a", "cascade_id").alias("root")))
    places = _kept(numbered(named.select("root").distinct(), "place", "root"))
    over = max(0, places.count() - k)
    return named.join(places, "root").select("cascade_id", F.greatest(F.col("place") - 1 - over, F.lit(0)).cast("int").alias("label"))

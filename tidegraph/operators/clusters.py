"""Similarity of cascades by their users, and clusters of cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.sampling import numbered, shuffled
from tidegraph.plans.loops import settled, written


def jaccard_pairs(act: DataFrame) -> DataFrame:
    """i < j, sim > 0: pairs of cascades by shared users. The join is on users; pairs without one are implicit zeros."""
    size = act.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("n"))
    a = act.select(F.col("cascade_id").alias("i"), "user_id")
    b = act.select(F.col("cascade_id").alias("j"), "user_id")
    both = a.join(b, "user_id").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("both"))
    x, y = size.selectExpr("cascade_id i", "n n_i"), size.selectExpr("cascade_id j", "n n_j")
    return both.join(x, "i").join(y, "j").select("i", "j", (F.col("both") / (F.col("n_i") + F.col("n_j") - F.col("both"))).alias("sim"))


def connected(pairs: DataFrame, ids: DataFrame, least: float) -> DataFrame:
    """cascade_id, label: the smallest id reachable over pairs of at least that similarity."""
    edges = pairs.where(F.col("sim") >= least).select("i", "j")
    both = settled(edges.union(edges.select("j", "i")))
    now = settled(ids.select("cascade_id", F.col("cascade_id").alias("label")))
    while True:
        near = both.join(now, both["j"] == now["cascade_id"]).groupBy("i").agg(F.min("label").alias("other"))
        nxt = settled(now.join(near, now["cascade_id"] == near["i"], "left").select("cascade_id", F.least("label", F.coalesce("other", "label")).alias("label"), (F.col("other") < F.col("label")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        now = nxt.drop("moved")


def density_cores(pairs: DataFrame, ids: DataFrame, eps: float = 0.001, min_points: int = 5) -> DataFrame:
    """cascade_id, neighbours, core. As in the data sets' use of it the similarity takes the place of a distance: neighbours have sim <= eps, implicit zeros and the
    cascade itself included. So each cascade's number of neighbours follows from its pairs over eps, without the zeros being made."""
    n = ids.count()
    far = pairs.where(F.col("sim") > eps)
    count = far.select("i").union(far.select("j")).groupBy(F.col("i").alias("cascade_id")).agg(F.count(F.lit(1)).alias("far"))
    return ids.join(count, "cascade_id", "left").select("cascade_id", (n - F.coalesce("far", F.lit(0))).alias("neighbours")).withColumn("core", F.col("neighbours") >= min_points)


def _nearest_label(far: DataFrame, labels: DataFrame) -> DataFrame:
    """i, best: for each i of far (i, j) that is far from all members of the first labels, the first label (1 ..) with a member that is not; other i are near label 1.

    labels: cascade_id, label. A label is excluded for i if as many of its members are far from i as it has; the first that is not is the first gap in the excluded ones.
    """
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    hits = far.join(labels.select(F.col("cascade_id").alias("j"), "label"), "j").groupBy("i", "label").agg(F.count(F.lit(1)).alias("n"))
    excluded = hits.join(size, "label").where("n = members")
    place = F.row_number().over(Window.partitionBy("i").orderBy("label"))
    return excluded.withColumn("place", place).where("label = place").groupBy("i").agg((F.max("label") + 1).alias("best"))


def near_components(far: DataFrame, ids: DataFrame) -> DataFrame:
    """cascade_id, label (1 ..): components of the graph in which all pairs are linked but those of far (i, j in both directions), numbered by their smallest id.

    Links are not made. In each round a component is hooked to the first one that it is linked with, which follows from counting the pairs that are far; the
    components that remain are numbered anew. Rounds grow with the logarithm of the number of ids.
    """
    now = settled(numbered(ids.select("cascade_id"), "label", "cascade_id"))
    while True:
        best = now.join(_nearest_label(far, now), now["cascade_id"] == F.col("i"), "left").groupBy("label").agg(F.min(F.coalesce("best", F.lit(1))).alias("to"))
        up = settled(best.select("label", F.least("label", "to").alias("to")))
        if up.where("to < label").isEmpty():
            return now
        while True:  # chains of hooks
            over = up.select(F.col("label").alias("to"), F.col("to").alias("top"))
            far_up = settled(up.join(over, "to").select("label", F.col("top").alias("to"), (F.col("top") < F.col("to")).alias("moved")))
            up = far_up.select("label", "to")
            if far_up.where("moved").isEmpty():
                break
        tops = numbered(up.select("to").distinct(), "number", "to")
        now = settled(now.join(up.join(tops, "to"), "label").select("cascade_id", F.col("number").alias("label")))


def dbscan(pairs: DataFrame, ids: DataFrame, eps: float = 0.001, min_points: int = 5) -> DataFrame:
    """cascade_id, core, label: density clusters with similarity as distance (see density_cores). Linked cores share a label, from 0 by the smallest id of their cores;
    other cascades get the first label that has a core next to them, or -1."""
    known = settled(density_cores(pairs, ids, eps, min_points))
    cores = known.where("core").select("cascade_id")
    off = pairs.where(F.col("sim") > eps)
    far = off.select("i", "j").union(off.select(F.col("j").alias("i"), F.col("i").alias("j")))
    far = settled(far.join(cores.select(F.col("cascade_id").alias("j")), "j", "left_semi").select("i", "j"))
    labels = near_components(settled(far.join(cores.select(F.col("cascade_id").alias("i")), "i", "left_semi").select("i", "j")), cores)
    many = labels.agg(F.coalesce(F.max("label"), F.lit(0)).alias("m")).first()["m"]
    rest = known.where("not core").join(_nearest_label(far, labels), known["cascade_id"] == F.col("i"), "left").withColumn("best", F.coalesce("best", F.lit(1)))
    border = rest.select("cascade_id", "core", F.when(F.col("best") <= many, F.col("best") - 1).otherwise(-1).cast("int").alias("label"))
    return known.where("core").join(labels, "cascade_id").select("cascade_id", "core", (F.col("label") - 1).cast("int").alias("label")).unionByName(border)


def within_means(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n, mean_sim over the pairs inside, zeros included."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a, b = labels.selectExpr("cascade_id i", "label"), labels.selectExpr("cascade_id j", "label label_j")
    total = pairs.join(a, "i").join(b, "j").where("label = label_j").groupBy("label").agg(F.sum("sim").alias("s"))
    return size.join(total, "label", "left").select("label", "n", F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("mean_sim"))


def cluster_error(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The Frobenius distance of the similarities from the matrix that is 1 inside clusters, zeros included."""
    a, b = labels.selectExpr("cascade_id i", "label"), labels.selectExpr("cascade_id j", "label label_j")
    same = F.when(F.col("label") == F.col("label_j"), 1.0).otherwise(0.0)
    seen = pairs.join(a, "i").join(b, "j").agg(F.sum(F.pow(F.col("sim") - same, 2)).alias("s"), F.sum(same).alias("k"))
    inside = labels.groupBy("label").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("m"))
    return seen.crossJoin(inside).select(F.sqrt(2 * (F.coalesce("s", F.lit(0.0)) + F.col("m") - F.coalesce("k", F.lit(0.0)))).alias("error"))  # a row each


def heat_map(pairs: DataFrame, ids: DataFrame, cells: int = 1000) -> DataFrame:
    """Row, column and sum of similarity of the matrix binned to at most cells by cells."""
    place = numbered(ids.select("cascade_id"), "p", "cascade_id").withColumn("p", F.col("p") - 1)
    n = ids.count()
    step = max(1, -(-n // cells))
    x, y = place.selectExpr("cascade_id i", "p p_i"), place.selectExpr("cascade_id j", "p p_j")
    return pairs.join(x, "i").join(y, "j").groupBy((F.col("p_i") / step).cast("int").alias("row"), (F.col("p_j") / step).cast("int").alias("col")).agg(F.sum("sim").alias("sim"))


def kmeans(vectors: DataFrame, k: int = 20, seed: int = 0, iterations: int = 20) -> DataFrame:
    """id, label for rows (id, features array)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("id", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(data)
    return model.transform(data).select("id", F.col("prediction").alias("label"))


def user_means(act: DataFrame, k: int = 20, rounds: int = 20, seed: int = 0) -> DataFrame:
    """cascade_id, label (0 ..), distance: k-means of the rows of the cascade-user matrix, which is 1 where a user took part and is never made.

    The first means are k cascades in the order of shuffled(seed). A mean is kept as its cascades' count n and its users' counts s, whole numbers, so that the squared
    distance of a cascade with m users is m + (sum of s^2 - 2 n (sum of s over its users)) / n^2. A round is one join on users, in which a user has a row for each mean
    it counts in; the nearest of the means that share no user with a cascade is never nearer than the mean of least length, which stands in for all of them. Equal
    distances: the smaller label. A mean without cascades goes. Rounds end when no label changes, or after ``rounds``. Rows with a null are left out, repeated ones count once.
    """
    x = written(act.select("cascade_id", "user_id").where("cascade_id is not null and user_id is not null").distinct(), "matrix")
    sizes = x.groupBy("cascade_id").agg(F.count(F.lit(1)).alias("m"))
    now = written(shuffled(x, seed).where(F.col("place") <= k).select("cascade_id", (F.col("place") - 1).cast("int").alias("label"), F.lit(0.0).alias("distance")), "labels")
    for _ in range(rounds + 1):  # the first assigns to single cascades
        counts = written(x.join(now, "cascade_id").groupBy("label", "user_id").agg(F.count(F.lit(1)).alias("s")), "means")
        means = now.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(counts.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q")), "label")
        means = written(means, "means")  # k rows
        length = F.col("q").cast("double") / (F.col("n") * F.col("n")).cast("double")
        least = means.agg(F.min(F.struct(length.alias("part"), "label")).alias("best"))
        shared = x.join(counts, "user_id").groupBy("cascade_id", "label").agg(F.sum("s").alias("dot"))
        part = (F.col("q") - 2 * F.col("dot") * F.col("n")).cast("double") / (F.col("n") * F.col("n")).cast("double")
        near = shared.join(F.broadcast(means), "label").groupBy("cascade_id").agg(F.min(F.struct(part.alias("part"), "label")).alias("near"))
        best = sizes.join(near, "cascade_id", "left").crossJoin(F.broadcast(least)).withColumn("to", F.least("near", "best"))  # least: one row
        before = now.select("cascade_id", F.col("label").alias("was"))
        moved = best.join(before, "cascade_id", "left").select("cascade_id", F.col("to.label").alias("label"), (F.col("m") + F.col("to.part")).alias("distance"), F.coalesce(F.col("was") != F.col("to.label"), F.lit(True)).alias("moved"))
        moved = written(moved, "labels")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return now

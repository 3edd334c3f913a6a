"""A Markov random field of all users over two time slices, fitted by gradient ascent with joint Gibbs samples.

A user i is active before (slice 0) and after (slice 1) a step; who was active stays so. The field's weight of a state is exp of the sum, over users i that have
sources, of S1(i) times (w(i,i) S0(i) + the sum over sources u of w(u,i) S0(u)). So the two slices are the two colours of the field's graph: given one slice, all users
of the other are independent, and a sweep resamples each slice by one join over the edges and one sum, sources and receivers alike.

Chains are bits: a BIGINT of a user holds its state in 64 chains, and there is a row (word) for each 64 chains. Random numbers are hashes of seed, sweep, slice, user, word and chain,
so a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.features import parent_index
from tidegraph.operators.sequences import at_receivers
from tidegraph.plans import ascent, frontier
from tidegraph.plans.loops import gathered, written

#: Chains in a word.
BITS = 64


def transitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cascade_id, v, depth, seen (positions of sources active down to that depth), d, state: whether v acts at the next depth. Steps end when v acts."""
    idx = parent_index(edges)
    src = nodes.select("cascade_id", F.col("user_id").alias("u"), "depth")
    own = nodes.select("cascade_id", F.col("user_id").alias("v"), F.col("depth").alias("own"))
    seen = src.join(idx, "u").join(own, ["cascade_id", "v"], "left").where("own is null or depth < own")
    step = seen.groupBy("cascade_id", "v", "depth").agg(F.collect_list("pos").alias("active"), F.first("d").alias("d"), F.first("own").alias("own"))
    w = Window.partitionBy("cascade_id", "v").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return step.select("cascade_id", "v", "depth", F.array_sort(F.array_distinct(F.flatten(F.collect_list("active").over(w)))).alias("seen"), "d", F.coalesce(F.col("own") == F.col("depth") + 1, F.lit(False)).cast("int").alias("state"))


def feature_sums(steps: DataFrame) -> DataFrame:
    """v, pos, n, n_active: steps in which the source has acted, and those of them after which v acts."""
    return steps.select("v", "state", F.explode("seen").alias("pos")).groupBy("v", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("state").alias("n_active"))


def field_edges(edges: DataFrame) -> DataFrame:
    """u, v, pos: sources of each user by position, and each user that has sources as its own source at position 0."""
    idx = parent_index(edges)
    return idx.select("u", "v", "pos").unionByName(idx.select("v").distinct().select(F.col("v").alias("u"), "v", F.lit(0).alias("pos")))


def joint_sums(nodes: DataFrame, field: DataFrame) -> DataFrame:
    """u, v, pos, c: steps between levels of all cascades in which u is active before and v after. Of a cascade of depth d these are the steps from the level of u, or the one above v, on: they are counted, not made."""
    deep = nodes.groupBy("cascade_id").agg(F.max("depth").alias("deepest")).withColumn("c", F.monotonically_increasing_id())
    left = nodes.join(written(deep, "codes"), "cascade_id").select("c", "user_id", (F.col("deepest") - F.col("depth")).alias("left"))
    a = left.where("left > 0").select("c", F.col("user_id").alias("u"), F.col("left").alias("left_u"))
    b = gathered(left.select("c", F.col("user_id").alias("v"), F.col("left").alias("left_v")), "v")
    both = at_receivers(a, field.select("u", "v")).join(b.hint("shuffle_hash"), ["c", "v"])
    found = both.groupBy("u", "v").agg(F.sum(F.least(F.col("left_u"), F.col("left_v") + 1)).alias("c"))
    return field.join(found, ["u", "v"], "left").select("u", "v", "pos", F.coalesce("c", F.lit(0)).cast("double").alias("c"))


def n_steps(nodes: DataFrame) -> int:
    """Steps between levels of all cascades."""
    return nodes.groupBy("cascade_id").agg(F.max("depth").alias("d")).agg(F.sum("d").alias("n")).first()["n"] or 0


def no_states(edges: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The start of both slices: nobody is active. (u, word, round, s0) of all users, (v, word, s1) of those with sources."""
    users = edges.select(F.col("src").alias("u")).union(edges.select("dst")).distinct()
    word = F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word")
    zero = F.lit(0).cast("long")
    return users.select("u", word).select("u", "word", F.lit(0).alias("round"), zero.alias("s0")), edges.select(F.col("dst").alias("v")).distinct().select("v", word).select("v", "word", zero.alias("s1"))


def _drawn(slice_: int, seed: int) -> str:
    """SQL of the bits that come up in each chain of a word, from id, word, round and z0 to z63, the field at the user in each chain."""
    fields = ", ".join(f"z{k}" for k in range(BITS))
    number = f"pmod(xxhash64({seed}, {slice_}, round, id, word, k), 9007199254740992L) / 9007199254740992D"
    return f"aggregate(transform(array({fields}), (z, k) -> if({number} < 1D / (1D + exp(-z)), shiftleft(1L, k), 0L)), 0L, (a, b) -> a | b)"


def _fields(state: str, weight: str = "weight") -> list:
    return [F.expr(f"sum(if(getbit({state}, {k}) = 1, {weight}, 0D))").alias(f"z{k}") for k in range(BITS)]


def after(field: DataFrame, s0: DataFrame, seed: int = 0) -> DataFrame:
    """v, word, round, s1: the second slice drawn from the first. field: u, v, weight, the weights of users themselves included. Who was active stays so."""
    own = F.max(F.when(F.col("u") == F.col("v"), F.col("s0"))).alias("own")
    z = field.join(s0, "u").groupBy(F.col("v").alias("id"), "word", "round").agg(*_fields("s0"), own)
    return z.select(F.col("id").alias("v"), "word", "round", F.expr(f"coalesce(own, 0L) | {_drawn(1, seed)}").alias("s1"))


def before(field: DataFrame, s1: DataFrame, seed: int = 0) -> DataFrame:
    """u, word, round, s0: the first slice drawn from the second, by the weights of a user's receivers; round is one more. Who has sources and is inactive after was so before."""
    own = F.coalesce(F.max(F.when(F.col("u") == F.col("v"), F.col("s1"))), F.lit(-1).cast("long")).alias("own")
    z = field.join(s1, "v").groupBy(F.col("u").alias("id"), "word", "round").agg(*_fields("s1"), own)
    return z.select(F.col("id").alias("u"), "word", (F.col("round") + 1).alias("round"), F.expr(f"own & ({_drawn(0, seed)})").alias("s0"))


def expectations(field: DataFrame, s0: DataFrame, s1: DataFrame) -> DataFrame:
    """u, v, e: the share of chains in which u is active before and v after."""
    both = field.select("u", "v").join(s0.select("u", "word", "s0"), "u").join(s1.select("v", "word", "s1"), ["v", "word"])
    return both.groupBy("u", "v").agg((F.sum(F.bit_count(F.col("s0").bitwiseAND(F.col("s1")))) / (F.count(F.lit(1)) * BITS)).alias("e"))


def sampled(field: DataFrame, edges: DataFrame, sweeps: int, words: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both slices of the field after so many sweeps from the state in which nobody is active."""
    s0, s1 = no_states(edges, words)
    for _ in range(sweeps):
        s1 = written(after(field, s0, seed), "after")
        s0 = written(before(field, s1, seed), "before")
    return s0, written(after(field, s0, seed), "after") if sweeps else s1


def fit(nodes: DataFrame, edges: DataFrame, iterations: int = 50, eta: float = 0.01, eps: float = 1e-6, chains: int = 64, burn: int = 3, seed: int = 0) -> DataFrame:
    """v, pos (0: v's own state before), weight: gradient ascent from weights of 1 on the likelihood of all steps between levels.

    The gradient is the sum of observed features less as many expected ones. Chains go on from one iteration to the next, a sweep each, after ``burn`` sweeps (chains: rounded up to
    words of 64). Ends when no user's weights move by eps. Weights of users without a source do not exist.
    """
    return ascent.weights(joint_sums(nodes, field_edges(edges)), n_steps(nodes), iterations, eta, eps, -(-chains // BITS), burn, seed)


def chances(steps: DataFrame, models: DataFrame) -> DataFrame:
    """steps with p = sigma of the weights of the sources that have acted."""
    m = models.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("pos", "weight"))).alias("w"))
    z = F.aggregate("seen", F.lit(0.0), lambda x, p: x + F.coalesce(F.element_at("w", p.cast("int")), F.lit(0.0)))
    return steps.join(m, "v").withColumn("p", 1 / (1 + F.exp(-z))).drop("w")


def predict(initial: DataFrame, edges: DataFrame, models: DataFrame, thresholds: list[float], max_step: int | None = None) -> DataFrame:
    """threshold, cascade_id, user_id, parent_id, depth, probability: a user joins with sigma of the weights of all its active sources, the whole given tree included,
    and follows the newly active one of the largest weight."""
    return frontier.expand(initial, edges, written(frontier.dense(models), "models"), frontier.mrf_judge(), thresholds, max_step, whole=True)

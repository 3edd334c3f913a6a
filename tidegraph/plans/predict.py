"""Prediction of the rest of a cascade by frontier expansion, all cascades and thresholds at once.

The result is rows (threshold, cascade_id, user_id, parent_id, act_time, depth, probability). Each round sends what users of the frontier are in along
their edges as lists, to buckets of receivers, which tell who joins; it ends when no frontier grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegraph.functions.scalar import received
from tidegraph.operators.sampling import numbered
from tidegraph.plans.loops import FEW, Grown, written
from tidegraph.plans.receivers import _flat as flat

STATE = ["threshold", "cascade_id", "user_id", "parent_id", "act_time", "depth", "probability"]


def _start(initial: DataFrame, thresholds: list[float], by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    spark = initial.sparkSession
    thr = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    nodes = initial.withColumn("probability", F.lit(None).cast("double"))
    nodes = (nodes if "threshold" in initial.columns else nodes.crossJoin(F.broadcast(thr))).select(*by, *STATE)  # few thresholds
    deepest = nodes.join(nodes.groupBy(*by, "threshold", "cascade_id").agg(F.max("depth").alias("depth")), [*by, "threshold", "cascade_id", "depth"], "left_semi").select(*by, *STATE)
    return nodes, deepest


def _earliest(given: pa.Table, known: pa.Table, by: list[str], kind: pa.Schema) -> pa.Table:
    """A round of ic for the receivers of a bucket. given: edges with lists of what their sources newly are in; known: lists of what receivers are active in. by: columns that make a group with v."""
    if not len(given):
        return kind.empty_table()
    (c, edge), (old, row) = flat(given, "c"), flat(known, "c")
    part = pa.concat_tables([given.select(by), known.select(by)])
    group = np.zeros(len(part), np.int64)
    for name in by:
        told = part[name].combine_chunks().dictionary_encode()
        group = np.unique(group * (len(told.dictionary) + 1) + pc.fill_null(told.indices, len(told.dictionary)).to_numpy(), return_inverse=True)[1]
    key = group[edge] * CASCADES + c
    keep = np.flatnonzero(~np.isin(key, group[len(given) + row] * CASCADES + old))
    time, depth = given["t"].combine_chunks().flatten(), given["depth"].combine_chunks().flatten()
    order = keep[np.lexsort((given["k"].to_numpy()[edge[keep]], _rank(given["u"])[edge[keep]], _rank(time)[keep], key[keep]))]
    if not len(order):
        return kind.empty_table()
    first = order[np.append(True, key[order][1:] != key[order][:-1])]
    of = group[edge[first]]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    source = pa.array(edge[first])
    names = kind.field("x").type.value_type
    parts = [pa.array(key[first] % CASCADES), time.take(pa.array(first)), depth.take(pa.array(first)), given["u"].take(source), given["k"].take(source), given["r"].take(source)]
    parts = [(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(f.type) for x, f in zip(parts, names, strict=True)]
    ends = pa.array(np.append(begin, len(first)), pa.int32())
    columns = [given[c].take(pa.array(edge[first[begin]])) for c in by] + [pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(names)))]
    return pa.table([x.cast(f.type) if x.type != f.type else x for x, f in zip(columns, kind, strict=True)], schema=kind)


def ic(initial: DataFrame, par: DataFrame, thresholds: list[float], max_step: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """par: u, v, k and, if known, r. A user joins at the first user of the frontier, in time, whose k reaches the threshold, and takes it as parent.

    by: columns of initial that keep cases apart (fold, method, depth given and so on); those that par has too choose the parameters. All cases go through one loop. A
    column threshold of initial takes the place of thresholds. An edge is a row with a list of the cascades (up to CASCADES) that its source newly is in; a receiver's row has a list of
    those that it joins, which are written once and sent as lists to what they and others are asked about later.
    """
    spark = initial.sparkSession
    shared = [c for c in by if c in par.columns]
    rate = F.col("r") if "r" in par.columns else F.lit(0.0)
    codes = written(numbered(initial.select("cascade_id").distinct(), "n", "cascade_id").select("cascade_id", F.expr(f"(n - 1) div {CASCADES}").alias("chunk"), ((F.col("n") - 1) % CASCADES).cast("short").alias("c")), "codes")
    nodes, deepest = (x.join(codes, "cascade_id") for x in _start(initial, thresholds, by))
    place, time, user, depth = [*by, "threshold", "chunk"], initial.schema["act_time"].dataType, initial.schema["user_id"].dataType, initial.schema["depth"].dataType
    start = written(nodes.groupBy(*place, F.col("user_id").alias("v")).agg(F.collect_list("c").alias("c")), "start")
    acts = deepest.groupBy(*place, F.col("user_id").alias("u")).agg(F.collect_list(F.struct("c", F.col("act_time").alias("t"), "depth")).alias("x"))
    acts = written(acts.select(*place, "u", *[F.col(f"x.{c}").alias(c) for c in ("c", "t", "depth")]), "front")
    n_front = acts.count()
    least = start.agg(F.min("threshold")).first()[0]  # no case has a use for the other edges
    p = written(par.select(*shared, "u", "v", "k", rate.alias("r")).where(F.col("k") >= F.lit(least)), "edges")
    out = written(p.groupBy(*shared, "u").agg(F.count(F.lit(1)).alias("n")), "targets")
    entry = T.StructType().add("c", T.ShortType()).add("t", time).add("depth", depth).add("u", user).add("k", p.schema["k"].dataType).add("r", p.schema["r"].dataType)
    shape = T.StructType([*(start.schema[c] for c in place), T.StructField("v", user), T.StructField("x", T.ArrayType(entry))])
    tree, step, key = Grown(spark, "tree"), 0, [*place, "v"]
    kind = to_arrow_schema(shape)

    def run(given: pa.Table, known: pa.Table) -> pa.Table:
        return _earliest(given, known, key, kind)

    while (max_step is None or step < max_step) and n_front:
        entries = acts.join(out, [*shared, "u"]).agg(F.sum(F.size("c") * F.col("n"))).first()[0] or 0
        if not entries:
            break
        many = max(-(-entries // TARGET), 2 * spark.sparkContext.defaultParallelism)
        bucket = F.pmod(F.xxhash64(*key), F.lit(many)).alias("bucket")
        given = acts.join(p, [*shared, "u"]).where("k >= threshold").select(bucket, *key, "u", "k", "r", "c", "t", "depth")
        known = start if not step else start.unionByName(tree.whole().select(*key, F.col("x.c").alias("c")))
        if n_front < FEW:
            known = known.join(F.broadcast(given.select(*key).distinct()), key, "left_semi")  # few receivers
        found = given.repartition(many, "bucket").groupBy("bucket").cogroup(known.select(bucket, *key, "c").repartition(many, "bucket").groupBy("bucket")).applyInArrow(run, shape)
        front, n_front = tree.add(found)
        when = F.transform("x", lambda x: received(x["t"], x["r"]).cast(time))
        acts = front.select(*place, F.col("v").alias("u"), F.col("x.c").alias("c"), when.alias("t"), F.transform("x", lambda x: (x["depth"] + 1).cast(depth)).alias("depth"))
        step += 1
    if not tree.rounds:
        return written(nodes.select(*by, *STATE), "tree")
    each = tree.whole().select(*place, F.col("v").alias("user_id"), F.explode("x").alias("x")).withColumn("c", F.col("x.c")).join(codes, ["chunk", "c"])
    joined = each.select(*by, "threshold", "cascade_id", "user_id", F.col("x.u").alias("parent_id"), received(F.col("x.t"), F.col("x.r")).cast(time).alias("act_time"), (F.col("x.depth") + 1).cast(depth).alias("depth"), F.col("x.k").alias("probability"))
    return written(nodes.select(*by, *STATE).unionByName(joined), "tree")


#: Cascades of a list of ic, at most.
CASCADES = 4096
#: Cascades of one number are dealt over receivers together: a row of a list has at most so many.
CHUNK = 64
#: Entries (an edge and a case of its source) of a bucket, about.
TARGET = 1_000_000


def _rank(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers in the order of the values, nulls first."""
    if pa.types.is_timestamp(x.type):
        x = x.cast(pa.int64())
    n = pc.rank(x, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    return (n.combine_chunks() if isinstance(n, pa.ChunkedArray) else n).to_numpy(zero_copy_only=False).astype(np.int64)


def _running(start: np.ndarray, w: np.ndarray, base: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For segments of w, added up one after the other: the largest base + sum, where it first reaches least (-1: nowhere), and base + sum there. One step of all segments at a time, those that got there leave."""
    end = np.append(start[1:], len(w))
    total, top, hit, there = np.zeros(len(start)), np.full(len(start), -np.inf), np.full(len(start), -1), np.zeros(len(start))
    on, at = np.arange(len(start)), start.copy()
    while len(on):
        total[on] += w[at]
        now = base[on] + total[on]
        top[on] = np.maximum(top[on], now)
        got = now >= least[on]
        hit[on[got]], there[on[got]] = at[got], now[got]
        go = ~got & (at + 1 < end[on])
        on, at = on[go], at[go] + 1
    return top, hit, there


def _weighed(given: pa.Table, known: pa.Table, kind: pa.Schema) -> pa.Table:
    """A round of lt for the receivers of a bucket. given: edges with lists of what their sources newly are in; known: what earlier rounds left, the last of a case counts."""
    if not len(given):
        return kind.empty_table()
    lists = given["c"].combine_chunks()
    edge = np.repeat(np.arange(len(given)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    part = pa.concat_tables([given.select(["threshold", "chunk", "v"]), known.select(["threshold", "chunk", "v"])])
    _, group = np.unique(np.stack([_rank(part[c]) for c in ("threshold", "chunk", "v")]), axis=1, return_inverse=True)
    group = group.ravel()
    key = group[edge] * CHUNK + lists.flatten().to_numpy(zero_copy_only=False)
    old = known["c"].combine_chunks()
    row = np.repeat(np.arange(len(known)), pc.list_value_length(old).to_numpy(zero_copy_only=False))
    old_key, old_base, turn = group[len(given) + row] * CHUNK + old.flatten().to_numpy(zero_copy_only=False), known["base"].combine_chunks().flatten().to_numpy(zero_copy_only=False), known["turn"].to_numpy()[row]
    order = np.lexsort((turn, old_key))
    old_key, old_base = old_key[order], old_base[order]
    at = np.searchsorted(old_key, key, side="right") - 1
    base = np.where((at >= 0) & (old_key[at] == key), old_base[at], 0.0) if len(old_key) else np.zeros(len(key))
    time = given["t"].combine_chunks().flatten()
    keep = np.flatnonzero(base < np.inf)
    order = keep[np.lexsort((_rank(given["u"])[edge[keep]], _rank(time)[keep], key[keep]))]
    if not len(order):
        return kind.empty_table()
    new = np.append(True, key[order][1:] != key[order][:-1])
    start = np.flatnonzero(new)
    first = order[start]
    top, hit, there = _running(start, given["w"].to_numpy()[edge[order]], base[first], given["threshold"].to_numpy()[edge[first]])
    whole = group[edge[first]]
    begin = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
    head = edge[first[begin]]
    joined = hit >= 0
    whose = order[hit[joined]]
    ends = np.append(begin, len(first))
    found = np.append(0, np.cumsum(joined))[ends]
    depth = given["depth"].combine_chunks().flatten()
    names = kind.field("found").type.value_type
    parts = [pa.array((key[first] % CHUNK)[joined]), given["u"].take(pa.array(edge[whose])), time.take(pa.array(whose)), depth.take(pa.array(whose)), pa.array(there[joined]), given["r"].take(pa.array(edge[whose]))]
    parts = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(parts, names, strict=True)]
    columns = [given[c].take(pa.array(head)) for c in ("threshold", "chunk", "v")]
    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[first] % CHUNK).cast(kind.field("c").type.value_type)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.where(joined, np.inf, top)))]
    columns += [pa.ListArray.from_arrays(pa.array(found, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(names)))]
    return pa.table([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, kind, strict=True)], schema=kind)


def lt(initial: DataFrame, par: DataFrame, thresholds: list[float], max_step: int | None = None) -> DataFrame:
    """par: u, v, w, r. Weights of active sources add up in the order in which they act, over all rounds; the user whose weight reaches the threshold is the parent.

    An edge is a row with a list of the cases (up to CHUNK cascades at a threshold) that its source is newly active in, so a round shuffles edges and not their cases one by one. Receivers are
    dealt over buckets of about TARGET entries, which add up and tell who joins. What a round leaves of a case (its sum, or that the user is active) is written once, as lists too.
    """
    spark = initial.sparkSession
    p = written(par.where("u <> v").select("u", "v", "w", "r"), "weights")
    out = written(p.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "targets")
    codes = written(numbered(initial.select("cascade_id").distinct(), "n", "cascade_id").select("cascade_id", F.expr(f"(n - 1) div {CHUNK}").alias("chunk"), ((F.col("n") - 1) % CHUNK).cast("byte").alias("c")), "codes")
    done, front = (written(x, "tree") for x in _start(initial, thresholds))
    kind, step = initial.schema["act_time"].dataType, 0
    user = initial.schema["user_id"].dataType
    key = ["threshold", "chunk", "v"]
    state = done.join(codes, "cascade_id").groupBy("threshold", "chunk", F.col("user_id").alias("v")).agg(F.collect_list("c").alias("c"))
    state = written(state.select(*key, "c", F.transform("c", lambda _: F.lit(float("inf"))).alias("base"), F.lit(-1).alias("turn")), "state")
    real = T.DoubleType()
    found = T.StructType().add("c", T.ByteType()).add("u", user).add("t", kind).add("depth", T.IntegerType()).add("p", real).add("r", par.schema["r"].dataType)
    shape = T.StructType().add("threshold", real).add("chunk", state.schema["chunk"].dataType).add("v", user)
    shape = shape.add("c", T.ArrayType(T.ByteType())).add("base", T.ArrayType(real)).add("found", T.ArrayType(found))

    def run(given: pa.Table, known: pa.Table) -> pa.Table:
        return _weighed(given, known, to_arrow_schema(shape))

    while (max_step is None or step < max_step) and not front.isEmpty():
        acts = front.join(codes, "cascade_id").groupBy("threshold", "chunk", F.col("user_id").alias("u")).agg(F.collect_list(F.struct("c", F.col("act_time").alias("t"), F.col("depth").cast("int").alias("depth"))).alias("x"))
        acts = written(acts.select("threshold", "chunk", "u", *[F.col(f"x.{c}").alias(c) for c in ("c", "t", "depth")]), "acts")
        entries = acts.join(out, "u").agg(F.sum(F.size("c") * F.col("n"))).first()[0] or 0
        many = max(-(-entries // TARGET), spark.sparkContext.defaultParallelism)
        bucket = F.pmod(F.xxhash64("v", "threshold", "chunk"), F.lit(many)).alias("bucket")
        given = acts.join(p, "u").select(bucket, *key, "u", "w", "r", "c", "t", "depth").repartition(many, "bucket")
        known = state.select(bucket, *key, "c", "base", "turn").repartition(many, "bucket")
        after = written(given.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, shape), "round")
        state = state.unionByName(after.select(*key, "c", "base", F.lit(step).alias("turn")))
        joined = after.select("threshold", "chunk", F.col("v").alias("user_id"), F.explode("found").alias("x")).select("threshold", "chunk", "user_id", F.col("x.c").alias("c"), "x").join(F.broadcast(codes), ["chunk", "c"])  # a row for each cascade
        front = joined.select("threshold", "cascade_id", "user_id", F.col("x.u").alias("parent_id"), received(F.col("x.t"), F.col("x.r")).cast(kind).alias("act_time"), (F.col("x.depth") + 1).alias("depth"), F.col("x.p").alias("probability"))
        done = done.unionByName(front)
        step += 1
    return done

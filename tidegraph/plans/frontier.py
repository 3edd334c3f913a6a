"""Prediction of the rest of a cascade with models of receivers, all cascades and thresholds at once: the loop, and how each kind of model judges.

Each round the inactive users with a model that are next to the frontier observe what is newly active; a judge says with what chance they act and whom
they follow. From the threshold on they join. A source sends what it is active in along its edges as lists; receivers judge in buckets, beside their models, and keep nothing
from round to round: what was observed before comes again with the lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.features import parent_index
from tidegraph.operators.sampling import numbered
from tidegraph.plans.loops import FEW, Grown, written
from tidegraph.plans.observations import ranks
from tidegraph.plans.receivers import _flat as flat

#: Cascades that a list has at most; a bucket has receivers by such groups of cascades.
CHUNK = 4096
#: Entries (an edge and a case of its source) of a bucket, about.
TARGET = 500_000
FOUND = "threshold double, chunk long, c short, user_id long, parent_id long, level int, probability double"
ROWS = pa.schema([("threshold", pa.float64()), ("chunk", pa.int64()), ("c", pa.int16()), ("user_id", pa.int64()), ("parent_id", pa.int64()), ("level", pa.int32()), ("probability", pa.float64())])


@dataclass
class Cases:
    """Inactive receivers that observe something new, each in one cascade at one threshold. By case: who (its receiver's row of models), d (how many sources) and first (its first entry).
    By entry, in the order of case, step and position: case, lag (observations since), pos and new."""

    models: pa.Table
    who: np.ndarray
    d: np.ndarray
    first: np.ndarray
    case: np.ndarray
    lag: np.ndarray
    pos: np.ndarray
    new: np.ndarray

    def weights(self, name: str, at: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of models and places in their list of that name the value there, and whether there is one."""
        lists = self.models[name].combine_chunks()
        start, size = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))), lists.value_lengths().to_numpy(zero_copy_only=False)
        values, there = lists.flatten().to_numpy(zero_copy_only=False), on < size[at]
        x = np.full(len(on), np.nan)
        x[there] = values[start[at[there]] + on[there]]
        return np.nan_to_num(x), ~np.isnan(x)

    def liked(self, value: np.ndarray) -> np.ndarray:
        """By case the new entry with the largest of the values (by entry), the first of several."""
        value = np.where(self.new, value, -np.inf)
        best = np.flatnonzero(self.new & (value == np.maximum.reduceat(value, self.first)[self.case]))
        return best[np.searchsorted(self.case[best], np.arange(len(self.first)))]


#: By case the chance to act and the entry of the source that is followed then.
Judge = Callable[[Cases], tuple[np.ndarray, np.ndarray]]


def dense(models: DataFrame, *more: Column) -> DataFrame:
    """v, w (weights by position from 0, null where there is none) and more, from rows of v, pos and weight."""
    held = models.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("pos", "weight"))).alias("m"), F.max("pos").alias("most"), *more)
    return held.withColumn("w", F.transform(F.sequence(F.lit(0), F.col("most").cast("int")), lambda i: F.try_element_at("m", i))).drop("m", "most")


def _judged(given: pa.Table, models: pa.Table, judge: Judge, level: int) -> pa.Table:
    """Who joins in a bucket. given: edges with lists of what their sources are active in (c, level), and own rows of receivers with what they are active in."""
    own = given["own"].to_numpy(zero_copy_only=False)
    mine, edges = given.filter(pa.array(own)), given.filter(pa.array(~own))
    if not len(edges) or not len(models):
        return ROWS.empty_table()
    # a group is a receiver at a threshold in a chunk of cascades
    names = ("v", "chunk", "threshold")
    cols = [np.concatenate([edges[c].to_numpy(), mine[c].to_numpy()]) for c in names]
    order = np.lexsort(cols[::-1])
    new = ranks(*(c[order] for c in cols))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    (c, edge), deep = flat(edges, "c"), flat(edges, "level")[0]
    own_c, own_row = flat(mine, "c")
    key = group[edge] * CHUNK + c
    keep = ~np.isin(key, group[len(edges) + own_row] * CHUNK + own_c)
    key, edge, deep = key[keep], edge[keep], deep[keep]
    keep = np.isin(key, np.unique(key[deep == level]))
    key, edge, deep = key[keep], edge[keep], deep[keep]
    if not len(key):
        return ROWS.empty_table()
    pos = edges["pos"].to_numpy()
    order = np.lexsort((pos[edge], deep, key))
    key, edge, deep = key[order], edge[order], deep[order]
    first = np.flatnonzero(ranks(key))
    case = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    step = np.cumsum(ranks(key, deep))
    last = step[np.append(first[1:], len(key)) - 1]
    head = edge[first]
    known = models["v"].to_numpy()
    by_v = np.argsort(known)
    who = by_v[np.searchsorted(known[by_v], edges["v"].to_numpy()[head])]
    p, chosen = judge(Cases(models, who, edges["d"].to_numpy()[head], first, case, last[case] - step, pos[edge], deep == level))
    hit = np.flatnonzero(p >= edges["threshold"].to_numpy()[head])
    at, source = pa.array(head[hit]), pa.array(edge[chosen[hit]])
    columns = [edges["threshold"].take(at), edges["chunk"].take(at), pa.array(key[first[hit]] % CHUNK), edges["v"].take(at), edges["u"].take(source), pa.array(np.full(len(hit), level + 1)), pa.array(p[hit])]
    return pa.table([x.cast(f.type) for x, f in zip(columns, ROWS, strict=True)], schema=ROWS)


def expand(initial: DataFrame, edges: DataFrame, models: DataFrame, judge: Judge, thresholds: list[float], max_step: int | None = None, whole: bool = False) -> DataFrame:
    """threshold, cascade_id, user_id, parent_id, depth, probability. models: a row for each v that has a model. Ends when no frontier grows, or after max_step rounds.
    With ``whole``, the sources that are active above the last level of the given tree count from the beginning; else observations begin with that level."""
    spark = initial.sparkSession
    idx = written(parent_index(edges).join(models.select("v"), "v", "left_semi"), "index")
    out = written(idx.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "targets")
    top = initial.groupBy("cascade_id").agg(F.max("depth").alias("top"))
    codes = written(numbered(top, "n", "cascade_id").select("cascade_id", "top", F.expr(f"(n - 1) div {CHUNK}").alias("chunk"), ((F.col("n") - 1) % CHUNK).cast("short").alias("c")), "codes")
    thr = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    start = initial.join(codes, "cascade_id").crossJoin(F.broadcast(thr))  # few thresholds
    start = start.select("threshold", "chunk", "c", F.col("user_id").cast("long").alias("user_id"), F.col("parent_id").cast("long").alias("parent_id"), (F.col("depth") - F.col("top")).cast("int").alias("level"), F.lit(None).cast("double").alias("probability"))
    tree = Grown(spark, "tree")
    first, _ = tree.add(start)
    front = first.where("level = 0")
    n_front, step = front.count(), 0
    place = ["threshold", "chunk"]

    def run(given: pa.Table, known: pa.Table) -> pa.Table:
        return _judged(given, known, judge, step)

    while (max_step is None or step < max_step) and n_front:
        done = tree.whole()
        acts = done.join(front.select(*place, "c").distinct(), [*place, "c"], "left_semi")
        near = written(front.select(*place, F.col("user_id").alias("u")).distinct().join(idx.select("u", "v"), "u").select(*place, "v").distinct(), "near")
        said = acts if whole else acts.where("level >= 0")
        lists = written(said.groupBy(*place, F.col("user_id").alias("u")).agg(F.collect_list(F.struct("c", "level")).alias("x")).select(*place, "u", *[F.col(f"x.{c}").alias(c) for c in ("c", "level")]), "said")
        entries = lists.join(out, "u").agg(F.sum(F.size("c") * F.col("n"))).first()[0] or 0
        many = max(-(-entries // TARGET), spark.sparkContext.defaultParallelism)
        bucket = F.pmod(F.xxhash64("v", *place), F.lit(many)).alias("bucket")
        sent = lists.join(idx, "u")
        if n_front < FEW:
            sent = sent.join(near, [*place, "v"], "left_semi")
        given = sent.select(bucket, *place, "v", "u", "pos", "d", "c", "level", F.lit(False).alias("own"))
        active = acts.groupBy(*place, F.col("user_id").alias("v")).agg(F.collect_list("c").alias("c")).join(near, [*place, "v"], "left_semi")
        given = given.unionByName(active.select(bucket, *place, "v", F.lit(None).cast("long").alias("u"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("d"), "c", F.lit(None).cast("array<int>").alias("level"), F.lit(True).alias("own")))
        known = near.select(bucket, "v").distinct().join(models, "v")
        found = given.repartition(many, "bucket").groupBy("bucket").cogroup(known.repartition(many, "bucket").groupBy("bucket")).applyInArrow(run, FOUND)
        front, n_front = tree.add(found)
        step += 1
    codes = codes.select("cascade_id", "top", "chunk", "c")
    return tree.whole().join(codes, ["chunk", "c"]).select("threshold", "cascade_id", "user_id", "parent_id", (F.col("level") + F.col("top")).alias("depth"), "probability")


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-z, -700, 700)))


def memm_judge(long: bool = False, binary: bool = False) -> Judge:
    """Models of seqlabel.fit_memm. Active states share their features, so the followed source is the first newly active one; with binary states
    it is the one with the largest weight."""

    def judge(s: Cases) -> tuple[np.ndarray, np.ndarray]:
        at, n = s.who[s.case], len(s.first)
        on = s.pos + s.lag * s.d[s.case] if long else s.pos
        width = s.models["w"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) - 1
        counted = (on <= width[at]) | ~np.bool_(long) | s.new
        slack = s.weights("w", s.who, np.zeros(n, np.int64))[0]
        z = np.bincount(s.case, s.weights("w", at, on)[0] * counted, n) - slack * np.bincount(s.case, counted, n) + np.log(s.models["n_active"].to_numpy().astype(float))[s.who]
        if not binary:
            return _logistic(z), s.liked(np.zeros(len(on)))
        value, there = s.weights("w", at, s.pos)
        return _logistic(z), s.liked(np.where(there, value, -np.inf))

    return judge


def mrf_judge() -> Judge:
    """Models of mrf.fit: all sources that are active count; the followed one is the newly active one with the largest weight."""

    def judge(s: Cases) -> tuple[np.ndarray, np.ndarray]:
        value, there = s.weights("w", s.who[s.case], s.pos)
        return _logistic(np.bincount(s.case, value, len(s.first))), s.liked(np.where(there, value, -np.inf))

    return judge


def crf_judge(long: bool = False, binary: bool = False) -> Judge:
    """Models of seqlabel.fit_crf: the chances of the states after the last observation, by the forward recursion over all observations of a receiver's cases together. The
    followed source is the newly active one whose state has the largest chance; with binary states, the one with the largest weight for acting."""

    def judge(s: Cases) -> tuple[np.ndarray, np.ndarray]:
        p, value = np.empty(len(s.first)), np.zeros(len(s.pos))
        lists = {c: s.models[c].combine_chunks() for c in ("states", "used", "w")}
        by_who = np.argsort(s.who, kind="stable")
        count = np.diff(np.append(s.first, len(s.case)))
        for cases in np.split(by_who, np.flatnonzero(ranks(s.who[by_who]))[1:]):
            states, used, w = (x[int(s.who[cases[0]])].values.to_numpy(zero_copy_only=False) for x in lists.values())
            n, d = len(states), len(used)
            emit, move = w[: n * d].reshape(n, d), np.exp(w[n * d :].reshape(n, n))
            at = np.repeat(s.first[cases], count[cases]) + np.arange(count[cases].sum()) - np.repeat(np.cumsum(count[cases]) - count[cases], count[cases])
            row, lag, pos = np.repeat(np.arange(len(cases)), count[cases]), s.lag[at], s.pos[at]
            q = np.ones((len(cases), n))
            # observations from the oldest on: what is seen when ``back`` more are to come
            for back in range(lag.max(), -1, -1):
                then = lag >= back
                on = pos[then] + (lag[then] - back) * s.d[cases[0]] if long else pos[then]
                place = np.minimum(np.searchsorted(used, on), max(d - 1, 0))
                there = used[place] == on if d else np.zeros(len(on), bool)
                x = np.zeros((len(cases), d))
                x[row[then][there], place[there]] = 1
                some = np.unique(row[then])
                score = x[some] @ emit.T
                after = (q[some] @ move) * np.exp(score - score.max(axis=1, keepdims=True))
                q[some] = after / after.sum(axis=1, keepdims=True)
            p[cases] = 1 - q[:, np.searchsorted(states, 0)]
            new = s.new[at]
            if binary:
                acting, mine = np.searchsorted(states, 1), np.minimum(np.searchsorted(used, pos), max(d - 1, 0))
                told = used[mine] == pos if d and n > 1 else np.zeros(len(pos), bool)
                like = np.where(told, emit[min(acting, n - 1)][mine] if d else 0.0, -np.inf)
            else:
                mine = np.minimum(np.searchsorted(states, pos), n - 1)
                like = np.where(states[mine] == pos, q[row, mine], 0.0)
            value[at] = np.where(new, like, -np.inf)
        return p, s.liked(value)

    return judge

"""Fits of one receiver at a time: what a receiver needs (its own activity and that of its sources) is brought together once, and all rounds run there.

A user's activity is one row with lists, so an edge is shuffled once and not once for each cascade of its source. Receivers are dealt over buckets of about ``TARGET`` entries; the
rounds of a bucket are sums over segments of flat arrays. The stop of a fit looks at all edges, so buckets give the values of every round, and which one counts is chosen after.
Receivers with more than loops.HOT entries are left to the joins of plans.em.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.plans import loops
from tidegraph.plans.loops import written

By = tuple[str, ...]
#: Entries (an edge and a cascade of its source) that a bucket has about.
TARGET = 400_000
LARGEST = 3.4028234663852886e38


@dataclass
class Bundle:
    """Receivers of a bucket. Edges are rows; v numbers their receivers, of which there are n. hits: entries whose receiver acts too and whose ``rule`` holds, in the order of ``group``
    (a receiver in a cascade); misses: entries whose receiver does not act. Both: (edge, group, start of each group, values...)."""

    table: pa.Table
    v: np.ndarray
    n: int
    size: np.ndarray
    hits: tuple[np.ndarray, ...]
    misses: tuple[np.ndarray, ...]

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()


#: From a bundle and a number of rounds to which edges are kept, the values of each round (edges by rounds) and their squared changes (by round).
Kernel = Callable[[Bundle, int], tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]]
Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and the row of each."""
    lists = table[name].combine_chunks()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def _grouped(group: np.ndarray, edge: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(group, kind="stable")
    group = group[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return edge[order], np.cumsum(new) - 1, np.flatnonzero(new), *(x[order] for x in values)


def bundle(table: pa.Table, rule: Rule, waits: bool = False) -> Bundle:
    """table: u, v, own (a receiver's own row), c and t (cascades and when or how deep), with ``waits`` rest (time left), and more columns of edges."""
    own, names = table["own"].to_numpy(zero_copy_only=False), ["c", "t"] + ["rest"] * waits
    mine, edges = table.filter(pa.array(own)), table.filter(pa.array(~own))
    receivers, v = np.unique(np.concatenate([edges["v"].to_numpy(), mine["v"].to_numpy()]), return_inverse=True)
    v, whose = v[: len(edges)], v[len(edges) :]
    (c, edge), (own_c, own_row) = _flat(edges, "c"), _flat(mine, "c")
    many, code = np.unique(np.concatenate([c, own_c]), return_inverse=True)
    key = v[edge] * len(many) + code[: len(c)]
    own_key = whose[own_row] * len(many) + code[len(c) :]
    order = np.argsort(own_key)
    own_key, own_t = own_key[order], _flat(mine, "t")[0][order]
    at = np.minimum(np.searchsorted(own_key, key), max(len(own_key) - 1, 0))
    acts = own_key[at] == key if len(own_key) else np.zeros(len(key), bool)
    t = _flat(edges, "t")[0]
    hit = np.flatnonzero(acts)
    hit = hit[rule(t[hit], own_t[at[hit]])]
    miss = np.flatnonzero(~acts)
    rest = _flat(edges, "rest")[0] if waits else t
    hits = _grouped(key[hit], edge[hit], own_t[at[hit]] - t[hit], own_t[at[hit]] == 0)
    out = Bundle(edges.drop_columns(names), v, len(receivers), np.bincount(edge, minlength=len(edges)), hits, _grouped(key[miss], edge[miss], rest[miss]))
    if waits:
        out.table = pa.concat_tables([out.table, mine.drop_columns(names)])
        out.v = np.concatenate([v, whose])
    return out


def _sum(edge: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(edge, weights=x, minlength=n)


def _rounds(start: np.ndarray, step: Callable[[np.ndarray], np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of each round (edges by rounds) and the sums of their squared changes."""
    now, out, moved = start, np.empty((len(start), most)), np.empty(most)
    for i in range(most):
        new = step(now)
        out[:, i], moved[i], now = new, float(((new - now) ** 2).sum()), new
    return out, moved


def inverse_success(b: Bundle, k: np.ndarray) -> np.ndarray:
    """By edge the sum of 1 / P over the positive cascades, P the chance that one of the parents succeeds."""
    edge, group, start = b.hits[:3]
    if not len(edge):
        return np.zeros(len(k))
    p = 1 - np.multiply.reduceat(1 - k[edge], start)
    return _sum(edge, np.divide(1.0, p, out=np.zeros_like(p), where=p != 0)[group], len(k))


def emic(b: Bundle, most: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    n = np.maximum(b.size, 1)
    out, moved = _rounds(b.column("k"), lambda k: np.where(b.size > 0, k * inverse_success(b, k) / n, 0.0), most)
    return b.size > 0, {"k": out}, {"k": moved}


def daic(b: Bundle, most: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    tried = np.bincount(b.hits[0], minlength=len(b.v)) + np.bincount(b.misses[0], minlength=len(b.v))
    weight = b.column("penalty")
    beta = tried + weight

    def step(k: np.ndarray) -> np.ndarray:
        under = beta * beta - 4 * weight * (k * inverse_success(b, k))
        root = np.where((np.abs(under) < 1e-10) | (under < 0), 0.0, under)
        return np.where(tried > 0, (beta - np.sqrt(root)) / (2 * weight), 0.0)

    out, moved = _rounds(b.column("k"), step, most)
    return tried > 0, {"k": out}, {"k": moved}


def _guarded(dt: np.ndarray, least: float = 1 / 43200) -> np.ndarray:
    return np.where(dt == 0, least, dt)


def ctic(b: Bundle, most: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    edge, group, start, dt, _ = b.hits
    dt, n = _guarded(dt), len(b.v)
    kept = np.bincount(edge, minlength=n)
    tried = np.maximum(kept + np.bincount(b.misses[0], minlength=n), 1)
    alone = (np.diff(np.append(start, len(edge))) == 1)[group] if len(edge) else np.zeros(0, bool)

    def step(par: np.ndarray) -> np.ndarray:
        if not len(edge):
            return np.zeros_like(par)
        k, r = par[edge, 0], par[edge, 1]
        x = k * np.exp(-r * dt)
        beta = x / (x + 1 - k)
        a = r * beta
        whole = np.add.reduceat(a, start)[group]
        alpha = np.where(alone, 1.0, np.divide(a, whole, out=np.zeros_like(a), where=whole != 0))
        m = alpha + (1 - alpha) * beta
        sa, sm, st = (_sum(edge, y, n) for y in (alpha, m, m * dt))
        return np.stack([sm / tried, np.divide(sa, st, out=np.zeros_like(sa), where=st != 0)], axis=1)

    now, out, moved = np.stack([b.column("k"), np.full(n, 1 / 30)], axis=1), np.empty((2, n, most)), np.empty((2, most))
    for i in range(most):
        new = step(now)
        out[:, :, i], moved[:, i], now = new.T, ((new - now) ** 2).sum(axis=0), new
    return kept > 0, dict(zip("kr", out, strict=True)), dict(zip("kr", moved, strict=True))


def _by_group(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, start) if len(start) else np.zeros(0)


def aslt(b: Bundle, most: int) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Edges are followed by a row for each receiver, its weight on itself."""
    n = len(b.v)
    edge, group, start, dt, first = b.hits
    late, wait, begin, rest = b.misses
    of, waiting, when = b.v[edge], b.v[late], b.v[late[begin]]
    w, r = 1 / np.bincount(b.v, minlength=b.n)[b.v], np.full(b.n, 1 / 30)
    out, moved = {c: np.empty((n, most)) for c in "wr"}, {c: np.empty(most) for c in "wr"}
    for i in range(most):
        seen = w[edge] * np.exp(-r[of] * _guarded(dt))
        h = np.where(first, 1.0, r[of] * _by_group(seen, start)[group])
        phi = np.divide(r[of] * seen, h, out=np.zeros_like(h), where=h > 0)
        fade = w[late] * np.expm1(-r[waiting] * rest)
        whole = _sum(b.v, w, b.n)
        g = np.maximum(whole[when] + _by_group(fade, begin), 0.0)
        inverse = np.divide(1.0, g, out=np.zeros_like(g), where=g > 0)
        psi = w[late] * np.exp(-r[waiting] * rest) * inverse[wait]
        top = _sum(of, phi, b.n)
        bottom = _sum(of, phi * _guarded(dt, 1 / 1440), b.n) + _sum(waiting, psi * rest, b.n)
        rate = np.where(top == 0, 0.0, np.where(bottom == 0, LARGEST, top / np.where(bottom == 0, 1.0, bottom)))
        y = _sum(edge, phi, n) + _sum(late, fade * inverse[wait], n)
        x = np.maximum(y + w * _sum(when, inverse, b.n)[b.v], 0.0)
        length = np.sqrt(_sum(b.v, x * x, b.n))[b.v]
        new = np.divide(x, length, out=np.zeros_like(x), where=length != 0)
        moved["w"][i], moved["r"][i] = ((new - w) ** 2).sum(), ((rate - r) ** 2).sum()
        w, r = new, rate
        out["w"][:, i], out["r"][:, i] = w, r[b.v]
    return np.ones(n, bool), out, moved


def activity(acts: DataFrame, by: By, *values: str) -> DataFrame:
    """by, id, c, and a list for each of the values: the cascades of each user. Cascades are numbered, in any order."""
    codes = written(acts.select("cascade_id").distinct().withColumn("c", F.monotonically_increasing_id()), "codes")
    rows = acts.join(codes, "cascade_id").groupBy(*by, F.col("user_id").alias("id")).agg(F.collect_list(F.struct("c", *values)).alias("x"))
    return written(rows.select(*by, "id", *[F.col(f"x.{c}").alias(c) for c in ("c", *values)]), "activity")


def crowded(lists: DataFrame, edges: DataFrame, by: By) -> tuple[DataFrame, int]:
    """by and v of receivers with more than loops.HOT entries, and how many entries all the others have."""
    size = lists.select(*by, F.col("id").alias("u"), F.size("c").alias("n"))
    each = written(edges.select(*by, "u", "v").join(size, [*by, "u"], "left").groupBy(*by, "v").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "entries")
    return each.where(F.col("n") > loops.HOT).select(*by, "v"), each.where(F.col("n") <= loops.HOT).agg(F.sum("n")).first()[0] or 0


def paths(lists: DataFrame, edges: DataFrame, users: DataFrame, entries: int, kernel: Kernel, rule: Rule, names: tuple[str, ...], most: int, by: By) -> DataFrame:
    """by, u, v and for each of the names a list of its values by round; in rows without u, lists of squared changes.

    lists: activity(). edges: by, u, v and columns that the kernel reads; users: by, id of the receivers, all with an own row.
    """
    spark, extra = edges.sparkSession, [c for c in edges.columns if c not in (*by, "u", "v")]
    waits = "rest" in lists.columns
    held = ["c", "t"] + ["rest"] * waits
    given = edges.join(lists.withColumnRenamed("id", "u"), [*by, "u"], "left").select(*by, "u", "v", F.lit(False).alias("own"), *held, *extra)
    mine = users.select(*by, "id").join(lists, [*by, "id"], "left").select(*by, F.col("id").alias("u"), F.col("id").alias("v"), F.lit(True).alias("own"), *held, *[F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in extra])
    many = max(-(-entries // TARGET), spark.sparkContext.defaultParallelism)
    rows = given.unionByName(mine).withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(many)))
    kind = T.StructType([*(edges.schema[c] for c in (*by, "u", "v")), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in names)])
    keys = [*by, "u", "v"]

    def run(table: pa.Table) -> pa.Table:
        b = bundle(table, rule, waits)
        kept, values, moved = kernel(b, most)
        ends = b.table.select(keys).filter(pa.array(kept))
        lists_of = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, most, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
        whole = {c: [*table[c].slice(0, 1).to_pylist()] for c in by} | {"u": [None], "v": [None]}
        sums = pa.table({c: pa.array(whole[c], ends.schema.field(c).type) for c in keys} | {c: lists_of(moved[c][None]) for c in names})
        out = pa.table({c: ends[c] for c in keys} | {c: lists_of(values[c][kept]) for c in names})
        return pa.concat_tables([out, sums])

    return written(rows.repartition(many, *by, "bucket").groupBy(*by, "bucket").applyInArrow(run, kind), "paths")


def squares(path: DataFrame, names: tuple[str, ...], by: By) -> DataFrame:
    """by, value (its name), i (round, from 1), square: sums of squared changes."""
    parts = [path.where("u is null").select(*by, F.lit(c).alias("value"), F.posexplode(c).alias("i", "square")).withColumn("i", F.col("i") + 1) for c in names]
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "value", "i").agg(F.sum("square").alias("square"))


def last_rounds(sums: DataFrame, weights: dict[str, float], stop: float, most: int, by: By) -> DataFrame:
    """by, i: the first round whose change, the weighted sum of the norms, is below stop, or the last."""
    norm = F.sum(reduce(lambda x, c: F.when(F.col("value") == c, weights[c]).otherwise(x), weights, F.lit(0.0)) * F.sqrt("square"))
    moved = sums.groupBy(*by, "value", "i").agg(F.sum("square").alias("square")).groupBy(*by, "i").agg(norm.alias("moved"))
    return written(moved.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("moved") < stop, F.col("i"))), F.lit(most)).cast("int").alias("i")), "ends")

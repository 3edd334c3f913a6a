"""What receivers observe of their sources, made where their edges lie: the sequences that models of receivers are fitted on, without a row for each step in Spark.

A user's activity is one row with lists, so an edge is shuffled once with what its source does. Receivers are dealt over buckets of about ``TARGET`` entries (an edge and a
cascade of its source); the steps of a bucket are flat arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.sampling import numbered
from tidegraph.plans.loops import written
from tidegraph.plans.receivers import _flat as flat

#: Entries of a bucket, about. Fits are long for their bytes.
TARGET = 150_000


@dataclass
class Steps:
    """Steps of the receivers of a bucket, by receiver and sequence (a cascade); who, seq and state are by step, row and pos by entry (a source that acts in a step), ascending.
    v and d are by receiver, sizes (how many steps) by sequence."""

    v: np.ndarray
    d: np.ndarray
    who: np.ndarray
    seq: np.ndarray
    state: np.ndarray
    sizes: np.ndarray
    row: np.ndarray
    pos: np.ndarray

    def history(self, long: bool) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature of all that has been observed up to a row: positions, or with ``long`` position + lag * d. By row, ascending."""
        end = np.cumsum(self.sizes)[self.seq[self.row]]
        n = end - self.row
        first = np.cumsum(n) - n
        lag = np.arange(n.sum()) - np.repeat(first, n)
        row, on = np.repeat(self.row, n) + lag, np.repeat(self.pos, n)
        if long:
            on = on + lag * np.repeat(self.d[self.who[self.row]], n)
        order = np.lexsort((on, row))
        return row[order], on[order]


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by keys begin to differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def steps(table: pa.Table) -> Steps:
    """table: u, v, own (a receiver's own row), c, t and p: cascades, how deep, and in own rows the parent there. As features.evidence has them, sequences in the order of c."""
    own = table["own"].to_numpy(zero_copy_only=False)
    mine, edges = table.filter(pa.array(own)), table.filter(pa.array(~own)).sort_by([("v", "ascending"), ("u", "ascending")])
    receivers, begin, d = np.unique(edges["v"].to_numpy(), return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(d)), d)
    place = np.arange(len(of)) - begin[of] + 1
    u = edges["u"].to_numpy()
    (c, edge), t = flat(edges, "c"), flat(edges, "t")[0]
    (own_c, own_row), own_t, own_p = flat(mine, "c"), flat(mine, "t")[0], flat(mine, "p")[0]
    span = max(c.max(initial=0), own_c.max(initial=0)) + 1
    whose = np.searchsorted(receivers, mine["v"].to_numpy())[own_row]
    key, own_key = of[edge] * span + c, whose * span + own_c
    order = np.argsort(own_key)
    own_key, own_t, own_p = own_key[order], own_t[order], own_p[order]
    at = np.minimum(np.searchsorted(own_key, key), max(len(own_key) - 1, 0))
    acts = own_key[at] == key if len(own_key) else np.zeros(len(key), bool)
    deep, parent = (x[at] if len(x) else np.zeros(len(key), int) for x in (own_t, own_p))
    keep = np.flatnonzero(~acts | (deep == 0) | (t < deep))
    keep = keep[np.lexsort((place[edge[keep]], t[keep], key[keep]))]
    key, t, edge, late, parent = key[keep], t[keep], edge[keep], acts[keep] & (deep[keep] > 0), parent[keep]
    new_seq, new = ranks(key), ranks(key, t)
    row, seq = np.cumsum(new) - 1, np.cumsum(new_seq)[new] - 1
    sizes, state = np.bincount(seq), np.zeros(new.sum(), np.int64)
    led = np.flatnonzero(late & (u[edge] == parent))
    state[np.cumsum(sizes)[seq[row[led]]] - 1] = place[edge[led]]
    return Steps(receivers, d, of[edge[new]], seq, state, sizes, row, place[edge])


Kernel = Callable[[Steps], pa.Table]


def fitted(nodes: DataFrame, edges: DataFrame, kernel: Kernel, kind: str) -> DataFrame:
    """What kernel makes of the steps of all receivers that have a source. nodes: cascade_id, user_id, parent_id, depth; edges: src, dst."""
    spark = nodes.sparkSession
    codes = numbered(nodes.select("cascade_id").distinct(), "c", "cascade_id").select("cascade_id", F.col("c").cast("int").alias("c"))
    rows = nodes.join(codes, "cascade_id").where("user_id is not null").groupBy(F.col("user_id").alias("u"))
    lists = rows.agg(F.collect_list(F.struct("c", F.col("depth").alias("t"), F.expr("coalesce(parent_id, user_id)").alias("p"))).alias("x"))
    lists = written(lists.select("u", *[F.col(f"x.{c}").alias(c) for c in "ctp"]), "activity")
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("v is not null")
    given = ends.join(lists.drop("p"), "u", "left").select("u", "v", F.lit(False).alias("own"), "c", "t", F.lit(None).cast(lists.schema["p"].dataType).alias("p"))
    users = ends.select("v").distinct()
    mine = lists.withColumn("v", F.col("u")).join(users, "v", "left_semi").select("u", "v", F.lit(True).alias("own"), "c", "t", "p")
    entries = ends.join(lists.select("u", F.size("c").alias("n")), "u").agg(F.sum("n")).first()[0] or 0
    many = max(-(-entries // TARGET), 4 * spark.sparkContext.defaultParallelism)
    table = given.unionByName(mine).withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(many)))

    def run(bucket: pa.Table) -> pa.Table:
        return kernel(steps(bucket))

    return table.repartition(many, "bucket").groupBy("bucket").applyInArrow(run, kind)

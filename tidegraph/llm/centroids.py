"""Centroid clustering over distinct quantised vectors: Lloyd's rounds in exact integers.

Vectors are quantised, equal ones are counted once with their multiplicity, the rounds run over the distinct ones with weighted integer sums, and the
assignments are joined back to the ids at the end. Each round reads the distinct vectors once and sends one row per task, cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded_batches, free_name, quoted, stored

#: Largest size of a quantised component: squared distances of 64 such components stay below 2**63.
LARGEST = (1 << 27) - 1
#: A vector with at least this share of all rows is joined back by broadcast; so there are 1000 of them at most.
HOT = 1000
STRUCT = "struct<cluster: int, distance: bigint, cluster_inertia: bigint, inertia: bigint, centroid_sha256: string>"


def quantised(x: Column, scale: int, size: int) -> Column:
    """floor(scale * x) for each component as double; null for arrays of another size and for those with a null or non-finite component."""
    number = F.transform(x, lambda v: v.cast("double"))
    fine = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # coalesced: forall is null, not false, where some component is null and no other fails
    whole = F.coalesce(x.isNotNull() & (F.size(x) == size) & fine, F.lit(False))
    too_large = F.exists(number, lambda v: F.abs(v * scale) > LARGEST)
    cells = F.when(too_large, F.raise_error(F.lit(f"a component leaves the range of {LARGEST} / {scale}")).cast("array<int>")).otherwise(F.transform(number, lambda v: F.floor(v * scale).cast("int")))
    return F.when(whole, cells)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a column of int arrays of one size, as numbers of 64 bits."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smaller of equals) and the squared distance, both exact."""
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * q.shape[1] * top * top < 1 << 53:  # doubles hold all sums, and multiply faster
        a, c = q.astype(np.float64), centroids.astype(np.float64)
        d = ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(q)), best]


def weighted_sums(q: np.ndarray, n: np.ndarray, best: np.ndarray, k: int) -> list[list[int]]:
    """For each cluster its multiplicities' sum and the weighted sums of the components; whole numbers of any size."""
    out = []
    for c in range(k):
        own, weight = q[best == c], n[best == c]
        if int(np.abs(own).max(initial=0)) * int(weight.sum(dtype=object) or 0) < 1 << 62:
            sums = (own * weight[:, None]).sum(axis=0).tolist()
        else:
            sums = (own.astype(object) * weight.astype(object)[:, None]).sum(axis=0).tolist()
        out.append([int(weight.sum(dtype=object) or 0), *map(int, sums)])
    return out


def _round(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of the members; empty clusters stay."""
    k, size = len(centroids), len(centroids[0])
    now = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (size + 1) for _ in range(k)]
        for batch in batches:
            q = matrix(batch.column("q"), size)
            best, _ = nearest(q, now)
            part = weighted_sums(q, batch.column("n").to_numpy(), best, k)
            total = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(total, part, strict=True)]
        some = [(c, i, Decimal(x)) for c, row in enumerate(total) if row[0] for i, x in enumerate(row)]
        columns = list(zip(*some, strict=True)) or [(), (), ()]
        kinds = [pa.int32(), pa.int32(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cluster", "place", "x"])

    sums = distinct.mapInArrow(run, "cluster int, place int, x decimal(38,0)").groupBy("cluster", "place").agg(F.sum("x").alias("x"))
    out = [list(c) for c in centroids]
    got = {(r["cluster"], r["place"]): int(r["x"]) for r in sums.collect()}  # k * (size + 1) rows at most
    for c, i in got:
        if i:
            out[c][i - 1] = got[c, i] // got[c, 0]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1", into: str = "__cluster") -> DataFrame:
    """The kept rows of vectors (vec_id, embedding and any others) with one more column at the end: struct of cluster, distance (squared),
    cluster_inertia, inertia and centroid_sha256.

    Kept are arrays of exactly ``size`` components, none null, NaN or infinite; components become floor(scale * x) as whole numbers. A component whose
    number is over ``LARGEST`` ends the query with an error, since distances would leave 64 bits. The start is the k kept rows with the smallest hash
    of seed:vec_id, in that order (of equal ids, the smaller vector first; null ids come last). Fewer kept rows make fewer clusters, none
    an empty result. Repeated rows count as often as they occur. The column is called ``into``, with underscores after it where vectors has one of that name.

    Only the k centroids reach the driver. Vectors that make up a thousandth of all rows, 1000 at most, are joined back by broadcast, all others by a shuffle.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = vectors.select(F.struct(*[F.col(quoted(c)) for c in vectors.columns]).alias("row"), quantised(F.col("embedding"), scale, size).alias("q")).where("q is not null")
    distinct = stored(kept.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row.vec_id").cast("string")).cast("binary"), 256)
    first = kept.select(name.alias("name"), "q").orderBy(F.col("name").asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return kept.select("row.*", F.lit(None).cast(STRUCT).alias(free_name(vectors.columns, into)))
    centroids = [list(r["q"]) for r in first]
    for _ in range(rounds):
        centroids = _round(distinct, centroids)
    now = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, d = nearest(matrix(batch.column("q"), size), now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(d)], ["q", "n", "cluster", "distance"])

    assigned = stored(distinct.mapInArrow(run, "q array<int>, n long, cluster int, distance long"), "assigned")
    # of the k clusters: at most k rows
    inertia = {r["cluster"]: (int(r["d"]), int(r["n"])) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("d"), F.sum("n").alias("n")).collect()}
    whole, rows = sum(d for d, _ in inertia.values()), sum(n for _, n in inertia.values())
    facts = [(c, d, whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, (d, _) in sorted(inertia.items())]
    facts = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows at most
    found = assigned.select("q", "n", "cluster", "distance")
    hot = F.broadcast(found.where(F.col("n") * HOT >= rows).drop("n"))  # HOT rows at most
    rest = found.where(F.col("n") * HOT < rows).drop("n")
    back = kept.join(hot, "q").unionByName(kept.join(hot.select("q"), "q", "left_anti").join(rest, "q"))
    out = back.join(facts, "cluster")
    return out.select("row.*", F.struct("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").alias(free_name(vectors.columns, into)))

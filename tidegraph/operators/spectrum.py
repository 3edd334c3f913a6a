"""Leading eigenvectors of a sparse symmetric matrix, and clusters of its rows from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.loops import written

_DOUBLES = "array<double>"


def _rows(frame: pd.DataFrame, column: str, width: int) -> np.ndarray:
    return np.array(frame[column].tolist(), dtype=float).reshape(len(frame), width)


def _times(links: DataFrame, state: DataFrame, column: str, width: int) -> DataFrame:
    """cascade_id, product: links (i, j, w) times the rows of a column of arrays."""
    terms = links.join(state.select(F.col("cascade_id").alias("j"), F.col(column).alias("x")), "j")
    sums = terms.groupBy(F.col("i").alias("cascade_id")).agg(*[F.sum(F.col("w") * F.col("x")[p]).alias(f"s{p}") for p in range(width)])
    return sums.select("cascade_id", F.array(*[f"s{p}" for p in range(width)]).alias("product"))


def _grams(state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'SZ of the columns z and sz, width x width each, summed by Spark from a partial sum for each task."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width, width))
        for batch in batches:
            if len(batch):
                z, sz = _rows(batch, "z", width), _rows(batch, "sz", width)
                total += np.stack([z.T @ z, z.T @ sz])
        yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

    summed = state.select("z", "sz").mapInPandas(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    flat = np.zeros(2 * width * width)
    for row in summed.collect():  # 2 width^2 numbers
        flat[row["place"]] = row["value"]
    zz, zsz = flat.reshape(2, width, width)
    return (zz + zz.T) / 2, (zsz + zsz.T) / 2


def _ritz(zz: np.ndarray, zsz: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest Ritz values of the span of Z and their coefficients; directions that depend on others are left out."""
    scale = 1 / np.sqrt(np.maximum(np.diag(zz), 1e-300))
    values, vectors = np.linalg.eigh(zz * np.outer(scale, scale))
    keep = values > 1e-12 * values[-1]
    white = scale[:, None] * vectors[:, keep] / np.sqrt(values[keep])
    theta, y = np.linalg.eigh(white.T @ zsz @ white)
    return theta[::-1][:width], (white @ y)[:, ::-1][:, :width]


def affinity(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links (i, j, w in both directions, w = sim / sqrt(d_i d_j)) and degrees (cascade_id, d). Repeated pairs add up; a null or equal id, or a similarity not over 0, makes no link."""
    good = pairs.where("i <> j and sim > 0").select("i", "j", "sim")
    both = written(good.union(good.select("j", "i", "sim")).groupBy("i", "j").agg(F.sum("sim").alias("sim")), "affinity")
    degrees = written(both.groupBy(F.col("i").alias("cascade_id")).agg(F.sum("sim").alias("d")), "degrees")
    x, y = degrees.select(F.col("cascade_id").alias("i"), F.col("d").alias("di")), degrees.select(F.col("cascade_id").alias("j"), F.col("d").alias("dj"))
    return written(both.join(x, "i").join(y, "j").select("i", "j", (F.col("sim") / F.sqrt(F.col("di") * F.col("dj"))).alias("w")), "links"), degrees


def eigenvectors(links: DataFrame, ids: DataFrame, k: int, spare: int = 4, rounds: int = 200, least: float = 1e-7) -> tuple[DataFrame, np.ndarray]:
    """cascade_id, x (array of k numbers): orthonormal eigenvectors of the k largest eigenvalues of a symmetric matrix of links (i, j, w), and these values, largest first.

    A conjugate-gradient method on blocks: in each round the best k + spare vectors are taken from the span of the last ones, their residuals and the last steps. A round is
    one join of the residuals with the links and sums of products, 3 (k + spare) squared; these alone come to the driver. It ends when no residual of the first k is
    over ``least``, or after ``rounds`` with the best vectors so far. The first vectors are hashes of the ids. With fewer ids than k the missing vectors have zeros.
    """
    ids = ids.select("cascade_id").where("cascade_id is not null").distinct()
    width = k + spare
    first = F.array(*[F.pmod(F.xxhash64("cascade_id", F.lit(p)), F.lit(1_000_003)) / 500_001.0 - 1 for p in range(width)])
    zeros = F.array_repeat(F.lit(0.0), width)
    start = written(ids.select("cascade_id", first.alias("x")), "spectrum")
    product = _times(links, start, "x", width)
    state = written(start.join(product, "cascade_id", "left").select("cascade_id", F.concat("x", zeros, zeros).alias("z"), F.concat(F.coalesce("product", zeros), zeros, zeros).alias("sz")), "spectrum")
    for _ in range(rounds):
        theta, mix = _ritz(*_grams(state, 3 * width), width)
        found = len(theta)
        theta, mix = np.pad(theta, (0, width - found)), np.pad(mix, ((0, 0), (0, width - found)))

        def step(batches: Iterator[pd.DataFrame], theta=theta, mix=mix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                z, sz = _rows(batch, "z", 3 * width), _rows(batch, "sz", 3 * width)
                x, sx = z @ mix, sz @ mix
                p, sp = z[:, width:] @ mix[width:], sz[:, width:] @ mix[width:]
                yield pd.DataFrame({"cascade_id": batch["cascade_id"], "x": list(x), "sx": list(sx), "r": list(sx - x * theta), "p": list(p), "sp": list(sp)})

        kind = ids.schema["cascade_id"].dataType.simpleString()
        moved = written(state.mapInPandas(step, f"cascade_id {kind}, " + ", ".join(f"{c} {_DOUBLES}" for c in ("x", "sx", "r", "p", "sp"))), "spectrum")
        norms = moved.agg(*[F.coalesce(F.sum(F.col("r")[p] * F.col("r")[p]), F.lit(0.0)) for p in range(k)]).first()
        if max(norms) <= least**2:
            break
        product = _times(links, moved, "r", width)
        state = written(moved.join(product, "cascade_id", "left").select("cascade_id", F.concat("x", "r", "p").alias("z"), F.concat("sx", F.coalesce("product", zeros), "sp").alias("sz")), "spectrum")
    return moved.select("cascade_id", F.slice("x", 1, k).alias("x")), theta[:k]


def pivots(rows: DataFrame, k: int) -> np.ndarray:
    """The rows that a QR decomposition with pivoting picks from rows (cascade_id, x): time after time the row that is longest without its parts along those picked before. Equal lengths, to twelve places: the smallest id."""
    picked, basis = [], []
    for _ in range(k):
        length = sum((F.col("x")[p] * F.col("x")[p] for p in range(k)), F.lit(0.0))
        for q in basis:
            length = length - F.pow(sum((F.col("x")[p] * float(q[p]) for p in range(k)), F.lit(0.0)), 2)
        best = rows.agg(F.max_by("x", F.struct(F.round(length, 12).alias("n"))).alias("any"), F.max(F.round(length, 12)).alias("n")).first()
        if best["any"] is None:
            break
        row = rows.where(F.round(length, 12) == best["n"]).agg(F.min_by("x", "cascade_id").alias("x")).first()["x"]
        rest = np.array(row)
        picked.append(row)
        for q in basis:
            rest = rest - (rest @ q) * q
        size = np.linalg.norm(rest)
        if size < 1e-9:
            break
        basis.append(rest / size)
    return np.array(picked, dtype=float).reshape(len(picked), k)


def clusters(pairs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """cascade_id, label (0 .. k - 1): spectral clusters of ids by the similarities of pairs (i, j, sim).

    The first k eigenvectors of the affinity, normalised by the roots of the degrees, give each id a row of k numbers, over the root of its degree. The rows picked by a
    pivoted QR decomposition are turned onto the axes; an id's label is the axis along which its turned row is longest. An id without pairs has its own row as it is.
    """
    links, degrees = affinity(pairs)
    vectors, _ = eigenvectors(links, ids, k)
    root = F.sqrt(F.coalesce("d", F.lit(1.0)))
    rows = written(vectors.join(degrees, "cascade_id", "left").select("cascade_id", F.transform("x", lambda v: v / root).alias("x")), "spectrum")
    chosen = pivots(rows, k)
    if not len(chosen):
        return rows.select("cascade_id", F.lit(0).alias("label"))
    u, _, v = np.linalg.svd(chosen.T, full_matrices=False)
    turn = u @ v
    along = F.array(*[F.abs(sum((F.col("x")[p] * float(turn[p, q]) for p in range(k)), F.lit(0.0))) for q in range(turn.shape[1])])
    return rows.select("cascade_id", (F.array_position(along, F.array_max(along)) - 1).cast("int").alias("label"))

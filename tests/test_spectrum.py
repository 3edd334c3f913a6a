"""Eigenvectors and spectral clusters against dense matrices."""

import random

import numpy as np
import pytest

from tidegraph.operators import spectrum

N, GROUPS = 45, 3


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(3)
    w = np.zeros((N, N))
    for i in range(N):
        for j in range(i + 1, N):
            if r.random() < 0.5:
                w[i, j] = w[j, i] = r.uniform(0.4, 0.9) if i % GROUPS == j % GROUPS else r.uniform(0.01, 0.1)
    pairs = [(i, j, float(w[i, j])) for i in range(N) for j in range(i + 1, N) if w[i, j]]
    return w, spark.createDataFrame(pairs, "i long, j long, sim double"), spark.range(N).withColumnRenamed("id", "cascade_id")


def dense(w):
    d = w.sum(1)
    return np.linalg.eigh(w / np.sqrt(np.outer(d, d)))


def test_eigenvectors_equal_dense(spark, case):
    w, pairs, ids = case
    links, _ = spectrum.affinity(pairs)
    rows, values = spectrum.eigenvectors(links, ids, GROUPS)
    want, vectors = dense(w)
    assert values == pytest.approx(want[::-1][:GROUPS], abs=1e-9)
    got = np.array([r["x"] for r in rows.orderBy("cascade_id").collect()])
    assert np.abs(np.abs(vectors[:, ::-1][:, :GROUPS].T @ got) - np.eye(GROUPS)).max() < 1e-5


def plain_labels(w, k):
    _, vectors = dense(w)
    x = vectors[:, ::-1][:, :k] / np.sqrt(w.sum(1))[:, None]
    rest, picked = x.copy(), []
    for _ in range(k):
        at = int((rest**2).sum(1).argmax())
        picked.append(at)
        q = rest[at] / np.linalg.norm(rest[at])
        rest = rest - np.outer(rest @ q, q)
    u, _, v = np.linalg.svd(x[picked].T)
    return np.abs(x @ (u @ v)).argmax(1).tolist()


def test_labels_equal_dense(spark, case):
    w, pairs, ids = case
    got = [r["label"] for r in spectrum.clusters(pairs, ids, GROUPS).orderBy("cascade_id").collect()]
    assert got == plain_labels(w, GROUPS)
    assert all(len({got[i] for i in range(g, N, GROUPS)}) == 1 for g in range(GROUPS)) and len(set(got)) == GROUPS


def test_no_pairs_and_few_ids(spark, case):
    none = spark.createDataFrame([], "i long, j long, sim double")
    assert spectrum.clusters(none, spark.createDataFrame([], "cascade_id long"), 2).count() == 0
    few = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "cascade_id long")
    odd = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (3, 3, 1.0), (None, 1, 0.2), (1, 3, None)], "i long, j long, sim double")
    rows = spectrum.clusters(odd, few, 2).collect()
    assert sorted(r["cascade_id"] for r in rows) == [1, 2, 3] and all(r["label"] in (0, 1) for r in rows)

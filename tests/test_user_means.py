"""k-means of the cascade-user matrix against dense vectors."""

import hashlib
import random

import numpy as np
import pytest

from tidegraph.operators import clusters


def plain(sets, k, rounds):
    ids, users = sorted(sets), sorted(set().union(*sets.values()))
    x = np.array([[u in sets[c] for u in users] for c in ids], dtype=float)
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5((ids[i] + "0").encode()).hexdigest(), ids[i]))[:k]
    means = {label: x[i] for label, i in enumerate(order)}
    was = None
    for _ in range(rounds + 1):
        names = sorted(means)
        d = np.array([[((row - means[n]) ** 2).sum() for n in names] for row in x])
        now = [names[int(np.round(row, 9).argmin())] for row in d]
        means = {n: x[[i for i, b in enumerate(now) if b == n]].mean(0) for n in set(now)}
        if now == was:
            break
        was = now
    return {c: (n, row.min()) for c, n, row in zip(ids, now, d)}


def test_equal_to_dense_vectors(spark):
    r = random.Random(11)
    sets = {f"c{i:02d}": {r.randrange(i % 4 * 10, i % 4 * 10 + 14) for _ in range(9)} | {99} for i in range(30)}
    sets["c90"] = {1000, 1001}  # shares no user with any mean but its own
    rows = [(c, u) for c, s in sets.items() for u in s] + [("c00", 99), ("c01", None), (None, 5)]
    act = spark.createDataFrame(rows, "cascade_id string, user_id long")
    got = {r["cascade_id"]: (r["label"], r["distance"]) for r in clusters.user_means(act, 4, 12).collect()}
    want = plain(sets, 4, 12)
    assert {c: n for c, (n, _) in got.items()} == {c: n for c, (n, _) in want.items()}
    assert [got[c][1] for c in sorted(got)] == pytest.approx([want[c][1] for c in sorted(want)])


def test_empty_table_and_more_means_than_cascades(spark):
    assert clusters.user_means(spark.createDataFrame([], "cascade_id string, user_id long"), 3).count() == 0
    two = spark.createDataFrame([("a", 1), ("b", 2)], "cascade_id string, user_id long")
    assert {(r["cascade_id"], r["distance"]) for r in clusters.user_means(two, 5).collect()} == {("a", 0.0), ("b", 0.0)}

"""Chains of all lengths step by step, against sums over all paths."""

import itertools

import numpy as np
import pytest

from tidegraph import queries
from tidegraph.operators import graphs
from tidegraph.plans import seqlabel


def test_sequences_of_all_lengths_are_worked_on_together():
    rng = np.random.default_rng(2)
    sizes = rng.permutation(np.arange(100) % 20 + 1)
    x = (rng.random((sizes.sum(), 4)) < 0.5).astype(float)
    (one,) = seqlabel.chains(x, sizes)  # one block, where there was one for each length
    assert len(one.start) == 21 and one.x.shape == x.shape
    assert [len(b.x) for b in seqlabel.chains(x[:300], np.ones(300, int))] == [256, 44]


@pytest.mark.parametrize("led", [False, True])
def test_values_are_sums_over_paths(led, monkeypatch):
    monkeypatch.setattr(seqlabel, "TOGETHER", 3)
    rng, n, d = np.random.default_rng(7), 3, 2
    sizes = np.array([1, 3, 2, 4, 1, 2, 3])
    x, y = (rng.random((sizes.sum(), d)) < 0.6).astype(float), rng.integers(0, n, sizes.sum())
    w = rng.normal(size=n * d + n * n)

    def plain(w):
        emit, move, out, at = w[: n * d].reshape(n, d), w[n * d :].reshape(n, n), 1.5 * w @ w, 0
        for size in sizes:
            rows, told = np.vstack([np.zeros((int(led), d)), x[at : at + size]]), [0] * led + y[at : at + size].tolist()
            score = lambda path: sum(emit[s] @ r for s, r in zip(path, rows)) + sum(move[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, B905, E731
            out += np.log(sum(np.exp(score(p)) for p in itertools.product(range(n), repeat=len(rows)))) - score(told)
            at += size
        return out

    value, g = seqlabel.chains_value(w, seqlabel.chains(x, sizes), seqlabel.seen_sums(x, y, sizes, n, led), n, 1.5, led)
    assert value == pytest.approx(plain(w))
    for i, one in enumerate(np.eye(len(w)) * 1e-6):
        assert (plain(w + one) - plain(w - one)) / 2e-6 == pytest.approx(g[i], abs=1e-5)


def test_fitted_crfs_are_no_checkpoint(spark, monkeypatch):
    rows = [(f"c{c}", u, u - 1 or None, u - 1) for c in range(3) for u in (1, 2, 3)]
    nodes = spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, depth int")
    for name, table in (("nodes_of", nodes), ("graph_of", graphs.from_trees(nodes)), ("act_of", None)):
        monkeypatch.setattr(queries, name, lambda s, d, table=table: table)
    monkeypatch.setattr(queries, "_made", {})
    got = queries.QUERIES["crf_fit"](spark, "none")
    assert "parquet" in got._jdf.queryExecution().executedPlan().toString() and got.where("weight is null").isEmpty()
    assert {r["v"] for r in got.select("v").distinct().collect()} == {2, 3}

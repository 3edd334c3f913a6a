"""The joint two-slice field against exact enumeration of its states and plain counts."""

import itertools
import math

import numpy as np
import pytest

from tidegraph.plans import mrf
from tidegraph.plans.loops import settled

EDGES = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 2), (5, 4), (3, 6), (6, 3)]


@pytest.fixture(scope="module")
def graph(spark):
    return settled(spark.createDataFrame(EDGES, "src long, dst long"))


def exact(weights):
    """Expected features by summing over the 4^6 states of six users; states in which somebody with sources stops being active have no weight."""
    users = sorted({u for e in EDGES for u in e})
    fed = {v for _, v in EDGES}
    total, sums = 0.0, dict.fromkeys(weights, 0.0)
    for bits in itertools.product((0, 1), repeat=2 * len(users)):
        s0, s1 = dict(zip(users, bits)), dict(zip(users, bits[len(users) :]))
        if any(s0[v] and not s1[v] for v in fed):
            continue
        p = math.exp(sum(w for (u, v), w in weights.items() if s0[u] and s1[v]))
        total += p
        for u, v in weights:
            sums[u, v] += p * s0[u] * s1[v]
    return {k: x / total for k, x in sums.items()}


def test_expectations_are_those_of_all_states(spark, graph):
    rng = np.random.default_rng(3)
    weights = {(u, v): float(rng.normal()) for u, v in EDGES} | {(v, v): float(rng.normal()) for v in {v for _, v in EDGES}}
    field = settled(spark.createDataFrame([(u, v, w) for (u, v), w in weights.items()], "u long, v long, weight double"))
    s0, s1 = mrf.sampled(field, graph, 12, words=64, seed=5)
    got = {(r["u"], r["v"]): r["e"] for r in mrf.expectations(field, s0, s1).collect()}
    want = exact(weights)
    assert got.keys() == want.keys()
    for k, e in want.items():  # 4096 chains
        assert abs(got[k] - e) < 4 * math.sqrt(e * (1 - e) / 4096) + 1e-3, k


def made_nodes(spark):
    rows = [("a", 1, None, 0), ("a", 2, 1, 1), ("a", 3, 2, 2), ("a", 6, 3, 3), ("b", 5, None, 0), ("b", 4, 5, 1), ("c", 1, None, 0), ("c", 3, None, 0), ("c", 9, 3, 1), ("d", 2, None, 0)]
    return settled(spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, depth int")), rows


def plain_sums(rows):
    out, steps = {}, 0
    depth = {}
    for c, u, _, d in rows:
        depth.setdefault(c, {})[u] = d
    pairs = EDGES + [(v, v) for v in {v for _, v in EDGES}]
    for level in depth.values():
        for t in range(max(level.values())):
            steps += 1
            s0, s1 = {u for u, d in level.items() if d <= t}, {u for u, d in level.items() if d <= t + 1}
            for u, v in pairs:
                out[u, v] = out.get((u, v), 0) + (u in s0 and v in s1)
    return out, steps


def test_observed_sums(spark, graph):
    nodes, rows = made_nodes(spark)
    got = {(r["u"], r["v"]): r["c"] for r in mrf.joint_sums(nodes, mrf.field_edges(graph)).collect()}
    want, steps = plain_sums(rows)
    assert got == want and mrf.n_steps(nodes) == steps == 5


def test_fit_goes_along_the_gradient(spark, graph):
    nodes, rows = made_nodes(spark)
    one = {(r["v"], r["pos"]): r["weight"] for r in mrf.fit(nodes, graph, iterations=1, eta=0.1, burn=0).collect()}
    again = {(r["v"], r["pos"]): r["weight"] for r in mrf.fit(nodes, graph, iterations=1, eta=0.1, burn=0).collect()}
    assert one == again  # draws are hashes
    names = {(r["u"], r["v"]): (r["v"], r["pos"]) for r in mrf.field_edges(graph).collect()}
    want, steps = plain_sums(rows)
    for key, c in want.items():  # in the first sweep nobody is active before, so nothing is expected
        assert one[names[key]] == pytest.approx(1 + 0.1 * c)
    end = mrf.fit(nodes, graph, iterations=6, eta=0.05, chains=256)
    assert end.count() == len(want) and end.where("weight is null or abs(weight) > 50").isEmpty()
    assert mrf.fit(nodes, graph.where("false"), iterations=2).isEmpty()

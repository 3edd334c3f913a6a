"""Predictions of the sequence models against plain loops over one cascade at a time."""

import math
from datetime import datetime

import numpy as np
import pytest

from tidegraph.operators import features, graphs, trees
from tidegraph.plans import experiment, mrf
from tidegraph.plans.loops import settled

USERS, THRESHOLDS = 9, [0.05, 0.3, 0.7]


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = np.random.default_rng(7), []
    for c in range(14):
        order = rng.permutation(USERS)[: rng.integers(2, USERS + 1)].tolist()
        depth = {order[0]: 0}
        rows.append((f"c{c}", order[0] + 1, None, 0))
        for u in order[1:]:
            p = list(depth)[rng.integers(max(0, len(depth) - 3), len(depth))]
            depth[u] = depth[p] + 1
            rows.append((f"c{c}", u + 1, p + 1, depth[u]))
    made = [(c, u, p, datetime(2024, 1, 1, 0, i % 60), d) for i, (c, u, p, d) in enumerate(rows)]
    nodes = settled(spark.createDataFrame(made, "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int"))
    return nodes, settled(graphs.from_trees(nodes))


def probability(method: str, w: dict, seen: list[list[int]], d: int, n_active: int) -> tuple[float, dict[int, float]]:
    """The chance that a user acts after observations (newly active positions, the last the newest), and how much each newly active position is preferred."""
    long = method.lstrip("m").startswith("l")

    def on(steps: list[list[int]]) -> set[int]:
        return {p + lag * d for lag, active in enumerate(reversed(steps)) for p in active} if long else {p for active in steps for p in active}

    new, multi = seen[-1], method.startswith("m")
    if method == "unimrf":
        return 1 / (1 + math.exp(-sum(w[p] for p in on(seen)))), {p: w[p] for p in new}
    if method.endswith("memm"):
        width = len(w) - 1
        x = {p for p in on(seen) if p <= width}
        active, idle = sum(w[p] for p in x) + w[0] * (width + 1 - len(x)), w[0] * (width + 1)
        p = n_active * math.exp(active) / (n_active * math.exp(active) + math.exp(idle))
        return p, {p: 0 if multi else w[p] for p in new}
    states = sorted({k[1] for k in w if k[0] == "move"})
    q = dict.fromkeys(states, 1.0)
    for t in range(1, len(seen) + 1):
        x = on(seen[:t])
        q = {j: sum(q[i] * math.exp(w["move", i, j]) for i in states) * math.exp(sum(w.get(("emit", j, p), 0) for p in x)) for j in states}
    total = sum(q.values())
    return 1 - q[0] / total, {p: q.get(p, 0) / total if multi else w.get(("emit", 1, p), -math.inf) for p in new}


def plain(method: str, initial: list, edges: list, models: dict, n_active: dict, threshold: float) -> dict:
    sources: dict = {}
    for u, v in sorted(edges):
        sources.setdefault(v, []).append(u)
    out = {}
    for c in {r[0] for r in initial}:
        depth = {u: d for x, u, d in initial if x == c}
        front, seen = {u for u in depth if depth[u] == max(depth.values())}, {}
        if method == "unimrf":  # the state of every active source counts, those above the last level too
            seen = {v: [older] for v, us in sources.items() if (older := [i + 1 for i, u in enumerate(us) if u in depth and u not in front])}
        while front:
            joined = {}
            for v, us in sources.items():
                new = [i + 1 for i, u in enumerate(us) if u in front]
                if new and v not in depth and v in models:
                    seen.setdefault(v, []).append(new)
                    p, liked = probability(method, models[v], seen[v], len(us), n_active.get(v, 1))
                    if p >= threshold:
                        joined[v] = us[max(new, key=lambda i: (liked[i], -i)) - 1], p
            for v, (u, p) in joined.items():
                out[c, v] = u, depth[u] + 1, p
            depth |= {v: depth[u] + 1 for v, (u, _) in joined.items()}
            front = set(joined)
    return out


@pytest.mark.parametrize("method", sorted(set(experiment.METHODS) - {"emic", "daic", "ctic", "aslt"}))
def test_predictions_are_those_of_a_plain_loop(data, method):
    nodes, graph = data
    fit, forecast = experiment.METHODS[method]
    par = settled(fit(experiment.Data(nodes, nodes), graph, **({"iterations": 4} if method == "unimrf" else {"iterations": 40})))
    models: dict = {}
    for r in par.collect():
        models.setdefault(r["v"], {})[r["pos"] if "pos" in par.columns else (r["kind"], r["state"], r["other"])] = r["weight"]
    n_active = {r["v"]: r["n_active"] for r in par.collect()} if "n_active" in par.columns else {}
    initial = trees.truncated(nodes, 1)
    start, edges = [tuple(r) for r in initial.select("cascade_id", "user_id", "depth").collect()], [tuple(r)[:2] for r in graph.select("src", "dst").collect()]
    got = forecast(initial, graph, par, THRESHOLDS, None).where("probability is not null").collect()
    some = 0
    for t in THRESHOLDS:
        want = plain(method, start, edges, models, n_active, t)
        found = {(r["cascade_id"], r["user_id"]): (r["parent_id"], r["depth"], r["probability"]) for r in got if r["threshold"] == t}
        assert {k: x[:2] for k, x in found.items()} == {k: x[:2] for k, x in want.items()}
        assert {k: x[2] for k, x in found.items()} == pytest.approx({k: x[2] for k, x in want.items()}, rel=1e-6)
        some += len(want)
    assert some


def test_a_source_of_a_shallow_level_counts(spark):
    start = spark.createDataFrame([("c", 1, None, None, 0), ("c", 2, 1, None, 1)], "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int")
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 2)], "src long, dst long")
    models = spark.createDataFrame([(3, 0, 9.0), (3, 1, 4.0), (3, 2, -1.0)], "v long, pos int, weight double")
    got = mrf.predict(start, edges, models, [0.5]).where("user_id = 3").collect()
    assert [(r["parent_id"], r["depth"]) for r in got] == [(2, 2)] and got[0]["probability"] == pytest.approx(1 / (1 + math.exp(-3)))


def test_empty_and_unknown(spark, data):
    nodes, graph = data
    fit, forecast = experiment.METHODS["mbcrf"]
    par = settled(fit(experiment.Data(nodes, nodes), graph, iterations=5))
    assert forecast(nodes.where("false"), graph, par, [0.1], None).isEmpty()
    alone = nodes.where("depth = 0")
    assert forecast(alone, graph, par.where("false"), [0.1], None).count() == alone.count()
    assert set(features.evidence(nodes, graph).columns) >= {"state", "active"}

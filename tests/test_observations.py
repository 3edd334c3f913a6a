"""Fits and predictions of receivers in buckets, against those over rows of features."""

import numpy as np
import pytest

from tidegraph.operators import features, graphs, trees
from tidegraph.plans import experiment, frontier, observations, seqlabel
from tidegraph.plans.loops import settled


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = np.random.default_rng(3), []
    for c in range(10):
        order = (rng.permutation(8)[: rng.integers(2, 9)] + 1).tolist()
        depth = {order[0]: 0}
        rows.append((f"c{c}", order[0], None, None, 0))
        for u in order[1:]:
            p = list(depth)[rng.integers(max(0, len(depth) - 3), len(depth))]
            depth[u] = depth[p] + 1
            rows.append((f"c{c}", u, p, None, depth[u]))
    nodes = settled(spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int"))
    return nodes, settled(graphs.from_trees(nodes))


@pytest.mark.parametrize(("long", "two_states"), [(False, False), (True, True)])
def test_fits_in_buckets_are_those_of_rows(data, monkeypatch, long, two_states):
    monkeypatch.setattr(observations, "TARGET", 40)
    monkeypatch.setattr(seqlabel, "ABREAST", 3)
    nodes, graph = data
    ev = features.evidence(nodes, graph)
    seen = features.long_features(ev) if long else features.bin_features(ev)
    seen = settled(seqlabel.binary(seen) if two_states else seen)
    of = lambda df: {tuple(r)[:-3] if "iterations" in df.columns else tuple(r)[:-1]: (tuple(r)[-3:] if "iterations" in df.columns else tuple(r)[-1:]) for r in df.select(*(["v", "pos", "weight", "n_active", "iterations"] if "pos" in df.columns else df.columns)).collect()}
    want, got = of(seqlabel.fit_memm(seen, *(("on", "lags") if long else ()), iterations=60)), of(seqlabel.memm_rows(seqlabel.fit_memm_at(nodes, graph, long, two_states, iterations=60)))
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    packed = settled(seqlabel.fit_crf_at(nodes, graph, long, two_states))
    want, got = of(seqlabel.fit_crf(seen, "on" if long else "seen")), of(seqlabel.crf_rows(packed))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    again = {r["v"]: r for r in seqlabel.crf_packed(seqlabel.crf_rows(packed)).collect()}
    assert {r["v"]: r for r in packed.collect()} == again


def test_a_fit_makes_no_rows_of_steps(data):
    nodes, graph = data
    for method in ("mbmemm", "lcrf"):
        plan = experiment.METHODS[method][0](experiment.Data(nodes, nodes), graph)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan


def test_predictions_do_not_depend_on_buckets(data, monkeypatch):
    nodes, graph = data
    start = trees.truncated(nodes, 0)
    models = settled(seqlabel.fit_memm_at(nodes, graph, True, True, iterations=20))
    told = lambda: {tuple(r) for r in seqlabel.predict(start, graph, models, [0.1, 0.4], None, True, True).collect()}
    want = told()
    for name, value in (("CHUNK", 3), ("TARGET", 5), ("FEW", 0)):
        monkeypatch.setattr(frontier, name, value)
    assert told() == want and len(want) > 2 * start.count()

"""Where the rows of a fit lie, cases side by side in one loop, and tuning over folds and draws."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import evaluate, graphs, sequences, trees
from tidegraph.plans import em, experiment, predict
from tidegraph.plans.loops import settled, slots, written


@pytest.fixture(scope="module")
def data(spark):
    rng, rows, start = np.random.default_rng(12), [], datetime(2024, 1, 1)
    for c in range(18):
        order = rng.permutation(8)[: rng.integers(2, 9)].tolist()
        depth = {order[0]: 0}
        rows.append((f"c{c:02}", order[0] + 1, None, start, 0, 0.0))
        for i, u in enumerate(order[1:], 1):
            p = list(depth)[rng.integers(max(0, len(depth) - 3), len(depth))]
            depth[u] = depth[p] + 1
            rows.append((f"c{c:02}", u + 1, p + 1, start + timedelta(days=i), depth[u], i / 30))
    whole = spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int, t double")
    act = whole.join(whole.groupBy("cascade_id").agg(F.max("t").alias("max_t")), "cascade_id").select("cascade_id", "user_id", "t", "max_t")
    nodes = settled(whole.drop("t"))
    return nodes, settled(act), settled(graphs.from_trees(nodes))


def values(df, *columns):
    key = [c for c in ("fold", "draw", "u", "v") if c in df.columns]
    return {tuple(r[k] for k in key): tuple(r[c] for c in columns) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12)


def shuffled(plan):
    """What each exchange of a physical plan reads, down to the tables below it."""
    out, lines = [], plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = re.search(r"[A-Za-z*]", line).start()
            below = []
            for x in lines[i + 1 :]:
                if not x.strip() or re.search(r"[A-Za-z*]", x).start() <= depth:
                    break
                below.append(x)
            out.append("\n".join(below))
    return out


def test_rounds_do_not_shuffle_the_rows_of_trials(spark, data):
    nodes, act, graph = data
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        ap, tried = em.laid(sequences.active_parents(act, graph), "active"), written(sequences.trials(act, graph), "tried")
        places, k = em.slots_of(ap), written(em.initial_k(graph).withColumn("r", F.lit(0.1)), "k")
        exposed = em.laid(sequences.exposed(act, graph), "exposed")
        first = em.laid(sequences.active_parents(act, graph).withColumn("first", F.lit(False)), "first")
        w = written(em.initial_w(graph, graphs.vertices(nodes)), "w")
        steps = {
            "daic": em.daic_step(k, ap, places, tried),
            "ctic": em.ctic_step(k, ap, places, tried),
            "aslt": em.aslt_step(w, first, exposed, em.slots_of(first), em.slots_of(exposed)),
        }
        for name, step in steps.items():
            plan = step._jdf.queryExecution().executedPlan().toString()
            moved = shuffled(plan)
            assert plan.count("Bucketed: true") >= 1 and moved, name
            for below in moved:  # what an exchange gets of trials has been summed by edge, slot by slot
                if re.search(r"cascade_id.*Bucketed: true", below):
                    assert below.lstrip(" :+-").startswith("*") or "HashAggregate(keys=[slot" in below or "HashAggregate(keys=[v" in below, (name, below)
                    assert re.search(r"HashAggregate\(keys=\[(slot#\d+L, )?(u#\d+L, )?v#\d+L", below), (name, below)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_receivers_lie_in_several_slots(spark, data, monkeypatch):
    nodes, act, graph = data
    users = graphs.vertices(nodes)
    plain = [values(em.fit_emic(nodes, graph, 2)[0], "k"), values(em.fit_ctic(act, graph, 2)[0], "k", "r"), values(em.fit_aslt(act, graph, users)[0], "w", "r")]
    ap = sequences.active_parents(act, graph)
    dealt = slots(ap, "v", "cascade_id", 4)
    many = dealt.groupBy("v").agg(F.count_distinct("slot").alias("n"))
    assert many.where("n > 1").count() > 2 and dealt.groupBy("v", "cascade_id").agg(F.count_distinct("slot").alias("n")).where("n > 1").isEmpty()
    monkeypatch.setattr("tidegraph.plans.loops.HOT", 4)
    split = [values(em.fit_emic(nodes, graph, 2)[0], "k"), values(em.fit_ctic(act, graph, 2)[0], "k", "r"), values(em.fit_aslt(act, graph, users)[0], "w", "r")]
    for a, b in zip(plain, split):
        close(a, b)


def test_cases_side_by_side_are_those_of_separate_fits(spark, data):
    nodes, act, graph = data
    fold = lambda df: df.where("cascade_id < 'c09'").withColumn("fold", F.lit(0)).unionByName(df.where("cascade_id >= 'c05'").withColumn("fold", F.lit(1)))
    n, a = settled(fold(nodes)), settled(fold(act))
    g = settled(n.where("parent_id is not null").select("fold", F.col("parent_id").alias("src"), F.col("user_id").alias("dst")).distinct())
    for fit, names in ((lambda n, a, g, **c: em.fit_emic(n, g, 4, 0.05, **c), ("k",)), (lambda n, a, g, **c: em.fit_ctic(a, g, 3, **c), ("k", "r"))):
        both, rounds = fit(n, a, g, by=("fold",))
        alone = [fit(*(x.where(F.col("fold") == f).drop("fold") for x in (n, a, g))) for f in (0, 1)]
        assert rounds == max(r for _, r in alone)
        close(values(both, *names), {(f, *k): x for f in (0, 1) for k, x in values(alone[f][0], *names).items()})


def test_tuning_is_that_of_a_plain_loop(spark, data):
    nodes, act, graph = data
    d = experiment.Data(nodes, act)
    train = nodes.select("cascade_id").distinct()
    grid = [0.05, 0.2, 0.4]
    for method in ("emic",):
        best, means = experiment.tune(method, d, train, grid, iterations=3)
        parts = [experiment.scores(method, d, a, b, grid, iterations=3) for a, b in experiment._folds(train, 3)]
        every = parts[0].unionByName(parts[1]).unionByName(parts[2])
        want = {r["threshold"]: r for r in evaluate.mean_metrics(every, ("threshold",)).collect()}
        got = {r["threshold"]: r for r in means.collect()}
        assert got.keys() == want.keys()
        for t in got:
            assert [got[t][m] for m in evaluate.METRICS] == pytest.approx([want[t][m] for m in evaluate.METRICS])
        assert best == max(sorted(want), key=lambda t: want[t]["f1"])


def test_search_is_that_of_a_plain_loop(spark, data, monkeypatch):
    nodes, act, _ = data
    d, train = experiment.Data(nodes, act), nodes.select("cascade_id").distinct()
    ranges = {"threshold": (0.02, 0.1), "penalty": (1.0, 20.0)}
    # two rounds a fit are enough to tell draws apart
    rounds = em.fit_daic
    monkeypatch.setattr(em, "fit_daic", lambda *a, **c: rounds(*a, iterations=2, **c))
    best, f1 = experiment.search("daic", d, train, ranges, iterations=2, folds=2)
    found = []
    for drawn in experiment.draws(ranges, 2):
        parts = [experiment.scores("daic", d, a, b, [drawn["threshold"]], penalty=drawn["penalty"]) for a, b in experiment._folds(train, 2)]
        found.append((evaluate.mean_metrics(parts[0].unionByName(parts[1])).first()["f1"], drawn))
    top = max(x for x, _ in found)
    assert f1 == pytest.approx(top) and best == next(w for x, w in found if x == top)


def test_predictions_of_cases(spark, data):
    nodes, _, graph = data
    k = em.initial_k(graph)
    par = k.withColumn("method", F.lit("a")).unionByName(k.withColumn("k", F.col("k") / 2).withColumn("method", F.lit("b")))
    given = [trees.truncated(nodes, depth).withColumn("given", F.lit(depth)) for depth in (0, 1)]
    given = given[0].unionByName(given[1])
    start = given.withColumn("method", F.lit("a")).unionByName(given.withColumn("method", F.lit("b")))
    out = predict.ic(start, par, [0.1, 0.3], by=("method", "given"))
    seen = {tuple(r) for r in out.select("method", "given", "threshold", "cascade_id", "user_id", "parent_id", "depth").collect()}
    want = set()
    for m, share in (("a", 1), ("b", 2)):
        for depth in (0, 1):
            one = predict.ic(trees.truncated(nodes, depth), k.withColumn("k", F.col("k") / share), [0.1, 0.3])
            want |= {(m, depth, *r) for r in one.select("threshold", "cascade_id", "user_id", "parent_id", "depth").collect()}
    assert seen == want

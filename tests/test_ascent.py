"""The random field's fit by buckets against the same steps as joins, round by round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import graphs
from tidegraph.plans import ascent, mrf
from tidegraph.plans.loops import settled


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = [(f"c{c:02}", int(u) + 1, int(order[(i - 1) // 2]) + 1 if i else None, int(np.log2(i + 1))) for c in range(9) for order in [rng.permutation(14)[: rng.integers(1, 13)]] for i, u in enumerate(order)]
    nodes = settled(spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, depth int"))
    return nodes, settled(graphs.from_trees(nodes))


def by_joins(nodes, edges, iterations, eta, eps, words, burn, seed):
    many = mrf.n_steps(nodes)
    now = settled(mrf.joint_sums(nodes, mrf.field_edges(edges)).withColumn("weight", F.lit(1.0)))
    s0, _ = mrf.sampled(now, edges, burn, words, seed)
    for i in range(iterations):
        s1 = settled(mrf.after(now, s0, seed))
        step = F.lit(eta) * (F.col("c") - F.lit(float(many)) * F.col("e"))
        new = settled(now.join(mrf.expectations(now, s0, s1), ["u", "v"]).select("u", "v", "pos", "c", (F.col("weight") + step).alias("weight"), step.alias("step")))
        now = new.drop("step")
        if new.groupBy("v").agg(F.sqrt(F.sum(F.col("step") * F.col("step"))).alias("n")).agg(F.max("n")).first()[0] < eps:
            break
        s0 = settled(mrf.before(now, s1, seed))
    return {(r["v"], r["pos"]): r["weight"] for r in now.collect()}, i + 1


def test_numbers_are_those_of_the_joins(spark):
    ids = np.array([-7, 0, 3, 1 << 40])
    number = "pmod(xxhash64(11, 1, 5, id, 2, k), 9007199254740992L) / 9007199254740992D"
    rows = spark.createDataFrame([(int(i),) for i in ids], "id long").selectExpr("id", f"transform(sequence(0, 63), k -> {number}) as x").collect()
    assert {r["id"]: r["x"] for r in rows} == dict(zip(ids.tolist(), ascent.numbers(11, 1, 5, ids, 2).tolist(), strict=True))


@pytest.mark.parametrize("chains, target, together", [(64, 5, 3), (128, 400_000, 10)])
def test_rounds_are_those_of_the_joins(spark, data, monkeypatch, chains, target, together):
    nodes, edges = data
    monkeypatch.setattr(ascent, "TARGET", target)
    monkeypatch.setattr(ascent, "TOGETHER", together)
    monkeypatch.setattr(ascent, "AT_ONCE", 7)
    want, _ = by_joins(nodes, edges, 4, 0.02, 1e-6, chains // 64, 2, 3)
    got = {(r["v"], r["pos"]): r["weight"] for r in mrf.fit(nodes, edges, iterations=4, eta=0.02, chains=chains, burn=2, seed=3).collect()}
    assert got.keys() == want.keys() and len({round(w, 6) for w in got.values()}) > 20
    for k, w in got.items():
        assert w == pytest.approx(want[k], abs=1e-9)


def test_ends_at_the_round_that_moves_little(spark, data, monkeypatch):
    nodes, edges = data
    for together in (3, 20):
        monkeypatch.setattr(ascent, "TOGETHER", together)
        for eps in (1e3, 3.0):
            want, rounds = by_joins(nodes, edges, 5, 0.02, eps, 1, 1, 0)
            got = {(r["v"], r["pos"]): r["weight"] for r in mrf.fit(nodes, edges, iterations=5, eta=0.02, eps=eps, burn=1).collect()}
            assert got == pytest.approx(want) and (rounds == 1 or eps < 1e3)

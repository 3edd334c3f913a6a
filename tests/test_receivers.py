"""Fits that run where a receiver's rows lie, against the same fits by joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import features, graphs
from tidegraph.plans import em, mln, seqlabel
from tidegraph.plans.loops import settled


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{c:02}", int(u) + 1, int(order[(i - 1) // 2]) + 1 if i else None, int(np.log2(i + 1)), i / 30) for c in range(14) for order in [rng.permutation(9)[: rng.integers(2, 10)]] for i, u in enumerate(order)]
    whole = spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, depth int, t double")
    act = whole.join(whole.groupBy("cascade_id").agg(F.max("t").alias("max_t")), "cascade_id").where("user_id <> 3")  # 3 has no times
    return settled(whole.select("cascade_id", "user_id", "parent_id", "depth")), settled(act.select("cascade_id", "user_id", "t", "max_t")), settled(graphs.from_trees(whole))


@pytest.mark.parametrize("method", ["emic", "daic", "ctic", "aslt"])
def test_rounds_are_no_joins(spark, data, monkeypatch, method):
    nodes, act, graph = data
    users = graphs.vertices(nodes)
    fit = {"emic": lambda: em.fit_emic(nodes, graph, 3), "daic": lambda: em.fit_daic(act, graph, 3), "ctic": lambda: em.fit_ctic(act, graph, 3), "aslt": lambda: em.fit_aslt(act, graph, users, 3)}[method]
    tables, plain = [], em.written
    monkeypatch.setattr(em, "written", lambda df, name: tables.append(name) or plain(df, name))
    rows = lambda df: {(r["u"], r["v"]): tuple(r) for r in df.collect()}
    got = rows(fit()[0])
    assert "round" not in tables
    monkeypatch.setattr("tidegraph.plans.loops.HOT", 1)  # nearly every receiver through the joins
    want = rows(fit()[0])
    assert tables.count("round") == 3 and got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)


def test_each_file_of_weights_has_its_own_end(spark, tmp_path):
    line = lambda u: f'0.5 !isActivated("N{u}",v0) v activates("N{u}","N9",v0)'
    (tmp_path / "a.txt").write_text("\n".join([line(1), "// end", line(7)]))
    (tmp_path / "b.txt").write_text("\n".join([line(2), line(3), line(4), "// end", line(8)]))
    (tmp_path / "c.txt").write_text("\n".join(["// end", line(6)]))
    (tmp_path / "d.txt").write_text(line(5))
    assert {r["u"] for r in mln.weights(spark, str(tmp_path), "// end").collect()} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("fit", [seqlabel.fit_memm, seqlabel.fit_crf])
def test_models_of_receivers_keep_all_cores_at_work(spark, data, fit):
    nodes, _, graph = data
    models = fit(features.bin_features(features.evidence(nodes, graph)))
    assert models.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # small partitions are not merged

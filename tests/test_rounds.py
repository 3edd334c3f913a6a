"""What the rounds of loops read, write and shuffle, however many there are."""

import random
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from tests.test_volume import shuffled
from tidegraph import queries
from tidegraph.operators import features, graphs, sequences
from tidegraph.plans import predict
from tidegraph.plans.loops import fresh, gathered, kept, settled


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("few", [0, 20_000])
def test_what_is_active_is_one_scan_after_any_number_of_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(predict, "FEW", few)
    start = settled(spark.createDataFrame([(c, c, None, datetime(2024, 1, 1), 0) for c in range(3)], "cascade_id int, user_id long, parent_id long, act_time timestamp, depth int"))
    chain = settled(spark.createDataFrame([(u, v, 0.5) for u in range(12) for v in (u - 1, u + 1)], "u long, v long, k double"))
    out = predict.ic(start, chain, [0.2, 0.4])
    assert scans(out) == 1
    got = {(r["threshold"], r["cascade_id"], r["user_id"], r["parent_id"], r["depth"]) for r in out.collect()}
    assert got == {(t, c, u, None if u == c else u + (1 if u < c else -1), abs(u - c)) for t in (0.2, 0.4) for c in range(3) for u in range(-1, 13)}


def test_fresh_rows(spark):
    found = spark.createDataFrame([(k, n) for k in "ab" for n in range(6)], "k string, n long")
    done = spark.createDataFrame([("a", 1), ("a", 1), ("b", 4), ("b", 9)], "k string, n long")
    for few in (False, True):
        assert {tuple(r) for r in fresh(found, done, ["k", "n"], few).collect()} == {(k, n) for k in "ab" for n in range(6)} - {("a", 1), ("b", 4)}


@pytest.fixture(scope="module")
def data(spark):
    """Trees in which a user comes often, as a source and as a receiver."""
    rng, rows = random.Random(4), []
    for c in range(30):
        depth = {}
        for u in rng.sample(range(12), rng.randint(3, 12)):
            up = rng.choice(sorted(depth)) if depth and rng.random() < 0.9 else None
            depth[u] = 0 if up is None else depth[up] + 1
            rows.append((f"c{c:02}", u, up, depth[u], len(depth) / 30))
    nodes = settled(spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, depth int, t double"))
    return nodes, settled(graphs.from_trees(nodes)), rows


def test_times_of_activations_need_no_trees(spark, tmp_path, monkeypatch):
    day = lambda n: datetime(2024, 1, 1, n)
    events = [(n, day(n), n % 3, "click") for n in range(9)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")

    def none(*_):
        raise AssertionError("trees")

    monkeypatch.setattr(queries.trees, "trees", none)
    got = {r["user_id"]: (r["t"], r["max_t"]) for r in queries.activation_sequence(spark, str(tmp_path)).collect()}
    assert got == {u: (round(u / 720, 9), round(8 / 720, 9)) for u in range(3)}


def test_users_who_ever_act_are_those_of_the_evidence(spark, data):
    nodes, graph, _ = data
    for some in (graph, graph.where("src % 3 > 0"), graph.where("dst < 0")):
        assert set(features.ever_active(nodes, some).collect()) == set(features.active_users(features.evidence(nodes, some)).collect())


def test_edges_are_shuffled_with_lists(spark, data):
    nodes, graph, rows = data
    act = settled(nodes.select("cascade_id", "user_id", "t", F.lit(1.0).alias("max_t")))
    t, edges = {(c, u): x for c, u, _, _, x in rows}, {tuple(r) for r in graph.select("src", "dst").collect()}
    got: list = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = shuffled(spark, lambda: got.append([{tuple(r) for r in f(act, graph).select("cascade_id", "u", "v").collect()} for f in (sequences.active_parents, sequences.exposed)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    entries = [(c, u, v) for u, v in edges for c, who in t if who == u]
    assert got[0][0] == {(c, u, v) for c, u, v in entries if (c, v) in t and t[c, u] <= t[c, v]}
    assert got[0][1] == {(c, u, v) for c, u, v in entries if (c, v) not in t}
    assert many < len(entries)  # both joins together


def test_features_lie_where_evidence_lies(spark, data):
    nodes, graph, _ = data
    ev = kept(features.evidence(nodes, graph), "evidence", "v")
    for f in (features.bin_features, lambda x: features.decayed(x, 0.5), features.long_features):
        assert shuffled(spark, lambda: f(ev).collect()) == 0
    # a source that acts in several steps adds up
    odd = gathered(spark.createDataFrame([("c", 1, d, a) for d, a in ((0, [1, 2]), (3, [2]), (4, [1, 2]))], "cascade_id string, v long, depth int, active array<int>"), "v")
    assert {(r["depth"], r["pos"]): r["x"] for r in features.decayed(odd, 0.5).collect()} == {(0, 1): 1, (0, 2): 1, (3, 1): 0.5, (3, 2): 1.5, (4, 1): 1.25, (4, 2): 1.75}

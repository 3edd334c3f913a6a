"""Trees, sequences, models and predictions on a hand-made fixture and against plain loops."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph import queries
from tidegraph.functions import scalar as C
from tidegraph.operators import cascades, clusters, evaluate, features, graphs, sampling, sequences, trees
from tidegraph.plans import em, mln, mrf, predict, seqlabel

START = datetime(2024, 1, 1)
NODES = [("c1", 1, None, 0.0, 0), ("c1", 2, 1, 0.1, 1), ("c1", 3, 2, 0.2, 2), ("c2", 1, None, 0.0, 0), ("c2", 3, 1, 0.3, 1), ("c2", 4, 3, 0.5, 2), ("c3", 2, None, 0.0, 0), ("c3", 3, 2, 0.1, 1)]
SPAN = {"c1": 0.2, "c2": 0.5, "c3": 0.1}


def when(t):
    return START + timedelta(days=30 * t)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(c, u, p, when(t), d) for c, u, p, t, d in NODES], "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int")


@pytest.fixture(scope="module")
def act(spark):
    return spark.createDataFrame([(c, u, t, SPAN[c]) for c, u, _, t, _ in NODES], "cascade_id string, user_id long, t double, max_t double")


@pytest.fixture(scope="module")
def graph(nodes):
    return graphs.from_trees(nodes)


def values(df, column):
    return {(r["u"], r["v"]): r[column] for r in df.collect()}


def test_graph_and_rond_set(act, graph):
    assert {tuple(r) for r in graph.collect()} == {(1, 2), (1, 3), (2, 3), (3, 4)}
    assert {tuple(r) for r in sequences.rond_set(act, graph).collect()} == {("c1", 4), ("c2", 2), ("c3", 4)}


def test_discrete_model(nodes, graph):
    k, n = em.fit_emic(nodes, graph)
    assert values(k, "k") == pytest.approx({(1, 2): 0.5, (1, 3): 0.5, (2, 3): 1.0, (3, 4): 1 / 3}, rel=1e-5) and n == 2


def test_penalised_model(act, graph):
    one, _ = em.fit_daic(act, graph, 1)
    assert values(one, "k") == pytest.approx({(1, 2): 0.090098, (1, 3): 0.141742, (2, 3): 0.2, (3, 4): 0.082109}, rel=1e-5)
    two, _ = em.fit_daic(act, graph, 2)
    assert values(two, "k") == pytest.approx({(1, 2): 0.090098, (1, 3): 0.136565, (2, 3): 0.157075, (3, 4): 0.082109}, rel=1e-5)


def test_continuous_model(act, graph):
    two, _ = em.fit_ctic(act, graph, 2)
    assert values(two, "k") == pytest.approx({(1, 2): 0.5, (1, 3): 0.893154, (2, 3): 1.0, (3, 4): 0.333333}, rel=1e-5)
    assert values(two, "r") == pytest.approx({(1, 2): 10.0, (1, 3): 2.650538, (2, 3): 8.940055, (3, 4): 5.0}, rel=1e-5)


def test_threshold_model(nodes, act, graph):
    one, _ = em.fit_aslt(act, graph, graphs.vertices(nodes), 1)
    w = values(one, "w")
    assert {e: w[e] for e in [(1, 2), (1, 3), (2, 3), (3, 4), (2, 2), (4, 4)]} == pytest.approx({(1, 2): 0.947622, (1, 3): 0.706714, (2, 3): 0.7075, (3, 4): 0.894427, (2, 2): 0.319393, (4, 4): 0.447214}, rel=1e-5)
    assert {r["v"]: r["r"] for r in one.select("v", "r").distinct().collect()} == pytest.approx({1: 0, 2: 2.874251, 3: 5.455372, 4: 5.0}, rel=1e-5)


def loop_tree(rows, authors):
    """First touch, one reshare after the other."""
    out = {}
    for c, post, u, ref, t, rt in sorted(rows, key=lambda r: (r[0], r[4], r[1])):
        if u == ref:
            continue
        if (c, ref) not in out:
            out[c, ref] = (None, rt)
        if (c, u) not in out:
            out[c, u] = (ref, t)
    for c, u, t in sorted(authors, key=lambda r: r[2]):
        out.setdefault((c, u), (None, t))
    return out


def test_trees_are_those_of_a_loop(spark):
    rng = np.random.default_rng(3)
    pc, rs = [], []
    for c in "abcd":
        authors = rng.integers(0, 9, size=30)
        times = [START + timedelta(seconds=int(x)) for x in np.sort(rng.integers(0, 40, size=30))]
        ids = [ord(c) * 100 + i for i in range(30)]
        pc += [(ids[i], c, int(authors[i]), times[i]) for i in range(30)]
        for i in range(1, 30):
            j = int(rng.integers(0, i))
            rs.append((ids[i], ids[j], int(authors[i]), int(authors[j]), times[i], times[j]))
    p = spark.createDataFrame(pc, "post_id long, cascade_id string, author_id long, datetime timestamp")
    r = spark.createDataFrame(rs, "post_id long, reshared_post_id long, user_id long, ref_user_id long, datetime timestamp, ref_datetime timestamp")
    owner = {i: c for i, c, *_ in pc}
    want = loop_tree([(owner[a], a, u, v, t, q) for a, _, u, v, t, q in rs], [(c, u, t) for _, c, u, t in pc])
    got = trees.trees(r, p)
    rows = got.collect()
    assert {(x["cascade_id"], x["user_id"]): (x["parent_id"], x["act_time"]) for x in rows} == want
    depth = {(x["cascade_id"], x["user_id"]): x["depth"] for x in rows}
    assert all(d == (0 if want[k][0] is None else depth[k[0], want[k][0]] + 1) for k, d in depth.items())
    assert trees.truncated(got, 1).where("depth > 1").isEmpty()
    gone = spark.createDataFrame([(3,), (5,)], "user_id long")
    kept = {(x["cascade_id"], x["user_id"]) for x in trees.pruned(got, gone).collect()}

    def stays(k):
        while k[1] is not None:
            if k[1] in (3, 5):
                return False
            k = (k[0], want[k][0])
        return True

    assert kept == {k for k in want if stays(k)}
    assert cascades.missing_nodes(got, graphs.from_trees(got)).isEmpty()


def test_cascade_prediction(nodes, graph, spark):
    par = spark.createDataFrame([(1, 2, 0.5, 10.0), (1, 3, 0.9, 2.0), (2, 3, 1.0, 9.0), (3, 4, 0.3, 5.0)], "u long, v long, k double, r double")
    out = predict.ic(trees.truncated(nodes, 0), par, [0.2, 0.4, 0.95])
    got = {(r["threshold"], r["cascade_id"], r["user_id"]): r["parent_id"] for r in out.where("depth > 0").collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 0.2 and k[1] == "c1"} == {("c1", 2): 1, ("c1", 3): 1, ("c1", 4): 3}
    assert {k[1:]: v for k, v in got.items() if k[0] == 0.4 and k[1] == "c1"} == {("c1", 2): 1, ("c1", 3): 1}
    assert {k[1:]: v for k, v in got.items() if k[0] == 0.95} == {("c3", 3): 2}
    n = [sum(k[0] == t for k in got) for t in (0.2, 0.4, 0.95)]
    assert n == sorted(n, reverse=True)


def test_threshold_prediction_adds_over_rounds(spark):
    start = spark.createDataFrame([("c", 1, None, START, 0), ("c", 2, None, START + timedelta(days=1), 0)], "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int")
    par = spark.createDataFrame([(1, 3, 0.4, 1.0), (2, 3, 0.2, 1.0), (1, 4, 0.5, 1.0), (4, 3, 0.3, 1.0), (3, 5, 0.9, 0.0)], "u long, v long, w double, r double")
    out = {(r["threshold"], r["user_id"]): (r["parent_id"], r["depth"]) for r in predict.lt(start, par, [0.5, 0.8]).collect()}
    assert out[0.5, 3] == (2, 1) and out[0.5, 4] == (1, 1) and out[0.5, 5] == (3, 2)
    assert (0.8, 4) not in out and (0.8, 3) not in out


def test_scores_of_edge_cases(spark):
    rows = [("none", 0, 0, 0, 5), ("no_truth", 0, 2, 0, 3), ("no_output", 0, 0, 2, 3), ("all", 2, 0, 0, 0)]
    got = {r["c"]: r for r in evaluate.scored(spark.createDataFrame(rows, "c string, tp int, fp int, fn int, tn int")).collect()}
    assert (got["none"]["precision"], got["none"]["recall"], got["none"]["f1"]) == (1.0, 1.0, 0.0)
    assert (got["no_truth"]["precision"], got["no_truth"]["recall"]) == (0.0, 1.0)
    assert (got["no_output"]["precision"], got["no_output"]["recall"]) == (1.0, 0.0)
    assert (got["all"]["f1"], got["all"]["fpr"], got["all"]["accuracy"]) == (1.0, 0.0, 1.0)


def test_thresholds_and_curves(spark):
    assert evaluate.grid(0.0, 1.0, 5) == [0.0, 0.25, 0.5, 0.75]
    means = spark.createDataFrame([(0.1, 0.4, 0.9, 0.8), (0.2, 0.7, 0.5, 0.6), (0.3, 0.7, 0.1, 0.3)], "threshold double, f1 double, fpr double, tpr double")
    assert tuple(evaluate.best_threshold(means).first()) == (0.2, 0.7)
    assert evaluate.auc(evaluate.roc(means)).first()["auc"] == pytest.approx(0.1 * 0.15 + 0.4 * 0.45 + 0.4 * 0.7 + 0.1 * 0.9)
    samples = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (2, 4, 6, 9)], "grp string, value double")
    assert evaluate.t_statistic(samples).first()["t"] == pytest.approx(-2.75 / (5.291667 * 0.5) ** 0.5, rel=1e-5)
    assert evaluate.one_sided_p(samples) == pytest.approx(0.0709, abs=1e-3)


def test_samples(spark):
    ids = spark.createDataFrame([(f"c{i}",) for i in range(25)], "cascade_id string")
    split = {r["cascade_id"]: r["split"] for r in sampling.train_test(ids).collect()}
    assert sum(s == "test" for s in split.values()) == round(0.3 * 25)
    assert sorted(r["fold"] for r in sampling.folds(ids).collect()) == [0] * 9 + [1] * 9 + [2] * 7
    assert sampling.sample(ids, 4, 1).collect() == sampling.sample(ids.repartition(5), 4, 1).collect()
    many = spark.range(1000).selectExpr("id * 7919 % 1009 x").repartition(7)
    got = sampling.numbered(many, "n", "x").collect()
    assert [r["n"] for r in sorted(got)] == list(range(1, 1001))
    assert sampling.numbered(many.limit(0), "n", "x").columns == ["x", "n"] and sampling.numbered(many.limit(0), "n", "x").isEmpty()


def test_features(nodes, graph):
    ev = features.evidence(nodes, graph)
    got = {(r["cascade_id"], r["v"], r["depth"]): (r["active"], r["state"]) for r in ev.collect()}
    assert got["c1", 3, 0] == ([1], 0) and got["c1", 3, 1] == ([2], 2)
    assert got["c2", 4, 1] == ([1], 1) and got["c1", 4, 2] == ([1], 0)
    bins = {(r["cascade_id"], r["v"], r["depth"]): (r["seen"], r["slack"]) for r in features.bin_features(ev).collect()}
    assert bins["c1", 3, 1] == ([1, 2], 1)
    long = {(r["cascade_id"], r["v"], r["depth"]): (r["on"], r["slack"]) for r in features.long_features(ev, 2).collect()}
    assert long["c1", 3, 1] == ([2, 3], 3)
    assert {tuple(r) for r in mrf.feature_sums(mrf.transitions(nodes, graph)).select("v", "pos", "n_active").collect()} >= {(2, 1, 1), (4, 1, 1)}


CHAIN = [("c1", i, i - 1 if i > 1 else None, 0.1 * i, i - 1) for i in range(1, 7)] + [("c2", i, i - 1 if i > 1 else None, 0.1 * i, i - 1) for i in range(1, 4)]


@pytest.fixture
def chain(spark, monkeypatch):
    """The tables of the queries are a cascade 1 to 6, each user the child of the one before, and one that stops at 3."""
    nodes = spark.createDataFrame([(c, u, p, when(t), d) for c, u, p, t, d in CHAIN], "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int")
    act = spark.createDataFrame([(c, u, t, 0.6 if c == "c1" else 0.3) for c, u, _, t, _ in CHAIN], "cascade_id string, user_id long, t double, max_t double")
    graph = graphs.from_trees(nodes)
    for name, df in (("nodes_of", nodes), ("act_of", act), ("graph_of", graph), ("evidence_of", features.evidence(nodes, graph))):
        monkeypatch.setattr(queries, name, lambda s, d, df=df: df)
    return nodes, graph


def test_histories_are_whole(spark, monkeypatch):
    ev = spark.createDataFrame([("c", 9, i, [1 + i % 2], 2, int(i == 4)) for i in range(5)] + [("d", 9, 0, [1, 2], 2, 0), ("d", 8, 0, [1], 1, 1)], "cascade_id string, v long, depth int, active array<int>, d long, state int")
    monkeypatch.setattr(queries, "evidence_of", lambda s, d: ev)
    got = {(r["cascade_id"], r["v"], r["depth"]): (r["on"], r["lags"], r["slack"]) for r in queries.long_features(spark, "").collect()}
    for c, v, depth, *_ in ev.collect():
        steps = sorted((r["depth"], r["active"]) for r in ev.collect() if (r["cascade_id"], r["v"]) == (c, v) and r["depth"] <= depth)
        d, lags = (2, 5) if v == 9 else (1, 1)
        on = sorted(p + lag * d for lag, (_, active) in enumerate(reversed(steps)) for p in active)
        assert got[c, v, depth] == (",".join(map(str, on)), lags, lags * d + 1 - len(on))
    weights = {(r["v"], r["pos"]) for r in seqlabel.fit_memm(features.long_features(ev), "on", "lags").collect()}
    assert weights == {(9, i) for i in range(11)} | {(8, 0), (8, 1)}


def test_predictions_go_on_until_no_frontier_grows(spark, chain):
    def of(f, threshold):
        return {(r["cascade_id"], r["user_id"]): (r["parent_id"], r["depth"]) for r in f(spark, "").collect() if r["threshold"] == threshold}

    want = {(c, u): (u - 1 if u > 1 else None, u - 1) for c in ("c1", "c2") for u in range(1, 7)}  # each k is 1, each w 1/2
    nodes, graph = chain
    start = trees.truncated(nodes, 1)
    ic = lambda s, d: predict.ic(start, em.initial_k(graph), [0.3])
    lt = lambda s, d: predict.lt(start, em.initial_w(graph, graphs.vertices(nodes)), [0.1])
    assert of(ic, 0.3) == of(lt, 0.1) == want
    models = seqlabel.fit_memm(features.bin_features(features.evidence(nodes, graph)))
    deep = {u for (_, u), (_, d) in of(lambda s, d: seqlabel.predict(start, graph, models, [0.3]), 0.3).items() if d > 2}
    assert deep == {4, 5, 6}


def test_fits_are_those_of_plain_loops(spark, nodes, act, graph):
    edges = [tuple(r) for r in graph.collect()]
    t = {(c, u): x for c, u, _, x, _ in NODES}
    depth = {(c, u): x for c, u, _, _, x in NODES}
    k0 = {(u, v): 1 / sum(a == u for a, _ in edges) for u, v in edges}
    tried = {(u, v): sum((c, u) in t and ((c, v) not in t or t[c, u] <= t[c, v]) for c in SPAN) for u, v in edges}
    after = [(c, u, v, t[c, v] - t[c, u]) for c in SPAN for u, v in edges if (c, u) in t and (c, v) in t and t[c, u] <= t[c, v]]
    next_ = [(c, u, v) for c, u, v, _ in after if depth[c, v] == depth[c, u] + 1]

    def inverse(k, pairs):
        p = {(c, v): 1 - np.prod([1 - k[a, b] for x, a, b, *_ in pairs if (x, b) == (c, v)]) for c, _, v, *_ in pairs}
        return {e: sum(1 / p[c, v] for c, u, v, *_ in pairs if (u, v) == e and p[c, v] > 0) for e in edges}

    k = dict(k0)
    for _ in range(20):
        s = inverse(k, next_)
        k = {e: k[e] * s[e] / sum((c, e[0]) in t for c in SPAN) for e in edges}
    assert values(em.fit_emic(nodes, graph)[0], "k") == pytest.approx(k, abs=1e-3)
    k = dict(k0)
    for _ in range(20):
        s = inverse(k, after)
        k = {e: ((b := tried[e] + 10) - max(b * b - 40 * k[e] * s[e], 0) ** 0.5) / 20 for e in edges}
    assert values(em.fit_daic(act, graph)[0], "k") == pytest.approx(k, abs=1e-3)
    k, r = dict(k0), dict.fromkeys(edges, 1 / 30)
    for _ in range(20):
        x = {(c, u, v): k[u, v] * np.exp(-r[u, v] * dt) for c, u, v, dt in after}
        b = {(c, u, v): y / (y + 1 - k[u, v]) for (c, u, v), y in x.items()}
        a = {i: r[i[1:]] * y for i, y in b.items()}
        al = {i: a[i] / sum(y for j, y in a.items() if (j[0], j[2]) == (i[0], i[2])) for i in a}
        m = {(c, u, v): (al[c, u, v], al[c, u, v] + (1 - al[c, u, v]) * b[c, u, v], dt) for c, u, v, dt in after}
        k = {e: sum(y for i, (_, y, _) in m.items() if i[1:] == e) / tried[e] for e in edges}
        r = {e: sum(w for i, (w, _, _) in m.items() if i[1:] == e) / sum(y * dt for i, (_, y, dt) in m.items() if i[1:] == e) for e in edges}
    got = em.fit_ctic(act, graph)[0]
    assert values(got, "k") == pytest.approx(k, abs=5e-3) and values(got, "r") == pytest.approx(r, rel=5e-3)


def test_registered_sequence_models_have_all_states_and_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        rows += [(f"c{c}", 5, i, sorted(set(rng.integers(1, 4, 2).tolist())), 3, 0) for i in range(2)] + [(f"c{c}", 5, 2, [c % 3 + 1], 3, c % 3 + 1 if c < 8 else 0)]
    ev = spark.createDataFrame(rows, "cascade_id string, v long, depth int, active array<int>, d long, state int")
    monkeypatch.setattr(queries, "evidence_of", lambda s, d: ev)
    got = seqlabel.fit_crf(features.bin_features(ev)).collect()
    assert {r["state"] for r in got} == {0, 1, 2, 3}
    bins = features.bin_features(ev).toPandas().sort_values("depth")
    seqs = [(np.array([[0] * 3, *([int(i in s) for i in (1, 2, 3)] for s in one["seen"])], float), np.array([0, *one["state"]])) for _, one in bins.groupby("cascade_id")]
    w = np.array([r["weight"] for k in ("emit", "move") for r in sorted(got, key=lambda r: (r["state"], r["other"])) if r["kind"] == k])
    assert np.linalg.norm(seqlabel.crf_value(w, seqs, 4)[1]) < 1e-2
    x = np.array([[int(i in s) for i in (1, 2, 3)] + [0] for s in bins["seen"]], float)
    x[:, -1] = 4 - x.sum(axis=1)
    want, rounds = seqlabel.gis(x, (bins["state"] > 0).to_numpy(), 3)
    fits = {r["pos"]: r for r in seqlabel.fit_memm(features.bin_features(ev)).collect()}
    assert [fits[p]["weight"] for p in (1, 2, 3, 0)] == pytest.approx(want) and fits[0]["iterations"] == rounds > 50


def test_scaling_matches_the_data():
    rng = np.random.default_rng(0)
    x = (rng.random((200, 3)) < 0.4).astype(float)
    x = np.column_stack([x, 4 - x.sum(axis=1)])
    y = rng.random(200) < 1 / (1 + np.exp(1 - 2 * x[:, 0]))
    lam, _ = seqlabel.gis(x, y, 1, 3000, 1e-7)
    p = 1 / (1 + np.exp(lam[-1] * 4 - x @ lam))
    assert (p[:, None] * x[:, :3]).sum(axis=0) == pytest.approx(x[y][:, :3].sum(axis=0), rel=1e-2)


def test_crf_gradient():
    rng = np.random.default_rng(1)
    seq = [((rng.random((5, 3)) < 0.5).astype(float), rng.integers(0, 2, 5)) for _ in range(3)]
    w = rng.normal(size=2 * 3 + 4)
    value, g = seqlabel.crf_value(w, seq, 2)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-6
        assert (seqlabel.crf_value(w + e, seq, 2)[0] - seqlabel.crf_value(w - e, seq, 2)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-4)
    best = seqlabel.lbfgs(lambda w: seqlabel.crf_value(w, seq, 2), w, 200, 1e-6)
    assert np.linalg.norm(seqlabel.crf_value(best, seq, 2)[1]) < 1e-3


def test_sequence_models_learn_and_predict(nodes, graph):
    models = seqlabel.fit_memm(features.bin_features(features.evidence(nodes, graph)))
    assert {r["v"] for r in models.select("v").distinct().collect()} == {2, 3, 4}
    out = seqlabel.predict(trees.truncated(nodes, 0), graph, models, [0.0])
    assert {(r["cascade_id"], r["user_id"]) for r in out.collect()} == {("c1", 1), ("c1", 2), ("c1", 3), ("c1", 4), ("c2", 1), ("c2", 2), ("c2", 3), ("c2", 4), ("c3", 2), ("c3", 3), ("c3", 4)}
    assert seqlabel.fit_crf(features.bin_features(features.evidence(nodes, graph))).where("weight is null").isEmpty()
    assert mrf.chances(mrf.transitions(nodes, graph), mrf.fit(nodes, graph, iterations=2)).where("p < 0 or p > 1").isEmpty()


def test_clusters(spark, act):
    pairs = clusters.jaccard_pairs(act)
    assert {(r["i"], r["j"]): r["sim"] for r in pairs.collect()} == pytest.approx({("c1", "c2"): 0.5, ("c1", "c3"): 2 / 3, ("c2", "c3"): 0.25})
    ids = act.select("cascade_id").distinct()
    labels = {r["cascade_id"]: r["label"] for r in clusters.connected(pairs, ids, 0.6).collect()}
    assert labels == {"c1": "c1", "c3": "c1", "c2": "c2"}


def test_scalar_functions(spark):
    row = spark.range(1).select(
        C.url_user(F.lit("HTTPS://Blog.Example.com/x?y")).alias("site"), C.url_user(F.lit("ftp://x")).alias("no"), F.length(C.truncated_url(F.lit("u" * 150))).alias("cut"),
        C.words(F.lit("Re: Hello,  World!")).alias("w"), C.padded_id(F.lit(42)).alias("id"), C.recipients(F.lit("a@x,\n\tb@y")).alias("to"), C.is_number(F.lit("۱23")).alias("num"),
        C.observation_text(F.array(F.lit(True), F.lit(False))).alias("obs"),
    ).first()
    assert row["site"] == "blog.example.com" and row["no"] is None and row["cut"] == 100 and row["w"] == ["re", "hello", "world"]
    assert row["id"] == "0" * 22 + "42" and row["to"] == ["a@x", "b@y"] and row["num"] and row["obs"] == "10"


def test_rules_and_weights(spark, nodes, graph, tmp_path):
    assert "0 !isActivated(\"N1\", c) v activates(\"N1\", \"N2\", c)" in [r["value"] for r in mln.rules(graph).collect()]
    assert any("isActivated(N1, ?c)" in r["value"] for r in mln.rules(graph, "pracmln").collect())
    text = '1.5 !isActivated("N1", v0) v activates("N1", "N2", v0)\n-0.5 !isActivated("N2", v0) v activates("N2", "N3", v0)\n////\n9 !isActivated("N3", v0) v activates("N3", "N4", v0)\n'
    (tmp_path / "out.txt").write_text(text)
    got = mln.normalised(mln.weights(spark, str(tmp_path / "out.txt"), "////"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1.0), (2, 3, 0.0)}


def test_replies(spark):
    at = lambda i: START + timedelta(minutes=i)
    rows = [(1, 10, at(0), None), (2, 11, at(1), 1), (3, 12, at(2), 2), (4, 11, at(3), 3), (5, 13, at(4), 4), (6, 14, at(5), 99), (7, 10, at(6), 1)]
    got = {(r["tweet_id"], r["cascade_id"]) for r in trees.reply_cascades(spark.createDataFrame(rows, "tweet_id long, user_id long, datetime timestamp, reply_to_id long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id int, x string, n int")
    out = cascades.upserted(base, spark.createDataFrame([(1, 7, "new")], "id int, n int, y string"), ["id"])
    assert {tuple(r) for r in out.collect()} == {(1, "a", 7, "new"), (2, "b", 5, None)}

"""How much is shuffled, and that what shuffles less gives the same rows."""

from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import evaluate
from tidegraph.plans import predict
from tidegraph.plans.loops import settled
from tidegraph.sources import readers


def shuffled(spark, job) -> int:
    """Rows that a job writes to shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages() -> dict:
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    job()
    return sum(n for k, n in stages().items() if k not in before)


def plain_lt(given: list, par: list, threshold: float) -> set:
    """One cascade: user, parent and depth of all who are active in the end. given: (user, time, depth)."""
    into = defaultdict(list)
    for u, v, w in par:
        into[v].append((u, w))
    done = {u: (None, d) for u, _, d in given}
    deepest = max(d for *_, d in given)
    front, base = {u: (t, d) for u, t, d in given if d == deepest}, defaultdict(float)
    while front:
        new = {}
        for v in into:
            tried = sorted((front[u][0], u, w) for u, w in into[v] if u in front) if v not in done else []
            total, start = 0.0, base[v]
            for t, u, w in tried:
                total += w
                base[v] = start + total
                if start + total >= threshold:
                    new[v] = (t + timedelta(days=1), front[u][1] + 1)
                    done[v] = (u, front[u][1] + 1)
                    break
        front = new
    return {(u, *x) for u, x in done.items()}


@pytest.mark.parametrize("chunk", [3, 64])
def test_threshold_prediction_shuffles_edges_not_trials(spark, monkeypatch, chunk):
    monkeypatch.setattr(predict, "CHUNK", chunk)
    rng, n, cascades = np.random.default_rng(3), 30, 40
    par = [(u, v, float(rng.integers(1, 9)) / 64) for u in range(n) for v in range(n) if u != v and rng.random() < 0.6]
    day = lambda: datetime(2024, 1, 1 + int(rng.integers(0, 3)))
    given = {f"c{i:02}": [(0, day(), 0)] + [(int(u), day(), 1) for u in rng.choice(range(1, n), 12, replace=False)] for i in range(cascades)}
    rows = [(c, u, None if d == 0 else 0, t, d) for c, some in given.items() for u, t, d in some]
    start = settled(spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int"))
    weights = settled(spark.createDataFrame([(*x, 30.0) for x in par], "u long, v long, w double, r double"))
    out: list = []

    def job() -> None:
        out.extend(predict.lt(start, weights, [0.2, 0.9, 3.0]).select("threshold", "cascade_id", "user_id", "parent_id", "depth").collect())

    many = shuffled(spark, job)
    for threshold in (0.2, 0.9, 3.0):
        for c, some in given.items():
            want = plain_lt(some, par, threshold)
            got = {(r["user_id"], None if r["depth"] <= 1 and r["user_id"] in {u for u, *_ in some} else r["parent_id"], r["depth"]) for r in out if r["threshold"] == threshold and r["cascade_id"] == c}
            assert got == want, (threshold, c)
    trials = sum(1 for r in out for u, v, _ in par if u == r["user_id"])
    assert chunk < 64 or many < trials / 2, (many, trials)


def test_rounds_read_edges_that_reach_a_threshold_only(spark, monkeypatch):
    start = settled(spark.createDataFrame([("c", 0, None, datetime(2024, 1, 1), 0)], "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int"))
    weak = spark.createDataFrame([(u, v, 0.05) for u in range(20) for v in range(100, 140)], "u long, v long, k double")
    strong = spark.createDataFrame([(u, u + 1, 0.3 if u % 2 else 0.5) for u in range(19)], "u long, v long, k double")
    kept, write = {}, predict.written
    monkeypatch.setattr(predict, "written", lambda df, name: kept.setdefault(name, []).append(write(df, name)) or kept[name][-1])
    out = predict.ic(start, weak.unionByName(strong), [0.2, 0.4])
    assert {(r["threshold"], r["user_id"]) for r in out.collect()} == {(0.2, u) for u in range(20)} | {(0.4, 0), (0.4, 1)}
    assert kept["edges"][0].count() == 19


def test_scores_meet_truth_once_for_all_thresholds(spark):
    rng, thresholds = np.random.default_rng(1), [i / 100 for i in range(60)]
    true = settled(spark.createDataFrame([(f"c{c}", u, 0 if u < 2 else 1) for c in range(8) for u in range(60)], "cascade_id string, user_id long, depth int"))
    given = true.where("depth = 0")
    rows = [(t, f"c{c}", int(u)) for t in thresholds for c in range(7) for u in rng.choice(80, 3, replace=False)]
    output = settled(spark.createDataFrame(rows, "threshold double, cascade_id string, user_id long"))
    graph = settled(spark.createDataFrame([(u, u + 1) for u in range(50)], "src long, dst long"))
    got: list = []
    many = shuffled(spark, lambda: got.extend(evaluate.nodes_metrics(output, true, given, graph, by=("threshold",)).collect()))
    assert len(got) == 8 * 60 and many < 60 * 8 * 58 / 2
    for r in got:
        o = {u for t, c, u in rows if t == r["threshold"] and c == r["cascade_id"] and u > 1}
        t = set(range(2, 60))
        tp = len(o & t)
        assert r["f1"] == pytest.approx(2 * tp / (len(o) + len(t))) and r["precision"] == pytest.approx(tp / len(o) if o else 1) and r["recall"] == pytest.approx(tp / len(t))
        fp, fn = len(o - t), len(t - o)
        tn = max(60 - tp - fp - fn, 0)  # the graph's users 0 to 50 and the later true ones 51 to 59
        assert r["fpr"] == pytest.approx(fp / (fp + tn)) and r["accuracy"] == pytest.approx((tp + tn) / (tp + tn + fp + fn))


def test_lines_stay_in_their_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "PIECE", 3, raising=False)
    (tmp_path / "a.txt").write_text("\n".join(str(i) for i in range(1, 2001)) + "\n")
    got: list = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert shuffled(spark, lambda: got.extend(readers.numbered_lines(spark, str(tmp_path)).collect())) < 500
        assert all(r["ln"] == int(r["line"]) for r in got) and len(got) == 2000
        lines = readers.raw_lines(spark, str(tmp_path))
        sums = readers.running(lines, F.sum, n=F.lit(1), s=F.col("line").cast("long"))
        top = readers.running(lines, F.max, m=F.when(F.col("line").endswith("7"), F.col("line").cast("long")))
        assert all(r["n"] == int(r["line"]) and r["s"] == r["n"] * (r["n"] + 1) // 2 for r in sums.collect())
        assert all(r["m"] == (i - (i - 7) % 10 if i >= 7 else None) for r in top.collect() for i in [int(r["line"])])
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert "__piece" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

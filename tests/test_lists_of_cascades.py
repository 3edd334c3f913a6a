"""Predictions whose lists of cascades are short."""

import random
from datetime import datetime

from tidegraph.plans import predict


def test_predictions_do_not_depend_on_lists_and_buckets(spark, monkeypatch):
    rng = random.Random(8)
    start = spark.createDataFrame([(f"c{c}", c, None, datetime(2024, 1, 1 + c), 0) for c in range(5)], "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int")
    par = [(a, b, round(rng.random(), 2), rng.random()) for a in range(12) for b in range(12) if a != b and rng.random() < 0.3]
    edges = spark.createDataFrame(par, "u long, v long, k double, r double")
    want = {tuple(r) for r in predict.ic(start, edges, [0.3, 0.6]).collect()}
    for name, value in (("CASCADES", 2), ("TARGET", 3), ("FEW", 0)):
        monkeypatch.setattr(predict, name, value)
    assert {tuple(r) for r in predict.ic(start, edges, [0.3, 0.6]).collect()} == want
    for t in (0.3, 0.6):
        for c in range(5):
            reached, front = {c}, {c}
            while front := {b for a, b, k, _ in par if a in front and k >= t} - reached:
                reached |= front
            assert {u for x, y, u, *_ in want if (x, y) == (t, f"c{c}")} == reached

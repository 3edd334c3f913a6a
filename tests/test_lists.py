"""Work that goes along edges as lists, against plain loops."""

import random

from tidegraph.operators import sequences


def test_inactive_sources_are_found_where_edges_lie(spark):
    rng = random.Random(5)
    act = {(f"c{c}", u) for c in range(6) for u in range(9) if rng.random() < 0.4}
    edges = {(a, b) for a in range(10) for b in range(10) if a != b and rng.random() < 0.3}
    table = spark.createDataFrame([(c, u, 0.0, 1.0) for c, u in act], "cascade_id string, user_id long, t double, max_t double")
    out = sequences.inactive_parents(table, spark.createDataFrame(sorted(edges), "src long, dst long"))
    rond = {(c, b) for c, a in act for x, b in edges if x == a and (c, b) not in act}
    assert sorted(tuple(r) for r in out.collect()) == sorted((c, v, a) for c, v in rond for a, b in edges if b == v and (c, a) not in act)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan  # no row of the result is shuffled to be dropped

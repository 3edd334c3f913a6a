"""Agglomeration in rounds against merging the nearest pair time after time."""

import random

import pytest

from tidegraph.operators import dendrogram


def plain(pairs, ids):
    """Merges (a, b, distance, size) in order, one nearest pair at a time."""
    w = {}
    for i, j, s in pairs:
        key = (min(i, j), max(i, j))
        w[key] = w.get(key, 0) + round(s * dendrogram.UNIT)
    weight = {c: sum(x for k, x in w.items() if c in k) for c in ids}
    size = dict.fromkeys(ids, 1)
    total, out = float(sum(weight.values())), []
    while w:
        d, a, b = min((float(weight[a]) * float(weight[b]) / float(x) / total, a, b) for (a, b), x in w.items())
        weight[a] += weight.pop(b)
        size[a] += size.pop(b)
        out.append((a, b, d, size[a]))
        old, w = w, {}
        for (x, y), n in old.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                key = (min(x, y), max(x, y))
                w[key] = w.get(key, 0) + n
    return out


def plain_cut(merges, ids, k):
    group = {c: c for c in ids}
    for a, b, _, _ in merges[: max(0, len(ids) - k)]:
        group = {c: min(group[a], group[b]) if g in (group[a], group[b]) else g for c, g in group.items()}
    tops = sorted(set(group.values()))
    over = max(0, len(tops) - k)
    return {c: max(0, tops.index(g) - over) for c, g in group.items()}


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(5)
    ids = [f"c{i:02d}" for i in range(40)]
    # three loose groups and two ids of a part of their own, one id without pairs
    pairs = [(a, b, r.uniform(0.2, 0.9) if int(a[1:]) % 3 == int(b[1:]) % 3 else r.uniform(0.01, 0.1)) for x, a in enumerate(ids[:37]) for b in ids[x + 1 : 37] if r.random() < 0.4]
    pairs.append(("c37", "c38", 0.5))
    return pairs, ids, spark.createDataFrame(pairs, "i string, j string, sim double")


def test_merges_are_those_of_the_sequence(spark, case):
    pairs, ids, df = case
    want = plain(pairs, ids)
    got = dendrogram.merges(df)
    rows = [(r["a"], r["b"], r["distance"], r["size"]) for r in got.orderBy("distance", "round", "a").collect()]
    assert rows == want and len(rows) == 37
    all_ids = spark.createDataFrame([(c,) for c in ids], "cascade_id string")
    for k in (1, 5, 50):
        labels = {r["cascade_id"]: r["label"] for r in dendrogram.cut(got, all_ids, k).collect()}
        assert labels == plain_cut(want, ids, k)
        assert len(set(labels.values())) == min(k, 40)


def test_repeated_reversed_null_and_no_pairs(spark):
    rows = [(1, 2, 0.5), (2, 1, 0.5), (3, 3, 0.9), (None, 1, 0.5), (4, 5, None), (2, 6, 0.0), (7, 8, 0.25), (7, 9, 0.25)]
    got = dendrogram.merges(spark.createDataFrame(rows, "i long, j long, sim double"))
    seen = {(r["a"], r["b"]): r["size"] for r in got.collect()}
    assert seen == {(1, 2): 2, (7, 8): 2, (7, 9): 3}  # equal distances: the smaller id first
    none = dendrogram.merges(spark.createDataFrame([], "i long, j long, sim double"))
    assert none.count() == 0
    ids = spark.createDataFrame([(1,), (2,), (2,)], "cascade_id long")
    assert {(r["cascade_id"], r["label"]) for r in dendrogram.cut(none, ids, 1).collect()} == {(1, 0), (2, 0)}
    assert dendrogram.cut(none, ids.limit(0), 3).count() == 0

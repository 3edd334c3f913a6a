"""The random field's fit where its edges lie: users are dealt over buckets, and what a half sweep sends from bucket to bucket is the states of users, not edges.

A bucket holds the edges of its users twice over, to their sources and to their receivers, with a copy of the weights each: both ends of an edge know both states, so both copies move
alike. For each bucket that has neighbours of its users it sends their states once, in the order of ids, which both know. A half sweep is one shuffle by bucket; ``TOGETHER`` of them run
before the state is written. Draws are those of plans.mrf, which has the same steps as joins.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans.loops import written

#: Edges that a bucket has about.
TARGET = 400_000
#: Half sweeps between two tables that are written.
TOGETHER = 10
#: Edges whose fields are added up at once.
AT_ONCE = 1 << 15
BITS = 64

#: A bucket's own row has no sender, its edges as body, and in moved the largest step of a user for each round since the last table; all other rows are states.
STATE = "bucket int, sender int, body binary, moved array<double>"
_ARROW = pa.schema([("bucket", pa.int32()), ("sender", pa.int32()), ("body", pa.binary()), ("moved", pa.list_(pa.float64()))])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def hashed(seed: np.ndarray, value: np.ndarray, wide: bool = False) -> np.ndarray:
    """One more column of Spark's xxhash64: an INT, or a BIGINT if wide."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    value = np.asarray(value, np.int64).astype(np.uint64)
    if wide:
        return _mixed(_turned((seed + five + np.uint64(8)) ^ (_turned(value * two, 31) * one), 27) * one + four)
    return _mixed(_turned((seed + five + np.uint64(4)) ^ ((value & np.uint64(0xFFFFFFFF)) * one), 23) * two + three)


def numbers(seed: int, slice_: int, round_: int, ids: np.ndarray, word: int) -> np.ndarray:
    """A number from 0 to 1 for each id and chain of a word."""
    h = np.full(1, 42, np.uint64)
    for x in (seed, slice_, round_):
        h = hashed(h, np.array([x]))
    h = hashed(hashed(h, ids, True), np.array([word]))
    return (hashed(h[:, None], np.arange(BITS)[None]) & np.uint64((1 << 53) - 1)).astype(float) / float(1 << 53)


def _side(own: np.ndarray, other: np.ndarray, home: np.ndarray, c: np.ndarray, words: int) -> dict[str, np.ndarray]:
    """Edges of one side in the order of own. home: the buckets of the others. near: where an edge finds the state of its other end; froms and tos: buckets, and how many states come
    from and go to each; sent: whose; itself: a user's edge to itself, or -1."""
    ids, place = np.unique(own, return_inverse=True)
    order = np.lexsort((other, home))
    new = np.ones(len(order), bool)
    new[1:] = (other[order][1:] != other[order][:-1]) | (home[order][1:] != home[order][:-1])
    near = np.empty(len(order), np.int32)
    near[order] = np.cumsum(new) - 1
    froms, n_from = np.unique(home[order][new], return_counts=True)
    pairs = np.unique(home.astype(np.int64) * max(len(ids), 1) + place)
    tos, n_to = np.unique(pairs // max(len(ids), 1), return_counts=True)
    itself = np.full(len(ids), -1)
    itself[place[own == other]] = np.flatnonzero(own == other)
    return {
        "ids": ids, "start": np.searchsorted(own, ids), "near": near, "froms": froms, "n_from": n_from, "tos": tos, "n_to": n_to, "sent": (pairs % max(len(ids), 1)).astype(np.int32),
        "itself": itself, "c": c, "w": np.ones(len(c)), "state": np.zeros((len(ids), words), np.int64),
    }


def _built(words: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        whole = {x: table[x].to_numpy() for x in ("bucket", "own", "other", "home", "pos", "c")}
        out, sides = table["receivers"].to_numpy(zero_copy_only=False), []
        for side in (False, True):
            rows = np.flatnonzero(out == side)
            rows = rows[np.lexsort((whole["other"][rows] if side else whole["pos"][rows], whole["own"][rows]))]
            sides.append(_side(*(whole[x][rows] for x in ("own", "other", "home", "c")), words))
        return _rows(int(whole["bucket"][0]), sides, [], [])

    return run


def _rows(bucket: int, sides: list[dict[str, np.ndarray]], moved: list[float], letters: list[tuple[int, bytes]]) -> pa.Table:
    to, body = [bucket, *(t for t, _ in letters)], [pickle.dumps(sides, 5), *(x for _, x in letters)]
    return pa.table([pa.array(to, pa.int32()), pa.array([None] + [bucket] * len(letters), pa.int32()), pa.array(body, pa.binary()), pa.array([moved] + [None] * len(letters), _ARROW.field("moved").type)], schema=_ARROW)


def _fields(side: dict[str, np.ndarray], states: np.ndarray) -> np.ndarray:
    """For each user and chain of a word the sum of the weights to active neighbours."""
    z, near, w = np.zeros((len(side["ids"]), BITS)), side["near"], side["w"]
    of = np.repeat(np.arange(len(side["ids"])), np.diff(np.append(side["start"], len(w))))
    for i in range(0, len(w), AT_ONCE):
        some = slice(i, i + AT_ONCE)
        on = np.unpackbits(np.ascontiguousarray(states[near[some]]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(of[some], prepend=-1))
        z[of[some][first]] += np.add.reduceat(on * w[some, None], first, axis=0)
    return z


def _half(slice_: int, round_: int, seed: int, rate: tuple[float, float] | None, clear: bool) -> Callable[[pa.Table], pa.Table]:
    """A half sweep of a bucket: the second slice (1) of receivers from the states of their sources, or the first (0) of sources. rate: eta and the number of steps where weights move."""

    def run(table: pa.Table) -> pa.Table:
        sides, moved, got = None, [], {}
        for sender, body, before in zip(table["sender"].to_pylist(), table["body"], table["moved"], strict=True):
            if sender is None:
                sides, moved = pickle.loads(body.as_buffer()), [] if clear else before.as_py()
            else:
                got[sender] = np.frombuffer(body.as_buffer(), np.int64)
        side = sides[1 - slice_]
        words = side["state"].shape[1]
        states = np.concatenate([got[b] for b in side["froms"]]).reshape(-1, words) if got else np.zeros((side["n_from"].sum(), words), np.int64)
        near, mine = side["near"], np.repeat(np.arange(len(side["ids"])), np.diff(np.append(side["start"], len(side["c"]))))

        def move() -> float:
            both = np.bitwise_count((states[near] & side["state"][mine]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            step = rate[0] * (side["c"] - rate[1] * (both / (words * BITS)))
            side["w"] = side["w"] + step
            return float(np.sqrt(np.bincount(mine, step * step)).max(initial=0.0))

        if rate and not slice_:
            move()
        new = np.empty_like(side["state"])
        with np.errstate(over="ignore"):
            for k in range(words):
                up = numbers(seed, slice_, round_, side["ids"], k) < 1 / (1 + np.exp(-_fields(side, states[:, k])))
                new[:, k] = np.packbits(up, axis=1, bitorder="little").view(np.int64)[:, 0]
        has = side["itself"] >= 0
        own = states[near[side["itself"][has]]]
        new[has] = new[has] | own if slice_ else new[has] & own
        side["state"] = new
        if rate and slice_:
            moved = [*moved, move()]
        ends = np.cumsum(side["n_to"])
        letters = [(int(b), new[side["sent"][end - n : end]].tobytes()) for b, n, end in zip(side["tos"], side["n_to"], ends, strict=True)]
        return _rows(table["bucket"][0].as_py(), sides, moved, letters)

    return run


def _told(table: pa.Table) -> pa.Table:
    side = pickle.loads(table["body"][0].as_buffer())[0]
    many = np.diff(np.append(side["start"], len(side["w"])))
    pos = np.arange(len(side["w"])) - np.repeat(side["start"], many)
    return pa.table({"v": pa.array(np.repeat(side["ids"], many), pa.int64()), "pos": pa.array(pos, pa.int32()), "weight": side["w"]})


def weights(field: DataFrame, many: int, iterations: int, eta: float, eps: float, words: int, burn: int, seed: int = 0) -> DataFrame:
    """v, pos, weight after gradient ascent from weights of 1. field: u, v, pos, c with all positions of a receiver from 0 on; many: steps that c counts at most. See mrf.fit."""
    spark = field.sparkSession
    field = written(field, "field")
    buckets = max(-(-field.count() // TARGET), spark.sparkContext.defaultParallelism)
    at = lambda user: F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")
    ends = lambda own, other, side: field.select(at(own).alias("bucket"), F.col(own).alias("own"), F.col(other).alias("other"), at(other).alias("home"), "pos", "c", F.lit(side).alias("receivers"))
    gone = lambda df, run, kind: df.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(run, kind)
    state = written(gone(ends("v", "u", False).unionByName(ends("u", "v", True)), _built(words), STATE), "buckets")
    plan = [(slice_, r) for r in range(burn + iterations) for slice_ in (1, 0)][:-1] if iterations else []

    def run(state: DataFrame, some: list[tuple[int, int]]) -> DataFrame:
        for i, (slice_, r) in enumerate(some):
            state = gone(state, _half(slice_, r, seed, (eta, float(many)) if r >= burn else None, i == 0), STATE)
        return written(state, "buckets")

    for i in range(0, len(plan), TOGETHER):
        some = plan[i : i + TOGETHER]
        new = run(state, some)
        learnt = [at for at, (slice_, r) in enumerate(some) if slice_ and r >= burn]
        largest = dict(new.where("sender is null").select(F.posexplode("moved").alias("i", "n")).groupBy("i").agg(F.max("n")).collect())
        still = [at for k, at in enumerate(learnt) if largest.get(k, 0.0) < eps]
        if still:
            state = new if still[0] == len(some) - 1 else run(state, some[: still[0] + 1])
            break
        state = new
    return state.where("sender is null").groupBy("bucket").applyInArrow(_told, "v long, pos int, weight double")

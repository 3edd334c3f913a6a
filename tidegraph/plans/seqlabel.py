"""Sequence models of receivers: maximum-entropy Markov models by iterative scaling and linear-chain CRFs, a model for each user.

Training reads one user's sequences at a time; prediction is a frontier loop of joins with the models' weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.plans import frontier, observations
from tidegraph.plans.loops import spread, written

WEIGHTS = "v long, pos int, weight double, n_active int, iterations int"


def gis(x: np.ndarray, active: np.ndarray, n_active: int, most: int = 500, stop: float = 1e-4, size: int | None = None) -> tuple[np.ndarray, int]:
    """Weights of a model whose active states share the features x and whose inactive state has the slack alone; all features of a row sum to a constant. size: how many
    features there are, where those that no row has are left out of x (their weights stay 0)."""
    total = x.sum(axis=1)[0]
    wanted = x[active].sum(axis=0)
    wanted[-1] += np.count_nonzero(~active) * total
    wanted = np.log(np.where(wanted == 0, 1e-10, wanted))
    lam, few, bias = np.zeros(x.shape[1]), stop * np.sqrt(size or x.shape[1]), np.log(n_active)
    for i in range(1, most + 1):
        # the idle state has the slack alone, with the whole sum of a row as its value
        p = np.clip(lam[-1] * total - x @ lam - bias, -700, 700)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        have = p @ x
        have[-1] += (len(p) - p.sum()) * total
        have[have == 0] = 1e-10
        change = (wanted - np.log(have)) / total
        lam += change
        if np.sqrt(change @ change) < few:
            break
    return lam, i


def _matrix(on: pd.Series, d: int, slack: pd.Series) -> np.ndarray:
    x = np.zeros((len(on), d + 1))
    if len(on):
        x[np.repeat(np.arange(len(on)), [len(places) for places in on]), np.concatenate([np.asarray(places, dtype=int) for places in on]) - 1] = 1
    x[:, -1] = slack
    return x


def fit_memm(features: DataFrame, column: str = "seen", width: int | str = 1, iterations: int = 500, stop: float = 1e-4) -> DataFrame:
    """v, pos (0: slack), weight, n_active, iterations; users who never act have no model. features: bin_features, or long_features with
    column="on" and width="lags", its number of lags."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        active = (df["state"] > 0).to_numpy()
        if not active.any():
            return pd.DataFrame([], columns=["v", "pos", "weight", "n_active", "iterations"])
        df = df.sort_values(["cascade_id", "depth"], kind="stable")
        d = int(df["d"].iloc[0]) * (int(df[width].iloc[0]) if isinstance(width, str) else width)
        n_active = int(df.loc[df["state"] > 0, "state"].nunique())
        used = np.unique(np.concatenate([np.asarray(x, dtype=int) for x in df[column]]))
        x = _matrix(df[column].map(lambda on: np.searchsorted(used, on) + 1), len(used), df["slack"])
        few, i = gis(x, (df["state"] > 0).to_numpy(), n_active, iterations, stop, d + 1)
        lam = np.zeros(d + 1)
        lam[np.append(used - 1, d)] = few
        return pd.DataFrame({"v": df["v"].iloc[0], "pos": [*range(1, d + 1), 0], "weight": lam, "n_active": n_active, "iterations": i})

    return spread(features, "v").groupBy("v").applyInPandas(run, WEIGHTS)


#: Receivers whose rounds run side by side in one set of arrays.
ABREAST = 8
#: w: weights by position, that of the slack at 0.
PACKED_MEMM = "v long, w array<double>, n_active int, iterations int"


@dataclass
class Scaled:
    """Rows of some receivers, numbered from 0, all with an active row. row and feature by entry, in the order of rows, at least one in each; whose by feature (no feature is without an entry); who, active and slack by row;
    total (the sum of a row), n_active and size (how many features there are) by receiver."""

    row: np.ndarray
    feature: np.ndarray
    whose: np.ndarray
    who: np.ndarray
    active: np.ndarray
    slack: np.ndarray
    total: np.ndarray
    n_active: np.ndarray
    size: np.ndarray


def gis_abreast(s: Scaled, most: int = 500, stop: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gis of several receivers at once: weights by feature, those of the slacks and rounds by receiver. Who has come to an end keeps its weights."""
    by_row, by_who, by_whose = (np.flatnonzero(observations.ranks(x)) for x in (s.row, s.who, s.whose))
    order = np.argsort(s.feature, kind="stable")
    rows, by_feature = s.row[order], np.flatnonzero(observations.ranks(s.feature[order]))
    n = np.diff(np.append(by_who, len(s.who)))

    def expected(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = np.add.reduceat(p.take(rows), by_feature)
        rest = np.add.reduceat(p * s.slack, by_who) + (n - np.add.reduceat(p, by_who)) * s.total
        have[have == 0] = rest[rest == 0] = 1e-10
        return have, rest

    want, want_slack = (np.log(x) for x in expected(s.active.astype(float)))
    lam, slack, few, bias = np.zeros(len(s.whose)), np.zeros(len(n)), stop * np.sqrt(s.size), np.log(s.n_active)
    total, rounds, going = s.total[s.whose], np.full(len(n), most), np.ones(len(n), bool)
    for i in range(1, most + 1):
        p = (slack * s.total - bias).take(s.who)
        p -= slack.take(s.who) * s.slack
        p -= np.add.reduceat(lam.take(s.feature), by_row)
        np.clip(p, -700, 700, out=p)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        have, rest = expected(p)
        change, change_slack = (want - np.log(have)) / total, (want_slack - np.log(rest)) / s.total
        if not going.all():
            change *= going[s.whose]
            change_slack *= going
        lam += change
        slack += change_slack
        over = going & (np.sqrt(np.add.reduceat(change * change, by_whose) + change_slack * change_slack) < few)
        if over.any():
            rounds[over] = i
            going &= ~over
            if not going.any():
                break
    return lam, slack, rounds


def _heads(s: observations.Steps) -> np.ndarray:
    """Where the steps of each receiver begin, and the end."""
    return np.append(np.searchsorted(s.who, np.arange(len(s.v))), len(s.who))


def _memms(s: observations.Steps, long: bool, two_states: bool, most: int, stop: float) -> pa.Table:
    kind = pa.schema([("v", pa.int64()), ("w", pa.list_(pa.float64())), ("n_active", pa.int32()), ("iterations", pa.int32())])
    row, on = s.history(long)
    active = s.state > 0
    heads = _heads(s)
    entries = np.searchsorted(row, heads)
    here = [i for i in range(len(s.v)) if active[heads[i] : heads[i + 1]].any()]
    if not here:
        return kind.empty_table()
    lags = np.ones(len(s.v), np.int64)
    if long:
        np.maximum.at(lags, s.who[np.cumsum(s.sizes) - 1], s.sizes)
    width = lags * s.d
    states = np.array([1 if two_states else len(np.unique(x[x > 0])) for x in (s.state[heads[i] : heads[i + 1]] for i in here)])
    values, rounds = [], []
    for k in range(0, len(here), ABREAST):
        some = np.array(here[k : k + ABREAST])
        rows = np.concatenate([np.arange(heads[i], heads[i + 1]) for i in some])
        mine = np.concatenate([np.arange(entries[i], entries[i + 1]) for i in some])
        who = np.repeat(np.arange(len(some)), heads[some + 1] - heads[some])
        r = np.searchsorted(rows, row[mine])
        span = width[some].max() + 1
        used, feature = np.unique(who[r] * span + on[mine], return_inverse=True)
        slack = (width[some] + 1)[who] - np.bincount(r, minlength=len(rows))
        size = width[some] + 1
        lam, rest, i = gis_abreast(Scaled(r, feature, used // span, who, active[rows], slack.astype(float), size.astype(float), states[k : k + ABREAST], size), most, stop)
        start = np.cumsum(size) - size
        w = np.zeros(size.sum())
        w[start], w[start[used // span] + used % span] = rest, lam
        values.append(w)
        rounds.append(i)
    ends = np.append(0, np.cumsum(width[here] + 1))
    return pa.table([pa.array(s.v[here]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values))), pa.array(states), pa.array(np.concatenate(rounds))], names=kind.names).cast(kind)


def fit_memm_at(nodes: DataFrame, edges: DataFrame, long: bool = False, two_states: bool = False, iterations: int = 500, stop: float = 1e-4) -> DataFrame:
    """PACKED_MEMM: fit_memm of the features that evidence(nodes, edges) has, made where a receiver's edges lie."""
    return observations.fitted(nodes, edges, lambda s: _memms(s, long, two_states, iterations, stop), PACKED_MEMM)


def memm_rows(packed: DataFrame) -> DataFrame:
    """The rows of fit_memm from PACKED_MEMM."""
    return packed.select("v", F.posexplode("w").alias("pos", "weight"), "n_active", "iterations")


def binary(features: DataFrame) -> DataFrame:
    """features with the states 0 and 1 only, whoever is the parent."""
    return features.withColumn("state", (F.col("state") > 0).cast("int"))


def predict(initial: DataFrame, edges: DataFrame, models: DataFrame, thresholds: list[float], max_step: int | None = None, long: bool = False, two_states: bool = False) -> DataFrame:
    """threshold, cascade_id, user_id, parent_id, depth, probability, from models of fit_memm on bin_features (or with ``long``, on long_features), or PACKED_MEMM; see frontier.expand."""
    packed = models if "w" in models.columns else written(frontier.dense(models, F.first("n_active").alias("n_active")), "models")
    return frontier.expand(initial, edges, packed, frontier.memm_judge(long, two_states), thresholds, max_step)


def predict_crf(initial: DataFrame, edges: DataFrame, models: DataFrame, thresholds: list[float], max_step: int | None = None, long: bool = False, two_states: bool = False) -> DataFrame:
    """The same from models of fit_crf, or PACKED_CRF."""
    packed = models if "states" in models.columns else written(crf_packed(models), "models")
    return frontier.expand(initial, edges, packed, frontier.crf_judge(long, two_states), thresholds, max_step)


# linear-chain CRFs


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int = 100, eps: float = 1e-4, memory: int = 6) -> np.ndarray:
    """A minimum of f, which gives value and gradient, by limited-memory BFGS with backtracking."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.linalg.norm(g) <= eps * max(1.0, np.linalg.norm(x)):
            break
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        step = 1.0
        while True:
            trial = x - step * q
            v, h = f(trial)
            if v <= value - 1e-4 * step * (g @ q) or step < 1e-10:
                break
            step /= 2
        if (h - g) @ (trial - x) > 1e-12:
            pairs = [*pairs, (trial - x, h - g)][-memory:]
        x, value, g = trial, v, h
    return x


#: Pairs that a CRF's fit keeps; fewer take more rounds.
MEMORY = 20
#: Sequences that are worked on at once.
TOGETHER = 256


@dataclass
class Chains:
    """Sequences step by step: the rows of step t, those of the longest sequences first, are start[t] to start[t + 1], so a sequence has the same place in all its steps. before: of each
    row that has a step before, in order, the row of that."""

    x: np.ndarray
    start: np.ndarray
    before: np.ndarray


def chains(x: np.ndarray, sizes: np.ndarray) -> list[Chains]:
    """x: rows of features of all sequences, one after the other; sizes: how many rows each has. ``TOGETHER`` sequences of like lengths at a time."""
    order, first, out = np.argsort(-sizes, kind="stable"), np.cumsum(sizes) - sizes, []
    for i in range(0, len(order), TOGETHER):
        some = order[i : i + TOGETHER]
        many = [np.count_nonzero(sizes[some] > t) for t in range(sizes[some[0]])]
        start = np.cumsum([0, *many])
        rows = np.concatenate([first[some[:n]] + t for t, n in enumerate(many)])
        out.append(Chains(x[rows], start, np.concatenate([start[t] + np.arange(n) for t, n in enumerate(many[1:])] or [np.zeros(0, int)])))
    return out


def seen_sums(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, n_states: int, led: bool) -> np.ndarray:
    """What the states y of the sequences add up to by weight: features by state, then moves between states."""
    emit, move = np.zeros((n_states, x.shape[1])), np.zeros((n_states, n_states))
    for state in np.unique(y):
        emit[state] = x[y == state].sum(axis=0)
    opens = np.zeros(len(y), bool)
    opens[np.cumsum(sizes) - sizes] = True
    np.add.at(move, (y[:-1][~opens[1:]], y[1:][~opens[1:]]), 1)
    if led:
        np.add.at(move[0], y[opens], 1)
    return np.concatenate([emit.ravel(), move.ravel()])


def chains_value(weights: np.ndarray, blocks: list[Chains], seen: np.ndarray, n_states: int, c2: float, led: bool) -> tuple[float, np.ndarray]:
    """Negative log-likelihood with a squared penalty, and its gradient. seen: seen_sums. led: before the first row of each sequence is an empty observation in state 0.
    Chances are scaled to a sum of 1 at each step; where they leave the range of numbers the value is infinite."""
    d = blocks[0].x.shape[1]
    emit, move = weights[: n_states * d].reshape(n_states, d), weights[n_states * d :].reshape(n_states, n_states)
    ge, gm, value = np.zeros_like(emit), np.zeros_like(move), c2 * float(weights @ weights) - float(weights @ seen)
    big = move.max()
    m = np.exp(move - big)
    reach = m.mean(axis=0) if led else np.ones(n_states)
    with np.errstate(all="ignore"):
        for b in blocks:
            step = [slice(i, j) for i, j in zip(b.start, b.start[1:])]  # noqa: B905  one less
            n = b.start[1]
            e = b.x @ emit.T
            top = e.max(axis=1)
            e -= top[:, None]
            np.exp(e, out=e)
            f, c = np.empty_like(e), np.empty(len(e))
            for t, at in enumerate(step):
                now = np.multiply(e[at], f[step[t - 1]][: at.stop - at.start] @ m if t else reach, out=f[at])
                now.sum(axis=1, out=c[at])
                now /= c[at, None]
            # e turns into the chances of a row and of all after it, by what leads to the row
            e /= c[:, None]
            p = f.copy()
            for t in range(len(step) - 1, 0, -1):
                at, up = step[t], slice(step[t - 1].start, step[t - 1].start + step[t].stop - step[t].start)
                back = e[at] @ m.T
                p[up] *= back
                e[up] *= back
            value += float(np.log(c).sum() + top.sum() + big * (len(e) - n) + n * (np.log(n_states) + big) * led)
            ge += p.T @ b.x
            gm += f[b.before].T @ e[n:]
            if led:
                gm += e[:n].sum(axis=0) / n_states
    g = np.concatenate([ge.ravel(), (m * gm).ravel()])
    g += 2 * c2 * weights
    g -= seen
    return value if np.isfinite(value) else np.inf, g


def crf_value(weights: np.ndarray, sequences: list[tuple[np.ndarray, np.ndarray]], n_states: int, c2: float = 1.0) -> tuple[float, np.ndarray]:
    """chains_value of sequences, each (features by step, states by step)."""
    x, y, sizes = np.concatenate([x for x, _ in sequences]), np.concatenate([y for _, y in sequences]), np.array([len(y) for _, y in sequences])
    return chains_value(weights, chains(x, sizes), seen_sums(x, y, sizes, n_states, False), n_states, c2, False)


CRF = "v long, kind string, state int, other int, weight double"
#: w: weights of features by state, then of moves between states; states and used (the features) in ascending order.
PACKED_CRF = "v long, states array<int>, used array<int>, w array<double>"


def _crf(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, n: int, c2: float, iterations: int) -> np.ndarray:
    blocks, seen = chains(x, sizes), seen_sums(x, y, sizes, n, True)
    return lbfgs(lambda w: chains_value(w, blocks, seen, n, c2, True), np.zeros(n * x.shape[1] + n * n), iterations, memory=MEMORY)


def _crfs(s: observations.Steps, long: bool, two_states: bool, c2: float, iterations: int) -> pa.Table:
    kind = pa.schema([("v", pa.int64()), ("states", pa.list_(pa.int32())), ("used", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))])
    row, on = s.history(long)
    state = np.minimum(s.state, 1) if two_states else s.state
    heads = _heads(s)
    entries, seqs = np.searchsorted(row, heads), np.searchsorted(s.seq[heads[:-1]], np.arange(len(s.sizes)), side="right") - 1
    out: list[list] = [[], [], [], []]
    for i, v in enumerate(s.v):
        first, last, mine = heads[i], heads[i + 1], slice(entries[i], entries[i + 1])
        if first == last or not state[first:last].any():
            continue
        used, place = np.unique(on[mine], return_inverse=True)
        x = np.zeros((last - first, len(used)))
        x[row[mine] - first, place] = 1
        names, y = np.unique(np.append(0, state[first:last]), return_inverse=True)
        for part, value in zip(out, (v, names, used, _crf(x, y[1:], s.sizes[seqs == i], len(names), c2, iterations)), strict=True):
            part.append(value)
    return pa.table([pa.array(part, f.type) for part, f in zip(out, kind, strict=True)], schema=kind)


def fit_crf_at(nodes: DataFrame, edges: DataFrame, long: bool = False, two_states: bool = False, c2: float = 1.0, iterations: int = 100) -> DataFrame:
    """PACKED_CRF: fit_crf of the features that evidence(nodes, edges) has, made where a receiver's edges lie."""
    return observations.fitted(nodes, edges, lambda s: _crfs(s, long, two_states, c2, iterations), PACKED_CRF)


def crf_rows(packed: DataFrame) -> DataFrame:
    """The rows of fit_crf from PACKED_CRF."""
    n, d, i = F.size("states"), F.size("used"), F.col("i")
    emit, j = i < n * d, i - n * d
    of = lambda values, k: F.get(values, k.cast("int"))
    state = F.when(emit, of("states", F.floor(i / d))).otherwise(of("states", F.floor(j / n)))
    other = F.when(emit, of("used", i % d)).otherwise(of("states", F.pmod(j, n)))
    rows = packed.select("v", "states", "used", F.posexplode("w").alias("i", "weight"))
    return rows.select("v", F.when(emit, "emit").otherwise("move").alias("kind"), state.alias("state"), other.alias("other"), "weight")


def crf_packed(rows: DataFrame) -> DataFrame:
    """PACKED_CRF from the rows of fit_crf."""
    names = lambda kind, c: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col(c))))
    weights = F.array_sort(F.collect_list(F.struct("kind", "state", "other", "weight")))  # emit before move
    return rows.groupBy("v").agg(names("move", "state").alias("states"), names("emit", "other").alias("used"), weights.alias("x")).select("v", "states", "used", F.col("x.weight").alias("w"))


def fit_crf(features: DataFrame, column: str = "seen", c2: float = 1.0, iterations: int = 100) -> DataFrame:
    """v, kind (emit or move), state, other (feature or next state), weight; features that a receiver never has are left out, their weight is 0.
    Each sequence starts with an empty observation in state 0. features: bin_features, or long_features with column="on"."""

    def run(table: pa.Table) -> pa.Table:
        kind = pa.schema([("v", pa.int64()), ("kind", pa.string()), ("state", pa.int32()), ("other", pa.int32()), ("weight", pa.float64())])
        if not pc.max(table["state"]).as_py():
            return kind.empty_table()
        table = table.sort_by([("cascade_id", "ascending"), ("depth", "ascending")])
        lists = table[column].combine_chunks()
        used, place = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        x = np.zeros((len(table), len(used)))
        x[np.repeat(np.arange(len(table)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), place] = 1
        names, y = np.unique(np.append(0, table["state"].to_numpy()), return_inverse=True)
        y, n, d = y[1:], len(names), len(used)
        cascade = table["cascade_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], cascade[1:] != cascade[:-1], [True]])))
        w = _crf(x, y, sizes, n, c2, iterations)
        columns = {
            "v": pa.repeat(table["v"][0].as_py(), len(w)),
            "kind": pa.concat_arrays([pa.repeat("emit", n * d), pa.repeat("move", n * n)]),
            "state": np.concatenate([np.repeat(names, d), np.repeat(names, n)]),
            "other": np.concatenate([np.tile(used, n), np.tile(names, n)]),
            "weight": w,
        }
        return pa.table(columns).cast(kind)

    return spread(features.select("v", "cascade_id", "depth", "state", column), "v").groupBy("v").applyInArrow(run, CRF)

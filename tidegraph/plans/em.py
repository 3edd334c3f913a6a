"""Models of spreading, fitted by expectation maximisation, each step a few joins and aggregations.

Parameters are rows: (u, v, k), (u, v, k, r), or (u, v, w) with (v, r). All rounds of a receiver run where its rows lie (plans.receivers). Receivers with very many rows go
through ``step`` functions, which map parameters to parameters by joins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalar import guarded
from tidegraph.operators import sequences as S
from tidegraph.plans import receivers
from tidegraph.plans.loops import bucketed, slots, written
from tidegraph.plans.receivers import LARGEST

By = tuple[str, ...]


def initial_k(edges: DataFrame, by: By = ()) -> DataFrame:
    """u, v, k = 1 / out-degree of u."""
    out = edges.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("n"))
    return edges.join(out, [*by, "src"]).select(*by, F.col("src").alias("u"), F.col("dst").alias("v"), (1 / F.col("n")).alias("k"))


def changes(new: DataFrame, old: DataFrame, value: str, key: list[str], by: By = ()) -> DataFrame:
    """by, moved: the Frobenius norm of the difference; what one side lacks is 0."""
    both = new.select(*by, *key, F.col(value).alias("__x")).join(old.select(*by, *key, F.col(value).alias("__y")), [*by, *key], "full")
    d = F.coalesce("__x", F.lit(0.0)) - F.coalesce("__y", F.lit(0.0))
    return both.groupBy(*by).agg(F.sqrt(F.sum(d * d)).alias("moved"))


def _squares(tables: list[DataFrame], values: dict[str, list[str]], by: By) -> DataFrame:
    """by, value, i, square of the rounds of a loop. values: the key of each."""
    parts = [
        changes(*(x.select(*by, *key, value).distinct() if key != ["u", "v"] else x for x in (new, old)), value, key, by).select(*by, F.lit(value).alias("value"), F.lit(i).alias("i"), (F.col("moved") * F.col("moved")).alias("square"))
        for i, (old, new) in enumerate(zip(tables, tables[1:], strict=False), 1)
        for value, key in values.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _fit(kernel: receivers.Kernel, rule: receivers.Rule, acts: DataFrame, edges: DataFrame, users: DataFrame | None, values: dict[str, tuple[float, list[str]]], stop: float, most: int, by: By, hot: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, int]:
    """Parameters, and after how many rounds: at most ``most``, fewer once the change falls below stop. by: columns of cases side by side, each with a stop of its own.

    acts: by, cascade_id, user_id, t (and rest). edges: by, u, v and what the kernel reads. values: the names of the parameters, their weight in the change and the key that they
    depend on. hot: from by and v of receivers with very many rows to the start and the step of a loop over their edges.
    """
    more = [c for c in ("rest",) if c in acts.columns]
    lists = receivers.activity(acts, by, "t", *more)
    crowd, entries = receivers.crowded(lists, edges, by)
    ids = (edges.select(*by, F.col("v").alias("id")).distinct() if users is None else users).join(crowd.withColumnRenamed("v", "id"), [*by, "id"], "left_anti")
    path = receivers.paths(lists, edges.join(crowd, [*by, "v"], "left_anti"), ids, entries, kernel, rule, tuple(values), most, by)
    sums, tables = receivers.squares(path, tuple(values), by), []
    if not crowd.isEmpty():
        start, step = hot(crowd)
        tables = [written(start, "start")]
        for _ in range(most):
            tables.append(written(step(tables[-1]), "round"))
        sums = sums.unionByName(_squares(tables, {c: key for c, (_, key) in values.items()}, by))
    ends = receivers.last_rounds(sums, {c: w for c, (w, _) in values.items()}, stop, most, by)
    ending = lambda df: df.join(F.broadcast(ends), list(by)) if by else df.crossJoin(F.broadcast(ends))  # noqa: E731  a row for each case
    out = [ending(path.where("u is not null")).select(*by, "u", "v", *[F.element_at(c, F.col("i")).alias(c) for c in values])]
    out += [ending(x).where(F.col("i") == i).select(*by, "u", "v", *values) for i, x in enumerate(tables) if i]
    return reduce(DataFrame.unionByName, out), ends.agg(F.max("i")).first()[0] or 1


def _times(act: DataFrame, by: By) -> DataFrame:
    return act.select(*by, "cascade_id", "user_id", "t")


def _not_later(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u <= v


def _crowded(edges: DataFrame, crowd: DataFrame, by: By) -> DataFrame:
    return edges.join(crowd.withColumnRenamed("v", "dst"), [*by, "dst"], "left_semi")


# discrete steps: a user can be activated by the users one level above


def emic_trials(nodes: DataFrame, edges: DataFrame, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """(cascade_id, u, v) with v one level below u, and (u, v, n_all): cascades with u."""
    a = nodes.select(*by, "cascade_id", F.col("user_id").alias("u"), (F.col("depth") + 1).alias("depth"))
    b = nodes.select(*by, "cascade_id", F.col("user_id").alias("v"), "depth")
    e = edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"))
    pos = a.join(e, [*by, "u"]).join(b, [*by, "cascade_id", "v", "depth"]).select(*by, "cascade_id", "u", "v")
    every = nodes.groupBy(*by, F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("n_all"))
    return pos, e.join(every, [*by, "u"]).select(*by, "u", "v", "n_all")


def laid(trials: DataFrame, name: str, hot: int | None = None) -> DataFrame:
    """Rows (cascade_id, u, v) of a fit, hashed by receiver once: no round shuffles them. Of a receiver with very many rows the cascades are dealt over slots; what is
    summed by cascade and receiver stays in a slot, what is summed by edge is added up over them."""
    return bucketed(slots(trials, "v", "cascade_id", hot), name)


def slots_of(pos: DataFrame) -> DataFrame:
    """v, slot: where the rows of each receiver lie."""
    return written(pos.select("v", "slot").distinct(), "slots")


def _placed(par: DataFrame, places: DataFrame) -> DataFrame:
    """Parameters of edges beside the rows of their receivers, once for each slot."""
    return par.join(places, "v")


def _inverse_success(pos: DataFrame, k: DataFrame, places: DataFrame, by: By = ()) -> DataFrame:
    """u, v, s: the sum of 1 / P over the positive cascades, P the chance that one of the parents succeeds."""
    given = pos.join(_placed(k, places), [*by, "slot", "u", "v"])
    p = given.groupBy(*by, "slot", "cascade_id", "v").agg((1 - F.product(1 - F.col("k"))).alias("p"))
    s = F.sum(F.when(F.col("p") == 0, 0.0).otherwise(1 / F.col("p"))).alias("s")
    part = pos.join(p, [*by, "slot", "cascade_id", "v"]).groupBy(*by, "slot", "u", "v").agg(s)
    return part.groupBy(*by, "u", "v").agg(F.sum("s").alias("s"))


def emic_step(k: DataFrame, pos: DataFrame, places: DataFrame, tried: DataFrame, by: By = ()) -> DataFrame:
    """u, v, k; 0 where no cascade is positive. pos: laid()."""
    s = _inverse_success(pos, k, places, by)
    return tried.join(k, [*by, "u", "v"]).join(s, [*by, "u", "v"], "left").select(*by, "u", "v", (F.col("k") * F.coalesce("s", F.lit(0.0)) / F.col("n_all")).alias("k"))


def fit_emic(nodes: DataFrame, edges: DataFrame, iterations: int = 20, stop: float = 1e-4, by: By = ()) -> tuple[DataFrame, int]:
    """by: columns of nodes and edges; a fit for each case, all in one loop."""
    k = initial_k(edges, by)

    def hot(crowd: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        pos, tried = emic_trials(nodes, _crowded(edges, crowd, by), by)
        pos, tried = laid(pos, "levels"), written(tried, "tried")
        places = slots_of(pos)
        return k.join(crowd, [*by, "v"], "left_semi").select(k.columns), lambda now: emic_step(now, pos, places, tried, by)

    levels = nodes.select(*by, "cascade_id", "user_id", F.col("depth").cast("double").alias("t"))
    return _fit(receivers.emic, lambda u, v: v == u + 1, levels, k, None, {"k": (1.0, ["u", "v"])}, stop, iterations, by, hot)


# continuous times with a penalty


def daic_step(k: DataFrame, ap: DataFrame, places: DataFrame, tried: DataFrame, penalty: float = 10.0, by: By = ()) -> DataFrame:
    """u, v, k: the smaller root of the penalised equation; a negative discriminant counts as 0. tried: u, v, n_pos, n_neg, and penalty where it differs by case."""
    s = _inverse_success(ap.select(*by, "slot", "cascade_id", "u", "v"), k, places, by)
    weight = F.col("penalty") if "penalty" in tried.columns else F.lit(penalty)
    beta = F.col("n_pos") + F.col("n_neg") + weight
    gamma = F.col("k") * F.coalesce("s", F.lit(0.0))
    under = beta * beta - 4 * weight * gamma
    root = F.when((F.abs(under) < 1e-10) | (under < 0), 0.0).otherwise(under)
    return tried.join(k, [*by, "u", "v"]).join(s, [*by, "u", "v"], "left").select(*by, "u", "v", ((beta - F.sqrt(root)) / (2 * weight)).alias("k"))


def fit_daic(act: DataFrame, edges: DataFrame, iterations: int = 20, stop: float = 1e-4, penalty: float = 10.0, by: By = ()) -> tuple[DataFrame, int]:
    """by: as fit_emic; edges may have a column penalty that depends on the case."""
    k, cases = initial_k(edges, by), edges.select(*by, "penalty").distinct() if "penalty" in edges.columns else None

    def hot(crowd: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        few = _crowded(edges, crowd, by)
        ap, tried = laid(S.active_parents(act, few, by), "active"), S.trials(act, few, by)
        if cases is not None:
            tried = tried.join(cases, list(by))
        tried, places = written(tried, "tried"), slots_of(ap)
        return k.join(crowd, [*by, "v"], "left_semi").select(k.columns), lambda now: daic_step(now, ap, places, tried, penalty, by)

    given = k.withColumn("penalty", F.lit(float(penalty))) if cases is None else k.join(cases.withColumn("penalty", F.col("penalty").cast("double")), list(by)).select(*k.columns, "penalty")
    return _fit(receivers.daic, _not_later, _times(act, by), given, None, {"k": (1.0, ["u", "v"])}, stop, iterations, by, hot)


# continuous times with rates


def ctic_step(par: DataFrame, ap: DataFrame, places: DataFrame, tried: DataFrame, by: By = ()) -> DataFrame:
    """u, v, k, r; edges without a positive cascade drop out. ap: laid()."""
    dt = guarded(F.col("dt"))
    given = ap.join(_placed(par, places), [*by, "slot", "u", "v"]).withColumn("dt", dt).withColumn("x", F.col("k") * F.exp(-F.col("r") * F.col("dt")))
    within = Window.partitionBy(*by, "slot", "cascade_id", "v")
    base = F.col("x") + 1 - F.col("k")
    weighed = given.withColumns({"beta": F.col("x") / base, "a": F.col("r") * F.col("x") / base}).withColumns({"sum_a": F.sum("a").over(within), "n": F.count(F.lit(1)).over(within)})
    alpha = F.when(F.col("n") == 1, 1.0).when(F.col("sum_a") == 0, 0.0).otherwise(F.col("a") / F.col("sum_a"))
    spread = weighed.withColumn("alpha", alpha).withColumn("m", F.col("alpha") + (1 - F.col("alpha")) * F.col("beta"))
    part = spread.groupBy(*by, "slot", "u", "v").agg(F.sum("alpha").alias("sa"), F.sum("m").alias("sm"), F.sum(F.col("m") * F.col("dt")).alias("st"))
    sums = part.groupBy(*by, "u", "v").agg(*[F.sum(c).alias(c) for c in ("sa", "sm", "st")])
    return sums.join(tried, [*by, "u", "v"]).select(*by, "u", "v", (F.col("sm") / (F.col("n_pos") + F.col("n_neg"))).alias("k"), F.when(F.col("st") == 0, 0.0).otherwise(F.col("sa") / F.col("st")).alias("r"))


def fit_ctic(act: DataFrame, edges: DataFrame, iterations: int = 20, stop: float = 2e-4, by: By = ()) -> tuple[DataFrame, int]:
    """by: as fit_emic."""
    k = initial_k(edges, by)

    def hot(crowd: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        few = _crowded(edges, crowd, by)
        ap, tried = laid(S.active_parents(act, few, by), "active"), written(S.trials(act, few, by), "tried")
        places = slots_of(ap)
        return k.join(crowd, [*by, "v"], "left_semi").select(*k.columns, F.lit(1 / 30).alias("r")), lambda now: ctic_step(now, ap, places, tried, by)

    return _fit(receivers.ctic, _not_later, _times(act, by), k, None, {"k": (1.0, ["u", "v"]), "r": (1 / 90000, ["u", "v"])}, stop, iterations, by, hot)


# thresholds with delays: self weights are rows with u = v


def initial_w(edges: DataFrame, users: DataFrame) -> DataFrame:
    """u, v, w, r: w = 1 / (in-degree + 1), self weights included, and r = 1/30 of each v. users: id."""
    indeg = edges.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    all_v = users.select(F.col("id").alias("v")).join(indeg, "v", "left").fillna(0, ["n"])
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(all_v.select(F.col("v").alias("u"), "v"))
    return pairs.join(all_v, "v").select("u", "v", (1 / (F.col("n") + 1)).alias("w"), F.lit(1 / 30).alias("r"))


def aslt_h(par: DataFrame, act: DataFrame, ap: DataFrame) -> DataFrame:
    """cascade_id, v, h: 1 for those who act first."""
    s = ap.join(par, ["u", "v"]).groupBy("cascade_id", "v").agg((F.max("r") * F.sum(F.col("w") * F.exp(-F.col("r") * guarded(F.col("dt"))))).alias("s"))
    all_ = act.select("cascade_id", F.col("user_id").alias("v"), "t").join(s, ["cascade_id", "v"], "left")
    return all_.select("cascade_id", "v", F.when(F.col("t") == 0, 1.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("h"))


def aslt_g(par: DataFrame, ex: DataFrame) -> DataFrame:
    """cascade_id, v, g for the rond set. ex: exposed().

    Of v's sources those that are active are in ex, so the weight of the others is the weight of all less theirs: inactive sources are never made as rows.
    """
    whole = par.groupBy("v").agg(F.sum("w").alias("whole"))
    less = ex.join(par, ["u", "v"]).groupBy("cascade_id", "v").agg(F.sum(F.col("w") * F.expm1(-F.col("r") * F.col("dt"))).alias("less"))
    return less.join(whole, "v").select("cascade_id", "v", F.greatest(F.col("whole") + F.col("less"), F.lit(0.0)).alias("g"))


def aslt_step(par: DataFrame, ap: DataFrame, ex: DataFrame, at: DataFrame, ex_at: DataFrame) -> DataFrame:
    """u, v, w, r from the rates and weights before; columns of w have length 1. ap (with first: whether v acts first of all) and ex: laid(); at and ex_at: their slots_of().

    A source that is inactive in a cascade of v's rond set, and v itself, add w / g there; summed over cascades that is w times the sum of 1 / g, less those in which the source is active.
    Densities h and chances g are sums over the rows of a cascade and receiver, which lie in one slot; only sums by edge leave it.
    """
    dt, w, r = F.col("dt"), F.col("w"), F.col("r")
    within = Window.partitionBy("slot", "cascade_id", "v")
    tops, bottoms, masses = (lambda x: F.sum(x).alias("top")), (lambda x: F.sum(x).alias("bottom")), (lambda x: F.sum(x).alias("y"))
    seen = ap.join(_placed(par, at), ["slot", "u", "v"]).withColumn("s", F.max("r").over(within) * F.sum(w * F.exp(-r * guarded(dt))).over(within))
    seen = seen.withColumn("h", F.when(F.col("first"), 1.0).otherwise(F.col("s"))).where("h > 0")
    phi = w * r * F.exp(-r * guarded(dt)) / F.col("h")
    acts = seen.groupBy("slot", "u", "v").agg(tops(phi), bottoms(phi * guarded(dt, 1 / 1440)), masses(phi))
    whole = par.groupBy("v").agg(F.sum("w").alias("whole"))
    rest = ex.join(_placed(par.join(whole, "v"), ex_at), ["slot", "u", "v"]).withColumn("less", F.sum(w * F.expm1(-r * dt)).over(within))
    rest = rest.withColumn("g", F.greatest(F.col("whole") + F.col("less"), F.lit(0.0))).where("g > 0")
    psi = w * F.exp(-r * dt) / F.col("g")
    waits = rest.groupBy("slot", "u", "v").agg(F.lit(0.0).alias("top"), bottoms(psi * dt), masses(w * F.expm1(-r * dt) / F.col("g")))
    sums = acts.unionByName(waits).groupBy("u", "v").agg(*[F.sum(c).alias(c) for c in ("top", "bottom", "y")])
    top, bottom = F.sum("top"), F.sum("bottom")
    rate = sums.groupBy("v").agg(F.when(top == 0, 0.0).when(bottom == 0, LARGEST).otherwise(top / bottom).alias("rate"))
    quiet = rest.groupBy("slot", "cascade_id", "v").agg(F.first("g").alias("g")).groupBy("v").agg(F.sum(1 / F.col("g")).alias("quiet"))
    every = par.select("u", "v", "w").join(sums.select("u", "v", "y"), ["u", "v"], "left").join(quiet, "v", "left")
    every = every.withColumn("x", F.greatest(F.coalesce("y", F.lit(0.0)) + w * F.coalesce("quiet", F.lit(0.0)), F.lit(0.0)))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("v")))
    return every.withColumn("len", length).join(rate, "v", "left").select("u", "v", F.when(F.col("len") == 0, 0.0).otherwise(F.col("x") / F.col("len")).alias("w"), F.coalesce("rate", F.lit(0.0)).alias("r"))


def fit_aslt(act: DataFrame, edges: DataFrame, users: DataFrame, iterations: int = 2, stop: float = 2e-4) -> tuple[DataFrame, int]:
    def hot(crowd: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        first, few = act.select("cascade_id", F.col("user_id").alias("v"), (F.col("t") == 0).alias("first")), _crowded(edges, crowd, ())
        ap, ex = laid(S.active_parents(act, few).join(first, ["cascade_id", "v"]), "active"), laid(S.exposed(act, few), "exposed")
        at, ex_at = slots_of(ap), slots_of(ex)
        start = initial_w(edges, users)
        return start.join(crowd, "v", "left_semi").select(start.columns), lambda now: aslt_step(now, ap, ex, at, ex_at)

    given = act.select("cascade_id", "user_id", "t", (F.col("max_t") - F.col("t")).alias("rest"))
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return _fit(receivers.aslt, _not_later, given, ends, users.select("id"), {"w": (1.0, ["u", "v"]), "r": (1 / 90000, ["v"])}, stop, iterations, (), hot)

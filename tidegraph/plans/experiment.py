"""Train, predict and score: the methods by name, threshold tuning over folds, random search, and comparison of methods."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import evaluate, graphs, sampling, trees
from tidegraph.plans import em, mrf, predict, seqlabel
from tidegraph.plans.loops import settled, written


@dataclass
class Data:
    """Trees and activations of some cascades."""

    nodes: DataFrame
    act: DataFrame

    def of(self, ids: DataFrame) -> Data:
        keep = ids.select("cascade_id")
        return Data(self.nodes.join(keep, "cascade_id", "left_semi"), self.act.join(keep, "cascade_id", "left_semi"))


Fit = Callable[..., DataFrame]
Predict = Callable[[DataFrame, DataFrame, DataFrame, list[float], int | None], DataFrame]


def _ic(initial: DataFrame, graph: DataFrame, par: DataFrame, thresholds: list[float], max_step: int | None) -> DataFrame:
    return predict.ic(initial, par, thresholds, max_step)


def _lt(initial: DataFrame, graph: DataFrame, par: DataFrame, thresholds: list[float], max_step: int | None) -> DataFrame:
    return predict.lt(initial, par, thresholds, max_step)


def _sequences(crf: bool, long: bool, two_states: bool) -> tuple[Fit, Predict]:
    """A model of receivers on cumulative or whole observations, with a state for each parent or two states."""

    def fit(data: Data, graph: DataFrame, packed: bool = False, **constants: float) -> DataFrame:
        out = (seqlabel.fit_crf_at if crf else seqlabel.fit_memm_at)(data.nodes, graph, long, two_states, **constants)
        return out if packed else (seqlabel.crf_rows if crf else seqlabel.memm_rows)(out)

    def forecast(initial: DataFrame, graph: DataFrame, par: DataFrame, thresholds: list[float], max_step: int | None) -> DataFrame:
        return (seqlabel.predict_crf if crf else seqlabel.predict)(initial, graph, par, thresholds, max_step, long, two_states)

    return fit, forecast


#: For each method, how it is fitted on (data, graph, **constants) and how it predicts.
METHODS: dict[str, tuple[Fit, Predict]] = {
    "emic": (lambda d, g, **c: em.fit_emic(d.nodes, g, **c)[0], _ic),
    "daic": (lambda d, g, **c: em.fit_daic(d.act, g, **c)[0], _ic),
    "ctic": (lambda d, g, **c: em.fit_ctic(d.act, g, **c)[0], _ic),
    "aslt": (lambda d, g, **c: em.fit_aslt(d.act, g, graphs.vertices(d.nodes), **c)[0], _lt),
    "unimrf": (lambda d, g, **c: mrf.fit(d.nodes, g, **c), mrf.predict),
}
for _crf in (False, True):
    for _long in (False, True):
        for _two in (False, True):
            METHODS[("" if _two else "m") + ("l" if _long else "b") + ("crf" if _crf else "memm")] = _sequences(_crf, _long, _two)


def compact(method: str) -> dict[str, bool]:
    """What to give a fit for the form of its models that its prediction reads best: a row for each receiver, with lists."""
    return {"packed": True} if method.endswith(("memm", "crf")) else {}


def parsed(tokens: list[list[str]]) -> dict[str, float | int | str | tuple[float, float]]:
    """Parameters of a command line: a name and a value, or a name and the two ends of a range to be tuned."""

    def number(x: str) -> float | int | str:
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                pass
        return x

    out: dict = {}
    for name, *values in tokens:
        if len(values) not in (1, 2):
            raise ValueError(f"{name} takes a value or two ends")
        out[name] = number(values[0]) if len(values) == 1 else (float(values[0]), float(values[1]))
    return out


def scores(method: str, data: Data, train: DataFrame, test: DataFrame, thresholds: list[float], init_depth: int = 0, max_depth: int | None = None, on: str = "nodes", max_step: int | None = None, **constants: float) -> DataFrame:
    """threshold, cascade_id and metrics of the test cascades (cascade_id); those no deeper than init_depth have nulls."""
    fit, forecast = METHODS[method]
    known = data.of(train)
    graph = settled(graphs.from_trees(known.nodes))
    par = written(fit(known, graph, **compact(method), **constants), "fitted")
    true = settled(data.of(test).nodes)
    deep = true.groupBy("cascade_id").agg(F.max("depth").alias("d")).where(F.col("d") > init_depth).select("cascade_id")
    usable = true.join(deep, "cascade_id", "left_semi")
    initial = trees.truncated(usable, init_depth)
    out = forecast(initial, graph, par, thresholds, max_step)
    measure = evaluate.nodes_metrics if on == "nodes" else evaluate.edges_metrics
    got = measure(out, usable, initial, graph, max_depth, ("threshold",))
    shallow = true.select("cascade_id").distinct().join(deep, "cascade_id", "left_anti")
    grid = data.nodes.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    empty = shallow.crossJoin(F.broadcast(grid)).select(*[F.lit(None).cast("double").alias(c) if c in evaluate.METRICS else F.col(c) for c in got.columns])  # few thresholds
    return got.unionByName(empty)


def _folds(train: DataFrame, k: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    dealt = settled(sampling.folds(train, k))
    for i in range(k):
        yield dealt.where(F.col("fold") != i).select("cascade_id"), dealt.where(F.col("fold") == i).select("cascade_id")


#: How the models that predict by probabilities of edges are fitted on (nodes, activations, graph) with columns that keep cases apart.
SIDE_BY_SIDE: dict[str, Callable[..., DataFrame]] = {
    "emic": lambda n, a, g, **c: em.fit_emic(n, g, **c)[0],
    "daic": lambda n, a, g, **c: em.fit_daic(a, g, **c)[0],
    "ctic": lambda n, a, g, **c: em.fit_ctic(a, g, **c)[0],
}


def cases(method: str, data: Data, train: DataFrame, drawn: DataFrame, folds: int = 3, init_depth: int = 0, max_depth: int | None = None, on: str = "nodes", max_step: int | None = None, **constants: float) -> DataFrame:
    """draw, fold, threshold, cascade_id and metrics: every draw on every fold of train, in one fit and one prediction.

    drawn: draw, threshold and, where it is drawn, penalty; a row for each threshold of a draw. Fold and draw are columns of the loops' tables, so a round is one job whatever
    their number, and draws that have converged leave the fit. Draws without a penalty share their fit.
    """
    dealt = settled(sampling.folds(train, folds))
    every = data.nodes.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    known = settled(dealt.withColumnRenamed("fold", "own").crossJoin(F.broadcast(every)).where("own <> fold").select("fold", "cascade_id"))  # folds: few
    nodes, act = (written(x.join(known, "cascade_id"), "fold") for x in (data.nodes, data.act))
    graph = written(nodes.where("parent_id is not null").select("fold", F.col("parent_id").alias("src"), F.col("user_id").alias("dst")).distinct(), "graphs")
    by: tuple[str, ...] = ("fold",)
    case_nodes, case_act, case_graph = nodes, act, graph
    if "penalty" in drawn.columns:
        by = ("fold", "draw")
        one = F.broadcast(drawn.select("draw", "penalty").distinct())  # draws: few
        case_nodes, case_act, case_graph = nodes, act.crossJoin(one.drop("penalty")), graph.crossJoin(one)
    par = SIDE_BY_SIDE[method](case_nodes, case_act, case_graph, by=by, **constants)
    true = written(data.nodes.join(dealt, "cascade_id"), "held")
    deep = true.groupBy("cascade_id").agg(F.max("depth").alias("d")).where(F.col("d") > init_depth).select("cascade_id")
    usable = settled(true.join(deep, "cascade_id", "left_semi"))
    given = trees.truncated(usable, init_depth)
    out = predict.ic(given.crossJoin(F.broadcast(drawn.select("draw", "threshold"))), par, [], max_step, ("fold", "draw"))  # draws: few
    measure = evaluate.nodes_metrics if on == "nodes" else evaluate.edges_metrics
    scored = [measure(*(x.where(F.col("fold") == f) for x in (out, usable, given, graph)), max_depth, ("draw", "threshold")).withColumn("fold", F.lit(f)) for f in range(folds)]
    return reduce(DataFrame.unionByName, scored)


def tune(method: str, data: Data, train: DataFrame, thresholds: list[float], folds: int = 3, **options) -> tuple[float, DataFrame]:
    """The threshold with the best mean f1 over the folds of train, and the means of all."""
    if method in SIDE_BY_SIDE:
        drawn = data.nodes.sparkSession.createDataFrame([(0, float(t)) for t in thresholds], "draw int, threshold double")
        every = cases(method, data, train, drawn, folds, **options)
    else:
        every = reduce(DataFrame.unionByName, [scores(method, data, a, b, thresholds, **options) for a, b in _folds(train, folds)])
    means = settled(evaluate.mean_metrics(every, ("threshold",)))
    return evaluate.best_threshold(means).first()["threshold"], means


def draws(ranges: dict[str, tuple[float, float]], iterations: int, seed: int = 0) -> list[dict[str, float]]:
    """Uniform draws of the parameters."""
    rng = random.Random(seed)
    return [{k: rng.uniform(*r) for k, r in sorted(ranges.items())} for _ in range(iterations)]


def search(method: str, data: Data, train: DataFrame, ranges: dict[str, tuple[float, float]], iterations: int = 100, seed: int = 0, folds: int = 3, **options) -> tuple[dict[str, float], float]:
    """The best of ``iterations`` uniform draws of the parameters in ranges, and its mean f1 (the first of equals); a range named threshold is one of them.

    Models of SIDE_BY_SIDE whose only drawn constant is the penalty are fitted for all draws at once, others one after the other.
    """
    made = draws(ranges, iterations, seed)
    if method in SIDE_BY_SIDE and set(ranges) <= {"threshold", "penalty"} and ("penalty" not in ranges or method == "daic"):
        fields = [c for c in ("penalty",) if c in ranges]
        drawn = data.nodes.sparkSession.createDataFrame([(i, d.get("threshold", 0.5), *[d[c] for c in fields]) for i, d in enumerate(made)], ", ".join(["draw int", "threshold double", *[f"{c} double" for c in fields]]))
        found = evaluate.mean_metrics(cases(method, data, train, drawn, folds, **options), ("draw",)).select("draw", F.coalesce("f1", F.lit(0.0)).alias("f1"))
        top = found.agg(F.max(F.struct("f1", -F.col("draw"))).alias("x")).first()["x"]
        return (made[-top[1]], top[0]) if top else ({}, -1.0)
    best, most = {}, -1.0
    for drawn in made:
        constants = {k: v for k, v in drawn.items() if k != "threshold"}
        _, means = tune(method, data, train, [drawn.get("threshold", 0.5)], folds, **constants, **options)
        f1 = means.first()["f1"] or 0.0
        if f1 > most:
            best, most = drawn, f1
    return best, most


def compare(methods: list[str], data: Data, train: DataFrame, test: DataFrame, threshold: float, settings: list[tuple[int, int | None]]) -> DataFrame:
    """method, init_depth, max_depth and mean metrics for each method and pair of depths."""
    out = None
    for method in methods:
        for init, most in settings:
            means = evaluate.mean_metrics(scores(method, data, train, test, [threshold], init, most)).select(F.lit(method).alias("method"), F.lit(init).alias("init_depth"), F.lit(most).cast("int").alias("max_depth"), "*")
            out = means if out is None else out.unionByName(means)
    return out


def side_by_side(true: DataFrame, out: DataFrame, cascade_id: str) -> str:
    """The true and the predicted tree of one cascade as indented text."""

    def text(rows: list) -> list[str]:
        children: dict = {}
        for r in rows:
            children.setdefault(r["parent_id"], []).append(r["user_id"])
        lines, queue = [], [(u, 0) for u in sorted(children.get(None, []), reverse=True)]
        while queue:
            u, depth = queue.pop()
            lines.append("  " * depth + str(u))
            queue += [(c, depth + 1) for c in sorted(children.get(u, []), reverse=True)]
        return lines

    a, b = (text(x.where(F.col("cascade_id") == cascade_id).select("user_id", "parent_id").collect()) for x in (true, out))
    width = max([len(x) for x in a] + [8])
    a, b = a + [""] * (len(b) - len(a)), b + [""] * (len(a) - len(b))
    return "\n".join(f"{x:<{width}} | {y}" for x, y in zip(a, b, strict=True))

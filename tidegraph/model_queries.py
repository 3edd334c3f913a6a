"""Queries of the models of spreading, of predictions with them and of scores of these, and SQL that unrolls their loops.

The SQL of a fit has all its rounds and a flag that holds the parameters once a change falls below the stop; that of a prediction has more rounds than frontiers
grow on the tables that it is run on (each further round is empty).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import evaluate, graphs, sequences, trees
from tidegraph.plans import em, experiment, predict
from tidegraph.queries import _ACT, _CASC, _K0, R, _once, act_of, cascades_of, fitted_of, graph_of, nodes_of, query

# fits


def _inverse(k: str, pos: str) -> str:
    return f"""p_{k} AS MATERIALIZED (SELECT cascade_id, v, 1 - product(1 - k) AS p FROM {pos} JOIN {k} USING (u, v) GROUP BY 1, 2),
s_{k} AS MATERIALIZED (SELECT u, v, sum(CASE WHEN p = 0 THEN 0 ELSE 1 / p END) AS s FROM {pos} JOIN p_{k} USING (cascade_id, v) GROUP BY 1, 2)"""


def _norm(a: str, b: str, value: str, key: str = "u, v") -> str:
    return f"(SELECT coalesce(sqrt(sum(power(coalesce(a.{value}, 0) - coalesce(b.{value}, 0), 2))), 0) FROM {a} a FULL JOIN {b} b USING ({key}))"


def _loop(name: str, start: str, step: Callable[[str], tuple[str, str]], change: Callable[[str, str], str], stop: float, rounds: int) -> str:
    """Tables name0 to name<rounds>. step gives, for the table before, other tables and the SQL of the next."""
    out = [f"{name}0 AS MATERIALIZED ({start}), done_{name}0 AS (SELECT false AS done)"]
    for i in range(rounds):
        now, new, flag = f"{name}{i}", f"new_{name}{i + 1}", f"(SELECT done FROM done_{name}{i})"
        more, sql = step(now)
        out.append(f"{more}, {new} AS MATERIALIZED ({sql}), {name}{i + 1} AS MATERIALIZED (FROM {new} WHERE NOT {flag} UNION ALL FROM {now} WHERE {flag}), done_{name}{i + 1} AS MATERIALIZED (SELECT {flag} OR {change(new, now)} < {stop} AS done)")
    return ", ".join(out)


_LEVELS = """sp AS MATERIALIZED (SELECT a.cascade_id, g.src AS u, g.dst AS v FROM nodes a JOIN g ON g.src = a.user_id JOIN nodes b ON b.cascade_id = a.cascade_id AND b.user_id = g.dst AND b.depth = a.depth + 1),
na AS MATERIALIZED (SELECT g.src AS u, g.dst AS v, n FROM g JOIN (SELECT user_id, count(*) AS n FROM nodes GROUP BY 1) ON user_id = g.src)"""
_EMIC = f"""{_K0}, {_LEVELS}, {_loop("em", "FROM k0", lambda k: (_inverse(k, "sp"), f"SELECT u, v, k * coalesce(s, 0) / n AS k FROM na JOIN {k} USING (u, v) LEFT JOIN s_{k} USING (u, v)"), lambda a, b: _norm(a, b, "k"), 1e-4, 20)}"""


@query(f"{R}{_ACT}, {_K0} SELECT u, v, round(k, 9) AS k FROM k0")
def emic_init(s: SparkSession, d: str) -> DataFrame:
    """Starting probabilities (M3)."""
    return em.initial_k(graph_of(s, d)).withColumn("k", F.round("k", 9))


@query(f"{R}{_ACT}, {_EMIC} SELECT u, v, round(k, 6) AS k FROM em20")
def emic_fit(s: SparkSession, d: str) -> DataFrame:
    """The discrete cascade model until it stops, 20 rounds at most."""
    return fitted_of("emic")(s, d).withColumn("k", F.round("k", 6))


def _daic_step(k: str) -> tuple[str, str]:
    more = f"{_inverse(k, 'ap')}, q_{k} AS (SELECT u, v, n_pos + n_neg + 10.0::DOUBLE AS b, k * coalesce(s, 0) AS c FROM tried JOIN {k} USING (u, v) LEFT JOIN s_{k} USING (u, v))"
    return more, f"SELECT u, v, (b - sqrt(CASE WHEN b * b - 40 * c < 1e-10 THEN 0 ELSE b * b - 40 * c END)) / 20 AS k FROM q_{k}"


_DAIC = f"""{_K0}, {_loop("da", "FROM k0", _daic_step, lambda a, b: _norm(a, b, "k"), 1e-4, 20)}"""


@query(f"{R}{_ACT}, {_DAIC} SELECT u, v, round(k, 6) AS k FROM da20")
def daic_fit(s: SparkSession, d: str) -> DataFrame:
    """The penalised cascade model until it stops, 20 rounds at most (M4)."""
    return fitted_of("daic")(s, d).withColumn("k", F.round("k", 6))


_DAY = "CASE WHEN dt = 0 THEN CAST(1 AS DOUBLE) / 43200 ELSE dt END"


def _ctic_step(c: str) -> tuple[str, str]:
    more = f"""x_{c} AS (SELECT cascade_id, u, v, d, k, r, k * exp(-r * d) AS x FROM (SELECT cascade_id, u, v, {_DAY} AS d FROM ap) JOIN {c} USING (u, v)),
y_{c} AS (SELECT *, x / (x + 1 - k) AS b, r * x / (x + 1 - k) AS a FROM x_{c}), z_{c} AS (SELECT *, sum(a) OVER w AS sa, count(*) OVER w AS n FROM y_{c} WINDOW w AS (PARTITION BY cascade_id, v)),
m_{c} AS (SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN sa = 0 THEN 0.0 ELSE a / sa END AS al FROM z_{c})"""
    return more, f"SELECT u, v, sum(al + (1 - al) * b) / any_value(n_pos + n_neg) AS k, CASE WHEN sum((al + (1 - al) * b) * d) = 0 THEN 0 ELSE sum(al) / sum((al + (1 - al) * b) * d) END AS r FROM m_{c} JOIN tried USING (u, v) GROUP BY 1, 2"


_CTIC = f"""{_K0}, {_loop("ct", "SELECT u, v, k, CAST(1 AS DOUBLE) / 30 AS r FROM k0", _ctic_step, lambda a, b: f"({_norm(a, b, 'r')} / 90000 + {_norm(a, b, 'k')})", 2e-4, 20)}"""


@query(f"{R}{_ACT}, {_CTIC} SELECT u, v, round(k, 5) AS k, round(r, 3) AS r FROM ct20")
def ctic_fit(s: SparkSession, d: str) -> DataFrame:
    """The continuous-time cascade model until it stops, 20 rounds at most (M2)."""
    return fitted_of("ctic")(s, d).select("u", "v", F.round("k", 5).alias("k"), F.round("r", 3).alias("r"))


_W0 = "vs AS (SELECT DISTINCT user_id AS v FROM nodes), ind AS (SELECT vs.v, count(g.src) AS n FROM vs LEFT JOIN g ON g.dst = vs.v GROUP BY 1)"
_START_W = "SELECT u, v, CAST(1 AS DOUBLE) / (n + 1) AS w, CAST(1 AS DOUBLE) / 30 AS r FROM (SELECT src AS u, dst AS v FROM g UNION ALL SELECT v, v FROM vs) JOIN ind USING (v)"


def _densities(w: str) -> str:
    return f"""hs_{w} AS (SELECT cascade_id, v, max(r) * sum(w * exp(-r * {_DAY})) AS s FROM ap JOIN {w} USING (u, v) GROUP BY 1, 2),
h_{w} AS MATERIALIZED (SELECT a.cascade_id, a.user_id AS v, CASE WHEN a.t = 0 THEN 1.0 ELSE coalesce(s, 0) END AS h FROM act a LEFT JOIN hs_{w} hs ON hs.cascade_id = a.cascade_id AND hs.v = a.user_id),
gg_{w} AS MATERIALIZED (SELECT cascade_id, v, sum(x) AS gv FROM (SELECT cascade_id, v, w * exp(-r * dt) AS x FROM ex JOIN {w} USING (u, v) UNION ALL SELECT cascade_id, v, w FROM ip JOIN {w} USING (u, v) UNION ALL SELECT cascade_id, v, w FROM (SELECT DISTINCT cascade_id, v FROM ex) JOIN (SELECT v, w FROM {w} WHERE u = v) USING (v)) GROUP BY 1, 2)"""


def _aslt_step(w: str) -> tuple[str, str]:
    more = f"""{_densities(w)}, ph_{w} AS MATERIALIZED (SELECT u, v, w * r * exp(-r * {_DAY}) / h AS x, CASE WHEN dt = 0 THEN CAST(1 AS DOUBLE) / 1440 ELSE dt END AS d FROM ap JOIN {w} USING (u, v) JOIN h_{w} USING (cascade_id, v) WHERE h > 0),
ps_{w} AS MATERIALIZED (SELECT u, v, w * exp(-r * dt) / gv AS x, dt AS d FROM ex JOIN {w} USING (u, v) JOIN gg_{w} USING (cascade_id, v) WHERE gv > 0),
pg_{w} AS MATERIALIZED (SELECT u, v, w / gv AS x FROM (SELECT cascade_id, u, v FROM ip UNION ALL SELECT DISTINCT cascade_id, v, v FROM ex) JOIN {w} USING (u, v) JOIN gg_{w} USING (cascade_id, v) WHERE gv > 0),
m_{w} AS (SELECT u, v, sum(x) AS x FROM (SELECT u, v, x FROM ph_{w} UNION ALL SELECT u, v, x FROM ps_{w} UNION ALL SELECT u, v, x FROM pg_{w}) GROUP BY 1, 2),
rt_{w} AS (SELECT v, CASE WHEN sum(a) = 0 THEN 0 WHEN sum(b) = 0 THEN {em.LARGEST} ELSE sum(a) / sum(b) END AS r FROM (SELECT v, x AS a, x * d AS b FROM ph_{w} UNION ALL SELECT v, 0, x * d FROM ps_{w}) GROUP BY 1),
e_{w} AS (SELECT w.u, w.v, coalesce(m.x, 0) AS x FROM {w} w LEFT JOIN m_{w} m USING (u, v)), l_{w} AS (SELECT v, sqrt(sum(x * x)) AS l FROM e_{w} GROUP BY 1)"""
    return more, f"SELECT e.u, e.v, CASE WHEN l = 0 THEN 0 ELSE x / l END AS w, coalesce(r, 0) AS r FROM e_{w} e JOIN l_{w} USING (v) LEFT JOIN rt_{w} USING (v)"


def _aslt_change(a: str, b: str) -> str:
    rates = _norm(f"(SELECT DISTINCT v, r FROM {a})", f"(SELECT DISTINCT v, r FROM {b})", "r", "v")
    return f"({rates} / 90000 + {_norm(a, b, 'w')})"


_ASLT = f"{_W0}, {_loop('as', _START_W, _aslt_step, _aslt_change, 2e-4, 2)}"
_DENSITY = f"{_ACT}, {_W0}, w0 AS ({_START_W}), {_densities('w0')}"


@query(f"{R}{_DENSITY} SELECT cascade_id, v, round(h, 8) AS h FROM h_w0")
def aslt_h(s: SparkSession, d: str) -> DataFrame:
    """Densities of activations (M1)."""
    act, g = act_of(s, d), graph_of(s, d)
    par = em.initial_w(g, graphs.vertices(nodes_of(s, d)))
    return em.aslt_h(par, act, sequences.active_parents(act, g)).withColumn("h", F.round("h", 8))


@query(f"{R}{_DENSITY} SELECT cascade_id, v, round(gv, 8) AS g FROM gg_w0")
def aslt_g(s: SparkSession, d: str) -> DataFrame:
    """Chances to stay inactive (M1)."""
    act, g = act_of(s, d), graph_of(s, d)
    par = em.initial_w(g, graphs.vertices(nodes_of(s, d)))
    return em.aslt_g(par, sequences.exposed(act, g)).withColumn("g", F.round("g", 8))


@query(f"{R}{_ACT}, {_ASLT} SELECT u, v, round(w, 6) AS w, round(r, 4) AS r FROM as2")
def aslt_fit(s: SparkSession, d: str) -> DataFrame:
    """The threshold model with delays, the reference's two rounds."""
    return fitted_of("aslt")(s, d).select("u", "v", F.round("w", 6).alias("w"), F.round("r", 4).alias("r"))


# prediction: roots and their children are given

_THR = (0.1, 0.3)
#: Rounds of the SQL, more than frontiers grow at any of the given sizes.
_ROUNDS = 30
_ORDER = "(epoch_us(f.act_time), f.user_id)"
_NODE = "cascade_id, user_id, parent_id, act_time, depth"


def _received(t: str, r: str) -> str:
    return f"make_timestamp(epoch_us({t}) + CAST(round((CASE WHEN {r} > 0 THEN least(1 / {r}, 24.0::DOUBLE) ELSE 24.0::DOUBLE END) * 2592000 * 1000000) AS BIGINT))"


def _start(thresholds: tuple[float, ...], by: str = "", settings: str = "") -> str:
    """init, th, d0 and f0. by: further columns of the state with a comma before, which settings (a table with depth_given) gives."""
    given = f"SELECT {by.lstrip(', ')}, n.cascade_id, n.user_id, n.parent_id, n.act_time, n.depth FROM nodes n, {settings} WHERE n.depth <= depth_given" if by else f"SELECT {_NODE} FROM nodes WHERE depth <= 1"
    own = by.lstrip(", ")
    return f"""init AS MATERIALIZED ({given}), th AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in thresholds)}]) AS threshold),
d0 AS MATERIALIZED (SELECT threshold, init.* FROM init, th), f0 AS MATERIALIZED (SELECT d0.* FROM d0 JOIN (SELECT {own + ", " if own else ""}cascade_id, max(depth) AS depth FROM init GROUP BY ALL) USING ({own + ", " if own else ""}cascade_id, depth))"""


def _ic(par: str, thresholds: tuple[float, ...] = _THR, rounds: int = _ROUNDS, by: str = "", settings: str = "", shared: str = "") -> str:
    """Tables of a prediction with par (u, v, k, r, and the columns shared); the last is d<rounds>."""
    key = f"threshold{by}, cascade_id"
    on = "".join(f" AND f.{c} = k.{c}" for c in shared.split(", ") if c)
    out = _start(thresholds, by, settings)
    for i in range(rounds):
        out += f""", n{i} AS MATERIALIZED (SELECT {key}, v, arg_min(f.user_id, {_ORDER}) AS p, min(f.act_time) AS t, arg_min(f.depth, {_ORDER}) AS dd, arg_min(f.r, {_ORDER}) AS r FROM (SELECT f.*, k.v, k.r FROM f{i} f JOIN {par} k ON k.u = f.user_id{on} AND k.k >= f.threshold) f ANTI JOIN (SELECT {key}, user_id AS v FROM d{i}) z USING ({key}, v) GROUP BY ALL),
f{i + 1} AS MATERIALIZED (SELECT {key}, v AS user_id, p AS parent_id, {_received("t", "r")} AS act_time, dd + 1 AS depth FROM n{i}), d{i + 1} AS MATERIALIZED (FROM d{i} UNION ALL FROM f{i + 1})"""
    return out


def _lt(par: str, thresholds: tuple[float, ...] = _THR, rounds: int = _ROUNDS) -> str:
    out = f"{_start(thresholds)}, b0 AS (SELECT threshold, cascade_id, user_id AS v, 0.0::DOUBLE AS base FROM d0 WHERE false)"
    for i in range(rounds):
        out += f""", run{i} AS MATERIALIZED (SELECT f.threshold, f.cascade_id, w.v, f.user_id AS u, f.act_time, f.depth, w.r, coalesce(b.base, 0) + sum(w.w) OVER (PARTITION BY f.threshold, f.cascade_id, w.v ORDER BY f.act_time, f.user_id ROWS UNBOUNDED PRECEDING) AS total FROM f{i} f JOIN {par} w ON w.u = f.user_id AND w.u <> w.v ANTI JOIN (SELECT threshold, cascade_id, user_id AS v FROM d{i}) z USING (threshold, cascade_id, v) LEFT JOIN b{i} b USING (threshold, cascade_id, v)),
f{i + 1} AS MATERIALIZED (SELECT threshold, cascade_id, v AS user_id, arg_min(u, (epoch_us(act_time), u)) AS parent_id, {_received("min(act_time)", "arg_min(r, (epoch_us(act_time), u))")} AS act_time, arg_min(depth, (epoch_us(act_time), u)) + 1 AS depth FROM run{i} WHERE round(total, 12) >= threshold GROUP BY 1, 2, 3),
b{i + 1} AS MATERIALIZED (SELECT threshold, cascade_id, v, max(total) AS base FROM run{i} GROUP BY 1, 2, 3 UNION ALL SELECT * FROM b{i} WHERE (threshold, cascade_id, v) NOT IN (SELECT threshold, cascade_id, v FROM run{i})), d{i + 1} AS MATERIALIZED (FROM d{i} UNION ALL FROM f{i + 1})"""
    return out


_OUT = ("threshold", "cascade_id", "user_id", "parent_id", "depth")
_TOLD = f"SELECT {', '.join(_OUT)} FROM d{_ROUNDS}"


@query(f"{R}{_ACT}, {_K0}, kr AS (SELECT *, 0.0::DOUBLE AS r FROM k0), {_ic('kr')} {_TOLD}")
def ic_predict(s: SparkSession, d: str) -> DataFrame:
    """Cascade prediction with starting probabilities at two thresholds until no frontier grows (M6)."""
    return predict.ic(trees.truncated(nodes_of(s, d), 1), em.initial_k(graph_of(s, d)), list(_THR)).select(*_OUT)


@query(f"{R}{_ACT}, {_W0}, w0 AS MATERIALIZED ({_START_W}), {_lt('w0')} {_TOLD}")
def lt_predict(s: SparkSession, d: str) -> DataFrame:
    """Threshold prediction with starting weights until no frontier grows."""
    par = em.initial_w(graph_of(s, d), graphs.vertices(nodes_of(s, d)))
    return predict.lt(trees.truncated(nodes_of(s, d), 1), par, list(_THR)).select(*_OUT)


def _forecast(s: SparkSession, d: str, method: str, thresholds: tuple[float, ...] = _THR) -> DataFrame:
    return experiment.METHODS[method][1](trees.truncated(nodes_of(s, d), 1), graph_of(s, d), fitted_of(method)(s, d), list(thresholds), None).select(*_OUT)


@query(f"{R}{_ACT}, {_EMIC}, par AS (SELECT *, 0.0::DOUBLE AS r FROM em20), {_ic('par')} {_TOLD}")
def emic_predict(s: SparkSession, d: str) -> DataFrame:
    """The discrete cascade model, fitted and then used (M3, M6)."""
    return _forecast(s, d, "emic")


@query(f"{R}{_ACT}, {_DAIC}, par AS (SELECT *, 0.0::DOUBLE AS r FROM da20), {_ic('par')} {_TOLD}")
def daic_predict(s: SparkSession, d: str) -> DataFrame:
    """The penalised cascade model, fitted and then used (M4, M6)."""
    return _forecast(s, d, "daic")


@query(f"{R}{_ACT}, {_CTIC}, {_ic('ct20')} {_TOLD}")
def ctic_predict(s: SparkSession, d: str) -> DataFrame:
    """The continuous-time cascade model, fitted and then used (M2, M6)."""
    return _forecast(s, d, "ctic")


@query(f"{R}{_ACT}, {_ASLT}, {_lt('as2')} {_TOLD}")
def aslt_predict(s: SparkSession, d: str) -> DataFrame:
    """The threshold model with delays, fitted and then used (M1, M5)."""
    return _forecast(s, d, "aslt")


# evaluation: predictions of the fitted discrete model from the first two levels, at several thresholds

_GRID = (0.05, 0.1, 0.2, 0.3, 0.5)
outputs_of = _once("outputs", lambda s, d: predict.ic(trees.truncated(nodes_of(s, d), 1), fitted_of("emic")(s, d), list(_GRID)))

_SCORES = "CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS \"precision\", CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS fpr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS tpr, CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy"
_R8 = ", ".join(f'round("{m}", 8) AS "{m}"' for m in evaluate.METRICS)


def _counts(key: str, known: str, pred: str, by: str = "threshold", given: str = "cascade_id", more: str = "") -> str:
    """Tables oo (output), tt (truth) and sc (scores) of what lies beyond the given tree; known: all users, or pairs of users, of the graph."""
    some = "AND parent_id IS NOT NULL" if "parent" in key else ""
    state = f"{more}cascade_id"
    return f"""oo AS MATERIALIZED (SELECT DISTINCT {by}, cascade_id, {key} FROM {pred} WHERE ({state}, {key}) NOT IN (SELECT {state}, {key} FROM init WHERE true {some}) {some}),
tt AS MATERIALIZED (SELECT DISTINCT {more}{f"n.cascade_id, {', '.join('n.' + k for k in key.split(', '))}"} FROM nodes n{", (SELECT DISTINCT " + more.rstrip(", ") + " FROM init) m" if more else ""} WHERE ({more}n.cascade_id, {', '.join('n.' + k for k in key.split(', '))}) NOT IN (SELECT {state}, {key} FROM init WHERE true {some}) {some.replace("parent_id", "n.parent_id")}),
kn AS MATERIALIZED ({known}), mr AS (SELECT {state}, count(*) AS more FROM tt ANTI JOIN kn USING ({key}) GROUP BY ALL),
bs AS (SELECT DISTINCT {by} FROM {pred}), cs AS (SELECT {by}, cascade_id FROM bs, (SELECT DISTINCT cascade_id FROM nodes)),
hit AS (SELECT {by}, cascade_id, count(*) AS n FROM oo JOIN tt USING ({state}, {key}) GROUP BY ALL), og AS (SELECT {by}, cascade_id, count(*) AS n FROM oo GROUP BY ALL), tg AS (SELECT {state}, count(*) AS n FROM tt GROUP BY ALL),
cf AS (SELECT {by}, cascade_id, coalesce(hit.n, 0) AS tp, coalesce(og.n, 0) - coalesce(hit.n, 0) AS fp, coalesce(tg.n, 0) - coalesce(hit.n, 0) AS fn, (SELECT count(*) FROM kn) + coalesce(more, 0) AS n_ref FROM cs LEFT JOIN hit USING ({by}, cascade_id) LEFT JOIN og USING ({by}, cascade_id) LEFT JOIN tg USING ({state}) LEFT JOIN mr USING ({state})),
sc AS MATERIALIZED (SELECT {by}, cascade_id, {_SCORES} FROM (SELECT *, greatest(n_ref - tp - fp - fn, 0) AS tn FROM cf))"""


_USERS = "SELECT src AS user_id FROM g UNION SELECT dst FROM g"
_PAIRS_OF_USERS = "SELECT DISTINCT src AS parent_id, dst AS user_id FROM g"
_SHOWN = f"{R}{_ACT}, {_EMIC}, par AS (SELECT *, 0.0::DOUBLE AS r FROM em20), {_ic('par', _GRID)}"
_CURVE = f"{_SHOWN}, {_counts('user_id', _USERS, f'd{_ROUNDS}')}, mean AS (SELECT threshold, {', '.join(f'avg("{m}") AS "{m}"' for m in evaluate.METRICS)} FROM sc GROUP BY 1)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if c in evaluate.METRICS else F.col(c) for c in df.columns])


@query(f"{_SHOWN}, {_counts('user_id', _USERS, f'd{_ROUNDS}')} SELECT threshold, cascade_id, {_R8} FROM sc")
def metrics_nodes(s: SparkSession, d: str) -> DataFrame:
    """Scores of predicted users."""
    n = nodes_of(s, d)
    return _rounded(evaluate.nodes_metrics(outputs_of(s, d), n, trees.truncated(n, 1), graph_of(s, d), by=("threshold",)))


@query(f"{_SHOWN}, {_counts('parent_id, user_id', _PAIRS_OF_USERS, f'd{_ROUNDS}')} SELECT threshold, cascade_id, {_R8} FROM sc")
def metrics_edges(s: SparkSession, d: str) -> DataFrame:
    """Scores of predicted edges."""
    n = nodes_of(s, d)
    return _rounded(evaluate.edges_metrics(outputs_of(s, d), n, trees.truncated(n, 1), graph_of(s, d), by=("threshold",)))


def _curve(s: SparkSession, d: str) -> DataFrame:
    n = nodes_of(s, d)
    return evaluate.mean_metrics(evaluate.nodes_metrics(outputs_of(s, d), n, trees.truncated(n, 1), graph_of(s, d), by=("threshold",)), ("threshold",))


@query(f"{_CURVE} SELECT threshold, {_R8} FROM mean")
def threshold_curve(s: SparkSession, d: str) -> DataFrame:
    """Mean scores for each threshold."""
    return _rounded(_curve(s, d))


@query(f"{_CURVE} SELECT threshold, round(f1, 8) AS f1 FROM mean ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(s: SparkSession, d: str) -> DataFrame:
    """The threshold with the best mean."""
    return evaluate.best_threshold(_curve(s, d)).withColumn("f1", F.round("f1", 8))


@query(f"{_CURVE}, pt AS (SELECT fpr, tpr FROM mean UNION ALL VALUES (0.0, 0.0), (1.0, 1.0)), o AS (SELECT fpr, tpr, lag(fpr) OVER w AS x, lag(tpr) OVER w AS y FROM pt WINDOW w AS (ORDER BY fpr, tpr)) SELECT round(sum((fpr - x) * (tpr + y) / 2), 8) AS auc FROM o")
def auc_roc(s: SparkSession, d: str) -> DataFrame:
    """Area under the curve."""
    return evaluate.auc(evaluate.roc(_curve(s, d))).withColumn("auc", F.round("auc", 8))


def _one(tables: str, name: str, start: str) -> str:
    """The tables of a prediction at 0.1 under names of their own, so that two can stand in one query."""
    import re

    return re.sub(r"\b(init|th|[dfnb]\d+|run\d+)\b", lambda m: f"{name}_{m[1]}", tables)


@query(
    f"{R}{_ACT}, {_EMIC}, par AS (SELECT *, 0.0::DOUBLE AS r FROM em20), {_one(_ic('par', (0.1,)), 'a', '')}, {_ASLT}, {_one(_lt('as2', (0.1,)), 'b', '')}, x AS (SELECT cascade_id, user_id FROM a_d{_ROUNDS}), y AS (SELECT cascade_id, user_id FROM b_d{_ROUNDS}) SELECT *, (cascade_id, user_id) IN (SELECT (cascade_id, user_id) FROM nodes) AS is_true FROM (SELECT *, 'a' AS only_in FROM (FROM x EXCEPT FROM y) UNION ALL SELECT *, 'b' FROM (FROM y EXCEPT FROM x))"
)
def method_diff(s: SparkSession, d: str) -> DataFrame:
    """Where the predictions of the fitted discrete (a) and threshold model (b) at 0.1 differ; all nodes are the truth."""
    a, b = (_forecast(s, d, m, (0.1,)) for m in ("emic", "aslt"))
    return evaluate.method_diff(a, b, nodes_of(s, d))



# methods and depths side by side: three fitted models from trees down to three depths, at 0.1

_METHODS, _DEPTHS = ("ctic", "daic", "emic"), (0, 1, 2)


def _settings(s: SparkSession, d: str) -> DataFrame:
    """method, given, threshold, cascade_id and metrics; all settings go through one prediction."""
    n, g = nodes_of(s, d), graph_of(s, d)
    every = [fitted_of(m)(s, d) for m in _METHODS]
    par = reduce(DataFrame.unionByName, [p.select("u", "v", "k", (F.col("r") if "r" in p.columns else F.lit(0.0)).alias("r"), F.lit(m).alias("method")) for m, p in zip(_METHODS, every, strict=True)])
    deepest = n.groupBy("cascade_id").agg(F.max("depth").alias("deepest"))
    grid = F.broadcast(s.createDataFrame([(m, i) for m in _METHODS for i in _DEPTHS], "method string, given int"))  # a row for each setting
    start = n.join(deepest, "cascade_id").crossJoin(grid).where("deepest > given and depth <= given").drop("deepest")
    out = predict.ic(start, par, [0.1], by=("method", "given"))
    scored = []
    for i in _DEPTHS:
        usable = n.join(deepest.where(F.col("deepest") > i).select("cascade_id"), "cascade_id", "left_semi")
        scored.append(evaluate.nodes_metrics(out.where(F.col("given") == i), usable, trees.truncated(usable, i), g, by=("method", "threshold")).withColumn("given", F.lit(i)))
    return reduce(DataFrame.unionByName, scored)


settings_of = _once("settings", _settings)
_SETTINGS = f"""{R}{_ACT}, {_EMIC}, {_DAIC.removeprefix(_K0 + ", ")}, {_CTIC.removeprefix(_K0 + ", ")}, par AS MATERIALIZED (SELECT 'emic' AS method, u, v, k, 0.0::DOUBLE AS r FROM em20 UNION ALL SELECT 'daic', u, v, k, 0.0::DOUBLE FROM da20 UNION ALL SELECT 'ctic', u, v, k, r FROM ct20),
st AS (SELECT unnest(['ctic', 'daic', 'emic']) AS method, given, given AS depth_given FROM (SELECT unnest([0, 1, 2]) AS given)), {_ic('par', (0.1,), _ROUNDS, ', method, given', 'st', 'method')}, {_counts('user_id', _USERS, f'd{_ROUNDS}', 'threshold, method, given', 'cascade_id', 'method, given, ')},
dp AS (SELECT cascade_id, max(depth) AS deepest FROM nodes GROUP BY 1), ss AS MATERIALIZED (SELECT sc.* FROM sc JOIN dp USING (cascade_id) WHERE deepest > given)"""


@query(f"{_SETTINGS} SELECT method, given, cascade_id, {_R8} FROM ss")
def settings_metrics(s: SparkSession, d: str) -> DataFrame:
    """Scores of each method from each depth; cascades no deeper are left out."""
    return _rounded(settings_of(s, d).select("method", "given", "cascade_id", *evaluate.METRICS))


@query(f"{_SETTINGS} SELECT given AS depth, " + ", ".join(f"round(avg(f1) FILTER (method = '{m}'), 8) AS {m}" for m in _METHODS) + " FROM ss GROUP BY 1")
def method_report(s: SparkSession, d: str) -> DataFrame:
    """Mean f1 by depth with a column for each method."""
    r = evaluate.method_report(settings_of(s, d).select("method", F.col("given").alias("depth"), "cascade_id", "f1"))
    return r.select("depth", *[F.round(m, 8).alias(m) for m in _METHODS])


def _student(sql: str) -> str:
    area = "(pi() / 2 - ({0})) / 2000 / 3 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * power(abs(cos(({0}) + i * (pi() / 2 - ({0})) / 2000)), df - 1)))"
    return f"SELECT round(t, 6) AS t, df, round({area.format('atan(abs(t) / sqrt(df))')} / (2 * ({area.format('0')})), 6) AS p FROM ({sql})"


_T = "SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t, na + nb - 2 AS df, ma, mb FROM (SELECT count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb, avg(value) FILTER (grp = 'a') AS ma, avg(value) FILTER (grp = 'b') AS mb, var_samp(value) FILTER (grp = 'a') AS va, var_samp(value) FILTER (grp = 'b') AS vb FROM x)"


@query(f"{_SETTINGS}, x AS (SELECT CASE WHEN method = 'ctic' THEN 'a' ELSE 'b' END AS grp, f1 AS value FROM ss WHERE given = 1 AND method IN ('ctic', 'emic')) " + _student(_T))
def method_t_test(s: SparkSession, d: str) -> DataFrame:
    """Student's t and p of two methods' f1 from the first two levels."""
    x = settings_of(s, d).where("given = 1 and method in ('ctic', 'emic')").select(F.when(F.col("method") == "ctic", "a").otherwise("b").alias("grp"), F.col("f1").alias("value"))
    return evaluate.t_test(x).select(F.round("t", 6).alias("t"), "df", F.round("p", 6).alias("p"))


@query()
def tuned_threshold(s: SparkSession, d: str) -> DataFrame:
    """Mean scores of each threshold over three folds, all fitted and predicted in one loop each."""
    n = nodes_of(s, d)
    _, means = experiment.tune("emic", experiment.Data(n, act_of(s, d)), n.select("cascade_id").distinct(), list(_GRID), init_depth=1)
    return _rounded(means)


@query()
def random_search(s: SparkSession, d: str) -> DataFrame:
    """The best of ten draws of threshold and penalty over two folds, all draws side by side."""
    n = nodes_of(s, d)
    best, f1 = experiment.search("daic", experiment.Data(n, act_of(s, d)), n.select("cascade_id").distinct(), {"threshold": (0.02, 0.3), "penalty": (1.0, 20.0)}, iterations=10, folds=2, init_depth=1)
    return s.createDataFrame([(best["threshold"], best["penalty"], f1)], "threshold double, penalty double, f1 double")


@query(f"{R}{_CASC}, x AS (SELECT CASE WHEN cascade_id LIKE 'click-%' THEN 'a' ELSE 'b' END AS grp, size AS value FROM casc WHERE cascade_id LIKE 'click-%' OR cascade_id LIKE 'view-%'), q AS (SELECT count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb, avg(value) FILTER (grp = 'a') AS ma, avg(value) FILTER (grp = 'b') AS mb, var_samp(value) FILTER (grp = 'a') AS va, var_samp(value) FILTER (grp = 'b') AS vb FROM x) SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 8) AS t, na + nb - 2 AS df, round(ma, 8) AS mean_a, round(mb, 8) AS mean_b FROM q")
def t_statistic(s: SparkSession, d: str) -> DataFrame:
    """Student's t of two groups."""
    c = cascades_of(s, d).where("cascade_id like 'click-%' or cascade_id like 'view-%'")
    out = evaluate.t_statistic(c.select(F.when(F.col("cascade_id").like("click-%"), "a").otherwise("b").alias("grp"), F.col("size").alias("value")))
    return out.select(F.round("t", 8).alias("t"), "df", F.round("mean_a", 8).alias("mean_a"), F.round("mean_b", 8).alias("mean_b"))

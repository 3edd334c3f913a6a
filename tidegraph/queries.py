"""A query for each operator on the driver's tables, and the SQL that gives the same rows.

The tables map to the social schema in ``sources.adapter``. Trees, activations and graphs are made once for a session and data folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import scalar as C
from tidegraph.operators import cascades, clusters, dendrogram, features, graphs, sampling, sequences, spectrum, trees
from tidegraph.plans import em, experiment, mln, mrf, seqlabel
from tidegraph.plans.loops import kept, settled, written
from tidegraph.sources import adapter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_made: dict[tuple[str, str, str, int], DataFrame] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _written_at(spark: SparkSession, sf_dir: str) -> int:
    """When the table events was last written, 0 if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(path).getModificationTime() if files.exists(path) else 0


def _once(name: str, make: Query, keep: Callable[[DataFrame], DataFrame] = settled) -> Query:
    """make's table, made once for a session and a folder, and again when the folder's events are written anew."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, name, _written_at(spark, sf_dir))
        if key not in _made:
            _made[key] = keep(make(spark, sf_dir))
        return _made[key]

    return get


nodes_of = _once("trees", lambda s, d: trees.trees(adapter.reshares(s, d), adapter.postcascades(s, d)))
cascades_of = _once("cascades", lambda s, d: cascades.with_depth(cascades.attributes(adapter.postcascades(s, d)), nodes_of(s, d)))
spans_of = lambda s, d: cascades.attributes(adapter.postcascades(s, d))  # noqa: E731  times of cascades, which need no trees
act_of = _once("activations", lambda s, d: sequences.activations(adapter.postcascades(s, d), spans_of(s, d)))
graph_of = _once("graph", lambda s, d: graphs.from_trees(nodes_of(s, d)))
evidence_of = _once("evidence", lambda s, d: features.evidence(nodes_of(s, d), graph_of(s, d)), lambda ev: kept(ev, "evidence", "v"))

# SQL of the same tables
_PC = "pc AS (SELECT event_id AS post_id, event_type || '-' || strftime(ts, '%Y-%m-%d') AS cascade_id, user_id AS author_id, ts AS datetime FROM events)"
_RS = f"""{_PC}, rk AS (SELECT *, row_number() OVER (PARTITION BY cascade_id ORDER BY datetime, post_id) AS rn FROM pc),
rs AS (SELECT a.post_id, b.post_id AS reshared_post_id, a.author_id AS user_id, b.author_id AS ref_user_id, a.datetime, b.datetime AS ref_datetime, a.cascade_id FROM rk a JOIN rk b ON a.cascade_id = b.cascade_id AND b.rn = a.rn // 2 WHERE a.rn > 1)"""
_TREE = f"""{_RS}, r AS (SELECT *, row_number() OVER (PARTITION BY cascade_id ORDER BY datetime, post_id) AS n FROM rs WHERE user_id <> ref_user_id),
fc AS (SELECT cascade_id, user_id, min(n) AS n, arg_min(ref_user_id, n) AS p, arg_min(datetime, n) AS t FROM r GROUP BY 1, 2),
fp AS (SELECT cascade_id, ref_user_id AS user_id, min(n) AS n, arg_min(ref_datetime, n) AS t FROM r GROUP BY 1, 2),
touched AS (SELECT cascade_id, user_id, CASE WHEN fc.n < coalesce(fp.n, 9e15) THEN fc.p END AS parent_id, CASE WHEN fc.n < coalesce(fp.n, 9e15) THEN fc.t ELSE fp.t END AS act_time FROM fc FULL JOIN fp USING (cascade_id, user_id)),
flat AS (SELECT * FROM touched UNION ALL SELECT cascade_id, author_id, NULL, min(datetime) FROM pc WHERE (cascade_id, author_id) NOT IN (SELECT cascade_id, user_id FROM touched) GROUP BY 1, 2),
nodes AS (SELECT *, 0 AS depth FROM flat WHERE parent_id IS NULL UNION ALL SELECT f.*, n.depth + 1 FROM flat f JOIN nodes n ON f.cascade_id = n.cascade_id AND f.parent_id = n.user_id)"""
_CASC = f"""{_TREE}, att AS (SELECT cascade_id, count(DISTINCT author_id) AS size, count(*) AS "count", min(datetime) AS first_time, max(datetime) AS last_time FROM pc GROUP BY 1),
casc AS (SELECT att.*, coalesce(d.depth, 0) AS depth FROM att LEFT JOIN (SELECT cascade_id, max(depth) AS depth FROM nodes GROUP BY 1) d USING (cascade_id))"""
_ACT = f"""{_CASC}, g AS (SELECT DISTINCT parent_id AS src, user_id AS dst FROM nodes WHERE parent_id IS NOT NULL),
act AS (SELECT cascade_id, author_id AS user_id, (epoch_us(min(datetime)) - epoch_us(any_value(first_time))) / 1e6 / 2592000 AS t, (epoch_us(any_value(last_time)) - epoch_us(any_value(first_time))) / 1e6 / 2592000 AS max_t FROM pc JOIN casc USING (cascade_id) WHERE datetime IS NOT NULL GROUP BY 1, 2),
ap AS (SELECT a.cascade_id, g.src AS u, g.dst AS v, b.t - a.t AS dt FROM act a JOIN g ON g.src = a.user_id JOIN act b ON b.cascade_id = a.cascade_id AND b.user_id = g.dst WHERE a.t <= b.t),
ex AS (SELECT a.cascade_id, g.src AS u, g.dst AS v, a.max_t - a.t AS dt FROM act a JOIN g ON g.src = a.user_id LEFT JOIN act b ON b.cascade_id = a.cascade_id AND b.user_id = g.dst WHERE b.user_id IS NULL),
ip AS (SELECT x.cascade_id, x.v, g.src AS u FROM (SELECT DISTINCT cascade_id, v FROM ex) x JOIN g ON g.dst = x.v LEFT JOIN act b ON b.cascade_id = x.cascade_id AND b.user_id = g.src WHERE b.user_id IS NULL),
tried AS (SELECT u, v, coalesce(p.n, 0) AS n_pos, coalesce(q.n, 0) AS n_neg FROM (SELECT u, v, count(*) AS n FROM ap GROUP BY 1, 2) p FULL JOIN (SELECT u, v, count(*) AS n FROM ex GROUP BY 1, 2) q USING (u, v))"""
_K0 = "k0 AS MATERIALIZED (SELECT g.src AS u, g.dst AS v, 1 / o.n AS k FROM g JOIN (SELECT src, count(*) AS n FROM g GROUP BY 1) o ON o.src = g.src)"
R = "WITH RECURSIVE "


# sources


@query(f"WITH {_PC} SELECT post_id, author_id, datetime, CAST(NULL AS VARCHAR) AS url FROM pc")
def posts(s: SparkSession, d: str) -> DataFrame:
    """posts (S1, F1)."""
    return adapter.posts(s, d)


@query(f"WITH {_PC} SELECT * FROM pc")
def postcascades(s: SparkSession, d: str) -> DataFrame:
    """The bridge of posts and cascades."""
    return adapter.postcascades(s, d)


@query(f"WITH {_RS} SELECT post_id, reshared_post_id, user_id, ref_user_id, datetime, ref_datetime FROM rs")
def reshares(s: SparkSession, d: str) -> DataFrame:
    """Edges between posts."""
    return adapter.reshares(s, d)


@query(f"WITH {_PC} SELECT post_id, cascade_id, author_id, datetime FROM (SELECT *, row_number() OVER (PARTITION BY cascade_id, author_id ORDER BY datetime, post_id) AS n FROM pc) WHERE n = 1")
def first_posts(s: SparkSession, d: str) -> DataFrame:
    """First post of each author in each cascade."""
    return trees.first_per_author(adapter.postcascades(s, d))


# cascades


@query(f"{R}{_CASC} SELECT cascade_id, size, \"count\", first_time, last_time, depth FROM casc")
def cascade_attributes(s: SparkSession, d: str) -> DataFrame:
    """Size, count, times and depth of each cascade."""
    return cascades.with_depth(cascades.attributes(adapter.postcascades(s, d)), nodes_of(s, d))


@query(f"{R}{_CASC} SELECT cascade_id, size, depth FROM casc WHERE size >= 4 AND size <= 60 AND depth >= 3")
def cascade_filter(s: SparkSession, d: str) -> DataFrame:
    """Optional ranges of size and depth."""
    return cascades.filtered(cascades_of(s, d), 4, 60, 3).select("cascade_id", "size", "depth")


@query(
    f"{R}{_CASC}, e AS (SELECT min(size) AS lo, max(size) AS hi FROM casc) SELECT CAST(least(floor((size - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM casc, e GROUP BY 1"
)
def size_histogram(s: SparkSession, d: str) -> DataFrame:
    """Histogram of sizes."""
    return cascades.size_histogram(cascades_of(s, d), 20).select("bin", "n")


@query(f"{R}{_CASC} SELECT min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, count(size) AS n FROM casc")
def size_summary(s: SparkSession, d: str) -> DataFrame:
    """Range and mean of sizes."""
    return cascades.size_summary(cascades_of(s, d)).withColumn("mean_size", F.round("mean_size", 6))


@query(f"{R}{_CASC} SELECT depth, count(*) AS n FROM casc GROUP BY 1")
def depth_histogram(s: SparkSession, d: str) -> DataFrame:
    """Cascades by depth."""
    return cascades_of(s, d).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{R}{_TREE}, b AS (SELECT cascade_id, count(*) AS size, max(depth) AS depth FROM nodes GROUP BY 1) SELECT count(*) AS n_cascades, min(size) AS min_size, max(size) AS max_size, min(depth) AS min_depth, max(depth) AS max_depth, (SELECT count(DISTINCT user_id) FROM nodes) AS n_users FROM b"
)
def project_stats(s: SparkSession, d: str) -> DataFrame:
    """Users, cascades, sizes and depths of a project."""
    return cascades.project_stats(nodes_of(s, d))


# trees

_N = "cascade_id, user_id, parent_id, act_time, depth"


@query(f"{R}{_TREE} SELECT {_N} FROM nodes")
def first_touch_tree(s: SparkSession, d: str) -> DataFrame:
    """First-touch trees with depths."""
    return trees.trees(adapter.reshares(s, d), adapter.postcascades(s, d)).select(*_N.split(", "))


@query(f"{R}{_TREE} SELECT cascade_id, count(*) AS size, max(depth) AS height, count(*) FILTER (parent_id IS NULL) AS n_roots, count(*) FILTER ((cascade_id, user_id) NOT IN (SELECT cascade_id, parent_id FROM nodes WHERE parent_id IS NOT NULL)) AS n_leaves FROM nodes GROUP BY 1")
def tree_summary(s: SparkSession, d: str) -> DataFrame:
    """Size, height, roots and leaves."""
    return trees.summary(nodes_of(s, d))


@query(f"{R}{_TREE} SELECT cascade_id, depth, count(*) AS n FROM nodes GROUP BY 1, 2")
def tree_levels(s: SparkSession, d: str) -> DataFrame:
    """Nodes at each depth."""
    return trees.at_depth(nodes_of(s, d))


@query(f"{R}{_TREE} SELECT {_N} FROM nodes WHERE depth <= 2")
def tree_truncate(s: SparkSession, d: str) -> DataFrame:
    """Trees down to a depth."""
    return trees.truncated(nodes_of(s, d), 2).select(*_N.split(", "))


@query(f"{R}{_TREE} SELECT cascade_id, parent_id AS src, user_id AS dst FROM nodes WHERE parent_id IS NOT NULL AND depth <= 3")
def tree_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges down to a depth."""
    return trees.edges(nodes_of(s, d), 3)


@query(f"{R}{_TREE} SELECT {_N} FROM nodes WHERE (cascade_id, user_id) NOT IN (SELECT cascade_id, parent_id FROM nodes WHERE parent_id IS NOT NULL)")
def tree_leaves(s: SparkSession, d: str) -> DataFrame:
    """Nodes without children."""
    return trees.leaves(nodes_of(s, d)).select(*_N.split(", "))


@query(f"{R}{_TREE} SELECT c.cascade_id || '/' || c.user_id AS post_id, c.cascade_id || '/' || c.parent_id AS reshared_post_id, c.cascade_id, c.user_id, c.parent_id AS ref_user_id, c.act_time AS datetime, p.act_time AS ref_datetime FROM nodes c JOIN nodes p ON p.cascade_id = c.cascade_id AND p.user_id = c.parent_id")
def tree_to_reshares(s: SparkSession, d: str) -> DataFrame:
    """Reshares made from trees."""
    return trees.to_reshares(nodes_of(s, d))


_LOW = f"{_TREE}, dg AS (SELECT u, count(*) AS n FROM (SELECT parent_id AS u FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT user_id FROM nodes WHERE parent_id IS NOT NULL) GROUP BY 1), low AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM nodes) LEFT JOIN dg ON u = user_id WHERE coalesce(n, 0) < 40)"


@query(f"{R}{_LOW}, kept AS (SELECT {_N} FROM nodes WHERE parent_id IS NULL AND user_id NOT IN (FROM low) UNION ALL SELECT n.cascade_id, n.user_id, n.parent_id, n.act_time, n.depth FROM nodes n JOIN kept k ON k.cascade_id = n.cascade_id AND k.user_id = n.parent_id WHERE n.user_id NOT IN (FROM low)) SELECT {_N} FROM kept")
def prune_trees(s: SparkSession, d: str) -> DataFrame:
    """Users of low degree go, and what hangs below them."""
    nodes = nodes_of(s, d)
    return trees.pruned(nodes, graphs.low_degree(nodes, 40)).select(*_N.split(", "))


# sequences


@query(f"{R}{_ACT} SELECT cascade_id, user_id, round(t, 9) AS t, round(max_t, 9) AS max_t FROM act")
def activation_sequence(s: SparkSession, d: str) -> DataFrame:
    """Relative times of activation."""
    a = sequences.activations(adapter.postcascades(s, d), spans_of(s, d))
    return a.select("cascade_id", "user_id", F.round("t", 9).alias("t"), F.round("max_t", 9).alias("max_t"))


@query(f"{R}{_ACT} SELECT cascade_id, array_to_string(list(user_id ORDER BY t, user_id), ',') AS users FROM act GROUP BY 1")
def activation_arrays(s: SparkSession, d: str) -> DataFrame:
    """Users of each cascade in the order of time."""
    return sequences.arrays(act_of(s, d)).select("cascade_id", F.array_join("users", ",").alias("users"))


@query(f"{R}{_ACT} SELECT cascade_id, u, v, round(dt, 9) AS dt FROM ap")
def active_parents(s: SparkSession, d: str) -> DataFrame:
    """Edges whose source acts before their target."""
    return sequences.active_parents(act_of(s, d), graph_of(s, d)).withColumn("dt", F.round("dt", 9))


@query(f"{R}{_ACT} SELECT DISTINCT cascade_id, v FROM ex")
def rond_set(s: SparkSession, d: str) -> DataFrame:
    """Inactive users next to an active one."""
    return sequences.rond_set(act_of(s, d), graph_of(s, d))


@query(f"{R}{_ACT} SELECT cascade_id, v, u FROM ip")
def inactive_parents(s: SparkSession, d: str) -> DataFrame:
    """Inactive sources of the rond set."""
    return sequences.inactive_parents(act_of(s, d), graph_of(s, d))


@query(f"{R}{_ACT} SELECT u, v, n_pos, n_neg FROM tried")
def edge_trials(s: SparkSession, d: str) -> DataFrame:
    """Successes and failures of each edge."""
    return sequences.trials(act_of(s, d), graph_of(s, d))


# graphs


@query(f"{R}{_TREE} SELECT DISTINCT parent_id AS src, user_id AS dst FROM nodes WHERE parent_id IS NOT NULL")
def graph_from_trees(s: SparkSession, d: str) -> DataFrame:
    """The user graph of trees."""
    return graphs.from_trees(nodes_of(s, d))


@query(f"WITH {_RS} SELECT DISTINCT ref_user_id AS src, user_id AS dst FROM rs WHERE user_id <> ref_user_id")
def graph_from_reshares(s: SparkSession, d: str) -> DataFrame:
    """The user graph of reshares within a cascade."""
    return graphs.from_reshares(adapter.reshares(s, d), adapter.postcascades(s, d))


@query(f"WITH {_RS} SELECT DISTINCT ref_user_id AS src, user_id AS dst FROM rs")
def graph_all_reshares(s: SparkSession, d: str) -> DataFrame:
    """All reshares as edges."""
    return graphs.from_all_reshares(adapter.reshares(s, d))


@query(f"WITH {_RS} SELECT DISTINCT ref_user_id AS src, user_id AS dst FROM rs WHERE user_id <> ref_user_id AND cascade_id LIKE 'click-%'")
def graph_of_some(s: SparkSession, d: str) -> DataFrame:
    """Reshares whose own post is among some posts."""
    return graphs.from_targets(adapter.reshares(s, d), adapter.postcascades(s, d).where("cascade_id like 'click-%'"))


@query(f"{R}{_TREE}, e AS (SELECT parent_id AS src, user_id AS dst FROM nodes WHERE parent_id IS NOT NULL) SELECT u AS user_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS total FROM (SELECT src AS u, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1")
def degrees(s: SparkSession, d: str) -> DataFrame:
    """Degrees over all trees (A10)."""
    return graphs.degrees(trees.edges(nodes_of(s, d)).select("src", "dst"))


@query(f"{R}{_LOW}, g AS (SELECT DISTINCT parent_id AS src, user_id AS dst FROM nodes WHERE parent_id IS NOT NULL) SELECT src, dst FROM g WHERE src NOT IN (FROM low) AND dst NOT IN (FROM low)")
def prune_graph(s: SparkSession, d: str) -> DataFrame:
    """The graph without users of low degree."""
    return graphs.without(graph_of(s, d), graphs.low_degree(nodes_of(s, d), 40))


@query(f"{R}{_TREE}, g AS (SELECT DISTINCT parent_id AS src, user_id AS dst FROM nodes WHERE parent_id IS NOT NULL) SELECT user_id, p AS n_pred, x AS n_succ FROM (SELECT dst AS user_id, count(*) AS p FROM g GROUP BY 1) FULL JOIN (SELECT src AS user_id, count(*) AS x FROM g GROUP BY 1) USING (user_id)")
def graph_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Predecessors and successors of each user."""
    n = graphs.neighbours(graph_of(s, d))
    return n.select("user_id", F.when(F.col("predecessors").isNotNull(), F.size("predecessors")).cast("long").alias("n_pred"), F.when(F.col("successors").isNotNull(), F.size("successors")).cast("long").alias("n_succ"))


_KEPT = f"{_LOW.replace(_TREE, _ACT)}, kept AS (SELECT {_N} FROM nodes WHERE parent_id IS NULL AND user_id NOT IN (FROM low) UNION ALL SELECT n.cascade_id, n.user_id, n.parent_id, n.act_time, n.depth FROM nodes n JOIN kept k ON k.cascade_id = n.cascade_id AND k.user_id = n.parent_id WHERE n.user_id NOT IN (FROM low)), ke AS (SELECT DISTINCT cascade_id FROM kept WHERE parent_id IS NOT NULL)"


@query(f"{R}{_KEPT} SELECT cascade_id, user_id, round(t, 9) AS t, round(max(t) OVER (PARTITION BY cascade_id), 9) AS max_t FROM act WHERE user_id NOT IN (FROM low) AND cascade_id IN (FROM ke)")
def prune_sequences(s: SparkSession, d: str) -> DataFrame:
    """Sequences without users of low degree, of cascades whose trees keep an edge."""
    nodes = nodes_of(s, d)
    low = graphs.low_degree(nodes, 40)
    out = sequences.pruned(act_of(s, d), low, trees.with_edges(trees.pruned(nodes, low)))
    return out.select("cascade_id", "user_id", F.round("t", 9).alias("t"), F.round("max_t", 9).alias("max_t"))


# samples


@query(f"WITH {_PC}, o AS (SELECT cascade_id, row_number() OVER (ORDER BY md5(cascade_id || '0'), cascade_id) AS n FROM (SELECT DISTINCT cascade_id FROM pc)) SELECT cascade_id, CASE WHEN n <= round_even((SELECT count(*) FROM o) * 0.3, 0) THEN 'test' ELSE 'training' END AS split FROM o")
def train_test_split(s: SparkSession, d: str) -> DataFrame:
    """A 70/30 split (T5)."""
    return sampling.train_test(adapter.postcascades(s, d).select("cascade_id"))


@query(f"WITH {_PC}, o AS (SELECT cascade_id, row_number() OVER (ORDER BY cascade_id) AS n FROM (SELECT DISTINCT cascade_id FROM pc)) SELECT cascade_id, CAST(floor((n - 1) / ceil((SELECT count(*) FROM o) / 3)) AS INT) AS fold FROM o")
def folds(s: SparkSession, d: str) -> DataFrame:
    """Three contiguous folds."""
    return sampling.folds(adapter.postcascades(s, d).select("cascade_id"))


# scalar functions


@query("SELECT page_id, nullif(left(regexp_extract(lower(url), '^https?://+([^/?]*\\w+[^/?]*)', 1), 100), '') AS site FROM pages")
def url_domain(s: SparkSession, d: str) -> DataFrame:
    """The user of a URL."""
    return adapter.table(s, d, "pages").select("page_id", C.url_user(F.col("url")).alias("site"))


@query("SELECT page_id, left(u, 50) || right(u, 50) AS short FROM (SELECT page_id, url || repeat('x', 120) AS u FROM pages) WHERE length(u) > 100")
def url_truncate(s: SparkSession, d: str) -> DataFrame:
    """Long URLs cut."""
    return adapter.table(s, d, "pages").select("page_id", C.truncated_url(F.concat("url", F.lit("x" * 120))).alias("short"))


_PUNCT = "'" + C.PUNCTUATION.replace("'", "''") + "'"
_SPLIT = f"list_filter(regexp_split_to_array(lower(translate(text, {_PUNCT}, '{' ' * len(C.PUNCTUATION)}')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_different FROM (SELECT doc_id, {_SPLIT} AS w FROM documents)")
def subject_words(s: SparkSession, d: str) -> DataFrame:
    """Words of a text."""
    w = adapter.table(s, d, "documents").select("doc_id", C.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_different"))


@query(f"WITH w AS (SELECT conv_id, turn, list_distinct({_SPLIT}) AS w FROM conversations) SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) END, 9) AS sim FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def word_jaccard(s: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of neighbouring turns."""
    w = adapter.table(s, d, "conversations").select("conv_id", "turn", F.array_distinct(C.words(F.col("text"))).alias("w"))
    nxt = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return w.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(C.jaccard(F.col("w"), F.col("w2")), 9).alias("sim"))


@query("SELECT event_id, lpad(CAST(user_id AS VARCHAR), 24, '0') AS padded FROM events")
def pad_id(s: SparkSession, d: str) -> DataFrame:
    """Ids of 24 digits."""
    return adapter.table(s, d, "events").select("event_id", C.padded_id(F.col("user_id")).alias("padded"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, CAST(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' Asia/Tehran', '%Y-%m-%d %H:%M:%S %Z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS utc FROM events")
def local_time_to_utc(s: SparkSession, d: str) -> DataFrame:
    """Local texts as times."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return adapter.table(s, d, "events").select("event_id", text.alias("text"), C.utc_time(text, "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("utc"))


@query("SELECT event_id, make_timestamp(epoch_us(ts) + CAST(round(CASE WHEN r > 0 THEN least(1 / r, 24.0) ELSE 24.0 END * 2592000 * 1000000) AS BIGINT)) AS received FROM (SELECT *, value - 5 AS r FROM events)")
def receive_time(s: SparkSession, d: str) -> DataFrame:
    """When a receiver acts."""
    return adapter.table(s, d, "events").select("event_id", C.received(F.col("ts"), F.col("value") - 5).cast("timestamp_ntz").alias("received"))


# clusters

_PAIRS = f"{_ACT}, sz AS (SELECT cascade_id, count(*) AS n FROM act GROUP BY 1), bo AS (SELECT a.cascade_id AS i, b.cascade_id AS j, count(*) AS c FROM act a JOIN act b ON a.user_id = b.user_id AND a.cascade_id < b.cascade_id GROUP BY 1, 2), pr AS (SELECT i, j, c / (x.n + y.n - c) AS sim FROM bo JOIN sz x ON x.cascade_id = i JOIN sz y ON y.cascade_id = j)"
_LABELS = "lb AS (SELECT cascade_id, split_part(cascade_id, '-', 1) AS label FROM sz)"
pairs_of = _once("pairs", lambda s, d: clusters.jaccard_pairs(act_of(s, d)))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return cascades_of(s, d).select("cascade_id", F.split_part("cascade_id", F.lit("-"), F.lit(1)).alias("label"))


@query(f"{R}{_PAIRS} SELECT i, j, round(sim, 9) AS sim FROM pr")
def jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    """Similarity of cascades by users."""
    return clusters.jaccard_pairs(act_of(s, d)).withColumn("sim", F.round("sim", 9))


@query(f"{R}{_PAIRS}, {_LABELS}, x AS (SELECT a.label, sum(sim) AS s FROM pr JOIN lb a ON a.cascade_id = i JOIN lb b ON b.cascade_id = j WHERE a.label = b.label GROUP BY 1) SELECT label, n, round(coalesce(s, 0) / (n * (n - 1) / 2), 8) AS mean_sim FROM (SELECT label, count(*) AS n FROM lb GROUP BY 1) LEFT JOIN x USING (label)")
def cluster_means(s: SparkSession, d: str) -> DataFrame:
    """Mean similarity inside clusters."""
    return clusters.within_means(pairs_of(s, d), _labels(s, d)).withColumn("mean_sim", F.round("mean_sim", 8))


@query(f"{R}{_PAIRS}, {_LABELS}, p AS (SELECT a.cascade_id AS i, b.cascade_id AS j, a.label = b.label AS same FROM lb a JOIN lb b ON a.cascade_id < b.cascade_id) SELECT round(sqrt(2 * sum(power(coalesce(sim, 0) - same::INT, 2))), 6) AS error FROM p LEFT JOIN pr USING (i, j)")
def cluster_error(s: SparkSession, d: str) -> DataFrame:
    """Distance from the block matrix of clusters."""
    return clusters.cluster_error(pairs_of(s, d), _labels(s, d)).withColumn("error", F.round("error", 6))


@query(f"{R}{_PAIRS}, o AS (SELECT cascade_id, row_number() OVER (ORDER BY cascade_id) - 1 AS p FROM sz) SELECT CAST(x.p // 10 AS INT) AS row, CAST(y.p // 10 AS INT) AS col, round(sum(sim), 6) AS sim FROM pr JOIN o x ON x.cascade_id = i JOIN o y ON y.cascade_id = j GROUP BY 1, 2")
def heat_map(s: SparkSession, d: str) -> DataFrame:
    """The matrix in bins of ten."""
    return clusters.heat_map(pairs_of(s, d), cascades_of(s, d), 15).withColumn("sim", F.round("sim", 6))


@query(f"{R}{_PAIRS}, f AS (SELECT i, count(*) AS n FROM (SELECT i FROM pr WHERE sim > 0.001 UNION ALL SELECT j FROM pr WHERE sim > 0.001) GROUP BY 1) SELECT cascade_id, (SELECT count(*) FROM sz) - coalesce(f.n, 0) AS neighbours, (SELECT count(*) FROM sz) - coalesce(f.n, 0) >= 5 AS core FROM sz LEFT JOIN f ON f.i = cascade_id")
def dbscan_cores(s: SparkSession, d: str) -> DataFrame:
    """Core cascades of density clusters."""
    return clusters.density_cores(pairs_of(s, d), cascades_of(s, d).select("cascade_id"))


def _dbscan_sql(eps: float, points: int) -> str:
    return f"""{R}{_PAIRS}, mx AS (SELECT a.cascade_id AS i, b.cascade_id AS j FROM sz a, sz b WHERE a.cascade_id = b.cascade_id OR coalesce((SELECT sim FROM pr WHERE pr.i = least(a.cascade_id, b.cascade_id) AND pr.j = greatest(a.cascade_id, b.cascade_id)), 0) <= {eps}),
co AS (SELECT i FROM mx GROUP BY 1 HAVING count(*) >= {points}), cc AS (SELECT i, j FROM mx SEMI JOIN co ON co.i = mx.j),
rc AS (SELECT i AS a, i AS b FROM co UNION SELECT rc.a, cc.j FROM rc JOIN cc ON cc.i = rc.b JOIN co ON co.i = rc.b),
cl AS (SELECT a, dense_rank() OVER (ORDER BY least_b) - 1 AS label FROM (SELECT a, min(b) AS least_b FROM rc GROUP BY 1))
SELECT cascade_id, co.i IS NOT NULL AS core, CAST(CASE WHEN co.i IS NOT NULL THEN own.label ELSE coalesce((SELECT min(label) FROM cc JOIN cl ON cl.a = cc.j WHERE cc.i = cascade_id), -1) END AS INTEGER) AS label FROM sz LEFT JOIN co ON co.i = cascade_id LEFT JOIN cl own ON own.a = cascade_id"""


@query(_dbscan_sql(0.001, 5))
def dbscan(s: SparkSession, d: str) -> DataFrame:
    """Density clusters of cascades (M19), with the reference's eps and points."""
    return clusters.dbscan(pairs_of(s, d), cascades_of(s, d).select("cascade_id"))


@query(_dbscan_sql(0.16, 16))
def dbscan_wide(s: SparkSession, d: str) -> DataFrame:
    """The same with wider neighbourhoods."""
    return clusters.dbscan(pairs_of(s, d), cascades_of(s, d).select("cascade_id"), 0.16, 16)


@query(f"{R}{_PAIRS}, rc AS (SELECT cascade_id AS a, cascade_id AS b FROM sz UNION SELECT rc.a, e.j FROM rc JOIN (SELECT i, j FROM pr WHERE sim >= 0.5 UNION ALL SELECT j, i FROM pr WHERE sim >= 0.5) e ON e.i = rc.b) SELECT a AS cascade_id, min(b) AS label FROM rc GROUP BY 1")
def similar_groups(s: SparkSession, d: str) -> DataFrame:
    """Cascades connected over similar pairs."""
    return clusters.connected(pairs_of(s, d), cascades_of(s, d).select("cascade_id"), 0.5)


merges_of = _once("merges", lambda s, d: dendrogram.merges(pairs_of(s, d)))


@query()
def paris_dendrogram(s: SparkSession, d: str) -> DataFrame:
    """Merges of cascades by distance."""
    return merges_of(s, d).withColumn("distance", F.round("distance", 9))


@query()
def paris_clusters(s: SparkSession, d: str) -> DataFrame:
    """The dendrogram cut at twenty clusters."""
    return dendrogram.cut(merges_of(s, d), cascades_of(s, d), 20)


@query()
def spectral_clusters(s: SparkSession, d: str) -> DataFrame:
    """Spectral clusters of cascades."""
    return spectrum.clusters(pairs_of(s, d), cascades_of(s, d), 5)


@query()
def kmeans(s: SparkSession, d: str) -> DataFrame:
    """KMeans of vectors."""
    v = adapter.table(s, d, "embeddings")
    return clusters.kmeans(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")))


def _user_means_sql(k: int, rounds: int) -> str:
    steps = [f"l0 AS MATERIALIZED (SELECT cascade_id, row_number() OVER (ORDER BY md5(cascade_id || '0'), cascade_id) - 1 AS label, 0.0 AS distance FROM sz QUALIFY row_number() OVER (ORDER BY md5(cascade_id || '0'), cascade_id) <= {k})"]
    for r in range(rounds + 1):
        steps += [
            f"s{r} AS MATERIALIZED (SELECT label, user_id, count(*) AS s FROM act JOIN l{r} USING (cascade_id) GROUP BY 1, 2)",
            f"c{r} AS MATERIALIZED (SELECT label, n, q FROM (SELECT label, count(*) AS n FROM l{r} GROUP BY 1) JOIN (SELECT label, sum(s * s) AS q FROM s{r} GROUP BY 1) USING (label))",
            f"d{r} AS MATERIALIZED (SELECT sz.cascade_id, c{r}.label, sz.n AS m, CAST(q - 2 * coalesce(dot, 0) * c{r}.n AS DOUBLE) / CAST(c{r}.n * c{r}.n AS DOUBLE) AS part FROM sz CROSS JOIN c{r} LEFT JOIN (SELECT cascade_id, label, sum(s) AS dot FROM act JOIN s{r} USING (user_id) GROUP BY 1, 2) x ON x.cascade_id = sz.cascade_id AND x.label = c{r}.label)",
            f"l{r + 1} AS MATERIALIZED (SELECT cascade_id, label, m + part AS distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY cascade_id ORDER BY part, label) = 1)",
        ]
    return f"{R}{_PAIRS.replace(', act AS (', ', act AS MATERIALIZED (').replace(chr(10) + 'act AS (', chr(10) + 'act AS MATERIALIZED (')}, {', '.join(steps)} SELECT cascade_id, CAST(label AS INTEGER) AS label, round(distance, 6) AS distance FROM l{rounds + 1}"


@query(_user_means_sql(20, 20))
def kmeans_users(s: SparkSession, d: str) -> DataFrame:
    """Means of the cascade-user matrix."""
    return clusters.user_means(act_of(s, d)).withColumn("distance", F.round("distance", 6))


# evidence, features and sequence models

_EV = f"""{_ACT}, ix AS (SELECT dst AS v, src AS u, row_number() OVER (PARTITION BY dst ORDER BY src) AS pos, count(*) OVER (PARTITION BY dst) AS d FROM g),
se AS (SELECT n.cascade_id, ix.v, n.depth, ix.pos, ix.d, o.depth AS own, (o.parent_id = ix.u) AS par FROM nodes n JOIN ix ON ix.u = n.user_id LEFT JOIN nodes o ON o.cascade_id = n.cascade_id AND o.user_id = ix.v WHERE o.depth IS NULL OR o.depth = 0 OR n.depth < o.depth),
st AS (SELECT cascade_id, v, depth, list_sort(list(pos)) AS active, any_value(d) AS d, any_value(own) AS own, max(pos) FILTER (par) AS ph FROM se GROUP BY 1, 2, 3),
ev AS (SELECT cascade_id, v, depth, active, d, CAST(CASE WHEN depth = max(depth) OVER w AND own > 0 THEN coalesce(max(ph) OVER w, 0) ELSE 0 END AS INT) AS state FROM st WINDOW w AS (PARTITION BY cascade_id, v))"""


@query(f"{R}{_EV} SELECT cascade_id, v, depth, array_to_string(active, ',') AS active, d, state FROM ev")
def evidence_sequences(s: SparkSession, d: str) -> DataFrame:
    """Observations and states of receivers (V1, V3, V4)."""
    e = features.evidence(nodes_of(s, d), graph_of(s, d))
    return e.select("cascade_id", "v", "depth", F.array_join(F.col("active").cast("array<string>"), ",").alias("active"), "d", "state")


@query(f"{R}{_EV} SELECT DISTINCT v FROM ev WHERE state > 0")
def active_users(s: SparkSession, d: str) -> DataFrame:
    """Users who ever act."""
    return features.ever_active(nodes_of(s, d), graph_of(s, d))


@query(f"{R}{_EV}, b AS (SELECT cascade_id, v, depth, state, d, list_sort(list_distinct(flatten(list(active) OVER (PARTITION BY cascade_id, v ORDER BY depth ROWS UNBOUNDED PRECEDING)))) AS seen FROM ev) SELECT cascade_id, v, depth, state, d, array_to_string(seen, ',') AS seen, d + 1 - len(seen) AS slack FROM b")
def bin_features(s: SparkSession, d: str) -> DataFrame:
    """Cumulative features with a slack."""
    b = features.bin_features(evidence_of(s, d))
    return b.withColumn("seen", F.array_join(F.col("seen").cast("array<string>"), ","))


@query(
    f"""{R}{_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY cascade_id, v ORDER BY depth) AS n FROM ev), lg AS (SELECT v, max(n)::INTEGER AS lags FROM n GROUP BY 1),
o AS (SELECT a.cascade_id, a.v, a.n, list_sort(list(b.pos + (a.n - b.m) * a.d)) AS o FROM n a JOIN (SELECT cascade_id, v, n AS m, unnest(active) AS pos FROM n) b ON a.cascade_id = b.cascade_id AND a.v = b.v AND b.m <= a.n GROUP BY 1, 2, 3)
SELECT cascade_id, v, depth, state, d, array_to_string(o, ',') AS "on", lags, lags * d + 1 - len(o) AS slack FROM n JOIN o USING (cascade_id, v, n) JOIN lg USING (v)"""
)
def long_features(s: SparkSession, d: str) -> DataFrame:
    """All observations so far, the newest first, and how long each receiver's history can be."""
    b = features.long_features(evidence_of(s, d))
    return b.withColumn("on", F.array_join(F.col("on").cast("array<string>"), ","))


@query(f"{R}{_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY cascade_id, v ORDER BY depth) AS n FROM ev) SELECT a.cascade_id, a.v, a.depth, b.pos, round(sum(power(0.5, a.n - b.m)), 9) AS x FROM n a JOIN (SELECT cascade_id, v, n AS m, unnest(active) AS pos FROM n) b ON a.cascade_id = b.cascade_id AND a.v = b.v AND b.m <= a.n GROUP BY 1, 2, 3, 4")
def decayed_features(s: SparkSession, d: str) -> DataFrame:
    """Features that fade with time."""
    return features.decayed(evidence_of(s, d), 0.5).withColumn("x", F.round("x", 9))


@query(f"{R}{_EV} SELECT DISTINCT v, unnest(active) AS pos FROM ev")
def reduced_parents(s: SparkSession, d: str) -> DataFrame:
    """Sources that ever act."""
    return features.reduced_parents(evidence_of(s, d))


@cache
def fitted_of(method: str) -> Query:
    """A method of experiment.METHODS fitted on all cascades; made once for a session and data folder."""
    packed = experiment.compact(method)
    keep = (lambda df: written(df, "fitted")) if packed else settled
    return _once(f"fitted {method}", lambda s, d: experiment.METHODS[method][0](experiment.Data(nodes_of(s, d), act_of(s, d)), graph_of(s, d), **packed), keep)


def _predicted(s: SparkSession, d: str, method: str) -> DataFrame:
    """What a method fitted on all cascades predicts from their first two levels, at 0.3."""
    return experiment.METHODS[method][1](trees.truncated(nodes_of(s, d), 1), graph_of(s, d), fitted_of(method)(s, d), [0.3], None)


@query()
def memm_fit(s: SparkSession, d: str) -> DataFrame:
    """A maximum-entropy model for each receiver."""
    return seqlabel.memm_rows(fitted_of("mbmemm")(s, d))


@query()
def memm_long_fit(s: SparkSession, d: str) -> DataFrame:
    """The same on whole histories (M8)."""
    return seqlabel.memm_rows(fitted_of("mlmemm")(s, d))


@query()
def memm_predict(s: SparkSession, d: str) -> DataFrame:
    """Prediction with these models until no frontier grows (2.10 j, J19)."""
    return _predicted(s, d, "mbmemm")


@query()
def crf_fit(s: SparkSession, d: str) -> DataFrame:
    """A linear-chain CRF for each receiver (M9, M11); a state for each parent."""
    return seqlabel.crf_rows(fitted_of("mbcrf")(s, d))


@query()
def memm_long_predict(s: SparkSession, d: str) -> DataFrame:
    """Prediction with maximum-entropy models on whole histories until no frontier grows (M8)."""
    return _predicted(s, d, "mlmemm")


@query()
def memm_binary_predict(s: SparkSession, d: str) -> DataFrame:
    """Prediction with two states; the parent is the newly active source of the largest weight."""
    return _predicted(s, d, "bmemm")


@query()
def crf_predict(s: SparkSession, d: str) -> DataFrame:
    """Prediction with CRFs until no frontier grows; the parent is the likeliest newly active state (M9)."""
    return _predicted(s, d, "mbcrf")


@query()
def crf_long_predict(s: SparkSession, d: str) -> DataFrame:
    """The same on whole histories."""
    return _predicted(s, d, "mlcrf")


@query()
def crf_binary_predict(s: SparkSession, d: str) -> DataFrame:
    """The same with two states."""
    return _predicted(s, d, "bcrf")


@query()
def mrf_predict(s: SparkSession, d: str) -> DataFrame:
    """Prediction with the random field."""
    return _predicted(s, d, "unimrf")


_MR = f"""{_EV.split('se AS')[0]}ms AS (SELECT n.cascade_id, ix.v, n.depth, list(ix.pos) AS active, any_value(ix.d) AS d, any_value(o.depth) AS own FROM nodes n JOIN ix ON ix.u = n.user_id LEFT JOIN nodes o ON o.cascade_id = n.cascade_id AND o.user_id = ix.v WHERE o.depth IS NULL OR n.depth < o.depth GROUP BY 1, 2, 3),
mt AS (SELECT cascade_id, v, depth, list_sort(list_distinct(flatten(list(active) OVER (PARTITION BY cascade_id, v ORDER BY depth ROWS UNBOUNDED PRECEDING)))) AS seen, d, CAST(coalesce(own = depth + 1, false) AS INT) AS state FROM ms)"""


@query(f"{R}{_MR} SELECT v, pos, count(*) AS n, sum(state)::BIGINT AS n_active FROM (SELECT v, state, unnest(seen) AS pos FROM mt) GROUP BY 1, 2")
def mrf_features(s: SparkSession, d: str) -> DataFrame:
    """Sums of transition features."""
    return mrf.feature_sums(mrf.transitions(nodes_of(s, d), graph_of(s, d)))


@query()
def mrf_fit(s: SparkSession, d: str) -> DataFrame:
    """A random field of all users with joint samples."""
    return fitted_of("unimrf")(s, d)


@query(
    f"""{R}{_EV.split('se AS')[0]}fl AS (SELECT u, v, pos FROM ix UNION ALL SELECT DISTINCT v, v, 0 FROM ix), dp AS (SELECT cascade_id, max(depth) AS deepest FROM nodes GROUP BY 1),
lv AS (SELECT cascade_id, deepest, unnest(range(0, deepest)) AS t FROM dp),
ob AS (SELECT fl.u, fl.v, count(*) AS c FROM lv JOIN nodes a ON a.cascade_id = lv.cascade_id AND a.depth <= t JOIN fl ON fl.u = a.user_id JOIN nodes b ON b.cascade_id = lv.cascade_id AND b.user_id = fl.v AND b.depth <= t + 1 GROUP BY 1, 2)
SELECT fl.u, fl.v, pos, coalesce(c, 0)::DOUBLE AS c FROM fl LEFT JOIN ob ON ob.u = fl.u AND ob.v = fl.v"""
)
def mrf_joint_sums(s: SparkSession, d: str) -> DataFrame:
    """Observed sums of the joint field's features."""
    return mrf.joint_sums(nodes_of(s, d), mrf.field_edges(graph_of(s, d)))


@query(f"{R}{_ACT} SELECT '0 !isActivated(\"N' || src || '\", c) v activates(\"N' || src || '\", \"N' || dst || '\", c)' AS value FROM g")
def mln_rules(s: SparkSession, d: str) -> DataFrame:
    """Rules of a Markov-logic network."""
    return mln.rules(graph_of(s, d))


@query(f"{R}{_ACT} SELECT 'isActivated(\"N' || user_id || '\", \"C' || cascade_id || '\")' AS value FROM nodes UNION ALL SELECT 'activates(\"N' || parent_id || '\", \"N' || user_id || '\", \"C' || cascade_id || '\")' FROM nodes WHERE parent_id IS NOT NULL")
def mln_evidence(s: SparkSession, d: str) -> DataFrame:
    """Evidence of a Markov-logic network (K6)."""
    return mln.evidence(nodes_of(s, d))


@query(f"{R}{_ACT}, {_K0} SELECT u, v, round((k - (SELECT min(k) FROM k0)) / ((SELECT max(k) FROM k0) - (SELECT min(k) FROM k0)), 9) AS k FROM k0")
def mln_normalise(s: SparkSession, d: str) -> DataFrame:
    """Weights between 0 and 1."""
    return mln.normalised(em.initial_k(graph_of(s, d)).withColumnRenamed("k", "weight")).withColumn("k", F.round("k", 9))


@query()
def reply_cascades(s: SparkSession, d: str) -> DataFrame:
    """Cascades of replies: a turn replies to the one before it."""
    e = adapter.reshares(s, d)
    t = adapter.posts(s, d).join(e.select("post_id", F.col("reshared_post_id").alias("reply_to_id")), "post_id", "left")
    return trees.reply_cascades(t.select(F.col("post_id").alias("tweet_id"), F.col("author_id").alias("user_id"), "datetime", "reply_to_id"))

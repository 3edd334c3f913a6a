"""Queries of the readers and the store: the driver's tables are written in a raw format, whole, and read back; SQL gives the same rows from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph import queries as Q
from tidegraph.functions import scalar as C
from tidegraph.operators import cascades, graphs, trees
from tidegraph.plans import mln
from tidegraph.plans.loops import shared_path
from tidegraph.queries import _ACT, _CASC, _PC, _RS, _TREE, ORACLE_SQL, R, query
from tidegraph.sources import adapter, readers, store

#: Records in a raw file, about.
RECORDS = 20_000


def _dumped(df: DataFrame, key: str, record: Column, name: str, head: str = "", between: str = "\n", tail: str = "") -> str:
    """Writes the records of df, in the order of key, into raw files that begin with ``head`` and end with ``tail``; gives their folder."""
    spark = df.sparkSession
    files = df.count() // RECORDS + 1
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("file"), F.struct(F.col(key).alias("k"), record.alias("v")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"]), between)
    path = shared_path(spark, name)
    rows.groupBy("file").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias("value")).write.partitionBy("file").text(path)
    return path


def _ranked(s: SparkSession, d: str) -> DataFrame:
    """Posts with what they reshare: post_id, cascade_id, author_id, datetime, and of the reshared post its id, user and time."""
    e = adapter.reshares(s, d).select("post_id", "reshared_post_id", "ref_user_id", "ref_datetime")
    return adapter.postcascades(s, d).join(e, "post_id", "left")


_UP = f"{_RS}, up AS (SELECT pc.*, rs.reshared_post_id, rs.ref_user_id, rs.ref_datetime FROM pc LEFT JOIN rs ON rs.post_id = pc.post_id)"


def _second(column: str) -> str:
    return f"date_trunc('second', {column})"


@query("SELECT lpad(c_custkey::VARCHAR, 24, '0') AS user_id, c_name AS username FROM customer")
def weibo_users(s: SparkSession, d: str) -> DataFrame:
    """Users from records of 15 lines."""
    record = F.concat(F.col("c_custkey").cast("string"), F.lit("\n" + "-\n" * 7), F.col("c_name"), F.lit("\n-" * 6))
    return readers.weibo_users(s, _dumped(adapter.table(s, d, "customer"), "c_custkey", record, "users", "x\n" * 15))


@query("SELECT lpad(event_id::VARCHAR, 24, '0') AS post_id, user_id || ' ' || event_id % 1000 AS tokens FROM events")
def weibo_roots(s: SparkSession, d: str) -> DataFrame:
    """Root posts and their tokens between lines that do not count (S3)."""
    record = F.concat(F.col("event_id").cast("string"), F.lit("\n"), F.col("user_id").cast("string"), F.lit(" "), (F.col("event_id") % 1000).cast("string"), F.lit("\n@a b\nlink x\n"))
    out = readers.weibo_roots(s, _dumped(adapter.table(s, d, "events"), "event_id", record, "roots"))
    return out.select("post_id", F.concat_ws(" ", F.col("tokens").cast("array<string>")).alias("tokens"))


@query(
    f"""WITH {_RS}, t AS (SELECT a.cascade_id, a.rn, a.author_id::VARCHAR AS who, {_second('a.datetime')} AS t, p.rn AS prn, p.author_id::VARCHAR AS pu, z.author_id::VARCHAR AS ru, {_second('z.datetime')} AS rt
FROM rk a JOIN rk p ON p.cascade_id = a.cascade_id AND p.rn = a.rn // 2 JOIN rk z ON z.cascade_id = a.cascade_id AND z.rn = 1 WHERE a.rn > 1)
SELECT cascade_id, who AS user_id, ru AS ref_user_id, t AS datetime, rt AS ref_datetime FROM t WHERE prn = 1
UNION ALL SELECT cascade_id, pu, ru, t - INTERVAL 10 MICROSECOND, rt FROM t WHERE prn > 1
UNION ALL SELECT cascade_id, who, pu, t, t - INTERVAL 10 MICROSECOND FROM t WHERE prn > 1"""
)
def weibo_retweets(s: SparkSession, d: str) -> DataFrame:
    """Edges of retweet paths (S4, W9): a post retweets the first one, over the post that it reshares."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd-HH:mm:ss")
    up = _ranked(s, d)
    first = up.where("reshared_post_id is null").groupBy("cascade_id").agg(F.min(F.struct("datetime", "post_id", "author_id")).alias("root"))
    more = up.where("reshared_post_id is not null").join(first, "cascade_id")
    over = F.when(F.col("reshared_post_id") == F.col("root.post_id"), F.lit("")).otherwise(F.concat(F.lit("\nretweet "), F.col("ref_user_id").cast("string")))
    line = F.concat(F.col("author_id").cast("string"), F.lit(" "), stamp("datetime"), F.lit(" x\ncontent"), over)
    told = more.groupBy("cascade_id").agg(F.array_sort(F.collect_list(F.struct("post_id", line.alias("v")))).alias("r"), F.first("root").alias("root"))
    n = F.size("r").cast("string")
    record = F.concat("cascade_id", F.lit(" "), F.col("root.author_id").cast("string"), F.lit(" "), stamp("root.datetime"), F.lit(" "), n, F.lit("\n"), n, F.lit("\n"), F.array_join(F.transform("r", lambda x: x["v"]), "\n"))
    return readers.weibo_retweets(s, _dumped(told, "cascade_id", record, "retweets"), "UTC")


@query(
    """WITH n AS (SELECT count(*) AS n FROM customer), c AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS u FROM customer),
e AS (SELECT u, u * 7 % n AS v, u % 2 AS t FROM c, n UNION ALL SELECT u, (u * 13 + 5) % n, 0 FROM c, n),
k AS (SELECT lpad(x.id::VARCHAR, 24, '0') AS a, lpad(y.id::VARCHAR, 24, '0') AS b, t FROM e JOIN c x ON x.u = e.u JOIN c y ON y.u = e.v)
SELECT b AS parent, a AS child FROM k UNION SELECT a, b FROM k WHERE t = 1"""
)
def weibo_relations(s: SparkSession, d: str) -> DataFrame:
    """Who leads whom, from lines of indices into a list of ids."""
    people = adapter.table(s, d, "customer").select(F.col("c_custkey"), (F.row_number().over(Window.orderBy("c_custkey")) - 1).alias("u"))  # the format has one list of all ids
    n, u, ids = people.count(), F.col("u"), shared_path(s, "ids")
    people.orderBy("u").coalesce(1).select(F.col("c_custkey").cast("string")).write.text(ids)
    line = F.concat_ws(" ", *[x.cast("string") for x in (u, F.lit(2), u * 7 % n, u % 2, (u * 13 + 5) % n, F.lit(0))])
    return readers.weibo_relations(s, _dumped(people, "u", line, "relations", "head\n"), ids + "/part-*")


def _memes(s: SparkSession, d: str) -> dict[str, DataFrame]:
    url = lambda u, p: F.concat(F.lit("http://site"), (F.col(u) % 50).cast("string"), F.lit(".com/"), F.col(p).cast("string"))
    link = F.when(F.col("reshared_post_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("L\t"), url("ref_user_id", "reshared_post_id"), F.lit("\n")))
    record = F.concat(F.lit("P\t"), url("author_id", "post_id"), F.lit("\nT\t"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"), F.lit("\nQ\tphrase "), "cascade_id", F.lit("\n"), link)
    return readers.memetracker(s, _dumped(_ranked(s, d), "post_id", record, "memes"))


_MEME = f"{_UP}, m AS (SELECT 'http://site' || author_id % 50 || '.com/' || post_id AS url, 'site' || author_id % 50 || '.com' AS host, {_second('datetime')} AS t, 'phrase ' || cascade_id AS q, 'http://site' || ref_user_id % 50 || '.com/' || reshared_post_id AS l, 'site' || ref_user_id % 50 || '.com' AS lh, {_second('ref_datetime')} AS lt FROM up)"


@query(f"WITH {_MEME} SELECT url AS post_id, host AS author_id, t AS datetime, url FROM m")
def meme_posts(s: SparkSession, d: str) -> DataFrame:
    """Posts of P and T lines."""
    return _memes(s, d)["posts"]


@query(f"WITH {_MEME} SELECT DISTINCT md5(q) AS cascade_id, q AS text FROM m")
def meme_cascades(s: SparkSession, d: str) -> DataFrame:
    """Cascades of Q lines."""
    return _memes(s, d)["cascades"]


@query(f"WITH {_MEME} SELECT url AS post_id, md5(q) AS cascade_id, host AS author_id, t AS datetime FROM m")
def meme_postcascades(s: SparkSession, d: str) -> DataFrame:
    """Who quotes what."""
    return _memes(s, d)["postcascades"]


@query(f"WITH {_MEME} SELECT url AS post_id, l AS reshared_post_id, host AS user_id, lh AS ref_user_id, t AS datetime, lt AS ref_datetime FROM m WHERE l IS NOT NULL")
def meme_reshares(s: SparkSession, d: str) -> DataFrame:
    """Reshares of L lines."""
    return _memes(s, d)["reshares"]


@query(f"WITH {_MEME} SELECT l AS to, url AS post_id FROM m WHERE l IS NOT NULL")
def meme_links(s: SparkSession, d: str) -> DataFrame:
    """Links, each checked to have its post."""
    t = _memes(s, d)
    return readers.checked_links(t["links"], t["posts"])


@query(f"WITH {_UP} SELECT 'u' || author_id AS username, post_id::VARCHAR AS tweet_id, {_second('datetime')} AS date, reshared_post_id::VARCHAR AS reply_to_id FROM up")
def tweets(s: SparkSession, d: str) -> DataFrame:
    """Tweets of records with links."""
    reply = F.when(F.col("reshared_post_id").isNull(), F.lit("-1")).otherwise(F.concat(F.lit("u"), F.col("ref_user_id").cast("string"), F.lit(" "), F.col("reshared_post_id").cast("string")))
    record = F.concat_ws("\n", F.concat(F.lit("u"), F.col("author_id").cast("string")), F.col("post_id").cast("string"), F.date_format("datetime", "EEE MMM dd HH:mm:ss +0000 yyyy"), F.lit("x"), F.lit("-1"), reply, F.lit("text"), F.lit("1"), F.lit("http://l"), F.lit(""))
    return readers.tweets(s, _dumped(_ranked(s, d), "post_id", record, "tweets"))


def _covid(s: SparkSession, d: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm")
    repost = F.when(F.col("ref_user_id").isNotNull(), F.struct(F.concat(F.lit("n"), F.col("ref_user_id").cast("string")).alias("username"), stamp("ref_datetime").alias("timestamp")))
    record = F.to_json(F.struct(F.col("author_id").cast("string").alias("user_id"), stamp("datetime").alias("timestamp"), repost.alias("repost")))
    return readers.covid_posts(s, _dumped(_ranked(s, d), "post_id", record, "covid", "[", ",", "]"))


@query(f"WITH {_UP} SELECT author_id::VARCHAR AS user_id, date_trunc('minute', datetime) AS datetime, 'n' || ref_user_id AS ref_username, date_trunc('minute', ref_datetime) AS ref_datetime FROM up")
def covid_posts(s: SparkSession, d: str) -> DataFrame:
    """Posts of nested JSON arrays."""
    return _covid(s, d)


_KNOWN = "CASE WHEN ref_user_id % 2 = 0 THEN ref_user_id::VARCHAR ELSE left(md5('n' || ref_user_id), 24) END"


@query(
    f"""WITH {_UP}, v AS (SELECT DISTINCT author_id::VARCHAR AS user_id, {_KNOWN} AS ref_user_id, date_trunc('minute', datetime) AS datetime, date_trunc('minute', ref_datetime) AS ref_datetime FROM up WHERE ref_user_id IS NOT NULL)
SELECT user_id || '@' || strftime(datetime, '%Y%m%d%H%M') AS post_id, ref_user_id || '@' || strftime(ref_datetime, '%Y%m%d%H%M') AS reshared_post_id, user_id, ref_user_id, datetime, ref_datetime FROM v WHERE user_id <> ref_user_id"""
)
def covid_reshares(s: SparkSession, d: str) -> DataFrame:
    """Reshares by user and minute; names that are not known get an id."""
    posts = _covid(s, d)
    known = adapter.postcascades(s, d).where("author_id % 2 = 0").select(F.col("author_id").cast("string").alias("user_id"), F.concat(F.lit("n"), F.col("author_id").cast("string")).alias("username")).distinct()
    return readers.covid_reshares(posts, readers.with_users(posts.select(F.col("ref_username").alias("username")), known))


@query(
    f"""WITH {_PC}, own AS (SELECT cascade_id, author_id AS user_id, min(datetime) AS own FROM pc GROUP BY 1, 2),
got AS (SELECT cascade_id, author_id AS ref_user_id, datetime AS ref_datetime, post_id, author_id + 1 AS user_id FROM pc UNION ALL SELECT cascade_id, author_id, datetime, post_id, author_id * 7 FROM pc),
f AS (SELECT *, row_number() OVER (PARTITION BY cascade_id, user_id ORDER BY ref_datetime, post_id) AS n FROM got WHERE user_id <> ref_user_id)
SELECT cascade_id, 'u' || user_id AS user_id, 'u' || ref_user_id AS ref_user_id, coalesce(own, ref_datetime + INTERVAL 1 DAY) AS datetime, ref_datetime FROM f LEFT JOIN own USING (cascade_id, user_id) WHERE n = 1"""
)
def mail_reshares(s: SparkSession, d: str) -> DataFrame:
    """The first mail of a thread to an address as a reshare (B7): a post is a mail to two addresses."""
    at = lambda c: F.concat(F.lit("u"), c.cast("string"))
    a = F.col("author_id")
    mail = adapter.postcascades(s, d).select(F.col("post_id").alias("mail_id"), F.col("cascade_id").alias("thread"), at(a).alias("sender"), F.array(at(a + 1), at(a * 7)).alias("to"), F.col("datetime").alias("date"))
    return readers.thread_reshares(mail)


def _mails(s: SparkSession, d: str) -> DataFrame:
    """A mail for each turn of a conversation, between two people, with the first words of the conversation as subject, some with a mark or one word more."""
    t = adapter.table(s, d, "conversations").where("conv_id is not null and turn is not null")
    topic = t.groupBy("conv_id").agg(F.array_join(F.slice(C.words(F.min_by("text", "turn")), 1, 4), " ").alias("topic"))
    person = lambda x: F.concat(F.lit("p"), F.pmod(F.xxhash64("conv_id", x), F.lit(40)).cast("string"))
    even = F.col("turn") % 2 == 0
    return t.join(topic, "conv_id").select(
        (F.col("conv_id") * 10_000 + F.col("turn")).alias("mail_id"),
        (F.col("conv_id") * 10_000 + F.col("turn")).alias("place"),
        F.when(even, person(F.lit(0))).otherwise(person(F.lit(1))).alias("sender"),
        F.array(F.when(even, person(F.lit(1))).otherwise(person(F.col("turn")))).alias("to"),
        F.concat_ws(" ", F.when(F.col("turn") > 0, F.lit("re")), "topic", F.when(F.col("turn") % 3 == 2, F.lit("more"))).alias("subject"),
    )


@query()
def mail_threads(s: SparkSession, d: str) -> DataFrame:
    """Mails in threads, the first that matches."""
    return readers.threads(_mails(s, d)).select("mail_id", "thread")


# store


@query(f"{R}{_TREE} SELECT cascade_id, user_id::VARCHAR AS user_id, parent_id::VARCHAR AS parent_id, act_time, depth FROM nodes")
def trees_in_json(s: SparkSession, d: str) -> DataFrame:
    """Trees written as nested JSON and read again."""
    return store.trees_from_json(store.trees_to_json(Q.nodes_of(s, d)))


@query(f"{R}{_ACT} SELECT src, dst FROM g")
def stored_graph(s: SparkSession, d: str) -> DataFrame:
    """A graph saved in a project, overwritten and loaded."""
    p = store.Project(s, shared_path(s, "project"), "sample")
    graph = Q.graph_of(s, d)
    p.save(graph.where("src < dst"), "graph")
    p.save(graph, "graph")
    return p.load("graph")


@query(f"{R}{_TREE}, k AS (SELECT DISTINCT cascade_id, user_id FROM nodes WHERE depth = 1) SELECT cascade_id, user_id FROM k")
def stored_by_key(s: SparkSession, d: str) -> DataFrame:
    """An artefact made once for a set of cascades and found by its key, whatever their order."""
    p = store.Project(s, shared_path(s, "project"), "sample")
    ids = Q.cascades_of(s, d).select("cascade_id")
    make = lambda: Q.nodes_of(s, d).where("depth = 1").select("cascade_id", "user_id")
    p.load_or("evidences", make, store.set_key(ids))
    return p.load_or("evidences", lambda: make().limit(0), store.set_key(ids.orderBy(F.desc("cascade_id"))))


@query(ORACLE_SQL["degrees"])
def degree_report(s: SparkSession, d: str) -> DataFrame:
    """The report of degrees, written as separated text and read again (K5)."""
    found, path = Q.QUERIES["degrees"](s, d), shared_path(s, "report")
    store.save_report(found, path)
    return s.read.schema(found.schema).option("header", True).option("sep", "\t").csv(path)


@query("WITH n AS (SELECT event_type AS method, count(*) AS c, (SELECT count(*) FROM events) AS t FROM events GROUP BY 1) SELECT method, 0.0::DOUBLE AS fpr, c / t AS tpr FROM n UNION ALL SELECT method, 1.0, 1.0 FROM n")
def roc_results(s: SparkSession, d: str) -> DataFrame:
    """Curves read from JSON results by the names of their files (S13): a method for each type of event."""
    e, root = adapter.table(s, d, "events"), shared_path(s, "roc")
    total = e.count()
    found = e.groupBy("event_type").count().select(F.concat(F.lit("sample-"), "event_type", F.lit("-auc")).alias("name"), F.array(F.lit(0.0), F.lit(1.0)).alias("fpr"), F.array(F.col("count") / total, F.lit(1.0)).alias("tpr"))
    found.write.partitionBy("name").json(root)
    return store.roc_results(s, root, "sample", "auc")


@query(f"{R}{_ACT} SELECT src AS u, dst AS v, (src % 10 - 4) / 10 AS weight FROM g")
def mln_weights(s: SparkSession, d: str) -> DataFrame:
    """Weights read from a learner's result."""
    line = F.concat(((F.col("src") % 10 - 4) / 10).cast("string"), F.lit(" !isActivated(\"N"), F.col("src").cast("string"), F.lit("\",v0) v activates(\"N"), F.col("src").cast("string"), F.lit("\",\"N"), F.col("dst").cast("string"), F.lit("\",v0)"))
    path = _dumped(Q.graph_of(s, d).withColumn("key", F.concat_ws("-", "src", "dst")), "key", line, "weights", "", "\n", "\n// end\n9 !isActivated(\"N1\",v0) v activates(\"N1\",\"N2\",v0)")
    return mln.weights(s, path, "// end")


# what else had no query


@query(f"WITH {_PC} SELECT DISTINCT author_id FROM pc WHERE author_id NOT IN (SELECT author_id FROM pc WHERE cascade_id = (SELECT min(cascade_id) FROM pc))")
def new_authors(s: SparkSession, d: str) -> DataFrame:
    """Keys that are not there yet (J10): authors who are not in the first cascade by name."""
    pc = adapter.postcascades(s, d)
    first = pc.agg(F.min("cascade_id")).first()[0]
    return cascades.new_only(pc.select("author_id").distinct(), pc.where(F.col("cascade_id") == first), ["author_id"])


@query(f"{R}{_CASC} SELECT cascade_id, CASE WHEN depth >= 3 THEN 0 ELSE size END AS size, CASE WHEN depth >= 3 THEN depth END AS depth FROM casc")
def upserted(s: SparkSession, d: str) -> DataFrame:
    """Attributes put over those there are (K2)."""
    c = Q.cascades_of(s, d)
    return cascades.upserted(c.select("cascade_id", "size"), c.where("depth >= 3").select("cascade_id", F.lit(0).cast("long").alias("size"), "depth"), ["cascade_id"])


@query(f"{R}{_RS}, {_TREE.split(', ', 1)[1].partition('r AS (')[1]}{_TREE.partition(', r AS (')[2].partition('flat AS (')[0]}nodes AS (SELECT *, 0 AS depth FROM touched WHERE parent_id IS NULL UNION ALL SELECT f.*, n.depth + 1 FROM touched f JOIN nodes n ON f.cascade_id = n.cascade_id AND f.parent_id = n.user_id) SELECT cascade_id, user_id, parent_id, act_time, depth FROM nodes")
def tree_of_reshares(s: SparkSession, d: str) -> DataFrame:
    """Trees of reshares alone: authors in no reshare are in no tree."""
    found = trees.cascade_reshares(adapter.reshares(s, d), adapter.postcascades(s, d))
    return trees.with_depth(trees.first_touch(found)).select("cascade_id", "user_id", "parent_id", "act_time", "depth")


@query(f"{R}{_ACT}, k AS (SELECT DISTINCT user_id FROM nodes WHERE parent_id IS NULL) SELECT src, dst FROM g WHERE src IN (FROM k) AND dst IN (FROM k)")
def graph_restricted(s: SparkSession, d: str) -> DataFrame:
    """The graph of some users (B11): those who start a tree."""
    return graphs.restricted(Q.graph_of(s, d), Q.nodes_of(s, d).where("parent_id is null").select("user_id").distinct())


@query(f"WITH {_PC} SELECT cascade_id, count(DISTINCT post_id) AS n_posts FROM pc GROUP BY 1")
def distinct_posts(s: SparkSession, d: str) -> DataFrame:
    """Different posts of each cascade (A5)."""
    return adapter.postcascades(s, d).select("cascade_id", "post_id").distinct().groupBy("cascade_id").agg(F.count(F.lit(1)).alias("n_posts"))


@query("SELECT conv_id, turn, role || '@x|' || conv_id || '@y' AS recipients FROM conversations")
def recipients(s: SparkSession, d: str) -> DataFrame:
    """Addresses of a folded header."""
    header = F.concat(F.col("role"), F.lit("@x,\n\t "), F.col("conv_id").cast("string"), F.lit("@y\n"))
    return adapter.table(s, d, "conversations").select("conv_id", "turn", F.array_join(C.recipients(header), "|").alias("recipients"))


@query("SELECT event_id, TRUE AS number, TRUE AS persian, FALSE AS word FROM events")
def numbers(s: SparkSession, d: str) -> DataFrame:
    """Texts of digits."""
    text = F.col("event_id").cast("string")
    return adapter.table(s, d, "events").select("event_id", C.is_number(text).alias("number"), C.is_number(F.translate(text, "0123456789", "۰۱۲۳۴۵۶۷۸۹")).alias("persian"), C.is_number(F.col("event_type")).alias("word"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '1' ELSE '0' END || CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END || '1' AS obs FROM events")
def observation_texts(s: SparkSession, d: str) -> DataFrame:
    """Observations as texts."""
    return adapter.table(s, d, "events").select("event_id", C.observation_text(F.array(F.col("user_id") % 2 == 0, F.col("event_id") % 3 == 0, F.lit(True))).alias("obs"))

"""Readers of five raw social data sets into the normalised schema: users, posts, cascades, reshares, relations.

Text files are read by Spark's splits; lines are numbered, and records told apart, by scans that carry a count or a place from one split of a file to
the next, so a file of any size is read in parallel. Only what no column function can decode (GB18030 text, mail heads) passes through a small pandas function.
"""

from __future__ import annotations

import email
from collections.abc import Callable
from email.policy import compat32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions.scalar import jaccard, padded_id, truncated_url, url_user, utc_time, words
from tidegraph.plans.loops import settled


def raw_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """file, block, at, line: the lines of text files, read by Spark's splits. block is where a line's split begins in its file; at orders the lines of a split and grows by 1.
    Encodings that Spark has no decoder for are decoded in Python, by lines: no other sign of theirs has the byte of a line's end."""
    value = F.col("value")
    if encoding.lower() == "iso-8859-1":
        value = F.decode(value.cast("binary"), "ISO-8859-1")
    elif encoding.lower() != "utf-8":

        @F.pandas_udf("string")
        def text_of(s: pd.Series) -> pd.Series:
            return s.map(lambda b: bytes(b).decode(encoding, errors="replace"))

        value = text_of(value.cast("binary"))
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.select("file", "block", "at", F.regexp_replace(value, "\r$", "").alias("line"))


#: Lines of a piece of a split, as a power of two: the most that a running value goes through in one order.
PIECE = 18


def _ahead(ends: DataFrame, how: Callable[[Column], Column], columns: list[str], *part: str) -> DataFrame:
    """For each split (or part of one), the columns combined over those before it in its file. ends: a row for each."""
    w = Window.partitionBy("file").orderBy("block", *part).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("file", "block", *part, *[how(F.col(c)).over(w).alias(c) for c in columns])


def _of_split(lines: DataFrame, ahead: DataFrame, *part: str) -> DataFrame:
    """lines with what comes from the splits before; a line whose split is unknown (the files were dealt out anew between two reads) is an error, not lost."""
    found = lines.join(F.broadcast(ahead.withColumn("__known", F.lit(True))), ["file", "block", *part], "left")  # a row for each split or piece: lines stay where they are
    return found.where(F.when(F.col("__known"), True).otherwise(F.raise_error(F.lit("splits changed while the files were read")).cast("boolean"))).drop("__known")


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """file, ln (from 1), line, block and at: lines numbered over all splits of a file. A split's lines follow its first; where it begins is the sum of the lines before."""
    lines = raw_lines(spark, path, encoding)
    ends = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("ln"), F.min("at").alias("first"))
    start = _ahead(ends, F.sum, ["ln"]).join(ends.select("file", "block", "first"), ["file", "block"])
    number = F.coalesce("ln", F.lit(0)) + F.col("at") - F.col("first") + 1
    return _of_split(lines, start).select("file", number.alias("ln"), "line", "block", "at")


def running(lines: DataFrame, how: Callable[[Column], Column], **columns: Column) -> DataFrame:
    """lines (file, block, at and others) with running values: how (F.sum or F.max) of a column over the lines of a file down to each line.

    A segmented scan: each piece of a split on its own, and what the pieces before it end with.
    """
    given = lines.withColumns({f"__{c}": x for c, x in columns.items()}).withColumn("__piece", F.shiftright("at", PIECE))
    ends = given.groupBy("file", "block", "__piece").agg(*[how(F.col(f"__{c}")).alias(f"__ahead_{c}") for c in columns])
    w = Window.partitionBy("file", "block", "__piece").orderBy("at")
    local = given.withColumns({f"__{c}": how(F.col(f"__{c}")).over(w) for c in columns})
    out = _of_split(local, _ahead(ends, how, [f"__ahead_{c}" for c in columns], "__piece"), "__piece")
    both = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how is F.sum else F.greatest
    return out.select(*lines.columns, *[both(F.col(f"__{c}"), F.col(f"__ahead_{c}")).alias(c) for c in columns])


def weibo_users(spark: SparkSession, path: str) -> DataFrame:
    """user_id, username: 15 head lines, then records of 15 lines with the id in the first and the name in the ninth."""
    body = numbered_lines(spark, path, "gb18030").where("ln > 15").withColumns({"rec": F.expr("(ln - 16) div 15"), "k": F.expr("(ln - 16) % 15")})
    rec = body.where("k in (0, 8)").groupBy("file", "rec").agg(F.max(F.when(F.col("k") == 0, F.trim("line"))).alias("id"), F.max(F.when(F.col("k") == 8, F.trim("line"))).alias("username"))
    return rec.where("id <> ''").groupBy(padded_id(F.col("id")).alias("user_id")).agg(F.min("username").alias("username"))


def weibo_roots(spark: SparkSession, path: str) -> DataFrame:
    """post_id, tokens: an id line and a line of token numbers, between lines that do not count."""
    useful = raw_lines(spark, path).where("trim(line) <> '' and not startswith(line, '@') and not startswith(line, 'link')")
    paired = running(useful, F.sum, n=F.lit(1)).groupBy("file", F.expr("(n + 1) div 2").alias("pair")).agg(F.max(F.when(F.col("n") % 2 == 1, F.trim("line"))).alias("id"), F.max(F.when(F.col("n") % 2 == 0, F.trim("line"))).alias("numbers"))
    return paired.select(padded_id(F.col("id")).alias("post_id"), F.split("numbers", r"\s+").cast("array<int>").alias("tokens"))


_STAMP = r"\d{4}-\d{1,2}-\d{1,2}-\d{1,2}:\d{1,2}:\d{1,2}"


def weibo_retweets(spark: SparkSession, path: str, zone: str = "Asia/Tehran") -> DataFrame:
    """cascade_id, user_id, ref_user_id (names or ids as in the file), datetime, ref_datetime: the paths of retweets as edges.

    A retweet by c over the path a, b gives root -> a -> b -> c; a step i of n before the last happens 10 microseconds earlier for each step left.

    Files are read by splits. A head (post, user, time, count) is followed by a line with the count, a retweet (user, time) by a line of content, which may look like anything. So of lines in a row that look
    like a head or a retweet, after one that does not, the first, third and so on are such and the others are content: the state of a reader follows from the last line before that looks otherwise.
    """
    looks = F.when(F.col("line").rlike(rf"^\S+\s+\S+\s+{_STAMP}\s+\d+"), "head").when(F.col("line").rlike(rf"^\S+\s+{_STAMP}(\s|$)"), "retweet")
    lines = numbered_lines(spark, path, "gb18030").withColumn("line", F.trim("line")).withColumn("looks", looks)
    read = running(lines, F.max, other=F.when(F.col("looks").isNull(), F.col("ln")))
    read = read.withColumn("real", F.when((F.col("ln") - F.coalesce("other", F.lit(0))) % 2 == 1, F.col("looks"))).drop("looks", "other")
    read = running(read, F.max, head=F.when(F.col("real") == "head", F.col("ln")), rt=F.when(F.col("real").isNotNull(), F.col("ln")))
    part = F.split("line", r"\s+")
    heads = read.where("real = 'head'").select("file", "head", part[0].alias("cascade_id"), part[1].alias("root_user"), part[2].alias("root_time"))
    over = F.when(F.col("real").isNull() & (F.col("ln") > F.col("rt") + 1) & F.col("line").rlike(r"^retweet(\s|$)"), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))))
    own = F.max(F.when(F.col("real") == "retweet", F.struct(part[0].alias("who"), part[1].alias("time")))).alias("own")
    told = read.where("rt > head and (real = 'retweet' or startswith(line, 'retweet'))").groupBy("file", "head", "rt").agg(own, F.max_by(over, F.when(over.isNotNull(), F.col("ln"))).alias("between"))
    raw = told.where("own is not null").join(heads, ["file", "head"])
    path_ = F.concat(F.array("root_user"), F.coalesce("between", F.array().cast("array<string>")), F.array("own.who"))
    fmt = "yyyy-MM-dd-HH:mm:ss"
    raw = raw.select("file", "cascade_id", "rt", path_.alias("path"), utc_time(F.col("own.time"), fmt, zone).alias("at"), utc_time(F.col("root_time"), fmt, zone).alias("root_at"))
    # each step of a path and the one before it
    n = F.size("path")
    when = lambda i: F.when(i == 0, F.col("root_at")).otherwise(F.timestamp_micros(F.unix_micros("at") - 10 * (n - i - 1)))
    edge = F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("path", i).alias("user_id"), F.get("path", i - 1).alias("ref_user_id"), when(i).alias("datetime"), when(i - 1).alias("ref_datetime"))))
    return raw.select("cascade_id", edge.alias("e")).select("cascade_id", "e.*")


def weibo_relations(spark: SparkSession, path: str, ids_path: str, only: DataFrame | None = None) -> DataFrame:
    """parent, child from lines ``u n (v type)*`` of indices into a list of ids: v leads u, and u leads v too if the type is 1. only: user_id of those wanted."""
    ids = numbered_lines(spark, ids_path).where("trim(line) <> ''").select((F.col("ln") - 1).alias("ix"), padded_id(F.trim("line")).alias("id"))
    p = numbered_lines(spark, path).where("ln > 1 and trim(line) <> ''").select(F.split(F.when(F.col("ln") > 1, F.trim("line")), r"\s+").cast("array<int>").alias("p"))
    pair = p.select(F.col("p")[0].alias("u"), F.explode(F.sequence(F.lit(1), F.greatest(F.col("p")[1], F.lit(0)))).alias("i"), "p").where("p[1] > 0").select("u", F.expr("p[2 * i]").alias("v"), F.expr("p[2 * i + 1]").alias("t"))
    named = pair.join(ids.select(F.col("ix").alias("u"), F.col("id").alias("uid")), "u").join(ids.select(F.col("ix").alias("v"), F.col("id").alias("vid")), "v")
    out = named.select(F.col("vid").alias("parent"), F.col("uid").alias("child")).union(named.where("t = 1").select("uid", "vid")).distinct()
    if only is not None:
        keep = only.select(F.col("user_id").alias("parent")).distinct()
        out = out.join(keep, "parent", "left_semi").join(keep.withColumnRenamed("parent", "child"), "child", "left_semi").select("parent", "child")
    return out


def memetracker(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """posts, cascades, postcascades, reshares and links (post_id, to: all ``L`` lines) of ``P``, ``T``, ``Q`` and ``L`` lines. The records of a file are counted over its lines in order. Links to no post make no reshare: see checked_links."""
    tagged = raw_lines(spark, path).where("line rlike '^[PTQL]\\t'").select("file", "block", "at", F.left("line", F.lit(1)).alias("tag"), F.substr("line", F.lit(3)).alias("value"))
    rec = running(tagged, F.sum, rec=(F.col("tag") == "P").cast("int"))
    head = rec.groupBy("file", "rec").agg(F.max(F.when(F.col("tag") == "P", truncated_url(F.col("value")))).alias("url"), F.max(F.when(F.col("tag") == "T", F.to_timestamp("value", "yyyy-MM-dd HH:mm:ss"))).alias("datetime"))
    posts = head.groupBy("url").agg(F.min("datetime").alias("datetime")).select(F.col("url").alias("post_id"), url_user(F.col("url")).alias("author_id"), "datetime", "url")
    quotes = rec.where("tag = 'Q'").select("file", "rec", F.col("value").alias("text")).join(head, ["file", "rec"])
    pc = quotes.select(F.col("url").alias("post_id"), F.md5("text").alias("cascade_id"), url_user(F.col("url")).alias("author_id"), "datetime").distinct()
    cascades = quotes.select(F.md5("text").alias("cascade_id"), "text").distinct()
    links = rec.where("tag = 'L'").select("file", "rec", truncated_url(F.col("value")).alias("to")).join(head, ["file", "rec"])
    target = posts.select(F.col("post_id").alias("to"), F.col("author_id").alias("ref_user_id"), F.col("datetime").alias("ref_datetime"))
    reshares = links.join(target, "to").select(F.col("url").alias("post_id"), F.col("to").alias("reshared_post_id"), url_user(F.col("url")).alias("user_id"), "ref_user_id", "datetime", "ref_datetime").distinct()
    return {"posts": posts, "cascades": cascades, "postcascades": pc, "reshares": reshares, "links": links.select(F.col("url").alias("post_id"), "to").distinct()}


def checked_links(links: DataFrame, posts: DataFrame) -> DataFrame:
    """links (post_id, to) with their target; a link to no post is an error."""
    hit = links.join(posts.select(F.col("post_id").alias("to"), F.lit(True).alias("__is")), "to", "left")
    return hit.where(F.when(F.col("__is"), True).otherwise(F.raise_error(F.concat(F.lit("no post "), F.col("to"))).cast("boolean"))).drop("__is")


def tweets(spark: SparkSession, path: str) -> DataFrame:
    """username, tweet_id, date, reply_to_id: records of eight lines (name, id, date, two that do not count before the reply, text, number of links), links, and a blank line.

    A record is known by its third line, a date after a line of digits: no other line of a record has both. So each line says for which records it can stand, and records are put together from there, wherever splits end.
    """
    line = F.trim("line")
    can = F.array_compact(
        F.array(
            F.struct(F.col("ln").alias("rec"), F.lit("username").alias("role")),
            F.when(line.rlike(r"^\d+$"), F.struct((F.col("ln") - 1).alias("rec"), F.lit("tweet_id").alias("role"))),
            F.when(line.rlike(r"^\w+ \w+ \d+ [\d:]+ \+0000 \d+$"), F.struct((F.col("ln") - 2).alias("rec"), F.lit("date").alias("role"))),
            F.when(line.rlike(r"^\S+\s+\S+"), F.struct((F.col("ln") - 5).alias("rec"), F.lit("reply").alias("role"))),
        )
    )
    parts = numbered_lines(spark, path, "iso-8859-1").select("file", line.alias("value"), F.explode(can).alias("c"))
    parts = parts.select("file", "c.rec", "c.role", "value").repartition("file", "rec")  # before the sums, which sort: a task then has a share of all records, not a split's
    rec = parts.groupBy("file", "rec").agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ("username", "tweet_id", "date", "reply")])
    day = F.regexp_replace("date", r"^\w+ (\w+ \d+ [\d:]+) \+0000 (\d+)$", "$1 $2")
    reply = F.split("reply", r"\s+")
    found = rec.where("username <> '' and tweet_id is not null and date is not null")
    return found.select("username", "tweet_id", F.to_timestamp(day, "MMM d HH:mm:ss yyyy").alias("date"), F.when((F.size(reply) > 1) & (reply[0] != "-1"), reply[1]).alias("reply_to_id"))


def mails(spark: SparkSession, path: str) -> DataFrame:
    """mail_id (path), place (the order: by mailbox, folder, path), user (mailbox), folder, sender, to, date (UTC, from US/Pacific), subject of the mails of a directory. Of a mailbox with all_documents
    only that folder counts, else inbox and sent_items."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    @F.pandas_udf("sender string, to string, date string, subject string")
    def heads(s: pd.Series) -> pd.DataFrame:
        out = []
        for b in s:
            raw = bytes(b)
            try:
                m = email.message_from_string(raw.decode("utf-8"), policy=compat32)
            except UnicodeDecodeError:
                m = email.message_from_string(raw.decode("iso-8859-1"), policy=compat32)
            out.append([m["From"], m["To"], m["Date"], m["Subject"]])
        return pd.DataFrame(out, columns=["sender", "to", "date", "subject"])

    part = F.split("path", "/")
    named = files.select("path", F.element_at(part, -3).alias("user"), F.element_at(part, -2).alias("folder"), heads("content").alias("m")).select("path", "user", "folder", "m.*")
    whole = named.where("folder = 'all_documents'").select("user").distinct().withColumn("whole", F.lit(True))
    kept = named.join(F.broadcast(whole), "user", "left").where("case when whole then folder = 'all_documents' else folder in ('inbox', 'sent_items') end")  # mailboxes: a row per person
    stamp = F.regexp_extract("date", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    to = F.when(F.col("to").isNull(), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("to", r"[\n\t ]", ""), ","))
    place = F.concat_ws("/", "user", "folder", F.element_at(F.split("path", "/"), -1))
    return kept.select(F.col("path").alias("mail_id"), place.alias("place"), "user", "folder", "sender", to.alias("to"), utc_time(stamp, "d MMM yyyy HH:mm:ss", "US/Pacific").alias("date"), "subject")


def similar_sets(sets: DataFrame, least: float = 0.5) -> DataFrame:
    """a, b: ids of different sets (id, w: words, each once) that share more than ``least`` of their words, in both directions.

    Words are ordered by how many sets have them, rare ones first. Two such sets share one of the first words of each, size - floor(least * size) of them, so a word
    that many sets have proposes pairs only where nothing rarer does.
    """
    word = sets.select("id", F.explode("w").alias("word"))
    often = word.groupBy("word").agg(F.count(F.lit(1)).alias("sets"))
    ordered = word.join(often, "word").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sets", "word"))), lambda x: x["word"]).alias("w"))
    size = F.size("w")
    first = ordered.select("id", size.alias("n"), F.explode(F.slice("w", 1, (size - F.floor(size * least)).cast("int"))).alias("word"))
    a, b = first.select(F.col("id").alias("a"), "n", "word"), first.select(F.col("id").alias("b"), F.col("n").alias("m"), "word")
    proposed = a.join(b, "word").where((F.col("a") < F.col("b")) & (F.least("n", "m") > least * F.greatest("n", "m"))).select("a", "b").distinct()
    x, y = sets.select(F.col("id").alias("a"), "w"), sets.select(F.col("id").alias("b"), F.col("w").alias("w2"))
    found = proposed.join(x, "a").join(y, "b").where(jaccard(F.col("w"), F.col("w2")) > least).select("a", "b")
    return found.union(found.select("b", "a"))


def _first_match(mails: pd.DataFrame) -> pd.DataFrame:
    """Threads of mails that can share threads, in order: a mail joins the first thread whose subjects are all similar to its own and in whose addresses is one of its own."""
    similar, first, users, subjects = {}, {}, {}, {}
    for r in mails.sort_values("place").itertuples():
        near = similar.setdefault(r.subject_set, {r.subject_set, *r.near})
        who = {r.sender, *r.to}
        for t in first:
            if who & users[t] and subjects[t] <= near:
                break
        else:
            t = r.mail_id
            first[t], users[t], subjects[t] = [], set(), set()
        users[t] |= who
        subjects[t].add(r.subject_set)
        first[t].append(r.mail_id)
    found = [(m, t) for t, members in first.items() for m in members]
    return pd.DataFrame(found, columns=["mail_id", "thread"])


def threads(mail: DataFrame, least: float = 0.5) -> DataFrame:
    """mail (mail_id, place, sender, to, subject and others) and thread, the mail_id of its first mail; threads of one mail and those with a subject that is a mere reply mark go.

    In the order of place (ties by mail_id are the caller's to break) a mail joins the first thread all of whose subjects share more than ``least`` of their words with its own and that knows its sender or an
    addressee. Mails without a subject or an addressee do not count; subjects without words are similar to nothing.

    Whatever shares a thread is connected over pairs (subject, address): mails of one subject, or of similar ones, with a common address. The components are found over these pairs, not over pairs of mails, with
    similar subjects from their rare words; then each component, a conversation, is gone through in order, one group for each. No order matters between components.
    """
    from tidegraph.operators.clusters import connected

    m = mail.where((F.col("subject") != "") & (F.size("to") > 0)).withColumn("w", F.array_sort(F.array_distinct(words(F.col("subject"))))).where("size(w) > 0")
    m = settled(m.withColumn("subject_set", F.xxhash64(F.array_join("w", " "))).withColumn("who", F.array_distinct(F.filter(F.array_union(F.array("sender"), "to"), lambda x: x.isNotNull()))))
    sets = settled(m.groupBy("subject_set").agg(F.first("w").alias("w")).select(F.col("subject_set").alias("id"), "w"))
    near = settled(similar_sets(sets, least))
    node = m.select("mail_id", "subject_set", F.explode("who").alias("address"))
    key = F.xxhash64("subject_set", "address")
    nodes = settled(node.select("subject_set", "address", key.alias("node")).distinct())
    across = nodes.join(near, nodes["subject_set"] == near["a"]).select("node", F.col("b").alias("subject_set"), "address").join(nodes.withColumnRenamed("node", "other"), ["subject_set", "address"]).select("node", "other")
    own = node.withColumn("node", key).groupBy("mail_id").agg(F.min("node").alias("first"), F.collect_set("node").alias("all"))
    inside = own.select(F.col("first").alias("node"), F.explode("all").alias("other")).where("node <> other").distinct()
    edges = inside.union(across.where("node < other"))
    labels = connected(edges.select(F.col("node").alias("i"), F.col("other").alias("j"), F.lit(1.0).alias("sim")), nodes.select(F.col("node").alias("cascade_id")), 1.0)
    placed = own.join(labels, own["first"] == labels["cascade_id"]).select("mail_id", F.col("label").alias("group"))
    similar = near.groupBy("a").agg(F.collect_set("b").alias("near"))
    given = m.join(placed, "mail_id").join(similar, F.col("subject_set") == F.col("a"), "left").select("group", "mail_id", "place", "subject_set", "sender", F.array_compact("to").alias("to"), F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    kind = mail.schema["mail_id"].dataType.simpleString()
    found = given.groupBy("group").applyInPandas(_first_match, f"mail_id {kind}, thread {kind}")
    marks = F.max(F.array_join(words(F.col("subject")), " ").isin("re", "fw", "fwd").cast("int"))
    kept = found.join(m.select("mail_id", "subject"), "mail_id").groupBy("thread").agg(F.count(F.lit(1)).alias("n"), marks.alias("mark")).where("n > 1 and mark = 0").select("thread")
    return mail.join(settled(found).join(settled(kept), "thread", "left_semi"), "mail_id")


def thread_reshares(mail: DataFrame) -> DataFrame:
    """cascade_id, user_id, ref_user_id, datetime, ref_datetime: the first mail of a thread to an address is a reshare of the sender's. An address acts at
    its own first mail, or a day after the one it got."""
    own = mail.groupBy(F.col("thread").alias("cascade_id"), F.col("sender").alias("user_id")).agg(F.min("date").alias("own"))
    got = mail.select(F.col("thread").alias("cascade_id"), F.col("sender").alias("ref_user_id"), F.col("date").alias("ref_datetime"), "mail_id", F.explode("to").alias("user_id"))
    w = Window.partitionBy("cascade_id", "user_id").orderBy("ref_datetime", "mail_id")
    first = got.where("user_id <> ref_user_id").withColumn("n", F.row_number().over(w)).where("n = 1")
    at = F.coalesce("own", F.col("ref_datetime") + F.expr("interval 1 day"))
    return first.join(own, ["cascade_id", "user_id"], "left").select("cascade_id", "user_id", "ref_user_id", at.alias("datetime"), "ref_datetime")


def covid_posts(spark: SparkSession, path: str) -> DataFrame:
    """user_id, datetime, ref_username, ref_datetime of JSON arrays; reposts have the last two."""
    schema = "user_id string, timestamp string, repost struct<username: string, timestamp: string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    at: Callable[[str], Column] = lambda c: F.to_timestamp(F.col(c), "yyyy-MM-dd'T'HH:mm")
    return raw.select("user_id", at("timestamp").alias("datetime"), F.col("repost.username").alias("ref_username"), at("repost.timestamp").alias("ref_datetime"))


def with_users(found: DataFrame, users: DataFrame) -> DataFrame:
    """users and those usernames of found (username) that it lacks, with an id made from the name."""
    new = found.select("username").where("username is not null").distinct().join(users, "username", "left_anti")
    return users.select("user_id", "username").unionByName(new.select(F.left(F.md5("username"), F.lit(24)).alias("user_id"), "username"))


def covid_reshares(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Reshares between posts found by user and minute; what is reshared but not there becomes a post."""
    named = posts.join(users.select(F.col("user_id").alias("ref_user_id"), F.col("username").alias("ref_username")), "ref_username", "left")
    post = lambda u, t: F.concat_ws("@", F.col(u), F.date_format(t, "yyyyMMddHHmm"))
    return named.where("ref_user_id is not null and user_id <> ref_user_id").select(post("user_id", "datetime").alias("post_id"), post("ref_user_id", "ref_datetime").alias("reshared_post_id"), "user_id", "ref_user_id", "datetime", "ref_datetime").distinct()



from datetime import datetime

import pytest

from tidegraph.operators import trees
from tidegraph.sources import readers, store


def test_weibo(spark, tmp_path):
    head = ["x"] * 15
    rec = lambda i, name: [str(i), *["-"] * 7, name, *["-"] * 6]
    (tmp_path / "users.txt").write_bytes("\n".join(head + rec(7, "王") + rec(8, "李") + rec(7, "王")).encode("gb18030"))
    assert {tuple(r) for r in readers.weibo_users(spark, str(tmp_path / "users.txt")).collect()} == {("7".zfill(24), "王"), ("8".zfill(24), "李")}
    (tmp_path / "roots.txt").write_text("11\n1 2 3\n@a b\nlink x\n\n12\n4\n")
    assert {(r["post_id"][-2:], tuple(r["tokens"])) for r in readers.weibo_roots(spark, str(tmp_path / "roots.txt")).collect()} == {("11", (1, 2, 3)), ("12", (4,))}
    (tmp_path / "rel.txt").write_text("head\n0 2 1 0 2 1\n1 0\n")
    (tmp_path / "ids.txt").write_text("100\n101\n102\n")
    got = {(r["parent"][-3:], r["child"][-3:]) for r in readers.weibo_relations(spark, str(tmp_path / "rel.txt"), str(tmp_path / "ids.txt")).collect()}
    assert got == {("101", "100"), ("102", "100"), ("100", "102")}
    text = "p1 u0 2012-01-01-10:00:00 2\n2\nua 2012-01-01-11:00:00 x\ncontent\nub 2012-01-01-12:00:00 y\ncontent\nretweet uc ud\n"
    (tmp_path / "rt.txt").write_bytes(text.encode("gb18030"))
    edges = [(r["ref_user_id"], r["user_id"], r["datetime"]) for r in readers.weibo_retweets(spark, str(tmp_path / "rt.txt"), "UTC").collect()]
    assert {e[:2] for e in edges} == {("u0", "ua"), ("u0", "uc"), ("uc", "ud"), ("ud", "ub")}
    at = {e[1]: e[2] for e in edges}
    assert at["uc"] < at["ud"] < at["ub"] == datetime(2012, 1, 1, 12)


def test_memetracker(spark, tmp_path):
    (tmp_path / "m.txt").write_text("P\thttp://a.com/1\nT\t2009-01-01 00:00:01\nQ\tyes we can\n\nP\thttp://b.com/2\nT\t2009-01-01 00:00:05\nQ\tyes we can\nL\thttp://a.com/1\nL\thttp://gone.com/\n")
    t = readers.memetracker(spark, str(tmp_path / "m.txt"))
    assert t["posts"].count() == 2 and t["cascades"].count() == 1 and t["postcascades"].count() == 2
    assert [(r["user_id"], r["ref_user_id"]) for r in t["reshares"].collect()] == [("b.com", "a.com")]
    assert {tuple(r) for r in t["links"].collect()} == {("http://b.com/2", "http://a.com/1"), ("http://b.com/2", "http://gone.com/")}
    with pytest.raises(Exception, match="no post http://gone"):
        readers.checked_links(t["links"], t["posts"]).collect()


def test_tweets(spark, tmp_path):
    one = ["ann", "5", "Mon Oct 12 10:00:00 +0000 2009", "x", "-1", "-1", "hello", "1", "http://l", ""]
    two = ["bob", "6", "Mon Oct 12 10:05:00 +0000 2009", "x", "-1", "ann 5", "hi", "0", ""]
    (tmp_path / "t.txt").write_bytes("\n".join(one + two).encode("iso-8859-1"))
    got = {(r["username"], r["tweet_id"], r["date"], r["reply_to_id"]) for r in readers.tweets(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {("ann", "5", datetime(2009, 10, 12, 10), None), ("bob", "6", datetime(2009, 10, 12, 10, 5), "5")}


def test_mail(spark, tmp_path):
    def mail(user, folder, name, sender, to, date, subject):
        path = tmp_path / user / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(f"From: {sender}\nTo: {to}\nDate: {date}\nSubject: {subject}\n\nbody\n")

    mail("ann", "all_documents", "1", "ann@x", "bob@x,\n\tcy@x", "Mon, 14 May 2001 16:39:00 -0700 (PDT)", "budget plan draft")
    mail("ann", "inbox", "1", "no@x", "ann@x", "Mon, 14 May 2001 16:39:00 -0700 (PDT)", "ignored")
    mail("bob", "inbox", "1", "bob@x", "ann@x", "Tue, 15 May 2001 09:00:00 -0700 (PDT)", "Re: budget plan draft")
    mail("bob", "inbox", "2", "bob@x", "dd@x", "Tue, 15 May 2001 10:00:00 -0700 (PDT)", "lunch")
    m = readers.mails(spark, str(tmp_path))
    assert m.count() == 3 and m.where("user = 'ann'").first()["date"] == datetime(2001, 5, 14, 23, 39)
    threaded = readers.threads(m)
    assert threaded.count() == 2
    got = {(r["user_id"], r["ref_user_id"], r["datetime"]) for r in readers.thread_reshares(threaded).collect()}
    assert got == {("bob@x", "ann@x", datetime(2001, 5, 15, 16)), ("cy@x", "ann@x", datetime(2001, 5, 15, 23, 39)), ("ann@x", "bob@x", datetime(2001, 5, 14, 23, 39))}


def test_covid(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"user_id": "1", "timestamp": "2020-02-01T10:00"}, {"user_id": "2", "timestamp": "2020-02-01T11:00", "repost": {"username": "one", "timestamp": "2020-02-01T10:00"}}]')
    posts = readers.covid_posts(spark, str(tmp_path / "c.json"))
    users = readers.with_users(posts.selectExpr("ref_username username"), spark.createDataFrame([("1", "one")], "user_id string, username string"))
    assert users.count() == 1
    assert [(r["user_id"], r["ref_user_id"]) for r in readers.covid_reshares(posts, users).collect()] == [("2", "1")]


def test_store(spark, tmp_path):
    p = store.Project(spark, f"file://{tmp_path}", "p")
    ids = spark.createDataFrame([("b",), ("a",)], "cascade_id string")
    key = store.set_key(ids)
    assert key == store.set_key(ids.orderBy("cascade_id")) != store.set_key(ids.limit(1))
    made = []
    make = lambda: made.append(1) or ids
    assert p.load_or("samples", make, key).count() == 2 and p.load_or("samples", make, key).count() == 2 and made == [1]
    rows = [("c", 1, None, datetime(2024, 1, 1), 0), ("c", 2, 1, datetime(2024, 1, 2), 1), ("c", 3, 2, datetime(2024, 1, 3), 2), ("c", 4, None, datetime(2024, 1, 4), 0)]
    nodes = spark.createDataFrame(rows, "cascade_id string, user_id long, parent_id long, act_time timestamp, depth int")
    back = store.trees_from_json(store.trees_to_json(nodes))
    assert {(r["user_id"], r["parent_id"], r["depth"]) for r in back.collect()} == {("1", None, 0), ("2", "1", 1), ("3", "2", 2), ("4", None, 0)}
    assert trees.to_reshares(nodes).count() == 2
    (tmp_path / "big-emic-auc.json").write_text('{"fpr": [0.0, 1.0], "tpr": [0.5, 1.0]}')
    assert {tuple(r) for r in store.roc_results(spark, f"file://{tmp_path}/*.json", "big", "auc").collect()} == {("emic", 0.0, 0.5), ("emic", 1.0, 1.0)}
    store.save_report(ids, f"file://{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/report").count() == 2


def test_entry():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) > 60

"""Readers whose files come in many splits, mail threads against a sequential loop, and density clusters against the whole matrix."""

import random

import pytest

from tidegraph.operators import clusters
from tidegraph.sources import readers


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lines_are_numbered_over_splits(spark, tmp_path, tiny_splits):
    lines = [f"line {i} " + "x" * (i % 70) for i in range(400)] + ["", "", "end"]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\r\ntwo\r\n")
    got = readers.numbered_lines(spark, str(tmp_path))
    assert got.select("file", "block").distinct().count() > 20
    found = sorted((r["file"][-5:], r["ln"], r["line"]) for r in got.collect())
    assert found == [("a.txt", i + 1, x) for i, x in enumerate(lines)] + [("b.txt", 1, "one"), ("b.txt", 2, "two")]


def test_records_over_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(4)
    head, name = ["x"] * 15, "王李abc"
    users = {i: "".join(rng.choices(name, k=4)) for i in range(60)}
    (tmp_path / "users.txt").write_bytes("\n".join(head + [x for i, n in users.items() for x in [str(i), *["-"] * 7, n, *["-"] * 6]]).encode("gb18030"))
    assert rows(readers.weibo_users(spark, str(tmp_path / "users.txt"))) == sorted((str(i).zfill(24), n) for i, n in users.items())
    (tmp_path / "roots.txt").write_text("".join(f"{i}\n{i} {i + 1}\n" + rng.choice(["", "@a b\n", "link x\n\n"]) for i in range(90)))
    assert {(int(r["post_id"]), tuple(r["tokens"])) for r in readers.weibo_roots(spark, str(tmp_path / "roots.txt")).collect()} == {(i, (i, i + 1)) for i in range(90)}
    text, want = "", []
    for c in range(25):
        n = rng.randint(0, 6)
        text += f"p{c} u{c} 2012-01-01-10:00:00 {n}\n{n}\n"
        for k in range(n):
            between = [f"m{c}x{k}x{j}" for j in range(rng.randint(0, 2))]
            content = rng.choice(["hello", "", "a 2012-01-01-10:00:00 trap", "p u 2012-01-01-10:00:00 5", "retweet me", "@x"])
            text += f"w{c}x{k} 2012-01-01-11:00:0{k} z\n{content}\n" + rng.choice(["", "@ab cd\n"]) + (f"retweet {' '.join(between)}\n" if between else "") + rng.choice(["", "link http://x\n"])
            path = [f"u{c}", *between, f"w{c}x{k}"]
            want += [(f"p{c}", b, a) for a, b in zip(path, path[1:])]
    (tmp_path / "rt.txt").write_bytes(text.encode("gb18030"))
    got = readers.weibo_retweets(spark, str(tmp_path / "rt.txt"), "UTC")
    assert rows(got.select("cascade_id", "user_id", "ref_user_id")) == sorted(want)
    assert got.where("datetime is null or ref_datetime is null or datetime < ref_datetime").isEmpty()
    text, want = "", []
    for i in range(40):
        reply, links = rng.choice([None, str(i - 1)]), rng.randint(0, 3)
        body = rng.choice(["hi", "", "12", "Mon Oct 12 10:00:00 +0000 2009", "7 8"])
        text += "\n".join([f"ann{i}", str(i), f"Mon Oct 12 10:00:{i % 60:02} +0000 2009", "x", "-1", f"bob {reply}" if reply else "-1", body, str(links), *["http://l"] * links, "", ""])
        want.append((f"ann{i}", str(i), reply))
    (tmp_path / "t.txt").write_bytes(text.encode("iso-8859-1"))
    assert rows(readers.tweets(spark, str(tmp_path / "t.txt")).select("username", "tweet_id", "reply_to_id")) == sorted(want, key=str)
    memes, quotes = "", set()
    for i in range(60):
        said = [f"phrase {rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))]
        memes += f"P\thttp://s{i}.com/{i}\nT\t2009-01-01 00:00:{i % 60:02}\n" + "".join(f"Q\t{q}\n" for q in said) + "\n"
        quotes |= {(f"http://s{i}.com/{i}", q) for q in said}
    (tmp_path / "m.txt").write_text(memes)
    t = readers.memetracker(spark, str(tmp_path / "m.txt"))
    assert t["posts"].count() == 60
    assert {tuple(r) for r in t["postcascades"].join(t["cascades"], "cascade_id").select("post_id", "text").collect()} == quotes


def plain_threads(mails, least=0.5):
    split = lambda s: set(s.lower().split())
    threads = []
    for m, _, sender, to, subject in sorted(mails, key=lambda r: r[1]):
        if not subject or not to:
            continue
        words, who = split(subject), {sender, *to}
        for t in threads:
            if words and all(split(s) and len(split(s) & words) / len(split(s) | words) > least for s in t["subjects"]) and who & t["users"]:
                break
        else:
            t = {"id": m, "users": set(), "subjects": set(), "mails": []}
            threads.append(t)
        t["users"] |= who
        t["subjects"].add(subject)
        t["mails"].append(m)
    return sorted((m, t["id"]) for t in threads if len(t["mails"]) > 1 and not any(s.lower().split() in (["re"], ["fw"], ["fwd"]) for s in t["subjects"]) for m in t["mails"])


def made_mails(n=260):
    rng = random.Random(8)
    words = ["plan", "budget", "lunch", "draft", "re", "report", "new"]
    return [(i, rng.randint(0, 10**6), f"u{rng.randint(0, 11)}", [f"u{rng.randint(0, 11)}" for _ in range(rng.randint(0, 3))], " ".join(rng.sample(words, rng.choice([0, 1, 2, 3, 3, 4])))) for i in range(n)]


def test_threads_are_those_of_a_sequential_loop(spark):
    mails = made_mails()
    want = plain_threads(mails)
    assert len({t for _, t in want}) > 10 and len(want) > 60
    df = spark.createDataFrame(mails, "mail_id long, place long, sender string, to array<string>, subject string")
    assert sorted(map(tuple, readers.threads(df).select("mail_id", "thread").collect())) == want
    assert readers.threads(df.where("false")).isEmpty()


def test_similar_sets(spark):
    rng = random.Random(2)
    sets = {i: sorted(rng.sample("abcdefgh", rng.randint(1, 6))) for i in range(60)}
    sets = {i: list(w) for w, i in {tuple(w): i for i, w in sets.items()}.items()}
    got = {tuple(r) for r in readers.similar_sets(spark.createDataFrame(list(sets.items()), "id long, w array<string>")).collect()}
    assert got == {(a, b) for a, x in sets.items() for b, y in sets.items() if a != b and len(set(x) & set(y)) / len(set(x) | set(y)) > 0.5}


def plain_dbscan(sim, ids, eps, points):
    near = {a: {b for b in ids if a == b or sim.get((min(a, b), max(a, b)), 0) <= eps} for a in ids}
    core = [a for a in ids if len(near[a]) >= points]
    label, n = {}, 0
    for a in core:
        if a in label:
            continue
        todo = [a]
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = n
            if x in core:
                todo += near[x]
        n += 1
    return sorted((a, a in core, label.get(a, -1)) for a in ids)


@pytest.mark.parametrize("dense", [0.2, 0.8, 0.93, 0.97])
def test_dbscan_on_implicit_zeros(spark, dense):
    rng = random.Random(int(dense * 100))
    ids = [f"c{i:02}" for i in range(45)]
    sim = {(a, b): 0.5 for i, a in enumerate(ids) for b in ids[i + 1 :] if rng.random() < dense}
    sim |= {k: 0.01 for k in rng.sample(sorted(sim), 20)}
    pairs = spark.createDataFrame([(*k, s) for k, s in sim.items()], "i string, j string, sim double")
    got = rows(clusters.dbscan(pairs, spark.createDataFrame([(i,) for i in ids], "cascade_id string"), 0.1, 4))
    assert got == plain_dbscan(sim, ids, 0.1, 4)
    if dense > 0.9:
        assert len({x for *_, x in got}) > 2

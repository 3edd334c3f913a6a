import random

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import brute
from tidegraph.llm import quality
from tidegraph.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small table with junk, near copies, a shared passage and benchmark items, written as the driver's tables are."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(w + ("." if i % 9 == 8 or i == n - 1 else "") for i, w in enumerate(rng.choices(words, k=n)))

    items = [(i, prose(30)) for i in range(4)]
    passage = prose(60)
    texts = [prose(rng.randint(30, 120)) for _ in range(25)]
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(4)]
    base = prose(120).split(" ")
    for _ in range(5):
        copy = list(base)
        copy[rng.randrange(120)] = "changed"
        texts.append(" ".join(copy) + ("" if copy[-1].endswith(".") else "."))
    texts += [prose(50) + " " + items[2][1] + " " + prose(50), " ".join(w + "###" for w in prose(60).split()), prose(20) + "\nHome | News | Sport | More\n" + prose(30), "too short.", None, ""]
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def stages(rows, items):
    """The plain version, stage by stage: (doc_id, text)."""
    out = []
    kept = []
    for d, t, *_ in rows:
        *_, keep, failed, _, cleaned = quality.judge(pa.array([t], pa.string()), 0.5)[0].as_py().values()
        if keep:
            kept.append((d, cleaned if failed else t))
    out.append(kept)
    kept = [r for r, (_, c) in zip(kept, brute.components(kept)) if c == r[0]]
    out.append(kept)
    now = []
    for (d, t), (w, g) in zip(kept, brute.windows(kept)):
        if sum(g) < len(w):
            now.append((d, b" ".join(x for x, y in zip(w, g) if not y).decode() if any(g) else t))
    out.append(now)
    sets = [brute.shingles(t) for _, t in items]
    out.append([(d, t) for d, t in now if not any(10 * len(q & brute.shingles(t)) >= 8 * len(q) for q in sets)])
    return out


def test_each_stage_is_the_plain_one(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    sizes = [len(rows)]
    for (_, f), want in zip(corpus_pipeline.STAGES[:-1], stages(rows, items), strict=True):
        docs = f(spark, docs, folder)
        assert docs.columns == columns
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(got) == sorted(want)
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        sizes.append(len(got))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) >= 4


def test_the_whole_pipeline(spark, corpus):
    folder, rows, items = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == {d for d, _ in stages(rows, items)[-1]}


def test_stages_of_nothing(spark, corpus):
    folder, *_ = corpus
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0


def test_rows_with_null_and_shared_ids_go_by_their_own_text(spark, corpus):
    folder, _, items = corpus
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    near = texts[0].rsplit(" ", 1)[0] + " changed"
    bad = texts[5] + " " + items[1][1]
    ids = [None, None, None, 7, 7]
    rows = [*zip(ids, texts), (9, near), (7, texts[3]), (None, bad), (7, bad + " more"), (None, None), (None, ""), (8, texts[4] + " x")]
    docs = spark.createDataFrame([(i, t, "en", f"src{k}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], SCHEMA)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")

    def of(f):
        return sorted(((r["doc_id"], r["text"]) for r in f(spark, docs, folder).collect()), key=key)

    gone = {5, 6, 8, 11}  # near copies of rows 0, 3, 7, 4
    assert of(corpus_pipeline.near_duplicates) == sorted((r for k, r in enumerate(rows) if k not in gone), key=key)
    assert of(corpus_pipeline.decontamination) == sorted((r for r in rows if bad not in (r[1] or "")), key=key)


def test_names():
    assert [q.split("_")[0] for q in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)

import os
import random
from collections import Counter

import pyarrow as pa
import pytest

from tidegraph.llm import language, queries


def grams(text):
    """The 5-byte pieces of a text in lower case between two spaces on each side, ASCII bytes that are no letters as spaces."""
    raw = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in ("  " + (text or "").lower() + "  ").encode())
    return [raw[i : i + 5] for i in range(len(raw) - 4)]


def test_scores_are_those_of_plain_sets(spark):
    """Languages that share an alphabet and many words: kept n-grams and scores against sets and counters, up to the filter's chance hits."""
    rng = random.Random(2)
    common = ["".join(rng.choices("aeinrst", k=rng.randint(2, 5))) for _ in range(60)]
    words = {x: common + ["".join(rng.choices("aeinrstlo", k=rng.randint(3, 7))) for _ in range(60)] for x in ("aa", "bb", "cc")}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(5, 60))), lang) for i, lang in enumerate(rng.choices(list(words), k=150))]
    f = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert f.languages == ["aa", "bb", "cc"]

    counts = {x: Counter(g for _, t, lang in rows if lang == x for g in grams(t)) for x in words}
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    best = Counter()
    for s in share.values():
        for g, v in s.items():
            best[g] = max(best[g], v)
    kept = {x: {g for g, n in c.items() if n >= 2 and 4 * share[x][g] >= best[g]} for x, c in counts.items()}
    own = [sum(share[x][g] for g in kept[x]) for x in f.languages]
    assert f.own == pytest.approx(own)

    texts = ["", "x", *[t for _, t, _ in rows[:40]], "wholly other words", "a\nb " * 50]
    got = f.scores(*language.folded(pa.array(texts)))
    for text, line in zip(texts, got):
        mine = grams(text)
        for i, x in enumerate(f.languages):
            chance = f.fill[i] ** language.HASHES
            want = max(0.0, (sum(g in kept[x] for g in mine) / max(len(mine), 1) - chance) / (1 - chance)) / own[i]
            assert line[i] == pytest.approx(want, abs=3 / max(len(mine), 1) / own[i] * (chance * len(mine) + 1) / 3)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_held_out_documents_are_told_by_language(spark):
    found = queries.op4_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null").select("doc_id", "lang")
    rows = found.join(lang, "doc_id").collect()
    for x in {r["lang"] for r in rows}:
        mine = [r for r in rows if r["lang"] == x]
        right = sum(r["lang_pred"] == x for r in mine)
        print(x, right, len(mine))
        assert right >= 0.9 * len(mine)

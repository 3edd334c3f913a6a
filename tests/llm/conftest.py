import random

import pytest


def make_documents(seed: int = 7) -> list[tuple]:
    """(doc_id, text, n_words, __d): random prose with copies, near copies, shared passages, odd rows, and columns whose names clash with the operators' own."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(2, 8))) for _ in range(300)]

    def prose(n: int) -> str:
        words = rng.choices(vocabulary, k=n)
        return "".join(w + rng.choice([" ", " ", " ", "  ", ".\n", "\t"]) for w in words).strip()

    passage = prose(70)
    texts: list[str | None] = [prose(rng.randint(1, 160)) for _ in range(40)]
    texts += [prose(30) + " " + passage + " " + prose(rng.randint(0, 60)) for _ in range(6)]
    base = prose(150)
    texts += [base, base, base.upper()]
    for _ in range(6):
        words = base.split(" ")
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", " \n\t ", "word", "two words", "two words", ("tick tock " * 120).strip(), "x" * 3000, "<|endoftext|> and ½ 中文 ０１ 's|", prose(4000)]
    rows = [(i, t, -1, "extra") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[41], -1, "extra"), (None, None, -1, "extra")]


SCHEMA = "doc_id long, text string, n_words int, __d string"


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

"""Language identification with bit-sliced Bloom filters of n-grams.

A cell of the filter holds one bit for each language; the AND of an n-gram's cells names all languages that have it.
The bits of a text's n-grams are summed for each language, corrected for the share of n-grams that the filter would
answer by chance, and divided by the share that the language's own texts reach; the largest decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded_batches
from tidegraph.llm.textblocks import mix, rows, utf8

GRAM, HASHES = 5, 3
#: n-grams that numpy works on at once, whatever the length of a text.
BLOCK = 1 << 18
#: Bytes that are no letters count as a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]
LETTER = re.compile(r"[^\W\d_]")


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lower-cased, padded texts, other than letters as spaces, and where each text begins; one more at the end."""
    pad, none = pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())
    lower = pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))
    data, off = utf8(pc.binary_join_element_wise(pad, lower, pad, none))
    return FOLD[data], off


def blocks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """n-grams as numbers, BLOCK at a time, and for each text where its own begin and end among them. Blocks share GRAM - 1 bytes, so a text of any length has each n-gram once."""
    first, last = off[:-1], np.maximum(off[1:] - GRAM + 1, off[:-1])
    for a in range(0, max(0, len(data) - GRAM + 1), BLOCK):
        b = min(a + BLOCK, len(data) - GRAM + 1)
        code = np.zeros(b - a, np.uint64)
        for k in range(GRAM):
            code |= data[a + k : b + k].astype(np.uint64) << np.uint64(8 * k)
        yield code, np.clip(first, a, b) - a, np.clip(last, a, b) - a


def cells(code: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The cells of each n-gram, one array for each hash."""
    h = mix(code * np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


class Filter:
    """languages; planes: for each 8 of them, a table of cells; fill: share of cells with each language's bit; own: share of n-grams that its own texts find."""

    def __init__(self, languages: list[str], found: dict[int, tuple[np.ndarray, np.ndarray]], prior: str) -> None:
        self.languages, self.prior = languages, prior
        most = max((len(g) for g, _ in found.values()), default=1)
        self.size = 1 << max(16, math.ceil(math.log2(16 * most)))
        self.planes = np.zeros((-(-max(len(languages), 1) // 8), self.size), np.uint8)
        for i, (g, _) in found.items():
            for at in cells(g, self.size):
                self.planes[i // 8][at] |= np.uint8(1 << i % 8)
        self.fill = np.array([float((self.planes[i // 8] >> np.uint8(i % 8) & 1).mean()) for i in range(len(languages))])
        self.own = np.array([max(found[i][1].sum(), 1e-9) for i in range(len(languages))])

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each text and language, the corrected share of its n-grams that the language has."""
        hits = np.zeros((len(off) - 1, len(self.languages)), np.int64)
        for code, lo, hi in blocks(data, off):
            at = list(cells(code, self.size))
            for p, plane in enumerate(self.planes):
                mask = plane[at[0]]
                for more in at[1:]:
                    mask &= plane[more]
                for bit in range(min(8, len(self.languages) - 8 * p)):
                    total = np.concatenate(([0], np.cumsum(mask >> np.uint8(bit) & np.uint8(1), dtype=np.int64)))
                    hits[:, 8 * p + bit] += total[hi] - total[lo]
        n = np.maximum(np.diff(off) - GRAM + 1, 1)
        chance = self.fill**HASHES
        return np.clip((hits / n[:, None] - chance) / (1 - chance), 0, 1) / self.own


def learn(docs: DataFrame, most: int = 400) -> Filter:
    """A filter from rows with text and lang: ``most`` documents of each language at most, those with the smallest hashes of doc_id.

    An n-gram belongs to a language if that language has at least a quarter of the share in which any language has it, and it came twice there.
    """
    if most > 1000:
        raise ValueError("at most 1000 documents of a language")  # beyond, Spark does not limit before it shuffles
    # first within parts of each language, then over what these leave: no task sees a whole language
    ids = docs.where("text is not null and lang is not null").selectExpr("lang", "doc_id", "xxhash64(doc_id) h")
    for part in (F.pmod("h", F.lit(64)), F.lit(0)):
        w = Window.partitionBy("lang", "part").orderBy("h", "doc_id")
        ids = ids.withColumn("part", part).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("lang", "doc_id", "h")
    ids = ids.select("lang", "doc_id").distinct()
    sample = docs.where("text is not null").select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 2 << 20):
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for code, lo, hi in blocks(*folded(batch.column("text"))):
                for name in sorted(set(names[lo < hi])):
                    edge = np.zeros(len(code) + 1, np.int64)
                    own = (names == name) & (lo < hi)
                    edge[lo[own]] += 1  # texts do not overlap
                    np.subtract.at(edge, hi[own], 1)
                    g, c = np.unique(code[np.cumsum(edge[:-1]) > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    best = counted.withColumn("share", share).withColumn("best", F.max("share").over(Window.partitionBy("gram")))
    # bounded: the n-grams of ``most`` documents of each language
    kept = best.where("n >= 2 and 4 * share >= best").groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("share").alias("shares")).orderBy("lang").collect()
    languages = [r["lang"] for r in kept]
    prior = docs.where("text is not null and lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").first()
    return Filter(languages, {i: (np.array(r["grams"], np.int64).astype(np.uint64), np.array(r["shares"])) for i, r in enumerate(kept)}, prior["lang"] if languages else "und")


def identify(docs: DataFrame, labelled: DataFrame, most: int = 400) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs; languages are learned from labelled (doc_id, text, lang).

    A null text or one without letters is ``und`` with score 0; ties go to the first language by name, and a text in which no language
    has an n-gram to the most frequent one, with score 0. Without labelled rows all is ``und``. score is the winner's share of all languages' scores.
    Repeated rows and null ids stay; the whole text counts, BLOCK n-grams at a time, so what a long text takes is a few times its bytes. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    f = learn(labelled, most)
    shared = docs.sparkSession.sparkContext.broadcast(f)  # 64 KB and more, by the sample's n-grams; never by documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in rows(batches, 2 << 20):
            text = batch.column("text")
            letters = np.array([bool(t and LETTER.search(t)) for t in text.to_pylist()])
            if f.languages:
                score = f.scores(*folded(text))
                best, total = score.argmax(axis=1), score.sum(axis=1)
                value = np.where(total > 0, score.max(axis=1) / np.maximum(total, 1e-12), 0.0)
                name = [("und" if not a else f.languages[b] if t > 0 else f.prior) for a, b, t in zip(letters, best, total, strict=True)]
                value[~letters] = 0.0
            else:
                name, value = ["und"] * len(letters), np.zeros(len(letters))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(value, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")

"""Benchmark decontamination: MinHash containment search, partitioned by size, verified by exact shingle containment.

Texts are compared as benchmarks are quoted: in lower case, without punctuation and markup. Items are grouped by the size of their shingle
sets. Of an item with q shingles, ``need`` = ceil(c q) must be in a document; its sketch holds the k = q - need + j shingles with the smallest hashes
(a bottom-k MinHash). A document that holds a share c of the item's shingles lacks q - need of them at most, so it has j of the sketch:
the search loses nothing, and j grows with the item so that common phrases alone make no candidates. In each size partition the largest hash of any
sketch bounds what a document has to look up, and documents with too few shingles for a partition skip it. The containment of
candidates is counted on the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded_batches
from tidegraph.llm.textblocks import blocks, rows, shingle_set, shingles

SHINGLE, CONTAINMENT = 5, 0.8
#: Bytes of items that one pass over the documents searches for; more items take more passes.
ITEM_BYTES = 32 << 20
#: Everything but letters, marks and digits separates words.
APART = r"[^\pL\pM\pN]+"


def plain_words(text: pa.Array) -> pa.Array:
    """Texts in composed lower case, words with one space between them; null stays null."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.utf8_normalize(text.cast(pa.large_string()), "NFC")), APART, " ")


def _needed(q: int, containment: float) -> tuple[int, int, int]:
    """Of an item with q shingles: how many a document must hold, how many are in the sketch, and how many of these it must hold."""
    need = max(1, math.ceil(containment * q - 1e-9))
    least = max(1, math.ceil(need / 2))
    return need, min(q, q - need + least), least


def sketches(items: DataFrame, n: int, containment: float) -> DataFrame:
    """item, hash, q for each shingle in the sketch of each of items (item long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            names = batch.column("item").to_pylist()
            own: dict[int, list[np.ndarray]] = {}
            for w in blocks(plain_words(batch.column("text")), n - 1):
                h, row = shingles(w, n)
                for r in np.unique(row).tolist():
                    own.setdefault(r, []).append(h[row == r])
            for r, parts in own.items():
                h = np.unique(np.concatenate(parts))
                k = _needed(len(h), containment)[1]
                yield pa.RecordBatch.from_arrays([pa.array([names[r]] * k, pa.int64()), pa.array(h[:k].view(np.int64)), pa.array([len(h)] * k, pa.int64())], ["item", "hash", "q"])

    return items.mapInArrow(run, "item long, hash long, q long")


class Sketches:
    """Sketches of items as arrays: for each partition by size, sorted hashes and which item each belongs to. Items are numbered from 0; sizes: shingles of each."""

    def __init__(self, item: np.ndarray, hash_: np.ndarray, q: np.ndarray, count: int, containment: float) -> None:
        self.least = np.ones(count, np.int64)
        part = np.ceil(np.log2(q + 1)).astype(np.int64) if len(q) else q
        self.parts = []
        for size in np.unique(part).tolist():
            at = np.flatnonzero(part == size)
            at = at[np.argsort(hash_[at], kind="stable")]
            h, i, own = hash_[at], item[at], q[at]
            self.least[i] = [_needed(x, containment)[2] for x in own.tolist()]
            seen = np.zeros(1 << 16, bool)
            seen[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.parts.append((_needed(int(own.min()), containment)[0], h.max(), seen, h, i))

    def shared(self, h: np.ndarray, row: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """row, item and hash of each shingle that is in an item's sketch; n: shingles of each row."""
        for least, top, seen, hashes, item in self.parts:
            at = np.flatnonzero((h <= top) & seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = at[n[row[at]] >= least]
            a, b = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            width = b - a
            stop = np.cumsum(width)
            if not len(stop) or not stop[-1]:
                continue
            entry = np.arange(stop[-1]) + np.repeat(a - (stop - width), width)
            yield np.repeat(row[at], width), item[entry], hashes[entry]

    def candidates(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
        """(row, item) with enough different shingles of the item's sketch."""
        if not found:
            return []
        row, item, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h, item, row))
        row, item, h = row[order], item[order], h[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        fresh = new.copy()
        fresh[1:] |= h[1:] != h[:-1]
        head = np.flatnonzero(new)
        count = np.add.reduceat(fresh.astype(np.int64), head)
        enough = head[count >= self.least[item[head]]]
        return list(zip(row[enough].tolist(), item[enough].tolist(), strict=True))


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment: each pair of a row of docs and of items (item_id, text) whose
    containment reaches the threshold.

    Words are runs of letters, marks and digits in lower case; a text of fewer than n words is one shingle. Null or empty texts match nothing; equal rows
    each give their own pairs; null ids stay. Other columns are not read. All items are searched, in blocks of bounded size: a block's texts and
    sketches are broadcast, and a task reads the texts of its candidates only.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = items.where("text is not null").selectExpr("cast(item_id as bigint) item_id", "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / ITEM_BYTES))
    slim, out = docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), None
    for k in range(passes):
        block = source.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").toArrow()  # ITEM_BYTES, about
        block = block.append_column("item", pa.array(range(block.num_rows), pa.int64()))
        if not block.num_rows and out is not None:
            continue
        found = sketches(spark.createDataFrame(block.select(["item", "text"])), n, containment).toArrow() if block.num_rows else None
        item, hash_, q = ((found.column(c).to_numpy() for c in ("item", "hash", "q")) if found is not None else (np.zeros(0, np.int64),) * 3)
        made = Sketches(item, hash_.view(np.uint64), q, block.num_rows, containment)
        shared = spark.sparkContext.broadcast((made, block.column("item_id").to_pylist(), plain_words(block.column("text").combine_chunks()).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            made, names, texts = shared.value
            wanted: dict[int, set[bytes]] = {}
            for batch in rows(batches, 4 << 20):
                ids, text = batch.column("doc_id").to_pylist(), plain_words(batch.column("text"))
                met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for w in blocks(text, n - 1):
                    h, row = shingles(w, n)
                    sizes = np.bincount(row, minlength=len(ids))
                    if w.base[0] or not w.own.all():  # a piece does not know its document's size
                        sizes[:] = np.iinfo(np.int64).max
                    met += made.shared(h, row, sizes)
                result: list[tuple] = []
                last, own = -1, set()
                for row, i in made.candidates(met):
                    if row != last:
                        last, own = row, shingle_set(text[row].as_py().encode(), n)
                    if i not in wanted:
                        if len(wanted) > 10_000:
                            wanted.clear()
                        wanted[i] = shingle_set(texts[i].encode(), n)
                    hits = len(wanted[i] & own)
                    if hits >= containment * len(wanted[i]) - 1e-9:
                        result.append((ids[row], names[i], len(wanted[i]), hits, hits / len(wanted[i])))
                columns = list(zip(*result, strict=True)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        part = slim.mapInArrow(run, "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double")
        out = part if out is None else out.unionByName(part)
    return out

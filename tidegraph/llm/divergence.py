"""Source divergence audit: how the words of each source of a language differ from those of its other sources and of the language.

Terms are counted by (language, source). Terms of a language with the same counts in all its sources are alike for every comparison, so they are grouped
by their sparse vector of counts; each pair of sources is evaluated once per distinct vector, times the number of terms that share it. For the ranking of
terms the distinct vectors are ranked first, and only terms of vectors that can reach the limit are looked up.

All numbers are whole: p = 1 + floor(SCALE * (count + 1) / (N + V)) for a group, f = floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded_batches, stored
from tidegraph.llm.textblocks import LOWER, rows, utf8

SCALE = 1_000_000_000
#: Distinct vectors and sources that one task compares at once.
VECTORS, SOURCES = 20_000, 256
#: Bytes of text that are cut into terms at once; a longer text comes in pieces that end between terms.
PIECE = 2 << 20

TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = True
TERM[128:] = True


def term_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each term and the byte after it; terms end where texts end."""
    solid = np.append(TERM[data], False)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1]))
    first = np.flatnonzero(solid & (~before | edge))
    last = np.flatnonzero(before & (~solid | edge))
    return first, last


def _terms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """The terms from start to end, told apart by their bytes."""
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)))
    flat = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))
    return words.dictionary_encode()


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about PIECE bytes that end at a byte outside terms."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            hit = np.flatnonzero(~TERM[data[end : end + 65536]])
            if hit.size:
                end += int(hit[0])
                break
            end = min(end + 65536, len(data))
        yield data[at:end]
        at = end


def _counted(group: np.ndarray, terms: pa.DictionaryArray, doc: np.ndarray) -> pa.Table:
    """group, term, n (occurrences), docs for terms with their group and document."""
    ids = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wide = len(terms.dictionary)
    pair, n = np.unique(doc * wide + ids, return_counts=True)  # a document and a term
    of = np.zeros(int(doc.max(initial=-1)) + 1, np.int64)
    of[doc] = group
    code, inverse = np.unique(of[pair // wide] * wide + pair % wide, return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, inverse, n)
    return pa.table({"group": code // wide, "term": terms.dictionary.take(pa.array(code % wide)), "n": total, "docs": np.bincount(inverse, minlength=len(code))})


def _slice(batch: pa.RecordBatch, lang: int, source: int) -> pa.RecordBatch:
    """lang, source, term, n, docs of a slice of documents."""
    groups = pa.StructArray.from_arrays([batch.column(lang), batch.column(source)], ["lang", "source"])
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
    data, off = utf8(batch.column("text"))
    data = LOWER[data]
    parts = []
    long = np.diff(off) > 2 * PIECE
    for i in np.flatnonzero(long).tolist():
        each = [_counted(np.zeros(len(s), np.int64) + group[i], _terms(p, s, e), np.zeros(len(s), np.int64)) for p in _pieces(data[off[i] : off[i + 1]]) for s, e in [term_bounds(p, np.array([0, len(p)]))] if len(s)]
        if each:
            one = pa.concat_tables(each).group_by(["group", "term"]).aggregate([("n", "sum")])
            parts.append(pa.table({"group": one["group"], "term": one["term"], "n": one["n_sum"], "docs": np.ones(len(one), np.int64)}))
    start, end = term_bounds(data, off)
    doc = np.searchsorted(off, start, side="right") - 1
    if long.any():
        short = ~long[doc]
        start, end, doc = start[short], end[short], doc[short]
    if len(start):
        parts.append(_counted(group[doc], _terms(data, start, end), doc))
    if not parts:
        parts = [pa.table({"group": pa.array([], pa.int64()), "term": pa.array([], pa.large_string()), "n": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})]
    out = pa.concat_tables(parts).combine_chunks()
    langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
    code = out["group"].combine_chunks()
    columns = [langs.take(code), sources.take(code), out["term"].combine_chunks().cast(pa.string()), out["n"].combine_chunks(), out["docs"].combine_chunks()]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), of whole texts; null text, lang and source are ''."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, PIECE):
            yield _slice(batch, 0, 1)

    some = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = some.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """p = 1 + floor(SCALE * (count + 1) / (n + v)) as a whole number; through decimals where 64 bits are too few."""
    small = (F.lit(SCALE) * (count + 1)).cast("long")
    wide = F.expr(f"{SCALE}BD").cast("decimal(20,0)") * (count + 1).cast("decimal(18,0)")
    div = lambda a, b: F.call_function("div", a, b)
    return F.lit(1).cast("long") + F.when(count < 9_000_000_000, div(small, (n + v).cast("long"))).otherwise(div(wide, (n + v).cast("decimal(18,0)")))


def excess(p: Column, q: Column) -> Column:
    """f = floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(count: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The same as share for arrays."""
    if int(count.max(initial=0)) < 9_000_000_000:
        return 1 + SCALE * (count + 1) // (n + v)
    return (1 + SCALE * (count.astype(object) + 1) // (n + v)).astype(np.int64)


def _compared(key: tuple, vectors: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """lang, s, t, value: f of each source of the block against each other source, over the block's vectors."""
    lang, _, block = key
    names = ["lang", "s", "t", "value"]
    if not len(vectors) or not len(groups):
        return pd.DataFrame([], columns=names)
    groups = groups.sort_values("at")
    n, v = groups["total"].to_numpy(np.int64), groups["v"].to_numpy(np.int64)
    many = len(groups)
    size = vectors["at"].map(len).to_numpy()
    at, count = np.concatenate(vectors["at"].to_numpy()), np.concatenate(vectors["count"].to_numpy())
    row, weight = np.repeat(np.arange(len(vectors)), size), vectors["terms"].to_numpy(np.int64)
    mine = np.arange(block * SOURCES, min((block + 1) * SOURCES, many))
    value = np.zeros((len(mine), many), np.int64)
    step = max(1, (1 << 20) // many)  # rows of counts that stand dense at once
    for a in range(0, len(vectors), step):
        z = min(a + step, len(vectors))
        dense = np.zeros((z - a, many), np.int64)
        lo, hi = np.searchsorted(row, [a, z])
        dense[row[lo:hi] - a, at[lo:hi]] = count[lo:hi]
        p = shares(dense, n, v)
        for i, s in enumerate(mine):
            d = p[:, s : s + 1] - p
            value[i] += weight[a:z] @ (d * d // p)
    s, t = np.repeat(mine, many), np.tile(np.arange(many), len(mine))
    return pd.DataFrame({"lang": lang, "s": s, "t": t, "value": value.ravel()})[s != t]


def audit(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source; null: '').

    Part ``pair``: for each (lang, source), each other source of the lang, with f summed over all kept terms of the lang, those in at least ``least_docs`` of
    its documents. Part ``term``: the kept terms that are more frequent in the group than in the lang, at most the first ``most``. Ranks begin at 1, by value descending and
    item ascending in the order of UTF-8. A group without terms has pairs all the same; a lang without kept terms has values of 0; an empty table gives no rows. Repeated
    rows are documents of their own; ids are not read. A vector has an entry for each source of its language at most. Very long texts are counted in pieces.
    """
    # the place of each source among those of its lang
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    places = stored(every.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "places")
    counted = term_counts(docs).join(places, ["lang", "source"])
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("vector"))
    terms = stored(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "vector"), "kept")
    vectors = stored(terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("terms")), "vectors")
    # N and V of each group
    entry = F.explode("vector").alias("x")
    size = vectors.select("lang", "terms", entry).groupBy("lang", "x.at").agg(F.sum(F.col("x.n") * F.col("terms")).alias("total"))
    kept = vectors.groupBy("lang").agg(F.sum("terms").alias("v"))
    groups = stored(places.join(size, ["lang", "at"], "left").join(kept, "lang", "left").fillna(0, ["total", "v"]), "groups")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    # pairs: blocks of distinct vectors against blocks of sources
    blocks = max(1, -(-vectors.count() // VECTORS))
    wide = max(1, -(-(groups.agg((F.max("at") + 1).alias("n")).first()["n"] or 0) // SOURCES))
    mine = lambda: F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("sources")
    left = vectors.select("lang", F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("block"), mine(), F.col("vector.at").alias("at"), F.col("vector.n").alias("count"), "terms")
    right = groups.select("lang", "at", "total", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select("*", mine())
    key = ["lang", "block", "sources"]
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_compared, "lang string, s int, t int, value long").groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    a, b = groups.select("lang", "source", F.col("at").alias("s")), groups.select("lang", F.col("source").alias("item"), F.col("at").alias("t"))
    pairs = a.join(b, "lang").where("s <> t").join(sums, ["lang", "s", "t"], "left")
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")))

    # terms: what a vector is worth in each of its sources, the vectors that can be among the first, and their terms
    all_ = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    worth = vectors.select("lang", "vector", "terms", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("count"), entry)
    worth = worth.select("lang", "vector", "terms", "count", F.col("x.at").alias("at"), F.col("x.n").alias("n")).join(groups, ["lang", "at"]).join(all_, "lang")
    worth = worth.withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", share(F.col("count"), F.col("all"), F.col("v"))).where("p > q")
    worth = worth.select("lang", "source", "vector", "terms", excess(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    near = worth.withColumn("r", F.rank().over(by_value)).where(F.col("r") <= most)
    above = F.sum("terms").over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("terms").over(Window.partitionBy("lang", "source", "value"))
    best = near.withColumn("above", above).where(F.col("above") < most).groupBy("lang", "vector").agg(F.collect_list(F.struct("source", "value")).alias("worth"))
    named = terms.join(best, ["lang", "vector"]).select("lang", F.col("term").alias("item"), F.explode("worth").alias("x"))
    tops = ranked(named.select("lang", "x.source", F.lit("term").alias("part"), "item", "x.value")).where(F.col("rank") <= most)
    return pairs.unionByName(tops)

"""Sharding by a Feistel permutation of global row numbers, in DataFrame operations only.

Row numbers are ranks by (doc_id, size, checksum, hash of the text): no result depends on how the
table is split into files. A Feistel network over the square a*a >= N permutes the numbers; a number that leaves
[0, N) walks on along its cycle until it comes back. Shard and slot follow by division, so where a
row goes can be computed from its number alone, and counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidegraph.llm.common import stored

#: A prime below 2**31: products of two residues fit into 64 bits.
PRIME = 2147483647
ROUNDS = 6
#: Walks are this long at most where the square has few numbers beyond N; a longer one is an error, never a wrong place.
WALK = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds, from a linear congruential generator."""
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def side(n: int) -> int:
    """The side of the smallest square that holds n numbers."""
    a = math.isqrt(max(n, 1))
    return a if a * a >= n else a + 1


def walk_bound(n: int) -> int:
    """Steps after which every walk has ended: no cycle has more numbers outside [0, n) than there are."""
    return min(WALK, side(n) ** 2 - n + 1)


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` of ``n``: a bijection of [0, n)."""
    a = side(n)

    def once(x: Column) -> Column:
        def turn(s: Column, key: Column) -> Column:
            t = (s["r"] + key) % PRIME
            t = (t * t) % PRIME
            t = (t * 48271 + key) % PRIME
            return F.struct(s["r"].alias("l"), ((s["l"] + t) % a).alias("r"))

        start = F.struct(F.call_function("div", x, F.lit(a).cast("long")).alias("l"), (x % a).cast("long").alias("r"))
        keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
        return F.aggregate(keys, start, turn, lambda s: s["l"] * F.lit(a).cast("long") + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(walk_bound(n))), once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row) for each row of docs, and their count.

    The sort deals rows to tasks by ranges; only one count per task goes through the driver's plan,
    none of the rows. Equal rows are told apart by the place where they were read, so that a third of all rows
    being copies does not land in one task.
    """
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
        F.monotonically_increasing_id().alias("m"),
    )
    ranked = stored(
        slim.orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "h", "m")
        .select("doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("at"))
        .withColumns({"part": F.shiftright("at", 33), "local": F.col("at").bitwiseAND((1 << 33) - 1)})
        .drop("at"),
        "numbered",
    )
    counts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row per task of the sort, not per document
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = ranked.count()
    return ranked.join(F.broadcast(starts), "part").select("doc_id", "size", "text_crc32", (F.col("before") + F.col("local")).alias("row")), total


def shard(docs: DataFrame, shards: int = 8, seed: int = 2024) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, row, place, shard, slot, grown_shard.

    law is ``rows``: counts of shards differ by one at most. Nulls in text count as empty, a null doc_id sorts
    first, equal rows get numbers of their own, an empty table gives no row; other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, n = numbered(docs)
    place = permuted(F.col("row"), n, seed)
    checked = F.when(F.col("place") < n, F.col("place")).otherwise(F.raise_error(F.lit("walk too long; choose another seed")).cast("long"))
    out = rows.withColumn("place", place).withColumn("place", checked)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
        "place",
    )

"""Best-fit packing with lower bounds that certify each partition, and repacking where they leave a gap.

Pieces of documents are dealt to partitions of bounded size. Each partition is packed best-fit
decreasing and compared with the largest of several lower bounds from dual feasible functions: when the bins
equal the bound, no packing of the partition has fewer, but partitions that are each at their bound may together be over that of all pieces. While the
whole has such a gap, partitions give up their bins that are not full; in each round those of several partitions meet, are packed again, and the new packing is taken
when it has fewer bins. Rounds go on until the bins equal the bound of all pieces or all have met; ``certificate`` compares the two.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded_batches, stored
from tidegraph.llm.tokens import pieces

#: Pieces in a partition, at most about and at least; and partitions that meet in a round.
PARTITION, LEAST, MEET = 100_000, 2_000, 4


def best_fit_decreasing(lengths: list[int], size: int) -> list[int]:
    """The bin of each piece; bins are numbered from 0."""
    free: dict[int, list[int]] = defaultdict(list)  # bins by free space
    spaces: list[int] = []  # free spaces that some bin has, ascending; at most ``size`` of them
    out, made = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect_left(spaces, n)
        if at < len(spaces):
            space = spaces[at]
            bin_ = free[space].pop()
            if not free[space]:
                spaces.pop(at)
                del free[space]
        else:
            bin_, space = made, size
            made += 1
        out[i] = bin_
        if left := space - n:
            if not free[left]:
                insort(spaces, left)
            free[left].append(bin_)
    return out


def lower_bound(lengths: list[int], size: int) -> int:
    """No packing has fewer bins: the largest of these dual feasible functions' sums.

    The sum itself; for each threshold t up to half a bin, pieces over size - t count as whole bins, pieces under t as nothing, others as they are;
    and for k from 1 to 20 the function that rounds (k+1)x/size down to k-ths unless it is a whole number.
    """
    counts = [0] * (size + 1)
    for n in lengths:
        counts[n] += 1
    return _bound(counts, size)


def _bound(counts: list[int], size: int) -> int:
    """lower_bound of counts[n] pieces of each length n."""
    total = sum(n * c for n, c in enumerate(counts))
    best = -(-total // size)
    small, large, mass = 0, 0, total  # of pieces under t; of those over size - t
    for t in range(1, size // 2 + 1):
        if t > 1:
            small += counts[t - 1] * (t - 1)
            n = size - t + 1
            large += counts[n]
            mass -= counts[n] * n
        else:
            large, mass = counts[size], total - counts[size] * size
        middle = mass - small
        best = max(best, large + -(-middle // size))
    for k in range(1, 21):
        weight = sum(c * (n if (k + 1) * n % size == 0 else 0) * k for n, c in enumerate(counts) if c)
        weight += sum(c * ((k + 1) * n // size) * size for n, c in enumerate(counts) if c and (k + 1) * n % size)
        best = max(best, -(-weight // (k * size)))
    return best


def _packer(size: int, level: int, share: int):
    """Packs a group. share: pieces that it may give up. Columns in and out are those of the pieces with grp, seq, fixed and bound."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "piece", "m"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = df["length"].tolist()
        bins = best_fit_decreasing(lengths, size)
        bound = lower_bound(lengths, size)
        before = df["seq"].nunique() if level else math.inf
        if max(bins) + 1 < before:
            df["seq"] = [level << 58 | int(key[0]) << 30 | b for b in bins]
            made = max(bins) + 1
        else:
            made = before
        # the emptiest bins are given up, as many as keep a meeting as small as a partition
        by_bin = df.groupby("seq")["length"].agg(["sum", "size"]).sort_values("sum", kind="stable")
        freed = by_bin.index[(by_bin["sum"] < size) & (by_bin["size"].cumsum() <= share)]
        df["open"] = df["seq"].isin(freed)
        df["bound"] = bound
        df["made"] = made
        return df

    return run


COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, m long, grp long, seq long, open boolean, bound long, made long"


def pack(docs: DataFrame, size: int = 2048, vocabulary: str = "byte_bpe_50k.json", partition: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and partition_bound and partition_bins,
    the certificate of the partition that packed it last.

    partition: pieces in a partition, about; if not given, as many as make a partition for each of the session's shuffle partitions, LEAST to PARTITION. A null text is the end id alone, an empty table gives no
    row, repeated rows and null ids are pieces of their own, ties in length go by doc_id, piece and row. Very long texts are cut into pieces as they are encoded, slice by slice. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    cut = stored(pieces(docs, vocabulary, size).withColumn("m", F.monotonically_increasing_id()), "pieces")
    lengths = [0] * (size + 1)
    for r in cut.groupBy("length").count().collect():  # size rows at most
        lengths[r["length"]] = r["count"]
    many, least = sum(lengths), _bound(lengths, size) if any(lengths) else 0
    if partition is None:
        partition = min(PARTITION, max(LEAST, math.ceil(many / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    groups, share = max(1, math.ceil(many / partition)), partition // MEET
    start = cut.withColumns({"grp": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "m"), F.lit(groups)), "seq": F.lit(0).cast("long"), "open": F.lit(True), "bound": F.lit(0).cast("long"), "made": F.lit(0).cast("long")})
    now = stored(start.groupBy("grp").applyInPandas(_packer(size, 0, share), COLUMNS), "packed-0")
    done, level = [], 0
    used = lambda df: df.select("seq").distinct().count()
    closed = 0
    while groups > 1 and closed + used(now) > least:
        # what is open meets what other partitions have open; the rest keeps its place and is not written again
        groups, level = math.ceil(groups / MEET), level + 1
        done.append(now.where("not open"))
        closed += used(done[-1])
        again = now.where("open").withColumn("grp", F.call_function("div", F.col("grp"), F.lit(MEET).cast("long")))
        now = stored(again.groupBy("grp").applyInPandas(_packer(size, level, share), COLUMNS), f"packed-{level}")
    packed = functools.reduce(DataFrame.unionByName, done, now)

    w = Window.partitionBy("seq").orderBy("length", "doc_id", "piece", "m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return packed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.col("seq").alias("sequence_id"),
        (F.sum("length").over(w) - F.col("length")).alias("offset"),
        F.col("bound").alias("partition_bound"),
        F.col("made").alias("partition_bins"),
    )


def certificate(packed: DataFrame, size: int = 2048) -> tuple[int, int]:
    """Sequences of a packing, and a number below which no packing of all its pieces can go. Only counts of lengths reach the driver."""
    counts = [0] * (size + 1)
    for r in packed.groupBy("length").count().collect():  # size rows at most
        counts[r["length"]] = r["count"]
    return packed.where("offset = 0").count(), _bound(counts, size)

"""Super-k-mers: runs of consecutive windows that share a minimiser, packed and dealt to buckets.

Equal windows have equal minimisers, so they meet in one bucket; a run of windows travels as one string, a few times shorter
than its windows. A block sends each different string once: a string that comes again in the task is settled where it is read, so
that copies, however many, reach a bucket once from each task. Where it is read a string is known by 128 bits; in the bucket strings and windows are compared themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from tidegraph.llm.common import bounded_batches, free_name, quoted
from tidegraph.llm.textblocks import mix, powers, rows

#: Bytes of packed strings in a bucket, about; bytes that a task gathers before it sends; strings known to repeat that a task remembers.
BUCKET_BYTES, SEND_BYTES, REMEMBERED = 8 << 20, 24 << 20, 500_000
R1, R2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
LEAST = -(1 << 63)
SPANS = "doc_id long, th long, first long, last long"


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    width, out = 1, values
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(values) - n + 1], out[n - width :])


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each values[first:last]."""
    out = []
    for base in (R1, R2):
        p = powers(np.uint64(base), len(values) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * p[:-1])))
        back = powers(np.uint64(pow(base, -1, 1 << 64)), len(values) + 1)
        out.append(mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64)))
    return out[0], out[1]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... for size[0] numbers, then the same for the next."""
    at = np.concatenate(([0], np.cumsum(size)))
    return np.arange(at[-1]) + np.repeat(first - at[:-1], size)


@dataclass
class Runs:
    """Runs of a block: which bucket hash, key, row, place of the first window in the document, number of windows, mark (anchor) and bytes."""

    bucket: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    mark: np.ndarray
    pack: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  # of the runs chosen: all bytes, and how many each has


@dataclass
class Sender:
    """Gathers what a task sends to each bucket."""

    buckets: int
    reach: int  # words or bytes of a window
    ordered: bool  # whether the earliest occurrence is kept
    size: int = 0
    text: dict[int, list[bytes]] = field(default_factory=dict)
    meta: dict[int, list[np.ndarray]] = field(default_factory=dict)
    spans: list[np.ndarray] = field(default_factory=list)
    again: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def add(self, runs: Runs, doc_id: np.ndarray, th: np.ndarray) -> None:
        """doc_id, th: of each row of the batch."""
        if not len(runs.h1):
            return
        doc, hashed = doc_id[runs.row], th[runs.row]
        order = np.lexsort((runs.start, doc, runs.h2, runs.h1))
        h1, h2, doc_o, start_o = runs.h1[order], runs.h2[order], doc[order], runs.start[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(order)))
        send = new.copy()
        if self.ordered:  # equal places are the same place, in rows that are alike
            send |= (doc_o == doc_o[head][group]) & (start_o == start_o[head][group])
        settled = ~send if self.ordered else (count > 1)[group]
        weight = np.minimum(count, 2)
        if self.again:
            known = np.fromiter((k[0] for k in self.again), np.uint64, len(self.again))
            for g in np.flatnonzero(np.isin(h1[head], known)):
                if (had := self.again.get((int(h1[head[g]]), int(h2[head[g]])))) is not None:
                    mine = slice(head[g], head[g] + count[g])
                    if not self.ordered:
                        settled[mine], send[mine] = True, False
                    elif (int(doc_o[head[g]]), int(start_o[head[g]])) > had:
                        settled[mine], send[mine] = True, False
        for g in np.flatnonzero(count > 1):
            i = head[g]
            if send[i] and len(self.again) < REMEMBERED:
                self.again[int(h1[i]), int(h2[i])] = (int(doc_o[i]), int(start_o[i]))
        if (at := order[settled]).size:
            self.spans.append(np.stack([doc[at], hashed[at], runs.start[at], runs.start[at] + runs.windows[at] + self.reach - 1]))
        at, w = order[send], weight[group[send]]
        by = np.lexsort((runs.start[at], doc[at], runs.bucket[at]))  # neighbours are alike, and pack well
        at, w = at[by], w[by]
        if not at.size:
            return
        data, length = runs.pack(at)
        meta = np.stack([doc[at], hashed[at], runs.start[at], runs.windows[at], runs.mark[at], w, length])
        number = runs.bucket[at]
        edge = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
        stop = np.concatenate(([0], np.cumsum(length)))
        raw = data.tobytes()
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            k = int(number[a])
            self.text.setdefault(k, []).append(raw[stop[a] : stop[b]])
            self.meta.setdefault(k, []).append(meta[:, a:b])
        self.size += len(raw)

    def flush(self) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        out: list[tuple[int, bytes, bytes]] = []
        for k, parts in self.text.items():
            meta = np.concatenate(self.meta[k], axis=1)
            meta[0] = np.diff(meta[0], prepend=0)
            out.append((k, zip_(b"".join(parts)), zip_(np.ascontiguousarray(meta).tobytes())))
        if self.spans:
            all_ = np.concatenate(self.spans, axis=1)
            to = self.buckets + (mix(all_[0].view(np.uint64) ^ all_[1].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0, [True])))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                out.append((int(to[order[a]]), b"", zip_(np.ascontiguousarray(all_[:, order[a:b]]).tobytes())))
        self.size, self.text, self.meta, self.spans = 0, {}, {}, []
        for i in range(0, len(out), 64):
            k, text, meta = zip(*out[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["bucket", "packed", "meta"])


@dataclass
class Bucket:
    """The different strings of a bucket; first: for each occurrence its string."""

    text: np.ndarray
    at: np.ndarray  # where each string begins
    length: np.ndarray
    windows: np.ndarray
    mark: np.ndarray
    weight: np.ndarray
    string: np.ndarray  # of each occurrence
    doc_id: np.ndarray
    th: np.ndarray
    start: np.ndarray
    windows_of: np.ndarray


def unpack(group: pa.Table) -> Bucket:
    un = zstandard.ZstdDecompressor().decompress
    raw = b"".join(un(x) for x in group.column("packed").to_pylist())
    parts = []
    for x in group.column("meta").to_pylist():
        part = np.frombuffer(un(x), np.int64).reshape(7, -1).copy()
        part[0] = np.cumsum(part[0])
        parts.append(part)
    doc, th, start, windows, mark, weight, length = np.concatenate(parts, axis=1)
    stop = np.cumsum(length)
    begin = stop - length
    number: dict[bytes, int] = {}
    string = np.array([number.setdefault(raw[a:z], len(number)) for a, z in zip(begin.tolist(), stop.tolist(), strict=True)], np.int64)
    head = np.zeros(len(number), np.int64)
    head[string[::-1]] = np.arange(len(string))[::-1]
    total = np.bincount(string, weights=weight).astype(np.int64)
    return Bucket(np.frombuffer(raw, np.uint8), begin[head], length[head], windows[head], mark[head], total, string, doc, th, start, windows)


def flagged_spans(flags: np.ndarray, first: np.ndarray, width: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true flags, in stretches of width[i] flags from first[i]: stretch, first flag in it, and end of the last flag's window."""
    stretch = np.repeat(np.arange(len(first)), width)
    on = flags[ranges(first, width)]
    place = ranges(np.zeros(len(first), np.int64), width)
    prev = np.concatenate(([False], on[:-1])) & (place > 0)
    begin = np.flatnonzero(on & ~prev)
    nxt = np.concatenate((on[1:], [False])) & (np.concatenate((place[1:], [0])) > 0)
    end = np.flatnonzero(on & ~nxt)
    return stretch[begin], place[begin], place[end] + reach


def pack_texts(text: pa.Array) -> pa.Array:
    """Each text, compressed by itself; null stays null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if x is None else pack(x.encode()) for x in text.to_pylist()], pa.binary())


def _unzip(packed: pa.Array) -> pa.Array:
    un = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else un(x).decode() for x in packed.to_pylist()], pa.string())


def unzipped(packed: pa.Array) -> list[bytes]:
    """Texts as bytes; null: empty."""
    un = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else un(x) for x in packed.to_pylist()]


def with_repeats(
    docs: DataFrame, into: str, kind: str, cut: Callable[[pa.Array], Iterator[Runs]], settle: Callable[[Bucket], tuple[np.ndarray, ...]], apply: Callable[[pa.Array, pa.Array], pa.Array], reach: int, ordered: bool, growth: float
) -> DataFrame:
    """docs with one more column at the end, of type ``kind``: what apply(packed texts, spans) makes of the stretches that windows to be removed cover.

    The column is called ``into``, with underscores after it where docs has one of that name; all columns of docs stay as they are.
    cut: the runs of a column of texts, with the hash of the bucket in ``bucket``; settle: the spans (doc_id, th, first, last) of a bucket.
    growth: packed bytes for a byte of text, about; it only sets the number of buckets.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * growth / BUCKET_BYTES))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    # where ids repeat, a hash of the text tells the rows of one id apart
    unique = docs.groupBy(doc.alias("d")).count().where("count > 1").isEmpty()
    th = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, reach, ordered)
        for batch in rows(batches):
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)
            hashed = batch.column("th").to_numpy(zero_copy_only=False)
            for runs in cut(batch.column("text")):
                runs.bucket = (runs.bucket % np.uint64(buckets)).astype(np.int64)
                sender.add(runs, doc_id, hashed)
                if sender.size >= SEND_BYTES:
                    yield from sender.flush()
        yield from sender.flush()

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            un = zstandard.ZstdDecompressor().decompress
            found = np.concatenate([np.frombuffer(un(x), np.int64).reshape(4, -1) for x in group.column("meta").to_pylist()], axis=1)
        else:
            found = settle(unpack(group))
        return pa.table([pa.array(x) for x in found], ["doc_id", "th", "first", "last"])

    sent = docs.select(doc.alias("doc_id"), th.alias("th"), "text").mapInArrow(send, "bucket long, packed binary, meta binary")
    spans = sent.groupBy("bucket").applyInArrow(meet, SPANS)
    # overlapping spans of a document become one before any are gathered: what is gathered is shorter than its text
    by = Window.partitionBy("doc_id", "th").orderBy("first", "last")
    reached = F.coalesce(F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = spans.withColumn("new", (F.col("first") > reached).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("doc_id", "th", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = merged.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    # texts travel packed; the spans are as many as there are repeats, so this join is never a broadcast
    rest = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    keyed = docs.select(doc.alias("doc_id"), th.alias("th"), F.struct(*rest).alias("rest"), F.arrow_udf(pack_texts, "binary")("text").alias("packed"))
    joined = keyed.join(found.hint("merge"), ["doc_id", "th"], "left").select("rest", "packed", "spans")
    schema = StructType([joined.schema["rest"], StructField("text", StringType()), StructField("found", _parse_datatype_string(kind))])

    def settle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # unpacked texts are several times larger
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _unzip(part.column(1)), apply(part.column(1), part.column(2))], ["rest", "text", "found"])

    out = joined.mapInArrow(settle_rows, schema)
    columns = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, F.col("found").alias(free_name(docs.columns, into)))


def covered(spans: list | None, n: int) -> np.ndarray:
    """For each of n places, whether a span covers it."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans or ():
        edge[s["first"]] += 1
        edge[min(s["last"], n)] -= 1
    return np.cumsum(edge[:-1]) > 0

"""N-gram Jaccard join with PartEnum signatures, and the components of its links.

Two sets with a Jaccard similarity of at least g differ in few elements: |r ^ s| <= (1-g)/(1+g) (|r|+|s|). Sizes fall into bands such that similar sets are in
the same or neighbouring ones; for each band the bound is a number k. The domain of shingles is dealt into k // 2 + 1 + x parts, and each part into three smaller
ones. Sets that differ in at most k elements have x + 1 parts at least in which they differ in one element at most, and there agree on two of the three smaller
parts. Each part of a set gives the three subsets of two smaller parts that are not empty as signatures; k = 0 has the whole set. Similar sets share a signature unless
more than x parts of both are poor: have a subset that is empty. Sets with that many poor parts give signatures under another dealing too, and so on;
those that are poor under all of them meet by a signature of their own. So no link is lost.

Sets that share a signature are candidates, in stars: each with the smallest of its group. Candidates are verified on the shingles themselves. Where the members of a star
are not in one component afterwards, all its pairs between components are examined: parity sketches, which bound the difference from below,
leave those that may be similar, and these are verified too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import bounded_batches, stored
from tidegraph.llm.superkmers import pack_texts, unzipped
from tidegraph.llm.textblocks import blocks, mix, rows, shingle_set, shingles

SHINGLE = 5
#: Ids (8 bytes each) up to which a set of them is broadcast.
BROADCAST_IDS = 500_000
#: Similarity in hundredths; dealings of the domain; least bits of a parity sketch; records that a task gathers before it sends; bytes of a bucket, about.
SIMILAR, DEALINGS, SKETCH_BITS, SEND, BUCKET_BYTES = 80, 4, 256, 2_000_000, 8 << 20
#: Smaller parts of a part; a signature leaves one of them out.
SUB = 3
#: Members of a star, or of a block of a larger one, that one task compares; and the nearest of other components that are tried for each before all others.
STAR, NEAREST = 2048, 4


def sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows of a column at a time: the rows with shingles, where each one's begin, and the different hashes, ascending in each row."""

    def apart(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        return row[at], np.append(at, len(row)), value

    long: dict[int, list[np.ndarray]] = {}
    for w in blocks(column, n - 1, lower=True):
        value, row = shingles(w, n)
        if w.base[0] or not w.own.all():
            long.setdefault(int(w.row[0]), []).append(np.unique(value))
        elif len(value):
            yield apart(value, row)
    for r, values in long.items():
        value = np.unique(np.concatenate(values))
        if len(value):
            yield apart(value, np.full(len(value), r))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (a fingerprint of the set) and its parity sketch, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            many = batch.num_rows
            count, f1, f2 = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, np.int64)
            sketch: list[bytes | None] = [None] * many
            for row, at, value in sets(batch.column("text"), n):
                size = np.diff(at)
                count[row] = size
                for f, salt in ((f1, 0x51), (f2, 0x52)):
                    f[row] = mix(np.add.reduceat(mix(value ^ np.uint64(salt)), at[:-1]) + size.astype(np.uint64)).view(np.int64)
                # as many bits as the next power of two over the set's size, so that folding makes sketches of two sizes comparable
                width = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(size)).astype(np.int64))
                place = np.concatenate(([0], np.cumsum(width)))
                bit = (mix(value ^ np.uint64(0x53)) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(place[:-1], size)
                odd = np.packbits((np.bincount(bit, minlength=place[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
                for r, a, z in zip(row.tolist(), (place[:-1] // 8).tolist(), (place[1:] // 8).tolist(), strict=True):
                    sketch[r] = odd[a:z]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(f1), pa.array(f2), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


class Bands:
    """Bands of sizes and, for the pairs whose larger set is in a band: differences allowed, parts of a dealing, and poor parts that a set may have."""

    def __init__(self, similar: int, largest: int) -> None:
        low = 1
        self.low: list[int] = []
        self.allowed: list[int] = []
        self.spare: list[int] = []
        while low <= largest * 2 or len(self.low) < 2:
            high = low * 100 // similar
            self.low.append(low)
            k = 2 * high * (100 - similar) // (100 + similar)
            self.allowed.append(k)
            few = 0.06 * (k // 2 + 1)
            self.spare.append(int(few + 2.5 * math.sqrt(few)) if k else 0)
            low = high + 1

    def signatures(self, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of sets value[at[i]:at[i+1]], and the set of each."""
        size = np.diff(at)
        band = np.searchsorted(np.array(self.low), size, "right") - 1
        allowed, spare = np.array(self.allowed), np.array(self.spare)
        parts = np.where(allowed > 0, allowed // 2 + 1 + spare, 1)
        out_s, out_i = [], []
        for up in (0, 1):
            instance = band + up  # with sets of its own band, and of the next
            mine = np.arange(len(size))
            for deal in range(DEALINGS):
                n = size[mine]
                p = parts[instance[mine]]
                base = np.concatenate(([0], np.cumsum(p)))
                which = np.repeat(np.arange(len(mine)), n)
                v = value if len(mine) == len(size) else value[np.repeat(at[mine] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                salt = mix(np.array([deal + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
                m = mix(v ^ salt)
                # the upper half of the hash chooses the smaller part
                small = ((m >> np.uint64(32)) * (SUB * p[which]).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + SUB * base[which]
                total = np.zeros(SUB * base[-1], np.uint64)
                np.add.at(total, small, m)
                full = np.zeros(SUB * base[-1], bool)
                full[small] = True
                total, full = total.reshape(-1, SUB), full.reshape(-1, SUB)
                owner = np.repeat(np.arange(len(mine)), p)
                place = np.arange(base[-1]) - base[owner]
                tag = (instance[mine][owner] * DEALINGS + deal).astype(np.uint64) * np.uint64(1 << 32) + SUB * place.astype(np.uint64)
                one = allowed[instance[mine]][owner] == 0  # equal sets: the whole
                all_, filled = total.sum(axis=1, dtype=np.uint64), full.sum(axis=1)
                if one.any():
                    out_s.append(mix(all_[one] + mix(tag[one])))
                    out_i.append(mine[owner[one]])
                for j in range(SUB):
                    some = ~one & (filled > full[:, j])  # what is left is not empty
                    out_s.append(mix(all_[some] - total[some, j] + mix(tag[some] + np.uint64(j))))
                    out_i.append(mine[owner[some]])
                poor = np.add.reduceat(((filled < 2) & ~one).astype(np.int64), base[:-1])
                mine = mine[poor > spare[instance[mine]]]
                if not mine.size:
                    break
            else:
                out_s.append(mix(mix(instance[mine].astype(np.uint64) + np.uint64(1 << 60))))
                out_i.append(mine)
        return np.concatenate(out_s), np.concatenate(out_i)


def groups(docs: DataFrame, n: int, similar: int, largest: int, total: int) -> DataFrame:
    """members: documents that share a signature, ascending; each group once from a bucket. Equal sets of a batch send one of them."""
    spark = docs.sparkSession
    bands = Bands(similar, largest)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 0.9 * 16 / BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for k, parts in held.items():
                sig, doc = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
                # 40 bits tell the signatures of a bucket apart but for a few; what meets by chance is not verified
                out.append((k, np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(), zip_(np.diff(doc, prepend=0).tobytes())))
            for i in range(0, len(out), 256):
                k, a, b = zip(*out[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["bucket", "signatures", "documents"])

        for batch in rows(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, at, value in sets(batch.column("text"), n):
                print_ = np.stack([np.add.reduceat(mix(value ^ np.uint64(s)), at[:-1]) for s in (0x51, 0x52)], axis=1)
                order = np.argsort(ids[row], kind="stable")
                _, one = np.unique(print_[order], axis=0, return_index=True)
                if len(one) < len(row):
                    one = np.sort(order[one])
                    width = np.diff(at)[one]
                    value = np.concatenate([value[at[i] : at[i + 1]] for i in one.tolist()])
                    row, at = row[one], np.concatenate(([0], np.cumsum(width)))
                sig, which = bands.signatures(at, value)
                doc = ids[row][which]
                to = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((doc, to))
                sig, doc, to = sig[order], doc[order], to[order]
                edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    held.setdefault(int(to[a]), []).append((sig[a:b], doc[a:b]))
                size += len(sig)
                if size >= SEND:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        un = zstandard.ZstdDecompressor().decompress
        raw = np.frombuffer(b"".join(group.column("signatures").to_pylist()), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        sig = wide.view(np.uint64).ravel()
        doc = np.concatenate([np.cumsum(np.frombuffer(un(x), np.int64)) for x in group.column("documents").to_pylist()])
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        same = sig[1:] == sig[:-1]
        keep = np.concatenate(([True], ~same | (doc[1:] != doc[:-1])))
        sig, doc = sig[keep], doc[keep]
        head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(head, len(sig)))
        hashed = np.add.reduceat(mix(doc.view(np.uint64)), head)
        some = np.flatnonzero(count > 1)
        _, one = np.unique(hashed[some], return_index=True)
        some = some[one]
        width = count[some]
        at = np.concatenate(([0], np.cumsum(width)))
        index = np.arange(at[-1]) + np.repeat(head[some] - at[:-1], width)
        return pa.table([pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(doc[index])).cast(pa.list_(pa.int64()))], ["members"])

    sent = docs.mapInArrow(send, "bucket long, signatures binary, documents binary")
    return sent.groupBy("bucket").applyInArrow(meet, "members array<long>")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A parity sketch (of 64-bit words) with fewer words: halves laid over each other."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and packed text of the documents of ids (doc_id), stored. A few ids are broadcast, so that no text moves; many are joined by a shuffle."""
    ids = stored(ids, "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return stored(docs.join(ids, "doc_id", "left_semi").select("doc_id", F.arrow_udf(pack_texts, "binary")("text").alias("packed")), "texts")


def verified(pairs: DataFrame, texts: DataFrame, n: int, similar: int) -> DataFrame:
    """Those of the pairs (a, b) of documents whose sets are similar: counted on the shingles themselves."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            good = []
            for x, y in zip(unzipped(batch.column("text_a")), unzipped(batch.column("text_b")), strict=True):
                if x != last:
                    last, own = x, shingle_set(x.lower(), n)  # of bytes: A-Z only
                other = shingle_set(y.lower(), n)
                both = len(own & other)
                good.append(both > 0 and 100 * both >= similar * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.hint("merge").join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _near(similar: int):
    """Whether two sets may be similar, from their sizes and sketches; never False for similar ones."""

    def run(na: pa.Array, nb: pa.Array, sa: pa.Array, sb: pa.Array) -> pa.Array:
        out = []
        for m, n, x, y in zip(na.to_pylist(), nb.to_pylist(), sa.to_pylist(), sb.to_pylist(), strict=True):
            words = min(len(x), len(y)) // 8
            apart = int(np.bitwise_count(folded(np.frombuffer(x, np.uint64), words) ^ folded(np.frombuffer(y, np.uint64), words)).sum())
            out.append(100 * min(m, n) >= similar * max(m, n) and (100 + similar) * apart <= (100 - similar) * (m + n))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that it reaches, for each node of an edge (a, b).

    Rounds of large and small stars: each node hands its larger neighbours, then its smaller ones, to the smallest
    it knows, until nothing changes. A node's edges are never gathered; only minima are.
    """
    now = stored(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "edges")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v u", "m v").where("u <> v").distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.selectExpr("v u", "m v").union(small.selectExpr("u", "m v")).where("u <> v").distinct()
        small = stored(small, "small")
        # each node has one edge, to the least of its component, when no edge's end has an edge of its own and none has two
        unsettled = small.join(small.selectExpr("u v").distinct(), "v", "left_semi").limit(1).count() + small.groupBy("u").count().where("count > 1").limit(1).count()
        now = small
        if not unsettled:
            break
    return now.selectExpr("u node", "v component").union(now.selectExpr("v node", "v component").distinct())


def _pairs_between(similar: int, most: int | None = None):
    """Of a group (id, component, n, sketch, first): pairs of different components that sizes and sketches do not rule out; if some rows are not first, only
    pairs of one that is and one that is not. With ``most``, for each member only so many others, nearest by their sketches."""

    def run(group: pa.Table) -> pa.Table:
        ids, comp, size = (group.column(c).to_numpy() for c in ("id", "component", "n"))
        raw = [np.frombuffer(x, np.uint64) for x in group.column("sketch").to_pylist()]
        words = min(map(len, raw))
        sketch = np.stack([folded(x, words) for x in raw])
        first = group.column("first").to_numpy().astype(bool)
        others = np.flatnonzero(~first)
        a, b = [ids[:0]], [ids[:0]]
        for i in np.flatnonzero(first):
            j = others if len(others) else np.arange(len(ids)) if most else np.arange(i + 1, len(ids))
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(size[j], size[i]) >= similar * np.maximum(size[j], size[i]))]
            apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            near = (100 + similar) * apart <= (100 - similar) * (size[j] + size[i])
            j, apart = j[near], apart[near]
            if most and len(j) > most:
                j = j[np.lexsort((ids[j], apart / (size[j] + size[i])))[:most]]
            a.append(np.full(len(j), ids[i]))
            b.append(ids[j])
        return pa.table([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return run


def _blocks(members: DataFrame, similar: int) -> DataFrame:
    """task, id, component, n, sketch, first: members (center, id, component, n, sketch) of large stars, dealt into tasks of two blocks of about ``STAR`` each, or of one.

    A block holds members of one star and one band of sizes: of one component if that has more than STAR members there, else of all smaller ones. Similar
    sets are in the same or neighbouring bands; blocks of one large component do not meet.
    """
    width = max(math.log(100 / similar), 1e-6) * (1 + 1e-9)
    large = members.groupBy("center", "component").count().where(F.col("count") > STAR).select("center", "component", F.lit(True).alias("large"))
    placed = members.join(F.broadcast(large), ["center", "component"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
    placed = placed.withColumn("own", F.when(F.col("large"), F.col("component")).otherwise(0)).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width))
    key = ["center", "large", "own", "band"]
    parts = stored(placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts")), "parts")
    block = F.struct("large", "own", "band", "part").alias("block")
    placed = placed.join(F.broadcast(parts), key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("center", block, "id", "component", "n", "sketch")
    blocks = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("center", block)
    tasks = blocks.selectExpr("center", "block x").join(blocks.selectExpr("center", "block y").hint("merge"), "center")
    tasks = tasks.where("x <= y and abs(x.band - y.band) <= 1 and not (x.large and y.large and x.own = y.own)").withColumn("task", F.xxhash64("center", "x", "y"))
    columns = ["id", "component", "n", "sketch"]
    one = placed.join(tasks.selectExpr("center", "x block", "task").hint("merge"), ["center", "block"]).select("task", *columns, F.lit(True).alias("first"))
    two = placed.join(tasks.where("x <> y").selectExpr("center", "y block", "task").hint("merge"), ["center", "block"]).select("task", *columns, F.lit(False).alias("first"))
    return one.union(two)


def _apart(near: DataFrame, facts: DataFrame, reached: DataFrame, similar: int, most: int | None) -> DataFrame:
    """a, b: pairs (see _pairs_between) of members of one star (center, node) that are in different components."""
    placed = near.join(reached.hint("merge"), "node", "left").select("center", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("center").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi and k > 2").select("center", "k")
    mixed = stored(mixed, "mixed")

    def members(stars: DataFrame) -> DataFrame:
        return placed.join(stars.select("center"), "center", "left_semi").join(facts.hint("merge"), "node").select("center", F.col("node").alias("id"), "component", "n", "sketch")

    pairs = members(mixed.where(F.col("k") <= STAR).hint("merge")).withColumn("first", F.lit(True)).groupBy("center").applyInArrow(_pairs_between(similar, most), "a long, b long")
    large = mixed.where(F.col("k") > STAR)
    if not large.isEmpty():
        # so few stars are broadcast: no task gets the whole of one
        pairs = pairs.union(_blocks(stored(members(F.broadcast(large)), "large-stars"), similar).groupBy("task").applyInArrow(_pairs_between(similar, most), "a long, b long"))
    return pairs.selectExpr("least(a, b) a", "greatest(a, b) b").distinct()


def near_duplicates(docs: DataFrame, n: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words are lower-cased in A-Z; a text with fewer than n words has one shingle, one without words none, and no links. Documents link when
    100 |both| >= similar |either|. Only texts link: rows that share a doc_id, or have none, are documents of their own. A null doc_id is
    larger than all others, so component_id is null only where no row of the component has an id.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _linked(docs, n, similar)
    rows_ = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found = stored(_linked(rows_.selectExpr("row doc_id", "text"), n, similar).selectExpr("doc_id row", "n_shingles", "component_id component").join(rows_.select("row", "doc_id").hint("merge"), "row"), "numbered")
    least = found.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return found.join(least.hint("merge"), "component", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _linked(docs: DataFrame, n: int, similar: int) -> DataFrame:
    """near_duplicates of documents whose doc_id are not null and all different."""
    known = stored(describe(docs, n), "described")
    id_ = F.col("doc_id").alias("id")
    full = known.where("n_shingles > 0")
    # equal sets are one node, named by the smallest id
    nodes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    names = stored(full.select(id_, "f1", "f2").join(nodes.hint("merge"), ["f1", "f2"]).select("id", "node"), "names")
    sizes = full.agg(F.max("n_shingles"), F.sum("n_shingles")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    met = stored(groups(docs, n, similar, largest, total), "groups")
    facts = stored(full.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch").join(names.where("id = node").select("node").hint("merge"), "node", "left_semi"), "facts")

    star = met.select(F.col("members")[0].alias("x"), F.explode("members").alias("y")).where("x <> y").distinct()
    star = star.join(names.selectExpr("id x", "node center").hint("merge"), "x").join(names.selectExpr("id y", "node").hint("merge"), "y")
    star = stored(star.where("center <> node").select("center", "node").distinct(), "stars")
    a, b = (facts.selectExpr(f"node {x}", f"n n{x}", f"sketch s{x}").hint("merge") for x in "ab")
    asked = star.selectExpr("least(center, node) a", "greatest(center, node) b").distinct()
    asked = stored(asked.join(a, "a").join(b, "b").where(_near(similar)("na", "nb", "sa", "sb")).select("a", "b"), "candidates")
    texts = packed_texts(docs, asked.selectExpr("a doc_id").union(asked.select("b")).distinct())
    links = stored(verified(asked, texts, n, similar), "links")
    reached = stored(components(links), "components")

    # a group lies within the star of its smallest member: of stars in several components, the pairs between these that the sketches leave. First each member's
    # nearest, which joins most components; then all that are still apart
    tested, near = asked, star.union(star.selectExpr("center", "center").distinct())
    for most in (NEAREST, None):
        more = _apart(near, facts, reached, similar, most)
        more = stored(more.join(tested.hint("merge"), ["a", "b"], "left_anti"), "more-candidates")
        if more.isEmpty():
            continue
        texts = packed_texts(docs, more.selectExpr("a doc_id").union(more.select("b")).distinct())
        joined, tested = stored(verified(more, texts, n, similar), "more-links"), tested.union(more)
        if not joined.isEmpty():
            links = links.union(joined)
            reached = stored(components(links), "components")
    final = names.join(reached.hint("merge"), "node", "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "node").alias("component"))
    return known.join(final.hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

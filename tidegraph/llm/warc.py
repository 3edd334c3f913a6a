"""WARC archives of pages, and one capture index of them by an external merge.

Records are written by Spark's text writer, whose line separator is the end of a record, and read as whole files by Content-Length, so
any store that Spark reaches will do. Records with a payload that an earlier page has are revisits and carry none.

Each archive gives a run of captures, sorted by URL key and time. Ranges of the key space take their slice of every run and merge the
slices with a loser tree; the ranges one after the other are the globally ordered history of captures. A range is cut by key, time and
page, so that one URL with many captures spreads over ranges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import stored, scratch_path

END = "\r\n\r\n"
#: Bytes of payloads in an archive and captures in a range of the index, about.
ARCHIVE_BYTES, RANGE_ROWS = 16 << 20, 100_000
#: Captures without a time of their own are this many seconds after 2000-01-01.
EPOCH = 946684800


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The key by which captures sort: host from its top-level domain on, without www, then path and query in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else "")
    return f"{at}){parts.path.lower() or '/'}" + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


def _digests(pages: DataFrame, payload: bool) -> DataFrame:
    """page_id, url, seen, payload_bytes, payload_digest and, if asked for, the payload: null where the batch has an equal one with a smaller page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, ids = batch.column("html").to_pylist(), batch.column("page_id").to_pylist()
            raw = [(h or "").encode() for h in html]
            found = [digest(x) for x in raw]
            first: dict[str, float] = {}
            for d, i in zip(found, ids, strict=True):
                first[d] = min(first.get(d, math.inf), math.inf if i is None else i)
            columns = [batch.column("page_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(found, pa.string())]
            names = ["page_id", "payload_bytes", "payload_digest"]
            if payload:
                own = [h or "" if first[d] == (math.inf if i is None else i) else None for h, d, i in zip(html, found, ids, strict=True)]
                columns += [batch.column("url"), batch.column("seen"), pa.array(own, pa.string())]
                names += ["url", "seen", "payload"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = "page_id long, payload_bytes long, payload_digest string"
    return pages.mapInArrow(run, kind + ", url string, seen long, payload string" if payload else kind)


def _record(smallest: int) -> list:
    """The columns of a record's text, from page_id, url, seen, payload_bytes, payload_digest, first and payload."""
    page = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(x).cast("string"), F.lit("null")), F.lit(">"))
    revisit = (F.col("payload_bytes") >= smallest) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.coalesce("payload", F.lit(""))))
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), r"[\r\n\s]", "%20")
    time = F.date_format(F.timestamp_seconds("seen"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    refers = F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), page("first"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), page("page_id"), F.lit("\r\nWARC-Date: "), time, F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), refers,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )
    return [text.alias("value")]


def write_archives(pages: DataFrame, path: str, smallest: int = 0, compression: str = "gzip") -> None:
    """Writes a record for each row of pages (page_id, url, html and, if there is one, seen, seconds since 1970) under path.

    Of equal payloads of at least ``smallest`` bytes the smallest page_id's is a response, others are revisits of it; rows with that same page_id are responses all.
    An archive is one gzip stream, or plain with compression="none". A null html is an empty payload, a null page_id larger than all others, a null url an urn of the page.
    """
    seen = F.col("seen").cast("long") if "seen" in pages.columns else F.lit(EPOCH) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(1 << 29))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), seen.alias("seen"), F.col("html").cast("string").alias("html"))
    known = _digests(slim.select("page_id", "html"), False)
    first = known.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    key = F.coalesce("page_id", F.lit(-(1 << 63)))
    given = known.select(key.alias("__id"), "payload_digest").distinct().join(first, "payload_digest")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ARCHIVE_BYTES))
    # payloads are dealt once, by page: copies of one payload, however many, do not end up in one archive
    rows = _digests(slim, True).withColumn("__id", key).repartition(files, "__id", "payload_digest")
    made = rows.join(given.hint("merge"), ["__id", "payload_digest"])
    made.select(*_record(smallest)).write.option("lineSep", END).option("compression", compression).text(path)


NAME = re.compile(rb"^([\w-]+): *(.*?)\r?$", re.MULTILINE)


def plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset (in the plain archive), length, header and block of each record."""
    at = 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        header = {k.decode().lower(): v.decode() for k, v in NAME.findall(content, at, stop)}
        begin = stop + 4
        end = begin + int(header["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length")
        yield at, end - at, header, content[begin:end]
        at = end + 4


CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured string, archive string, position long, length long"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "null" else int(number)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under path; digests of payloads are computed again and compared. A file is in memory as a whole, up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CAPTURES.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string()}
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = []
                for at, length, header, block in parse(plain(content.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    found = header["warc-payload-digest"].removeprefix("sha1:")
                    kind = header["warc-type"]
                    size = int(re.search(rb"(?mi)^content-length: *(\d+)", head)[1])
                    if kind == "response" and (digest(payload) != found or len(payload) != size):
                        raise ValueError(f"{file}: the payload at byte {at} is not the one written")
                    refers = _page(header["warc-refers-to"]) if "warc-refers-to" in header else None
                    url = header["warc-target-uri"]
                    out.append((_page(header["warc-record-id"]), size, found, kind, refers, url, url_key(url), re.sub(r"\D", "", header["warc-date"]), file.rpartition("/")[2], at, length))
                out.sort(key=_order)
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, CAPTURES.split(", "), strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURES)


def _order(capture: tuple) -> tuple:
    """URL key, time, page (null first), archive and position."""
    return capture[6], capture[7], -1 if capture[0] is None else 0, capture[0] or 0, capture[8], capture[9]


def merge(runs: Iterable[list[tuple]], key=_order) -> Iterator[tuple]:
    """Sorted runs as one, with a tree of losers: each leaf is a run, each inner node keeps the run that lost there."""
    lists = [r for r in runs if r]
    k = len(lists)
    if not k:
        return
    place = [0] * k
    head: list[tuple | None] = [(key(r[0]), i) for i, r in enumerate(lists)]

    def beats(a: int, b: int) -> bool:
        x, y = head[a], head[b]
        return y is None or (x is not None and x < y)

    loser = [-1] * k
    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node > 0 and loser[node] >= 0:
            if beats(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2
        loser[node] = winner  # an open node waits for the other side; node 0 keeps the winner
    while head[winner := loser[0]] is not None:
        run = lists[winner]
        yield run[place[winner]]
        place[winner] += 1
        head[winner] = (key(run[place[winner]]), winner) if place[winner] < len(run) else None
        node, now = (winner + k) // 2, winner
        while node > 0:
            if beats(loser[node], now):
                now, loser[node] = loser[node], now
            node //= 2
        loser[0] = now


def capture_index(captures: DataFrame, most: int = RANGE_ROWS) -> DataFrame:
    """The captures and where each stands: ``span``, the number of its range, and ``place`` in it. Ordered by these, they are ordered by URL key, time and page.

    captures: runs, each sorted, as read_archives gives them and files keep them. They are dealt to ranges as they are; a run is what comes in order from one archive, so nothing is sorted a second time.
    """
    n = captures.count()
    ranges = max(1, math.ceil(n / most))
    dealt = captures.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "position")
    names = [x.split()[0] for x in CAPTURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[str, list[list[tuple]]] = {}
        schema = None
        for batch in batches:  # a range holds ``most`` captures, about
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = runs.setdefault(row[8], [[]])
                if own[-1] and _order(row) < _order(own[-1][-1]):  # what comes out of order begins a run of its own
                    own.append([])
                own[-1].append(row)
        if schema is None:
            return
        part, place, out = TaskContext.get().partitionId(), 0, []

        def batch_of(rows: list[tuple], first: int) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(range(first, first + len(rows)), pa.int64())], [*names, "span", "place"])

        for row in merge([r for own in runs.values() for r in own]):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(out, place)
                place, out = place + len(out), []
        if out:
            yield batch_of(out, place)

    return dealt.mapInArrow(run, CAPTURES + ", span int, place long")


def archive_and_index(pages: DataFrame, smallest: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives of pages, reads them back and gives their merged index, one row per row of pages. An empty table gives no row; other columns are not read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, smallest)
    return capture_index(stored(read_archives(spark, path), "captures"))

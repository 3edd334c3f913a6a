import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from tidegraph.llm import warc
from tidegraph.llm.common import scratch_path

PAGES = "page_id long, url string, html string, payload string"


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://{rng.choice(['www.', ''])}site{i % 7}.example.com/p/{rng.randint(1, 9)}?b={i % 3}&a=1", f"<p>{i % 40}</p>\r\n\r\nWARC/1.1 ü") for i in range(120)]
    rows += [(200, "http://hot.example.com/", "same")] + [(201 + i, "http://hot.example.com/", "same") for i in range(50)]
    rows += [(300, None, None), (301, "no url at all", ""), (None, "http://x.example/", "same"), (302, "http://y.example/\r\n", "alone"), rows[0]]
    return [(*r, "clash") for r in rows]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_records_come_back(spark, compression):
    rows = pages()
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(5), path, compression=compression)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    first: dict = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        revisit = first[h or ""] != i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None] += 1
    assert got == want


def test_index_is_in_global_order(spark):
    rows = pages()
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    captures = warc.read_archives(spark, path)
    out = warc.capture_index(captures, most=30).orderBy("span", "place").collect()
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else 0, r["page_id"] or 0) for r in out]
    assert keys == sorted(keys) and len(out) == len(rows) and len({r["span"] for r in out}) > 3


def test_losers_merge_like_sorting():
    rng = random.Random(8)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 20), i, j) for j in range(rng.randint(0, 30))) for i in range(k)]
        assert list(warc.merge(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_small_payloads_are_no_revisits_and_broken_archives_are_errors(spark):
    rows = [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")]
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, smallest=5)
    assert {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, path).collect()} == {1: None, 2: None, 3: None, 4: 3}
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n"))
    assert warc.plain(gzip.compress(b"x")) == warc.plain(b"x") == b"x"


def test_keys_of_urls():
    assert warc.url_key("https://www.B.example.com:443/Path/?b=2&A=1") == "com,example,b)/path/?a=1&b=2"
    assert warc.url_key("http://a.org:8080") == "org,a:8080)/" and warc.url_key("plain") == "plain"


def test_no_pages(spark):
    assert warc.archive_and_index(spark.createDataFrame([], PAGES)).count() == 0

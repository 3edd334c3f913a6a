import os
from collections import Counter
from datetime import datetime

import duckdb
import pytest

from tests.test_splits import plain_threads
from tidegraph import queries, source_queries

DATA = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == source_queries.__name__ and n in queries.ORACLE_SQL]
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="the driver's tables are not here")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("customer", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_what_is_written_raw_comes_back_as_sql_has_it(spark, tables, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = tables.sql(queries.ORACLE_SQL[name])
    at = [rows.columns.index(c) for c in df.columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rows.fetchall())
    assert sorted(df.columns) == sorted(rows.columns) and want
    assert Counter(tuple(plain(v) for v in r) for r in df.collect()) == want


def test_threads_of_the_query_are_those_of_a_sequential_loop(spark):
    mails = [tuple(r) for r in source_queries._mails(spark, DATA).select("mail_id", "place", "sender", "to", "subject").collect()]
    want = plain_threads(mails)
    assert want and sorted(tuple(r) for r in queries.QUERIES["mail_threads"](spark, DATA).collect()) == want


def test_names():
    assert len(NAMES) >= 25

"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    cols = sorted(got.column_names)
    mine = sorted(tuple(map(plain, r)) for r in zip(*[got.column(c).to_pylist() for c in cols])) if got.num_rows else []
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    assert mine == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_counts_distinct_events(spark):
    rows = entry.queries()["stream_dedupe_available_now"](spark, DATA).collect()
    assert sum(r.n for r in rows) == 1000


def test_silence_chunks_cover(spark):
    rows = entry.queries()["silence_chunks"](spark, DATA).orderBy("user_id", "index").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.user_id, []).append(r)
    assert by and all(c[0].start == 0 and all(a.end == b.start for a, b in zip(c, c[1:])) for c in by.values())

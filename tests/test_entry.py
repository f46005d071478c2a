"""Every registered query that has a statement gives the statement's rows."""

import re

import __spark_entry__ as entry
import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in entry.queries() if not re.match(r"op\d+_", n) and n != "pipeline"]


def values(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is None or v != v else str(v) for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(rows, key=str)


def oracle(name, folder=FOLDER):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return base.execute(entry.oracle_sql()[name]).df()


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    if name in entry.oracle_sql():
        want = oracle(name)
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

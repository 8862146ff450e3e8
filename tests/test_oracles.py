"""Every query with oracle SQL gives DuckDB's rows on the smallest tables."""

import math
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark, request):
    """Columns and rows of every query asked for, several at a time: each is small and waits on planning."""

    def run(name):
        got = QUERIES[name](spark, SF)
        return got.columns, [tuple(r) for r in got.collect()]

    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "originalname", "") == "test_oracle"]
    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(run, name) for name in names}
    pool.shutdown(cancel_futures=True)


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(results, duck, name):
    columns, got = results[name].result()
    if name not in ORACLES:
        assert columns and got
        return
    wanted = duck.sql(ORACLES[name])
    assert sorted(columns) == sorted(wanted.columns)
    assert rows(columns, got) == rows(wanted.columns, wanted.fetchall())

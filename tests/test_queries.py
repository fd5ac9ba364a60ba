"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from bookmerge.plans import kept, more, steps  # noqa: F401  register further queries
from bookmerge.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_streams_follow_their_batch_twins(spark):
    batch = {r["key"]: r["strikes"] for r in QUERIES["strike_ledger"](spark, SF).collect()}
    assert {r["key"]: r["strikes"] for r in QUERIES["stream_strikes"](spark, SF).collect()} == batch
    assert {tuple(r) for r in QUERIES["stream_bursts"](spark, SF).collect()} == {tuple(r) for r in QUERIES["coalesce_bursts"](spark, SF).collect()}

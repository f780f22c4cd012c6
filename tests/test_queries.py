"""Every query of the media part against its SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from lumaframe import reskin
from lumaframe.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in reskin.TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def in_order(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert len(rows) > 0
        return
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert in_order(df.columns, rows) == in_order(want.columns, want.fetchall())


def test_roll_up_of_the_root_is_the_total(spark):
    root = [r for r in QUERIES["tree_rollup"](spark, SF).collect() if r["rel_path"] == "."][0]
    total = QUERIES["totals"](spark, SF).first()
    assert (root["total"], root["keep"], root["reject"]) == (total["files"], total["keep"], total["reject"])


def test_views_grow_with_the_tables(spark):
    for name in reskin.VIEWS:
        assert reskin.view(spark, "/root/testdata/sf0.01", name).count() > 2 * reskin.view(spark, SF, name).count(), name

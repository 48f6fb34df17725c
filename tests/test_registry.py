"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from vitrine.plans import all_oracles, all_queries

QUERIES = all_queries()
ORACLES = all_oracles()
ROWS_ONLY = {"ivf_probe"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return value


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=str)
    if name not in ORACLES:
        assert found
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
    assert found == wanted


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0

"""Every named query against its SQL on the smallest scale folder."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from tools.compare import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, tables, name):
    frame = contract.queries()[name](spark, FOLDER)
    mine = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    if name not in contract.oracle_sql():
        assert len(mine) > 0
        return
    result = tables.execute(contract.oracle_sql()[name])
    theirs = pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description], dtype=object)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)

"""Every registered motion query against its SQL, over the smallest supplied tables."""

import math
import os

import duckdb
import pytest

from strideframe.plans.oracles import ORACLES
from strideframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    # queries round to six places themselves; what is left are the last bits
    return None if isinstance(x, float) and math.isnan(x) else float(f"{float(x):.9g}") + 0.0


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    found, wanted = rows(df.columns, df.collect()), rows(columns, cursor.fetchall())
    assert len(found) > 0
    assert found == wanted


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

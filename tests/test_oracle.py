"""Every registered query of the engine against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from veritab import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.7g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(shown, value))
    return value


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, database, name):
    frame = catalog.QUERIES[name](spark, SF_DIR)
    cols = sorted(frame.columns)
    rows = sorted((tuple(shown(r[c]) for c in cols) for r in frame.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    result = database.sql(catalog.ORACLE_SQL[name])
    assert sorted(result.columns) == cols
    place = [result.columns.index(c) for c in cols]
    expected = sorted((tuple(shown(r[i]) for i in place) for r in result.fetchall()), key=repr)
    assert rows == expected

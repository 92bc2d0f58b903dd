"""Each query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

from corpusmith.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert found.count() > 0
        return
    ran = con.execute(ORACLE_SQL[name])
    kinds = {d[0]: str(d[1]) for d in ran.description}
    assert {c: TYPES[t] for c, t in found.dtypes} == kinds
    assert rows(found.columns, found.collect()) == rows(list(kinds), ran.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

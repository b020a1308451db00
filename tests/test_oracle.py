"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from docquarry.plans.oracle import ORACLE
from docquarry.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
         "FLOAT": "float", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    relation = tables.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    wanted_types = dict(zip(relation.columns, map(str, relation.types)))
    assert dict(df.dtypes) == {c: TYPES[wanted_types[c]] for c in columns}
    order = lambda row: tuple((value is None, 0 if value is None else value) for value in row)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=order)
    want = sorted(relation.select(*columns).fetchall(), key=order)
    assert got == want

"""Every query of the catalog beside its SQL, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(columns, table):
    return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in columns])))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_like_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, FOLDER).toArrow()
    theirs = duck.sql(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    columns = sorted(ours.column_names)
    if name == "char_entropy":
        a, b = (dict(zip(t.column("doc_id").to_pylist(), t.column("entropy").to_pylist())) for t in (ours, theirs))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-6 for k in a)
    else:
        assert rows(columns, ours) == rows(columns, theirs)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

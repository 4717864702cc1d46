"""Each registered query against its oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from weir.plans import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name, queries, oracles):
    found = queries[name](spark, SF).toPandas()
    if name not in oracles:
        assert len(found)
        return
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        wanted = c.sql(oracles[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    as_rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert as_rows(found) == as_rows(wanted)


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, name):
    compare(spark, name, bindings.QUERIES, bindings.ORACLES)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count()

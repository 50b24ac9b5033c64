"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from check import TABLES, comparable
from rolemeter.catalog.oracle import ORACLE
from rolemeter.catalog.queries import REGISTRY


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, db, sf_dir, name):
    got = comparable(REGISTRY[name](spark, sf_dir).toPandas())
    want = comparable(db.execute(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and len(got) > 0
    assert [str(t) for t in got.dtypes] == [str(t) for t in want.dtypes]
    assert ((got == want) | (got.isna() & want.isna())).all(axis=None)


def test_entry(spark):
    assert entry(spark).columns == ["resume_id", "role", "readiness_score", "readiness_tier", "n_skills", "n_gaps"]

"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from obsmill.plans import oracle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem documents pages conversations".split()
QUERIES, ORACLE = queries.registry(), oracle.oracle()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = ordered(result.fetchall())
    assert ordered(tuple(r[c] for c in columns) for r in frame.collect()) == expected


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


def test_fingerprints_do_not_depend_on_the_partitioning(spark):
    first = {tuple(r) for r in QUERIES["partition_fingerprint"](spark, FOLDER).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert {tuple(r) for r in QUERIES["partition_fingerprint"](spark, FOLDER).collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_contract_has_all_queries_and_their_sql():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_flagship(spark):
    rows = {r.kpi: r.value for r in contract.entry(spark).collect()}
    assert len(rows) == 6 and all(v is not None for v in rows.values())

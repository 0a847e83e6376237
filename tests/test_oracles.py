"""Every registered query against its oracle SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF_DIR}/{file}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 6) if isinstance(value, float) else value


def _bag(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(row[i]) for i in order) for row in data), key=repr)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_gives_the_rows_of_its_oracle(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    assert rows
    if name in contract.oracle_sql():
        expected = duck.sql(contract.oracle_sql()[name])
        assert _bag(frame.columns, rows) == _bag(expected.columns, expected.fetchall())


def test_entry_has_rows(spark):
    assert [row["event_type"] for row in contract.entry(spark).collect()] == ["click", "purchase"]

"""Every registered query against its SQL on the small tables."""

from collections import Counter

import duckdb
import pytest
from paths import TESTDATA

import __spark_entry__ as contract
from tagloom.plans.oracle import SQL
from tagloom.plans.queries import REGISTRY

TABLES = ("benchmark", "conversations", "documents", "events")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'")
    return connection


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(REGISTRY) <= set(contract.queries())
    without = set(REGISTRY) - set(contract.oracle_sql())
    assert without == {"train_parameter_mixing", "train_iterative_mixing"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = contract.queries()[name](spark, TESTDATA)
    columns = sorted(found.columns)
    rows = Counter(tuple(row) for row in found.select(*columns).collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == Counter(tuple(row[i] for i in order) for row in cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() == 4


@pytest.mark.parametrize("name", ["train_parameter_mixing", "train_iterative_mixing"])
def test_training_is_repeatable(spark, name):
    run = contract.queries()[name]
    first, second = ({r.feature: round(r.weight, 9) for r in run(spark, TESTDATA).collect()} for _ in range(2))
    assert first == second and first["TAG:STOP:STOP"] == 0

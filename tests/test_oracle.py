"""Every registered query against its SQL over the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

# The library's own queries, which all have SQL; tests/llm holds those of the text operators.
OWN = {query.__name__ for query in entry_module._QUERIES}
QUERIES = {name: query for name, query in entry_module.queries().items() if name in OWN}
ORACLES = {
    name: sql
    for name, sql in entry_module.oracle_sql().items()
    if name in OWN or name not in entry_module._TEXT_SQL
}
SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}

# Row counts at sf0.01 that were worked out beforehand, apart from both engines.
EXPECTED_ROWS = {
    "entity_catalog": 3875,
    "entity_search_account": 9,
    "entity_search_tags": 37,
    "entity_exact_match": 37,
    "entity_alert_conditions": 2000,
    "entity_relationships": 2 * 51731,
    "entity_recent_violations": 7423,
    "apm_running_instances": 750,
    "dashboard_pages_widgets": 2150,
    "open_incident_after_ack": 3323,
    "policy_list": 25,
    "monitor_create": 161,
    "monitor_create_errors": 89,
    "event_timeseries": 720,
    "event_facet_attr": 100,
    "event_total_result": 6,
    "event_compare": 5,
    "response_parse": 7986 + 2014 + 250,
}


@pytest.fixture(scope="module")
def database(sample_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sample_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, database, sample_dir, name):
    result = QUERIES[name](spark, sample_dir)
    columns = sorted(result.columns)
    rows = [tuple(r) for r in result.select(columns).collect()]

    cursor = database.execute(ORACLES[name])
    types = {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(types) == columns
    assert types == {c: SQL_TYPES[t] for c, t in result.dtypes}
    places = [[c[0] for c in cursor.description].index(c) for c in columns]
    expected = [tuple(r[i] for i in places) for r in cursor.fetchall()]

    assert in_order(rows) == in_order(expected)
    assert len(rows) == EXPECTED_ROWS.get(name, len(rows))


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0

"""Logical tables as Parquet folders.

Events are laid out by day and entities by domain, so a time window or a domain
predicate skips whole folders before any file is opened. Rows are dealt to files by
ranges of the columns they are sorted by, so that a file holds few accounts or a
piece of a large one: an account scope, a cursor or a lookup skips the row groups of
all other files by their bounds. Columns that are looked up by value without any
order have Bloom filters besides.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsq.errors import RequestError
from obsq.schema import TABLES

PARTITIONS = {
    "entity": ["domain"],
    "event": ["event_date"],
}

# Rows are in this order over all files, which gives files and pages narrow bounds on
# the columns that windows, cursors, lookups and account scopes filter by.
SORTED = {
    "entity": ["guid"],
    "event": ["account_id", "ts"],
    "incident": ["account_id", "started_at"],
    "policy": ["account_id", "policy_id"],
    "violation": ["guid", "opened_at"],
    "alert_condition": ["guid"],
    "relationship": ["source_guid"],
    "app_instance": ["guid"],
    "dashboard_page": ["dashboard_guid"],
    "dashboard_widget": ["page_guid"],
}

# Columns with Bloom filters, for exact matches that no order helps.
LOOKED_UP = {
    "entity": ["guid", "name"],
    "incident": ["entity_guid"],
    "violation": ["guid"],
    "alert_condition": ["guid"],
    "relationship": ["target_guid"],
}


# Logs have no folder before the first row is appended, and are empty then.
LOGS = {"incident_ack"}


def table_schema(name: str) -> T.StructType:
    if name not in TABLES:
        raise RequestError(f"no such table: {name}")
    schema = T.StructType(list(TABLES[name].fields))
    if name == "event":
        schema = schema.add("event_date", "date")
    return schema


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One logical table under ``root``; the schema is fixed, never inferred."""
    schema = table_schema(name)
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as missing:
        if name not in LOGS or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_tables(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in (names or TABLES)}


def write_table(rows: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write one logical table in its layout."""
    if name == "event":
        rows = rows.withColumn("event_date", F.to_date("ts"))
    rows = rows.select([F.col(f.name).cast(f.dataType) for f in table_schema(name)])
    layout = PARTITIONS.get(name, [])
    order = [*layout, *SORTED.get(name, [])]
    if order:
        # Ranges of all columns of the order, so a busy day or a large account is
        # cut into several files. AQE merges what is small.
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    bloom = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP.get(name, [])}
    bloom["parquet.bloom.filter.adaptive.enabled"] = "true"
    rows.write.mode(mode).options(**bloom).partitionBy(*layout).parquet(f"{root}/{name}")


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a log folder. Readers fold repeats, so a rerun is harmless."""
    rows.write.mode("append").parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Results as JSON text, one object per line."""
    rows.write.mode(mode).json(path)

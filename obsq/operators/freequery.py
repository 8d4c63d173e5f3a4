"""Free queries over the logical tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from obsq.errors import RequestError


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)


@contextmanager
def views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Iterator[None]:
    """The tables as views for as long as a query is analysed.

    Temporary views the caller has under the same names are there again after it.
    """
    own = {name: spark.table(name) for name in tables if _is_temporary(spark, name)}
    register_views(tables)
    try:
        yield
    finally:
        for name in tables:
            if name in own:
                own[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _is_temporary(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary


def free_query(
    spark: SparkSession, text: str, variables: Mapping[str, Any] | None = None
) -> DataFrame:
    """A SQL query over the registered views.

    Variables are bound as ``:name`` parameters and never become part of the text.
    """
    if not isinstance(text, str) or not text.strip():
        raise RequestError("the query text is empty")
    return spark.sql(text, args=dict(variables or {}))

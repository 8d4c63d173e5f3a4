"""Cutting tables to a set of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.plans.scratch import shared_folder
from obsq.plans.sizes import fits_broadcast


class KeySet:
    """The distinct values of a column of requests.

    Requests that fit a broadcast are used as they are. Of others the distinct values
    are written once, which gives every table that is cut to them one small scan to
    join with, and Spark a table from which it can build a Bloom filter.
    """

    def __init__(self, requests: DataFrame, column: str):
        self.column = column
        self.small = fits_broadcast(requests)
        values = requests.select(column).distinct()
        if not self.small:
            path = shared_folder(requests.sparkSession, "keys")
            values.write.parquet(path)
            values = requests.sparkSession.read.schema(values.schema).parquet(path)
        self.values = values

    def cut(self, rows: DataFrame, column: str | None = None) -> DataFrame:
        """The rows whose ``column`` is among the values.

        Beyond a broadcast both sides are shuffled, the rows behind a Bloom filter of
        the values where the scan is large enough for one to pay. Spark makes it for a
        filtered scan only, so the values get a filter that all of them pass; null
        matches nothing in any case.
        """
        column = column or self.column
        asked = self.values.select(F.col(self.column).alias(column))
        if self.small:
            return rows.join(F.broadcast(asked), column, "left_semi")
        return rows.join(asked.filter(F.col(column) >= ""), column, "left_semi")

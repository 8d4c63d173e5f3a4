"""The entity catalog as the union of its kinds."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.schema import ENTITY


def union_kinds(kinds: Iterable[DataFrame]) -> DataFrame:
    """One wide catalog from tables that each hold one kind of entity.

    Columns a kind lacks become null. A domain or type that is a literal of its
    kind lets the optimizer drop every other kind from a search.
    """
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    present = set(wide.columns)
    return wide.select(
        [
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ENTITY
        ]
    )

"""Joining rows to a lookup by a key that some rows share far too often.

AQE splits a hot key when both join sides come straight from a shuffle. A
lookup that was itself aggregated or joined on the same key does not, so its
hot keys are spread here: a key that fills more than an average shuffle
partition is cut into as many pieces as the partitions it would fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Keys above the mean partition size, with the pieces to cut each into.

    ``counts`` has one row per key and its row count ``n``. At most
    ``spark.sql.shuffle.partitions`` keys can exceed the mean, which bounds the
    result whatever the data, and makes it safe to broadcast.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) * parts > total).select(
        *keys, F.ceil(F.col(n) * parts / total).cast("int").alias("_pieces")
    )


def salted_left_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    row_id: str,
    counts: DataFrame,
    n: str,
    matchable: Column | None = None,
) -> DataFrame:
    """``rows`` left-joined to ``lookup``, one lookup row per key at most.

    ``row_id`` identifies a row; its hash picks the piece, so a recomputed task
    puts every row back where it was. The lookup repeats a hot key once per
    piece: at most twice the shuffle partitions in extra rows over all keys.
    Rows that are not ``matchable``, such as those with a null key, are spread
    over all partitions instead of meeting in one.
    """
    keys = list(keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(counts, keys, n))
    pieces = F.col("_pieces").cast("long")
    if matchable is not None:
        pieces = F.when(matchable, pieces).otherwise(F.lit(parts).cast("long"))
    salt = F.pmod(F.xxhash64(row_id), pieces)
    salted = (
        rows.join(hot, keys, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0).cast("long")))
        .drop("_pieces")
    )
    pieces = F.coalesce(F.col("_pieces"), F.lit(1)).cast("long") - 1
    spread = (
        lookup.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces)))
        .drop("_pieces")
    )
    return salted.join(spread, [*keys, "_salt"], "left").drop("_salt")

"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from obsq.llm.common import discard, from_scratch, store

#: Most links that are joined in one task, without a shuffle.
FEW = 1 << 15


def _largest_to_smallest(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return (
        both.filter(F.col("b") > F.col("a")).join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _smaller_to_smallest(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _all_stars(links: DataFrame) -> bool:
    """Whether every node is either a centre or has one link, to a centre."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def _joined(links: DataFrame) -> DataFrame:
    """The stars of ``FEW`` links or less, by union-find in one task."""
    arrow = to_arrow_schema(links.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(node):
            while (up := parent.setdefault(node, node)) != node:
                parent[node] = node = parent[up]
            return node

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        stars = [(node, root(node)) for node in parent if root(node) != node]
        columns = list(zip(*stars)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return links.coalesce(1).mapInArrow(run, links.schema)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every linked node; a component is its smallest node.

    ``links`` has columns ``a`` and ``b``, in either order. Each round is two
    joins of the links on a node, their table written in between; a node with very
    many links is a hot join key that AQE splits, and its smallest neighbour comes
    from partial aggregates. The number of rounds grows with the logarithm of the
    longest chain; links that are stars already take none. ``FEW`` links take no round
    either, as the tasks of its shuffles would cost more than the links: one task joins them.
    """
    links = store(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = links.count() <= FEW
    if few:
        stars = store(_joined(links))
        discard(links)
        links = stars
    while not few and not _all_stars(links):
        # repeats of a link are dropped once a round
        wide = store(_largest_to_smallest(links))
        discard(links)
        links = store(_smaller_to_smallest(wide).distinct())
        discard(wide)
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    return from_scratch(found, *links._scratch_paths)

"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id, and
each shard is built once into a KD-tree: median splits along the widest side,
leaves of ``LEAF_ROWS`` with tight bounding boxes, stored as packed arrays. The
queries are packed into blocks of ``BLOCK_QUERIES``. Every block meets every
shard, one (block, shard) at a time in a task.

A first pass searches only the best leaf of each shard; the k-th score over all
shards is a bound every query then carries into the second pass. There a query
visits the leaves of a shard from the highest bound down, where the bound of a
box is the largest inner product any point in it could have, and stops at the
first that cannot reach its k-th score. Ties count as reached unless the leaf
holds only larger ids, so the result is exact.

Components become floor(scale * x) as whole numbers; scores are exact while they
are below 2**53.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component, and rows without id, take no part. Vectors of another length than the
query are no candidates. A query's own rows are all rows with its id; of rows
that repeat a query's id, the first by its components asks. Repeated candidates
count each. Fewer than k candidates give fewer rows, an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsq.llm.common import store

SCALE = 256
SHARD_ROWS = 8192
LEAF_ROWS = 64
BLOCK_QUERIES = 4096


def _split(x: np.ndarray, rows: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Leaves of a KD-tree, left to right."""
    out, todo = [], [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            out.append(rows)
            continue
        points = x[rows]
        side = int(np.argmax(points.max(0) - points.min(0)))
        half = len(rows) // 2
        order = np.argpartition(points[:, side], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _build(scale: int, leaf_rows: int):
    """A shard's rows -> one row of packed arrays: points by leaf, ids, leaf starts, boxes."""

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("vec_id", kind="stable")
        ids = shard["vec_id"].to_numpy(np.int64)
        x = np.floor(np.stack(shard["vector"].to_numpy()).astype(np.float64) * scale)
        leaves = _split(x, np.arange(len(x)), leaf_rows)
        order = np.concatenate([np.sort(leaf) for leaf in leaves])
        starts = np.cumsum([0] + [len(leaf) for leaf in leaves])
        low = np.stack([x[leaf].min(0) for leaf in leaves])
        high = np.stack([x[leaf].max(0) for leaf in leaves])
        return pd.DataFrame(
            {
                "dim": [x.shape[1]],
                "shard": [int(shard["shard"].iloc[0])],
                "points": [_pack(x[order])],
                "ids": [_pack(ids[order])],
                "starts": [_pack(starts.astype(np.int64))],
                "low": [_pack(low)],
                "high": [_pack(high)],
            }
        )

    return build


class Shard:
    def __init__(self, row):
        self.dim = dim = int(row["dim"])
        self.x = np.frombuffer(row["points"], np.float64).reshape(-1, dim)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.low = np.frombuffer(row["low"], np.float64).reshape(-1, dim)
        self.high = np.frombuffer(row["high"], np.float64).reshape(-1, dim)
        self.least = np.array([self.ids[a:b].min() for a, b in zip(self.starts, self.starts[1:])])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf the largest inner product the leaf's box allows."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(
        self, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray, visits: int | None = None
    ) -> tuple[np.ndarray, np.ndarray, int]:
        """The best k (scores, ids) of each query, and the leaves visited.

        ``kth`` is a score each query has k candidates at or above already.
        """
        n, leaves = len(q), len(self.low)
        scores = np.full((n, k), -np.inf)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        kth = kth.copy()
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(n)
        seen = 0
        for turn in range(min(leaves, visits or leaves)):
            leaf = order[active, turn]
            bound = bounds[active, leaf]
            reached = bound >= np.maximum(kth[active], scores[active, -1])
            active, leaf, bound = active[reached], leaf[reached], bound[reached]
            if not len(active):
                break
            # a tie with the k-th matters only for a smaller id
            worth = (bound > scores[active, -1]) | (self.least[leaf] < ids[active, -1])
            by_leaf = np.argsort(leaf[worth], kind="stable")
            asked, leaf = active[worth][by_leaf], leaf[worth][by_leaf]
            edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                at = asked[a:b]
                start, end = self.starts[leaf[a]], self.starts[leaf[a] + 1]
                seen += len(at)
                got = q[at] @ self.x[start:end].T
                some = got.max(1) >= np.maximum(kth[at], scores[at, -1])
                at, got = at[some], got[some]
                candidates = np.broadcast_to(self.ids[start:end], got.shape)
                got = np.where(candidates == own[at, None], -np.inf, got)
                got = np.concatenate([scores[at], got], 1)
                candidates = np.concatenate([ids[at], candidates], 1)
                best = np.lexsort((candidates, -got), axis=1)[:, :k]
                scores[at] = np.take_along_axis(got, best, 1)
                ids[at] = np.take_along_axis(candidates, best, 1)
        return scores, ids, seen


def vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vector, dim`` of the rows that take part."""
    value = F.col(vector).cast("array<double>")
    good = F.forall(value, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return rows.select(
        F.col(id_column).cast("long").alias("vec_id"), value.alias("vector"), F.size(value).alias("dim")
    ).filter(F.col("vec_id").isNotNull() & (F.col("dim") > 0) & good)


def build_index(points: DataFrame, scale: int = SCALE, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row of packed arrays per shard, written to the shared folder."""
    shards = max(1, -(-points.count() // shard_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)))
    schema = "dim int, shard long, points binary, ids binary, starts binary, low binary, high binary"
    return store(dealt.groupBy("dim", "shard").applyInPandas(_build(scale, leaf_rows), schema))


def _query_blocks(queries: DataFrame, scale: int, block_rows: int, total: int) -> DataFrame:
    """One row per block of queries of one length: packed ids and components."""
    blocks = max(1, -(-total // block_rows))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id")
        x = np.floor(np.stack(block["vector"].to_numpy()).astype(np.float64) * scale)
        kth = block["kth"].to_numpy(np.float64) if "kth" in block else np.full(len(x), -np.inf)
        return pd.DataFrame(
            {
                "dim": [x.shape[1]], "block": [int(block["block"].iloc[0])],
                "asked": [_pack(block["vec_id"].to_numpy(np.int64))], "q": [_pack(x)], "kth": [_pack(kth)],
            }
        )

    return store(dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, asked binary, q binary, kth binary"))


def _search(blocks: DataFrame, index: DataFrame, k: int, visits: int | None) -> DataFrame:
    """``query_id, vec_id, score``: the best k of each query in each shard."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each shard once for every block and each block once for every shard, so that
    # the pairs, and not the few lengths or blocks, are what is dealt to tasks
    sizes = index.agg(F.max("shard")).first()[0], blocks.agg(F.max("block")).first()[0]
    last_shard, last_block = (F.lit(n if n is not None else 0).cast("long") for n in sizes)
    pairs = (
        index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
        .repartition(parts, "dim", "shard", "block")
        .join(
            blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), last_shard)))
            .repartition(parts, "dim", "shard", "block"),
            ["dim", "shard", "block"],
        )
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                shard = Shard(row)
                q = np.frombuffer(row["q"], np.float64).reshape(-1, shard.dim)
                asked = np.frombuffer(row["asked"], np.int64)
                kth = np.frombuffer(row["kth"], np.float64)
                scores, ids, _ = shard.search(q, asked, k, kth, visits)
                found = np.isfinite(scores) & (scores >= kth[:, None])
                at, _ = np.nonzero(found)
                yield pd.DataFrame(
                    {"query_id": asked[at], "vec_id": ids[found], "score": scores[found].astype(np.int64)}
                )

    return pairs.mapInPandas(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    points: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE,
    shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``points`` for each of ``queries``.

    Both have ``vec_id, vector, dim`` as from ``vectors``.
    """
    first = W.partitionBy("vec_id").orderBy("vector")
    asked = store(
        queries.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    )
    total = asked.count()
    index = build_index(points, scale, shard_rows, leaf_rows)
    blocks = _query_blocks(asked, scale, block_queries, total)
    sample = _best(_search(blocks, index, k, visits=1), k)
    bounds = sample.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score").cast("double")).alias("kth")
    )
    carried = asked.join(bounds, asked["vec_id"] == F.col("query_id"), "left").select(
        "vec_id", "vector", "dim", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")
    )
    exact = _search(_query_blocks(carried, scale, block_queries, total), index, k, visits=None)
    return _best(exact, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

"""Near-dedup by SimHash, checked and completed by Jaccard similarity: 0.8 of the five-word shingles.

Documents get a SimHash fingerprint of their five-word shingles, as in ``simhash``;
those whose fingerprints are linked form groups, and each is compared with the
first of its group on the whole shingle sets. Four bits link only the closest
copies, so the rest of the pairs is found exactly, none by chance:

- Of two documents with similarity 0.8 or more, the first three tenths of the
  shingles of either by hash have a number in common that their sizes tell
  (`early`). Documents that share fewer with all others have no near copy.
- The shingles of the others are put in one order, the rarest first, by how many
  of these documents have them. Of two similar ones, the first fifth of either
  (and one more) have a shingle in common. Documents that meet under such a
  shingle are candidates, and all are verified on their whole shingle sets.

Equal sets are one node, whatever their number. In a few turns a node is first
verified with two nodes only, of the first and last under each of its shingles in
an order of the turn, which is linear and joins most of a large group of copies;
no further turn is taken once one hardly lowers the number of pairs left. What is still in different components then meets under the shingles where more
than one component is left. Sets are compared only where the number of shingles
shared in the prefixes allows 0.8.

Defined cases: a null or empty text has the empty set, and all of these are one
document. A text of fewer than five words is one shingle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsq.llm.common import discard, map_texts, shuffles_freed, store, store_buckets
from obsq.llm.graph import components
from obsq.llm.simhash import _signed, majority, near_components, shingle_hashes

WIDTH = 5
#: Counts of a set's shingles by the top bits of their hash; sets of similarity 0.8 have similar ones.
BINS = 64
#: Candidates are compared in shares of so many shingles, for the disk they take on the way, ...
SHARE = 1 << 22
#: ... but in so many shares at most.
SHARES = 4
#: Most turns in which nodes are verified with two others before all pairs left are.
TURNS = 5
#: No turn is taken where the shingles left make no more pairs than this times their rows, ...
FEW_PAIRS = 4
#: ... or where the last turn left more than this of them.
STALLED = 0.9


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def early(hashes: np.ndarray) -> np.ndarray:
    """The smallest shingles of a set; sets of similarity 0.8 have `_known` or more of either's in common."""
    n = len(hashes)
    return hashes[: n - _least(n) + max(1, n // 10)] if n else hashes


def histogram(hashes: np.ndarray) -> np.ndarray:
    """Number of shingles in each of ``BINS`` ranges of the hash."""
    return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(np.int32)


def _least(n: int) -> int:
    """0.8 of a number, rounded up."""
    return (4 * n + 4) // 5


def _known() -> Column:
    """How many shingles of `early` any set similar to one of ``n`` shares: its own tenth, if it has 0.8 of them."""
    return F.greatest(F.lit(1), F.expr("(4 * n + 4) div 5 div 10"))


def _longs(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _similar(shared: Column) -> Column:
    """Whether sets of sizes ``n`` and ``m`` with so many elements in common reach 0.8."""
    return 9 * shared >= 4 * (F.col("n") + F.col("m"))


def _sizes_allow(n: str, m: str) -> Column:
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


def _in_order(i: str, j: str) -> Column:
    """Whether sets can reach 0.8 if the first shingle they share is the ``i``-th of one, ``j``-th of the other."""
    rest = F.least(F.col("n") - F.col(i), F.col("m") - F.col(j))
    return _similar(rest)


def _histograms_allow(f: str, g: str) -> Column:
    """Sets share at most the smaller count of each range of the hash."""
    least = F.zip_with(f, g, lambda x, y: F.least(x, y))
    return _similar(F.aggregate(least, F.lit(0), lambda a, x: a + x))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar.

    Histograms are compared first; they travel in place of the sets of most pairs. The
    sets are in buckets of their node, so what travels is one set for each pair left,
    and that in a few shares, one after the other, if the sets are large or many.
    """

    def side(node: str, size: str, column: str, name: str) -> DataFrame:
        return sets.select(F.col("node").alias(node), F.col("n").alias(size), F.col(column).alias(name))

    close = store(
        pairs.select("a", "b").join(side("a", "n", "bins", "f"), "a").join(side("b", "m", "bins", "g"), "b")
        .filter(_histograms_allow("f", "g")).select("a", "b", (F.col("n") + F.col("m")).alias("both"))
    )
    size = close.agg(F.sum("both")).first()[0] or 0
    shares = max(1, min(SHARES, -(-size // SHARE)))
    found = [
        store(
            close.filter(F.pmod(F.xxhash64("b"), F.lit(shares)) == share).select("a", "b")
            .join(side("a", "n", "shingles", "s"), "a").join(side("b", "m", "shingles", "t"), "b")
            .filter(_similar(F.size(F.array_intersect("s", "t")))).select("a", "b")
        )
        for share in range(shares)
    ]
    discard(close)
    if shares == 1:
        return found[0]
    whole = store(reduce(DataFrame.unionByName, found))
    discard(*found)
    return whole


def _promising(pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose number of shared shingles of the prefixes allows 0.8; a row for each of those."""
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    # what follows the prefix that ends first adds at most its own length
    most = F.col("shared") + F.ceil(F.greatest("n", "m") * 4 / F.lit(5)) - 1
    return store(shared.filter(_similar(most)).select("a", "b"))


def _tries(left: DataFrame, met: DataFrame, turn: int) -> DataFrame:
    """Promising pairs of a node with at most two others, the two ends of its shingles in an order of this turn."""
    place = F.struct(F.xxhash64(F.lit(turn), "node").alias("at"), "node", "n", "component")
    ends = left.groupBy("token").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("times", "b", "m")), False), 1, 2)
    tried = store(
        left.join(ends, "token").select("node", "n", "component", F.explode(F.array("low", "high")).alias("end"))
        .filter((F.col("component") != F.col("end.component")) & _sizes_allow("n", "end.n"))
        .groupBy("node", "n", F.col("end.node").alias("b"), F.col("end.n").alias("m")).agg(F.count("*").alias("times"))
        .groupBy("node", "n").agg(best.alias("best"))
        .select("node", "n", F.explode("best").alias("e")).select("node", "n", "e.b", "e.m")
    )
    # the shingles a pair shares are counted over all of them, not those it was found by
    own = tried.join(met.select("node", "token"), "node").withColumnRenamed("node", "a")
    promising = _promising(own.join(met.select(F.col("node").alias("b"), "token"), ["b", "token"]))
    discard(tried)
    return promising


def _shared(rows: DataFrame, column: str) -> DataFrame:
    """Rows of the tokens that more than one value of a column has."""
    several = (
        rows.groupBy("token").agg(F.min(column).alias("low"), F.max(column).alias("high"))
        .filter("low < high").select("token")
    )
    return rows.join(several, "token", "left_semi")


def _with_copies(nodes: DataFrame) -> DataFrame:
    """The nodes that can have a near copy, by the shingles of `early` that others share."""
    tokens = nodes.select(F.explode("early").alias("token"), "node")
    several = tokens.groupBy("token").count().filter("count > 1").select("token")
    shared = tokens.join(several, "token", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    return store(nodes.select("node", "n", "row", "fp").join(shared, "node").filter(F.col("shared") >= _known()).drop("shared"))


def _hashed_alike(heads: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of a node with the first of its SimHash group and the first of its fingerprint."""
    rows = heads.join(groups, "fp")
    first = F.min(F.struct("node", "n")).alias("first")
    pairs = [
        rows.join(rows.groupBy(of).agg(first), of)
        .filter((F.col("node") != F.col("first.node")) & _sizes_allow("n", "first.n"))
        .select(F.col("node").alias("a"), F.col("first.node").alias("b"))
        for of in ("component", "fp")
    ]
    return store(pairs[0].unionByName(pairs[1]).distinct())


def _met(sets: DataFrame) -> DataFrame:
    """``token, node, n, at`` of the shingles under which a node meets others, rarest first.

    What only one node has comes before all of these and meets none.
    """
    tokens = sets.select(F.explode("shingles").alias("token"), "node", "n")
    times = store(tokens.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1"))
    # counted from the commonest, as the shingles of no other node are not listed
    last = F.row_number().over(W.partitionBy("node").orderBy(F.desc("times"), F.desc("token")))
    ordered = (
        tokens.join(times, "token").withColumn("last", last).filter(F.expr("last >= (4 * n + 4) div 5"))
        .select("token", "node", "n", (F.col("n") - F.col("last")).alias("at"))
    )
    listed = store(ordered)
    met = store(_shared(listed, "node"))
    discard(times, listed)
    return met


def _joined(new: DataFrame, *linked: DataFrame) -> DataFrame:
    """``node, component`` by new links and what is linked already, stored; the others are discarded."""
    stars = [rows.select(F.col("node").alias("a"), F.col("component").alias("b")) for rows in linked]
    whole = components(reduce(DataFrame.unionByName, stars, new))
    found = store(whole)
    discard(new, whole, *linked)
    return found


def _apart(left: DataFrame, linked: DataFrame) -> DataFrame:
    """Shingles under which nodes of more than one component meet, with the component of each."""
    return store(_shared(
        left.join(linked, "node", "left")
        .select("token", "node", "n", "at", F.coalesce("component", "node").alias("component")),
        "component",
    ))


def _meetings(left: DataFrame) -> tuple[int, float]:
    """How many rows the shingles left have, and how many pairs these make at most."""
    n = F.col("count")
    found = left.groupBy("token").count().agg(F.sum(n).alias("rows"), F.sum(n * (n - 1) / 2).alias("pairs")).first()
    return found["rows"] or 0, found["pairs"] or 0


def similar_components(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, component`` of the nodes that are linked to another.

    ``marked`` has ``row, node, n, fp, early`` of every row and is discarded, ``texts`` has
    ``row, text``; ``row`` is a key that only equal rows share.
    """
    # equal sets of which words repeat differ in their fingerprints; one stands for them
    nodes = store(
        marked.groupBy("node", "n")
        .agg(F.min("fp").alias("fp"), F.first("early").alias("early"), F.min("row").alias("row"))
    )
    discard(marked)
    groups = near_components(nodes.select("fp").distinct())
    # one row of each node that may have near copies, to read its text by
    heads = _with_copies(nodes)
    discard(nodes)

    def per_text(batch: list[str]) -> list[list]:
        found = [shingle_set(t) for t in batch]
        return [[_longs(f) for f in found], [histogram(f) for f in found]]

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = (
        texts.join(heads, "row").repartition(parts, "node")
        .groupBy("node").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    )
    sets = store_buckets(map_texts(once, "text", ["node", "n"], "shingles array<long>, bins array<int>", per_text), "node")
    alike = _hashed_alike(heads, groups)
    discard(heads, groups)
    new = _verified(alike, sets)
    discard(alike)
    linked = _joined(new)
    met = _met(sets)
    left = _apart(met, linked)
    before = float("inf")
    for turn in range(TURNS):
        rows, meetings = _meetings(left)
        if meetings <= FEW_PAIRS * rows or meetings > STALLED * before:
            break
        before = meetings
        promising = _tries(left, met, turn)
        new = _verified(promising, sets)
        discard(promising)
        if new.isEmpty():
            discard(new)
            break
        linked = _joined(new, linked)
        # shingles all of whose nodes are joined already need no more looks
        kept = _apart(left.drop("component"), linked)
        discard(left)
        left = kept
    other = left.select(
        "token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("component").alias("d")
    )
    # a similar pair meets under the first shingle that it shares, if under no other
    pairs = store(
        left.withColumnRenamed("node", "a").join(other, "token")
        .filter((F.col("component") < F.col("d")) & _sizes_allow("n", "m") & _in_order("at", "bt"))
        .select("a", "b").distinct()
    )
    new = _verified(pairs, sets)
    discard(pairs, left, met, sets)
    return _joined(new, linked)


def _heads(docs: DataFrame, text: Column, own: list[Column], row: Column) -> DataFrame:
    """``row`` of one document of each group; that is a key which only equal rows share."""

    def per_text(texts: list[str]) -> list[list]:
        columns: list[list] = [[], [], [], []]
        for t in texts:
            every = shingle_hashes(t, WIDTH)
            hashes = np.unique(every)
            node = _signed(xxhash.xxh64_intdigest(hashes.tobytes()))
            values = [node, len(hashes), _signed(majority(every)), _longs(early(hashes))]
            for column, value in zip(columns, values):
                column.append(value)
        return columns

    marked = store(map_texts(docs, "text", [*own, row], "node long, n long, fp long, early array<long>", per_text))
    ids = store(marked.select("node", "row", "id", "h", "g"))
    placed = similar_components(marked, docs.select(row, text.alias("text")))
    smallest = F.struct(F.col("id").isNull(), "id", "h", "g")
    heads = store(
        ids.join(placed, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.min_by("row", smallest).alias("row")).select("row")
    )
    discard(ids, placed)
    return heads


def drop_similar(docs: DataFrame) -> DataFrame:
    """One document of each group linked by similarities of 0.8 or more, columns as they came.

    Links are found by SimHash and verified, then completed by shingles (see above).

    It is the one with the smallest id. A null id is larger than any; of documents
    with one id, null or repeated, the one with the smaller hash of its text counts
    as smaller. Equal texts under one id are one document, of which one row stays.
    """
    text = F.col("text").cast("string")
    own = [F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")]
    # what tells documents of one id apart, in one key for joins and the window at the end
    row = F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64(text), F.xxhash64(F.lit(7), text)).alias("row")
    with shuffles_freed(docs.sparkSession):
        heads = _heads(docs, text, own, row)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), row)
    kept = rows.join(heads, "row", "left_semi")
    once = W.partitionBy("row").orderBy(F.xxhash64("_doc"))
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_doc.*")

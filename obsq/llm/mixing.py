"""Mixing sources to target weights by weighted fair queueing, in SQL functions only.

Each source's documents are shuffled by a hash and queued, up to ``EPOCHS`` times
over. A queued document's virtual finish time is the words of its source up to
and including it, divided by the source's target; all queues are then ordered by
that time and cut where the words reach the total budget.

Running sums never pass through one task. A source's queue is cut into about
sqrt(rows) slices by the hash, the slices are summed, and the sum before each
slice is added to a running sum inside it; the cut of the whole order is found
the same way over slices of virtual time. What one task holds grows with the
square root of the largest source.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last. A source without words has the target 0 and is not taken. Ties in
time are ordered by source, hash and id; repeated rows are counted each. An empty
table gives an empty result. The order depends only on ids and texts, so reruns
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obsq.llm.common import WORD, store

# The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, rows, target`` of sized documents, one row per source.

    All sources share one total by weight. A source is full at ``epochs`` times
    its size, and its excess goes to the others by weight until none is over: in
    the order of (room / weight) the full ones come first, so that one pass with
    running sums finds the level of the rest.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("rows")
    )
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int")
    ).cast("long")
    everything = W.partitionBy()
    filled = W.orderBy(F.col("_room") / F.col("_weight"), F.col("_rank"))
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    after = filled.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_room").over(before), F.lit(0))).cast("double") / (
        F.sum("_weight").over(after).cast("double")
    )
    return (
        per_source.withColumn("_rank", F.row_number().over(in_order) - 1)
        .withColumn("_weight", weight)
        .withColumn("_room", F.col("source_size") * epochs)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_level", level)
        # full while the level asks for more than the room; the first that is not
        # sets the level of all later ones, whose own would be no higher
        .withColumn("_open", F.col("_room") >= F.col("_level") * F.col("_weight"))
        .withColumn("_water", F.max(F.when(F.col("_open"), F.col("_level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
                F.least(F.col("_room").cast("double"), F.col("_water") * F.col("_weight"))
            ),
        )
        .select("source", "source_size", "rows", "target", "_rank")
    )


def _finish(epoch: int) -> Column:
    """Virtual finish time of a document's n-th turn."""
    words = F.col("_queued") + F.col("source_size") * (epoch - 1)
    return words.cast("double") / F.col("target")


def _slice(time: Column, slices: int) -> Column:
    """Slice of virtual time; what ends after twice the targets shares the last."""
    return F.least(F.floor(time * slices), F.lit(2 * slices)).cast("long")


def _place(epoch: int | Column, time: Column) -> Column:
    """A turn's place in the order of all turns."""
    turn = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.struct(
        time.alias("time"), F.col("_rank").alias("rank"), F.col("_mix").alias("mix"),
        F.col("_id").alias("id"), F.col("size").alias("size"), turn.alias("turn"),
    )


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    source: str = "source",
    epochs: int = EPOCHS,
    keep: list[Column] | None = None,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row (with ``keep`` beside).

    ``copies`` is how often the mix takes the document, ``taken`` its words times that.
    """
    mix = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    kept = keep or []
    sized = store(
        docs.select(
            F.col(id_column).alias("_id"), F.col(source).alias("source"), mix.alias("_mix"),
            word_count(F.col(text)).alias("size"), *kept,
        )
    )
    names = sized.columns[4:]
    targets = store(source_targets(sized, epochs)).withColumnRenamed("source", "_source")
    # a source's queue in slices of the hash
    at = F.conv(F.substring("_mix", 1, 8), 16, 10).cast("double") / float(2**32)
    dealt = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_part", F.floor(at * F.ceil(F.sqrt("rows"))).cast("long")
    )
    before = W.partitionBy("_rank").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("_rank", "_part").agg(F.sum("size").alias("_words"))
        .select("_rank", "_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_rank", "_part").orderBy("_mix", "_id", "size").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    queue = store(
        dealt.join(offsets, ["_rank", "_part"])
        .withColumn("_queued", F.col("_offset") + F.sum("size").over(inside))
        .select("_id", "_mix", "_rank", "size", "source_size", "target", "_queued", *names)
    )
    last = _cut(queue, epochs)
    copies = F.lit(0)
    if last is not None:
        cut = F.struct(*[F.lit(last[f]).cast(kind).alias(f) for f, kind in last["kinds"].items()])
        for epoch in range(1, epochs + 1):
            turn = F.when(F.col("target") > 0, _place(epoch, _finish(epoch)) <= cut)
            copies = copies + F.coalesce(turn, F.lit(False)).cast("int")
    return (
        queue.withColumn("copies", copies)
        .select(
            F.col("_id").alias(id_column), "size", "source_size", "target",
            (F.col("size") * F.col("copies")).alias("taken"), "copies", *names,
        )
    )


def _cut(queue: DataFrame, epochs: int) -> dict | None:
    """The place of the last turn within the total budget, None if there is none.

    Turns are summed by slices of virtual time; only the slice where the budget
    ends is ordered turn by turn.
    """
    totals = queue.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    if not totals["words"]:
        return None
    slices, budget = int(totals["n"] ** 0.5) + 1, totals["words"]
    turns = queue.filter("target > 0").select(
        "size",
        F.explode(
            F.array(*[_place(e, _finish(e)) for e in range(1, epochs + 1)])
        ).alias("place"),
    ).withColumn("_slice", _slice(F.col("place.time"), slices))
    running = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    # a few times sqrt(rows) sums at most
    sums = turns.groupBy("_slice").agg(F.sum("size").alias("words"), F.max("place").alias("last")).withColumn(
        "upto", F.sum("words").over(running)
    )
    full = sums.filter(F.col("upto") <= budget).orderBy(F.desc("_slice")).select("upto", "last", "_slice").first()
    partly = sums.filter(F.col("upto") > budget).orderBy("_slice").select("_slice", (F.col("upto") - F.col("words")).alias("before")).first()
    last = full["last"] if full else None
    if partly:
        order = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
        inside = (
            turns.filter(F.col("_slice") == partly["_slice"])
            .withColumn("upto", F.sum("size").over(order) + partly["before"])
            .filter(F.col("upto") <= budget).agg(F.max("place").alias("last")).first()
        )
        last = inside["last"] or last
    if last is None:
        return None
    kinds = {f.name: f.dataType for f in turns.schema["place"].dataType.fields}
    return last.asDict() | {"kinds": kinds}


def take_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, with the columns it came with."""
    whole = F.struct(*docs.columns).alias("_doc")
    mixed = mix_sources(docs, keep=[whole])
    return mixed.select(F.explode(F.expr("slice(array(1, 2, 3), 1, copies)")).alias("_turn"), "_doc").select("_doc.*")

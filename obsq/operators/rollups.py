"""Rollups of events: one row per short bucket and facet, merged into any coarser answer.

A rollup row holds what can be added up: the number of events, sums, extremes, and
sketches of distinct values (HyperLogLog) and of the distribution of a value (KLL). A
question over hours or days, its total and its comparison with an earlier window then
read rollup rows, of which there are as many as buckets and facets, however many
events there were. Counts, sums, means and extremes are exact; a distinct count has a
standard error of about 1.6 %, a quantile one of about 1.3 % of the rank.

Rows are published batch by batch, and a batch counts once, however often it is added.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.operators.events import EPOCH, EventQuery, _named, _seconds
from obsq.sources.published import Published, PublishConflict

#: Sizes of the sketches: 2**12 registers, and levels of at least 200 values.
HLL_BITS, KLL_SIZE = 12, 200
TRIES = 20


class Rollup:
    """Rollups under ``root``.

    ``facets`` are kept besides the event type and the account; ``values`` are
    numbers to sum and sketch, ``distinct`` columns to count the values of.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        bucket: timedelta = timedelta(hours=1),
        facets: Sequence[str | Column] = (),
        values: Sequence[str] = (),
        distinct: Sequence[str] = (),
    ):
        self.spark = spark
        self.store = Published(spark, root)
        self.bucket, self.seconds = bucket, _seconds(bucket)
        self.facets, self.values, self.distinct = list(facets), list(values), list(distinct)

    def add(self, events: DataFrame, batch: str) -> None:
        """Roll up a batch of events that no other batch holds."""
        for _ in range(TRIES):
            base = self.store.current()
            if batch in base.batches:
                return
            part = self.store.stage(self._rolled(events), "rollup", len(base.batches), compression="zstd")
            try:
                self.store.publish(base, [*base.parts, part], {**base.batches, batch: len(base.batches)})
                return
            except PublishConflict:
                continue
        raise PublishConflict(f"{TRIES} other batches came before {batch!r}; add it again")

    def _rolled(self, events: DataFrame) -> DataFrame:
        keyed, names = _named(events, ["event_type", "account_id", *self.facets])
        size = f"{self.seconds} seconds"
        sums = [F.count("*").alias("n")]
        for v in self.values:
            number = F.col(v).cast("double")
            sums += [
                F.sum(number).alias(f"{v}_sum"), F.count(number).alias(f"{v}_n"), F.min(number).alias(f"{v}_min"),
                F.max(number).alias(f"{v}_max"), F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias(f"{v}_kll"),
            ]
        for d in self.distinct:
            sums.append(F.hll_sketch_agg(d, F.lit(HLL_BITS)).alias(f"{d}_hll"))
        grouped = keyed.groupBy(F.window("ts", size).alias("_slot"), *names).agg(*sums)
        rest = [c for c in grouped.columns if c != "_slot"]
        rows = grouped.select(F.col("_slot.start").alias("ts"), *rest)
        return rows.repartitionByRange("ts", *names).sortWithinPartitions("ts", *names)

    def rows(self) -> DataFrame:
        """The rollup rows; ``ts`` is the start of their bucket. A bucket whose events
        came in several batches has several rows."""
        parts = self.store.current().of_kind("rollup")
        if not parts:
            raise RequestError("nothing was rolled up yet")
        return self.spark.read.parquet(*[f"{self.store.root}/{part.path}" for part in parts])

    # --- measures, to be used as aggregates of `query` ---

    def count(self) -> Column:
        return F.coalesce(F.sum("n"), F.lit(0))

    def total(self, value: str) -> Column:
        return F.sum(f"{self._value(value)}_sum")

    def mean(self, value: str) -> Column:
        return F.sum(f"{self._value(value)}_sum") / F.nullif(F.sum(f"{value}_n"), F.lit(0))

    def least(self, value: str) -> Column:
        return F.min(f"{self._value(value)}_min")

    def most(self, value: str) -> Column:
        return F.max(f"{self._value(value)}_max")

    def quantile(self, value: str, share: float) -> Column:
        sketch = F.kll_merge_agg_double(f"{self._value(value)}_kll")
        return F.when(F.sum(f"{value}_n") > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(share))))

    def distinct_count(self, column: str) -> Column:
        if column not in self.distinct:
            raise RequestError(f"{column} has no distinct counts in this rollup")
        return F.hll_sketch_estimate(F.hll_union_agg(f"{column}_hll"))

    def _value(self, value: str) -> str:
        if value not in self.values:
            raise RequestError(f"{value} is not a value of this rollup")
        return value

    # --- questions ---

    def query(
        self,
        aggregates: Sequence[Column],
        event_types: Sequence[str] | None = None,
        begin: datetime | None = None,
        end: datetime | None = None,
        facets: Sequence[str | Column] = (),
        bucket: timedelta | None = None,
        compare_back: timedelta | None = None,
        fill: bool = False,
        rows: DataFrame | None = None,
    ) -> EventQuery:
        """As `Workspace.event_query`, over rollup rows.

        Window, buckets and the step back must be whole numbers of the rollup's
        buckets: rows cannot be cut. ``rows`` may be `rows()` cut to some accounts.
        """
        for moment in (begin, end):
            if moment is not None and (moment - EPOCH) % self.bucket:
                raise RequestError(f"{moment} is not the start of a bucket of {self.bucket}")
        for length in (bucket, compare_back):
            if length is not None and length % self.bucket:
                raise RequestError(f"{length} is not a whole number of buckets of {self.bucket}")
        return EventQuery(
            self.rows() if rows is None else rows, aggregates, event_types, begin, end, facets, bucket, compare_back, fill
        )

"""Created monitors, stored once each.

A batch of definitions is checked, its accepted monitors are compared with the GUIDs
stored before, and what is new is published in one step together with the name of
the batch. A batch that runs again, or shares requests with another, adds nothing
twice; a batch that fails half-way leaves nothing that a reader sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsq.operators.monitors import MonitorBatch, as_entities, check_monitors
from obsq.schema import TAGS
from obsq.sources.published import Published, PublishConflict

TRIES = 20
STORED = (
    T.StructType()
    .add("req_id", "long")
    .add("guid", "string")
    .add("account_id", "integer")
    .add("name", "string")
    .add("uri", "string")
    .add("locations", T.StructType().add("public", T.ArrayType(T.StringType())))
    .add("period", "string")
    .add("status", "string")
    .add("type", "string")
    .add("tags", TAGS)
    .add("batch", "string")
)


class MonitorStore:
    """The monitors under ``root``."""

    def __init__(self, spark: SparkSession, root: str, default_account: int | None = None):
        self.store = Published(spark, root)
        self.default_account = default_account

    def create(self, requests: DataFrame, batch: str) -> MonitorBatch:
        """Check a batch of definitions and store the accepted ones that are new."""
        checked = check_monitors(requests, self.default_account)
        for _ in range(TRIES):
            base = self.store.current()
            if batch in base.batches:
                return checked
            # a request that occurs twice gives one monitor
            one = checked.created.groupBy("guid").agg(
                F.min_by(F.struct([F.col(f.name) for f in STORED if f.name not in ("guid", "batch")]), "req_id").alias("row")
            ).select("guid", "row.*")
            stored = self.store.open(base.of_kind("monitor"), STORED).select("guid")
            new = one.join(stored, "guid", "left_anti").withColumn("batch", F.lit(batch))
            part = self.store.stage(
                new.select([F.col(f.name).cast(f.dataType) for f in STORED]), "monitor", len(base.batches), compression="zstd"
            )
            try:
                self.store.publish(base, [*base.parts, part], {**base.batches, batch: len(base.batches)})
                return checked
            except PublishConflict:
                continue
        raise PublishConflict(f"{TRIES} other batches came before {batch!r}; create it again")

    def monitors(self) -> DataFrame:
        """Every stored monitor, with the batch that created it."""
        return self.store.open(self.store.current().of_kind("monitor"), STORED)

    def entities(self) -> DataFrame:
        """Stored monitors as rows of the catalog."""
        return as_entities(self.monitors().drop("batch"))

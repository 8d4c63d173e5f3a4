"""A log of acknowledgements that is published batch by batch.

A batch has a name and is applied once: its requests are judged against the
incidents as the batches before it left them, and the accepted ones are published
together with the batch's name. Applied again, after a failure or by mistake, it
writes nothing and gets the outcomes it had, as it is judged by the rows of earlier
batches alone. A request is told by its batch and its id, so batches may use the same
ids. Of two batches applied at one time the later one is judged again.

`compact` folds the log into one snapshot, a row per incident sorted by account and
incident; readers open the snapshot and the batches since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsq.operators.acknowledge import LOG_FIELDS, accepted, acknowledge, current_incidents, still_open
from obsq.schema import INCIDENT_ACK
from obsq.sources.published import Part, Published, PublishConflict, Version

#: Times a batch is judged anew because another one was published first.
TRIES = 20

SNAPSHOT, TAIL = "snapshot", "batch"
LOG_ROW = INCIDENT_ACK.__class__(list(INCIDENT_ACK.fields)).add("batch", "string").add("batch_no", "integer")


class AcknowledgementLog:
    """The log under ``root``."""

    def __init__(
        self, spark: SparkSession, root: str, default_account: int | None = None, match_account: bool = True
    ):
        self.store = Published(spark, root)
        self.default_account = default_account
        self.match_account = match_account

    def apply(self, requests: DataFrame, incidents: DataFrame, batch: str) -> DataFrame:
        """Outcome of each request of a batch, the accepted ones in the log for good.

        ``incidents`` are in their base state, as before any acknowledgement.
        """
        for _ in range(TRIES):
            base = self.store.current()
            if batch not in base.batches:
                number = 1 + max(base.batches.values(), default=0)
                rows = (
                    accepted(self._judged(requests, incidents, base, number))
                    .withColumns({"batch": F.lit(batch), "batch_no": F.lit(number)})
                )
                part = self.store.stage(rows, TAIL, number, compression="zstd")
                try:
                    base = self.store.publish(base, [*base.parts, part], {**base.batches, batch: number})
                except PublishConflict:
                    continue
            return self._judged(requests, incidents, base, base.batches[batch])
        raise PublishConflict(f"{TRIES} other batches came before {batch!r}; apply it again")

    def _judged(self, requests: DataFrame, incidents: DataFrame, version: Version, number: int) -> DataFrame:
        earlier = self._rows(version, number)
        now = current_incidents(incidents, earlier, self.default_account, self.match_account)
        return acknowledge(requests, now.select(incidents.columns), self.default_account, self.match_account)

    def _rows(self, version: Version, before: int | None = None) -> DataFrame:
        parts = version.of_kind(SNAPSHOT, TAIL)
        if before is None:
            return self.store.open(parts, LOG_ROW)
        # the snapshot may hold rows of that batch and later ones
        open_ = [p for p in parts if p.kind == SNAPSHOT or p.number < before]
        return self.store.open(open_, LOG_ROW).filter(F.col("batch_no") < before)

    def rows(self) -> DataFrame:
        """Every accepted request, with its batch."""
        return self._rows(self.store.current())

    def incidents(self, base: DataFrame) -> DataFrame:
        """Incidents in their present state, with who acknowledged them and when."""
        return current_incidents(base, self.rows().select(LOG_FIELDS), self.default_account, self.match_account)

    def still_open(self, base: DataFrame) -> DataFrame:
        """Open incidents that no batch acknowledged."""
        return still_open(base, self.rows().select(LOG_FIELDS), self.default_account, self.match_account)

    def compact(self) -> Version:
        """One sorted snapshot in place of the parts there are.

        Accepted rows are one per incident already; what a faulty writer may have
        added besides is folded to the first by batch, time and id. Batches keep
        their names, so a batch in the snapshot is still not applied twice.
        """
        base = self.store.current()
        keys = ["account_id", "incident_id"] if self.match_account else ["incident_id"]
        order = ["batch_no", "acknowledged_at", "req_id", "acknowledged_by"]
        rest = [f.name for f in LOG_ROW if f.name not in order]
        folded = (
            self._rows(base).groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first"))
            .select([F.col(f"first.{f.name}") for f in LOG_ROW])
            .repartitionByRange(*keys).sortWithinPartitions(*keys)
        )
        part = self.store.stage(folded, SNAPSHOT, max(base.batches.values(), default=0), compression="zstd")
        return self.store.publish(base, [part])

    def parts(self) -> list[Part]:
        """What a reader opens."""
        return self.store.current().of_kind(SNAPSHOT, TAIL)

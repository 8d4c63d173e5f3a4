"""Validating and creating synthetic monitors in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.functions.accounts import resolved_account
from obsq.functions.predicates import given, well_formed_tags
from obsq.schema import (
    ACCOUNT,
    CREATED_MONITOR_TYPE,
    DEFAULT_PERIOD,
    DEFAULT_STATUS,
    LOCATIONS,
    MONITOR,
    MONITOR_STATUSES,
    OK,
    PERIOD,
    PERIODS,
    REQUIRED,
    STATUS,
)

MESSAGES = {
    ACCOUNT: "an account is required",
    REQUIRED: "name, uri and locations are required",
    LOCATIONS: "every location must be a text",
    PERIOD: "the period is not one of the valid ones",
    STATUS: "the status is not one of the valid ones",
}


@dataclass(frozen=True)
class MonitorBatch:
    checked: DataFrame
    """Every request with defaults applied and its ``outcome``."""

    @property
    def created(self) -> DataFrame:
        """The accepted monitors in their stored form.

        The GUID follows from the request's id, account, name and address, each
        preceded by its length, so that every accepted request gives a monitor of
        its own and running a batch again gives the same monitors.
        """
        parts = [F.col(c).cast("string") for c in ("req_id", "account_id", "name", "uri")]
        identity = F.md5(F.concat_ws("|", *[F.concat(F.length(p), F.lit(":"), p) for p in parts]))
        return self.checked.filter(F.col("outcome") == OK).select(
            "req_id",
            F.concat(F.lit("SYNTH|"), identity).alias("guid"),
            "account_id",
            "name",
            "uri",
            F.struct(F.col("locations").alias("public")).alias("locations"),
            "period",
            "status",
            F.lit(CREATED_MONITOR_TYPE).alias("type"),
            "tags",
        )

    @property
    def rejected(self) -> DataFrame:
        """The other requests, with the first rule each one breaks."""
        message = F.lit(None).cast("string")
        for code, text in MESSAGES.items():
            message = F.when(F.col("outcome") == code, text).otherwise(message)
        return self.checked.filter(F.col("outcome") != OK).select(
            "req_id", "account_id", "name", "outcome", message.alias("message")
        )


def check_monitors(requests: DataFrame, default_account: int | None = None) -> MonitorBatch:
    """Check creation requests row by row, without a shuffle.

    A null period or status takes its default. Rules in order: a usable account;
    name, address and locations present; no null among the locations; a valid
    period; a valid status. Malformed tags are dropped, not an error.
    """
    filled = (
        requests.withColumn("account_id", resolved_account(F.col("account_id"), default_account))
        .withColumn("period", F.coalesce("period", F.lit(DEFAULT_PERIOD)))
        .withColumn("status", F.coalesce("status", F.lit(DEFAULT_STATUS)))
        .withColumn("tags", well_formed_tags(F.col("tags")))
    )
    return MonitorBatch(filled.withColumn("outcome", _outcome()))


def as_entities(created: DataFrame) -> DataFrame:
    """Created monitors as catalog rows, for the union with the other kinds.

    A rerun writes a monitor again: one of its rows counts.
    """
    monitor = F.struct(
        F.col("type").alias("monitor_type"),
        "period",
        "status",
        F.col("locations.public").alias("locations_public"),
        F.lit(None).alias("locations_private"),
        F.lit(None).alias("script_text"),
    )
    entity = F.struct(
        "name",
        "account_id",
        F.lit("SYNTH").alias("domain"),
        F.lit("MONITOR").alias("type"),
        F.lit("SYNTH_MONITOR").alias("entity_type"),
        "tags",
        monitor.cast(MONITOR).alias("monitor"),
    )
    first = F.min_by(entity, "req_id").alias("first")
    return created.groupBy("guid").agg(first).select("guid", "first.*")


def _outcome() -> Column:
    present = (
        given(F.col("name"))
        & given(F.col("uri"))
        & F.coalesce(F.size("locations") > 0, F.lit(False))
    )
    null_location = F.exists("locations", lambda place: place.isNull())
    return (
        F.when(F.col("account_id").isNull(), ACCOUNT)
        .when(~present, REQUIRED)
        .when(null_location, LOCATIONS)
        .when(~F.col("period").isin(PERIODS), PERIOD)
        .when(~F.col("status").isin(MONITOR_STATUSES), STATUS)
        .otherwise(OK)
    )

"""Acknowledging incidents through an append-only log.

The log is the state: an incident's present state is its base state folded with
the log, so appending a request twice, or running a job again, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsq.functions.accounts import resolved_account
from obsq.plans.skew import salted_left_join
from obsq.schema import (
    ACCOUNT,
    ACKNOWLEDGED,
    ALREADY_ACKED,
    INVALID_ID,
    NOT_FOUND,
    NOT_OPEN,
    OK,
    OPEN,
)

LOG_FIELDS = [
    "req_id",
    "incident_id",
    "account_id",
    "message",
    "acknowledged_by",
    "acknowledged_at",
]


def acknowledge(
    requests: DataFrame,
    incidents: DataFrame,
    default_account: int | None = None,
    match_account: bool = True,
) -> DataFrame:
    """Every request with its ``outcome``, and the incident where it succeeded.

    Rules in order: a usable account, a positive incident id, a known incident,
    an open one, and the earliest request for it by time and request id. With
    ``match_account`` an incident is only known within its own account; without,
    incident ids are taken to be unique over all accounts.

    Requests for one incident may be most of the log. They are reduced to one
    row per incident before any shuffle, and hot incidents are split when the
    result is joined back.
    """
    return _judge(requests, incidents, default_account, match_account)


def acknowledge_again(
    requests: DataFrame,
    incidents: DataFrame,
    log: DataFrame,
    default_account: int | None = None,
    match_account: bool = True,
) -> DataFrame:
    """Outcomes of a batch whose accepted requests may be in the log already.

    A request that the log took is OK again, and those that lost to it in the
    batch are ALREADY_ACKED again. A request is recognised by its ``req_id``,
    which no other batch may use. ``incidents`` are in their base state.
    """
    now = _folded(incidents, log, default_account, match_account)
    return _judge(requests, now, default_account, match_account, F.col("_logged"))


def _judge(
    requests: DataFrame,
    incidents: DataFrame,
    default_account: int | None,
    match_account: bool,
    logged: Column | None = None,
) -> DataFrame:
    """``logged`` is the request the log accepted for an incident, null if none."""
    keys = ["account_id", "incident_id"] if match_account else ["incident_id"]
    asked = requests.withColumn(
        "account_id", resolved_account(F.col("account_id"), default_account)
    ).withColumn("message", F.nullif("message", F.lit("")))
    per_incident = _first_requests(asked, keys)
    logged = F.lit(None).cast("bigint") if logged is None else logged
    base = incidents.select(*keys, "state", "title", logged.alias("_logged"))
    # the batch that was logged finds its incidents as it found them then
    state = F.when(F.col("first.req_id") == F.col("_logged"), OPEN).otherwise(F.col("state"))
    known = per_incident.join(base, keys).select(
        *keys, F.col("first.req_id").alias("_first"), state.alias("_base"), "title", "_logged"
    )
    counts = per_incident.select(*keys, "_requests")
    placed = salted_left_join(asked, known, keys, "req_id", counts, "_requests", _is_valid())
    outcome = (
        F.when(F.col("account_id").isNull(), ACCOUNT)
        .when(~F.coalesce(F.col("incident_id") > 0, F.lit(False)), INVALID_ID)
        .when(F.col("_base").isNull(), NOT_FOUND)
        .when(F.col("req_id") == F.col("_logged"), OK)
        .when(F.col("_base") != OPEN, NOT_OPEN)
        .when(F.col("req_id") != F.col("_first"), ALREADY_ACKED)
        .otherwise(OK)
    )
    succeeded = F.col("outcome") == OK
    return placed.withColumn("outcome", outcome).select(
        *LOG_FIELDS,
        "outcome",
        F.when(succeeded, F.lit(ACKNOWLEDGED)).otherwise(F.col("_base")).alias("state"),
        F.when(succeeded, F.col("title")).alias("title"),
    )


def accepted(outcomes: DataFrame) -> DataFrame:
    """The rows to append to the log."""
    return outcomes.filter(F.col("outcome") == OK).select(LOG_FIELDS)


def folded_log(
    log: DataFrame, default_account: int | None = None, match_account: bool = True
) -> DataFrame:
    """The log with one row per incident, the request that counts.

    Written to a folder of its own, it stands in for the log: incidents folded
    with it have the same states, and a later batch need not read every request
    ever made.
    """
    keys = ["account_id", "incident_id"] if match_account else ["incident_id"]
    asked = log.withColumn("account_id", resolved_account(F.col("account_id"), default_account))
    order = ["acknowledged_at", "req_id", "acknowledged_by"]
    rest = [c for c in LOG_FIELDS if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return _valid(asked).groupBy(*keys).agg(first).select(*[f"first.{c}" for c in LOG_FIELDS])


def current_incidents(
    incidents: DataFrame,
    log: DataFrame,
    default_account: int | None = None,
    match_account: bool = True,
) -> DataFrame:
    """Incidents in their present state, with who acknowledged them and when.

    ``log`` may hold every request ever made: those that never were valid, or
    came second, have no effect.
    """
    return _folded(incidents, log, default_account, match_account).drop("_logged")


def _folded(
    incidents: DataFrame, log: DataFrame, default_account: int | None, match_account: bool
) -> DataFrame:
    """`current_incidents` with ``_logged``, the request that acknowledged each."""
    keys = ["account_id", "incident_id"] if match_account else ["incident_id"]
    asked = log.withColumn("account_id", resolved_account(F.col("account_id"), default_account))
    first = _first_requests(asked, keys).select(
        *keys,
        F.col("first.req_id").alias("_req"),
        F.col("first.acknowledged_by").alias("_by"),
        F.col("first.acknowledged_at").alias("_at"),
        F.lit(True).alias("_asked"),
    )
    changed = (F.col("state") == OPEN) & F.coalesce(F.col("_asked"), F.lit(False))
    columns = incidents.columns
    return (
        incidents.join(first, keys, "left")
        .withColumn("_logged", F.when(changed, F.col("_req")))
        .withColumn("acknowledged_by", F.when(changed, F.col("_by")))
        .withColumn("acknowledged_at", F.when(changed, F.col("_at")))
        .withColumn("state", F.when(changed, F.lit(ACKNOWLEDGED)).otherwise(F.col("state")))
        .select(*columns, "acknowledged_by", "acknowledged_at", "_logged")
    )


def still_open(
    incidents: DataFrame,
    log: DataFrame,
    default_account: int | None = None,
    match_account: bool = True,
) -> DataFrame:
    """Open incidents without an acknowledgement, in the incidents' own columns."""
    keys = ["account_id", "incident_id"] if match_account else ["incident_id"]
    asked = log.withColumn("account_id", resolved_account(F.col("account_id"), default_account))
    acknowledged = _valid(asked).select(keys).distinct()
    return incidents.filter(F.col("state") == OPEN).join(acknowledged, keys, "left_anti")


def _is_valid() -> Column:
    return F.col("account_id").isNotNull() & F.coalesce(F.col("incident_id") > 0, F.lit(False))


def _valid(asked: DataFrame) -> DataFrame:
    return asked.filter(F.col("account_id").isNotNull() & (F.col("incident_id") > 0))


def _first_requests(asked: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest valid request of each incident, and how many there are."""
    return _valid(asked).groupBy(*keys).agg(
        F.min(F.struct("acknowledged_at", "req_id", "acknowledged_by")).alias("first"),
        F.count("*").alias("_requests"),
    )

"""Alert policies and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.functions.accounts import in_accounts
from obsq.functions.predicates import contains_ignoring_case
from obsq.operators.paging import BY_POLICY, NEWEST_INCIDENT, Listing
from obsq.schema import OPEN, PRIORITIES

POLICY_FIELDS = ["policy_id", "name", "incident_preference"]
INCIDENT_FIELDS = [
    "incident_id",
    "title",
    "priority",
    "state",
    "policy_name",
    "condition_name",
    "entity",
    "started_at",
    "updated_at",
    "description",
    "violation_url",
]


def list_policies(
    policies: DataFrame,
    accounts=None,
    name_filter: str | None = None,
    default_account: int | None = None,
    limit: int | None = None,
) -> Listing:
    """Policies of an account whose name contains a text, in any case."""
    scoped = in_accounts(policies, accounts, default_account)
    if name_filter:
        scoped = scoped.filter(contains_ignoring_case(F.col("name"), name_filter))
    return Listing(scoped.select(POLICY_FIELDS), BY_POLICY, limit)


def list_open_incidents(
    incidents: DataFrame,
    entities: DataFrame,
    accounts=None,
    priority: str | None = None,
    default_account: int | None = None,
    limit: int | None = None,
) -> Listing:
    """Open incidents of an account with the entity that raised each.

    A priority may be given in any case. An incident whose entity is not in the
    catalog stays in the list, with null fields for it.
    """
    scoped = in_accounts(incidents, accounts, default_account).filter(F.col("state") == OPEN)
    if priority:
        scoped = scoped.filter(F.col("priority") == _priority(priority))
    raised_by = entities.select(
        F.col("guid").alias("entity_guid"),
        F.struct("guid", "name", "type").alias("entity"),
    )

    def with_entities(rows: DataFrame, is_page: bool) -> DataFrame:
        """A page takes its few entities out of the catalog before it is joined."""
        known = raised_by
        if is_page:
            known = known.join(rows.select("entity_guid").distinct(), "entity_guid", "left_semi")
        return rows.join(known, "entity_guid", "left").select(INCIDENT_FIELDS)

    return Listing(scoped, NEWEST_INCIDENT, limit, with_entities)


def _priority(text: str) -> str:
    chosen = text.upper()
    if chosen not in PRIORITIES:
        raise RequestError(f"priority must be one of {PRIORITIES}, not {text!r}")
    return chosen

"""Searching and listing the entity catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.functions.accounts import in_accounts
from obsq.functions.predicates import all_of, has_tag, name_contains
from obsq.operators.paging import BY_GUID, Listing
from obsq.schema import LISTING_LIMIT, SEARCH_LIMIT

BASIC_FIELDS = ["guid", "name", "entity_type", "domain", "account_id", "tags"]
APPLICATION_FIELDS = ["guid", "name", "apm.language", "reporting", "alert_severity", "tags"]
MONITOR_FIELDS = [
    "guid",
    "name",
    "monitor.monitor_type",
    "monitor.period",
    "monitor.status",
    "monitor.locations_public",
    "monitor.locations_private",
    "tags",
]


def search_entities(
    entities: DataFrame,
    name: str | None = None,
    entity_type: str | None = None,
    domain: str | None = None,
    tags: Sequence[Mapping[str, str]] | None = None,
    account: int | None = None,
    limit: int | None = SEARCH_LIMIT,
) -> Listing:
    """Entities that satisfy every criterion given.

    An empty string is no criterion, a tag without key and value is ignored,
    and at least one criterion besides the account is needed. Without an account
    the search spans all of them; account 0 is one like any other here.
    """
    terms = []
    if domain:
        terms.append(F.col("domain") == F.lit(domain))
    if entity_type:
        terms.append(F.col("type") == F.lit(entity_type))
    if name:
        terms.append(name_contains(F.col("name"), name))
    for tag in tags or []:
        if isinstance(tag, Mapping) and "key" in tag and "value" in tag:
            terms.append(has_tag(F.col("tags"), tag["key"], str(tag["value"])))
    if not terms:
        raise RequestError("give at least one of name, type, domain and tags")
    if account is not None:
        terms.insert(0, F.col("account_id") == F.lit(_whole_number(account)))
    matches = entities.filter(all_of(terms)).select(BASIC_FIELDS)
    return Listing(matches, BY_GUID, limit)


def find_exact(
    entities: DataFrame,
    name: str,
    domain: str | None = None,
    entity_type: str | None = None,
    account: int | None = None,
    default_account: int | None = None,
) -> DataFrame:
    """Entities of exactly this name, in the account given or the default one."""
    terms = [F.col("name") == F.lit(name)]
    chosen = account or default_account
    if chosen:
        terms.append(F.col("account_id") == F.lit(_whole_number(chosen)))
    if domain:
        terms.append(F.col("domain") == F.lit(domain))
    if entity_type:
        terms.append(F.col("type") == F.lit(entity_type))
    return entities.filter(all_of(terms)).select(BASIC_FIELDS)


def list_applications(
    entities: DataFrame, accounts=None, default_account: int | None = None,
    limit: int | None = LISTING_LIMIT,
) -> Listing:
    """APM applications of an account."""
    return _list_kind(
        entities, "APM", "APPLICATION", APPLICATION_FIELDS, accounts, default_account, limit
    )


def list_monitors(
    entities: DataFrame, accounts=None, default_account: int | None = None,
    limit: int | None = LISTING_LIMIT,
) -> Listing:
    """Synthetic monitors of an account."""
    return _list_kind(
        entities, "SYNTH", "MONITOR", MONITOR_FIELDS, accounts, default_account, limit
    )


def _list_kind(entities, domain, entity_type, fields, accounts, default_account, limit) -> Listing:
    of_kind = entities.filter((F.col("domain") == domain) & (F.col("type") == entity_type))
    scoped = in_accounts(of_kind, accounts, default_account)
    return Listing(scoped.select(fields), BY_GUID, limit)


def _whole_number(account) -> int:
    try:
        return int(account)
    except (TypeError, ValueError):
        raise RequestError(f"account must be a whole number, not {account!r}") from None

"""The whole set of questions, over one set of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from obsq.errors import AccountRequired
from obsq.functions.accounts import in_accounts
from obsq.operators import (
    accounts,
    acknowledge,
    alerts,
    bulk_search,
    details,
    events,
    freequery,
    monitors,
    search,
)
from obsq.operators.paging import Listing
from obsq.operators.search_index import SearchIndex
from obsq.plans.settings import configure
from obsq.schema import LISTING_LIMIT, SEARCH_LIMIT
from obsq.sources.tables import read_tables


class Workspace:
    """Tables by logical name, with the account to use when a call names none."""

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        default_account: int | None = None,
        index: SearchIndex | None = None,
    ):
        """``index`` answers entity searches in place of the catalog, as of its last extension."""
        self.spark = configure(spark)
        self.tables = dict(tables)
        self.default_account = default_account
        self.index = index

    @classmethod
    def at(
        cls, spark: SparkSession, root: str, default_account: int | None = None, *names: str
    ) -> Workspace:
        """A workspace over the table folders under ``root``, all or some of them."""
        return cls(spark, read_tables(spark, root, *names), default_account)

    # --- queries over any table ---

    def query(self, text: str, variables: Mapping[str, Any] | None = None) -> DataFrame:
        """SQL over the tables as views, with bound ``:name`` variables."""
        with freequery.views(self.spark, self.tables):
            return freequery.free_query(self.spark, text, variables)

    def event_query(
        self,
        aggregates: Sequence[Column],
        event_types: Sequence[str] | None = None,
        begin: datetime | None = None,
        end: datetime | None = None,
        facets: Sequence[str | Column] = (),
        bucket: timedelta | None = None,
        compare_back: timedelta | None = None,
        fill: bool = False,
        account=None,
    ) -> events.EventQuery:
        scoped = in_accounts(self.tables["event"], account, self.default_account)
        return events.EventQuery(
            scoped, aggregates, event_types, begin, end, facets, bucket, compare_back, fill
        )

    # --- accounts ---

    def account_details(self) -> DataFrame:
        """Id and name of the default account; no row when it does not exist."""
        if not self.default_account:
            raise AccountRequired("no default account is set")
        return in_accounts(self.tables["account"], self.default_account)

    def lookup_accounts(self, requests: DataFrame) -> DataFrame:
        return accounts.lookup_accounts(requests, self.tables["account"])

    # --- entities ---

    def search_entities(
        self,
        name: str | None = None,
        entity_type: str | None = None,
        domain: str | None = None,
        tags: Sequence[Mapping[str, str]] | None = None,
        account: int | None = None,
        limit: int | None = SEARCH_LIMIT,
    ) -> Listing:
        if self.index is not None:
            return self.index.search_one(name, entity_type, domain, tags, account, limit)
        return search.search_entities(
            self.tables["entity"], name, entity_type, domain, tags, account, limit
        )

    def search_entities_bulk(self, requests: DataFrame) -> bulk_search.BulkSearch:
        if self.index is not None:
            return self.index.search(requests)
        return bulk_search.search_entities_bulk(self.tables["entity"], requests)

    def find_exact(
        self,
        name: str,
        domain: str | None = None,
        entity_type: str | None = None,
        account: int | None = None,
    ) -> DataFrame:
        return search.find_exact(
            self.tables["entity"], name, domain, entity_type, account, self.default_account
        )

    def entity_details(self, requests: DataFrame) -> DataFrame:
        return details.entity_details(requests, self.tables["entity"])

    def details_by_type(self) -> DataFrame:
        return details.details_by_type(self.tables["entity"])

    def recent_violations(self) -> DataFrame:
        return details.recent_violations(self.tables["violation"])

    def entity_conditions(self) -> DataFrame:
        return details.entity_conditions(
            self.tables["entity"], self.tables["alert_condition"], self.tables["policy"]
        )

    def entity_relationships(self) -> DataFrame:
        return details.entity_relationships(self.tables["relationship"], self.tables["entity"])

    def running_instances(self) -> DataFrame:
        return details.running_instances(self.tables["app_instance"])

    def dashboard_contents(self) -> DataFrame:
        return details.dashboard_contents(
            self.tables["dashboard_page"], self.tables["dashboard_widget"]
        )

    def nested_details(self, children_per_row: int = details.CHILDREN_PER_ROW) -> DataFrame:
        return details.nested_details(
            self.tables["entity"],
            self.tables["violation"],
            self.tables["alert_condition"],
            self.tables["policy"],
            self.tables["relationship"],
            children_per_row,
        )

    def requested_details(
        self, requests: DataFrame, children_per_row: int = details.CHILDREN_PER_ROW
    ) -> DataFrame:
        """Everything known of the GUIDs in ``requests``, children as lists."""
        return details.requested_details(
            requests,
            self.tables["entity"],
            self.tables["violation"],
            self.tables["alert_condition"],
            self.tables["policy"],
            self.tables["relationship"],
            self.tables["app_instance"],
            self.tables["dashboard_page"],
            self.tables["dashboard_widget"],
            children_per_row,
        )

    def list_applications(self, account=None, limit: int | None = LISTING_LIMIT) -> Listing:
        return search.list_applications(
            self.tables["entity"], account, self.default_account, limit
        )

    # --- monitors ---

    def list_monitors(self, account=None, limit: int | None = LISTING_LIMIT) -> Listing:
        return search.list_monitors(self.tables["entity"], account, self.default_account, limit)

    def check_monitors(self, requests: DataFrame) -> monitors.MonitorBatch:
        return monitors.check_monitors(requests, self.default_account)

    # --- alerts ---

    def list_policies(
        self, account=None, name_filter: str | None = None, limit: int | None = None
    ) -> Listing:
        return alerts.list_policies(
            self.tables["policy"], account, name_filter, self.default_account, limit
        )

    def list_open_incidents(
        self, account=None, priority: str | None = None, limit: int | None = None
    ) -> Listing:
        """Open incidents; acknowledged ones leave the list when there is a log."""
        incidents = self.tables["incident"]
        if "incident_ack" in self.tables:
            incidents = acknowledge.still_open(
                incidents, self.tables["incident_ack"], self.default_account
            )
        return alerts.list_open_incidents(
            incidents, self.tables["entity"], account, priority, self.default_account, limit
        )

    def acknowledge(self, requests: DataFrame, rerun: bool = False) -> DataFrame:
        """Outcome of each request, given the log of earlier ones if there is one.

        With ``rerun`` the requests may be a batch that was logged already, which
        then gets the outcomes it had.
        """
        incidents = self.tables["incident"]
        if rerun and "incident_ack" in self.tables:
            return acknowledge.acknowledge_again(
                requests, incidents, self.tables["incident_ack"], self.default_account
            )
        if "incident_ack" in self.tables:
            incidents = acknowledge.current_incidents(
                incidents, self.tables["incident_ack"], self.default_account
            )
        return acknowledge.acknowledge(requests, incidents, self.default_account)

"""The registered queries, each over the whole sample tables of a folder."""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = str(Path(__file__).resolve().parent)
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from obsq import ALL_ACCOUNTS, Workspace  # noqa: E402
from obsq.functions.rendering import (  # noqa: E402
    json_text,
    places_text,
    reply_text,
    tags_text,
)
from obsq.operators import acknowledge, alerts, details  # noqa: E402
from obsq.operators.ack_log import AcknowledgementLog  # noqa: E402
from obsq.operators.attributes import (  # noqa: E402
    read_attribute_events,
    variant_attribute,
    write_attribute_events,
)
from obsq.operators.accounts import resolve_accounts  # noqa: E402
from obsq.operators.events import attribute, scan_events  # noqa: E402
from obsq.operators.monitor_store import MonitorStore  # noqa: E402
from obsq.operators.replies import parse_replies  # noqa: E402
from obsq.operators.rollups import Rollup  # noqa: E402
from obsq.operators.search_index import SearchIndex  # noqa: E402
from obsq.operators.stored_details import DetailStore  # noqa: E402
from obsq.operators.typed_replies import typed_rows  # noqa: E402
from obsq.operators.tag_table import read_tags, search_by_tags, write_tags  # noqa: E402
from obsq.plans.scratch import shared_folder  # noqa: E402
from obsq.plans.settings import configure  # noqa: E402
from obsq.sources.fixtures import Fixtures  # noqa: E402
from obsq_oracle import ORACLE_SQL  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
DEFAULT_ACCOUNT = 7
HOUR = timedelta(hours=1)


@lru_cache(maxsize=4)
def _fixtures(spark: SparkSession, folder: str) -> Fixtures:
    """The tables of a folder as unread DataFrames, shared by the queries on it."""
    return Fixtures(configure(spark), folder)


def _workspace(spark: SparkSession, folder: str, *names: str) -> Workspace:
    return Workspace(spark, _fixtures(spark, folder).tables(*names), DEFAULT_ACCOUNT)


def _entities(spark: SparkSession, folder: str) -> Workspace:
    return _workspace(spark, folder, "entity")


def _events(spark: SparkSession, folder: str) -> Workspace:
    return _workspace(spark, folder, "event")


def _n():
    return F.count("*").alias("n")


def _users():
    return F.countDistinct("user_id").alias("users")


def _total_value():
    return F.round(F.sum("value"), 2).alias("total_value")


def _with_tags_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags_text", tags_text(F.col("tags"))).drop("tags")


def _flat_entity(rows: DataFrame) -> DataFrame:
    """The entity of an incident as plain columns."""
    ends = [F.col(f"entity.{f}").alias(f"entity_{f}") for f in ("guid", "name", "type")]
    return rows.select([c for c in rows.columns if c != "entity"] + ends)


def _rank_as_long(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("bigint") for n in names})


# --- catalog and accounts --------------------------------------------------


def entity_catalog(spark, folder):
    return _with_tags_text(_entities(spark, folder).tables["entity"]).drop(
        "apm", "browser", "host", "monitor"
    )


def account_lookup(spark, folder):
    requests = _fixtures(spark, folder).lookup_request
    return _workspace(spark, folder, "account").lookup_accounts(requests)


def account_lookup_json(spark, folder):
    """The same answers as JSON text, data or errors."""
    found = account_lookup(spark, folder)
    data = F.struct(F.col("account_id").alias("id"), "name")
    return found.select("req_id", reply_text(data, F.col("outcome")).alias("reply"))


def account_resolve(spark, folder):
    return resolve_accounts(_fixtures(spark, folder).account_request, DEFAULT_ACCOUNT)


# --- search ----------------------------------------------------------------


def entity_search_name(spark, folder):
    found = _entities(spark, folder).search_entities(name="red", domain="SYNTH")
    return _with_tags_text(found.rows)


def entity_search_account(spark, folder):
    found = _entities(spark, folder).search_entities(name="red", account=6, limit=None)
    return _with_tags_text(found.rows)


def entity_search_type(spark, folder):
    found = _entities(spark, folder).search_entities(entity_type="HOST", limit=None)
    return _with_tags_text(found.rows)


def entity_search_tags(spark, folder):
    wanted = [{"key": "word", "value": "red"}, {"key": "word", "value": "widget"}]
    found = _entities(spark, folder).search_entities(tags=wanted, limit=None)
    return _with_tags_text(found.rows)


def entity_search_combined(spark, folder):
    found = _entities(spark, folder).search_entities(
        name="#0_0%1",
        entity_type="APPLICATION",
        domain="APM",
        tags=[{"key": "region", "value": "ASIA"}],
        limit=None,
    )
    return _with_tags_text(found.rows)


def entity_search_total(spark, folder):
    found = _entities(spark, folder).search_entities(domain="APM")
    return found.with_total().select("guid", "name", "total_count")


def entity_search_bulk(spark, folder):
    requests = _fixtures(spark, folder).search_request
    return _entities(spark, folder).search_entities_bulk(requests).matches.drop("tags")


def _customer_searches(spark, folder):
    requests = _fixtures(spark, folder).customer_search
    return _entities(spark, folder).search_entities_bulk(requests)


def entity_search_bulk_many(spark, folder):
    return _customer_searches(spark, folder).matches.drop("tags")


def entity_search_bulk_totals(spark, folder):
    return _customer_searches(spark, folder).totals


def entity_search_bulk_errors(spark, folder):
    return _customer_searches(spark, folder).errors


def entity_search_bulk_first(spark, folder):
    requests = _fixtures(spark, folder).search_request
    return _entities(spark, folder).search_entities_bulk(requests).first(5).drop("tags")


@lru_cache(maxsize=4)
def _index(spark: SparkSession, folder: str) -> SearchIndex:
    """An index that first knew the monitors by other names, kept for the queries on a folder."""
    entities = _fixtures(spark, folder).entity
    index = SearchIndex(spark, shared_folder(spark, "search-index"))
    is_monitor = F.col("domain") == "SYNTH"
    index.build(entities.withColumn("name", F.when(is_monitor, F.concat(F.lit("former "), "name")).otherwise(F.col("name"))))
    index.extend(entities.filter(is_monitor))
    return index


def entity_index_name(spark, folder):
    found = _index(spark, folder).search_one(name="red", domain="SYNTH", limit=None)
    return _with_tags_text(found.rows)


def entity_index_bulk(spark, folder):
    return _index(spark, folder).search(_fixtures(spark, folder).customer_search).matches.drop("tags")


def entity_index_totals(spark, folder):
    return _index(spark, folder).search(_fixtures(spark, folder).customer_search).totals


def entity_tag_table(spark, folder):
    """Searches for pairs of tags through a table laid out by tag key."""
    fixtures = _fixtures(spark, folder)
    root = shared_folder(spark, "tags")
    write_tags(fixtures.entity, root)
    return search_by_tags(read_tags(spark, root), fixtures.entity, fixtures.tag_search).drop("tags")


def entity_exact_match(spark, folder):
    everywhere = Workspace(spark, _fixtures(spark, folder).tables("entity"))
    return _with_tags_text(everywhere.find_exact("red widget", "SYNTH", "MONITOR"))


def entity_page_next(spark, folder):
    page = _entities(spark, folder).search_entities(domain="SYNTH").after("SYNTH|11")
    return page.rows.select("guid", "name").withColumn("next_cursor", page.next_cursor.scalar())


def apm_application_list(spark, folder):
    return _with_tags_text(_entities(spark, folder).list_applications().rows)


def monitor_list(spark, folder):
    rows = _with_tags_text(_entities(spark, folder).list_monitors().rows)
    return rows.withColumn(
        "locations_public", F.array_join("locations_public", ";")
    ).withColumn("locations_private", places_text(F.col("locations_private")))


# --- details ---------------------------------------------------------------


def entity_detail(spark, folder):
    requests = _fixtures(spark, folder).detail_request
    return _with_tags_text(_entities(spark, folder).entity_details(requests))


def entity_detail_by_type(spark, folder):
    rows = _entities(spark, folder).details_by_type()
    return rows.select(
        "guid",
        "name",
        "domain",
        "entity_type",
        "apm.language",
        F.col("apm.application_name").alias("apm_application_name"),
        "apm.min_version",
        "apm.max_version",
        "browser.serving_agent_version",
        F.col("browser.application_name").alias("browser_application_name"),
        "browser.application_id",
        "host.summary.*",
        "host.operating_system",
        "host.system_memory_bytes",
        "host.processor_count",
        "host.kernel_version",
        "host.agent_version",
        "monitor.monitor_type",
        "monitor.period",
        "monitor.status",
        F.array_join("monitor.locations_public", ";").alias("locations_public"),
        places_text(F.col("monitor.locations_private")).alias("locations_private"),
        "monitor.script_text",
    )


def _nested_text(nested: DataFrame) -> DataFrame:
    def text(items: str, separator: str, *fields: str):
        return F.array_join(
            F.transform(items, lambda i: F.concat_ws(separator, *[i[f].cast("string") for f in fields])),
            ",",
        )

    return nested.select(
        "guid",
        "part",
        "name",
        text("recent_violations", ":", "rank", "violation_id").alias("violations"),
        text("conditions", ":", "condition_id", "policy_name").alias("conditions"),
        text("relationships", ">", "source_guid", "target_guid").alias("relationships"),
    )


def entity_detail_nested(spark, folder):
    workspace = _workspace(
        spark, folder, "entity", "violation", "alert_condition", "policy", "relationship"
    )
    # A low number of children per row, so that long lists do go on in parts.
    return _nested_text(workspace.nested_details(children_per_row=100))


def entity_detail_requested(spark, folder):
    fixtures = _fixtures(spark, folder)
    return _requested_text(details.requested_details(
        fixtures.guid_request,
        fixtures.entity,
        fixtures.violation,
        fixtures.alert_condition,
        fixtures.policy,
        fixtures.delivery,
        fixtures.app_instance,
        fixtures.dashboard_page,
        fixtures.dashboard_widget,
        children_per_row=100,
    ))


def _requested_text(found: DataFrame) -> DataFrame:
    def text(items: str, *fields: str):
        return F.array_join(
            F.transform(items, lambda i: F.concat_ws(":", *[i[f].cast("string") for f in fields])),
            ",",
        ).alias(items)

    widgets = F.transform(
        "pages",
        lambda p: F.concat_ws(
            ":",
            p["page_guid"],
            F.array_join(F.transform(p["widgets"], lambda w: w["widget_id"].cast("string")), "+"),
        ),
    )
    return found.select(
        "guid",
        "part",
        "outcome",
        "name",
        "apm.language",
        "host.operating_system",
        text("recent_violations", "rank", "violation_id"),
        text("conditions", "condition_id", "policy_name"),
        text("relationships", "source_guid", "target_guid"),
        text("running_instances", "rank", "instance_id"),
        F.array_join(widgets, ",").alias("pages"),
    )


@lru_cache(maxsize=4)
def _detail_store(spark: SparkSession, folder: str) -> DetailStore:
    """All detail tables in buckets of their entity, kept for the queries on a folder."""
    fixtures = _fixtures(spark, folder)
    names = ("entity", "violation", "alert_condition", "policy", "app_instance", "dashboard_page", "dashboard_widget")
    tables = fixtures.tables(*names) | {"relationship": fixtures.delivery}
    return DetailStore.save(spark, shared_folder(spark, "details"), tables, children_per_row=100)


def entity_stored_requested(spark, folder):
    return _requested_text(_detail_store(spark, folder).requested(_fixtures(spark, folder).guid_request))


def entity_stored_violations(spark, folder):
    return _rank_as_long(_detail_store(spark, folder).recent_violations(), "rank")


def entity_recent_violations(spark, folder):
    return _rank_as_long(_workspace(spark, folder, "violation").recent_violations(), "rank")


def entity_alert_conditions(spark, folder):
    return _workspace(spark, folder, "entity", "alert_condition", "policy").entity_conditions()


def entity_relationships(spark, folder):
    return _workspace(spark, folder, "entity", "relationship").entity_relationships()


def apm_running_instances(spark, folder):
    return _rank_as_long(_workspace(spark, folder, "app_instance").running_instances(), "rank")


def dashboard_pages_widgets(spark, folder):
    rows = _workspace(spark, folder, "dashboard_page", "dashboard_widget").dashboard_contents()
    return _rank_as_long(rows, "page_rank", "widget_rank")


def entity_json(spark, folder):
    rows = _entities(spark, folder).tables["entity"]
    text = json_text(
        "guid", "name", "account_id", "domain", "entity_type", "reporting", "alert_severity",
        "tags", "apm", "browser", "monitor",
    )
    return rows.select("guid", text.alias("json"))


# --- events ----------------------------------------------------------------


def event_count(spark, folder):
    return _events(spark, folder).event_query(
        [_n()], event_types=["click", "view"], account=ALL_ACCOUNTS
    ).rows


def event_time_range(spark, folder):
    events = _events(spark, folder).tables["event"]
    return scan_events(
        events, begin=datetime(2024, 1, 10), end=datetime(2024, 1, 20)
    ).drop("account_id")


def event_facet(spark, folder):
    measures = [
        _n(),
        _users(),
        _total_value(),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    ]
    return _events(spark, folder).event_query(
        measures, facets=["event_type"], account=ALL_ACCOUNTS
    ).rows


def event_facet_attr(spark, folder):
    return _events(spark, folder).event_query(
        [_n(), F.max("value").alias("max_value")], facets=[attribute("k")], account=ALL_ACCOUNTS
    ).rows


def event_facet_variant(spark, folder):
    """The same facet from events whose attributes were parsed when they were written."""
    root = shared_folder(spark, "events")
    write_attribute_events(_fixtures(spark, folder).event, root)
    events = Workspace(spark, {"event": read_attribute_events(spark, root)}, DEFAULT_ACCOUNT)
    return events.event_query(
        [_n(), F.max("value").alias("max_value")], facets=[variant_attribute("k")], account=ALL_ACCOUNTS
    ).rows


def event_timeseries(spark, folder):
    return _events(spark, folder).event_query(
        [_n(), _total_value()], bucket=HOUR, account=ALL_ACCOUNTS
    ).rows


def event_timeseries_facet(spark, folder):
    return _events(spark, folder).event_query(
        [_n()], facets=["event_type"], bucket=timedelta(days=7), account=ALL_ACCOUNTS
    ).rows


def event_timeseries_filled(spark, folder):
    return _events(spark, folder).event_query(
        [_n()],
        begin=datetime(2024, 1, 1),
        end=datetime(2024, 1, 31),
        facets=["event_type"],
        bucket=HOUR,
        fill=True,
        account=ALL_ACCOUNTS,
    ).rows


def event_total_result(spark, folder):
    return _events(spark, folder).event_query(
        [_n(), _users()],
        begin=datetime(2024, 1, 10),
        end=datetime(2024, 1, 20),
        facets=["event_type"],
        account=ALL_ACCOUNTS,
    ).with_total


def event_metadata(spark, folder):
    described = _events(spark, folder).event_query(
        [_n()],
        begin=datetime(2024, 1, 15),
        end=datetime(2024, 1, 16),
        facets=["event_type"],
        compare_back=timedelta(days=1),
        account=ALL_ACCOUNTS,
    ).metadata
    return described.withColumn("event_types", F.array_join("event_types", ",")).withColumn(
        "facets", F.array_join("facets", ",")
    )


def event_compare(spark, folder):
    return _events(spark, folder).event_query(
        [_n(), _users()],
        begin=datetime(2024, 1, 15),
        end=datetime(2024, 1, 16),
        facets=["event_type"],
        compare_back=timedelta(days=1),
        account=ALL_ACCOUNTS,
    ).rows


def event_timeseries_compare(spark, folder):
    """Two weeks beside the two weeks that start seven days earlier."""
    return _events(spark, folder).event_query(
        [_n()],
        begin=datetime(2024, 1, 8),
        end=datetime(2024, 1, 22),
        facets=["event_type"],
        bucket=HOUR,
        compare_back=timedelta(days=7),
        account=ALL_ACCOUNTS,
    ).rows


def event_account(spark, folder):
    return _events(spark, folder).event_query(
        [_n(), _users()], facets=["event_type"], account=5
    ).rows


def event_default_account(spark, folder):
    return _events(spark, folder).event_query([_n(), _users()], facets=["event_type"]).rows


def event_filled_measures(spark, folder):
    """Empty buckets count 0 and have no largest value and no text."""
    return _events(spark, folder).event_query(
        [_n(), F.max("value").alias("max_value"), F.min("props").alias("first_props")],
        begin=datetime(2024, 1, 10),
        end=datetime(2024, 1, 12),
        facets=["event_type"],
        bucket=HOUR,
        fill=True,
    ).rows


def event_bucket_total(spark, folder):
    return _events(spark, folder).event_query(
        [_n(), _users()], facets=["event_type"], bucket=HOUR, account=ALL_ACCOUNTS
    ).with_total


def event_compare_total(spark, folder):
    return _events(spark, folder).event_query(
        [_n()],
        begin=datetime(2024, 1, 15),
        end=datetime(2024, 1, 16),
        facets=["event_type"],
        compare_back=timedelta(days=1),
        account=ALL_ACCOUNTS,
    ).with_total


@lru_cache(maxsize=4)
def _rollup(spark: SparkSession, folder: str) -> Rollup:
    """Hourly rollups in two batches of all events, kept for the queries on a folder."""
    events = _fixtures(spark, folder).event
    rollup = Rollup(spark, shared_folder(spark, "rollup"), HOUR, [], ["value"], ["user_id"])
    for name, wanted in (("even", 0), ("odd", 1)):
        rollup.add(events.filter(F.col("event_id") % 2 == wanted), name)
    return rollup


def event_rollup_daily(spark, folder):
    rollup = _rollup(spark, folder)
    measures = [
        rollup.count().alias("n"),
        F.round(rollup.total("value"), 2).alias("total_value"),
        rollup.most("value").alias("most"),
    ]
    return rollup.query(measures, facets=["event_type"], bucket=timedelta(days=1)).with_total


def event_rollup_compare(spark, folder):
    rollup = _rollup(spark, folder)
    return rollup.query(
        [F.nullif(rollup.count(), F.lit(0)).alias("n")],
        begin=datetime(2024, 1, 15),
        end=datetime(2024, 1, 16),
        facets=["event_type"],
        compare_back=timedelta(days=1),
    ).with_total


# --- alerts ----------------------------------------------------------------


def policy_list(spark, folder):
    return _workspace(spark, folder, "policy").list_policies(ALL_ACCOUNTS, "auto").rows


def open_incident_list(spark, folder):
    found = _workspace(spark, folder, "incident", "entity").list_open_incidents(ALL_ACCOUNTS)
    return _flat_entity(found.rows)


def open_incident_priority(spark, folder):
    found = _workspace(spark, folder, "incident", "entity").list_open_incidents(
        priority="critical"
    )
    return _flat_entity(found.rows)


def open_incident_page_next(spark, folder):
    """The page behind the last incident of some earlier page."""
    listed = _workspace(spark, folder, "incident", "entity").list_open_incidents(
        ALL_ACCOUNTS, limit=100
    )
    page = listed.after(datetime(1998, 1, 1), 5000)
    cursor = page.next_cursor.select(
        F.concat(F.date_format("started_at", "yyyy-MM-dd"), F.lit(" "), F.col("incident_id"))
    )
    return page.rows.select("incident_id", "started_at", "priority").withColumn(
        "next_cursor", cursor.scalar()
    )


def incident_current_state(spark, folder):
    fixtures = _fixtures(spark, folder)
    return acknowledge.current_incidents(
        fixtures.incident, fixtures.incident_ack, DEFAULT_ACCOUNT, match_account=False
    ).select("incident_id", "account_id", "state", "acknowledged_by", "acknowledged_at")


def open_incident_after_ack(spark, folder):
    fixtures = _fixtures(spark, folder)
    # The sample log names no account; its incident ids hold for all of them.
    remaining = acknowledge.still_open(
        fixtures.incident, fixtures.incident_ack, DEFAULT_ACCOUNT, match_account=False
    )
    return _flat_entity(
        alerts.list_open_incidents(remaining, fixtures.entity, ALL_ACCOUNTS).rows
    )


def incident_ack_outcome(spark, folder):
    fixtures = _fixtures(spark, folder)
    return acknowledge.acknowledge(
        fixtures.incident_ack, fixtures.incident, DEFAULT_ACCOUNT, match_account=False
    )


def account_ack_outcome(spark, folder):
    fixtures = _fixtures(spark, folder)
    return acknowledge.acknowledge(fixtures.account_ack, fixtures.incident, DEFAULT_ACCOUNT)


def account_ack_rerun(spark, folder):
    """The outcomes of a batch judged again after its accepted rows were logged."""
    fixtures = _fixtures(spark, folder)
    batch, incidents = fixtures.account_ack, fixtures.incident
    log = acknowledge.accepted(acknowledge.acknowledge(batch, incidents, DEFAULT_ACCOUNT))
    return acknowledge.acknowledge_again(batch, incidents, log, DEFAULT_ACCOUNT)


def account_ack_state(spark, folder):
    fixtures = _fixtures(spark, folder)
    return acknowledge.current_incidents(
        fixtures.incident, fixtures.account_ack, DEFAULT_ACCOUNT
    ).select("incident_id", "account_id", "state", "acknowledged_by", "acknowledged_at")


def account_ack_still_open(spark, folder):
    fixtures = _fixtures(spark, folder)
    remaining = acknowledge.still_open(fixtures.incident, fixtures.account_ack, DEFAULT_ACCOUNT)
    return _flat_entity(
        alerts.list_open_incidents(remaining, fixtures.entity, ALL_ACCOUNTS).rows
    )


def _ack_batches(spark, folder):
    """Even and odd requests as two batches that use the same ids, and an empty log."""
    requests = _fixtures(spark, folder).account_ack
    own_id = F.expr("req_id div 2")
    even, odd = (requests.filter(F.col("req_id") % 2 == i).withColumn("req_id", own_id) for i in (0, 1))
    return even, odd, AcknowledgementLog(spark, shared_folder(spark, "ack-log"), DEFAULT_ACCOUNT)


def ack_log_outcome(spark, folder):
    """The outcomes of two batches that are applied again after the log was compacted."""
    incidents = _fixtures(spark, folder).incident
    even, odd, log = _ack_batches(spark, folder)
    log.apply(even, incidents, "even")
    log.apply(odd, incidents, "odd")
    log.compact()
    again = [log.apply(b, incidents, name).withColumn("batch", F.lit(name)) for b, name in ((even, "even"), (odd, "odd"))]
    return again[0].unionByName(again[1])


def ack_log_state(spark, folder):
    """Incidents read back from a snapshot of one batch, a second batch and a repeat of the first."""
    incidents = _fixtures(spark, folder).incident
    even, odd, log = _ack_batches(spark, folder)
    log.apply(even, incidents, "even")
    log.compact()
    log.apply(odd, incidents, "odd")
    log.apply(even, incidents, "even")
    return log.incidents(incidents).select(
        "incident_id", "account_id", "state", "acknowledged_by", "acknowledged_at"
    )


# --- monitors --------------------------------------------------------------


def monitor_create(spark, folder):
    requests = _fixtures(spark, folder).monitor_request
    created = _workspace(spark, folder, "account").check_monitors(requests).created
    return _with_tags_text(created).withColumn(
        "locations_public", F.array_join("locations.public", ";")
    ).drop("locations")


def monitor_create_errors(spark, folder):
    requests = _fixtures(spark, folder).monitor_request
    return _workspace(spark, folder, "account").check_monitors(requests).rejected


def monitor_stored(spark, folder):
    """Monitors read back after two batches that share most requests, one of them created twice."""
    requests = _fixtures(spark, folder).monitor_request
    store = MonitorStore(spark, shared_folder(spark, "monitors"))
    part = requests.filter("req_id % 3 <> 0")
    store.create(part, "part")
    store.create(requests, "all")
    store.create(part, "part")
    return _with_tags_text(store.monitors()).withColumn(
        "locations_public", F.array_join("locations.public", ";")
    ).drop("locations")


# --- replies and free queries ----------------------------------------------


def response_parse(spark, folder):
    return parse_replies(_fixtures(spark, folder).response, rows_path=["rows"]).drop("detail")


def response_typed(spark, folder):
    """Data rows of the archive with the columns that their content has."""
    return typed_rows(parse_replies(_fixtures(spark, folder).response, rows_path=["rows"]))


def sql_param_query(spark, folder):
    return _workspace(spark, folder, "entity", "incident").query(
        """
        SELECT e.domain, i.priority, count(*) AS n
        FROM incident i JOIN entity e ON e.guid = i.entity_guid
        WHERE i.state = :state AND i.account_id = :account AND i.started_at >= CAST(:since AS TIMESTAMP_NTZ)
        GROUP BY e.domain, i.priority
        """,
        {"state": "OPEN", "account": DEFAULT_ACCOUNT, "since": "1996-01-01"},
    )


_QUERIES = [
    entity_catalog, account_lookup, account_lookup_json, account_resolve, response_parse, entity_json,
    sql_param_query, entity_search_name, entity_search_account, entity_search_type,
    entity_search_tags, entity_search_combined, entity_search_total, entity_search_bulk,
    entity_exact_match, entity_page_next, entity_detail, entity_detail_by_type,
    entity_detail_nested, entity_recent_violations, entity_alert_conditions,
    entity_relationships, apm_application_list, apm_running_instances,
    dashboard_pages_widgets, monitor_list, monitor_create, monitor_create_errors, policy_list,
    open_incident_list, open_incident_priority, open_incident_page_next,
    open_incident_after_ack, incident_current_state, incident_ack_outcome,
    event_count, event_time_range, event_facet, event_facet_attr, event_timeseries,
    event_timeseries_facet, event_timeseries_filled, event_total_result, event_metadata,
    event_compare, event_timeseries_compare, event_account, event_default_account,
    event_filled_measures, event_bucket_total, event_compare_total,
    account_ack_outcome, account_ack_state, account_ack_still_open, account_ack_rerun,
    entity_detail_requested, entity_search_bulk_many, entity_search_bulk_totals,
    entity_search_bulk_errors, entity_search_bulk_first,
    entity_index_name, entity_index_bulk, entity_index_totals, ack_log_outcome, ack_log_state, monitor_stored,
    entity_stored_requested, entity_stored_violations, entity_tag_table, event_rollup_daily, event_rollup_compare,
    event_facet_variant, response_typed,
]


# The text operators and their pipeline can be taken out as a whole.
try:
    import corpus_pipeline
    from obsq.llm.oracle import ORACLE_SQL as _TEXT_SQL
    from obsq.llm.queries import QUERIES as _TEXT_QUERIES
except ImportError:
    _TEXT_QUERIES, _TEXT_SQL = {}, {}
else:
    _TEXT_QUERIES = _TEXT_QUERIES | {"pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        _TEXT_SQL = _TEXT_SQL | {"pipeline": corpus_pipeline.ORACLE_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES} | _TEXT_QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | _TEXT_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Open incidents with the entity behind each."""
    return open_incident_list(spark, SMOKE_DIR)

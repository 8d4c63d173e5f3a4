"""Logical tables and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values ----------------------------------------------------------
# Vocabularies and limits that results depend on.

PRIORITIES = ["CRITICAL", "WARNING", "INFO"]
PERIODS = [
    "EVERY_MINUTE",
    "EVERY_5_MINUTES",
    "EVERY_10_MINUTES",
    "EVERY_15_MINUTES",
    "EVERY_30_MINUTES",
    "EVERY_HOUR",
    "EVERY_6_HOURS",
    "EVERY_12_HOURS",
    "EVERY_DAY",
]
MONITOR_STATUSES = ["ENABLED", "DISABLED", "MUTED"]
INCIDENT_PREFERENCES = ["PER_POLICY", "PER_CONDITION", "PER_CONDITION_AND_TARGET"]

DEFAULT_PERIOD = "EVERY_15_MINUTES"
DEFAULT_STATUS = "ENABLED"
CREATED_MONITOR_TYPE = "SIMPLE_BROWSER"

OPEN = "OPEN"
ACKNOWLEDGED = "ACKNOWLEDGED"
RUNNING = "RUNNING"

SEARCH_LIMIT = 50
LISTING_LIMIT = 250
RECENT_VIOLATIONS = 5
RUNNING_INSTANCES = 5
DASHBOARD_PAGES = 10
PAGE_WIDGETS = 10
EXCERPT_CHARS = 500

# --- outcome codes of request tables ---------------------------------------

OK = "OK"
ACCOUNT = "ACCOUNT"
NOT_FOUND = "NOT_FOUND"
# monitor requests
REQUIRED = "REQUIRED"
LOCATIONS = "LOCATIONS"
PERIOD = "PERIOD"
STATUS = "STATUS"
# acknowledgements
INVALID_ID = "INVALID_ID"
NOT_OPEN = "NOT_OPEN"
ALREADY_ACKED = "ALREADY_ACKED"

# --- tables ----------------------------------------------------------------

TAGS = T.ArrayType(T.StructType().add("key", "string").add("value", "string"))

APM = (
    T.StructType()
    .add("language", "string")
    .add("application_name", "string")
    .add("min_version", "string")
    .add("max_version", "string")
)
BROWSER = (
    T.StructType()
    .add("serving_agent_version", "string")
    .add("application_name", "string")
    .add("application_id", "long")
)
HOST = (
    T.StructType()
    .add(
        "summary",
        T.StructType()
        .add("cpu_utilization_percent", "double")
        .add("disk_used_percent", "double")
        .add("memory_used_percent", "double")
        .add("network_receive_rate", "double")
        .add("network_transmit_rate", "double"),
    )
    .add("operating_system", "string")
    .add("system_memory_bytes", "long")
    .add("processor_count", "integer")
    .add("kernel_version", "string")
    .add("agent_version", "string")
)
MONITOR = (
    T.StructType()
    .add("monitor_type", "string")
    .add("period", "string")
    .add("status", "string")
    .add("locations_public", T.ArrayType(T.StringType()))
    .add(
        "locations_private",
        T.ArrayType(T.StructType().add("guid", "string").add("name", "string")),
    )
    .add("script_text", "string")
)

# The type-specific columns of an entity: (domain, type) -> column name. A
# dashboard's pages and widgets are child tables, a mobile application has no
# fields of its own.
ENTITY_KINDS = {
    ("APM", "APPLICATION"): "apm",
    ("BROWSER", "APPLICATION"): "browser",
    ("INFRA", "HOST"): "host",
    ("SYNTH", "MONITOR"): "monitor",
}

ENTITY = (
    T.StructType()
    .add("guid", "string")
    .add("name", "string")
    .add("account_id", "integer")
    .add("domain", "string")
    .add("type", "string")
    .add("entity_type", "string")
    .add("reporting", "boolean")
    .add("permalink", "string")
    .add("alert_severity", "string")
    .add("tags", TAGS)
    .add("apm", APM)
    .add("browser", BROWSER)
    .add("host", HOST)
    .add("monitor", MONITOR)
)

ACCOUNT_TABLE = T.StructType().add("account_id", "integer").add("name", "string")

VIOLATION = (
    T.StructType()
    .add("violation_id", "long")
    .add("guid", "string")
    .add("label", "string")
    .add("level", "string")
    .add("opened_at", "timestamp_ntz")
    .add("closed_at", "timestamp_ntz")
)

ALERT_CONDITION = (
    T.StructType()
    .add("condition_id", "long")
    .add("name", "string")
    .add("enabled", "boolean")
    .add("policy_id", "long")
    .add("guid", "string")
)

POLICY = (
    T.StructType()
    .add("policy_id", "long")
    .add("name", "string")
    .add("incident_preference", "string")
    .add("account_id", "integer")
)

RELATIONSHIP = (
    T.StructType()
    .add("source_guid", "string")
    .add("target_guid", "string")
    .add("type", "string")
)

APP_INSTANCE = (
    T.StructType()
    .add("instance_id", "long")
    .add("guid", "string")
    .add("host", "string")
    .add("port", "integer")
    .add("agent_version", "string")
    .add("state", "string")
)

DASHBOARD_PAGE = (
    T.StructType()
    .add("dashboard_guid", "string")
    .add("page_guid", "string")
    .add("name", "string")
    .add("position", "long")
)

DASHBOARD_WIDGET = (
    T.StructType()
    .add("page_guid", "string")
    .add("widget_id", "long")
    .add("title", "string")
    .add("visualization", "string")
)

INCIDENT = (
    T.StructType()
    .add("incident_id", "long")
    .add("title", "string")
    .add("priority", "string")
    .add("state", "string")
    .add("policy_name", "string")
    .add("condition_name", "string")
    .add("entity_guid", "string")
    .add("started_at", "timestamp_ntz")
    .add("updated_at", "timestamp_ntz")
    .add("description", "string")
    .add("violation_url", "string")
    .add("account_id", "integer")
)

INCIDENT_ACK = (
    T.StructType()
    .add("req_id", "long")
    .add("incident_id", "long")
    .add("account_id", "integer")
    .add("message", "string")
    .add("acknowledged_by", "string")
    .add("acknowledged_at", "timestamp_ntz")
)

MONITOR_REQUEST = (
    T.StructType()
    .add("req_id", "long")
    .add("name", "string")
    .add("uri", "string")
    .add("locations", T.ArrayType(T.StringType()))
    .add("period", "string")
    .add("status", "string")
    .add("account_id", "integer")
    .add("tags", TAGS)
)

SEARCH_REQUEST = (
    T.StructType()
    .add("req_id", "long")
    .add("account_id", "integer")
    .add("name", "string")
    .add("domain", "string")
    .add("type", "string")
    .add("tags", TAGS)
)

EVENT = (
    T.StructType()
    .add("event_id", "long")
    .add("ts", "timestamp_ntz")
    .add("user_id", "long")
    .add("event_type", "string")
    .add("value", "double")
    .add("props", "string")
    .add("account_id", "integer")
)

TABLES = {
    "account": ACCOUNT_TABLE,
    "entity": ENTITY,
    "violation": VIOLATION,
    "alert_condition": ALERT_CONDITION,
    "policy": POLICY,
    "relationship": RELATIONSHIP,
    "app_instance": APP_INSTANCE,
    "dashboard_page": DASHBOARD_PAGE,
    "dashboard_widget": DASHBOARD_WIDGET,
    "incident": INCIDENT,
    "incident_ack": INCIDENT_ACK,
    "monitor_request": MONITOR_REQUEST,
    "event": EVENT,
}

"""The logical tables derived from the sample tables, see FIXTURES.md."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsq.schema import INCIDENT_PREFERENCES, MONITOR_STATUSES, PERIODS
from obsq.sources.catalog import union_kinds

# --- fixed values ----------------------------------------------------------
# The columns of the sample tables, and the market segments they use.

SAMPLE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "pages": "page_id bigint, url string, html string",
}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

TABLE_NAMES = [
    "account",
    "entity",
    "violation",
    "alert_condition",
    "policy",
    "relationship",
    "app_instance",
    "dashboard_page",
    "dashboard_widget",
    "incident",
    "incident_ack",
    "monitor_request",
    "event",
]


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _common(kind: str, key: str, name: str, account: str, domain: str, entity_type: str):
    return [
        f"concat('{kind}|', {key}) AS guid",
        f"{name} AS name",
        f"CAST({account} AS int) AS account_id",
        f"'{domain}' AS domain",
        f"'{entity_type}' AS type",
        f"'{domain}_{entity_type}' AS entity_type",
        f"concat('https://example.test/{kind}|', {key}) AS permalink",
    ]


def _severity(balance: str) -> str:
    return f"CASE WHEN {balance} < 0 THEN 'CRITICAL' WHEN {balance} < 1000 THEN 'WARNING' END"


NO_TAGS = "CAST(array() AS array<struct<key: string, value: string>>) AS tags"
LEVEL = (
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CRITICAL'"
    " WHEN o_orderpriority = '3-MEDIUM' THEN 'WARNING' ELSE 'INFO' END"
)


class Fixtures:
    """Logical tables over one folder of sample tables. Nothing is read early."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def sample(self, name: str) -> DataFrame:
        return self.spark.read.schema(SAMPLE_COLUMNS[name]).parquet(
            f"{self.folder}/{name}.parquet"
        )

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in (names or TABLE_NAMES)}

    @cached_property
    def account(self) -> DataFrame:
        return self.sample("nation").selectExpr("n_nationkey AS account_id", "n_name AS name")

    # --- entities ---

    @cached_property
    def applications(self) -> DataFrame:
        customers = self.sample("customer").withColumnRenamed("c_nationkey", "n_nationkey")
        nations = self.sample("nation").withColumnRenamed("n_regionkey", "r_regionkey")
        return (
            customers.join(nations, "n_nationkey", "left")
            .join(self.sample("region"), "r_regionkey", "left")
            .selectExpr(
                *_common("APM", "c_custkey", "c_name", "n_nationkey", "APM", "APPLICATION"),
                "c_acctbal >= 0 AS reporting",
                f"{_severity('c_acctbal')} AS alert_severity",
                "array(struct('segment' AS key, c_mktsegment AS value),"
                " struct('region' AS key, r_name AS value)) AS tags",
                "struct(lower(c_mktsegment) AS language, c_name AS application_name,"
                " concat('1.', c_custkey % 5) AS min_version,"
                " concat('2.', c_custkey % 7) AS max_version) AS apm",
            )
        )

    @cached_property
    def hosts(self) -> DataFrame:
        return self.sample("supplier").selectExpr(
            *_common("INFRA", "s_suppkey", "s_name", "s_nationkey", "INFRA", "HOST"),
            "s_acctbal >= 0 AS reporting",
            f"{_severity('s_acctbal')} AS alert_severity",
            NO_TAGS,
            "struct("
            " struct(s_acctbal / 100D AS cpu_utilization_percent,"
            "  CAST(s_suppkey % 100 AS double) AS disk_used_percent,"
            "  CAST(s_suppkey % 90 AS double) AS memory_used_percent,"
            "  s_acctbal * 2D AS network_receive_rate,"
            "  s_acctbal * 0.5D AS network_transmit_rate) AS summary,"
            " if(s_suppkey % 2 = 0, 'linux', 'windows') AS operating_system,"
            " (s_suppkey % 8 + 1) * 1073741824 AS system_memory_bytes,"
            " CAST(s_suppkey % 16 + 1 AS int) AS processor_count,"
            " concat('5.', s_suppkey % 20) AS kernel_version,"
            " concat('1.', s_suppkey % 50) AS agent_version) AS host",
        )

    @cached_property
    def monitors(self) -> DataFrame:
        status = f"get({_array(MONITOR_STATUSES)}, p_size % 3)"
        return self.sample("part").selectExpr(
            *_common("SYNTH", "p_partkey", "p_name", "p_partkey % 25", "SYNTH", "MONITOR"),
            f"{status} = 'ENABLED' AS reporting",
            "array(struct('brand' AS key, p_brand AS value),"
            " struct('word' AS key, split_part(p_name, ' ', 1) AS value),"
            " struct('word' AS key, split_part(p_name, ' ', 2) AS value)) AS tags",
            "struct(p_type AS monitor_type,"
            f" get({_array(PERIODS)}, CAST(p_partkey % 9 AS int)) AS period,"
            f" {status} AS status,"
            " array(concat('LOC_', p_partkey % 3), concat('LOC_', p_partkey % 5))"
            "  AS locations_public,"
            " array(struct(concat('LOCP|', p_partkey % 4) AS guid,"
            "  concat('private-', p_partkey % 4) AS name)) AS locations_private,"
            " if(p_partkey % 4 = 0, concat('// ', p_name), NULL) AS script_text) AS monitor",
        )

    @cached_property
    def browser_applications(self) -> DataFrame:
        return self.sample("pages").selectExpr(
            *_common("BROWSER", "page_id", "url", "page_id % 25", "BROWSER", "APPLICATION"),
            "true AS reporting",
            NO_TAGS,
            "struct(concat('1.', page_id % 30) AS serving_agent_version,"
            " url AS application_name, page_id AS application_id) AS browser",
        )

    @cached_property
    def dashboards(self) -> DataFrame:
        return self.sample("nation").selectExpr(
            *_common("DASH", "n_nationkey", "n_name", "n_nationkey", "VIZ", "DASHBOARD"), NO_TAGS
        )

    @cached_property
    def entity(self) -> DataFrame:
        return union_kinds(
            [
                self.applications,
                self.hosts,
                self.monitors,
                self.browser_applications,
                self.dashboards,
            ]
        )

    # --- child tables ---

    @cached_property
    def violation(self) -> DataFrame:
        return self.sample("orders").selectExpr(
            "o_orderkey AS violation_id",
            "concat('APM|', o_custkey) AS guid",
            "concat('Violation ', o_orderkey) AS label",
            f"{LEVEL} AS level",
            "o_orderdate AS opened_at",
            "if(o_orderstatus = 'F', o_orderdate + INTERVAL 1 DAY, NULL) AS closed_at",
        )

    @cached_property
    def policy(self) -> DataFrame:
        """A policy per nation and segment that customers use."""
        used = self.sample("customer").selectExpr("c_nationkey AS n_nationkey", "c_mktsegment")
        number = f"n_nationkey * 10L + array_position({_array(SEGMENTS)}, c_mktsegment) - 1"
        return (
            used.distinct()
            .join(self.sample("nation"), "n_nationkey")
            .selectExpr(
                f"{number} AS policy_id",
                "concat(c_mktsegment, ' ', n_name) AS name",
                f"get({_array(INCIDENT_PREFERENCES)}, CAST(({number}) % 3 AS int))"
                " AS incident_preference",
                "n_nationkey AS account_id",
            )
        )

    @cached_property
    def alert_condition(self) -> DataFrame:
        return self.sample("part").selectExpr(
            "p_partkey AS condition_id",
            "p_name AS name",
            "p_size > 25 AS enabled",
            "(p_partkey % 25) * 10 + p_partkey % 5 AS policy_id",
            "concat('INFRA|', p_partkey % 10) AS guid",
        )

    @cached_property
    def relationship(self) -> DataFrame:
        return (
            self.sample("lineitem")
            .select("l_suppkey", "l_partkey")
            .distinct()
            .selectExpr(
                "concat('INFRA|', l_suppkey) AS source_guid",
                "concat('SYNTH|', l_partkey) AS target_guid",
                "'SERVES' AS type",
            )
        )

    @cached_property
    def delivery(self) -> DataFrame:
        """Edges as above, one per line item, so that some are equal."""
        return self.sample("lineitem").selectExpr(
            "concat('INFRA|', l_suppkey) AS source_guid",
            "concat('SYNTH|', l_partkey) AS target_guid",
            "'SERVES' AS type",
        )

    @cached_property
    def app_instance(self) -> DataFrame:
        return self.sample("events").selectExpr(
            "event_id AS instance_id",
            "concat('APM|', user_id) AS guid",
            "concat('host-', event_id % 50) AS host",
            "CAST(event_id % 1000 + 8000 AS int) AS port",
            "concat('1.', event_id % 5) AS agent_version",
            "if(event_type = 'error', 'STOPPED', 'RUNNING') AS state",
        )

    @cached_property
    def dashboard_page(self) -> DataFrame:
        return self.sample("customer").selectExpr(
            "concat('DASH|', c_nationkey) AS dashboard_guid",
            "concat('PAGE|', c_custkey) AS page_guid",
            "c_name AS name",
            "c_custkey AS position",
        )

    @cached_property
    def dashboard_widget(self) -> DataFrame:
        return self.sample("orders").selectExpr(
            "concat('PAGE|', o_custkey) AS page_guid",
            "o_orderkey AS widget_id",
            "concat('Widget ', o_orderkey) AS title",
            "o_orderpriority AS visualization",
        )

    # --- incidents ---

    @cached_property
    def incident(self) -> DataFrame:
        customers = (
            self.sample("customer")
            .withColumnRenamed("c_nationkey", "n_nationkey")
            .join(self.sample("nation"), "n_nationkey", "left")
            .withColumnRenamed("c_custkey", "o_custkey")
        )
        return (
            self.sample("orders")
            .join(customers, "o_custkey", "left")
            .selectExpr(
                "o_orderkey AS incident_id",
                f"concat({LEVEL}, ' on ', c_name) AS title",
                f"{LEVEL} AS priority",
                "CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'ACKNOWLEDGED'"
                " ELSE 'CLOSED' END AS state",
                "concat(c_mktsegment, ' ', n_name) AS policy_name",
                "concat('Condition ', o_orderkey % 100) AS condition_name",
                "concat('APM|', o_custkey) AS entity_guid",
                "o_orderdate AS started_at",
                "o_orderdate + INTERVAL 1 DAY AS updated_at",
                "concat('Incident ', o_orderkey) AS description",
                "concat('https://example.test/violation/', o_orderkey) AS violation_url",
                "n_nationkey AS account_id",
            )
        )

    @cached_property
    def incident_ack(self) -> DataFrame:
        """A request per event, two for most incidents asked for, over the range of all."""
        return self.sample("events").selectExpr(
            "event_id AS req_id",
            "CASE event_id % 10 WHEN 9 THEN event_id + 1000000000 WHEN 8 THEN -event_id"
            " ELSE (event_id div 4) * 6 + event_id % 2 END AS incident_id",
            "CAST(NULL AS int) AS account_id",
            "if(event_id % 3 = 0, concat('seen by ', user_id), NULL) AS message",
            "CAST(user_id AS string) AS acknowledged_by",
            "ts AS acknowledged_at",
        )

    @cached_property
    def account_ack(self) -> DataFrame:
        """Two requests per incident: most name its account, some another one or none."""
        owners = self.incident.select("incident_id", F.col("account_id").alias("owner"))
        return (
            self.sample("events")
            .withColumn("incident_id", F.expr("event_id div 2"))
            .join(owners, "incident_id", "left")
            .selectExpr(
                "event_id AS req_id",
                "if(event_id % 10 = 8, -event_id, incident_id) AS incident_id",
                "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN owner + 1 ELSE owner END AS account_id",
                "if(event_id % 3 = 0, concat('seen by ', user_id), NULL) AS message",
                "CAST(user_id AS string) AS acknowledged_by",
                "ts AS acknowledged_at",
            )
        )

    # --- requests ---

    @cached_property
    def monitor_request(self) -> DataFrame:
        return self.sample("pages").selectExpr(
            "page_id AS req_id",
            "if(page_id % 11 = 0, '', concat('mon-', page_id)) AS name",
            "url AS uri",
            "array(concat('LOC_', page_id % 3),"
            " if(page_id % 13 = 0, NULL, concat('LOC_', page_id % 5))) AS locations",
            f"coalesce(get({_array(PERIODS)}, CAST(page_id % 10 AS int)), 'EVERY_WEEK')"
            " AS period",
            "CASE page_id % 7 WHEN 0 THEN 'PAUSED' WHEN 1 THEN 'MUTED' WHEN 2 THEN 'DISABLED'"
            " ELSE 'ENABLED' END AS status",
            "CAST(page_id % 24 + 1 AS int) AS account_id",
            "array(struct('team' AS key,"
            " if(page_id % 4 = 0, NULL, concat('team-', page_id % 6)) AS value)) AS tags",
        )

    @cached_property
    def account_request(self) -> DataFrame:
        """One request per customer; every fifth names no account."""
        return self.sample("customer").selectExpr(
            "c_custkey AS req_id", "if(c_custkey % 5 = 4, NULL, c_nationkey) AS account_id"
        )

    @cached_property
    def lookup_request(self) -> DataFrame:
        """As above; some name no account, some one that does not exist."""
        return self.sample("customer").selectExpr(
            "c_custkey AS req_id",
            "CASE c_custkey % 10 WHEN 9 THEN c_nationkey + 100 WHEN 4 THEN NULL"
            " ELSE c_nationkey END AS account_id",
        )

    @cached_property
    def detail_request(self) -> DataFrame:
        """The application behind each event; error events name an unknown GUID."""
        return self.sample("events").selectExpr(
            "event_id AS req_id",
            "concat(if(event_type = 'error', 'MOBILE|', 'APM|'), user_id) AS guid",
        )

    @cached_property
    def guid_request(self) -> DataFrame:
        """The customers of all orders, all suppliers and nations, and GUIDs of no entity."""
        asked = [
            ("orders", "concat('APM|', o_custkey)"),
            ("supplier", "concat('INFRA|', s_suppkey)"),
            ("nation", "concat('DASH|', n_nationkey)"),
            ("customer", "concat('MOBILE|', c_custkey)"),
        ]
        first, *others = [self.sample(t).selectExpr(f"{guid} AS guid") for t, guid in asked]
        for more in others:
            first = first.unionByName(more)
        return first

    @cached_property
    def search_request(self) -> DataFrame:
        """One search per nation, of four kinds; the last kind has no criterion."""
        return self.sample("nation").selectExpr(
            "CAST(n_nationkey AS bigint) AS req_id",
            "n_nationkey AS account_id",
            "CASE WHEN n_nationkey % 10 BETWEEN 3 AND 5 THEN '0001'"
            " WHEN n_nationkey % 10 BETWEEN 6 AND 8 THEN 'red' END AS name",
            "CASE WHEN n_nationkey % 10 BETWEEN 0 AND 2 THEN 'APM'"
            " WHEN n_nationkey % 10 BETWEEN 3 AND 5 THEN 'INFRA' END AS domain",
            "CAST(NULL AS string) AS type",
            NO_TAGS,
        )

    @cached_property
    def customer_search(self) -> DataFrame:
        """One search per customer by the end of its name, some within an account or
        for a tag; every seventh has no criterion."""
        return self.sample("customer").selectExpr(
            "c_custkey AS req_id",
            "if(c_custkey % 3 = 0, NULL, c_nationkey) AS account_id",
            "if(c_custkey % 7 = 6, NULL, substring(c_name, -6)) AS name",
            "CAST(NULL AS string) AS domain",
            "CAST(NULL AS string) AS type",
            "if(c_custkey % 7 < 3, array(struct('segment' AS key, c_mktsegment AS value)),"
            " CAST(array() AS array<struct<key: string, value: string>>)) AS tags",
        )

    @cached_property
    def tag_search(self) -> DataFrame:
        """One search for each pair of a segment and a region that customers have, by the first of them."""
        customers = self.sample("customer").withColumnRenamed("c_nationkey", "n_nationkey")
        nations = self.sample("nation").withColumnRenamed("n_regionkey", "r_regionkey")
        return (
            customers.join(nations, "n_nationkey").join(self.sample("region"), "r_regionkey")
            .groupBy("c_mktsegment", "r_name").agg(F.min("c_custkey").alias("req_id"))
            .selectExpr(
                "req_id",
                "array(struct('segment' AS key, c_mktsegment AS value), struct('region' AS key, r_name AS value)) AS tags",
            )
        )

    # --- events and replies ---

    @cached_property
    def event(self) -> DataFrame:
        return self.sample("events").selectExpr("*", "CAST(user_id % 25 AS int) AS account_id")

    @cached_property
    def response(self) -> DataFrame:
        """A reply per event, and a page per web page where JSON was expected."""
        failed = """concat('{"data":null,"errors":[{"message":"event ', event_id, ' failed"}]}')"""
        answered = (
            """concat('{"data":{"rows":[{"id":', event_id, ',"type":"', event_type, '"}]}}')"""
        )
        replies = self.sample("events").selectExpr(
            "concat('event-', event_id) AS reply_id",
            f"if(event_type = 'error', {failed}, {answered}) AS raw",
        )
        pages = self.sample("pages").selectExpr(
            "concat('page-', page_id) AS reply_id", "html AS raw"
        )
        return replies.unionByName(pages)

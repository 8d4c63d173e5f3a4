"""Entity details from tables that are stored in buckets of the GUID.

`DetailStore.save` writes the catalog and every child table in the same number of
buckets by their entity. What is asked of them later (rankings, lists, details of all
or of requested entities) then meets in its bucket: no table is shuffled again, but
for the requests. The ends of edges and the policies of conditions are looked up when
the store is written, which is the only time they are.

A bucket cannot be split by AQE. An entity with more children of a kind than fit a row
is therefore *long*: its children go to tables of their own, without buckets, and are
answered by the shuffled plans of :mod:`obsq.operators.details`, which split them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from obsq.errors import RequestError
from obsq.operators import details
from obsq.plans.semi_join import KeySet
from obsq.schema import DASHBOARD_PAGES, NOT_FOUND, OK, PAGE_WIDGETS
from obsq.sources.files import SharedFiles

#: The GUID column of each bucketed table, and the columns its buckets are sorted by.
KEYS = {
    "entity": "guid",
    "violation": "guid",
    "condition": "guid",
    "edge": "guid",
    "app_instance": "guid",
    "dashboard_page": "dashboard_guid",
    "dashboard_widget": "dashboard_guid",
}
LAYOUT = "layout.json"


class DetailStore:
    """A written store under ``root``, opened in this session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        layout = json.loads(SharedFiles(spark, self.root).read(LAYOUT))
        self.children_per_row = layout["children_per_row"]
        self.tables = {
            name: self._open(name, StructType.fromJson(schema), layout["buckets"])
            for name, schema in layout["tables"].items()
        }

    @classmethod
    def save(
        cls,
        spark: SparkSession,
        root: str,
        tables: Mapping[str, DataFrame],
        children_per_row: int = details.CHILDREN_PER_ROW,
        buckets: int | None = None,
    ) -> DetailStore:
        """Write a store of ``tables`` (by logical name) and open it.

        ``root`` must be new. The file that describes the layout is written last, so a
        store that can be opened is whole.
        """
        files = SharedFiles(spark, root)
        if files.names(""):
            raise RequestError(f"{root} is not empty")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        entities, pages = tables["entity"], tables["dashboard_page"]
        on_dashboard = pages.select("page_guid", "dashboard_guid")
        children = {
            "violation": tables["violation"],
            "condition": details.entity_conditions(entities, tables["alert_condition"], tables["policy"]),
            "edge": details.entity_relationships(tables["relationship"], entities),
            "app_instance": tables["app_instance"],
            "dashboard_page": pages,
            "dashboard_widget": tables["dashboard_widget"].join(on_dashboard, "page_guid"),
        }
        schemas = {}

        def write(rows: DataFrame, name: str) -> None:
            schemas[name] = json.loads(rows.schema.json())
            path = f"{root.rstrip('/')}/{name}"
            if name in KEYS:
                dealt = rows.repartition(buckets, KEYS[name])
                writer = dealt.write.bucketBy(buckets, KEYS[name]).sortBy(KEYS[name]).option("path", path)
                writer.format("parquet").mode("overwrite").saveAsTable(_table_name(root, name))
            else:
                rows.write.parquet(path)

        many = [
            child.groupBy(F.col(KEYS[name]).alias("guid")).agg(F.count("*").alias("n"))
            .filter((F.col("n") > children_per_row) & F.col("guid").isNotNull()).select("guid")
            for name, child in children.items()
        ]
        write(reduce(DataFrame.unionByName, many).distinct(), "long")
        long = spark.read.schema("guid string").parquet(f"{root.rstrip('/')}/long")

        def of_long(rows: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
            return rows.join(long.withColumnRenamed("guid", column), column, how).select(rows.columns)

        write(entities.join(long.withColumn("_long", F.lit(True)), "guid", "left"), "entity")
        for name, child in children.items():
            write(of_long(child, KEYS[name], "left_anti"), name)
        write(tables["policy"], "policy")
        for name in ("violation", "alert_condition", "app_instance"):
            write(of_long(tables[name], "guid"), f"long_{name}")
        write(_touching(tables["relationship"], long), "long_relationship")
        write(of_long(pages, "dashboard_guid"), "long_dashboard_page")
        kept = of_long(on_dashboard, "dashboard_guid").select("page_guid")
        write(tables["dashboard_widget"].join(kept, "page_guid", "left_semi"), "long_dashboard_widget")
        layout = {"buckets": buckets, "children_per_row": children_per_row, "tables": schemas}
        files.create(LAYOUT, json.dumps(layout), f"staged-{LAYOUT}")
        return cls(spark, root)

    def _open(self, name: str, schema: StructType, buckets: int) -> DataFrame:
        path = f"{self.root}/{name}"
        if name not in KEYS:
            return self.spark.read.schema(schema).parquet(path)
        table = _table_name(self.root, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        location = path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet"
            f" CLUSTERED BY ({KEYS[name]}) SORTED BY ({KEYS[name]}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        return self.spark.table(table)

    # --- rankings ---

    def recent_violations(self) -> DataFrame:
        return self._both(details.recent_violations, "violation")

    def running_instances(self) -> DataFrame:
        return self._both(details.running_instances, "app_instance")

    def _both(self, ranking, name: str) -> DataFrame:
        return ranking(self.tables[name]).unionByName(ranking(self.tables[f"long_{name}"]))

    # --- details ---

    def nested(self) -> DataFrame:
        """As `nested_details`, for all entities."""
        fields = [c for c in details.COMMON_FIELDS if c != "guid"]
        lists = {"recent_violations": self._violations(), "conditions": self._conditions(), "relationships": self._edges()}
        short = self.tables["entity"].filter(F.col("_long").isNull())
        joined = _with_lists(short.select("guid", details._first_part(), *fields), lists)
        return joined.unionByName(self._long_details(self.tables["long"]).select(joined.columns))

    def requested(self, requests: DataFrame) -> DataFrame:
        """As `requested_details`, for the GUIDs of ``requests``."""
        keys = KeySet(requests, "guid")
        guids, cut = keys.values, keys.cut
        fields = [c for c in details.COMMON_FIELDS if c != "guid"]
        known = cut(self.tables["entity"]).select(
            "guid", "_long", F.lit(True).alias("_known"), *fields, *details._own_structs()
        )
        # a GUID that no entity has is answered here, whatever children it has
        asked = guids.join(known, "guid", "left").filter(F.col("_long").isNull())
        lists = {
            "recent_violations": self._violations(cut),
            "conditions": self._conditions(cut),
            "relationships": self._edges(cut),
            "running_instances": self._instances(cut),
            "pages": self._pages(cut),
        }
        joined = _with_lists(asked.drop("_long").withColumn("part", F.lit(0).cast("bigint")), lists)
        answered = joined.select(
            "guid",
            "part",
            F.when(F.col("_known"), OK).otherwise(NOT_FOUND).alias("outcome"),
            *[c for c in known.columns if c not in ("guid", "_long", "_known")],
            # children may name a GUID that no entity has
            *[F.when(F.col("_known"), F.col(name)).otherwise(F.array()).alias(name) for name in lists],
        )
        return answered.unionByName(self._long_details(cut(self.tables["long"])))

    def _long_details(self, guids: DataFrame) -> DataFrame:
        """Details of entities whose lists go over several rows."""
        names = ("violation", "alert_condition", "relationship", "app_instance", "dashboard_page", "dashboard_widget")
        violations, conditions, edges, instances, pages, widgets = (self.tables[f"long_{name}"] for name in names)
        entities = self.tables["entity"].drop("_long")
        found = details.requested_details(
            guids, entities, violations, conditions, self.tables["policy"], edges, instances, pages, widgets,
            self.children_per_row,
        )
        # long GUIDs of no entity are answered with the short ones
        return found.filter(F.col("outcome") == OK)

    def _violations(self, cut=lambda rows: rows) -> DataFrame:
        return _listed(details._violation_items(cut(self.tables["violation"])), "violation")

    def _conditions(self, cut=lambda rows: rows) -> DataFrame:
        item = F.struct("condition_id", "condition_name", "enabled", "policy_id", "policy_name")
        return _listed(cut(self.tables["condition"]).select("guid", item.alias("condition")), "condition")

    def _edges(self, cut=lambda rows: rows) -> DataFrame:
        return _listed(cut(self.tables["edge"]).select("guid", F.struct(*EDGE).alias("relationship")), "relationship")

    def _instances(self, cut) -> DataFrame:
        ranked = details.running_instances(cut(self.tables["app_instance"]))
        item = F.struct("rank", "instance_id", "host", "port", "agent_version")
        return _listed(ranked.select("guid", item.alias("instance")), "instance")

    def _pages(self, cut) -> DataFrame:
        """Pages and widgets are in the bucket of their dashboard, so a page meets its widgets there."""
        pages = details.top_per_parent(
            cut(self.tables["dashboard_page"], "dashboard_guid"),
            "dashboard_guid", [F.asc("position"), F.asc("page_guid")], DASHBOARD_PAGES, "page_rank",
        )
        page = F.struct("page_rank", "page_guid", F.col("name").alias("page_name"))
        within = Window.partitionBy("dashboard_guid", "page_guid").orderBy("widget_id")
        widgets = (
            cut(self.tables["dashboard_widget"], "dashboard_guid")
            .withColumn("widget_rank", F.row_number().over(within)).filter(F.col("widget_rank") <= PAGE_WIDGETS)
        )
        widget = F.struct("widget_rank", "widget_id", "title", "visualization")
        shown = widgets.groupBy("dashboard_guid").agg(
            F.sort_array(F.collect_list(F.struct("page_guid", widget.alias("widget")))).alias("shown")
        )

        def with_widgets(p):
            own = F.filter(F.coalesce("shown", F.array()), lambda w: w["page_guid"] == p["page_guid"])
            return F.struct(
                p["page_rank"].alias("page_rank"), p["page_guid"].alias("page_guid"), p["page_name"].alias("page_name"),
                F.transform(own, lambda w: w["widget"]).alias("widgets"),
            )

        listed = pages.groupBy("dashboard_guid").agg(F.sort_array(F.collect_list(page)).alias("pages"))
        return listed.join(shown, "dashboard_guid", "left").select(
            F.col("dashboard_guid").alias("guid"), F.transform("pages", with_widgets).alias("items")
        )


def _touching(edges: DataFrame, guids: DataFrame) -> DataFrame:
    """The edges with an end among distinct ``guids``; one between two of them is kept once."""
    rows = edges
    for end in ("source_guid", "target_guid"):
        rows = rows.join(guids.select(F.col("guid").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return rows.filter(F.col("_source_guid") | F.col("_target_guid")).select(edges.columns)


def _listed(rows: DataFrame, item: str) -> DataFrame:
    return rows.groupBy("guid").agg(F.sort_array(F.collect_list(item)).alias("items"))


def _with_lists(rows: DataFrame, lists: Mapping[str, DataFrame]) -> DataFrame:
    for name, children in lists.items():
        rows = rows.join(children.withColumnRenamed("items", name), "guid", "left")
    return rows.withColumns({name: F.coalesce(F.col(name), F.array()) for name in lists})


EDGE = ["source_guid", "target_guid", "type", "source_name", "source_type", "target_name", "target_type"]


def _table_name(root: str, name: str) -> str:
    """The name of a stored table in this session's catalog."""
    return f"obsq_{hashlib.md5(root.rstrip('/').encode()).hexdigest()}_{name}"

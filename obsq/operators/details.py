"""Everything known about an entity: its own fields and its child rows.

Each child table is joined or ranked on its own. One wide join would multiply
the children of an entity with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.plans.semi_join import KeySet
from obsq.plans.sizes import fits_broadcast
from obsq.plans.skew import salted_left_join
from obsq.schema import (
    DASHBOARD_PAGES,
    ENTITY_KINDS,
    NOT_FOUND,
    OK,
    PAGE_WIDGETS,
    RECENT_VIOLATIONS,
    RUNNING,
    RUNNING_INSTANCES,
)

COMMON_FIELDS = [
    "guid",
    "name",
    "account_id",
    "domain",
    "entity_type",
    "tags",
    "reporting",
    "permalink",
    "alert_severity",
]
CHILDREN_PER_ROW = 1000
#: Equal edges that become rows in one go.
COPY_BLOCK = 4096


def entity_details(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """The common fields of each requested GUID.

    ``requests`` holds ``guid`` and any columns of its own. A GUID that is
    empty or that no entity has keeps its row, with NOT_FOUND as ``outcome``.
    """
    known = entities.select(*COMMON_FIELDS, F.lit(True).alias("_known"))
    if fits_broadcast(requests):
        # The outer join cannot broadcast the requests, a filter of the catalog
        # can: what is left of it is as small as they are.
        known = known.join(F.broadcast(requests.select("guid").distinct()), "guid", "left_semi")
    return (
        requests.join(known, "guid", "left")
        .withColumn("outcome", F.when(F.col("_known"), OK).otherwise(NOT_FOUND))
        .drop("_known")
    )


def details_by_type(entities: DataFrame) -> DataFrame:
    """The fields each kind of entity has of its own, one nullable struct per
    kind; only the struct of an entity's own kind is filled."""
    return entities.select("guid", "name", "domain", "entity_type", *_own_structs())


def _own_structs() -> list[Column]:
    return [
        F.when((F.col("domain") == domain) & (F.col("type") == entity_type), F.col(column)).alias(
            column
        )
        for (domain, entity_type), column in ENTITY_KINDS.items()
    ]


def top_per_parent(
    rows: DataFrame, parent: str, order: Sequence[Column], count: int, rank: str = "rank"
) -> DataFrame:
    """The first ``count`` rows of each parent, numbered from 1.

    The order must end in a unique key. Every task drops all but its own best
    rows per parent before the shuffle, so a parent with a third of all rows
    sends on only ``count`` rows per task.
    """
    within = Window.partitionBy(parent).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= count)


def recent_violations(violations: DataFrame, count: int = RECENT_VIOLATIONS) -> DataFrame:
    """The latest violations of each entity, newest first."""
    return top_per_parent(
        violations, "guid", [F.desc("opened_at"), F.desc("violation_id")], count
    )


def running_instances(instances: DataFrame, count: int = RUNNING_INSTANCES) -> DataFrame:
    """A few running instances of each application."""
    running = instances.filter(F.col("state") == RUNNING)
    return top_per_parent(running, "guid", [F.asc("instance_id")], count).drop("state")


def dashboard_contents(
    pages: DataFrame,
    widgets: DataFrame,
    page_count: int = DASHBOARD_PAGES,
    widget_count: int = PAGE_WIDGETS,
) -> DataFrame:
    """The first pages of each dashboard with the first widgets of each page.

    A page without widgets keeps one row. Widgets are ranked before the join:
    both sides then hold a few rows per page, however many one page started with.
    """
    kept_pages = top_per_parent(
        pages, "dashboard_guid", [F.asc("position"), F.asc("page_guid")], page_count, "page_rank"
    ).select("dashboard_guid", "page_rank", "page_guid", F.col("name").alias("page_name"))
    kept_widgets = top_per_parent(
        widgets, "page_guid", [F.asc("widget_id")], widget_count, "widget_rank"
    )
    return kept_pages.join(kept_widgets, "page_guid", "left").select(
        "dashboard_guid",
        "page_rank",
        "page_guid",
        "page_name",
        "widget_rank",
        "widget_id",
        "title",
        "visualization",
    )


def entity_conditions(
    entities: DataFrame, conditions: DataFrame, policies: DataFrame
) -> DataFrame:
    """Alert conditions of each entity with the policy they belong to.

    A condition whose policy is unknown is kept, without the policy's name.
    """
    policy = policies.select("policy_id", F.col("name").alias("policy_name"))
    return (
        conditions.join(policy, "policy_id", "left")
        .join(entities.select("guid", F.col("name").alias("entity_name")), "guid")
        .select(
            "guid",
            "entity_name",
            "condition_id",
            F.col("name").alias("condition_name"),
            "enabled",
            "policy_id",
            "policy_name",
        )
    )


def entity_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of each entity, as source and as target, with both ends resolved.

    An edge is listed once for each of its ends that is in the catalog (once in
    all if it is a loop); the other end may be unknown and is then null. Both
    ends are resolved once, by two equality joins, and the listings for source
    and target are made from that without an OR in a join condition.
    """
    return _by_end(_with_ends(relationships, entities)).filter(_end_known()).select(
        "guid",
        "type",
        "source_guid",
        "source_name",
        "source_type",
        "target_guid",
        "target_name",
        "target_type",
    )


def _with_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the name and type of both ends, null where no entity has the GUID."""

    def end(side: str) -> DataFrame:
        return entities.select(
            F.col("guid").alias(f"{side}_guid"),
            F.col("name").alias(f"{side}_name"),
            F.col("entity_type").alias(f"{side}_type"),
            F.lit(True).alias(f"_{side}_known"),
        )

    # Outer joins keep the edges as the streamed side, whose hot keys can be
    # split, and leave only the catalog to be broadcast if it is small enough.
    return edges.join(end("source"), "source_guid", "left").join(
        end("target"), "target_guid", "left"
    )


def _end_known() -> Column:
    return F.when(F.col("guid") == F.col("source_guid"), F.col("_source_known")).otherwise(
        F.col("_target_known")
    )


def _by_end(edges: DataFrame) -> DataFrame:
    """Each edge once per distinct end, as ``guid``."""
    ends = F.array_distinct(F.array("source_guid", "target_guid"))
    return edges.withColumn("guid", F.explode(ends))


def nested_details(
    entities: DataFrame,
    violations: DataFrame,
    conditions: DataFrame,
    policies: DataFrame,
    relationships: DataFrame,
    children_per_row: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """Entities with their child rows as lists in a fixed order.

    An entity is one row, ``part`` 0, as long as no list is longer than
    ``children_per_row``. A longer list is spread over further parts, so that no
    row and no task has to hold a list without bound; the common fields are in
    part 0 only. A list without children is empty.

    All children meet in one grouping by entity and part. Recent violations are
    few per entity by definition and need no parts.
    """
    _check_bound(children_per_row)
    common = [c for c in COMMON_FIELDS if c != "guid"]
    together = entities.select("guid", _first_part(), F.struct(*common).alias("entity"))
    for children in (
        _violation_items(violations),
        _condition_items(entities, conditions, policies, children_per_row),
        _edge_items(relationships, entities, children_per_row),
    ):
        together = together.unionByName(children, allowMissingColumns=True)
    return (
        together.groupBy("guid", "part")
        .agg(
            F.first("entity", ignorenulls=True).alias("entity"),
            _list("violation").alias("recent_violations"),
            _list("condition").alias("conditions"),
            _list("relationship").alias("relationships"),
        )
        # Violations of a GUID that no entity has; other children were joined.
        .filter(F.col("entity").isNotNull() | (F.col("part") > 0))
        .select(
            "guid", "part", "entity.*", "recent_violations", "conditions", "relationships"
        )
    )


def requested_details(
    requests: DataFrame,
    entities: DataFrame,
    violations: DataFrame,
    conditions: DataFrame,
    policies: DataFrame,
    relationships: DataFrame,
    instances: DataFrame,
    pages: DataFrame,
    widgets: DataFrame,
    children_per_row: int = CHILDREN_PER_ROW,
) -> DataFrame:
    """Everything known of the GUIDs in ``requests``, each answered once.

    Common fields, the struct of the entity's own kind, and as lists: recent
    violations, conditions, relationships, running instances, and dashboard
    pages with their widgets. Long lists go on in parts as in `nested_details`.
    A GUID that no entity has (a null one too) is one row with NOT_FOUND as
    ``outcome`` and empty lists.

    Every child table is cut to the requested GUIDs before it is joined, ranked
    or counted, so the work follows the requests and not the catalog.
    """
    _check_bound(children_per_row)
    keys = KeySet(requests, "guid")
    guids, cut = keys.values, keys.cut

    known = cut(entities)
    fields = F.struct(*[c for c in COMMON_FIELDS if c != "guid"], *_own_structs())
    together = guids.join(
        known.select("guid", fields.alias("entity")), "guid", "left"
    ).select("guid", _first_part(), "entity")

    running = running_instances(cut(instances)).select(
        "guid",
        _first_part(),
        F.struct("rank", "instance_id", "host", "port", "agent_version").alias("instance"),
    )
    for children in (
        _violation_items(cut(violations)),
        _condition_items(known, cut(conditions), policies, children_per_row),
        _edge_items(cut(_by_end(relationships)), entities, children_per_row),
        running,
        _page_items(cut(pages, "dashboard_guid"), widgets),
    ):
        together = together.unionByName(children, allowMissingColumns=True)

    found = F.col("entity").isNotNull() | (F.col("part") > 0)

    def listed(item: str, name: str) -> Column:
        # children may name a GUID that no entity has
        return F.when(found, F.col(item)).otherwise(F.array()).alias(name)

    return (
        together.groupBy("guid", "part")
        .agg(
            F.first("entity", ignorenulls=True).alias("entity"),
            *[
                _list(item).alias(item)
                for item in ("violation", "condition", "relationship", "instance", "page")
            ],
        )
        .select(
            "guid",
            "part",
            F.when(found, OK).otherwise(NOT_FOUND).alias("outcome"),
            "entity.*",
            listed("violation", "recent_violations"),
            listed("condition", "conditions"),
            listed("relationship", "relationships"),
            listed("instance", "running_instances"),
            listed("page", "pages"),
        )
    )


def _check_bound(children_per_row: int) -> None:
    if children_per_row < RECENT_VIOLATIONS:
        raise RequestError(f"children_per_row must be at least {RECENT_VIOLATIONS}")


def _first_part() -> Column:
    return F.lit(0).cast("bigint").alias("part")


def _list(item: str) -> Column:
    return F.sort_array(F.collect_list(item))


def _violation_items(violations: DataFrame) -> DataFrame:
    return recent_violations(violations).select(
        "guid",
        _first_part(),
        F.struct("rank", "violation_id", "label", "level", "opened_at", "closed_at").alias(
            "violation"
        ),
    )


def _condition_items(
    entities: DataFrame, conditions: DataFrame, policies: DataFrame, per_row: int
) -> DataFrame:
    counted = conditions.groupBy("guid").agg(F.count("*").alias("children"))
    ruled = entity_conditions(entities, conditions, policies)
    return _with_parts(ruled, "condition_id", counted, per_row).select(
        "guid",
        _part(F.col("condition_id").cast("string")),
        F.struct(
            "condition_id", "condition_name", "enabled", "policy_id", "policy_name"
        ).alias("condition"),
    )


def _edge_items(edges: DataFrame, entities: DataFrame, per_row: int) -> DataFrame:
    """Edges of each end, equal ones numbered so that parts divide them as well.

    Equal edges travel as one row with their number. They become rows again in
    two steps, blocks and then the edges of a block; where an edge has several
    blocks, they are dealt to all tasks in between. ``edges`` may already hold ``guid``, the end meant.
    """
    ends = ["source_guid", "target_guid", "type"]
    if "guid" in edges.columns:
        counted = edges.groupBy("guid", *ends).agg(F.count("*").alias("copies"))
        listed = _with_ends(counted, entities)
    else:
        counted = edges.groupBy(*ends).agg(F.count("*").alias("copies"))
        listed = _by_end(_with_ends(counted, entities))
        counted = _by_end(counted)
    sizes = counted.groupBy("guid").agg(F.sum("copies").alias("children"))
    edge_id = F.concat_ws("\u0001", *ends)
    last = F.col("copies") - 1
    known = listed.filter(_end_known())
    many = F.col("copies") > COPY_BLOCK
    # edges of one block stay where they are
    blocks = known.filter(~many).withColumn("_block", F.lit(0).cast("bigint")).unionByName(
        known.filter(many)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / COPY_BLOCK))))
        .repartition("guid", *ends, "_block")
    ).withColumn("_row", F.concat_ws("\u0001", edge_id, F.col("_block").cast("string")))
    first = F.col("_block") * COPY_BLOCK
    copies = F.sequence(first, F.least(last, first + (COPY_BLOCK - 1)))
    numbered = F.when(F.col("_copy") == 0, edge_id).otherwise(
        F.concat_ws("\u0001", edge_id, F.col("_copy").cast("string"))
    )
    return (
        _with_parts(blocks, "_row", sizes, per_row)
        .withColumn("_copy", F.explode(copies))
        .select(
            "guid",
            _part(numbered),
            F.struct(
                "source_guid", "target_guid", "type",
                "source_name", "source_type", "target_name", "target_type",
            ).alias("relationship"),
        )
    )


def _page_items(pages: DataFrame, widgets: DataFrame) -> DataFrame:
    """The first pages of dashboards, each with the list of its first widgets."""
    kept = top_per_parent(
        pages, "dashboard_guid", [F.asc("position"), F.asc("page_guid")], DASHBOARD_PAGES, "_rank"
    ).drop("_rank")
    shown = widgets.join(kept.select("page_guid"), "page_guid", "left_semi")
    widget = F.when(
        F.col("widget_rank").isNotNull(),
        F.struct("widget_rank", "widget_id", "title", "visualization"),
    )
    page = ["page_rank", "page_guid", "page_name"]
    return (
        dashboard_contents(kept, shown)
        .groupBy("dashboard_guid", *page)
        .agg(F.sort_array(F.collect_list(widget)).alias("widgets"))
        .select(
            F.col("dashboard_guid").alias("guid"),
            _first_part(),
            F.struct(*page, "widgets").alias("page"),
        )
    )


def _with_parts(rows: DataFrame, row_id: str, sizes: DataFrame, per_row: int) -> DataFrame:
    """Child rows with ``parts``, the rows their parent's list goes over (null: one).

    ``sizes`` holds each parent's ``children``. Null keys are dropped as every
    join on the sizes would drop them.
    """
    sizes = sizes.filter(F.col("guid").isNotNull())
    long_lists = sizes.filter(F.col("children") > per_row).select(
        "guid", F.ceil(F.col("children") / per_row).alias("parts")
    )
    return salted_left_join(rows, long_lists, ["guid"], row_id, sizes, "children")


def _part(row_id: Column) -> Column:
    """A child's part follows from a hash of its id: parts are near even without
    ordering all children of a parent."""
    digest = F.conv(F.substring(F.md5(row_id), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(F.pmod(digest, F.col("parts")), F.lit(0).cast("bigint")).alias("part")

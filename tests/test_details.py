from datetime import datetime

import pytest
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.operators import details
from obsq.plans.semi_join import KeySet
from obsq.plans.sizes import fits_broadcast
from obsq.sources.tables import read_table, write_table
from tests.helpers import entities, first_plan, plan, table, values


def day(n):
    return datetime(2024, 1, n)


def test_details_keep_unknown_guids(spark):
    catalog = entities(spark, {"guid": "a", "name": "A"})
    requests = spark.createDataFrame(
        [(1, "a"), (2, "x"), (3, ""), (4, None), (5, "a")], "req_id int, guid string"
    )
    found = details.entity_details(requests, catalog)
    assert values(found, "req_id", "name", "outcome") == [
        (1, "A", "OK"),
        (2, None, "NOT_FOUND"),
        (3, None, "NOT_FOUND"),
        (4, None, "NOT_FOUND"),
        (5, "A", "OK"),
    ]


def test_a_few_requests_do_not_move_the_catalog(spark, tmp_path, fixtures):
    """A small request file filters the catalog where it is."""
    guids = ["APM|1", "nothing", "SYNTH|2", "APM|1"]
    spark.createDataFrame([(g,) for g in guids], "guid string").coalesce(1).write.parquet(
        str(tmp_path / "requests")
    )
    requests = spark.read.parquet(str(tmp_path / "requests"))
    assert fits_broadcast(requests) and not fits_broadcast(requests, 10**6)
    found = details.entity_details(requests, fixtures.entity)
    assert values(found, "guid", "outcome") == sorted(
        [("APM|1", "OK"), ("APM|1", "OK"), ("SYNTH|2", "OK"), ("nothing", "NOT_FOUND")], key=str
    )
    text = first_plan(found)
    # Only the requests are exchanged on their way to the catalog.
    assert "LeftSemi, BuildRight" in text and "SortMergeJoin" not in text.split("LeftSemi")[1]


def test_only_the_own_kind_is_filled(spark):
    apm, browser = {"language": "java"}, {"application_id": 7}
    catalog = entities(
        spark,
        {"guid": "a", "apm": apm, "browser": browser},
        {"guid": "b", "domain": "BROWSER", "apm": apm, "browser": browser},
        {"guid": "m", "domain": "MOBILE", "apm": apm},
    )
    rows = details.details_by_type(catalog).select("guid", "apm.language", "browser.application_id")
    assert values(rows) == [("a", "java", None), ("b", None, 7), ("m", None, None)]


def test_recent_violations_break_ties_by_id(spark):
    rows = [
        {"violation_id": i, "guid": "a", "opened_at": day(1 if i < 8 else 2)} for i in range(9)
    ]
    rows.append({"violation_id": 99, "guid": "b", "opened_at": day(3)})
    top = details.recent_violations(table(spark, "violation", *rows))
    assert values(top, "guid", "rank", "violation_id") == [
        ("a", 1, 8), ("a", 2, 7), ("a", 3, 6), ("a", 4, 5), ("a", 5, 4), ("b", 1, 99),
    ]


def test_stopped_instances_take_no_place(spark):
    rows = [
        {"instance_id": i, "guid": "a", "state": "RUNNING" if i % 2 else "STOPPED"}
        for i in range(20)
    ]
    top = details.running_instances(table(spark, "app_instance", *rows))
    assert values(top, "instance_id") == [1, 3, 5, 7, 9]


def test_dashboards_keep_empty_pages(spark):
    pages = [
        {"dashboard_guid": "d", "page_guid": f"p{i:02}", "position": 20 - i} for i in range(12)
    ]
    widgets = [{"page_guid": "p11", "widget_id": i} for i in range(13)]
    widgets.append({"page_guid": "p00", "widget_id": 50})
    contents = details.dashboard_contents(
        table(spark, "dashboard_page", *pages), table(spark, "dashboard_widget", *widgets)
    )
    rows = values(contents, "page_rank", "page_guid", "widget_rank", "widget_id")
    assert [r for r in rows if r[1] == "p11"] == sorted(
        [(1, "p11", i + 1, i) for i in range(10)], key=str
    )
    assert {r[1] for r in rows} == {f"p{i:02}" for i in range(2, 12)}
    assert len(rows) == 10 + 9


@pytest.fixture(scope="module")
def network(spark):
    catalog = entities(
        spark, {"guid": "h1", "name": "one"}, {"guid": "m1", "name": "mon"}, {"guid": "lone"}
    )
    edges = table(
        spark,
        "relationship",
        {"source_guid": "h1", "target_guid": "m1", "type": "SERVES"},
        {"source_guid": "h1", "target_guid": "h1", "type": "CALLS"},
        {"source_guid": "m1", "target_guid": "gone", "type": "SERVES"},
        {"source_guid": "gone", "target_guid": "lost", "type": "SERVES"},
    )
    return catalog, edges


def test_relationships_of_both_ends(network):
    catalog, edges = network
    rows = details.entity_relationships(edges, catalog)
    assert values(rows, "guid", "source_name", "target_name", "type") == [
        ("h1", "one", "mon", "SERVES"),
        ("h1", "one", "one", "CALLS"),
        ("m1", "mon", None, "SERVES"),
        ("m1", "one", "mon", "SERVES"),
    ]


def test_conditions_with_policy(spark, network):
    catalog, _ = network
    conditions = table(
        spark,
        "alert_condition",
        {"condition_id": 1, "name": "c1", "policy_id": 10, "guid": "h1"},
        {"condition_id": 2, "name": "c2", "policy_id": 77, "guid": "h1"},
        {"condition_id": 3, "name": "c3", "policy_id": 10, "guid": "gone"},
    )
    policies = table(spark, "policy", {"policy_id": 10, "name": "p"})
    rows = details.entity_conditions(catalog, conditions, policies)
    assert values(rows, "guid", "condition_id", "policy_name") == [("h1", 1, "p"), ("h1", 2, None)]


def test_nested_details_are_whole_however_long(spark):
    catalog = entities(spark, {"guid": "big", "name": "B"}, {"guid": "small", "name": "S"})
    conditions = table(
        spark,
        "alert_condition",
        *[{"condition_id": i, "name": f"c{i}", "guid": "big"} for i in range(200)],
        {"condition_id": 900, "name": "x", "guid": "small"},
        {"condition_id": 901, "name": "y", "guid": "small"},
    )
    violations = table(
        spark,
        "violation",
        *[{"violation_id": i, "guid": "small", "opened_at": day(1)} for i in range(9)],
        {"violation_id": 77, "guid": "gone", "opened_at": day(1)},
    )
    edges = table(
        spark,
        "relationship",
        *[{"source_guid": "big", "target_guid": f"t{i}", "type": "SERVES"} for i in range(150)],
    )
    policies = table(spark, "policy", {"policy_id": 1, "name": "p"})
    nested = details.nested_details(
        catalog, violations, conditions, policies, edges, children_per_row=20
    )
    rows = {(r.guid, r.part): r for r in nested.collect()}

    assert {guid for guid, _ in rows} == {"big", "small"}
    small = rows[("small", 0)]
    assert [v.violation_id for v in small.recent_violations] == [8, 7, 6, 5, 4]
    assert [c.condition_id for c in small.conditions] == [900, 901]
    assert (small.name, small.relationships) == ("S", [])

    big = [r for (guid, _), r in rows.items() if guid == "big"]
    assert {r.part for r in big} == set(range(10))
    assert [r.name for r in big if r.name] == ["B"]
    assert sorted(c.condition_id for r in big for c in r.conditions) == list(range(200))
    assert len({e.target_guid for r in big for e in r.relationships}) == 150
    assert max(len(r.conditions) for r in big) < 60
    with pytest.raises(RequestError):
        details.nested_details(catalog, violations, conditions, policies, edges, 4)


def test_equal_edges_are_spread_over_parts(spark):
    catalog = entities(spark, {"guid": "a", "name": "A"}, {"guid": "b", "name": "B"})
    edge = {"source_guid": "a", "target_guid": "b", "type": "SERVES"}
    edges = spark.range(details.COPY_BLOCK + 500).select(
        *[F.lit(v).alias(k) for k, v in edge.items()]
    )
    empty = [table(spark, t) for t in ("violation", "alert_condition", "policy")]
    nested = details.nested_details(catalog, *empty, edges, children_per_row=100)
    sizes = nested.select("guid", F.size("relationships").alias("n")).collect()
    assert {g: sum(r.n for r in sizes if r.guid == g) for g in "ab"} == {
        "a": details.COPY_BLOCK + 500, "b": details.COPY_BLOCK + 500
    }
    assert max(r.n for r in sizes) < 200


def _requested(spark, requests, **tables):
    names = [
        "violation", "alert_condition", "policy", "relationship", "app_instance",
        "dashboard_page", "dashboard_widget",
    ]
    found = details.requested_details(
        requests, tables["entity"], *[tables.get(n) or table(spark, n) for n in names]
    )
    return {r.guid: r for r in found.collect()}


def test_requested_details(spark):
    requests = spark.createDataFrame(
        [("d",), ("d",), ("app",), ("gone",), (None,), ("",)], "guid string"
    )
    rows = _requested(
        spark,
        requests,
        entity=entities(
            spark,
            {"guid": "d", "name": "D", "domain": "VIZ", "type": "DASHBOARD"},
            {"guid": "app", "name": "A"},
            {"guid": "other", "name": "O"},
        ),
        violation=table(
            spark,
            "violation",
            {"violation_id": 1, "guid": "app", "opened_at": day(1)},
            {"violation_id": 2, "guid": "gone", "opened_at": day(1)},
            {"violation_id": 3, "guid": "other", "opened_at": day(1)},
        ),
        relationship=table(
            spark,
            "relationship",
            {"source_guid": "other", "target_guid": "app", "type": "CALLS"},
            {"source_guid": "other", "target_guid": "app", "type": "CALLS"},
            {"source_guid": "app", "target_guid": "app", "type": "LOOPS"},
        ),
        app_instance=table(
            spark,
            "app_instance",
            {"instance_id": 5, "guid": "app", "state": "RUNNING"},
            {"instance_id": 6, "guid": "gone", "state": "RUNNING"},
        ),
        dashboard_page=table(
            spark,
            "dashboard_page",
            {"dashboard_guid": "d", "page_guid": "p1", "name": "P1", "position": 1},
            {"dashboard_guid": "d", "page_guid": "p2", "name": "P2", "position": 2},
        ),
        dashboard_widget=table(
            spark,
            "dashboard_widget",
            *[{"page_guid": "p2", "widget_id": i} for i in range(30)],
        ),
    )
    assert set(rows) == {"d", "app", "gone", None, ""}
    for unknown in ("gone", None, ""):
        row = rows[unknown]
        assert row.outcome == "NOT_FOUND" and row.name is None
        assert row.recent_violations == row.running_instances == row.pages == []
    app = rows["app"]
    assert (app.outcome, app.name, app.pages) == ("OK", "A", [])
    assert [v.violation_id for v in app.recent_violations] == [1]
    assert [i.instance_id for i in app.running_instances] == [5]
    assert [(e.type, e.source_name) for e in app.relationships] == [
        ("LOOPS", "A"), ("CALLS", "O"), ("CALLS", "O")
    ]
    assert [(p.page_guid, len(p.widgets)) for p in rows["d"].pages] == [("p1", 0), ("p2", 10)]


def test_requested_details_of_empty_tables(spark):
    nobody = spark.createDataFrame([], "guid string")
    assert _requested(spark, nobody, entity=entities(spark, {"guid": "a"})) == {}
    asked = spark.createDataFrame([("a",)], "guid string")
    assert _requested(spark, asked, entity=entities(spark))["a"].outcome == "NOT_FOUND"


def test_requests_cut_child_tables_before_they_are_shuffled(spark, fixtures, tmp_path):
    """The semi joins with the GUIDs lie right above the scans."""
    tables = {}
    for name in ("entity", "violation", "relationship", "app_instance", "dashboard_page"):
        write_table(getattr(fixtures, name), str(tmp_path), name)
        tables[name] = read_table(spark, str(tmp_path), name)
    spark.range(3).selectExpr("concat('APM|', id) AS guid").write.parquet(f"{tmp_path}/asked")
    found = details.requested_details(
        spark.read.parquet(f"{tmp_path}/asked"),
        tables["entity"],
        tables["violation"],
        table(spark, "alert_condition"),
        table(spark, "policy"),
        tables["relationship"],
        tables["app_instance"],
        tables["dashboard_page"],
        table(spark, "dashboard_widget"),
    )
    lines = first_plan(found).splitlines()
    for name in ("violation", "relationship", "app_instance", "dashboard_page"):
        scans = [i for i, line in enumerate(lines) if f"/{name}]" in line and "Scan" in line]
        assert scans
        for at in scans:
            depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
            above = []
            for line in reversed(lines[:at]):
                step = len(line) - len(line.lstrip(" :+-*()0123456789"))
                if step < depth:
                    above.append(line)
                    depth = step
            first = next(line for line in above if "Exchange" in line or "LeftSemi" in line)
            assert "LeftSemi" in first, (name, first)


def test_ranking_cuts_before_the_shuffle(fixtures):
    for rows in (
        details.recent_violations(fixtures.violation),
        details.running_instances(fixtures.app_instance),
        details.dashboard_contents(fixtures.dashboard_page, fixtures.dashboard_widget),
        details.recent_violations(fixtures.violation, 5000),
    ):
        text = plan(rows)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_detail_joins_are_equality_joins(spark, fixtures, tmp_path, conf):
    write_table(fixtures.policy, str(tmp_path), "policy")
    policies = read_table(spark, str(tmp_path), "policy")
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    for rows in (
        details.entity_conditions(fixtures.entity, fixtures.alert_condition, policies),
        details.entity_relationships(fixtures.relationship, fixtures.entity),
    ):
        text = plan(rows)
        assert "NestedLoop" not in text and "CartesianProduct" not in text
        assert "SortMergeJoin" in text


def test_a_hot_entity_is_split(spark, conf):
    """Nine of ten requests name one entity: AQE cuts that partition."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    )
    try:
        catalog = spark.range(1000).select(
            F.concat(F.lit("g"), "id").alias("guid"),
            F.lit("n").alias("name"),
            F.lit(1).alias("account_id"),
            F.lit("APM").alias("domain"),
            F.lit("APM_APPLICATION").alias("entity_type"),
            F.expr("CAST(NULL AS array<struct<key: string, value: string>>)").alias("tags"),
            F.lit(True).alias("reporting"),
            F.lit("p").alias("permalink"),
            F.lit("s").alias("alert_severity"),
        )
        requests = spark.range(0, 200000, 1, 8).select(
            F.col("id").alias("req_id"),
            F.concat(F.lit("g"), F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id") % 1000)).alias(
                "guid"
            ),
        )
        found = details.entity_details(requests, catalog)
        assert "skew=true" in plan(found)
        assert found.filter("outcome = 'OK'").count() == 200000
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_many_requests_cut_children_behind_a_bloom_filter(spark, tmp_path, conf):
    """Of a child table only what may be asked for is shuffled."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    conf(spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0")
    children = spark.range(50_000).selectExpr("concat('G', id % 5000) AS guid", "id AS violation_id")
    children.write.parquet(str(tmp_path / "children"))
    stored = spark.read.parquet(str(tmp_path / "children"))
    requests = spark.range(300).selectExpr("concat('G', id % 60) AS guid").union(spark.sql("SELECT null"))
    keys = KeySet(requests, "guid")
    assert not keys.small and keys.values.count() == 61 and len(keys.values.inputFiles()) >= 1
    cut = keys.cut(stored)
    text = plan(cut)
    assert "might_contain" in text
    assert cut.count() == 600
    shuffled = cut._jdf.queryExecution().executedPlan()
    cut.collect()
    written = [int(n) for n in shuffle_records(shuffled)]
    # 600 rows, the few the filter lets through by chance, the keys and the filter itself
    assert max(written) < 1500


def shuffle_records(adaptive):
    """Records that each shuffle of an executed plan wrote."""
    found, waiting = [], [adaptive.finalPhysicalPlan()]
    while waiting:
        node = waiting.pop()
        if "ShuffleExchange" in node.getClass().getSimpleName():
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        if "QueryStage" in node.getClass().getSimpleName():
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_only_blocks_of_many_copies_are_dealt(fixtures):
    items = details._edge_items(fixtures.delivery, fixtures.entity, 100)
    text = items._jdf.queryExecution().optimizedPlan().toString()
    assert f"> {details.COPY_BLOCK}" in text.split("RepartitionByExpression")[1]

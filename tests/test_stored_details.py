"""Details from bucketed tables beside those from plain ones."""

import pytest

from obsq.errors import RequestError
from obsq.operators import details, stored_details
from obsq.operators.stored_details import KEYS, DetailStore, _table_name
from tests.helpers import first_plan, values

NAMES = ["entity", "violation", "alert_condition", "policy", "app_instance", "dashboard_page", "dashboard_widget"]


@pytest.fixture(scope="module")
def tables(fixtures):
    return fixtures.tables(*NAMES) | {"relationship": fixtures.delivery}


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    return DetailStore.save(spark, str(tmp_path_factory.mktemp("details") / "store"), tables, children_per_row=100)


def as_text(frame):
    return values(frame.selectExpr("to_json(struct(*)) AS row"), "row")


def test_requested_details_are_the_same(spark, tables, store, fixtures):
    want = details.requested_details(
        fixtures.guid_request, *[tables[n] for n in ("entity", "violation", "alert_condition", "policy", "relationship",
                                                    "app_instance", "dashboard_page", "dashboard_widget")], 100,
    )
    got = store.requested(fixtures.guid_request)
    assert got.columns == want.columns and as_text(got) == as_text(want)
    # some entities have lists in parts, which the buckets do not hold
    assert 0 < store.tables["long"].count() < 200 and got.filter("part > 0").count() > 0


def test_few_and_odd_requests(spark, store, tmp_path):
    asked = spark.createDataFrame([("APM|1",), ("APM|1",), ("DASH|3",), ("INFRA|1",), ("nobody",), (None,)], "guid string")
    asked.write.parquet(str(tmp_path / "asked"))
    stored = spark.read.parquet(str(tmp_path / "asked"))
    for requests in (asked, stored):
        rows = store.requested(requests).filter("part = 0").collect()
        assert sorted((r.guid or "", r.outcome) for r in rows) == [
            ("", "NOT_FOUND"), ("APM|1", "OK"), ("DASH|3", "OK"), ("INFRA|1", "OK"), ("nobody", "NOT_FOUND"),
        ]
        assert all(r.recent_violations == [] for r in rows if r.outcome == "NOT_FOUND")


def test_nested_details_are_the_same(tables, store):
    want = details.nested_details(*[tables[n] for n in ("entity", "violation", "alert_condition", "policy", "relationship")], 100)
    assert as_text(store.nested()) == as_text(want)


def test_rankings_are_the_same(tables, store):
    assert values(store.recent_violations()) == values(details.recent_violations(tables["violation"]))
    assert values(store.running_instances()) == values(details.running_instances(tables["app_instance"]))


def test_buckets_meet_without_an_exchange(spark, store, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    short = {name: rows for name, rows in store.tables.items()}
    ranked = details.recent_violations(short["violation"])
    lists = [store._violations(), store._conditions(), store._edges()]
    joined = short["entity"].filter("_long IS NULL").select("guid", "name")
    for i, children in enumerate(lists):
        joined = joined.join(children.withColumnRenamed("items", f"list_{i}"), "guid", "left")
    for frame in (ranked, joined):
        text = first_plan(frame)
        assert "Exchange" not in text and "Bucketed: true" in text
    # requests are shuffled to the buckets, the tables are not
    asked = spark.range(9).selectExpr("concat('APM|', id) AS guid").distinct()
    text = first_plan(asked.join(joined, "guid"))
    assert text.count("Exchange") == 1


def test_a_store_is_opened_by_another_session(spark, store, fixtures):
    other = spark.newSession()
    for name in KEYS:
        spark.sql(f"DROP TABLE {_table_name(store.root, name)}")
    opened = DetailStore(other, store.root)
    assert values(opened.recent_violations()) == values(details.recent_violations(fixtures.violation))
    assert "Exchange" not in first_plan(details.recent_violations(opened.tables["violation"]))


def test_a_store_is_not_overwritten(spark, store, tables):
    with pytest.raises(RequestError):
        DetailStore.save(spark, store.root, tables)


def test_edges_of_long_entities_are_found_without_grouping_all_edges(spark):
    ends = [("a", "b"), ("a", "b"), ("a", "c"), ("c", "a"), ("c", "d"), (None, "b"), ("a", None), (None, None), ("b", "b")]
    edges = spark.createDataFrame([(*e, None) for e in ends], "source_guid string, target_guid string, type string")
    guids = spark.createDataFrame([("a",), ("b",)], "guid string")
    found = stored_details._touching(edges, guids)
    assert values(found) == values(edges.filter("source_guid IN ('a', 'b') OR target_guid IN ('a', 'b')"))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()

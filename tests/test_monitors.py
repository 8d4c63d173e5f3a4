import pytest

from obsq.operators.monitors import as_entities, check_monitors
from obsq.operators.search import list_monitors
from obsq.sources.catalog import union_kinds
from obsq.sources.tables import append_rows
from tests.helpers import outcomes, table, values

GOOD = {
    "name": "m", "uri": "https://example.test", "locations": ["L1", "L2"], "account_id": 3,
    "period": "EVERY_HOUR", "status": "MUTED",
}


def check(spark, *rows, default=None):
    numbered = [{"req_id": i, **GOOD, **row} for i, row in enumerate(rows)]
    return check_monitors(table(spark, "monitor_request", *numbered), default)


def by_request(df):
    return {r.req_id: r.outcome for r in df.collect()}


def test_first_broken_rule_wins(spark):
    batch = check(
        spark,
        {},
        {"name": ""},
        {"name": None, "locations": [None], "period": "x", "status": "y"},
        {"uri": None},
        {"locations": []},
        {"locations": None},
        {"locations": ["L", None], "period": "x"},
        {"period": "EVERY_WEEK", "status": "y"},
        {"period": "every_hour"},
        {"status": "PAUSED"},
        {"account_id": 0, "name": ""},
        {"account_id": None},
        {"locations": [""]},
    )
    assert by_request(batch.checked) == {
        0: "OK", 1: "REQUIRED", 2: "REQUIRED", 3: "REQUIRED", 4: "REQUIRED", 5: "REQUIRED",
        6: "LOCATIONS", 7: "PERIOD", 8: "PERIOD", 9: "STATUS", 10: "ACCOUNT", 11: "ACCOUNT",
        12: "OK",
    }
    assert batch.created.count() + batch.rejected.count() == 13
    assert values(batch.rejected.filter("message IS NULL")) == []


def test_defaults(spark):
    batch = check(spark, {"period": None, "status": None, "account_id": None}, default=9)
    row = batch.created.collect()[0]
    assert (row.period, row.status, row.account_id) == ("EVERY_15_MINUTES", "ENABLED", 9)
    assert (row.type, row.locations.public) == ("SIMPLE_BROWSER", ["L1", "L2"])


def test_malformed_tags_are_dropped(spark):
    def tags(*pairs):
        return {"tags": [{"key": k, "value": v} for k, v in pairs]}

    batch = check(
        spark, tags(("a", "1"), ("b", None), (None, "c"), ("a", "2")), tags(("b", None)), {}, tags()
    )
    kept = {r.req_id: r.tags and [tuple(t) for t in r.tags] for r in batch.created.collect()}
    assert kept == {0: [("a", "1"), ("a", "2")], 1: None, 2: None, 3: None}


def test_created_monitors_join_the_catalog(spark, fixtures, tmp_path):
    created = check(spark, {}, {"name": "second"}, {"name": ""}).created
    for _ in range(2):
        append_rows(created, str(tmp_path / "monitors"))
    stored = spark.read.parquet(str(tmp_path / "monitors"))
    assert stored.count() == 4
    catalog = union_kinds([fixtures.dashboards, as_entities(stored)])
    listed = list_monitors(catalog, 3).rows
    assert values(listed, "name", "monitor_type", "period") == [
        ("m", "SIMPLE_BROWSER", "EVERY_HOUR"), ("second", "SIMPLE_BROWSER", "EVERY_HOUR"),
    ]


@pytest.mark.parametrize("period", ["EVERY_MINUTE", "EVERY_5_MINUTES", "EVERY_DAY"])
def test_valid_periods(spark, period):
    assert outcomes(check(spark, {"period": period}).checked) == {"OK": 1}


def test_outcomes_of_the_sample(fixtures):
    assert outcomes(check_monitors(fixtures.monitor_request).checked) == {
        "OK": 161, "REQUIRED": 23, "LOCATIONS": 18, "PERIOD": 21, "STATUS": 27,
    }


def test_checking_needs_no_shuffle(fixtures):
    batch = check_monitors(fixtures.monitor_request)
    text = batch.created._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_each_accepted_request_has_a_monitor_of_its_own(spark):
    schema = "req_id long, account_id int, name string, uri string, locations array<string>, period string, status string, tags array<struct<key: string, value: string>>"
    asked = [(1, 7, "a|b", "c"), (2, 7, "a", "b|c"), (3, 7, "a", "b|c")]
    requests = spark.createDataFrame([(*a, ["X"], None, None, None) for a in asked], schema)
    created = check_monitors(requests).created
    assert as_entities(created.unionByName(created)).count() == 3

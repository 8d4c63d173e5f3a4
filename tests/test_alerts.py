from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsq.errors import AccountRequired, RequestError
from obsq.functions.accounts import ALL_ACCOUNTS
from obsq.operators import accounts, acknowledge, alerts
from obsq.operators.paging import NEWEST_INCIDENT, Listing
from obsq.plans import skew
from obsq.sources.tables import append_rows
from obsq.workspace import Workspace
from tests.helpers import entities, first_plan, outcomes, table, values


def minute(m):
    return datetime(2024, 1, 1, 0, m)


def incident(number, state="OPEN", account=1, **other):
    return {
        "incident_id": number, "state": state, "account_id": account, "priority": "INFO",
        "title": f"t{number}", "entity_guid": "a", "started_at": minute(0), **other,
    }


@pytest.fixture(scope="module")
def incidents(spark):
    return table(
        spark,
        "incident",
        incident(1, priority="CRITICAL"),
        incident(2, "CLOSED"),
        incident(3, entity_guid="gone", started_at=minute(9)),
        incident(4, account=2),
        incident(5, "ACKNOWLEDGED"),
        incident(6, account=0),
    )


@pytest.fixture(scope="module")
def catalog(spark):
    return entities(spark, {"guid": "a", "name": "A"})


def test_open_incidents_of_an_account(incidents, catalog):
    listed = alerts.list_open_incidents(incidents, catalog, 1)
    rows = values(listed.rows, "incident_id", "entity.name")
    assert rows == [(1, "A"), (3, None)]
    everywhere = alerts.list_open_incidents(incidents, catalog, ALL_ACCOUNTS)
    assert values(everywhere.rows, "incident_id") == [1, 3, 4, 6]
    newest = alerts.list_open_incidents(incidents, catalog, [1, 2], limit=2)
    assert [r.incident_id for r in newest.rows.collect()] == [3, 4]
    cursor = newest.next_cursor.collect()[0]
    assert [r.incident_id for r in newest.after(*cursor).rows.collect()] == [1]
    with pytest.raises(AccountRequired):
        alerts.list_open_incidents(incidents, catalog, 0)


def test_priority_in_any_case(incidents, catalog):
    for text in ("critical", "CRITICAL", "Critical"):
        listed = alerts.list_open_incidents(incidents, catalog, 1, text)
        assert values(listed.rows, "incident_id") == [1]
    assert values(alerts.list_open_incidents(incidents, catalog, 1, "info").rows, "incident_id") == [3]
    assert alerts.list_open_incidents(incidents, catalog, 1, "").rows.count() == 2
    with pytest.raises(RequestError):
        alerts.list_open_incidents(incidents, catalog, 1, "urgent")


def test_incident_pages_make_up_the_whole(fixtures):
    listed = alerts.list_open_incidents(
        fixtures.incident, fixtures.entity, ALL_ACCOUNTS, "critical", limit=800
    )
    order = NEWEST_INCIDENT.columns()
    whole = Listing(listed.matches, NEWEST_INCIDENT).rows.orderBy(*order)
    expected = [r.incident_id for r in whole.collect()]
    seen, page = [], listed
    while True:
        seen += [r.incident_id for r in page.rows.collect()]
        cursor = page.next_cursor.collect()[0]
        if cursor.incident_id is None:
            break
        page = page.after(*cursor)
    assert seen == expected and len(seen) > 800


def test_policies_by_name(spark):
    policies = table(
        spark,
        "policy",
        {"policy_id": 1, "name": "Golden AUTO 100%", "account_id": 1},
        {"policy_id": 2, "name": "other", "account_id": 1},
        {"policy_id": 3, "name": "autos", "account_id": 2},
    )
    assert values(alerts.list_policies(policies, 1, "auto").rows, "policy_id") == [1]
    assert values(alerts.list_policies(policies, ALL_ACCOUNTS, "Auto").rows, "policy_id") == [1, 3]
    assert values(alerts.list_policies(policies, 1, "0%").rows, "policy_id") == [1]
    assert values(alerts.list_policies(policies, 1, "_").rows, "policy_id") == []
    assert values(alerts.list_policies(policies, 1, "").rows, "policy_id") == [1, 2]
    assert alerts.list_policies(policies, 1, limit=1).with_total().collect()[0].total_count == 2


def ack(req, number, at=0, account=1, **other):
    return {
        "req_id": req, "incident_id": number, "account_id": account,
        "acknowledged_at": minute(at), "acknowledged_by": f"u{req}", **other,
    }


@pytest.fixture(scope="module")
def requests(spark):
    return table(
        spark,
        "incident_ack",
        ack(1, 1, at=5),
        ack(2, 1, at=4, message=""),
        ack(3, 1, at=4),
        ack(4, 2),
        ack(5, 99),
        ack(6, -1),
        ack(7, 0),
        ack(8, None),
        ack(9, 4),
        ack(10, 4, account=2, at=30, message="mine"),
        ack(11, 6, account=0),
        ack(12, 3, account=None),
        ack(13, 5),
    )


EXPECTED = {
    1: "ALREADY_ACKED", 2: "OK", 3: "ALREADY_ACKED", 4: "NOT_OPEN", 5: "NOT_FOUND",
    6: "INVALID_ID", 7: "INVALID_ID", 8: "INVALID_ID", 9: "NOT_FOUND", 10: "OK",
    11: "ACCOUNT", 12: "ACCOUNT", 13: "NOT_OPEN",
}


def test_acknowledgement_rules(requests, incidents):
    done = acknowledge.acknowledge(requests, incidents)
    rows = {r.req_id: r for r in done.collect()}
    assert {k: r.outcome for k, r in rows.items()} == EXPECTED
    assert (rows[2].state, rows[2].title, rows[2].message) == ("ACKNOWLEDGED", "t1", None)
    assert (rows[4].state, rows[4].title) == ("CLOSED", None)
    with_default = acknowledge.acknowledge(requests, incidents, default_account=1)
    assert outcomes(with_default.filter("req_id = 12")) == {"OK": 1}


def test_incident_ids_over_all_accounts(requests, incidents):
    done = {r.req_id: r.outcome for r in acknowledge.acknowledge(
        requests, incidents, match_account=False).collect()}
    assert (done[9], done[10]) == ("OK", "ALREADY_ACKED")


def test_the_log_is_the_state(spark, requests, incidents, tmp_path):
    log_path = str(tmp_path / "log")
    done = acknowledge.acknowledge(requests, incidents, default_account=1)
    append_rows(acknowledge.accepted(done), log_path)
    append_rows(acknowledge.accepted(done), log_path)
    log = spark.read.parquet(log_path)
    assert log.count() == 6

    now = acknowledge.current_incidents(incidents, log)
    states = {r.incident_id: (r.state, r.acknowledged_by) for r in now.collect()}
    assert states == {
        1: ("ACKNOWLEDGED", "u2"), 2: ("CLOSED", None), 3: ("ACKNOWLEDGED", "u12"),
        4: ("ACKNOWLEDGED", "u10"), 5: ("ACKNOWLEDGED", None), 6: ("OPEN", None),
    }
    # The raw requests give the same states as the accepted ones.
    raw = acknowledge.current_incidents(incidents, requests, default_account=1)
    assert values(raw) == values(now)
    assert values(acknowledge.still_open(incidents, log), "incident_id") == [6]
    again = acknowledge.acknowledge(requests, now.drop("acknowledged_by", "acknowledged_at"))
    assert "OK" not in outcomes(again)


def test_workspace_uses_the_log(spark, requests, incidents, catalog):
    workspace = Workspace(
        spark, {"incident": incidents, "entity": catalog, "incident_ack": requests}, 1
    )
    assert values(workspace.list_open_incidents().rows, "incident_id") == []
    assert "OK" not in outcomes(workspace.acknowledge(requests))
    without = Workspace(spark, {"incident": incidents, "entity": catalog}, 1)
    assert values(without.list_open_incidents().rows, "incident_id") == [1, 3]
    assert outcomes(without.acknowledge(requests))["OK"] == 3


def test_a_folded_log_stands_in_for_the_log(requests, incidents):
    folded = acknowledge.folded_log(requests, 1)
    keys = ["account_id", "incident_id"]
    assert folded.count() == folded.select(keys).distinct().count() < requests.count()
    now = acknowledge.current_incidents(incidents, requests, 1)
    assert values(acknowledge.current_incidents(incidents, folded, 1)) == values(now)
    assert values(acknowledge.folded_log(folded, 1)) == values(folded)
    assert folded.columns == acknowledge.LOG_FIELDS
    again = acknowledge.acknowledge_again(requests, incidents, folded, 1)
    assert values(again) == values(acknowledge.acknowledge(requests, incidents, 1))


def test_a_logged_batch_judged_again_has_its_outcomes(spark, requests, incidents, catalog):
    done = acknowledge.acknowledge(requests, incidents, default_account=1)
    log = acknowledge.accepted(done)
    tables = {"incident": incidents, "entity": catalog, "incident_ack": log}
    again = Workspace(spark, tables, 1).acknowledge(requests, rerun=True)
    assert values(again) == values(done)
    # another batch finds the incidents taken
    later = requests.withColumn("req_id", F.col("req_id") + 1000)
    others = outcomes(Workspace(spark, tables, 1).acknowledge(later, rerun=True))
    assert "OK" not in others and "ALREADY_ACKED" not in others
    # before anything was logged a rerun is a first run
    empty = {**tables, "incident_ack": log.limit(0)}
    assert values(Workspace(spark, empty, 1).acknowledge(requests, rerun=True)) == values(done)


log_entry = st.tuples(
    st.integers(-1, 6), st.sampled_from([None, 0, 1, 2]), st.integers(0, 3)
)


@settings(
    max_examples=5, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True
)
@given(
    st.lists(log_entry, min_size=1, max_size=40),
    st.lists(st.sampled_from(["OPEN", "CLOSED"]), min_size=5, max_size=5),
)
def test_outcomes_match_a_plain_replay(spark, log, states):
    """Requests replayed one by one, against the same as a table."""
    base = {(1 + i % 2, i): state for i, state in enumerate(states)}
    expected, taken = {}, set()
    numbered = sorted(enumerate(log), key=lambda e: (e[1][2], e[0]))
    for req, (number, account, _) in numbered:
        account = 1 if account is None else account
        if account == 0:
            outcome = "ACCOUNT"
        elif number <= 0:
            outcome = "INVALID_ID"
        elif (account, number) not in base:
            outcome = "NOT_FOUND"
        elif base[account, number] != "OPEN":
            outcome = "NOT_OPEN"
        elif (account, number) in taken:
            outcome = "ALREADY_ACKED"
        else:
            outcome = "OK"
            taken.add((account, number))
        expected[req] = outcome
    incidents = table(
        spark, "incident", *[incident(n, s, a) for (a, n), s in base.items()]
    ).coalesce(1)
    requests = table(
        spark, "incident_ack", *[ack(r, n, t, a) for r, (n, a, t) in enumerate(log)]
    ).coalesce(1)
    done = acknowledge.acknowledge(requests, incidents, default_account=1)
    assert {r.req_id: r.outcome for r in done.collect()} == expected
    remaining = acknowledge.still_open(incidents, requests, default_account=1)
    still = {(r.account_id, r.incident_id) for r in remaining.collect()}
    assert still == {k for k, s in base.items() if s == "OPEN"} - taken


def test_outcomes_of_the_sample(fixtures):
    done = acknowledge.acknowledge(
        fixtures.incident_ack, fixtures.incident, default_account=7, match_account=False
    )
    assert outcomes(done) == {
        "OK": 1656, "ALREADY_ACKED": 997, "NOT_OPEN": 5345, "NOT_FOUND": 1000, "INVALID_ID": 1002,
    }


def test_a_hot_incident_is_spread_over_tasks(spark, conf):
    """Nine of ten requests are for one incident, the rest for others."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    requests = spark.range(0, 20000, 1, 4).selectExpr(
        "id AS req_id",
        "if(id % 10 = 0, id, 7L) AS incident_id",
        "1 AS account_id",
        "CAST(NULL AS string) AS message",
        "'u' AS acknowledged_by",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS acknowledged_at",
    )
    incidents = spark.range(30000).selectExpr(
        "id AS incident_id", "'OPEN' AS state", "1 AS account_id", "'t' AS title"
    )
    done = acknowledge.acknowledge(requests, incidents)
    assert outcomes(done) == {"OK": 2000, "ALREADY_ACKED": 17999, "INVALID_ID": 1}

    counts = requests.groupBy("incident_id").agg(F.count("*").alias("n"))
    hot = skew.hot_keys(counts, ["incident_id"], "n").collect()
    assert [(r.incident_id, r._pieces) for r in hot] == [(7, 8)]
    keyed = skew.salted_left_join(
        requests, incidents.select("incident_id", "state"), ["incident_id"], "req_id", counts, "n"
    )
    assert keyed.filter("state = 'OPEN'").count() == 20000
    assert "_salt" in first_plan(keyed)


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(800).selectExpr("id", "CAST(NULL AS bigint) AS k")
    lookup = spark.createDataFrame([(1, "x")], "k bigint, v string")
    counts = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    joined = skew.salted_left_join(rows, lookup, ["k"], "id", counts, "n", F.col("k").isNotNull())
    assert joined.count() == 800 and joined.filter("v IS NOT NULL").count() == 0


def test_account_lookup_and_resolution(spark):
    requests = spark.createDataFrame(
        [(1, 5), (2, None), (3, 0), (4, 99)], "req_id int, account_id int"
    )
    known = table(spark, "account", {"account_id": 5, "name": "five"}, {"account_id": 0, "name": "z"})
    assert values(accounts.lookup_accounts(requests, known), "req_id", "name", "outcome") == [
        (1, "five", "OK"), (2, None, "ACCOUNT"), (3, None, "ACCOUNT"), (4, None, "NOT_FOUND"),
    ]
    resolved = accounts.resolve_accounts(requests, 7)
    assert values(resolved, "req_id", "account_id", "outcome") == [
        (1, 5, "OK"), (2, 7, "OK"), (3, None, "ACCOUNT"), (4, 99, "OK"),
    ]
    assert outcomes(accounts.resolve_accounts(requests, None)) == {"OK": 2, "ACCOUNT": 2}
    assert values(Workspace(spark, {"account": known}, 5).account_details()) == [(5, "five")]
    assert Workspace(spark, {"account": known}, 6).account_details().count() == 0
    with pytest.raises(AccountRequired):
        Workspace(spark, {"account": known}, 0).account_details()


def test_only_a_page_of_incidents_meets_the_catalog(fixtures):
    listed = alerts.list_open_incidents(fixtures.incident, fixtures.entity, ALL_ACCOUNTS, limit=100)
    for keys_only in (listed.total, listed.next_cursor):
        assert "entity_guid" not in first_plan(keys_only)
    # every join with the catalog has the limit below it
    joined = listed.rows._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("GlobalLimit 100") >= 2
    assert joined.index("GlobalLimit 100") < joined.index("LeftOuter")
    below = joined[joined.index("LeftOuter"):]
    assert below.index("GlobalLimit 100") < below.index("LeftSemi")
    page = [tuple(r) for r in listed.rows.select("incident_id", "entity.guid").collect()]
    whole = alerts.list_open_incidents(fixtures.incident, fixtures.entity, ALL_ACCOUNTS).rows
    newest = whole.orderBy(F.desc("started_at"), F.desc("incident_id")).limit(100)
    assert page == [tuple(r) for r in newest.select("incident_id", "entity.guid").collect()]

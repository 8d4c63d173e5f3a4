from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsq.errors import AccountRequired, RequestError
from obsq.operators import events
from obsq.operators.events import EventQuery
from obsq.workspace import Workspace
from tests.helpers import first_plan, plan, table, values

HOUR = timedelta(hours=1)
START = datetime(2024, 1, 1)


def n():
    return F.count("*").alias("n")


def at(hours, **other):
    return {"ts": START + timedelta(hours=hours), "event_type": "view", **other}


def test_window_is_half_open(spark):
    rows = table(spark, "event", *[at(h, event_id=h) for h in range(5)])
    kept = events.scan_events(rows, None, START + HOUR, START + 3 * HOUR)
    assert values(kept, "event_id") == [1, 2]
    with pytest.raises(RequestError):
        events.scan_events(rows, None, START, START)
    with pytest.raises(RequestError):
        events.scan_events(rows, [])


def test_window_and_types_reach_the_files(fixtures):
    text = plan(EventQuery(fixtures.event, [n()], ["view", "click"], START, START + HOUR).rows)
    assert "In(event_type, [click,view])" in text.replace("[view,click]", "[click,view]")
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


def test_attribute_facet_and_missing_attribute(spark):
    rows = table(
        spark, "event", at(0, props='{"k": 1}'), at(0, props='{"k": 1, "a b": "x"}'), at(0, props="no")
    )
    assert values(events.facet(rows, [n()], [events.attribute("k")])) == [("1", 2), (None, 1)]
    assert ("x", 1) in values(events.facet(rows, [n()], [events.attribute("a b")]))


def test_total_is_right_for_averages_and_distinct_counts(spark):
    rows = table(
        spark,
        "event",
        at(0, user_id=1, value=1.0),
        at(0, user_id=1, value=2.0),
        at(0, user_id=1, value=9.0, event_type="click"),
        at(0, user_id=2, value=0.0, event_type=None),
    )
    users = F.countDistinct("user_id").alias("users")
    mean = F.avg("value").alias("mean")
    got = events.facet_with_total(rows, [users, mean], ["event_type"])
    assert values(got) == sorted(
        [("view", 0, 1, 1.5), ("click", 0, 1, 9.0), (None, 0, 1, 0.0), (None, 1, 2, 3.0)], key=str
    )
    by_two = events.facet_with_total(rows, [n()], ["event_type", "user_id"])
    assert values(by_two.filter("is_total = 1"), "event_type", "user_id", "n") == [(None, None, 4)]
    assert by_two.count() == 4
    with pytest.raises(RequestError):
        events.facet_with_total(rows, [n()], [])


def test_bucket_origin(spark):
    rows = table(spark, "event", at(0), at(24 * 3 + 23))
    week = timedelta(days=7)
    epoch = events.timeseries(rows, [n()], week)
    assert values(epoch, "bucket_start") == [datetime(2023, 12, 28), datetime(2024, 1, 4)]
    monday = events.timeseries(rows, [n()], week, origin=datetime(2024, 1, 1))
    assert values(monday, "bucket_start", "n") == [(datetime(2024, 1, 1), 2)]
    for bucket in (timedelta(0), timedelta(milliseconds=1500), -HOUR):
        with pytest.raises(RequestError):
            events.timeseries(rows, [n()], bucket)


def test_empty_buckets_by_facet(spark):
    rows = table(spark, "event", at(1.5), at(1.6), at(3.2), at(2.5, event_type=None), at(9))
    filled = events.timeseries_filled(
        rows, [n(), F.sum("value").alias("v")], HOUR, START + HOUR / 2, START + 4.5 * HOUR,
        ["event_type"],
    )
    counts = {(r.bucket_start.hour, r.event_type): r.n for r in filled.collect()}
    assert counts == {
        (0, "view"): 0, (1, "view"): 2, (2, "view"): 0, (3, "view"): 1, (4, "view"): 0,
        (0, None): 0, (1, None): 0, (2, None): 1, (3, None): 0, (4, None): 0,
    }
    assert {(r.bucket_end - r.bucket_start) for r in filled.collect()} == {HOUR}
    assert values(filled.filter("n = 0"), "v")[0] == 0


def test_empty_buckets_without_facets(spark):
    rows = table(spark, "event", at(1.5), at(3.2))
    filled = events.timeseries_filled(rows, [n()], HOUR, START, START + 5 * HOUR)
    assert [(r.bucket_start.hour, r.n) for r in filled.orderBy("bucket_start").collect()] == [
        (0, 0), (1, 1), (2, 0), (3, 1), (4, 0),
    ]
    nothing = events.timeseries_filled(rows.filter("false"), [n()], HOUR, START, START + 2 * HOUR)
    assert values(nothing, "n") == [0, 0]


@settings(
    max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True
)
@given(
    st.lists(
        st.tuples(st.integers(0, 600), st.sampled_from(["x", "y", None])), min_size=1, max_size=30
    ),
    st.integers(7, 90),
)
def test_filling_matches_a_plain_count(spark, points, minutes):
    begin, end = START + timedelta(minutes=60), START + timedelta(minutes=500)
    rows = table(
        spark, "event",
        *[{"ts": START + timedelta(minutes=m), "event_type": f} for m, f in points],
    ).coalesce(1)
    size = timedelta(minutes=minutes)
    filled = events.timeseries_filled(rows, [n()], size, begin, end, ["event_type"])
    got = {(r.bucket_start, r.event_type): r.n for r in filled.collect()}

    def start_of(moment):
        return moment - (moment - datetime(1970, 1, 1)) % size

    inside = [(START + timedelta(minutes=m), f) for m, f in points]
    inside = [(t, f) for t, f in inside if begin <= t < end]
    expected = {}
    for facet in {f for _, f in inside}:
        slot = start_of(begin)
        while slot < end:
            expected[(slot, facet)] = sum(1 for t, f in inside if f == facet and start_of(t) == slot)
            slot += size
    assert got == expected


def test_comparison_periods(spark):
    rows = table(
        spark, "event", at(1), at(2), at(25), at(26, event_type="click"), at(48, event_type="late")
    )
    day = timedelta(days=1)
    got = events.compare(rows, [n()], START + day, START + 2 * day, day, ["event_type"])
    assert values(got) == [("click", 1, None), ("view", 1, 2)]
    hourly = events.compare(rows, [n()], START + day, START + 2 * day, day, (), HOUR)
    assert [
        (r.bucket_start, r.current_n, r.previous_n) for r in hourly.orderBy("bucket_start").collect()
    ] == [
        (START + 25 * HOUR, 1, 1),
        (START + 26 * HOUR, 1, 1),
    ]
    with pytest.raises(RequestError):
        events.compare(rows, [n()], START, START + day, timedelta(0))


def test_overlapping_and_distant_comparison(spark):
    rows = table(spark, "event", *[at(h) for h in range(10)])
    overlap = events.compare(rows, [n()], START + 4 * HOUR, START + 8 * HOUR, HOUR)
    assert values(overlap) == [(4, 4)]
    distant = events.compare(rows, [n()], START + 8 * HOUR, START + 10 * HOUR, 7 * HOUR)
    assert values(distant) == [(2, 2)]


def test_description(spark):
    rows = table(spark, "event", at(0), at(1, event_type="click"), at(2, event_type="click"))
    query = EventQuery(
        rows, [n()], ["view", "click", "none"], START + HOUR, START + 9 * HOUR,
        facets=["event_type", events.attribute("k")], compare_back=HOUR,
    )
    described = query.metadata.collect()[0]
    assert described.event_types == ["click"]
    assert described.facets == ["event_type", "k"]
    assert (described.window_begin, described.compare_with) == (START + HOUR, START)
    open_ended = EventQuery(rows, [n()]).metadata.collect()[0]
    assert (open_ended.facets, open_ended.window_end) == ([], None)


def test_facets_add_up_to_the_total(fixtures):
    query = EventQuery(fixtures.event, [n()], facets=["event_type", "user_id"])
    assert query.rows.agg(F.sum("n")).collect()[0][0] == query.total.collect()[0].n == 10000


def test_unusable_queries(spark):
    rows = table(spark, "event", at(0))
    for wrong in (
        {"aggregates": []},
        {"aggregates": [n()], "fill": True},
        {"aggregates": [n()], "fill": True, "bucket": HOUR},
        {"aggregates": [n()], "compare_back": HOUR},
    ):
        with pytest.raises(RequestError):
            EventQuery(rows, **wrong)


def test_queries_are_scoped_to_an_account(spark):
    rows = table(spark, "event", at(0, account_id=1), at(1, account_id=2), at(1, account_id=2))
    workspace = Workspace(spark, {"event": rows}, default_account=2)
    assert values(workspace.event_query([n()]).rows, "n") == [2]
    assert values(workspace.event_query([n()], account=1).rows, "n") == [1]
    with pytest.raises(AccountRequired):
        workspace.event_query([n()], account=0)


def test_filled_and_compared_events_are_read_once(fixtures):
    begin = datetime(2024, 1, 10)
    for query in (
        EventQuery(fixtures.event, [n()], None, begin, begin + 9 * HOUR, ["event_type"], HOUR, fill=True),
        EventQuery(fixtures.event, [n()], None, begin, begin + HOUR, ["event_type"], compare_back=HOUR),
    ):
        assert plan(query.rows).count("FileScan") == 1


def test_attribute_with_a_quote(spark):
    rows = spark.createDataFrame([('{"it\'s": 5, "k": 1}',), ("{}",), (None,)], "props string")
    got = [tuple(r) for r in rows.select(events.attribute("it's"), events.attribute("k")).collect()]
    assert got == [("5", "1"), (None, None), (None, None)]


def test_empty_buckets_of_other_measures(spark):
    rows = table(spark, "event", at(0, value=-5.0, props="a"), at(2, value=-2.0, props="b"))
    measures = [n(), F.max("value").alias("top"), F.max("props").alias("text")]
    for facets in ((), ("event_type",)):
        query = EventQuery(rows, measures, None, START, START + 3 * HOUR, facets, HOUR, fill=True)
        got = query.rows.orderBy("bucket_start").select("n", "top", "text").collect()
        assert [tuple(r) for r in got] == [(1, -5.0, "a"), (0, None, None), (1, -2.0, "b")]


def test_long_gaps_of_short_buckets(spark):
    days = 20
    rows = table(spark, "event", at(0), at(24 * days - 1))
    filled = events.timeseries_filled(
        rows, [n()], timedelta(seconds=1), START, START + timedelta(days=days), ["event_type"]
    )
    got = filled.agg(F.count("*"), F.countDistinct("bucket_start"), F.sum("n")).first()
    assert tuple(got) == (days * 86400, days * 86400, 2)


def test_filled_instants_keep_to_one_grid(spark, conf):
    conf(spark__sql__session__timeZone="Asia/Kolkata")
    rows = spark.sql(
        "SELECT explode(array(timestamp'2024-01-01 00:10:00', timestamp'2024-01-01 02:50:00')) AS ts, 'x' AS event_type"
    )
    filled = events.timeseries_filled(rows, [n()], HOUR, START, START + 3 * HOUR, ["event_type"])
    got = filled.orderBy("bucket_start").selectExpr("date_format(bucket_start, 'HH:mm')", "n").collect()
    assert [tuple(r) for r in got] == [("23:30", 1), ("00:30", 0), ("01:30", 0), ("02:30", 1)]


def test_total_beside_buckets_and_comparisons(spark):
    rows = table(spark, "event", at(0, user_id=1), at(1, user_id=1), at(1, user_id=2))
    users = F.countDistinct("user_id").alias("users")
    for fill in (False, True):
        query = EventQuery(rows, [users], None, START, START + 2 * HOUR, (), HOUR, fill=fill)
        got = query.with_total.select("bucket_start", "is_total", "users")
        assert values(got) == sorted([(START, 0, 1), (START + HOUR, 0, 2), (None, 1, 2)], key=str)
    compared = EventQuery(rows, [n()], None, START + HOUR, START + 2 * HOUR, ["event_type"], compare_back=HOUR)
    assert values(compared.with_total, "event_type", "is_total", "current_n", "previous_n") == sorted(
        [("view", 0, 2, 1), (None, 1, 2, 1)], key=str
    )


@pytest.mark.parametrize("form", [
    {"bucket": timedelta(hours=6), "fill": True, "facets": ["event_type"]},
    {"compare_back": timedelta(days=2), "facets": ["event_type"]},
    {"compare_back": timedelta(hours=6), "bucket": timedelta(hours=3), "facets": ["event_type", "account_id"]},
    {"compare_back": timedelta(hours=6), "bucket": timedelta(hours=3)},
])
def test_totals_come_from_the_scan_of_the_rows(fixtures, form):
    users = F.countDistinct("user_id").alias("users")
    window = {"begin": datetime(2024, 1, 10), "end": datetime(2024, 1, 12)}
    query = events.EventQuery(fixtures.event, [n(), users], **window, **form)
    both = query.with_total
    rows, totals = both.filter("is_total = 0").drop("is_total"), both.filter("is_total = 1")
    assert values(rows.select(query.rows.columns)) == values(query.rows)
    plain = events.EventQuery(fixtures.event, [n(), users], **window, compare_back=form.get("compare_back"))
    measures = plain.rows.columns
    assert values(totals.select(measures)) == values(plain.rows) and totals.count() == 1
    assert first_plan(both).count("FileScan") == 1

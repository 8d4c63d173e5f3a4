"""Answers from rollups beside those from the events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.operators.events import EventQuery
from obsq.operators.rollups import Rollup
from tests.helpers import values

HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def host():
    return F.get_json_object("props", "$['k']").alias("host")


@pytest.fixture(scope="module")
def rollup(spark, fixtures, tmp_path_factory):
    made = Rollup(spark, str(tmp_path_factory.mktemp("r") / "rollup"), HOUR, [host()], ["value"], ["user_id"])
    late = F.col("event_id") % 3 == 0
    made.add(fixtures.event.filter(~late), "first")
    made.add(fixtures.event.filter(late), "late")
    made.add(fixtures.event.filter(late), "late")
    return made


def exact():
    value = F.col("value")
    return [
        F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("least"), F.max(value).alias("most"),
    ]


def merged(r):
    return [
        r.count().alias("n"), F.round(r.total("value"), 4).alias("total"), F.round(r.mean("value"), 6).alias("mean"),
        r.least("value").alias("least"), r.most("value").alias("most"),
    ]


@pytest.mark.parametrize("question", [
    {},
    {"facets": ["event_type"]},
    {"facets": ["event_type"], "bucket": DAY, "begin": datetime(2024, 1, 3), "end": datetime(2024, 1, 9, 5)},
    {"facets": ["host", "account_id"], "event_types": ["click", "view"]},
    {"begin": datetime(2024, 1, 10), "end": datetime(2024, 1, 12), "compare_back": 3 * HOUR, "facets": ["event_type"]},
    {"begin": datetime(2024, 1, 10), "end": datetime(2024, 1, 12), "bucket": 6 * HOUR, "fill": True, "facets": ["event_type"]},
])
def test_exact_measures_are_the_same(rollup, fixtures, question):
    events = fixtures.event.withColumn("host", F.get_json_object("props", "$['k']"))
    want, got = EventQuery(events, exact(), **question), rollup.query(merged(rollup), **question)
    assert got.rows.columns == want.rows.columns and values(got.rows) == values(want.rows)
    if question.get("facets"):
        assert values(got.with_total) == values(want.with_total)
    assert values(got.total) == values(want.total)


def test_sketches_are_near(rollup, fixtures):
    by_type = rollup.query(
        [rollup.distinct_count("user_id").alias("users"), rollup.quantile("value", 0.5).alias("half"),
         rollup.quantile("value", 0.99).alias("most")], facets=["event_type"],
    )
    found = {r.event_type: r for r in by_type.with_total.collect()}
    for kind, row in found.items():
        events = fixtures.event if kind is None else fixtures.event.filter(F.col("event_type") == kind)
        users = events.agg(F.countDistinct("user_id")).first()[0]
        assert abs(row.users - users) <= 0.06 * users + 1
        for share, value in ((0.5, row.half), (0.99, row.most)):
            below = events.agg(F.avg((F.col("value") <= value).cast("double"))).first()[0]
            assert abs(below - share) < 0.03
    assert None in found and len(found) > 3


def test_rows_are_few_and_batches_count_once(rollup, fixtures, spark):
    rows = rollup.rows()
    assert rows.agg(F.sum("n")).first()[0] == fixtures.event.count()
    assert len(rollup.store.current().parts) == 2 and rollup.store.current().number == 2
    hours = fixtures.event.select(F.date_trunc("hour", "ts"), "event_type", "account_id", host()).distinct().count()
    assert rows.select("ts", "event_type", "account_id", "host").distinct().count() == hours


def test_questions_that_cut_buckets_are_errors(spark, rollup, tmp_path):
    n = [rollup.count().alias("n")]
    for question in (
        {"begin": datetime(2024, 1, 1, 0, 30)}, {"bucket": timedelta(minutes=90)}, {"end": datetime(2024, 1, 1, 0, 0, 1)},
        {"begin": datetime(2024, 1, 2), "end": datetime(2024, 1, 3), "compare_back": timedelta(minutes=30)},
    ):
        with pytest.raises(RequestError):
            rollup.query(n, **question)
    for measure in (lambda: rollup.total("price"), lambda: rollup.distinct_count("value")):
        with pytest.raises(RequestError):
            measure()
    with pytest.raises(RequestError):
        Rollup(spark, str(tmp_path / "none")).query(n)


def test_null_values(spark, tmp_path):
    events = spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, 1), "a", 1, None, None), (datetime(2024, 1, 1, 0, 2), None, None, None, 7)],
        "ts timestamp_ntz, event_type string, account_id int, value double, user_id long",
    )
    made = Rollup(spark, str(tmp_path / "r"), HOUR, [], ["value"], ["user_id"])
    made.add(events, "one")
    measures = [made.count().alias("n"), made.mean("value").alias("mean"), made.quantile("value", 0.5).alias("half"),
                made.distinct_count("user_id").alias("users")]
    assert values(made.query(measures, facets=["event_type"]).rows) == [("a", 1, None, None, 0), (None, 1, None, None, 1)]

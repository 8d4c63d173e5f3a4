"""Attributes and replies by way of VARIANT."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.operators.attributes import read_attribute_events, variant_attribute, write_attribute_events
from obsq.operators.events import EventQuery, attribute
from obsq.operators.replies import parse_replies
from obsq.operators.typed_replies import reply_schema, typed_rows
from tests.helpers import first_plan, table, values

NOON = datetime(2024, 1, 1, 12)
TEXTS = ['{"k": 1, "host": "a"}', '{"k": 2.5, "n": {"x": [1, 2]}}', '{"it\'s": true}', "no json", None, '{"k": null}', "[1]"]


@pytest.fixture
def stored(spark, tmp_path):
    rows = table(spark, "event", *[{"event_id": i, "ts": NOON, "account_id": 1, "event_type": "a", "props": t} for i, t in enumerate(TEXTS)])
    write_attribute_events(rows, str(tmp_path / "event"))
    return read_attribute_events(spark, str(tmp_path / "event"))


def test_attributes_of_every_shape(stored):
    assert values(stored, "event_id", "props") == [(i, "no json" if i == 3 else None) for i in range(7)]
    found = values(stored.select("event_id", variant_attribute("k")))
    assert found == [(0, "1"), (1, "2.5"), *[(i, None) for i in range(2, 7)]]
    assert values(stored.select(variant_attribute("it's", "boolean")), "it's").count(True) == 1
    assert [r for r in values(stored.select(variant_attribute("n")), "n") if r] == ['{"x":[1,2]}']
    assert values(stored.select(variant_attribute("k", "double")), "k")[:2] == [1.0, 2.5]
    with pytest.raises(RequestError):
        variant_attribute("'\"")


def test_facets_are_those_of_the_text(spark, fixtures, tmp_path):
    write_attribute_events(fixtures.event, str(tmp_path / "event"))
    stored = read_attribute_events(spark, str(tmp_path / "event"))
    count = [F.count("*").alias("n")]
    want = EventQuery(fixtures.event, count, facets=[attribute("k")]).rows
    got = EventQuery(stored, count, facets=[variant_attribute("k")]).rows
    assert values(got) == values(want)
    # the scan gives the attribute, not the whole of them
    assert "attributes:struct<0:string" in first_plan(got).replace(" ", "")


def parsed(spark, *texts):
    archive = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "reply_id int, raw string")
    return parse_replies(archive, ["rows"])


def test_rows_get_the_type_they_share(spark):
    replies = parsed(
        spark,
        '{"data": {"rows": [{"a": 1, "b": {"c": "x"}, "none": null}, {"a": 2.5, "b": {"c": null, "d": [1]}}]}}',
        '{"data": {"rows": [{"a": 3, "reply_id": "own", "odd name`": "q"}]}, "errors": [{"message": "m"}]}',
        "not json", '{"data": null}',
    )
    rows = typed_rows(replies)
    assert dict(rows.dtypes)["a"].startswith("decimal") and dict(rows.dtypes)["none"] == "string"
    assert dict(rows.dtypes)["b"] == "struct<c:string,d:array<bigint>>"
    assert sorted(float(v) for v in values(rows, "a")) == [1.0, 2.5, 3.0]
    assert ("q", "own", 1) in values(rows.select(F.col("`odd name```"), "row_reply_id", "reply_id"))
    again = typed_rows(parsed(spark, '{"data": {"rows": [{"a": 9, "new": 1}, 5]}}'), reply_schema(replies))
    assert sorted(values(again, "a"), key=str) == [9, None]


def test_rows_of_no_common_type(spark):
    assert typed_rows(parsed(spark, '{"data": {"rows": [1, 2]}}')).dtypes[-1] == ("value", "bigint")
    mixed = typed_rows(parsed(spark, '{"data": {"rows": [{"a": 1}, "x", [1]]}}'))
    assert mixed.dtypes[-1] == ("value", "variant") and mixed.count() == 3
    varied = typed_rows(parsed(spark, '{"data": {"rows": [{"a": 1}, {"a": "x"}]}}'))
    assert dict(varied.dtypes)["a"] == "variant"
    assert typed_rows(parsed(spark, "nothing")).count() == 0

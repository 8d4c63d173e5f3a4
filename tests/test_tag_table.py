"""Searches by tag through the table of tags."""

import pytest

from obsq.errors import RequestError
from obsq.operators.bulk_search import search_entities_bulk
from obsq.operators.search import search_entities
from obsq.operators.tag_table import guids_with_tags, read_tags, search_by_tags, write_tags
from tests.helpers import entities, plan, table, values


def tag(key, value):
    return {"key": key, "value": value}


CATALOG = [
    {"guid": "A", "tags": [tag("env", "prod"), tag("env", "prod"), tag("team", "x")]},
    {"guid": "B", "tags": [tag("env", "prod"), tag("env", "test")]},
    {"guid": "C", "tags": [tag("Env", "prod"), tag("a/b=c", "ü %41"), tag("", "")]},
    {"guid": "D", "tags": None},
    {"guid": "E", "tags": [tag("env", None), tag(None, "prod")]},
    {"guid": "F"},
]


@pytest.fixture
def tags(spark, tmp_path):
    write_tags(entities(spark, *CATALOG), str(tmp_path / "tags"))
    return read_tags(spark, str(tmp_path / "tags"))


@pytest.mark.parametrize("wanted", [
    [tag("env", "prod")], [tag("env", "prod"), tag("env", "test")], [tag("env", "prod"), tag("env", "prod")],
    [tag("Env", "prod")], [tag("a/b=c", "ü %41")], [tag("", "")], [tag("nothing", "x")], [tag("team", "x"), {"key": "k"}],
])
def test_same_as_the_catalog(spark, tags, wanted):
    catalog = entities(spark, *CATALOG)
    want = values(search_entities(catalog, tags=wanted, limit=None).rows, "guid")
    assert values(guids_with_tags(tags, wanted), "guid") == want
    request = table(spark, "search_request", {"req_id": 1, "tags": [t for t in wanted if "value" in t]})
    assert values(search_by_tags(tags, catalog, request), "guid") == want


def test_many_requests(spark, tags):
    catalog = entities(spark, *CATALOG)
    asked = [[tag("env", "prod")]] * 3 + [[tag("env", "test"), tag("env", "prod")], [tag("x", "y")], [], None, [tag("env", None)]]
    requests = table(spark, "search_request", *[{"req_id": i, "tags": t} for i, t in enumerate(asked)])
    want = search_entities_bulk(catalog, requests).matches
    got = search_by_tags(tags, catalog, requests)
    assert values(got, "req_id", "guid", "name", "tags") == values(want, "req_id", "guid", "name", "tags")


def test_no_tags_is_an_error(tags):
    for wanted in ([], [{"key": "env"}]):
        with pytest.raises(RequestError):
            guids_with_tags(tags, wanted)


def test_only_folders_of_the_keys_are_opened(spark, tmp_path):
    many = [{"guid": f"G{i}", "tags": [tag(f"key{i % 40}", f"v{i % 3}")]} for i in range(400)]
    write_tags(entities(spark, *many), str(tmp_path / "tags"))
    tags = read_tags(spark, str(tmp_path / "tags"))
    single = guids_with_tags(tags, [tag("key7", "v1")])
    assert folders_read(single) == 1 and len(values(single, "guid")) == 4
    requests = table(spark, "search_request", *[{"req_id": i, "tags": [tag(f"key{i}", "v0")]} for i in range(2)])
    requests.write.parquet(str(tmp_path / "asked"))
    stored = spark.read.schema(requests.schema).parquet(str(tmp_path / "asked"))
    found = search_by_tags(tags, entities(spark, *many), stored)
    assert "dynamicpruning" in plan(found)
    assert folders_read(found) == 2 and len(values(found, "guid")) == 7


def folders_read(df):
    """Folders of the tag table that the scans of a plan opened."""
    df.collect()
    read, waiting = 0, [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    while waiting:
        node = waiting.pop()
        if "FileSourceScan" in node.getClass().getSimpleName() and "tag_key" in node.toString():
            read += node.metrics().apply("numPartitions").value()
        if "QueryStage" in node.getClass().getSimpleName():
            waiting.append(node.plan())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return read

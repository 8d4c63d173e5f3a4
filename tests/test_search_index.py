"""The kept search index beside the search of the catalog itself."""

import random
import re

import pytest

from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.operators import search_index
from obsq.operators.bulk_search import checked_requests, search_entities_bulk
from obsq.operators.search import search_entities
from obsq.operators.search_index import SearchIndex
from obsq.sources.published import PublishConflict
from obsq.workspace import Workspace
from tests.helpers import entities, plan, rows_scanned, table, values

NAMES = [
    "checkout", "check out", "cart", "", None, "a", "ab", "100%_sure", "100x_sure", "back\\slash", "aaa", "aaaa",
    "Ünïcode 🙂 name", "checkout-checkout", "tuo kcehc", "outcheck",
]
TAGS = [[], [{"key": "env", "value": "prod"}], [{"key": "a=b", "value": "c"}, {"key": "a", "value": "b=c"}], None]


def made_entities(n=90, seed=1):
    rng = random.Random(seed)
    return [
        {
            "guid": f"G{i}", "name": rng.choice(NAMES), "domain": rng.choice(["APM", "INFRA"]),
            "type": rng.choice(["APPLICATION", "HOST"]), "account_id": rng.choice([0, 1, 2, None]), "tags": rng.choice(TAGS),
        }
        for i in range(n)
    ]


def made_requests(n=120, seed=2):
    rng = random.Random(seed)
    names = [None, "", "check", "out", "k o", "a", "ab", "%", "_", "a%a", "1__", "\\", "🙂", "c_e%t", "aaa", "zzz", "CHECK"]
    return [
        {
            "req_id": i, "name": rng.choice(names), "domain": rng.choice([None, None, "APM", "", "VIZ"]),
            "type": rng.choice([None, None, "HOST"]), "account_id": rng.choice([None, None, 0, 1, 9]),
            "tags": rng.choice([*TAGS, [{"key": "env", "value": None}]]),
        }
        for i in range(n)
    ]


@pytest.fixture
def index(spark, tmp_path):
    return SearchIndex(spark, str(tmp_path / "index"))


def pairs(found):
    return values(found.matches, "req_id", "guid", "name", "account_id")


@pytest.mark.parametrize("shard_entities", [7, 1 << 16])
def test_answers_as_the_catalog_does(spark, index, monkeypatch, shard_entities):
    monkeypatch.setattr(search_index, "SHARD_ENTITIES", shard_entities)
    catalog = entities(spark, *made_entities())
    requests = table(spark, "search_request", *made_requests())
    index.build(catalog)
    want = search_entities_bulk(catalog, requests)
    got = index.search(requests)
    assert pairs(got) == pairs(want) and len(pairs(got)) > 300
    assert values(got.errors) == values(want.errors)
    assert values(got.totals) == values(want.totals)
    assert values(got.first(2), "req_id", "guid") == values(want.first(2), "req_id", "guid")


def test_requests_of_unknown_size(spark, index, conf):
    catalog, requests = entities(spark, *made_entities()), table(spark, "search_request", *made_requests())
    index.build(catalog)
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    assert pairs(index.search(requests)) == pairs(search_entities_bulk(catalog, requests))


def test_single_searches(spark, index):
    catalog = entities(spark, *made_entities())
    index.build(catalog)
    for arguments in [
        {"name": "check"}, {"name": "k_o%"}, {"domain": "APM", "account": 0}, {"entity_type": "HOST", "name": "a"},
        {"tags": [{"key": "a=b", "value": "c"}, {"key": "x"}]}, {"name": "%"}, {"name": "\\"}, {"name": "nowhere"},
    ]:
        want = search_entities(catalog, limit=None, **arguments)
        got = index.search_one(limit=None, **arguments)
        assert values(got.rows, "guid", "name") == values(want.rows, "guid", "name"), arguments
    assert [r.guid for r in index.search_one(domain="APM", limit=3).rows.collect()] == [
        r.guid for r in search_entities(catalog, domain="APM", limit=3).rows.collect()
    ]
    for nothing in ({}, {"name": ""}, {"account": 1}, {"tags": [{"key": "env"}]}):
        with pytest.raises(RequestError):
            index.search_one(**nothing)


def test_extended_changed_removed_and_compacted(spark, index):
    old, new = made_entities(60, 3), made_entities(80, 4)
    first = [{**row, "name": "former"} if i % 2 else row for i, row in enumerate(old)]
    removed = spark.createDataFrame([("G3",), ("G59",), ("unknown",)], "guid string")
    index.build(entities(spark, *first))
    index.extend(entities(spark, *new[40:]), removed)
    index.extend(entities(spark, *old[1:40:2]))
    current = {row["guid"]: row for row in first}
    for guid in ("G3", "G59"):
        del current[guid]
    current |= {row["guid"]: row for row in new[40:]} | {row["guid"]: row for row in old[1:40:2]}
    catalog = entities(spark, *current.values())
    requests = table(spark, "search_request", *made_requests())
    want = pairs(search_entities_bulk(catalog, requests))
    assert pairs(index.search(requests)) == want
    assert values(index.entities(), "guid") == sorted(current)
    before = index.store.current()
    index.compact()
    assert pairs(index.search(requests)) == want
    assert len(index.store.current().parts) == 3 < len(before.parts)
    index.store.vacuum()
    assert pairs(index.search(requests)) == want


def test_a_workspace_searches_its_index(spark, index):
    catalog, requests = entities(spark, *made_entities()), table(spark, "search_request", *made_requests(20))
    index.build(catalog)
    plain, indexed = Workspace(spark, {"entity": catalog}), Workspace(spark, {}, index=index)
    assert pairs(indexed.search_entities_bulk(requests)) == pairs(plain.search_entities_bulk(requests))
    for arguments in ({"name": "out", "domain": "APM"}, {"tags": [{"key": "env", "value": "prod"}], "account": 1}):
        want, got = plain.search_entities(**arguments), indexed.search_entities(**arguments)
        assert values(got.with_total(), "guid", "total_count") == values(want.with_total(), "guid", "total_count")


def test_empty_catalog_and_no_index(spark, index):
    requests = table(spark, "search_request", *made_requests(10))
    assert index.search(requests).matches.count() == 0
    index.build(entities(spark))
    assert index.search(requests).matches.count() == 0 and index.search_one(name="a").rows.count() == 0


def test_a_search_reads_postings_instead_of_the_catalog(spark, index):
    rows = [{"guid": f"G{i}", "name": f"service {i:05d}", "account_id": i % 7} for i in range(3000)]
    index.build(entities(spark, *rows))
    found = index.search_one(name="01234", limit=None)
    text = plan(found.rows)
    assert re.search(r"PushedFilters: \[[^\]]*In\(probe, \[", text) and values(found.rows, "guid") == ["G1234"]
    # pieces of names are read, none are made from the catalog
    assert "substring(name" not in text and "ReadSchema: struct<probe:string" in text


def test_row_groups_of_other_probes_are_skipped(spark, index, monkeypatch):
    small = {**search_index.POSTING_OPTIONS, "parquet.block.size": "65536"}
    monkeypatch.setattr(search_index, "POSTING_OPTIONS", small)
    rows = [{"guid": f"G{i}", "name": f"{i * 7919 % 100000:05d} {i * 104729 % 99991:05d}"} for i in range(20_000)]
    index.build(entities(spark, *rows))
    postings = index.store.open(index.store.current().of_kind("posting"), search_index.POSTING)
    lists = postings.filter(postings["probe"].isin(["name:012", "name:123", "name:234"]))
    assert lists.count() == 3 and rows_scanned(lists.select("numbers")) < postings.count() / 2


def test_six_letters_have_a_list_of_their_own(spark, index):
    rows = [{"guid": f"G{i}", "name": f"service {i:06d}"} for i in range(1500)]
    index.build(entities(spark, *rows))
    asked = [(1, "001234"), (2, "001234"), (2, "1499"), (3, "none")]
    requests = table(spark, "search_request", *[{"req_id": i, "name": name} for i, name in asked])
    valid, _ = checked_requests(requests)
    probes = valid.filter("req_id = 1").select(F.explode(search_index._asked()).alias("probe"))
    postings = index.store.open(index.store.current().of_kind("posting"), search_index.POSTING)
    # the list read for a search does not grow with the entities that share three letters with it
    assert values(postings.join(probes, "probe"), "probe", "n") == [("name:001234", 1)]
    assert values(index.search(requests).totals) == [(1, 1), (2, 2)]


def test_two_writers_of_one_version(spark, index, monkeypatch):
    index.build(entities(spark, *made_entities(5)))
    stale = index.store.current()
    index.extend(entities(spark, {"guid": "N1", "name": "late"}))
    monkeypatch.setattr(index.store, "current", lambda: stale)
    with pytest.raises(PublishConflict):
        index.extend(entities(spark, {"guid": "N2", "name": "later"}))
    monkeypatch.undo()
    assert "N2" not in values(index.entities(), "guid") and "N1" in values(index.entities(), "guid")

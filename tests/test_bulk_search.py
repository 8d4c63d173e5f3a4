import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.operators import bulk_search
from obsq.operators.bulk_search import search_entities_bulk
from obsq.operators.search import search_entities
from tests.helpers import entities, first_plan, table, values


def pairs(result):
    return values(result.matches, "req_id", "guid")


@pytest.fixture(scope="module")
def catalog(spark):
    env = [{"key": "env", "value": "prod"}, {"key": "env", "value": "prod"}]
    return entities(
        spark,
        {"guid": "a", "name": "checkout", "account_id": 0, "tags": env},
        {"guid": "b", "name": "check in", "account_id": 2, "tags": env},
        {"guid": "c", "name": "ab", "account_id": 2},
        {"guid": "d", "name": "", "account_id": 2, "domain": "INFRA", "type": "HOST"},
        {"guid": "e", "name": None, "account_id": 2, "tags": None},
        {"guid": "f", "name": "a\\b", "account_id": 3},
        {"guid": "g", "name": "aaaa", "account_id": 3},
    )


def test_each_kind_of_criterion(spark, catalog):
    requests = table(
        spark,
        "search_request",
        {"req_id": 1, "name": "check"},
        {"req_id": 2, "name": "check", "account_id": 0},
        {"req_id": 3, "name": "b"},
        {"req_id": 4, "name": "%"},
        {"req_id": 5, "name": "c_e%k i"},
        {"req_id": 6, "domain": "INFRA"},
        {"req_id": 7, "type": "APPLICATION", "account_id": 2},
        {"req_id": 8, "tags": [{"key": "env", "value": "prod"}]},
        {"req_id": 9, "tags": [{"key": "env", "value": "prod"}], "name": "in", "domain": "APM"},
        {"req_id": 10, "name": "a\\b"},
        {"req_id": 11, "name": "no such name"},
        {"req_id": 12, "name": "_", "account_id": 3},
        {"req_id": 13, "name": "aaa"},
    )
    assert pairs(search_entities_bulk(catalog, requests)) == sorted(
        [
            (1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "f"),
            (4, "a"), (4, "b"), (4, "c"), (4, "d"), (4, "f"), (4, "g"),
            (5, "b"), (6, "d"), (7, "b"), (7, "c"), (7, "e"), (8, "a"), (8, "b"),
            (9, "b"), (10, "f"), (12, "f"), (12, "g"), (13, "g"),
        ],
        key=str,
    )


def test_requests_without_a_criterion_are_errors(spark, catalog):
    requests = table(
        spark,
        "search_request",
        {"req_id": 1, "account_id": 2},
        {"req_id": 2, "name": "", "domain": "", "tags": []},
        {"req_id": 3, "tags": [{"key": "env", "value": None}]},
        {"req_id": 4, "name": "check"},
    )
    result = search_entities_bulk(catalog, requests)
    assert values(result.errors, "req_id") == [1, 2, 3]
    assert pairs(result) == [(4, "a"), (4, "b")]


def test_first_matches_and_totals(spark, catalog):
    requests = table(
        spark, "search_request", {"req_id": 1, "name": "%"}, {"req_id": 2, "name": "check"}
    )
    result = search_entities_bulk(catalog, requests)
    assert values(result.first(1), "req_id", "guid") == [(1, "a"), (2, "a")]
    assert values(result.totals) == [(1, 6), (2, 2)]
    with pytest.raises(RequestError):
        result.first(0)


text = st.text(alphabet="ab%_\\ ", max_size=5)
tag = st.fixed_dictionaries({"key": st.sampled_from("kl"), "value": st.sampled_from("vw")})
request = st.fixed_dictionaries(
    {
        "account_id": st.sampled_from([None, 0, 1]),
        "name": st.none() | text,
        "domain": st.sampled_from([None, "", "APM", "INFRA"]),
        "type": st.sampled_from([None, "HOST"]),
        "tags": st.none() | st.lists(tag, max_size=2),
    }
)
entity = st.fixed_dictionaries(
    {
        "account_id": st.sampled_from([0, 1]),
        "name": st.none() | st.text(alphabet="ab%_\\ ", max_size=7),
        "domain": st.sampled_from(["APM", "INFRA"]),
        "type": st.sampled_from(["HOST", "APPLICATION"]),
        "tags": st.none() | st.lists(tag, max_size=3),
    }
)


@settings(
    max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True
)
@given(st.lists(entity, min_size=8, max_size=20), st.lists(request, min_size=5, max_size=8))
def test_agrees_with_single_searches(spark, catalog_rows, request_rows):
    catalog = entities(spark, *[{"guid": f"g{i}", **e} for i, e in enumerate(catalog_rows)])
    catalog = catalog.coalesce(1)
    numbered = [{"req_id": i, **r} for i, r in enumerate(request_rows)]
    expected, unusable = [], []
    for r in numbered:
        try:
            single = search_entities(
                catalog, r["name"], r["type"], r["domain"], r["tags"], r["account_id"], None
            )
        except RequestError:
            unusable.append(r["req_id"])
            continue
        expected += [(r["req_id"], guid) for guid in values(single.rows, "guid")]
    result = search_entities_bulk(catalog, table(spark, "search_request", *numbered))
    assert pairs(result) == sorted(expected, key=str)
    assert values(result.errors, "req_id") == sorted(unusable, key=str)


def test_requests_of_the_sample(spark, fixtures):
    """The first ten nations, whose count was worked out beforehand."""
    requests = fixtures.search_request.filter("req_id < 10")
    result = search_entities_bulk(fixtures.entity, requests)
    assert result.matches.count() == 214
    assert values(result.errors, "req_id") == [9]


def test_both_plans_give_the_same_matches(spark, fixtures, conf):
    found = []
    for threshold in ("100MB", "-1"):
        conf(spark__sql__autoBroadcastJoinThreshold=threshold)
        found.append(pairs(search_entities_bulk(fixtures.entity, fixtures.customer_search)))
    assert found[0] == found[1] and found[0]


def test_only_pieces_somebody_asks_for_are_offered(spark, catalog):
    requests = table(
        spark, "search_request", {"req_id": 1, "name": "check", "account_id": 2}
    ).withColumnsRenamed({"name": "r_name", "account_id": "r_account_id"})
    used = bulk_search._forms_used(requests)
    offered = values(bulk_search._offered(catalog.filter("guid = 'b'"), used), "probe")
    assert offered == sorted(
        [f"in 2 name:{p}" for p in ("che", "hec", "eck", "ck ", "k i", " in")]
        + ["in 2 tag:3:env=prod", "in 2 domain:APM", "in 2 type:APPLICATION", "in 2 any:"]
    )


def test_searches_of_empty_tables(spark, catalog):
    none = table(spark, "search_request")
    assert pairs(search_entities_bulk(catalog, none)) == []
    asked = table(spark, "search_request", {"req_id": 1, "name": "check"})
    assert pairs(search_entities_bulk(catalog.limit(0), asked)) == []


def test_nothing_is_paired_with_everything(spark, fixtures, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = first_plan(search_entities_bulk(fixtures.entity, fixtures.search_request).matches)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_a_common_piece_of_a_name_is_not_the_probe(spark):
    """All names share a prefix; a search with a rare ending looks at few."""
    catalog = spark.range(5000).select(
        F.concat(F.lit("g"), "id").alias("guid"),
        F.concat(F.lit("customer-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"),
        F.lit("APM_APPLICATION").alias("entity_type"),
        F.lit("APM").alias("domain"),
        F.lit("APPLICATION").alias("type"),
        F.lit(1).alias("account_id"),
        F.expr("CAST(array() AS array<struct<key: string, value: string>>)").alias("tags"),
    )
    requests = table(spark, "search_request", {"req_id": 1, "name": "customer-004321"})
    matches = search_entities_bulk(catalog, requests).matches
    assert values(matches, "guid") == ["g4321"]


def test_equal_requests_are_one_search(spark, catalog):
    asked = [{"req_id": i // 2, "name": "b", "domain": "APM" if i % 2 else None} for i in range(8)]
    requests = table(spark, "search_request", *asked)
    valid, _ = bulk_search.checked_requests(requests)
    keyed, searches = bulk_search.distinct_searches(valid)
    assert (keyed.count(), searches.count()) == (8, 2)
    found = bulk_search.search_entities_bulk(catalog, requests)
    counted = found.matches.groupBy("req_id").count()
    assert values(found.totals, "req_id", "total_count") == values(counted, "req_id", "count")

import pytest

from obsq.errors import AccountRequired, RequestError
from obsq.functions.accounts import ALL_ACCOUNTS, in_accounts
from obsq.operators.paging import BY_GUID, Listing
from obsq.operators.search import find_exact, list_applications, list_monitors, search_entities
from tests.helpers import entities, plan, table, values


@pytest.fixture(scope="module")
def catalog(spark):
    def tag(*pairs):
        return [{"key": k, "value": v} for k, v in pairs]

    return entities(
        spark,
        {"guid": "a", "name": "100% sure", "account_id": 0},
        {"guid": "b", "name": "it's_here", "tags": tag(("env", "prod"), ("team", "x"))},
        {"guid": "c", "name": "back\\slash", "tags": tag(("env", "test"), ("env", "prod"))},
        {"guid": "d", "name": "Plain", "account_id": 2, "tags": tag(("env", "prod"))},
        {"guid": "e", "name": "mon", "domain": "SYNTH", "type": "MONITOR", "tags": None},
        {"guid": "f", "name": None, "tags": tag(("env", None))},
    )


def found(catalog, **criteria):
    return values(search_entities(catalog, **criteria).rows, "guid")


def test_name_is_contained_with_wildcards(catalog):
    assert found(catalog, name="'s_h") == ["b"]
    assert found(catalog, name="k\\s") == ["c"]
    assert found(catalog, name="0% s") == ["a"]
    assert found(catalog, name="P_a%n") == ["d"]
    assert found(catalog, name="plain") == []
    assert found(catalog, name="%") == ["a", "b", "c", "d", "e"]


def test_every_tag_is_required_and_keys_may_repeat(catalog):
    env = {"key": "env", "value": "prod"}
    assert found(catalog, tags=[env]) == ["b", "c", "d"]
    assert found(catalog, tags=[env, {"key": "env", "value": "test"}]) == ["c"]
    assert found(catalog, tags=[env, {"key": "team"}, "team"]) == ["b", "c", "d"]


def test_account_zero_is_searchable_and_no_account_spans_all(catalog):
    assert found(catalog, name="%", account=0) == ["a"]
    assert found(catalog, domain="APM", account=2) == ["d"]
    assert found(catalog, entity_type="MONITOR") == ["e"]
    assert found(catalog, name="%", account="2") == ["d"]


@pytest.mark.parametrize(
    "criteria",
    [
        {},
        {"account": 1},
        {"name": "", "domain": "", "tags": []},
        {"tags": [{"key": "env"}]},
        {"name": "x", "account": "seven"},
        {"name": "x", "limit": 0},
    ],
)
def test_unusable_criteria(catalog, criteria):
    with pytest.raises(RequestError):
        search_entities(catalog, **criteria)


def test_limit_and_total(catalog):
    page = search_entities(catalog, name="%", limit=2)
    assert values(page.rows, "guid") == ["a", "b"]
    assert values(page.with_total(), "guid", "total_count") == [("a", 5), ("b", 5)]
    assert page.total.collect()[0].total_count == 5
    assert search_entities(catalog, name="%").limit == 50


def test_exact_match_uses_the_default_account(catalog):
    assert values(find_exact(catalog, "Plain"), "guid") == ["d"]
    assert values(find_exact(catalog, "Plain", default_account=1), "guid") == []
    assert values(find_exact(catalog, "Plain", account=2, default_account=1), "guid") == ["d"]
    assert values(find_exact(catalog, "Plain", account=0, default_account=2), "guid") == ["d"]
    assert values(find_exact(catalog, "mon", "SYNTH", "MONITOR"), "guid") == ["e"]
    assert values(find_exact(catalog, "mon", "APM"), "guid") == []


def test_listings_need_an_account(catalog):
    assert values(list_applications(catalog, 2).rows, "guid") == ["d"]
    assert values(list_applications(catalog, default_account=2).rows, "guid") == ["d"]
    assert values(list_monitors(catalog, ALL_ACCOUNTS).rows, "guid") == ["e"]
    assert list_monitors(catalog, 1).limit == 250
    for account, default in [(None, None), (0, 2), (None, 0)]:
        with pytest.raises(AccountRequired):
            list_applications(catalog, account, default)


def test_account_scopes(spark, catalog):
    assert values(in_accounts(catalog, [1, 2]), "guid") == ["b", "c", "d", "e", "f"]
    wanted = table(spark, "account", {"account_id": 2}, {"account_id": 0}, {"account_id": 2})
    assert values(in_accounts(catalog, wanted), "guid") == ["d"]
    with pytest.raises(AccountRequired):
        in_accounts(catalog, [])


def test_pages_make_up_the_whole(spark, fixtures):
    everything = search_entities(fixtures.entity, domain="SYNTH", limit=None)
    expected = [r.guid for r in everything.rows.orderBy("guid").collect()]
    page = search_entities(fixtures.entity, domain="SYNTH", limit=700)
    seen = []
    while True:
        seen += [r.guid for r in page.rows.collect()]
        cursor = page.next_cursor.collect()[0].guid
        if cursor is None:
            break
        assert cursor == seen[-1]
        page = page.after(cursor)
    assert seen == expected


def test_no_next_page_when_the_last_one_is_full(spark, catalog):
    page = Listing(catalog.select("guid"), BY_GUID, 6)
    assert page.next_cursor.collect()[0].guid is None
    with pytest.raises(RequestError):
        page.after("a", "b")
    with pytest.raises(RequestError):
        Listing(catalog, BY_GUID).next_cursor


def test_search_reads_one_kind_and_keeps_the_best_rows_only(fixtures):
    text = plan(search_entities(fixtures.entity, name="red", domain="SYNTH").rows)
    assert "TakeOrderedAndProject" in text
    assert text.count("FileScan") == 1
    assert "p_retailprice" not in text
    assert "PushedFilters: [IsNotNull(p_name), StringContains(p_name,red)]" in text

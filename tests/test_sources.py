import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from obsq.errors import RequestError
from obsq.functions.rendering import json_text, reply_text
from obsq.operators.events import scan_events
from obsq.operators.freequery import free_query
from obsq.operators.replies import parse_replies
from obsq.operators.search import find_exact
from obsq.schema import TABLES
from obsq.sources.catalog import union_kinds
from obsq.sources.tables import read_tables, read_table, write_json, write_table
from obsq.streaming import bucket_stream, read_event_stream
from obsq.workspace import Workspace
from tests.helpers import entities, outcomes, plan, rows_scanned, table, values


def parsed(spark, *texts, path=("rows",)):
    archive = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")
    return values(parse_replies(archive, list(path)).drop("detail"))


def test_replies_of_every_shape(spark):
    rows = parsed(
        spark,
        '{"data": {"rows": [{"a": 1, "b": [1, {"c": null}]}, {"a": 2}]}}',
        '{"data": {"rows": [{"a": 3}]}, "errors": [{"message": "partly", "path": []}]}',
        '{"data": null, "errors": [{"message": "x"}, {"message": "y"}]}',
        '{"data": null}',
        '{"data": {"rows": []}}',
        '{"other": 1}',
        "<html>gateway</html>",
        '{"data": {"rows": [{"a": 1',
        "",
        None,
        "[]",
        '{"data": {"rows": 5}}',
        '{"errors": []}',
    )
    assert rows == sorted(
        [
            (0, "data", 0, '{"a":1,"b":[1,{"c":null}]}'),
            (0, "data", 1, '{"a":2}'),
            (1, "data", 0, '{"a":3}'),
            (1, "error", 0, "partly"),
            (2, "error", 0, "x"),
            (2, "error", 1, "y"),
            (3, "empty", 0, '{"data": null}'),
            (4, "empty", 0, '{"data": {"rows": []}}'),
            (5, "unexpected", 0, '{"other": 1}'),
            (6, "undecodable", 0, "<html>gateway</html>"),
            (7, "undecodable", 0, '{"data": {"rows": [{"a": 1'),
            (8, "undecodable", 0, ""),
            (9, "undecodable", 0, ""),
            (10, "undecodable", 0, "[]"),
            (11, "undecodable", 0, '{"data": {"rows": 5}}'),
            (12, "empty", 0, '{"errors": []}'),
        ],
        key=str,
    )


def test_no_reply_is_cut_or_lost(spark):
    long = '{"value": "' + "x" * 2000 + '"}'
    other = '{"data": {"actor": {"rows": [1]}}}'
    error = '{"message":"m","extensions":{"code":7},"path":["a"]}'
    archive = spark.createDataFrame(
        enumerate([long, other, f'{{"errors": [{error}, {{"code": 3}}]}}']), "id int, raw string"
    )
    rows = values(parse_replies(archive, ["rows"]))
    assert rows == [
        (0, "unexpected", 0, long, None),
        (1, "unexpected", 0, other, None),
        (2, "error", 0, "m", error),
        (2, "error", 1, '{"code":3}', '{"code":3}'),
    ]


def test_rows_further_down_and_long_texts(spark):
    nested = '{"data": {"actor": {"found": {"rows": ["p", 2]}}}}'
    rows = parsed(spark, nested, "x" * 2000, path=("actor", "found", "rows"))
    assert rows == [
        (0, "data", 0, "p"), (0, "data", 1, "2"), (1, "undecodable", 0, "x" * 500),
    ]
    with pytest.raises(RequestError):
        parsed(spark, nested, path=())


def test_json_output(spark, tmp_path):
    catalog = entities(
        spark,
        {"guid": "a", "name": 'quote " and \\', "apm": {"language": "java"}},
        {"guid": "b", "domain": "VIZ", "type": "DASHBOARD"},
    )
    texts = [json.loads(r[0]) for r in catalog.select(json_text(*catalog.columns)).collect()]
    assert texts[0]["name"] == 'quote " and \\' and texts[0]["apm"] == {"language": "java"}
    assert "apm" not in texts[1] and "browser" not in texts[1]
    assert "\n" in catalog.select(json_text("guid", pretty=True)).first()[0]
    write_json(catalog, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_replies_to_requests_parse_back(spark, fixtures):
    from obsq.operators.monitors import check_monitors

    batch = check_monitors(fixtures.monitor_request)
    row = F.struct(F.array(F.struct("name", "period")).alias("rows"))
    replies = batch.checked.select(
        "req_id", reply_text(row, F.col("outcome"), F.lit("no")).alias("raw")
    )
    parsed_back = parse_replies(replies, ["rows"])
    assert outcomes(parsed_back, "kind") == {"data": 161, "error": 89}
    first = parsed_back.filter("kind = 'data'").orderBy("req_id").first()
    assert json.loads(first.content)["name"] == f"mon-{first.req_id}"


def test_tables_survive_a_round_trip(spark, fixtures, tmp_path):
    for name, rows in fixtures.tables().items():
        write_table(rows, str(tmp_path), name)
    stored = read_tables(spark, str(tmp_path))
    assert set(stored) == set(TABLES)
    for name in ("entity", "incident", "event", "monitor_request"):
        columns = [f.name for f in TABLES[name]]
        before = fixtures.tables(name)[name].select(columns)
        assert values(stored[name].select(columns)) == values(before)
    workspace = Workspace.at(spark, str(tmp_path), 7)
    assert workspace.list_applications().rows.count() == 73
    with pytest.raises(RequestError):
        read_table(spark, str(tmp_path), "nothing")


def test_layout_prunes_days_and_domains(spark, fixtures, tmp_path):
    write_table(fixtures.event, str(tmp_path), "event")
    write_table(fixtures.entity, str(tmp_path), "entity")
    events = read_table(spark, str(tmp_path), "event")
    window = scan_events(events, None, datetime(2024, 1, 10), datetime(2024, 1, 12))
    expected = scan_events(fixtures.event, None, datetime(2024, 1, 10), datetime(2024, 1, 12))
    assert window.count() == expected.count() > 0
    filters = re.search(r"PartitionFilters: \[(.*?)\], Push", plan(window)).group(1)
    assert filters.count("event_date#") == 3, filters
    assert len(events.inputFiles()) >= 30
    found = Workspace.at(spark, str(tmp_path), None, "entity").search_entities(domain="INFRA").rows
    assert "PartitionFilters: [isnotnull(domain" in plan(found)


def test_free_query(spark, fixtures):
    workspace = Workspace(spark, fixtures.tables("account", "entity"))
    text = "SELECT count(*) AS n FROM entity WHERE domain = :domain AND account_id = :account"
    got = workspace.query(text, {"domain": "APM", "account": 7})
    assert values(got, "n") == [73]
    hostile = workspace.query(text, {"domain": "APM' OR '1'='1", "account": 7})
    assert values(hostile, "n") == [0]
    for blank in ("", "  \n", None):
        with pytest.raises(RequestError):
            free_query(spark, blank)


def test_buckets_of_a_stream_match_the_batch(spark, fixtures, tmp_path):
    write_table(fixtures.event, str(tmp_path), "event")
    day = timedelta(days=1)
    counted = bucket_stream(
        read_event_stream(spark, f"{tmp_path}/event", files_per_batch=1000),
        [F.count("*").alias("n")], day, late_by=timedelta(hours=1), facets=["event_type"],
    )
    query = (
        counted.writeStream.format("memory").queryName("bucketed").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    batch = Workspace(spark, {"event": fixtures.event}, 7).event_query(
        [F.count("*").alias("n")], facets=["event_type"], bucket=day, account=list(range(1, 25))
    ).rows.unionByName(
        fixtures.event.filter("account_id = 0").groupBy(
            F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket_start"), "event_type"
        ).agg(F.count("*").alias("n")), allowMissingColumns=True,
    ).groupBy("bucket_start", "event_type").agg(F.sum("n").alias("n"))
    got = spark.table("bucketed").select(
        F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "event_type", "n"
    )
    assert values(got) == values(batch.select("bucket_start", "event_type", "n"))


def test_late_events_are_dropped_from_closed_buckets(spark, tmp_path):
    """In append mode a bucket appears once, when the watermark has passed it."""
    def add(batch, *hours):
        spark.createDataFrame(
            [(i, datetime(2024, 1, 1) + timedelta(hours=h), "view") for i, h in enumerate(hours)],
            "event_id long, ts timestamp_ntz, event_type string",
        ).coalesce(1).write.parquet(f"{tmp_path}/in/event_date=2024-01-0{batch}")

    add(1, 0.1, 0.2, 1.5)
    stream = spark.readStream.schema(
        "event_id long, ts timestamp_ntz, event_type string, event_date date"
    ).parquet(f"{tmp_path}/in")
    counted = bucket_stream(
        stream, [F.count("*").alias("n")], timedelta(hours=1), late_by=timedelta(hours=2)
    )
    def run():
        query = (
            counted.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{tmp_path}/state")
            .option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)

    run()
    add(2, 9.5)
    run()
    add(3, 0.3, 20.5)
    run()
    out = spark.read.parquet(f"{tmp_path}/out").selectExpr("hour(bucket_start) AS h", "n")
    assert values(out) == [(0, 2), (1, 1), (9, 1)]


def test_a_workspace_starts_without_a_log(spark, tmp_path):
    root = str(tmp_path)
    write_table(table(spark, "incident", {"incident_id": 1, "account_id": 1, "state": "OPEN"}), root, "incident")
    workspace = Workspace.at(spark, root, 1, "incident", "incident_ack")
    request = table(spark, "incident_ack", {"req_id": 1, "incident_id": 1})
    assert values(workspace.acknowledge(request), "outcome") == ["OK"]
    with pytest.raises(AnalysisException):
        Workspace.at(spark, root, 1, "policy")


def test_a_free_query_leaves_the_callers_views(spark):
    spark.range(3).createOrReplaceTempView("policy")
    policies = table(spark, "policy", {"policy_id": 9})
    events = table(spark, "event", {"event_id": 4})
    found = Workspace(spark, {"policy": policies, "event": events}).query(
        "SELECT policy_id, event_id FROM policy, event"
    )
    assert spark.table("policy").columns == ["id"]
    assert not spark.catalog.tableExists("event")
    assert values(found) == [(9, 4)]
    spark.catalog.dropTempView("policy")


def many_incidents(spark, n=4000):
    """Incidents of 50 accounts, a third of them of account 7."""
    return spark.range(n).selectExpr(
        "id AS incident_id", "'t' AS title", "'INFO' AS priority", "'OPEN' AS state", "'p' AS policy_name",
        "'c' AS condition_name", "concat('G', id % 97) AS entity_guid",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7919 % 4001) AS started_at",
        "timestamp_ntz'2024-01-01 00:00:00' AS updated_at", "'d' AS description", "'u' AS violation_url",
        "CAST(if(id % 3 = 0, 7, id % 50) AS int) AS account_id",
    )


def test_an_account_reads_few_files_and_a_large_one_has_several(spark, tmp_path, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    write_table(many_incidents(spark), str(tmp_path), "incident")
    stored = read_table(spark, str(tmp_path), "incident")
    assert len(stored.inputFiles()) == 8 and stored.count() == 4000
    one = stored.filter("account_id = 33").select("incident_id")
    assert rows_scanned(one) <= 1000 and one.count() == many_incidents(spark).filter("account_id = 33").count()
    # the large account is cut by time: no file has a piece of another file's times
    spans = (
        stored.filter("account_id = 7").groupBy(F.input_file_name().alias("file"))
        .agg(F.min("started_at").alias("first"), F.max("started_at").alias("last")).orderBy("first").collect()
    )
    assert len(spans) >= 3 and all(a["last"] <= b["first"] for a, b in zip(spans, spans[1:]))


def test_lookups_skip_files_by_bloom_filters(spark, tmp_path, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = spark.range(4000).selectExpr(
        "concat('G', md5(CAST(id AS string))) AS guid", "concat('name ', id) AS name", "CAST(1 AS int) AS account_id",
        "'APM' AS domain", "'APPLICATION' AS type", "'APM_APPLICATION' AS entity_type",
    )
    write_table(union_kinds([rows]), str(tmp_path), "entity")
    stored = read_table(spark, str(tmp_path), "entity")
    files = len(stored.inputFiles())
    named = find_exact(stored, "name 1234").select("guid")
    assert files >= 8 and named.count() == 1 and rows_scanned(named) <= 2 * 4000 / files
    unknown = find_exact(stored, "name 12345").select("guid")
    assert unknown.count() == 0 and rows_scanned(unknown) <= 4000 / files

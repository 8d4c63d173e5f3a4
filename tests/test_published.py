"""Logs and stores that change in whole steps."""

from datetime import datetime, timedelta

import pytest

from obsq.errors import RequestError
from obsq.operators import ack_log
from obsq.operators.ack_log import AcknowledgementLog
from obsq.operators.monitor_store import MonitorStore
from obsq.plans.scratch import shared_folder
from obsq.sources.published import Published, PublishConflict
from tests.helpers import outcomes, table, values

NOON = datetime(2024, 1, 1, 12)


def incidents(spark, n=6):
    return table(spark, "incident", *[
        {"incident_id": i, "account_id": 1, "state": "CLOSED" if i == 5 else "OPEN", "title": f"t{i}"} for i in range(1, n)
    ])


def requests(spark, *asked):
    """Requests ``(req_id, incident_id, minute)``."""
    return table(spark, "incident_ack", *[
        {"req_id": r, "incident_id": i, "account_id": 1, "acknowledged_by": f"u{r}", "acknowledged_at": NOON + timedelta(minutes=m)}
        for r, i, m in asked
    ])


@pytest.fixture
def log(spark, tmp_path):
    return AcknowledgementLog(spark, str(tmp_path / "log"))


def told(frame):
    return values(frame, "req_id", "incident_id", "outcome")


def states(log, base):
    return values(log.incidents(base), "incident_id", "state", "acknowledged_by")


def test_versions_appear_whole(spark, tmp_path):
    folder = Published(spark, str(tmp_path / "t"))
    assert folder.current().number == 0 and folder.current().parts == ()
    rows = spark.range(3)
    part = folder.stage(rows, "x")
    assert folder.open(folder.current().parts, rows.schema).count() == 0
    one = folder.publish(folder.current(), [part], {"a": 1})
    assert folder.current() == one and folder.open(one.parts, rows.schema).count() == 3
    two = folder.publish(one, [folder.stage(rows, "x")])
    assert folder.version(1) == one and two.batches == {"a": 1}
    with pytest.raises(PublishConflict):
        folder.publish(one, [])
    assert folder.current() == two
    lost = folder.stage(rows, "lost")
    assert set(folder.vacuum()) == {part.path, lost.path}
    assert folder.current() == two and folder.open(two.parts, rows.schema).count() == 3


def test_batches_are_applied_once_and_share_ids(spark, log):
    base = incidents(spark)
    first = requests(spark, (1, 1, 5), (2, 1, 4), (3, 2, 9), (4, 99, 1), (5, 5, 1))
    second = requests(spark, (1, 3, 1), (2, 2, 0), (3, 1, 0))
    want_first = [(1, 1, "ALREADY_ACKED"), (2, 1, "OK"), (3, 2, "OK"), (4, 99, "NOT_FOUND"), (5, 5, "NOT_OPEN")]
    want_second = [(1, 3, "OK"), (2, 2, "NOT_OPEN"), (3, 1, "NOT_OPEN")]
    assert told(log.apply(first, base, "a")) == want_first
    assert told(log.apply(second, base, "b")) == want_second
    after = states(log, base)
    assert after == [
        (1, "ACKNOWLEDGED", "u2"), (2, "ACKNOWLEDGED", "u3"), (3, "ACKNOWLEDGED", "u1"), (4, "OPEN", None), (5, "CLOSED", None),
    ]
    number = log.store.current().number
    assert told(log.apply(first, base, "a")) == want_first and told(log.apply(second, base, "b")) == want_second
    assert log.store.current().number == number and states(log, base) == after
    assert values(log.still_open(base), "incident_id") == [4]


def test_readers_open_the_snapshot_and_the_tail(spark, log):
    base = incidents(spark)
    log.apply(requests(spark, (1, 1, 0)), base, "a")
    log.apply(requests(spark, (1, 2, 0)), base, "b")
    log.compact()
    log.apply(requests(spark, (1, 3, 0), (2, 1, 0)), base, "c")
    assert [p.kind for p in log.parts()] == ["snapshot", "batch"]
    opened = {f.split("/parts/")[1].split("/")[0] for f in log.rows().inputFiles()}
    assert opened == {p.path.split("/")[1] for p in log.parts()}
    log.store.vacuum()
    assert told(log.apply(requests(spark, (1, 1, 0)), base, "a")) == [(1, 1, "OK")]
    assert told(log.apply(requests(spark, (1, 3, 0), (2, 1, 0)), base, "c")) == [(1, 3, "OK"), (2, 1, "NOT_OPEN")]
    assert values(log.rows(), "incident_id", "batch") == [(1, "a"), (2, "b"), (3, "c")]
    log.compact()
    assert [p.kind for p in log.parts()] == ["snapshot"] and values(log.still_open(base), "incident_id") == [4]


def test_a_batch_judged_again_after_another_came_first(spark, tmp_path, monkeypatch):
    base = incidents(spark)
    mine, other = (AcknowledgementLog(spark, str(tmp_path / "log")) for _ in range(2))
    publish = mine.store.publish
    calls = []

    def late(*arguments):
        if not calls:
            calls.append(1)
            other.apply(requests(spark, (7, 1, 9)), base, "other")
        return publish(*arguments)

    monkeypatch.setattr(mine.store, "publish", late)
    assert told(mine.apply(requests(spark, (1, 1, 0), (2, 2, 0)), base, "mine")) == [(1, 1, "NOT_OPEN"), (2, 2, "OK")]
    assert values(mine.rows(), "incident_id", "batch") == [(1, "other"), (2, "mine")]
    monkeypatch.setattr(ack_log, "TRIES", 0)
    with pytest.raises(PublishConflict):
        mine.apply(requests(spark), base, "never")


def test_a_batch_that_fails_leaves_nothing(spark, log, monkeypatch):
    base = incidents(spark)

    def broken(*arguments):
        raise OSError("no space")

    monkeypatch.setattr(log.store, "publish", broken)
    with pytest.raises(OSError):
        log.apply(requests(spark, (1, 1, 0)), base, "a")
    monkeypatch.undo()
    assert log.rows().count() == 0
    assert told(log.apply(requests(spark, (1, 1, 0)), base, "a")) == [(1, 1, "OK")]
    assert outcomes(log.apply(requests(spark), base, "none")) == {}


def monitor(req_id, name="m", **other):
    return {"req_id": req_id, "name": name, "uri": "http://x", "locations": ["A"], "account_id": 1, **other}


def test_monitors_are_stored_once(spark, tmp_path):
    store = MonitorStore(spark, str(tmp_path / "monitors"))
    one, two, bad = monitor(1), monitor(2, tags=[{"key": "k", "value": "v"}]), monitor(3, name="")
    assert outcomes(store.create(table(spark, "monitor_request", one, two, one, bad), "a").checked) == {"OK": 3, "REQUIRED": 1}
    assert store.create(table(spark, "monitor_request", two, monitor(4)), "b").created.count() == 2
    store.create(table(spark, "monitor_request", monitor(9)), "a")
    assert values(store.monitors(), "req_id", "batch") == [(1, "a"), (2, "a"), (4, "b")]
    assert store.entities().count() == 3
    assert store.entities().filter("guid LIKE 'SYNTH|%' AND monitor.period = 'EVERY_15_MINUTES'").count() == 3


def test_shared_folder(spark, monkeypatch):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")

    class Cluster:
        conf = spark.conf

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RequestError):
            shared_folder(Cluster, "x")

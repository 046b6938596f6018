"""End-to-end golden case: three tickets ingested through the stream, then
the dashboard, customer page and export read back from the store."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpdesk_lake.filters import AnalyticsFilters, CustomerMetricsArgs
from helpdesk_lake.operators import comparison as C
from helpdesk_lake.operators import customers as CM
from helpdesk_lake.operators import dashboard as D
from helpdesk_lake.operators import exports as E
from helpdesk_lake.sources.json_feed import read_feed
from helpdesk_lake.streaming.ingest import start_ingestion
from helpdesk_lake.streaming.store import (IngestionError, ingest_batch, ingest_log, ingestion_state, init_store,
                                           store_model)

BASE = datetime(2026, 8, 1, 10, 0, tzinfo=timezone.utc)


def _iso(dt):
    return dt.isoformat().replace("+00:00", "Z") if dt else None


def record(ticket_id, requester_id, name, email, created_h, status, tags, first_min, score):
    created = BASE + timedelta(hours=created_h)
    return {
        "ticket_id": ticket_id,
        "subject": f"Ticket {ticket_id}",
        "description": "Descrição do problema",
        "status": status,
        "priority": "normal",
        "requester_id": requester_id,
        "requester_name": name,
        "requester_email": email,
        "assignee_id": 91,
        "assignee_name": "Suporte N1",
        "created_at": _iso(created),
        "updated_at": _iso(created + timedelta(hours=1)),
        "first_response_at": _iso(created + timedelta(minutes=first_min)) if first_min is not None else None,
        "tags": tags,
        "satisfaction_rating": (
            {"score": score, "offered_at": _iso(created + timedelta(minutes=5)),
             "rated_at": _iso(created + timedelta(minutes=45)), "comment": ""} if score else None),
    }


GOLDEN = [
    record(1001, 501, "Cliente A", "A@EXAMPLE.COM", 0, "open", ["dns"], 10, "good"),
    record(1002, 501, "Cliente A", "a@example.com", 2, "solved", ["dns", "ssl"], 30, "bad"),
    record(1003, 502, "Cliente B", "b@example.com", 24, "closed", ["ssl"], None, None),
]


def _write(folder, name, payload):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(payload), encoding="utf-8")


@pytest.fixture(scope="module")
def golden_store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("golden")
    feed, root = base / "feed", str(base / "store")
    _write(feed, "batch-0001.json", GOLDEN)
    q = start_ingestion(spark, str(feed), root, checkpoint=str(base / "ckpt"), expected_count=3)
    q.awaitTermination(120)
    assert q.exception() is None
    # re-sending 1001 unchanged: a new file with the same version
    _write(feed, "batch-0002.json", [GOLDEN[0]])
    q = start_ingestion(spark, str(feed), root, checkpoint=str(base / "ckpt"), expected_count=1)
    q.awaitTermination(120)
    assert q.exception() is None
    return root


def test_table_counts(spark, golden_store):
    m = store_model(spark, golden_store)
    assert m.tickets.count() == 3
    assert m.tags.count() == 2
    assert m.ticket_tags.count() == 4
    assert m.ratings.count() == 2
    assert m.customers.count() == 2
    emails = {r.requester_email for r in m.customers.collect()}
    assert emails == {"a@example.com", "b@example.com"}


def test_resend_is_unchanged(spark, golden_store):
    log = {r.batch: r for r in ingest_log(spark, golden_store).collect()}
    assert len(log) == 2
    second = log[max(log)]
    assert second.state == "SUCCESS"
    assert second.tickets_created == 0 and second.tickets_unchanged == 1
    assert second.next_cursor == 4
    state = ingestion_state(spark, golden_store).first()
    assert state.worker_state == "IDLE" and state.cursor_position == 4 and state.last_error is None


def test_dashboard_numbers(spark, golden_store):
    m = store_model(spark, golden_store)
    f = AnalyticsFilters()
    s = D.period_summary(m, f).first()
    assert (s.total_tickets, s.resolved_tickets) == (3, 2)
    assert s.average_first_response_seconds == 1200.0
    r = D.recurrence(m, f).first()
    assert r.average_recurrence_seconds == 7200.0 and r.recurrence_sample_intervals == 1
    topics = {t.tag: t.ticket_count for t in D.topic_aggregates(m, f).collect()}
    assert topics == {"dns": 2, "ssl": 2}
    b = D.customer_behavior(m, f).first()
    assert (b.unique_customers, b.repeat_customers, b.average_tickets_per_customer) == (2, 1, 1.5)
    assert D.timeline(m, f).agg(F.sum("opened")).first()[0] == 3
    buckets = {x.bucket: x.ticket_count for x in C.first_response_distribution(m, f).collect()}
    assert buckets == {"up_to_15m": 1, "15_to_30m": 1, "30_to_60m": 0, "1_to_4h": 0, "over_4h": 0, "unanswered": 1}


def test_customer_page(spark, golden_store):
    m = store_model(spark, golden_store)
    page = CM.customer_metrics_page(m, CustomerMetricsArgs()).collect()
    assert page[0].total == 2
    first = page[0]
    assert first.requester_email == "a@example.com"
    assert (first.ticket_volume, first.resolved_tickets, first.average_recurrence_seconds) == (2, 1, 7200.0)
    assert first.has_next is False and first.has_previous is False


def test_export_order_and_tags(spark, golden_store):
    m = store_model(spark, golden_store)
    rows = E.data_export(m, AnalyticsFilters()).collect()
    assert [r.ticket_id for r in rows] == [1001, 1002, 1003]
    assert [r.tags for r in rows] == [["dns"], ["dns", "ssl"], ["ssl"]]
    assert rows[0].satisfaction_rating.score == "good"
    assert rows[0].created_at == "2026-08-01T10:00:00Z"
    assert rows[2].satisfaction_rating is None


def test_conflict_batch_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    init_store(spark, root)
    feed = tmp_path / "feed"
    batch = [record(1, 501, "A", "a@example.com", 0, "open", [], None, None),
             record(2, 502, "B", "b@example.com", 1, "open", [], None, None),
             record(3, 501, "A", "b@example.com", 2, "open", [], None, None)]
    _write(feed, "b.json", batch)
    with pytest.raises(IngestionError):
        ingest_batch(spark, read_feed(spark, str(feed / "b.json"), 3), root, 0)
    m = store_model(spark, root)
    assert m.customers.count() == 0 and m.tickets.count() == 0
    assert ingest_log(spark, root).first().state == "ERROR"
    state = ingestion_state(spark, root).first()
    assert state.worker_state == "ERROR" and state.cursor_position == 0 and "conflict" in state.last_error


def test_invalid_record_fails_batch(spark, tmp_path):
    root = str(tmp_path / "store")
    init_store(spark, root)
    bad = record(9, 1, "X", "x@example.com", 0, "unknown", [], None, None)
    _write(tmp_path / "f", "b.json", [bad])
    with pytest.raises(IngestionError, match="status"):
        ingest_batch(spark, read_feed(spark, str(tmp_path / "f" / "b.json"), 1), root, 0)
    assert store_model(spark, root).tickets.count() == 0


def test_newer_version_replaces_and_rating_removed(spark, tmp_path):
    root = str(tmp_path / "store")
    init_store(spark, root)
    v1 = record(7, 1, "X", "x@example.com", 0, "open", ["a"], 10, "good")
    v2 = dict(v1, status="solved", tags=["b"], satisfaction_rating=None,
              updated_at=_iso(BASE + timedelta(hours=5)))
    late = dict(v1, status="hold", updated_at=_iso(BASE + timedelta(minutes=30)))
    _write(tmp_path / "f", "1.json", [v1])
    ingest_batch(spark, read_feed(spark, str(tmp_path / "f" / "1.json")), root, 0)
    _write(tmp_path / "g", "2.json", [v2, late])
    ingest_batch(spark, read_feed(spark, str(tmp_path / "g" / "2.json")), root, 1)
    m = store_model(spark, root)
    t = m.tickets.first()
    assert t.status == "SOLVED"
    assert [r.tag_id for r in m.ticket_tags.collect()] == ["b"]
    assert m.ratings.count() == 0
    assert {r.name for r in m.tags.collect()} == {"a", "b"}


def test_stream_replay_processes_nothing(spark, golden_store, tmp_path_factory):
    """A second run over the same folder and checkpoint finds no new file."""
    before = ingest_log(spark, golden_store).count()
    feed = [p for p in tmp_path_factory.getbasetemp().rglob("feed") if (p / "batch-0001.json").exists()][0]
    q = start_ingestion(spark, str(feed), golden_store, checkpoint=str(feed.parent / "ckpt"), expected_count=1)
    q.awaitTermination(120)
    assert q.exception() is None
    assert ingest_log(spark, golden_store).count() == before
    assert store_model(spark, golden_store).tickets.count() == 3


def test_later_batches_and_layout_round_trip(spark, tmp_path):
    from helpdesk_lake.sources.tables import parquet_model, write_model
    root = str(tmp_path / "store")
    init_store(spark, root)
    _write(tmp_path / "a", "1.json", GOLDEN)
    ingest_batch(spark, read_feed(spark, str(tmp_path / "a" / "1.json")), root, 0)
    newer = dict(GOLDEN[0], status="solved", updated_at=_iso(BASE + timedelta(hours=3)))
    _write(tmp_path / "b", "2.json", [newer])
    ingest_batch(spark, read_feed(spark, str(tmp_path / "b" / "2.json")), root, 1)
    assert D.period_summary(store_model(spark, root), AnalyticsFilters()).first().resolved_tickets == 3
    # a stale version is ignored; a newer one applies
    stale = dict(GOLDEN[0], status="hold", updated_at=_iso(BASE + timedelta(hours=2)))
    newest = dict(GOLDEN[2], status="open", updated_at=_iso(BASE + timedelta(days=2)))
    _write(tmp_path / "c", "3.json", [stale, newest])
    out = ingest_batch(spark, read_feed(spark, str(tmp_path / "c" / "3.json")), root, 3)
    assert out["tickets_unchanged"] == 1 and out["tickets_updated"] == 1
    m = store_model(spark, root)
    status = {r.ticket_id: r.status for r in m.tickets.collect()}
    assert status == {1001: "SOLVED", 1002: "SOLVED", 1003: "OPEN"}
    assert ingestion_state(spark, root).first().cursor_position == 6
    write_model(m, str(tmp_path / "tables"), partitions=2)
    pm = parquet_model(spark, str(tmp_path / "tables"))
    assert D.period_summary(pm, AnalyticsFilters()).first() == D.period_summary(m, AnalyticsFilters()).first()


def test_fresh_checkpoint_changes_nothing(spark, tmp_path):
    """A stream that starts anew (lost checkpoint, another process) reads all files again: what it re-sends is unchanged."""
    feed, root = tmp_path / "feed", str(tmp_path / "store")
    for k in range(3):
        _write(feed, f"{k}.json", [GOLDEN[k]])
        q = start_ingestion(spark, str(feed), root, checkpoint=str(tmp_path / f"ckpt-{k}"))
        q.awaitTermination(120)
        assert q.exception() is None
        assert store_model(spark, root).tickets.count() == k + 1
    log = ingest_log(spark, root).orderBy("finished_at").collect()
    assert [(r.records, r.tickets_created, r.tickets_unchanged) for r in log] == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]
    assert store_model(spark, root).ticket_text.count() == 3 and store_model(spark, root).customers.count() == 2


def test_repeated_batch_replaces_itself(spark, tmp_path):
    """A batch that runs again (after a crash, say) leaves the same tables and one log row; batches of any name and order are seen;
    a version that two writers applied is one row; texts are not read for narrow columns."""
    from helpdesk_lake.streaming.store import current_versions
    root = str(tmp_path / "store")
    init_store(spark, root)
    for name, record in (("b100", GOLDEN[0]), ("a2", GOLDEN[1]), ("b100", GOLDEN[0]), ("c1", GOLDEN[2]), ("d", GOLDEN[2])):
        _write(tmp_path / "f", "x.json", [record])
        out = ingest_batch(spark, read_feed(spark, str(tmp_path / "f" / "x.json")), root, name)
        assert out["state"] == "SUCCESS" and out["tickets_created"] == (0 if name == "d" else 1)
    assert sorted(r.batch for r in ingest_log(spark, root).collect()) == ["a2", "b100", "c1", "d"]
    assert sorted(r.ticket_id for r in store_model(spark, root).tickets.collect()) == [1001, 1002, 1003]
    assert sorted(r.ticket_id for r in store_model(spark, root).ticket_text.collect()) == [1001, 1002, 1003]
    assert store_model(spark, root).customers.count() == 2
    plan = current_versions(spark, root, ["ticket_id", "status"])._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "subject" not in plan


def test_switched_off(spark, tmp_path):
    from helpdesk_lake.streaming.store import IngestionDisabled, set_enabled
    root, feed = str(tmp_path / "store"), tmp_path / "f"
    init_store(spark, root)
    _write(feed, "x.json", GOLDEN)
    set_enabled(spark, root, False)
    assert ingestion_state(spark, root).first().worker_state == "DISABLED"
    with pytest.raises(IngestionDisabled):
        ingest_batch(spark, read_feed(spark, str(feed)), root, 1)
    with pytest.raises(IngestionDisabled):
        start_ingestion(spark, str(feed), root)
    set_enabled(spark, root, True)
    start_ingestion(spark, str(feed), root).awaitTermination(120)
    state = ingestion_state(spark, root).first()
    assert (state.enabled, state.worker_state, state.cursor_position) == (True, "IDLE", 3)


def test_feed_reader_errors_stay_with_their_record(spark, tmp_path):
    """Odd files: a wrong type, a missing field, broken JSON, an empty array; one record a line; order of files and places."""
    from helpdesk_lake.operators import ingestion as I
    from helpdesk_lake.sources.json_feed import read_feed_lines, write_feed
    feed = tmp_path / "f"
    _write(feed, "a.json", [GOLDEN[0], dict(GOLDEN[1], ticket_id="no number"), dict(GOLDEN[2], satisfaction_rating="good", tags="x")])
    _write(feed, "c.json", [])
    _write(feed, "d e.json", [{"ticket_id": 5}])
    (feed / "b.json").write_text('[{"ticket_id": 7}, {"tick', encoding="utf-8")
    rows = read_feed(spark, str(feed)).orderBy("seq").collect()
    assert [(r.source_file.rsplit("/", 1)[1], r.pos, r.ticket_id) for r in rows if r.file_error is None] == [
        ("a.json", 1, 1001), ("a.json", 2, None), ("a.json", 3, 1003), ("d%20e.json", 1, 5)]
    assert [r.record_error for r in rows if r.file_error is None] == [None, "malformed record: ticket_id", "malformed record: tags, satisfaction_rating", None]
    assert {r.source_file.rsplit("/", 1)[1] for r in rows if r.file_error} == {"b.json"}
    wrong = read_feed(spark, str(feed), expected_count=3).where("file_error IS NOT NULL").collect()
    assert {r.source_file.rsplit("/", 1)[1] for r in wrong} == {"b.json", "c.json", "d%20e.json"}
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.jsonl").write_text("\n".join([json.dumps(GOLDEN[0]), "{broken", json.dumps(GOLDEN[2])] * 40), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = read_feed_lines(spark, str(lines))
        assert got.rdd.getNumPartitions() > 3
        got = got.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.ticket_id for r in got] == [1001, None, 1003] * 40 and len({r.seq for r in got}) == 120
    assert [r.record_error is None for r in got] == [True, False, True] * 40
    good = read_feed_lines(spark, str(lines)).where("record_error IS NULL")
    write_feed(good, str(tmp_path / "out"), 3)
    back = read_feed(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [r.ticket_id for r in back] == [1001, 1003] * 40
    assert I.validate(read_feed(spark, str(tmp_path / "out"))).where("is_valid").count() == 80


def test_newest_of_a_stream(spark, tmp_path):
    """Versions shuffled, repeated and late, in files that come bit by bit, with a restart after each: as in one batch."""
    import random

    from helpdesk_lake.streaming.latest import latest, newest, start_latest
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, *range(30)]), BASE.replace(tzinfo=None) + timedelta(minutes=rng.randrange(200)), k, f"v{k}") for k in range(600)]
    rows.append((2, None, 1000, "no time"))
    schema = "ticket long, at timestamp_ntz, seq long, status string"
    sent = rows + rng.sample(rows, 200)
    rng.shuffle(sent)
    source, path, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    assert latest(spark, str(tmp_path / "none"), schema, "ticket", "at", "seq", ["status"]).count() == 0
    for k in range(4):
        spark.createDataFrame(sent[k * 200:(k + 1) * 200 if k < 3 else None], schema).repartition(3).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(source))
        start_latest(stream, path, ckpt, "ticket", "at", "seq", ["status"]).awaitTermination(180)
    want = newest(spark.createDataFrame(rows, schema), "ticket", "at", "seq", ["status"])
    got = latest(spark, path, schema, "ticket", "at", "seq", ["status"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = {}
    for ticket, at, seq, status in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[2]):
        if ticket not in plain or at > plain[ticket][0]:
            plain[ticket] = (at, seq, status)
    assert {r.ticket: (r.at, r.seq, r.status) for r in got.collect()} == plain


def test_lenient_batch_keeps_its_rejects(spark, tmp_path):
    root = str(tmp_path / "store")
    init_store(spark, root)
    _write(tmp_path / "f", "x.json", [GOLDEN[0], dict(GOLDEN[1], status="nonsense")])
    out = ingest_batch(spark, read_feed(spark, str(tmp_path / "f" / "x.json")), root, 0, strict=False)
    assert out["state"] == "SUCCESS" and store_model(spark, root).tickets.count() == 1
    rejected = spark.read.parquet(f"{root}/records").where("NOT is_valid").collect()
    assert len(rejected) == 1 and rejected[0].errors == ["status: invalid value"]

"""Small hand-made cases (FIXTURES §3 and the edge cases the reference leaves untested)."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpdesk_lake.filters import AnalyticsFilters, CustomerMetricsArgs, normalize_search
from helpdesk_lake.functions import expressions as X
from helpdesk_lake.model import TicketModel
from helpdesk_lake.operators import comparison as C
from helpdesk_lake.operators import customers as CM
from helpdesk_lake.operators import dashboard as D
from helpdesk_lake.operators import exports as E
from helpdesk_lake.operators import ingestion as I
from helpdesk_lake.operators import listings as L
from helpdesk_lake.operators import maintenance as M
from helpdesk_lake.sinks.reports import last_column, sheet_title, write_csv, write_xlsx_parts
from helpdesk_lake.sources.json_feed import read_feed

TICKET_SCHEMA = ("ticket_id long, customer_id long, status string, priority string, assignee_external_id long, "
                 "assignee_name string, source_created_at timestamp_ntz, source_updated_at timestamp_ntz, "
                 "first_response_at timestamp_ntz")


def ts(s):
    return datetime.fromisoformat(s)


def make_model(spark, tickets, ratings=(), links=(), customers=None):
    t = spark.createDataFrame(tickets, TICKET_SCHEMA)
    r = spark.createDataFrame(list(ratings), "ticket_id long, score string, offered_at timestamp_ntz, "
                                             "rated_at timestamp_ntz, comment string")
    tt = spark.createDataFrame(list(links), "ticket_id long, tag_id string")
    tags = tt.select(F.col("tag_id"), F.col("tag_id").alias("name")).distinct()
    if customers is None:
        customers = sorted({row[1] for row in tickets})
        customers = [(c, c, f"Cliente {c}", f"c{c}@example.com") for c in customers]
    c = spark.createDataFrame(customers, "customer_id long, external_requester_id long, requester_name string, "
                                         "requester_email string")
    text = t.select("ticket_id", F.lit("assunto").alias("subject"), F.lit("descrição").alias("description"))
    return TicketModel(sources={"customers": c, "tickets": t, "ratings": r, "tags": tags, "ticket_tags": tt,
                                "ticket_text": text})


def T(i, cust, status, created, first=None, priority="NORMAL"):
    c = ts(created)
    return (i, cust, status, priority, 91, "Suporte", c, c, ts(first) if first else None)


@pytest.fixture()
def comparison_model(spark):
    # current window (2026-08-10 .. 2026-08-11): 2 tickets, 1 resolved, responses 600 s and 1200 s
    tickets = [
        T(1, 1, "SOLVED", "2026-08-10 10:00:00", "2026-08-10 10:10:00"),
        T(2, 1, "OPEN", "2026-08-10 11:00:00", "2026-08-10 11:20:00"),
        # previous window: 1 ticket, resolved, 1200 s
        T(3, 2, "CLOSED", "2026-08-09 09:00:00", "2026-08-09 09:20:00"),
    ]
    ratings = [(1, "GOOD", None, None, ""), (2, "BAD", None, None, ""), (3, "GOOD", None, None, "")]
    links = [(1, "dns"), (2, "ssl"), (3, "dns")]
    return make_model(spark, tickets, ratings, links)


CUR = AnalyticsFilters.create(from_at="2026-08-10T00:00:00", to_at="2026-08-10T23:59:59")


def test_metrics_comparison_arithmetic(comparison_model):
    m = C.metrics_comparison(comparison_model, CUR).first()
    assert (m.ticket_volume, m.previous_ticket_volume, m.ticket_volume_change_percent) == (2, 1, 100.0)
    assert m.resolution_rate == 0.5 and m.previous_resolution_rate == 1.0
    assert m.resolution_change_points == -50.0
    assert m.average_first_response_seconds == 900.0
    assert m.first_response_change_percent == -25.0
    assert m.average_recurrence_seconds == 3600.0
    assert m.satisfaction_rate == 0.5 and m.unanswered_tickets == 0


def test_topics_previous_and_driver(comparison_model):
    topics = {r.tag: r for r in C.topic_breakdown(comparison_model, CUR).collect()}
    assert topics["dns"].previous_ticket_count == 1 and topics["ssl"].previous_ticket_count == 0
    assert topics["dns"].share == 0.5 and topics["ssl"].share == 0.5
    summary = C.dashboard_summary(C.metrics_comparison(comparison_model, CUR),
                                  C.topic_breakdown(comparison_model, CUR)).first()
    assert summary.top_driver_label == "dns"
    # resolution and satisfaction both fell 50 p.p.: ties break on the text (Q4)
    assert summary.primary_alert == "Satisfação caiu 50.0 p.p."
    assert summary.primary_improvement == "Primeira resposta ficou 25.0% mais rápida."
    assert summary.headline.startswith("O volume aumentou 100.0%.")


def test_previous_window_ends_before_from():
    prev = CUR.previous()
    assert prev.to_at < CUR.from_at
    assert (CUR.from_at - prev.to_at).total_seconds() == pytest.approx(1e-6)


def test_empty_period_has_no_division_by_zero(comparison_model):
    empty = AnalyticsFilters.create(from_at="2030-01-01T00:00:00", to_at="2030-01-02T00:00:00")
    m = C.metrics_comparison(comparison_model, empty).first()
    assert m.ticket_volume == 0 and m.resolution_rate is None and m.satisfaction_rate is None
    assert m.ticket_volume_change_percent is None and m.unanswered_tickets == 0
    s = D.period_summary(comparison_model, empty).first()
    assert s.total_tickets == 0 and s.resolved_tickets == 0 and s.average_first_response_seconds is None
    summary = C.dashboard_summary(C.metrics_comparison(comparison_model, AnalyticsFilters()),
                                  C.topic_breakdown(comparison_model, AnalyticsFilters())).first()
    assert "não tem base anterior comparável" in summary.headline


def test_customer_rates(spark):
    tickets = [T(1, 5, "SOLVED", "2026-01-01 00:00:00"), T(2, 5, "CLOSED", "2026-01-02 00:00:00"),
               T(3, 5, "OPEN", "2026-01-03 00:00:00")]
    ratings = [(1, "GOOD", None, None, ""), (2, "BAD", None, None, ""), (3, "UNOFFERED", None, None, "")]
    m = make_model(spark, tickets, ratings)
    row = CM.customer_aggregates(m, CustomerMetricsArgs()).first()
    assert row.resolution_rate == pytest.approx(2 / 3) and row.satisfaction_rate == 0.5
    assert row.average_recurrence_seconds == 86400.0 and row.recurrence_sample_intervals == 2


def test_negative_response_is_unanswered_but_has_response(spark):
    tickets = [T(1, 1, "OPEN", "2026-01-01 10:00:00", "2026-01-01 09:00:00")]
    m = make_model(spark, tickets)
    assert {r.bucket: r.ticket_count for r in D.response_buckets(m, AnalyticsFilters()).collect()} == {"unanswered": 1}
    assert D.period_summary(m, AnalyticsFilters()).first().responded_tickets == 0
    assert D.period_summary(m, AnalyticsFilters.create(has_first_response=True)).first().total_tickets == 1


def test_tag_ids_and_names_must_match_same_tag(spark):
    m = make_model(spark, [T(1, 1, "OPEN", "2026-01-01 00:00:00")], links=[(1, "dns"), (1, "ssl")])
    f = AnalyticsFilters.create(tag_ids=["dns"], tag_names=["ssl"])
    assert D.period_summary(m, f).first().total_tickets == 0
    f2 = AnalyticsFilters.create(tag_ids=["dns", "ssl"], tag_names=["ssl"])
    assert D.period_summary(m, f2).first().total_tickets == 1


def test_range_errors():
    with pytest.raises(ValueError):
        AnalyticsFilters.create(from_at="2026-02-01T00:00:00", to_at="2026-01-01T00:00:00")
    with pytest.raises(ValueError):
        CustomerMetricsArgs(ticket_volume_min=10, ticket_volume_max=5)
    with pytest.raises(ValueError):
        CustomerMetricsArgs(satisfaction_rate_min=0.9, satisfaction_rate_max=0.5)
    with pytest.raises(ValueError):
        AnalyticsFilters.create(statuses="unknown")


def test_search_normalisation():
    assert normalize_search("  falha   domínio  ") == "falha domínio"
    assert normalize_search("   ") is None
    assert L.search_terms("falha domínio") == ["falha", "domínio"]
    with pytest.raises(ValueError):
        normalize_search("x" * 201)


def test_expressions(spark):
    df = spark.createDataFrame([("=SUM(A1)",), ("-5",), ("@x",), ("ok",), (None,)], "v string")
    out = [r[0] for r in E.report_cells(df).collect()]
    assert out == ["'=SUM(A1)", "'-5", "'@x", "ok", ""]
    nums = spark.createDataFrame([(12.25,), (12.35,), (0.05,), (-3.75,)], "x double")
    assert [r[0] for r in nums.select(X.one_decimal_abs("x")).collect()] == \
        [f"{abs(v):.1f}" for v in (12.25, 12.35, 0.05, -3.75)]
    secs = spark.createDataFrame([(None,), (45.0,), (600.0,), (3600.0,), (3900.0,), (86400.0,), (97200.0,)], "s double")
    assert [r[0] for r in secs.select(X.duration_text("s")).collect()] == \
        ["—", "45s", "10 min", "1h", "1h 5min", "1d", "1d 3h"]
    tags = spark.createDataFrame([([" ssl ", "dns", "dns", ""],)], "t array<string>")
    assert tags.select(X.normalize_tag_array("t")).first()[0] == ["dns", "ssl"]
    zoned = spark.createDataFrame([("2026-08-01T10:00:00Z",), ("2026-08-01T12:00:00+02:00",), ("2026-08-01T10:00:00",),
                                   ("garbage",)], "s string")
    got = [r[0] for r in zoned.select(X.to_naive_utc("s")).collect()]
    assert got[:3] == [datetime(2026, 8, 1, 10, 0)] * 3 and got[3] is None


def test_validation_normalises_and_rejects(spark):
    good = {"ticket_id": 1, "subject": "s", "description": "d", "status": "solved", "priority": "high",
            "requester_id": 1, "requester_name": "n", "requester_email": "  CLIENTE@EXAMPLE.COM  ",
            "created_at": "2026-08-01T10:00:00Z", "updated_at": "2026-08-01T11:00:00Z",
            "tags": [" ssl ", "dns", "dns", ""], "satisfaction_rating": {"score": "good"}}
    bads = [dict(good, subject=""), dict(good, description=""), dict(good, requester_name=""),
            dict(good, status="unknown"), dict(good, priority="critical")]
    from helpdesk_lake.schemas import TICKET_SOURCE
    rows = [json.dumps(r) for r in [good, *bads]]
    src = (spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, raw string")
           .select("seq", F.from_json("raw", TICKET_SOURCE).alias("r")).select("seq", "r.*"))
    out = I.validate(src).orderBy("seq").collect()
    assert out[0].is_valid and out[0].status == "SOLVED" and out[0].priority == "HIGH"
    assert out[0].requester_email == "cliente@example.com" and out[0].tags == ["dns", "ssl"]
    assert out[0].rating.score == "GOOD" and out[0].rating.comment == ""
    assert [r.is_valid for r in out[1:]] == [False] * 5


def test_feed_file_shape_rejects(spark, tmp_path):
    (tmp_path / "obj.json").write_text('{"ticket_id": 1}')
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "bad.json").write_text('[{"ticket_id": 1}, "not an object", {"ticket_id": 3}]')
    obj = read_feed(spark, str(tmp_path / "obj.json"), 1).collect()
    assert obj and all(r.file_error for r in obj)
    empty = read_feed(spark, str(tmp_path / "empty.json"), 1).collect()
    assert empty and all(r.file_error for r in empty)
    bad = read_feed(spark, str(tmp_path / "bad.json"), 3).orderBy("pos").collect()
    assert [r.record_error is not None for r in bad] == [False, True, False]
    assert [r.pos for r in bad] == [1, 2, 3] and all(r.file_error is None for r in bad)


def test_csv_and_xlsx_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "Cliente A"), (2, 'Cliente "B", x'), (3, " lead\nline ")], "id long, name string")
    write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode("utf-8") for p in sorted((tmp_path / "csv").glob("part-*.csv")))
    assert text.startswith("\ufeffid,name\r\n1,Cliente A\r\n")
    assert '"Cliente ""B"", x"' in text and '" lead\r\nline "' in text
    manifest = write_xlsx_parts(df, str(tmp_path / "xlsx"), partitions=1).collect()
    assert sum(r.rows for r in manifest) == 3
    with zipfile.ZipFile(manifest[0].path) as zf:
        sheet = zf.read("xl/worksheets/sheet1.xml").decode()
        assert "xl/workbook.xml" in zf.namelist()
    assert sheet.count("<row") == 4 and 'autoFilter ref="A1:B1"' in sheet
    assert sheet_title("a[b]:c*?/d\\e" * 5) == ("a_b__c___d_e" * 5)[:31]
    assert [last_column(k) for k in (1, 26, 27, 28, 702, 703)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]
    split = write_xlsx_parts(df, str(tmp_path / "xlsx"), partitions=1, sheet_limit=2).collect()
    assert [r.rows for r in split] == [1, 1, 1]  # a header and one row each
    for r in split:  # archives like any other, and nothing else in their folder
        with zipfile.ZipFile(r.path) as zf:
            assert zf.testzip() is None and zf.comment == b"\n"
    assert {p.suffix for p in Path(split[0].path).parent.iterdir() if not p.name.startswith((".", "_"))} == {".xlsx"}
    many = spark.range(2500).select("id", F.concat(F.lit("é<&>"), F.col("id").cast("string")).alias("t"))
    sheets = write_xlsx_parts(many, str(tmp_path / "xlsx"), partitions=3, sheet_limit=301).collect()
    assert sum(r.rows for r in sheets) == 2500 and max(r.rows for r in sheets) == 300
    texts = []
    for r in sheets:
        with zipfile.ZipFile(r.path) as zf:
            texts += re.findall("é&lt;&amp;&gt;[0-9]+", zf.read("xl/worksheets/sheet1.xml").decode())
    assert len(set(texts)) == 2500


def test_maintenance_rules(spark):
    m = make_model(spark, [T(1, 1, "OPEN", "2026-01-01 00:00:00"), T(2, 2, "OPEN", "2026-01-02 00:00:00")],
                   ratings=[(1, "GOOD", None, None, "")], links=[(1, "dns"), (2, "dns")],
                   customers=[(1, 1, "A", "a@x"), (2, 2, "B", "b@x"), (3, 3, "C", "c@x")])
    ids = spark.createDataFrame([(1,)], "ticket_id long")
    after = M.delete_tickets(m, ids)
    assert after["tickets"].count() == 1 and after["ratings"].count() == 0 and after["ticket_tags"].count() == 1
    asked = spark.createDataFrame([(1,), (3,)], "customer_id long")
    assert [r.customer_id for r in M.refused_customer_deletes(m, asked).collect()] == [1]
    assert sorted(r.customer_id for r in M.delete_customers(m, asked).collect()) == [1, 2]
    patch = spark.createDataFrame([(2, "SOLVED", None), (9, "OPEN", None)], "ticket_id long, status string, assignee_name string")
    patched = {r.ticket_id: r for r in M.patch_rows(m.tickets, patch, "ticket_id").collect()}
    assert patched[2].status == "SOLVED" and patched[2].assignee_name == "Suporte" and patched[1].status == "OPEN"
    assert [r.ticket_id for r in M.unknown_patch_ids(m.tickets, patch, "ticket_id").collect()] == [9]
    pairs = spark.createDataFrame([(1, "dns"), (5, "x")], "ticket_id long, tag_id string")
    assert M.unlink(m.ticket_tags, pairs).count() == 1


def test_same_batch_versions_and_ties(spark):
    rows = [(1, 1, ts("2026-01-01 01:00:00")), (2, 1, ts("2026-01-01 01:00:00")),  # tie keeps the first
            (3, 1, ts("2026-01-01 02:00:00")), (4, 1, ts("2026-01-01 01:30:00"))]  # late one ignored
    df = spark.createDataFrame(rows, "seq long, ticket_id long, source_updated_at timestamp_ntz")
    flags = [r.applied for r in I.apply_flags(df).orderBy("seq").collect()]
    assert flags == [True, False, True, False]


def test_ticket_gaps_hot_customer_spans_slices(spark):
    from pyspark.sql import Window
    rows = [(i, 1 if i % 10 else 2 + i % 7, "OPEN", "NORMAL", None, None,
             datetime(2026, 1, 1) + __import__("datetime").timedelta(minutes=7 * i + (i % 3)), None, None)
            for i in range(1200)]
    t = spark.createDataFrame(rows, TICKET_SCHEMA)
    got = {r.ticket_id: r.previous_at for r in D.ticket_gaps(t, partitions=8).collect()}
    w = Window.partitionBy("customer_id").orderBy("source_created_at", "ticket_id")
    want = {r.ticket_id: r.p for r in t.select("ticket_id", F.lag("source_created_at").over(w).alias("p")).collect()}
    assert got == want
    # the hot customer really is spread over several slices
    keys = ["customer_id", "source_created_at", "ticket_id"]
    slices = (t.repartitionByRange(8, *keys).withColumn("s", F.spark_partition_id())
              .filter(F.col("customer_id") == 1).select("s").distinct().count())
    assert slices > 4


def test_dashboard_bundle_matches_operators(spark):
    from helpdesk_lake.plans.catalog import COMPARE
    from helpdesk_lake.plans.dashboard_bundle import dashboard_overview
    from helpdesk_lake.sources.fixtures import fixture_model
    from helpdesk_lake.plans.compare import digest

    m = fixture_model(spark, "/root/testdata/sf0.001")
    bundle = dashboard_overview(m, COMPARE)

    def same(a, b):
        cols = sorted(b.columns)
        ra = [tuple(r) for r in a.select(*cols).collect()]
        rb = [tuple(r) for r in b.select(*cols).collect()]
        assert digest(cols, ra)[0] == digest(cols, rb)[0]

    same(bundle["status_distribution"], C.status_distribution(m, COMPARE))
    same(bundle["priority_breakdown"], C.priority_breakdown(m, COMPARE))
    same(bundle["first_response_distribution"].drop("share"),
         C.first_response_distribution(m, COMPARE).drop("share"))
    same(bundle["operation_timeseries"], C.operation_timeseries(D.timeline(m, COMPARE, 90)))
    totals = bundle["grouped"].filter("dimension = 'all' AND is_current").first()
    summary = D.period_summary(m, COMPARE).first()
    assert totals.ticket_count == summary.total_tickets and totals.good_ratings == summary.good_ratings
    assert bundle["summary"].count() == 1 and bundle["assignee_options"].count() > 0


def test_json_snapshot_and_ordered_scan(spark, tmp_path):
    from helpdesk_lake.sinks.reports import current_snapshot, expire_snapshots, read_json_snapshot, write_json_snapshot
    schema = "id long, name string, x string"
    df = spark.createDataFrame([(i, f"n{i}", None) for i in range(50)], schema)
    target = str(tmp_path / "snap")
    first = write_json_snapshot(df.repartition(4), target)
    folder = current_snapshot(spark, target).folder
    # the digest again, from the files themselves
    parts = sorted(p for p in Path(folder).glob("part-*") if p.suffix != ".crc")
    lines = "\n".join(f"{p.name} {hashlib.sha256(p.read_bytes()).hexdigest()}" for p in parts)
    assert first == hashlib.sha256(lines.encode()).hexdigest() and len(parts) > 1
    second = write_json_snapshot(df.limit(30), target)
    assert second != first and current_snapshot(spark, target).rows == 30
    assert read_json_snapshot(spark, target, schema).count() == 30
    assert Path(folder).exists()  # readers of the earlier snapshot go on
    write_json_snapshot(df.limit(0), target)
    assert read_json_snapshot(spark, target, schema).count() == 0
    assert expire_snapshots(spark, target, keep=1) == 2 and not Path(folder).exists()
    assert read_json_snapshot(spark, target, schema).count() == 0
    ordered = L.ordered_scan(df.select("id").repartition(7), "id", partitions=4)
    parts = ordered.rdd.glom().map(lambda rows: [r.id for r in rows]).collect()
    flat = [i for p in parts for i in p]
    assert flat == sorted(flat) == list(range(50))


def test_index_search_equals_scan_search(spark, tmp_path):
    from helpdesk_lake.sources.fixtures import fixture_model
    m = fixture_model(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "idx")
    L.write_search_index(m, path, partitions=4)
    idx = spark.read.parquet(path)
    for search in ("der die", "ch er", "Agent 9103", "12", "zzzzqq"):
        scan = [r.ticket_id for r in L.ticket_page(m, search=search, page_size=100).collect()]
        via_index = [r.ticket_id for r in L.ticket_page(m, search=search, page_size=100, index=idx).collect()]
        assert scan == via_index, search
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        idx.filter(F.col("token").startswith("der")).explain()
    assert "StringStartsWith" in buf.getvalue()  # the prefix reaches the Parquet scan


def test_optional_collation(spark):
    tickets = [T(1, 1, "OPEN", "2026-01-01 00:00:00"), T(2, 2, "OPEN", "2026-01-02 00:00:00")]
    m = make_model(spark, tickets, links=[(1, "Configuração"), (2, "dns")],
                   customers=[(1, 1, "José Álvares", "alvares@x"), (2, 2, "Maria", "maria@x")])
    plain = AnalyticsFilters.create(tag_names="configuracao")
    ci_ai = AnalyticsFilters.create(tag_names="configuracao", collation="UNICODE_CI_AI")
    assert D.period_summary(m, plain).first().total_tickets == 0
    assert D.period_summary(m, ci_ai).first().total_tickets == 1
    assert L.customer_page(m, search="jose").count() == 0
    assert [r.customer_id for r in L.customer_page(m, search="jose", collation="UNICODE_CI_AI").collect()] == [1]


def test_parquet_layout_prunes_and_agrees(spark, tmp_path):
    import contextlib
    import io
    from helpdesk_lake.sources.fixtures import fixture_model
    from helpdesk_lake.sources.tables import parquet_model, write_model
    from helpdesk_lake.plans.catalog import PERIOD
    src = fixture_model(spark, "/root/testdata/sf0.001")
    write_model(src, str(tmp_path / "tables"), partitions=4)
    pm = parquet_model(spark, str(tmp_path / "tables"))
    a = D.period_summary(src, PERIOD).first()
    b = D.period_summary(pm, PERIOD).first()
    assert a == b
    assert C.topic_breakdown(src, PERIOD).collect() == C.topic_breakdown(pm, PERIOD).collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        D.filtered_tickets(pm, PERIOD).explain()
    assert "PartitionFilters: [isnotnull(created_month" in buf.getvalue()
    from helpdesk_lake.plans.catalog import COMPARE
    t, _ = C.two_period_tickets(pm, COMPARE)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        t.explain()
    assert "PartitionFilters: [isnotnull(created_month" in buf.getvalue()
    assert C.metrics_comparison(src, COMPARE).collect() == C.metrics_comparison(pm, COMPARE).collect()


def test_metric_rows_and_report_formats(spark, tmp_path, comparison_model):
    from helpdesk_lake.sinks.reports import write_report
    overall = E.metrics_overall(comparison_model, CUR, top_topics_limit=2).collect()
    codes = [r.metric_code for r in overall]
    assert codes[:5] == ["ticket_volume", "average_recurrence_seconds", "resolution_rate", "satisfaction_rate",
                         "average_first_response_seconds"]
    topics = [r for r in overall if r.metric_code == "top_topics"]
    assert [r.rank for r in topics] == [1, 2] and {r.dimension for r in topics} == {"dns", "ssl"}
    resp = [r for r in overall if r.metric_code == "average_first_response_seconds"][0]
    assert resp.sample_size == 2 and resp.value == 900.0 and resp.period_start == "2026-08-10T00:00:00"
    per_customer = E.metrics_by_customer(comparison_model, CUR, metrics="average_first_response_seconds,top_topics",
                                         top_topics_limit=1).collect()
    resp_rows = [r for r in per_customer if r.metric_code == "average_first_response_seconds"]
    assert resp_rows and all(r.sample_size is None for r in resp_rows)  # Q9
    assert resp_rows[0].scope_label == "Cliente 1 <c1@example.com>"
    assert [r.rank for r in per_customer if r.metric_code == "top_topics"] == [1]
    with pytest.raises(ValueError):
        E.metrics_overall(comparison_model, CUR, metrics="nope")
    with pytest.raises(ValueError):
        write_report(E.data_export(comparison_model, CUR), "pdf", str(tmp_path / "x"))
    manifest = write_report(E.data_export(comparison_model, CUR, preset="essential"), "xlsx",
                            str(tmp_path / "xlsx"), sheet="Tickets", partitions=1).collect()
    assert sum(r.rows for r in manifest) == 2
    write_report(E.data_export(comparison_model, CUR, preset="essential"), "csv", str(tmp_path / "csv"), partitions=1)
    header = next((tmp_path / "csv").glob("part-*.csv")).read_text(encoding="utf-8-sig").splitlines()[0]
    assert header.split(",") == ["ticket_id", "subject", "status", "priority", "requester_name", "assignee_name",
                                 "created_at", "first_response_at", "tags", "satisfaction_rating"]


def test_argument_rules():
    from helpdesk_lake.filters import period_preset
    now = datetime(2026, 8, 15, 14, 30)
    assert period_preset("today", now) == (datetime(2026, 8, 15), now)
    assert period_preset("7d", now) == (datetime(2026, 8, 8, 14, 30), now)
    assert period_preset("30d", now, scope="export") == (datetime(2026, 7, 16), now)
    assert period_preset("all", now, scope="export") == (None, None)
    assert period_preset("custom", now, scope="export", custom_from="2026-08-01", custom_to="2026-08-02") == \
        (datetime(2026, 8, 1), datetime(2026, 8, 2, 23, 59, 59, 999000))
    with pytest.raises(ValueError):
        period_preset("all", now)  # not a dashboard preset
    from helpdesk_lake.plans.dashboard_bundle import dashboard_overview
    with pytest.raises(ValueError):
        dashboard_overview(None, AnalyticsFilters(), top_topics_limit=51)
    with pytest.raises(ValueError):
        dashboard_overview(None, AnalyticsFilters(), timeline_limit=0)
    with pytest.raises(ValueError):
        E.metrics_overall(None, AnalyticsFilters(), top_topics_limit=0)
    with pytest.raises(ValueError):
        L.ticket_page(None, statuses=["unknown"])

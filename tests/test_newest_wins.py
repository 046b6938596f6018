"""Newest-wins flags, winners and identity conflicts against the record-by-record rules, with hot keys."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helpdesk_lake.functions import expressions as X
from helpdesk_lake.operators import ingestion as I

SCHEMA = "ticket_id long, seq long, source_updated_at timestamp_ntz, subject string"


def feed(n, seed):
    """A third and more of the records belong to ticket 5; updates come out of order, repeated and late."""
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    return [(5 if rng.random() < 0.4 else rng.randrange(40), k, start + timedelta(minutes=rng.randrange(n // 3)), f"s{k}") for k in range(n)]


def one_by_one(rows, stored):
    bar, flags, last = dict(stored), {}, {}
    for ticket, seq, at, subject in sorted(rows, key=lambda r: r[1]):
        applied = ticket not in bar or at > bar[ticket]
        flags[seq] = (applied, ticket not in bar)
        if applied:
            last[ticket] = (seq, subject)
        bar[ticket] = max(bar.get(ticket, at), at)
    return flags, last


def test_hot_ticket_spans_slices(spark):
    rows = feed(900, 3)
    stored = {5: datetime(2026, 1, 1, 1), 7: datetime(2026, 2, 1), 99: datetime(2026, 1, 1)}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    old = spark.createDataFrame([(k, v) for k, v in stored.items()] + [(5, datetime(2025, 1, 1))], "ticket_id long, source_updated_at timestamp_ntz")
    for versions, known in ((None, {}), (old, stored)):
        flags, last = one_by_one(rows, known)
        got = {r.seq: (r.applied, r.created) for r in I.apply_flags(df, versions, slices=8).collect()}
        assert got == flags
        assert {r.ticket_id: (r.seq, r.subject) for r in I.latest_versions(df, versions).collect()} == last
    # the hot ticket really lies in several slices
    spread = df.repartitionByRange(8, "ticket_id", "seq").where("ticket_id = 5").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 3


def test_no_window_over_records(spark):
    df = spark.createDataFrame(feed(50, 1), SCHEMA)
    plan = I.latest_versions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert I.apply_flags(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_email_conflicts(spark):
    """An e-mail and an id that many records share; conflicts found without a window."""
    rows = [(k, "hot@x.y") for k in range(300)] + [(1000, f"m{k}@x.y") for k in range(300)] + [(2000 + k, f"own{k}@x.y") for k in range(50)] * 3
    df = spark.createDataFrame(rows, "external_requester_id long, requester_email string")
    found = I.identity_conflicts(df)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r[0], r[1]) for r in found.collect()} == {r for r in rows if r[0] < 2000}
    stored = spark.createDataFrame([(2000, "other@x.y"), (7777, "own1@x.y")], "external_requester_id long, requester_email string")
    against = I.identity_conflicts(df, stored).where("reason LIKE '%existing%'")
    assert {(r[0], r[1]) for r in against.collect()} == {(2000, "own0@x.y"), (2001, "own1@x.y")}


def test_trim_takes_every_white_space(spark):
    odd = "\t 　\x1f a  b \x85 "
    df = spark.createDataFrame([(odd,), ("",), (None,), ("   ",)], "t string")
    assert [r[0] for r in df.select(X.strip_space("t")).collect()] == [odd.strip(), "", None, ""]

"""Offset pages by order statistics, page tokens, folded search, and maintenance written back."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpdesk_lake.model import TicketModel
from helpdesk_lake.operators import listings as L
from helpdesk_lake.operators.paging import OrderedRows, offset_page
from helpdesk_lake.sinks import maintain
from helpdesk_lake.sources.tables import parquet_model, read_table, write_model

TICKETS = ("ticket_id long, customer_id long, status string, priority string, assignee_external_id long, assignee_name string, "
           "source_created_at timestamp_ntz, source_updated_at timestamp_ntz, first_response_at timestamp_ntz")


def small_model(spark, texts=None):
    rows = [(k, k % 3, "OPEN", "LOW", 9100, "José Ängström" if k == 4 else "Ann", datetime(2026, 1 + k % 4, 1 + k), datetime(2026, 6, 1), None) for k in range(12)]
    links = [(k, t) for k in range(12) for t in ("dns", "ssl") if k % 2 or t == "dns"]
    return TicketModel(sources={
        "tickets": spark.createDataFrame(rows, TICKETS),
        "customers": spark.createDataFrame([(k, k, f"n{k}", f"n{k}@x") for k in range(5)],
                                           "customer_id long, external_requester_id long, requester_name string, requester_email string"),
        "ratings": spark.createDataFrame([(k, "GOOD", None, None, "") for k in range(0, 12, 2)],
                                         "ticket_id long, score string, offered_at timestamp_ntz, rated_at timestamp_ntz, comment string"),
        "ticket_text": spark.createDataFrame([(k, f"s{k}", (texts or {}).get(k, "plain words")) for k in range(12)], "ticket_id long, subject string, description string"),
        "tags": spark.createDataFrame([("dns", "dns"), ("ssl", "ssl")], "tag_id string, name string"),
        "ticket_tags": spark.createDataFrame(links, "ticket_id long, tag_id string"),
    }, tag_ids_are_names=True)


def test_any_page_reads_its_slices_only(spark):
    """Rows of which most share the first key; pages near and far, across slice borders, empty and beyond the end."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("volume"))
    keys = [F.desc("volume"), F.asc("id")]
    want = [r.id for r in df.orderBy(*keys).collect()]
    ordered = OrderedRows(df, keys, slices=8)
    assert ordered.total == 2000 and len(ordered.counts) >= 6
    for start, stop in ((0, 5), (240, 270), (1234, 1300), (1990, 2010), (5000, 5020)):
        got = ordered.between(start, stop)
        assert [(r.place, r.id) for r in got.orderBy("place").collect()] == list(enumerate(want))[start:stop]
    plan = ordered.between(1234, 1240)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_slice" in plan or "PartitionFilters: [(_slice" in plan
    assert "Sort" not in plan and "Exchange" not in plan
    rows, total = offset_page(df.limit(0), keys, 1, 20)
    assert rows.count() == 0 and total == 0


def test_page_tokens(spark):
    token = "eyJzb3VyY2VfY3JlYXRlZF9hdCI6IjE5OTgtMDMtMDFUMDA6MDA6MDAiLCJpZCI6Ijk5OTk5OSJ9"
    key = L.page_key(spark, token, L.TICKET_KEY)
    assert (key.source_created_at, key.id) == (datetime(1998, 3, 1), 999999)
    for bad in ("", "nonsense", token[:20], "e30=", "bnVsbA==", "/////w=="):
        with pytest.raises(ValueError, match="page token"):
            L.page_key(spark, bad, L.TICKET_KEY)
    m = small_model(spark)
    first = L.ticket_page(m, page_size=5).collect()
    assert not first[0].has_previous and first[0].has_next
    second = L.ticket_page(m, page_size=5, cursor=first[0].next_cursor).collect()
    assert second[0].has_previous and {r.ticket_id for r in first} & {r.ticket_id for r in second} == set()
    assert len(L.ticket_page(m).collect()) == 12 and L.PAGE_SIZE == 20


def test_folded_index_search(spark, tmp_path):
    """Accents and case are folded on both sides; the prefix reaches the scan of the index."""
    m = small_model(spark, {1: "Über Öl und CAFÉS", 2: "uber ol", 3: "cafe", 5: "Straße"})
    path = str(tmp_path / "index")
    L.write_search_index(m, path, folded=True)
    index = spark.read.schema("ticket_id long, token string").parquet(path)

    def found(search):
        return {r.ticket_id for r in L.ticket_page(m, search=search, index=index, folded=True).collect()}

    assert found("ÜBER öl") == {1, 2} and found("Café") == {1, 3} and found("stra") == {5} and found("JOSE angst") == {4}
    assert found("zzz") == set()
    plan = L.index_matches(index, ["cafe"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,cafe)" in plan
    with pytest.raises(ValueError, match="index"):
        L.ticket_page(m, search="x", folded=True)


@pytest.fixture
def tables(spark, tmp_path):
    root = str(tmp_path / "tables")
    write_model(small_model(spark), root, partitions=2)
    return root


def ids(spark, root, name):
    return sorted(r.ticket_id for r in read_table(spark, root, name).collect())


def test_refused_changes_write_nothing(spark, tables):
    m = parquet_model(spark, tables)
    before = {n: read_table(spark, tables, n).count() for n in ("tickets", "ratings", "ticket_tags", "customers")}
    new = m.tickets.limit(1)
    orphan = new.withColumn("ticket_id", F.lit(77).cast("long")).withColumn("customer_id", F.lit(99).cast("long"))
    for rows, why in ((new, "duplicate key"), (orphan, "missing parent"), (orphan.withColumn("customer_id", F.lit(1).cast("long")).union(orphan.withColumn("customer_id", F.lit(1).cast("long"))), "in insert")):
        with pytest.raises(maintain.RuleBroken, match=why):
            maintain.insert_tickets(spark, tables, rows)
    patch = spark.createDataFrame([(1, "HOLD"), (55, "HOLD")], "ticket_id long, status string")
    with pytest.raises(maintain.RuleBroken, match="unknown ticket.*55"):
        maintain.patch_tickets(spark, tables, patch)
    with pytest.raises(maintain.RuleBroken, match="twice"):
        maintain.patch_tickets(spark, tables, patch.limit(1).union(patch.limit(1)))
    with pytest.raises(maintain.RuleBroken, match="customers with tickets"):
        maintain.delete_customers(spark, tables, spark.createDataFrame([(0,), (4,)], "customer_id long"))
    assert before == {n: read_table(spark, tables, n).count() for n in before}
    assert {r.status for r in read_table(spark, tables, "tickets").collect()} == {"OPEN"}


def test_changes_rewrite_their_months_only(spark, tables, tmp_path):
    from pathlib import Path

    def files():
        return {p.parent.name: {q.name for q in p.parent.glob("part-*")} for p in Path(tables, "tickets").glob("*/part-*")}

    old = files()
    patch = spark.createDataFrame([(1, "HOLD", None), (5, None, "Bo")], "ticket_id long, status string, assignee_name string")
    maintain.patch_tickets(spark, tables, patch)  # both of February
    now = files()
    assert now["created_month=2026-02"] != old["created_month=2026-02"]
    assert {k: v for k, v in now.items() if k[-2:] != "02"} == {k: v for k, v in old.items() if k[-2:] != "02"}
    rows = {r.ticket_id: (r.status, r.assignee_name) for r in read_table(spark, tables, "tickets").collect()}
    assert rows[1] == ("HOLD", "Ann") and rows[5] == ("OPEN", "Bo") and rows[9] == ("OPEN", "Ann")
    # all of March goes: its partitions too, and whatever belongs to its tickets; absent ids are no error
    gone = spark.createDataFrame([(2,), (6,), (10,), (500,)], "ticket_id long")
    maintain.delete_tickets(spark, tables, gone)
    assert ids(spark, tables, "tickets") == [0, 1, 3, 4, 5, 7, 8, 9, 11] and "created_month=2026-03" not in files()
    assert ids(spark, tables, "ratings") == [0, 4, 8] and not set(ids(spark, tables, "ticket_text")) & {2, 6, 10}
    maintain.unlink(spark, tables, spark.createDataFrame([(1, "ssl"), (1, "none"), (700, "ssl")], "ticket_id long, tag_id string"))
    links = [(r.ticket_id, r.tag_id) for r in read_table(spark, tables, "ticket_tags").collect()]
    assert (1, "ssl") not in links and (1, "dns") in links and (3, "ssl") in links
    maintain.delete_tags(spark, tables, spark.createDataFrame([("dns",)], "tag_id string"))
    assert {r.tag_id for r in read_table(spark, tables, "ticket_tags").collect()} == {"ssl"} and read_table(spark, tables, "tags").count() == 1
    maintain.delete_customers(spark, tables, spark.createDataFrame([(4,)], "customer_id long"))
    assert read_table(spark, tables, "customers").count() == 4
    one = parquet_model(spark, tables).tickets.limit(1).withColumn("ticket_id", F.lit(90).cast("long"))
    maintain.insert_tickets(spark, tables, one)
    assert 90 in ids(spark, tables, "tickets")

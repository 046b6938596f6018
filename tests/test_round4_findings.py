"""Findings of round 4."""

from __future__ import annotations

from helpdesk_lake.model import TicketModel
from helpdesk_lake.operators import listings as L


def _tickets(spark):
    rows = ", ".join(f"({k}, 'OPEN', 'HIGH', {name}, TIMESTAMP_NTZ '1998-01-01 00:00:0{second}')" for k, name, second in (
        (1, "'der die x'", 1), (2, "NULL", 2), (3, "'Agent'", 3), (3, "'Agent'", 4), (4, "NULL", 5), (5, "NULL", 6)))
    tickets = spark.sql(f"SELECT ticket_id, status, priority, assignee_name, at AS source_created_at, at AS source_updated_at "
                        f"FROM VALUES {rows} AS t(ticket_id, status, priority, assignee_name, at)").withColumn("ticket_id", L.F.col("ticket_id").cast("long"))
    text = spark.createDataFrame([(1, "nothing", "here"), (2, "Der", "DIEsel"), (3, "der", None), (3, "a", "die der"), (3, "b", "die, der"), (5, None, None)],
                                 "ticket_id long, subject string, description string")
    return TicketModel(sources={"tickets": tickets, "ticket_text": text})


def test_search_moves_no_description(spark):
    """whether a text matches is told before the join, so descriptions cross no shuffle; ids that repeat and tickets without text as before."""
    m = _tickets(spark)
    page = L.ticket_page(m, search="der  die", page_size=10)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "description" not in plan.split("Join LeftOuter", 1)[0]
    got = [(r.ticket_id, r.source_created_at.second, r.subject) for r in page.collect()]
    assert sorted(got) == [(1, 1, "nothing"), (2, 2, "Der"), (3, 3, "a"), (3, 3, "b"), (3, 4, "a"), (3, 4, "b")]
    assert [r.ticket_id for r in L.ticket_page(m, search="4").collect()] == [4]
    assert [r.ticket_id for r in L.ticket_page(m, search="%").collect()] == []
    assert sorted((r.ticket_id, r.subject) for r in L.ticket_page(m, search="Agent").collect()) == [(3, "a")] * 2 + [(3, "b")] * 2 + [(3, "der")] * 2


def test_filters_beyond_the_bound_are_broadcast_in_groups(spark, monkeypatch):
    """F2: op8 scores texts against a filter that is too large to hold without writing their n-grams, and to the same figures."""
    import random

    from helpdesk_lake.llm import lm_bloom

    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for k in range(200)] + [(None, "w1 w2 w3"), (7, None), (8, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lm_bloom.fit(docs.select("text"))
    groups = lm_bloom.fit(docs.select("text"), filter_bytes=lm_bloom.BLOCK_BITS // 8)  # one block at a time
    assert held[0].spread is None and groups[0].group == 1 and sum(part[2] for part in groups[0].spread) > 2
    monkeypatch.setattr(lm_bloom, "_spread_scores", None)
    monkeypatch.setattr(lm_bloom, "RUN", 5000)
    one, other = ([tuple(r)[:4] + (round(r.base_score, 6), round(r.score, 6)) for r in lm_bloom.score(docs, *m).collect()] for m in (held, groups))
    assert len(one) == len(rows) and sorted(one, key=str) == sorted(other, key=str)
    monkeypatch.setattr(lm_bloom, "GROUPS", 1)
    assert lm_bloom.fit(docs.select("text"), filter_bytes=lm_bloom.BLOCK_BITS // 8)[0].group == 0  # still larger ones are joined


def test_export_sorts_and_shuffles_no_text(spark, tmp_path, monkeypatch):
    """F8: documents beyond one broadcast come in pieces, and the sort is one of narrow records, whatever repeats or is null."""
    from helpdesk_lake.filters import AnalyticsFilters
    from helpdesk_lake.operators import exports as E
    from helpdesk_lake.sources import fixtures

    made = {
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
                   [f"({k}, {k % 3 + 1}, 'F', TIMESTAMP_NTZ '1996-01-0{k % 9 + 1} 00:00:00', '1-URGENT')" for k in (9, 3, 7, 1, 8, 2, 5, 6, 12, 5)]),
        "customer": ("c_custkey long, c_name string", [f"({k}, 'Customer#{k}')" for k in (1, 2, 3)]),
        "part": ("p_partkey long, p_name string, p_type string, p_brand string", ["(1, 'bolt', 'STEEL', 'Brand#1')"]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string", ["(3, 1, 1, 1, 'A')"]),
        "documents": ("doc_id long, text string", ["(0, 'zero')", "(1, 'one')", "(1, 'one again')", "(2, NULL)", "(NULL, 'none')"]),
    }
    for name, (schema, rows) in made.items():
        cols = [c.split() for c in schema.split(", ")]
        df = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({', '.join(c for c, _ in cols)})")
        df.selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in cols]).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = {0: ["zero"], 1: ["one", "one again"]}  # slot k % 5
    wanted = sorted(((k, "STEEL bolt" if k == 3 else "no lines", t) for k in (1, 2, 3, 5, 5, 6, 7, 8, 9, 12) for t in texts.get(k % 5, [None])), key=str)
    for bytes_, pieces in ((64 << 20, 1), (8, 3), (4, 0)):  # 20 bytes of text; more than four pieces are shuffled
        monkeypatch.setattr(fixtures, "BROADCAST_BYTES", bytes_)
        out = E.data_export(fixtures.fixture_model(spark, str(tmp_path)), AnalyticsFilters())
        above = out._jdf.queryExecution().executedPlan().toString().split("Exchange rangepartitioning")[0]
        assert above.count("Join [doc_slot") == pieces
        if pieces:
            assert above.index("Join [doc_slot") < above.index("Sort [ticket_id") and above.count("Sort [") == 1
        got = [(r.ticket_id, r.subject, r.description) for r in out.collect()]
        assert [r[0] for r in got] == sorted(r[0] for r in got) and sorted(got, key=str) == wanted


def test_index_of_postings_holds_a_token_once_a_run(spark, tmp_path, monkeypatch):
    """the index that the searches write has a row a token and run, not one a ticket, with the same pairs and pages."""
    rows = [(1, "Café", "der die der"), (2, None, None), (3, "x_1", ""), (4, "", "DIE Öl-Uhr der"), (5, "...", "--"), (6, "ÉN", "der ΑΣ die İ"), (6, "en", "der")]
    m = TicketModel(sources={"ticket_text": spark.createDataFrame(rows, "ticket_id long, subject string, description string").coalesce(1)})
    for folded in (False, True):
        path = str(tmp_path / f"p{folded}")
        L.write_search_index(m, path, folded=folded, postings=True)
        index = spark.read.schema(L.POSTINGS).parquet(path)
        wanted = L.search_index(m, folded).select("token", "ticket_id")
        held = index.select("token", L.F.explode("ticket_ids").alias("ticket_id"))
        assert held.exceptAll(wanted).isEmpty() and wanted.exceptAll(held).isEmpty()
        assert index.count() == wanted.select("token").distinct().count() < wanted.count()
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionNum", None) is None  # set for the write only
        for terms in (["der"], ["der", "di"], ["d", "der", "en"], ["nie"], []):
            assert sorted(r[0] for r in L.index_matches(index, terms).collect()) == sorted(r[0] for r in L.index_matches(wanted, terms).collect())
    monkeypatch.setattr(L, "RUN_TOKENS", 3)
    L.write_search_index(m, str(tmp_path / "runs"), postings=True)
    runs = spark.read.parquet(str(tmp_path / "runs")).select("token", L.F.explode("ticket_ids").alias("ticket_id"))
    wanted = L.search_index(m).select("token", "ticket_id")
    assert runs.exceptAll(wanted).isEmpty() and wanted.exceptAll(runs).isEmpty()

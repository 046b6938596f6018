"""Maintenance and text-helper queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import maintenance as M
from ..operators.filtering import apply_filters
from ..session import scratch_path
from ..sinks import maintain
from ..sources.tables import parquet_model, write_model
from .catalog import PERIOD, period_sql, register
from .oracle_model import with_model

P = period_sql(PERIOD)
T_COLS = ("ticket_id", "customer_id", "status", "priority", "assignee_external_id", "assignee_name")


def _patch(m):
    """Close every solved ticket of the period and hand it to agent 9100;
    null name in the patch keeps the stored one."""
    solved = apply_filters(m, PERIOD).filter(F.col("status") == "SOLVED")
    patch = solved.select("ticket_id", F.lit("CLOSED").alias("status"),
                          F.lit(9100).cast("long").alias("assignee_external_id"),
                          F.lit(None).cast("string").alias("assignee_name"))
    return M.patch_rows(m.tickets, patch, "ticket_id").select(*T_COLS)


register("bulk_patch", "M2", with_model(f"""
SELECT ticket_id, customer_id,
       CASE WHEN {P} AND status = 'SOLVED' THEN 'CLOSED' ELSE status END AS status, priority,
       CASE WHEN {P} AND status = 'SOLVED' THEN 9100 ELSE assignee_external_id END AS assignee_external_id,
       assignee_name
FROM m_tickets"""))(_patch)


def _delete(m):
    """Delete the LOW-priority tickets of the period (cascading), then count
    what remains per table."""
    doomed = apply_filters(m, PERIOD).filter(F.col("priority") == "LOW").select("ticket_id")
    after = M.delete_tickets(m, doomed)
    parts = [df.agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(name).alias("table_name"), "remaining")
             for name, df in after.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DOOMED = f"SELECT ticket_id FROM m_tickets WHERE {P} AND priority = 'LOW'"
register("bulk_delete", "M3", with_model(f"""
SELECT 'tickets' AS table_name, count(*) AS remaining FROM m_tickets WHERE ticket_id NOT IN ({DOOMED})
UNION ALL SELECT 'ratings', count(*) FROM m_ratings WHERE ticket_id NOT IN ({DOOMED})
UNION ALL SELECT 'ticket_tags', count(*) FROM m_ticket_tags WHERE ticket_id NOT IN ({DOOMED})"""))(_delete)


def _refused(m):
    """Customers asked for deletion: every customer whose name ends in 0;
    those with tickets are refused (RESTRICT)."""
    asked = m.customers.filter(F.col("requester_name").endswith("0")).select("customer_id")
    return M.refused_customer_deletes(m, asked)


register("customer_delete_refused", "M3", with_model("""
SELECT customer_id FROM m_customers c WHERE requester_name LIKE '%0'
  AND EXISTS (SELECT 1 FROM m_tickets t WHERE t.customer_id = c.customer_id)"""))(_refused)


def _unlink(m):
    pairs = apply_filters(m, PERIOD).select("ticket_id").withColumn("tag_id", F.lit("brand#13"))
    left = M.unlink(m.ticket_tags, pairs)
    return left.groupBy("tag_id").agg(F.count(F.lit(1)).alias("links"))


register("unlink_tags", "M4", with_model(f"""
SELECT tag_id, count(*) AS links FROM m_ticket_tags tt
WHERE NOT (tag_id = 'brand#13' AND ticket_id IN (SELECT ticket_id FROM m_tickets WHERE {P}))
GROUP BY tag_id"""))(_unlink)


def _insert_check(m):
    """Re-insert the period's tickets, half of them pointing to a customer
    that does not exist: duplicates and missing parents are reported."""
    cand = apply_filters(m, PERIOD).select(
        "ticket_id", F.when(F.col("status") == "OPEN", F.col("customer_id") + 10**9)
        .otherwise(F.col("customer_id")).alias("customer_id"))
    return M.insert_violations(m.tickets, cand, ["ticket_id"],
                               {"customer_id": (m.customers, "customer_id")})


register("insert_violations", "M1", with_model(f"""
SELECT DISTINCT * FROM (
  SELECT ticket_id, 'duplicate key' AS violation FROM m_tickets WHERE {P}
  UNION ALL
  SELECT ticket_id, 'missing parent for customer_id' FROM m_tickets WHERE {P} AND status = 'OPEN'
    AND customer_id + 1000000000 NOT IN (SELECT customer_id FROM m_customers)) x"""))(_insert_check)


NEW_IDS = 10**9


def _applied(m):
    """The tables after all four: urgent tickets of the period inserted again under new ids, solved ones closed and handed to agent
    9100, low ones deleted with their ratings and links, one tag unlinked."""
    spark = m.tickets.sparkSession
    root = scratch_path(spark, f"tables-{uuid.uuid4().hex}")
    kept = ("tickets", "ratings", "tags", "ticket_tags", "customers")
    write_model(m, root, tables=kept)
    now = lambda: parquet_model(spark, root)
    urgent = apply_filters(now(), PERIOD).filter(F.col("priority") == "URGENT")
    maintain.insert_tickets(spark, root, urgent.withColumn("ticket_id", F.col("ticket_id") + NEW_IDS))
    solved = apply_filters(now(), PERIOD).filter(F.col("status") == "SOLVED")
    maintain.patch_tickets(spark, root, solved.select("ticket_id", F.lit("CLOSED").alias("status"), F.lit(9100).cast("long").alias("assignee_external_id"),
                                                      F.lit(None).cast("string").alias("assignee_name")))
    low = apply_filters(now(), PERIOD).filter(F.col("priority") == "LOW").select("ticket_id")
    maintain.delete_tickets(spark, root, low, ("tickets", "ratings", "ticket_tags"))
    maintain.unlink(spark, root, apply_filters(now(), PERIOD).select("ticket_id").withColumn("tag_id", F.lit("brand#13")))
    after = now()
    rated = after.rated_tickets(("score",)).groupBy("status", "priority").agg(
        F.count(F.lit(1)).alias("tickets"), F.count_if(F.col("assignee_external_id") == 9100).alias("handed"), F.count("score").alias("ratings"),
        F.sum("ticket_id").alias("id_sum"), F.count("assignee_name").alias("named"))
    links = (after.ticket_tags.join(after.tickets.select("ticket_id", "status", "priority"), "ticket_id")
             .groupBy("status", "priority").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("tag_id") == "brand#13").alias("of_tag")))
    return rated.join(links, ["status", "priority"], "left")


register("maintenance_applied", "M1 M2 M3 M4", with_model("""
SELECT a.status, a.priority, tickets, handed, ratings, id_sum, named, links, of_tag
FROM (SELECT status, priority, count(*) AS tickets, count(*) FILTER (assignee_external_id = 9100) AS handed, count(score) AS ratings,
             CAST(sum(ticket_id) AS BIGINT) AS id_sum, count(assignee_name) AS named FROM after_t LEFT JOIN m_ratings USING (ticket_id) GROUP BY 1, 2) a
LEFT JOIN (SELECT status, priority, count(*) AS links, count(*) FILTER (tag_id = 'brand#13') AS of_tag
           FROM after_t JOIN (SELECT ticket_id, tag_id, in_period FROM m_ticket_tags JOIN flagged USING (ticket_id)) l USING (ticket_id)
           WHERE NOT (tag_id = 'brand#13' AND l.in_period) GROUP BY 1, 2) b USING (status, priority)""", {
    "flagged": f"SELECT ticket_id, ({P}) AS in_period FROM m_tickets",
    "more": f"""SELECT ticket_id, status, priority, assignee_external_id, assignee_name, ({P}) AS in_period FROM m_tickets
                UNION ALL SELECT ticket_id + 1000000000, status, priority, assignee_external_id, assignee_name, TRUE FROM m_tickets
                WHERE {P} AND priority = 'URGENT'""",
    "after_t": """SELECT ticket_id, CASE WHEN in_period AND status = 'SOLVED' THEN 'CLOSED' ELSE status END AS status, priority,
                         CASE WHEN in_period AND status = 'SOLVED' THEN 9100 ELSE assignee_external_id END AS assignee_external_id, assignee_name
                  FROM more WHERE NOT (in_period AND priority = 'LOW')"""}))(_applied)

register("duration_text", "X18 X19 X1", with_model(f"""
SELECT ticket_id,
  CASE WHEN first_response_at IS NULL THEN '—'
    ELSE (WITH s AS (SELECT greatest(0, CAST(epoch(first_response_at) - epoch(source_created_at) AS BIGINT)) AS s)
          SELECT CASE WHEN s < 60 THEN s || 's'
                      WHEN s // 60 < 60 THEN (s // 60) || ' min'
                      WHEN s // 3600 < 24 THEN (s // 3600) || 'h' ||
                           CASE WHEN (s // 60) % 60 > 0 THEN ' ' || ((s // 60) % 60) || 'min' ELSE '' END
                      ELSE (s // 86400) || 'd' ||
                           CASE WHEN (s // 3600) % 24 > 0 THEN ' ' || ((s // 3600) % 24) || 'h' ELSE '' END END
          FROM s) END AS response_text,
  CASE WHEN first_response_at IS NULL THEN NULL
       ELSE CAST(greatest(0, round((epoch(first_response_at) - epoch(source_created_at)) / 60.0)) AS BIGINT) END AS response_minutes
FROM m_tickets"""))(lambda m: m.tickets.select(
    "ticket_id",
    X.duration_text(F.when(F.col("first_response_at").isNotNull(),
                           X.seconds_between("first_response_at", "source_created_at"))).alias("response_text"),
    X.whole_minutes_between("first_response_at", "source_created_at").alias("response_minutes")))


register("priority_display_order", "T10", with_model("""
SELECT priority, count(*) AS ticket_count,
       CAST(CASE priority WHEN 'URGENT' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'NORMAL' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END
            AS BIGINT) AS display_rank
FROM m_tickets GROUP BY priority"""))(lambda m: m.tickets.groupBy("priority").agg(
    F.count(F.lit(1)).alias("ticket_count")).withColumn("display_rank", X.priority_display_rank()))

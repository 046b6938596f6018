"""Customer metrics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..filters import CustomerMetricsArgs
from ..operators import customers as CM
from .catalog import PERIOD, period_sql, register
from .oracle_model import BAD, GOOD, RESOLVED, VALID_SECONDS, with_model

P = period_sql(PERIOD)


def _rate(n: str, d: str) -> str:
    return f"CASE WHEN {d} <> 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END"


AGG_SQL = f"""
  SELECT c.customer_id, c.external_requester_id, c.requester_name, c.requester_email,
         a.ticket_volume, a.resolved_tickets, a.good_ratings, a.bad_ratings, a.average_first_response_seconds,
         r.average_recurrence_seconds, a.ticket_volume - 1 AS recurrence_sample_intervals,
         {_rate('a.resolved_tickets', 'a.ticket_volume')} AS resolution_rate,
         {_rate('a.good_ratings', 'a.good_ratings + a.bad_ratings')} AS satisfaction_rate
  FROM (SELECT customer_id, count(*) AS ticket_volume, CAST(sum({RESOLVED}) AS BIGINT) AS resolved_tickets,
               CAST(sum({GOOD}) AS BIGINT) AS good_ratings, CAST(sum({BAD}) AS BIGINT) AS bad_ratings,
               round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds
        FROM m_rated WHERE {P} GROUP BY customer_id) a
  JOIN m_customers c ON c.customer_id = a.customer_id
  LEFT JOIN (SELECT customer_id, round(avg(CAST(epoch(cur_at) - epoch(prev_at) AS BIGINT)), 2) AS average_recurrence_seconds
             FROM (SELECT customer_id, source_created_at AS cur_at,
                          lag(source_created_at) OVER (PARTITION BY customer_id ORDER BY source_created_at, ticket_id) AS prev_at
                   FROM m_tickets WHERE {P}) x
             WHERE prev_at IS NOT NULL GROUP BY customer_id) r ON r.customer_id = a.customer_id"""


def topics_sql(k: int, restrict: str = "") -> str:
    return f"""
  SELECT customer_id, CAST(to_json(list({{'tag': tag, 'ticket_count': ticket_count}} ORDER BY rk)) AS VARCHAR)
         AS top_topics_json
  FROM (SELECT customer_id, tag, ticket_count,
               row_number() OVER (PARTITION BY customer_id ORDER BY ticket_count DESC, tag ASC) AS rk
        FROM (SELECT t.customer_id, l.tag, count(DISTINCT t.ticket_id) AS ticket_count
              FROM m_tickets t JOIN m_links l ON l.ticket_id = t.ticket_id
              WHERE {P} {restrict} GROUP BY 1, 2) x) y
  WHERE rk <= {k} GROUP BY customer_id"""


ALL_ARGS = CustomerMetricsArgs(filters=PERIOD, top_topics_limit=3)
register("customer_aggregates", "A10 A11 A17 J1 J2 D1", with_model("SELECT * FROM aggs", {"aggs": AGG_SQL}))(
    lambda m: CM.customer_aggregates(m, ALL_ARGS))

register("customer_top_topics", "W2 A12 A13", with_model(f"""
SELECT customer_id, topic_rank, tag, ticket_count FROM (
  SELECT customer_id, tag, ticket_count,
         CAST(row_number() OVER (PARTITION BY customer_id ORDER BY ticket_count DESC, tag ASC) AS INTEGER) AS topic_rank
  FROM (SELECT t.customer_id, l.tag, count(DISTINCT t.ticket_id) AS ticket_count
        FROM m_tickets t JOIN m_links l ON l.ticket_id = t.ticket_id WHERE {P} GROUP BY 1, 2) x) y
WHERE topic_rank <= 3"""))(lambda m: CM.customer_top_topic_rows(m, ALL_ARGS))

OUT_COLS = ("customer_id", "external_requester_id", "requester_name", "requester_email", "ticket_volume",
            "resolved_tickets", "good_ratings", "bad_ratings", "average_first_response_seconds",
            "average_recurrence_seconds", "recurrence_sample_intervals", "resolution_rate", "satisfaction_rate")


def _page_query(args: CustomerMetricsArgs):
    def build(m):
        page = CM.customer_metrics_page(m, args)
        return page.select(*OUT_COLS, F.to_json("top_topics").alias("top_topics_json"),
                           "total", "has_next", "has_previous")
    return build


PAGE_ARGS = CustomerMetricsArgs(filters=PERIOD, page=3, page_size=25, top_topics_limit=3)
register("customer_metrics", "D15 T4 J7 J11 A13 A14 W2", with_model(f"""
SELECT p.*, coalesce(tp.top_topics_json, '[]') AS top_topics_json,
       (SELECT count(*) FROM aggs) AS total,
       50 + count(*) OVER () < (SELECT count(*) FROM aggs) AS has_next,
       TRUE AS has_previous
FROM (SELECT * FROM aggs ORDER BY ticket_volume DESC, requester_name ASC, customer_id ASC LIMIT 25 OFFSET 50) p
LEFT JOIN ({topics_sql(3)}) tp ON tp.customer_id = p.customer_id""", {"aggs": AGG_SQL}))(_page_query(PAGE_ARGS))

RANGE_ARGS = CustomerMetricsArgs(filters=PERIOD, page=1, page_size=100, top_topics_limit=2,
                                 ticket_volume_min=3, ticket_volume_max=8,
                                 satisfaction_rate_min=0.25, satisfaction_rate_max=0.75)
register("customer_metrics_filtered", "F17 D15 T4 Q8", with_model(f"""
SELECT p.*, coalesce(tp.top_topics_json, '[]') AS top_topics_json,
       (SELECT count(*) FROM f) AS total,
       count(*) OVER () < (SELECT count(*) FROM f) AS has_next,
       FALSE AS has_previous
FROM (SELECT * FROM f ORDER BY ticket_volume DESC, requester_name ASC, customer_id ASC LIMIT 100) p
LEFT JOIN ({topics_sql(2)}) tp ON tp.customer_id = p.customer_id""",
    {"aggs": AGG_SQL, "f": """SELECT * FROM aggs WHERE ticket_volume >= 3 AND ticket_volume <= 8
       AND satisfaction_rate >= 0.25 AND satisfaction_rate <= 0.75"""}))(_page_query(RANGE_ARGS))

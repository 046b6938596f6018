"""DuckDB SQL text of the fixture model, for the correctness oracle.

Written independently of the DataFrame mapping in ``sources/fixtures.py`` so
the driver's side-by-side check compares two formulations. Every query's SQL
is ``WITH <model CTEs> <query>``; DuckDB drops the CTEs a query does not use.
"""

from __future__ import annotations

MODEL_CTES = {
    "m_customers": """
        SELECT c_custkey AS customer_id,
               c_custkey AS external_requester_id,
               c_name AS requester_name,
               lower(replace(c_name, '#', '.')) || '@example.com' AS requester_email
        FROM customer""",
    "m_tickets": """
        SELECT ticket_id, customer_id, status, priority, assignee_external_id, assignee_name,
               source_created_at,
               source_created_at + INTERVAL 1 HOUR AS source_updated_at,
               CASE WHEN ticket_id % 7 = 0 THEN NULL
                    WHEN ticket_id % 13 = 0 THEN source_created_at - INTERVAL 1 HOUR
                    ELSE source_created_at + to_seconds((ticket_id * 104729) % 21600) END
                 AS first_response_at
        FROM (
          SELECT o_orderkey AS ticket_id,
                 o_custkey AS customer_id,
                 CASE o_orderstatus
                   WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'SOLVED' ELSE 'CLOSED' END
                   WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'NEW' ELSE 'OPEN' END
                   WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'HOLD' END
                 END AS status,
                 CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH'
                                      WHEN '5-LOW' THEN 'LOW' ELSE 'NORMAL' END AS priority,
                 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 9100 + o_orderkey % 11 END
                   AS assignee_external_id,
                 CASE WHEN o_orderkey % 11 = 0 THEN NULL
                      ELSE 'Agent ' || CAST(9100 + o_orderkey % 11 AS VARCHAR) END AS assignee_name,
                 CAST(o_orderdate AS TIMESTAMP) + to_seconds((o_orderkey * 7919) % 86400)
                   AS source_created_at
          FROM orders) o""",
    "m_first_line": """
        SELECT l_orderkey AS ticket_id, l_partkey AS first_partkey, l_returnflag AS first_returnflag
        FROM (SELECT l_orderkey, l_partkey, l_returnflag,
                     row_number() OVER (PARTITION BY l_orderkey
                                        ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rn
              FROM lineitem) x
        WHERE rn = 1""",
    "m_ratings": """
        SELECT t.ticket_id,
               CASE f.first_returnflag WHEN 'A' THEN 'GOOD' WHEN 'R' THEN 'BAD'
                    WHEN 'N' THEN CASE WHEN t.ticket_id % 2 = 0 THEN 'OFFERED' ELSE 'UNOFFERED' END
               END AS score,
               t.source_created_at + INTERVAL 5 MINUTE AS offered_at,
               CASE WHEN f.first_returnflag IN ('A', 'R')
                    THEN t.source_created_at + INTERVAL 45 MINUTE END AS rated_at,
               '' AS comment
        FROM m_tickets t JOIN m_first_line f ON f.ticket_id = t.ticket_id""",
    "m_rated": """
        SELECT t.*, r.score, r.offered_at, r.rated_at, r.comment
        FROM m_tickets t LEFT JOIN m_ratings r ON r.ticket_id = t.ticket_id""",
    "m_text": """
        SELECT t.ticket_id,
               coalesce(p.p_type || ' ' || p.p_name, 'no lines') AS subject,
               d.text AS description
        FROM m_tickets t
        LEFT JOIN m_first_line f ON f.ticket_id = t.ticket_id
        LEFT JOIN part p ON p.p_partkey = f.first_partkey
        LEFT JOIN documents d ON d.doc_id = t.ticket_id % (SELECT count(*) FROM documents)""",
    "m_tags": """
        SELECT DISTINCT lower(p_brand) AS tag_id, lower(p_brand) AS name FROM part""",
    "m_ticket_tags": """
        SELECT DISTINCT l.l_orderkey AS ticket_id, lower(p.p_brand) AS tag_id
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "m_links": """
        SELECT tt.ticket_id, tt.tag_id, g.name AS tag
        FROM m_ticket_tags tt JOIN m_tags g ON g.tag_id = tt.tag_id""",
}

# Seconds between two timestamps.
def secs(end: str, start: str) -> str:
    return f"CAST(epoch({end}) - epoch({start}) AS BIGINT)"


VALID_RESPONSE = "(first_response_at IS NOT NULL AND first_response_at >= source_created_at)"
VALID_SECONDS = f"CASE WHEN {VALID_RESPONSE} THEN {secs('first_response_at', 'source_created_at')} END"
RESOLVED = "CASE WHEN status IN ('SOLVED', 'CLOSED') THEN 1 ELSE 0 END"
GOOD = "CASE WHEN score = 'GOOD' THEN 1 ELSE 0 END"
BAD = "CASE WHEN score = 'BAD' THEN 1 ELSE 0 END"
BUCKET = f"""CASE WHEN first_response_at IS NULL OR first_response_at < source_created_at THEN 'unanswered'
     WHEN {secs('first_response_at', 'source_created_at')} <= 900 THEN 'up_to_15m'
     WHEN {secs('first_response_at', 'source_created_at')} <= 1800 THEN '15_to_30m'
     WHEN {secs('first_response_at', 'source_created_at')} <= 3600 THEN '30_to_60m'
     WHEN {secs('first_response_at', 'source_created_at')} <= 14400 THEN '1_to_4h'
     ELSE 'over_4h' END"""


def with_model(query: str, extra_ctes: dict[str, str] | None = None) -> str:
    """Prefix a query with the model CTEs (and any query-specific CTEs)."""
    ctes = dict(MODEL_CTES)
    ctes.update(extra_ctes or {})
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {body}\n{query}"

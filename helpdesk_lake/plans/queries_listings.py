"""Listing, search and paging queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import listings as L
from ..session import scratch_path
from .catalog import register
from .oracle_model import with_model

# Search terms as the reference derives them, applied to the oracle text.
SEARCH = "  der   die  "
TERMS = L.search_terms(" ".join(SEARCH.split()))
TEXT = "lower(coalesce(x.subject, '') || ' ' || coalesce(x.description, ''))"


def _fts_sql(terms: list[str]) -> str:
    conds = [f"len(list_filter(regexp_extract_all({TEXT}, '[\\p{{L}}\\p{{N}}_]+'), "
             f"lambda w: starts_with(w, '{t}'))) > 0" for t in terms]
    return " AND ".join(conds)


def _iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S')"


def _token(obj: str) -> str:
    return f"translate(to_base64(encode(to_json({obj}))), '+/', '-_')"


def _page_sql(cand: str, order: str, size: int, cols: str, token: str, previous: bool = True) -> str:
    return f"""SELECT {cols}, {previous} AS has_previous, n > {size} AS has_next,
       CASE WHEN n > {size} THEN (SELECT tok FROM numbered WHERE rn = {size}) END AS next_cursor
FROM numbered WHERE rn <= {size}""", {
        "cand": cand,
        "numbered": f"SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n, {token} AS tok FROM cand",
    }


TICKET_COLS = "ticket_id, status, priority, assignee_name, source_created_at, source_updated_at, subject"
TICKET_TOKEN = _token(f"{{'source_created_at': {_iso('source_created_at')}, 'id': CAST(ticket_id AS VARCHAR)}}")
# the token of 1998-03-01T00:00:00 and id 999999
CURSOR = "eyJzb3VyY2VfY3JlYXRlZF9hdCI6IjE5OTgtMDMtMDFUMDA6MDA6MDAiLCJpZCI6Ijk5OTk5OSJ9"


def _ticket_page_sql(where: str, size: int = 25, previous: bool = False) -> str:
    cand = f"""SELECT t.ticket_id, t.status, t.priority, t.assignee_name, t.source_created_at, t.source_updated_at,
                  x.subject
           FROM m_tickets t LEFT JOIN m_text x ON x.ticket_id = t.ticket_id
           WHERE {where} ORDER BY t.source_created_at DESC, t.ticket_id DESC LIMIT {size + 1}"""
    body, ctes = _page_sql(cand, "source_created_at DESC, ticket_id DESC", size, TICKET_COLS, TICKET_TOKEN, previous)
    return with_model(body, ctes)


register("ticket_page", "T5 F12 T9", _ticket_page_sql(
    "t.status IN ('OPEN', 'NEW', 'PENDING') AND t.priority IN ('URGENT', 'HIGH') "
    "AND (t.source_created_at < TIMESTAMP '1998-03-01 00:00:00' OR "
    "(t.source_created_at = TIMESTAMP '1998-03-01 00:00:00' AND t.ticket_id < 999999))", L.PAGE_SIZE, True))(
    lambda m: L.ticket_page(m, statuses=["open", "new", "pending"], priorities=["urgent", "high"], cursor=CURSOR))

register("ticket_search", "F13 F14 F15 X13 T5 Q12 Q13", _ticket_page_sql(
    f"(t.assignee_name LIKE 'der die%' OR ({_fts_sql(TERMS)}))", 50))(
    lambda m: L.ticket_page(m, search=SEARCH, page_size=50))

def _indexed(m, search: str, folded: bool, page_size: int):
    """The search through an index of the whole texts, written first."""
    spark = m.tickets.sparkSession
    path = scratch_path(spark, f"index-{uuid.uuid4().hex}")
    L.write_search_index(m, path, folded=folded, postings=True)
    return L.ticket_page(m, search=search, page_size=page_size, index=spark.read.schema(L.POSTINGS).parquet(path), folded=folded)


register("ticket_search_indexed", "F13 F14 F15 X13 T5 Q13", _ticket_page_sql(
    f"(t.assignee_name LIKE 'der die%' OR ({_fts_sql(TERMS)}))", 50))(lambda m: _indexed(m, SEARCH, False, 50))

FOLDED_SEARCH = "ÉN zu"
FOLDED = [L.fold_text(t) for t in L.search_terms(FOLDED_SEARCH)]
_FOLDED_SQL = " AND ".join(f"len(list_filter(regexp_extract_all(strip_accents({TEXT}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: starts_with(w, '{t}'))) > 0" for t in FOLDED)
register("search_collated", "Q12 F13 F14 F15", _ticket_page_sql(
    f"(strip_accents(lower(t.assignee_name)) LIKE '{L.fold_text(FOLDED_SEARCH)}%' OR ({_FOLDED_SQL}))", 40))(
    lambda m: _indexed(m, FOLDED_SEARCH, True, 40))

register("ticket_search_digits", "F13 F15", _ticket_page_sql(
    "(t.ticket_id = 1234 OR t.assignee_name LIKE '1234%' OR (" + _fts_sql(["1234"]) + "))", 10))(
    lambda m: L.ticket_page(m, search="1234", page_size=10))

register("ticket_search_assignee", "F13 F15", _ticket_page_sql(
    "(t.assignee_name LIKE 'Agent 9103%' OR (" + _fts_sql(["agent", "9103"]) + "))", 100))(
    lambda m: L.ticket_page(m, search="Agent 9103", page_size=100))

CUSTOMER_COLS = "customer_id, external_requester_id, requester_name, requester_email"
CUSTOMER_TOKEN = _token("{'requester_name': requester_name, 'id': CAST(customer_id AS VARCHAR)}")
# the token of Customer#000000100 and id 100
NAME_CURSOR = "eyJyZXF1ZXN0ZXJfbmFtZSI6IkN1c3RvbWVyIzAwMDAwMDEwMCIsImlkIjoiMTAwIn0="


def _customer_page_sql(where: str, size: int, previous: bool = False) -> str:
    cand = f"""SELECT {CUSTOMER_COLS} FROM m_customers WHERE {where}
           ORDER BY requester_name, customer_id LIMIT {size + 1}"""
    body, ctes = _page_sql(cand, "requester_name, customer_id", size, CUSTOMER_COLS, CUSTOMER_TOKEN, previous)
    return with_model(body, ctes)


register("customer_page", "T6 T9", _customer_page_sql(
    "(requester_name > 'Customer#000000100' OR (requester_name = 'Customer#000000100' AND customer_id > 100))", 30, True))(
    lambda m: L.customer_page(m, cursor=NAME_CURSOR, page_size=30))

register("customer_search", "F16 T6", _customer_page_sql(
    "(external_requester_id = 12 OR requester_name LIKE '12%' OR requester_email LIKE '12%')", 20))(
    lambda m: L.customer_page(m, search=" 12 ", page_size=20))

register("customer_search_prefix", "F16 T6", _customer_page_sql(
    "(requester_name LIKE 'Customer#0000001%' OR requester_email LIKE 'Customer#0000001%')", 100))(
    lambda m: L.customer_page(m, search="Customer#0000001", page_size=100))

ID_TOKEN = "translate(to_base64(encode(CAST(ticket_id AS VARCHAR))), '+/', '-_')"
register("tickets_by_tags", "J5 T7 U2", with_model(*_page_sql(
    """SELECT ticket_id FROM m_tickets t WHERE EXISTS (SELECT 1 FROM m_ticket_tags tt
         WHERE tt.ticket_id = t.ticket_id AND tt.tag_id IN ('brand#22', 'brand#5')) AND ticket_id > 500
       ORDER BY ticket_id LIMIT 41""", "ticket_id", 40, "ticket_id", ID_TOKEN)))(
    lambda m: L.tickets_by_tag_ids(m, ["brand#22", "brand#5"], after=500, page_size=40).select(
        "ticket_id", "has_previous", "has_next", "next_cursor"))

register("id_page", "T7", with_model(*_page_sql(
    "SELECT ticket_id, score FROM m_ratings WHERE ticket_id > 7000 ORDER BY ticket_id LIMIT 21",
    "ticket_id", 20, "ticket_id, score", ID_TOKEN)))(
    lambda m: L.id_page(m.rating_scores, "ticket_id", after=7000, page_size=20))

register("page_token", "T9", with_model(f"""
SELECT ticket_id, {TICKET_TOKEN} AS token, {_iso('source_created_at')} AS decoded_at,
       CAST(ticket_id AS VARCHAR) AS decoded_id
FROM m_tickets"""))(lambda m: _token_roundtrip(m))


def _token_roundtrip(m):
    from ..functions import expressions as X

    t = m.tickets.select("ticket_id", "source_created_at")
    tok = X.page_token(X.iso_text("source_created_at"), F.col("ticket_id").cast("string"),
                       names=["source_created_at", "id"])
    with_tok = t.select("ticket_id", tok.alias("token"))
    decoded = L.token_key(F.col("token"), L.TICKET_KEY)
    return with_tok.select("ticket_id", "token", X.iso_text(decoded["source_created_at"]).alias("decoded_at"),
                           decoded["id"].cast("string").alias("decoded_id"))

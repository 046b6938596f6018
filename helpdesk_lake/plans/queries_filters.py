"""Filter queries (F1-F10, J4): the filtered ticket set for each condition."""

from __future__ import annotations

from ..filters import AnalyticsFilters
from ..operators.filtering import apply_filters
from .catalog import PERIOD, PERIOD_FROM, PERIOD_TO, period_sql, register
from .oracle_model import with_model

COLS = ("ticket_id", "customer_id", "status", "priority", "assignee_external_id")
SEL = ", ".join(f"t.{c}" for c in COLS)


def _q(filters: AnalyticsFilters):
    return lambda m: apply_filters(m, filters).select(*COLS)


register("filter_period", "F1 F2", with_model(f"SELECT {SEL} FROM m_tickets t WHERE {period_sql(PERIOD, 't.source_created_at')}"))(
    _q(PERIOD))

CUSTOMERS = AnalyticsFilters.create(customer_ids=[1, 2, 3, 10, 100, 1000, 1499])
register("filter_customers", "F3", with_model(
    f"SELECT {SEL} FROM m_tickets t WHERE t.customer_id IN (1, 2, 3, 10, 100, 1000, 1499)"))(_q(CUSTOMERS))

EMAILS = AnalyticsFilters.create(requester_emails="  Customer.000000010@EXAMPLE.com, customer.000000020@example.com,"
                                                  "customer.000000020@example.com, nobody@example.com")
register("filter_emails", "F4 J4", with_model(f"""
SELECT {SEL} FROM m_tickets t WHERE EXISTS (
  SELECT 1 FROM m_customers c WHERE c.customer_id = t.customer_id
    AND lower(c.requester_email) IN ('customer.000000010@example.com', 'customer.000000020@example.com',
                                     'nobody@example.com'))"""))(_q(EMAILS))

STATUS_PRIORITY = AnalyticsFilters.create(statuses="solved, hold", priorities=["urgent", "LOW"])
register("filter_status_priority", "F5 F6", with_model(
    f"SELECT {SEL} FROM m_tickets t WHERE t.status IN ('SOLVED', 'HOLD') AND t.priority IN ('URGENT', 'LOW')"))(
    _q(STATUS_PRIORITY))

ASSIGNEES = AnalyticsFilters.create(assignee_external_ids="9101,9105")
register("filter_assignees", "F7", with_model(
    f"SELECT {SEL} FROM m_tickets t WHERE t.assignee_external_id IN (9101, 9105)"))(_q(ASSIGNEES))

TAGS = AnalyticsFilters.create(tag_ids=["brand#13", "brand#7"], tag_names=" brand#13 ,brand#21")
register("filter_tags", "F8 J4", with_model(f"""
SELECT {SEL} FROM m_tickets t WHERE EXISTS (
  SELECT 1 FROM m_ticket_tags tt JOIN m_tags g ON g.tag_id = tt.tag_id
  WHERE tt.ticket_id = t.ticket_id AND g.tag_id IN ('brand#13', 'brand#7')
    AND g.name IN ('brand#13', 'brand#21'))"""))(_q(TAGS))

SCORES = AnalyticsFilters.create(satisfaction_scores="good,unoffered")
register("filter_scores", "F9 J4", with_model(f"""
SELECT {SEL} FROM m_tickets t WHERE EXISTS (
  SELECT 1 FROM m_ratings r WHERE r.ticket_id = t.ticket_id AND r.score IN ('GOOD', 'UNOFFERED'))"""))(_q(SCORES))

register("filter_has_response", "F10", with_model(
    f"SELECT {SEL} FROM m_tickets t WHERE t.first_response_at IS NOT NULL"))(
    _q(AnalyticsFilters.create(has_first_response=True)))

register("filter_no_response", "F10 Q6", with_model(
    f"SELECT {SEL} FROM m_tickets t WHERE t.first_response_at IS NULL"))(
    _q(AnalyticsFilters.create(has_first_response=False)))

ALL = AnalyticsFilters.create(from_at=PERIOD_FROM, to_at=PERIOD_TO, statuses="open,new,solved,closed",
                              priorities="urgent,high,normal", assignee_external_ids=[9101, 9102, 9103, 9104],
                              tag_names="brand#11,brand#12,brand#13", satisfaction_scores="good,bad",
                              has_first_response=True)
register("filter_all", "F1-F10", with_model(f"""
SELECT {SEL} FROM m_tickets t
WHERE {period_sql(PERIOD, 't.source_created_at')}
  AND t.status IN ('OPEN', 'NEW', 'SOLVED', 'CLOSED') AND t.priority IN ('URGENT', 'HIGH', 'NORMAL')
  AND t.assignee_external_id IN (9101, 9102, 9103, 9104) AND t.first_response_at IS NOT NULL
  AND EXISTS (SELECT 1 FROM m_links l WHERE l.ticket_id = t.ticket_id AND l.tag IN ('brand#11', 'brand#12', 'brand#13'))
  AND EXISTS (SELECT 1 FROM m_ratings r WHERE r.ticket_id = t.ticket_id AND r.score IN ('GOOD', 'BAD'))"""))(
    _q(ALL))

# Summary under a combined filter: predicates feed the aggregate (F1 + A1).
from ..operators.dashboard import period_summary  # noqa: E402
from .oracle_model import BAD, GOOD, RESOLVED, VALID_RESPONSE, VALID_SECONDS  # noqa: E402

register("filtered_summary", "F1 A1 J1", with_model(f"""
SELECT count(*) AS total_tickets,
       CAST(coalesce(sum({RESOLVED}), 0) AS BIGINT) AS resolved_tickets,
       round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds,
       CAST(coalesce(sum(CASE WHEN {VALID_RESPONSE} THEN 1 ELSE 0 END), 0) AS BIGINT) AS responded_tickets,
       CAST(coalesce(sum({GOOD}), 0) AS BIGINT) AS good_ratings,
       CAST(coalesce(sum({BAD}), 0) AS BIGINT) AS bad_ratings
FROM m_rated t
WHERE t.priority IN ('URGENT', 'HIGH') AND EXISTS (
  SELECT 1 FROM m_links l WHERE l.ticket_id = t.ticket_id AND l.tag IN ('brand#11', 'brand#12'))"""))(
    lambda m: period_summary(m, AnalyticsFilters.create(priorities="urgent,high", tag_names="brand#11,brand#12")))

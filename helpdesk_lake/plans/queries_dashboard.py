"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard as D
from .catalog import NO_FILTER, PERIOD, period_sql, register
from .oracle_model import BAD, BUCKET, GOOD, RESOLVED, VALID_RESPONSE, VALID_SECONDS, secs, with_model

P = period_sql(PERIOD)


register("period_summary", "A1 F1 F2 F11 J1 A17", with_model(f"""
SELECT count(*) AS total_tickets,
       CAST(coalesce(sum({RESOLVED}), 0) AS BIGINT) AS resolved_tickets,
       round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds,
       CAST(coalesce(sum(CASE WHEN {VALID_RESPONSE} THEN 1 ELSE 0 END), 0) AS BIGINT) AS responded_tickets,
       CAST(coalesce(sum({GOOD}), 0) AS BIGINT) AS good_ratings,
       CAST(coalesce(sum({BAD}), 0) AS BIGINT) AS bad_ratings
FROM m_rated WHERE {P}"""))(lambda m: D.period_summary(m, PERIOD))


register("period_snapshot", "A1 A2 A17", with_model(f"""
SELECT s.*, r.* FROM
 (SELECT count(*) AS total_tickets, CAST(coalesce(sum({RESOLVED}), 0) AS BIGINT) AS resolved_tickets,
         round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds,
         CAST(coalesce(sum(CASE WHEN {VALID_RESPONSE} THEN 1 ELSE 0 END), 0) AS BIGINT) AS responded_tickets,
         CAST(coalesce(sum({GOOD}), 0) AS BIGINT) AS good_ratings, CAST(coalesce(sum({BAD}), 0) AS BIGINT) AS bad_ratings
  FROM m_rated WHERE {P}) s,
 (SELECT round(avg({secs('current_at', 'previous_at')}), 2) AS average_recurrence_seconds,
         CAST(count(previous_at) AS BIGINT) AS recurrence_sample_intervals,
         count(DISTINCT customer_id) AS customers_with_recurrence
  FROM (SELECT customer_id, source_created_at AS current_at,
               lag(source_created_at) OVER (PARTITION BY customer_id ORDER BY source_created_at, ticket_id) AS previous_at
        FROM m_tickets WHERE {P}) x WHERE previous_at IS NOT NULL) r"""))(lambda m: D.period_snapshot(m, PERIOD))


register("recurrence", "A2 W1 X1", with_model(f"""
SELECT round(avg({secs('current_at', 'previous_at')}), 2) AS average_recurrence_seconds,
       CAST(count(previous_at) AS BIGINT) AS recurrence_sample_intervals,
       count(DISTINCT customer_id) AS customers_with_recurrence
FROM (SELECT customer_id, source_created_at AS current_at,
             lag(source_created_at) OVER (PARTITION BY customer_id
                                          ORDER BY source_created_at, ticket_id) AS previous_at
      FROM m_tickets WHERE {P}) x
WHERE previous_at IS NOT NULL"""))(lambda m: D.recurrence(m, PERIOD))


register("ticket_gaps", "W1 X1", with_model(f"""
SELECT customer_id, ticket_id, source_created_at, previous_at,
       {secs('source_created_at', 'previous_at')} AS gap_seconds
FROM (SELECT customer_id, ticket_id, source_created_at,
             lag(source_created_at) OVER (PARTITION BY customer_id ORDER BY source_created_at, ticket_id) AS previous_at
      FROM m_tickets WHERE {P}) x"""))(lambda m: D.ticket_gaps(D.filtered_tickets(m, PERIOD)))


register("status_distribution", "A3 Q2", with_model(f"""
SELECT status AS label, count(*) AS value FROM m_tickets WHERE {P} GROUP BY status"""))(
    lambda m: D.status_counts(m, PERIOD))


register("priority_breakdown_raw", "A4", with_model(f"""
SELECT priority, count(*) AS ticket_count, CAST(sum({RESOLVED}) AS BIGINT) AS resolved_tickets,
       round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds
FROM m_tickets WHERE {P} GROUP BY priority"""))(lambda m: D.priority_aggregates(m, PERIOD))


register("top_topics_raw", "A5 J3 T1 Q15", with_model(f"""
SELECT tag, count(DISTINCT t.ticket_id) AS ticket_count, CAST(sum({RESOLVED}) AS BIGINT) AS resolved_tickets,
       round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds
FROM m_tickets t JOIN m_links l ON l.ticket_id = t.ticket_id
WHERE {P}
GROUP BY tag ORDER BY ticket_count DESC, tag ASC LIMIT 10"""))(lambda m: D.topic_aggregates(m, PERIOD, 10))


register("timeline_raw", "A6 T2 X2 Q3 Q7", with_model(f"""
SELECT * FROM (
  SELECT CAST(source_created_at AS DATE) AS date, count(*) AS opened,
         CAST(sum({RESOLVED}) AS BIGINT) AS resolved,
         round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds,
         CAST(sum({GOOD}) AS BIGINT) AS good_ratings, CAST(sum({BAD}) AS BIGINT) AS bad_ratings
  FROM m_rated WHERE {P}
  GROUP BY 1 ORDER BY 1 DESC LIMIT 90) x ORDER BY date"""))(lambda m: D.timeline(m, PERIOD, 90))


register("response_buckets_raw", "A7 X3", with_model(f"""
SELECT {BUCKET} AS bucket, count(*) AS ticket_count FROM m_tickets GROUP BY 1"""))(
    lambda m: D.response_buckets(m, NO_FILTER))


register("customer_behavior", "A8 D12", with_model(f"""
SELECT count(*) AS unique_customers,
       CAST(coalesce(sum(CASE WHEN ticket_count > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS repeat_customers,
       round(avg(ticket_count), 2) AS average_tickets_per_customer,
       CASE WHEN count(*) <> 0 THEN
         CAST(coalesce(sum(CASE WHEN ticket_count > 1 THEN 1 ELSE 0 END), 0) AS DOUBLE) / count(*) END
         AS repeat_customer_rate
FROM (SELECT customer_id, count(*) AS ticket_count FROM m_tickets WHERE {P} GROUP BY customer_id) x"""))(
    lambda m: D.customer_behavior(m, PERIOD))


register("top_customers", "A9 T3 J2", with_model(f"""
SELECT c.customer_id, c.requester_name, c.requester_email, x.ticket_count
FROM (SELECT customer_id, count(*) AS ticket_count FROM m_tickets WHERE {P} GROUP BY customer_id) x
JOIN m_customers c ON c.customer_id = x.customer_id
ORDER BY x.ticket_count DESC, c.requester_name ASC, c.customer_id ASC LIMIT 5"""))(
    lambda m: D.top_customers(m, PERIOD))


# --- period comparison (D4-D13) ----------------------------------------------
from ..operators import comparison as C  # noqa: E402
from .catalog import COMPARE, ts_sql  # noqa: E402

CUR = period_sql(COMPARE)
PREV = period_sql(COMPARE.previous())


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _chg(cur: str, prev: str) -> str:
    return (f"CASE WHEN {cur} IS NOT NULL AND {prev} IS NOT NULL AND {prev} <> 0 "
            f"THEN round(({_d(cur)} - {_d(prev)}) / abs({_d(prev)}) * 100.0, 2) END")


def _pts(cur: str, prev: str) -> str:
    return f"CASE WHEN {cur} IS NOT NULL AND {prev} IS NOT NULL THEN round(({_d(cur)} - {_d(prev)}) * 100.0, 2) END"


def _rate(n: str, d: str) -> str:
    return f"CASE WHEN {d} <> 0 THEN {_d(n)} / {_d(d)} END"


def _summary_cte(where: str) -> str:
    return f"""SELECT count(*) AS total, CAST(coalesce(sum({RESOLVED}), 0) AS BIGINT) AS resolved,
        round(avg({VALID_SECONDS}), 2) AS resp,
        CAST(coalesce(sum(CASE WHEN {VALID_RESPONSE} THEN 1 ELSE 0 END), 0) AS BIGINT) AS responded,
        CAST(coalesce(sum({GOOD}), 0) AS BIGINT) AS good, CAST(coalesce(sum({BAD}), 0) AS BIGINT) AS bad
      FROM m_rated WHERE {where}"""


def _recurrence_cte(where: str) -> str:
    return f"""SELECT round(avg({secs('cur_at', 'prev_at')}), 2) AS rec, count(prev_at) AS intervals,
        count(DISTINCT customer_id) AS rec_customers
      FROM (SELECT customer_id, source_created_at AS cur_at,
                   lag(source_created_at) OVER (PARTITION BY customer_id ORDER BY source_created_at, ticket_id) AS prev_at
            FROM m_tickets WHERE {where}) x WHERE prev_at IS NOT NULL"""


COMPARISON_CTES = {
    "s_cur": _summary_cte(CUR), "s_prev": _summary_cte(PREV),
    "r_cur": _recurrence_cte(CUR), "r_prev": _recurrence_cte(PREV),
    "metrics": f"""SELECT
      c.total AS ticket_volume, p.total AS previous_ticket_volume,
      {_chg('c.total', 'p.total')} AS ticket_volume_change_percent,
      rc.rec AS average_recurrence_seconds, CAST(rc.intervals AS BIGINT) AS recurrence_sample_intervals,
      rc.rec_customers AS customers_with_recurrence, rp.rec AS previous_average_recurrence_seconds,
      {_chg('rc.rec', 'rp.rec')} AS recurrence_change_percent,
      {_rate('c.resolved', 'c.total')} AS resolution_rate, c.resolved AS resolved_tickets,
      {_rate('p.resolved', 'p.total')} AS previous_resolution_rate,
      {_chg(_rate('c.resolved', 'c.total'), _rate('p.resolved', 'p.total'))} AS resolution_change_percent,
      {_pts(_rate('c.resolved', 'c.total'), _rate('p.resolved', 'p.total'))} AS resolution_change_points,
      {_rate('c.good', 'c.good + c.bad')} AS satisfaction_rate, c.good AS good_ratings, c.bad AS bad_ratings,
      c.good + c.bad AS rated_total,
      {_rate('p.good', 'p.good + p.bad')} AS previous_satisfaction_rate,
      {_chg(_rate('c.good', 'c.good + c.bad'), _rate('p.good', 'p.good + p.bad'))} AS satisfaction_change_percent,
      {_pts(_rate('c.good', 'c.good + c.bad'), _rate('p.good', 'p.good + p.bad'))} AS satisfaction_change_points,
      c.resp AS average_first_response_seconds, c.responded AS responded_tickets,
      greatest(c.total - c.responded, 0) AS unanswered_tickets,
      p.resp AS previous_average_first_response_seconds,
      {_chg('c.resp', 'p.resp')} AS first_response_change_percent
    FROM s_cur c, s_prev p, r_cur rc, r_prev rp""",
}

register("metrics_comparison", "D4 D5 D1 D2 D3 A1 A2 X4 X5 Q5 Q11", with_model(
    "SELECT * FROM metrics", COMPARISON_CTES))(lambda m: C.metrics_comparison(m, COMPARE))


register("status_distribution_compare", "D6 J6 A3", with_model(f"""
SELECT c.label, c.value, coalesce(p.value, 0) AS previous_value,
       {_chg('c.value', 'coalesce(p.value, 0)')} AS change_percent
FROM (SELECT status AS label, count(*) AS value FROM m_tickets WHERE {CUR} GROUP BY 1) c
LEFT JOIN (SELECT status AS label, count(*) AS value FROM m_tickets WHERE {PREV} GROUP BY 1) p
  ON p.label = c.label"""))(lambda m: C.status_distribution(m, COMPARE))


register("priority_breakdown", "D7 A4 J6", with_model(f"""
SELECT c.priority, c.ticket_count, {_rate('c.ticket_count', 'sum(c.ticket_count) OVER ()')} AS share,
       c.resolved_tickets, {_rate('c.resolved_tickets', 'c.ticket_count')} AS resolution_rate,
       c.average_first_response_seconds, coalesce(p.n, 0) AS previous_ticket_count,
       {_chg('c.ticket_count', 'coalesce(p.n, 0)')} AS change_percent
FROM (SELECT priority, count(*) AS ticket_count, CAST(sum({RESOLVED}) AS BIGINT) AS resolved_tickets,
             round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds
      FROM m_tickets WHERE {CUR} GROUP BY 1) c
LEFT JOIN (SELECT priority, count(*) AS n FROM m_tickets WHERE {PREV} GROUP BY 1) p
  ON p.priority = c.priority"""))(lambda m: C.priority_breakdown(m, COMPARE))


def _topics_sql(where: str, k: int = 10) -> str:
    return f"""SELECT tag, count(DISTINCT t.ticket_id) AS ticket_count, CAST(sum({RESOLVED}) AS BIGINT) AS resolved_tickets,
        round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds
      FROM m_tickets t JOIN m_links l ON l.ticket_id = t.ticket_id WHERE {where}
      GROUP BY tag ORDER BY ticket_count DESC, tag ASC LIMIT {k}"""


TOPIC_CTES = {
    "tc": _topics_sql(CUR), "tp": _topics_sql(PREV),
    "total": f"SELECT count(*) AS n FROM m_tickets WHERE {CUR}",
    "topics": f"""SELECT tc.tag, tc.ticket_count, {_rate('tc.ticket_count', '(SELECT n FROM total)')} AS share,
        tc.resolved_tickets, {_rate('tc.resolved_tickets', 'tc.ticket_count')} AS resolution_rate,
        tc.average_first_response_seconds,
        CAST(row_number() OVER (ORDER BY tc.ticket_count DESC, tc.tag ASC) AS INTEGER) AS rank,
        coalesce(tp.ticket_count, 0) AS previous_ticket_count,
        {_chg('tc.ticket_count', 'coalesce(tp.ticket_count, 0)')} AS change_percent
      FROM tc LEFT JOIN tp ON tp.tag = tc.tag""",
}

register("top_topics", "D8 A5 T1 W3 J6 Q1", with_model("SELECT * FROM topics", TOPIC_CTES))(
    lambda m: C.topic_breakdown(m, COMPARE, 10))


TIMELINE_SQL = f"""SELECT * FROM (
  SELECT CAST(source_created_at AS DATE) AS date, count(*) AS opened,
         CAST(sum({RESOLVED}) AS BIGINT) AS resolved,
         round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds,
         CAST(sum({GOOD}) AS BIGINT) AS good_ratings, CAST(sum({BAD}) AS BIGINT) AS bad_ratings
  FROM m_rated WHERE {P} GROUP BY 1 ORDER BY 1 DESC LIMIT 90) x"""

register("timeline", "D9 A6 T2 D1", with_model(f"""
SELECT date, opened, resolved, {_rate('resolved', 'opened')} AS resolution_rate,
       average_first_response_seconds, {_rate('good_ratings', 'good_ratings + bad_ratings')} AS satisfaction_rate,
       good_ratings + bad_ratings AS rated_tickets
FROM tl""", {"tl": TIMELINE_SQL}))(lambda m: C.operation_timeseries(D.timeline(m, PERIOD, 90)))

register("tickets_over_time", "D10 A6", with_model("SELECT date, opened AS value FROM tl", {"tl": TIMELINE_SQL}))(
    lambda m: C.tickets_over_time(D.timeline(m, PERIOD, 90)))

register("priority_distribution", "D10 A4", with_model(f"""
SELECT priority AS label, count(*) AS value FROM m_tickets WHERE {P} GROUP BY 1"""))(
    lambda m: C.priority_distribution(D.priority_aggregates(m, PERIOD)))


from ..constants import RESPONSE_BUCKETS  # noqa: E402

BUCKET_DOMAIN = ("SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{code}', '{label}')" for i, (code, label, _) in enumerate(RESPONSE_BUCKETS, start=1))
    + ") v(bucket_order, bucket, label)")

register("response_distribution", "D11 A7 J9 D1", with_model(f"""
SELECT d.bucket, d.label, coalesce(c.n, 0) AS ticket_count,
       {_rate('coalesce(c.n, 0)', 'sum(coalesce(c.n, 0)) OVER ()')} AS share, d.bucket_order
FROM dom d LEFT JOIN (SELECT {BUCKET} AS bucket, count(*) AS n FROM m_tickets WHERE {P} GROUP BY 1) c
  ON c.bucket = d.bucket""", {"dom": BUCKET_DOMAIN}))(lambda m: C.first_response_distribution(m, PERIOD))


from .. import constants as K  # noqa: E402


def _one_dec(x: str) -> str:
    return f"printf('%.1f', abs({x}))"


def _told(sentences: tuple, x: str) -> str:
    rise = f"WHEN {x} > 0 THEN replace('{sentences[-2]}', '{{}}', {_one_dec(x)}) ELSE replace('{sentences[-1]}', '{{}}', {_one_dec(x)}) END"
    if len(sentences) == 2:
        return f"CASE {rise}"
    return f"CASE WHEN {x} IS NULL THEN '{sentences[0]}' WHEN abs({x}) < {K.STABLE_THRESHOLD} THEN '{sentences[1]}' {rise}"


SUMMARY_CTES = dict(COMPARISON_CTES)
SUMMARY_CTES.update(TOPIC_CTES)
SUMMARY_CTES["cands"] = f"""
  SELECT CASE WHEN resolution_change_points > 0 THEN 'improvement' ELSE 'alert' END AS kind,
         abs(resolution_change_points) AS m, {_told(K.ALERT_RESOLUTION, 'resolution_change_points')} AS t
    FROM metrics WHERE resolution_change_points IS NOT NULL
  UNION ALL
  SELECT CASE WHEN first_response_change_percent > 0 THEN 'alert' ELSE 'improvement' END,
         abs(first_response_change_percent), {_told(K.ALERT_FIRST_RESPONSE, 'first_response_change_percent')}
    FROM metrics WHERE first_response_change_percent IS NOT NULL
  UNION ALL
  SELECT CASE WHEN satisfaction_change_points > 0 THEN 'improvement' ELSE 'alert' END,
         abs(satisfaction_change_points), {_told(K.ALERT_SATISFACTION, 'satisfaction_change_points')}
    FROM metrics WHERE satisfaction_change_points IS NOT NULL"""

register("dashboard_summary", "D13 Q4 X16", with_model(f"""
SELECT
  concat_ws(' ', {_told(K.HEADLINE_VOLUME, 'm.ticket_volume_change_percent')},
                 {_told(K.HEADLINE_RESOLUTION, 'm.resolution_change_points')},
                 {_told(K.HEADLINE_FIRST_RESPONSE, 'm.first_response_change_percent')}) AS headline,
  coalesce((SELECT t FROM cands WHERE kind = 'alert' ORDER BY m DESC, t DESC LIMIT 1),
           '{K.SUMMARY_NO_ALERT}') AS primary_alert,
  coalesce((SELECT t FROM cands WHERE kind = 'improvement' ORDER BY m DESC, t DESC LIMIT 1),
           '{K.SUMMARY_NO_IMPROVEMENT}') AS primary_improvement,
  (SELECT tag FROM topics WHERE rank = 1) AS top_driver_label,
  (SELECT ticket_count FROM topics WHERE rank = 1) AS top_driver_ticket_count,
  (SELECT share FROM topics WHERE rank = 1) AS top_driver_share,
  (SELECT change_percent FROM topics WHERE rank = 1) AS top_driver_change_percent
FROM metrics m""", SUMMARY_CTES))(
    lambda m: C.dashboard_summary(C.metrics_comparison(m, COMPARE), C.topic_breakdown(m, COMPARE, 10)))


register("trend_summary", "D16 A6", with_model("""
SELECT round(CAST(coalesce(sum(opened), 0) AS DOUBLE), 2) AS trend_value,
       arg_min(date, (-opened, date)) FILTER (WHERE opened IS NOT NULL) AS peak_date, max(opened) AS peak_value
FROM tl""", {"tl": TIMELINE_SQL}))(
    lambda m: C.trend_summary(D.timeline(m, PERIOD, 90), "opened"))

register("trend_summary_averaged", "D16 A6", with_model("""
SELECT round(coalesce(avg(CASE WHEN average_first_response_seconds > 0 THEN average_first_response_seconds END), 0.0), 2)
         AS trend_value,
       arg_min(date, (-average_first_response_seconds, date))
         FILTER (WHERE average_first_response_seconds IS NOT NULL) AS peak_date,
       max(average_first_response_seconds) AS peak_value
FROM tl""", {"tl": TIMELINE_SQL}))(
    lambda m: C.trend_summary(D.timeline(m, PERIOD, 90), "average_first_response_seconds", averaged=True))

register("label_share", "D17 A3", with_model(f"""
SELECT label, value, {_rate('value', 'sum(value) OVER ()')} AS share
FROM (SELECT status AS label, count(*) AS value FROM m_tickets WHERE {P} GROUP BY 1) x"""))(
    lambda m: C.label_share(D.status_counts(m, PERIOD)))


# --- D14: single-pass grouping sets ------------------------------------------
from .dashboard_bundle import grouped_rows  # noqa: E402


def _gs(dim: str, col: str | None) -> str:
    label = f"CAST({col} AS VARCHAR)" if col else "CAST(NULL AS VARCHAR)"
    group = f"is_current, {col}" if col else "is_current"
    return f"""SELECT '{dim}' AS dimension, {label} AS label, is_current, count(*) AS ticket_count,
      CAST(sum({RESOLVED}) AS BIGINT) AS resolved_tickets, round(avg({VALID_SECONDS}), 2) AS average_first_response_seconds,
      CAST(sum({GOOD}) AS BIGINT) AS good_ratings, CAST(sum({BAD}) AS BIGINT) AS bad_ratings
    FROM tw GROUP BY {group}"""


GS_CTES = {"tw": f"""SELECT *, ({CUR}) AS is_current, CAST(source_created_at AS DATE) AS day, {BUCKET} AS bucket
                     FROM m_rated WHERE ({CUR}) OR ({PREV})"""}
register("dashboard_single_pass", "D14 A1 A3 A4 A6 A7 D5", with_model(
    " UNION ALL ".join([_gs("all", None), _gs("status", "status"), _gs("priority", "priority"),
                        _gs("day", "day"), _gs("bucket", "bucket")]), GS_CTES))(
    lambda m: grouped_rows(m, COMPARE))


from .dashboard_bundle import dashboard_bundle  # noqa: E402


def _bundle_rows(m):
    """The nested row unfolded again: (chart, position, label, value, previous_value)."""
    b = dashboard_bundle(m, COMPARE)
    none = F.lit(None).cast("long")

    def chart(name, label, value, previous=None):
        return F.transform(name, lambda e, i: F.struct(
            F.lit(name).alias("chart"), (i + 1).cast("long").alias("position"), e[label].cast("string").alias("label"),
            e[value].cast("long").alias("value"), (none if previous is None else e[previous].cast("long")).alias("previous_value")))

    def single(name, label, value):
        return F.struct(F.lit(name).alias("chart"), F.lit(1).cast("long").alias("position"), label.cast("string").alias("label"),
                        value.cast("long").alias("value"), none.alias("previous_value"))

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ones = F.array(*[single("scope", F.lit(c), micros(f"scope.{c}")) for c in ("from_at", "to_at", "previous_from_at", "previous_to_at")],
                   single("scope", F.lit("is_comparable"), F.col("scope.is_comparable").cast("int")),
                   single("metrics", F.lit("ticket_volume"), F.col("metrics.ticket_volume")),
                   single("customer_behavior", F.lit("unique_customers"), F.col("customer_behavior.unique_customers")),
                   single("summary", F.col("summary.top_driver_label"), F.col("summary.top_driver_ticket_count")))
    return b.select(F.inline(F.concat(
        ones, chart("status_distribution", "label", "value", "previous_value"), chart("priority_breakdown", "priority", "ticket_count", "previous_ticket_count"),
        chart("priority_distribution", "label", "value"), chart("top_topics", "tag", "ticket_count", "previous_ticket_count"),
        chart("operation_timeseries", "date", "resolved"), chart("tickets_over_time", "date", "value"),
        chart("first_response_distribution", "bucket", "ticket_count"), chart("top_customers", "requester_email", "ticket_count"),
        F.transform("tag_options", lambda e, i: F.struct(F.lit("tag_options").alias("chart"), (i + 1).cast("long").alias("position"), e["name"].alias("label"),
                                                         none.alias("value"), none.alias("previous_value"))),
        chart("assignee_options", "name", "external_id"))))


FROM_AT, TO_AT = ts_sql(COMPARE.from_at), ts_sql(COMPARE.to_at)
BUNDLE_CTES = dict(TOPIC_CTES)
BUNDLE_CTES |= {
    "dom": BUCKET_DOMAIN,
    "days": f"""SELECT * FROM (SELECT CAST(source_created_at AS DATE) AS date, count(*) AS opened, CAST(sum({RESOLVED}) AS BIGINT) AS resolved
                FROM m_tickets WHERE {CUR} GROUP BY 1 ORDER BY 1 DESC LIMIT 90) x""",
    "st": f"""SELECT c.status AS label, c.n AS value, coalesce(p.n, 0) AS previous_value
              FROM (SELECT status, count(*) AS n FROM m_tickets WHERE {CUR} GROUP BY 1) c
              LEFT JOIN (SELECT status, count(*) AS n FROM m_tickets WHERE {PREV} GROUP BY 1) p ON p.status = c.status""",
    "pr": f"""SELECT c.priority AS label, c.n AS value, coalesce(p.n, 0) AS previous_value
              FROM (SELECT priority, count(*) AS n FROM m_tickets WHERE {CUR} GROUP BY 1) c
              LEFT JOIN (SELECT priority, count(*) AS n FROM m_tickets WHERE {PREV} GROUP BY 1) p ON p.priority = c.priority""",
    "cu": f"""SELECT c.customer_id, c.requester_name, c.requester_email, x.n FROM (SELECT customer_id, count(*) AS n FROM m_tickets WHERE {CUR} GROUP BY 1) x
              JOIN m_customers c ON c.customer_id = x.customer_id ORDER BY x.n DESC, c.requester_name, c.customer_id LIMIT 5""",
}
register("dashboard_bundle", "D14 D5 S7", with_model(f"""
SELECT 'scope' AS chart, CAST(1 AS BIGINT) AS position, label, value, CAST(NULL AS BIGINT) AS previous_value FROM (VALUES
  ('from_at', epoch_us({FROM_AT})), ('to_at', epoch_us({TO_AT})), ('previous_to_at', epoch_us({FROM_AT}) - 1),
  ('previous_from_at', epoch_us({FROM_AT}) - 1 - (epoch_us({TO_AT}) - epoch_us({FROM_AT}))), ('is_comparable', 1)) v(label, value)
UNION ALL SELECT 'metrics', 1, 'ticket_volume', (SELECT count(*) FROM m_tickets WHERE {CUR}), NULL
UNION ALL SELECT 'customer_behavior', 1, 'unique_customers', (SELECT count(DISTINCT customer_id) FROM m_tickets WHERE {CUR}), NULL
UNION ALL SELECT 'summary', 1, tag, ticket_count, NULL FROM topics WHERE rank = 1
UNION ALL SELECT 'status_distribution', row_number() OVER (ORDER BY value DESC, label), label, value, previous_value FROM st
UNION ALL SELECT 'priority_breakdown', row_number() OVER (ORDER BY value DESC, label), label, value, previous_value FROM pr
UNION ALL SELECT 'priority_distribution', row_number() OVER (ORDER BY value DESC, label), label, value, NULL FROM pr
UNION ALL SELECT 'top_topics', rank, tag, ticket_count, previous_ticket_count FROM topics
UNION ALL SELECT 'operation_timeseries', row_number() OVER (ORDER BY date), CAST(date AS VARCHAR), resolved, NULL FROM days
UNION ALL SELECT 'tickets_over_time', row_number() OVER (ORDER BY date), CAST(date AS VARCHAR), opened, NULL FROM days
UNION ALL SELECT 'first_response_distribution', d.bucket_order, d.bucket, coalesce(c.n, 0), NULL
  FROM dom d LEFT JOIN (SELECT {BUCKET} AS bucket, count(*) AS n FROM m_tickets WHERE {CUR} GROUP BY 1) c ON c.bucket = d.bucket
UNION ALL SELECT 'top_customers', row_number() OVER (ORDER BY n DESC, requester_name, customer_id), requester_email, n, NULL FROM cu
UNION ALL SELECT 'tag_options', row_number() OVER (ORDER BY name, tag_id), name, NULL, NULL FROM m_tags
UNION ALL SELECT 'assignee_options', row_number() OVER (ORDER BY name, id), name, id, NULL FROM (
  SELECT DISTINCT assignee_external_id AS id, coalesce(nullif(assignee_name, ''), '{K.ASSIGNEE_FALLBACK_PREFIX}' || CAST(assignee_external_id AS VARCHAR)) AS name
  FROM m_tickets WHERE assignee_external_id IS NOT NULL) x""", BUNDLE_CTES))(_bundle_rows)

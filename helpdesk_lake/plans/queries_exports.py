"""Export queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..filters import AnalyticsFilters
from ..functions import expressions as X
from ..operators import exports as E
from ..session import scratch_path
from ..sinks.reports import read_json_snapshot, write_json_snapshot, write_report
from .catalog import PERIOD, period_sql, register
from .oracle_model import with_model
from .. import constants as K

P = period_sql(PERIOD, "t.source_created_at")


def _iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S') || 'Z'"


RECORD_SQL = f"""
SELECT t.ticket_id, x.subject, x.description, lower(t.status) AS status, lower(t.priority) AS priority,
       c.external_requester_id AS requester_id, c.requester_name, c.requester_email,
       t.assignee_external_id AS assignee_id, t.assignee_name,
       {_iso('t.source_created_at')} AS created_at, {_iso('t.source_updated_at')} AS updated_at,
       {_iso('t.first_response_at')} AS first_response_at,
       CAST(to_json(coalesce(g.tags, CAST([] AS VARCHAR[]))) AS VARCHAR) AS tags,
       CASE WHEN r.score IS NOT NULL THEN CAST(to_json({{'score': lower(r.score), 'offered_at': {_iso('r.offered_at')},
                                                  'rated_at': {_iso('r.rated_at')}, 'comment': r.comment}}) AS VARCHAR) END
         AS satisfaction_rating
FROM m_tickets t
JOIN m_customers c ON c.customer_id = t.customer_id
LEFT JOIN m_ratings r ON r.ticket_id = t.ticket_id
LEFT JOIN m_text x ON x.ticket_id = t.ticket_id
LEFT JOIN (SELECT ticket_id, list_sort(list(tag)) AS tags FROM m_links GROUP BY ticket_id) g ON g.ticket_id = t.ticket_id"""


def _json_cols(df):
    return df.select(*[X.compact_json(c).alias(c) if c in ("tags", "satisfaction_rating") else F.col(c)
                       for c in df.columns])


register("export_records", "E1 E2 E4 J8 J1 J2 X9 X10 X14 F18", with_model(f"{RECORD_SQL} WHERE {P}"))(
    lambda m: _json_cols(E.data_export(m, PERIOD)))

SOLVED = AnalyticsFilters.create(statuses="solved")
ESSENTIAL = ", ".join(["ticket_id", "subject", "status", "priority", "requester_name", "assignee_name",
                       "created_at", "first_response_at", "tags", "satisfaction_rating"])
register("export_preview", "E3 A15 F18", with_model(f"""
SELECT {ESSENTIAL}, (SELECT count(*) FROM m_tickets WHERE status = 'SOLVED') AS total_matching
FROM ({RECORD_SQL} WHERE t.status = 'SOLVED' ORDER BY t.ticket_id LIMIT 50) x"""))(
    lambda m: _json_cols(E.export_preview(m, SOLVED, preset="essential", limit=50)))


def _cell(v: str) -> str:
    inner = f"coalesce(CAST({v} AS VARCHAR), '')"
    return f"CASE WHEN regexp_matches({inner}, '^[=+\\-@]') THEN '''' || {inner} ELSE {inner} END"


SERVICE = ["ticket_id", "subject", "description", "status", "priority", "requester_name", "requester_email",
           "assignee_name", "created_at", "updated_at", "first_response_at", "tags", "satisfaction_rating"]
URGENT = AnalyticsFilters.create(priorities="urgent")
register("export_cells", "X11 X12 E4 Q14", with_model(
    "SELECT " + ", ".join(f"{_cell(c)} AS {c}" for c in SERVICE) + f" FROM ({RECORD_SQL} WHERE t.priority = 'URGENT') x"))(
    lambda m: E.report_cells(E.data_export(m, URGENT, preset="service")))


def _rate(n: str, d: str) -> str:
    return f"CASE WHEN {d} <> 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END"


PERIOD_START, PERIOD_END = PERIOD.from_at.isoformat(), PERIOD.to_at.isoformat()
PS = f"'{PERIOD_START}' AS period_start, '{PERIOD_END}' AS period_end"
M_COLS = ("scope_type, scope_id, scope_label, metric_code, metric_label, value, unit, numerator, "
          "denominator, sample_size, dimension, rank")


def _mrow(code: str, value: str, num="NULL", den="NULL", ss="NULL", dim="NULL", rank="NULL",
          scope=f"'overall', '{K.OVERALL_SCOPE_ID}', '{K.OVERALL_SCOPE_LABEL}'") -> str:
    label, unit = K.METRIC_LABELS[code], K.METRIC_UNITS[code]
    return (f"SELECT {scope}, '{code}', '{label}', CAST({value} AS DOUBLE), '{unit}', CAST({num} AS BIGINT), "
            f"CAST({den} AS BIGINT), CAST({ss} AS BIGINT), CAST({dim} AS VARCHAR), CAST({rank} AS INTEGER), {PS}")


Q = period_sql(PERIOD)
OVERALL_CTES = {
    "s": f"""SELECT count(*) AS total, sum(CASE WHEN status IN ('SOLVED','CLOSED') THEN 1 ELSE 0 END) AS resolved,
               sum(CASE WHEN score = 'GOOD' THEN 1 ELSE 0 END) AS good, sum(CASE WHEN score = 'BAD' THEN 1 ELSE 0 END) AS bad,
               round(avg(CASE WHEN first_response_at IS NOT NULL AND first_response_at >= source_created_at
                              THEN CAST(epoch(first_response_at) - epoch(source_created_at) AS BIGINT) END), 2) AS resp,
               sum(CASE WHEN first_response_at IS NOT NULL AND first_response_at >= source_created_at THEN 1 ELSE 0 END) AS responded
             FROM m_rated WHERE {Q}""",
    "rc": f"""SELECT round(avg(CAST(epoch(cur_at) - epoch(prev_at) AS BIGINT)), 2) AS rec, count(prev_at) AS n
              FROM (SELECT source_created_at AS cur_at, lag(source_created_at) OVER (PARTITION BY customer_id
                           ORDER BY source_created_at, ticket_id) AS prev_at FROM m_tickets WHERE {Q}) x
              WHERE prev_at IS NOT NULL""",
    "tp": f"""SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tag) AS rk
              FROM m_tickets t JOIN m_links l ON l.ticket_id = t.ticket_id WHERE {Q}
              GROUP BY tag ORDER BY n DESC, tag LIMIT 5""",
}
register("metrics_overall", "E5 E7 U1 W3", with_model(f"""
SELECT {M_COLS}, period_start, period_end FROM (
  {_mrow('ticket_volume', 's.total')} FROM s
  UNION ALL {_mrow('average_recurrence_seconds', 'rc.rec', ss='rc.n')} FROM rc
  UNION ALL {_mrow('resolution_rate', _rate('s.resolved', 's.total'), 's.resolved', 's.total')} FROM s
  UNION ALL {_mrow('satisfaction_rate', _rate('s.good', 's.good + s.bad'), 's.good',
                   's.good + s.bad', 's.good + s.bad')} FROM s
  UNION ALL {_mrow('average_first_response_seconds', 's.resp',
                   ss='s.responded')} FROM s
  UNION ALL {_mrow('top_topics', 'tp.n', dim='tp.tag', rank='tp.rk')} FROM tp
) u(scope_type, scope_id, scope_label, metric_code, metric_label, value, unit, numerator, denominator, sample_size,
    dimension, rank, period_start, period_end)""", OVERALL_CTES))(
    lambda m: E.metrics_overall(m, PERIOD, top_topics_limit=5))


CUST_SCOPE = "'customer', CAST(a.customer_id AS VARCHAR), a.requester_name || ' <' || a.requester_email || '>'"
CUSTOMER_CTES = {
    "a": f"""SELECT c.customer_id, c.requester_name, c.requester_email, x.* EXCLUDE (customer_id),
               r.rec
             FROM (SELECT customer_id, count(*) AS vol,
                          sum(CASE WHEN status IN ('SOLVED','CLOSED') THEN 1 ELSE 0 END) AS resolved,
                          sum(CASE WHEN score = 'GOOD' THEN 1 ELSE 0 END) AS good,
                          sum(CASE WHEN score = 'BAD' THEN 1 ELSE 0 END) AS bad,
                          round(avg(CASE WHEN first_response_at IS NOT NULL AND first_response_at >= source_created_at
                               THEN CAST(epoch(first_response_at) - epoch(source_created_at) AS BIGINT) END), 2) AS resp
                   FROM m_rated WHERE {Q} GROUP BY customer_id) x
             JOIN m_customers c ON c.customer_id = x.customer_id
             LEFT JOIN (SELECT customer_id, round(avg(CAST(epoch(cur_at) - epoch(prev_at) AS BIGINT)), 2) AS rec
                        FROM (SELECT customer_id, source_created_at AS cur_at, lag(source_created_at) OVER
                                (PARTITION BY customer_id ORDER BY source_created_at, ticket_id) AS prev_at
                              FROM m_tickets WHERE {Q}) y WHERE prev_at IS NOT NULL GROUP BY customer_id) r
               ON r.customer_id = x.customer_id""",
    "ct": f"""SELECT customer_id, tag, n, rk FROM (
               SELECT t.customer_id, l.tag, count(*) AS n,
                      row_number() OVER (PARTITION BY t.customer_id ORDER BY count(*) DESC, l.tag) AS rk
               FROM m_tickets t JOIN m_links l ON l.ticket_id = t.ticket_id WHERE {Q} GROUP BY 1, 2) z
             WHERE rk <= 3""",
}
register("metrics_by_customer", "E6 E7 U1 X15 Q9 D15", with_model(f"""
SELECT {M_COLS}, period_start, period_end FROM (
  {_mrow('ticket_volume', 'a.vol', scope=CUST_SCOPE)} FROM a
  UNION ALL {_mrow('average_recurrence_seconds', 'a.rec', ss='a.vol - 1', scope=CUST_SCOPE)} FROM a
  UNION ALL {_mrow('resolution_rate', _rate('a.resolved', 'a.vol'), 'a.resolved', 'a.vol',
                   scope=CUST_SCOPE)} FROM a
  UNION ALL {_mrow('satisfaction_rate', _rate('a.good', 'a.good + a.bad'), 'a.good',
                   'a.good + a.bad', 'a.good + a.bad', scope=CUST_SCOPE)} FROM a
  UNION ALL {_mrow('average_first_response_seconds', 'a.resp',
                   scope=CUST_SCOPE)} FROM a
  UNION ALL {_mrow('top_topics', 'ct.n', dim='ct.tag', rank='ct.rk',
                   scope=CUST_SCOPE)} FROM ct JOIN a ON a.customer_id = ct.customer_id
) u(scope_type, scope_id, scope_label, metric_code, metric_label, value, unit, numerator, denominator, sample_size,
    dimension, rank, period_start, period_end)""", CUSTOMER_CTES))(
    lambda m: E.metrics_by_customer(m, PERIOD, top_topics_limit=3))


CUSTOMER_CTES_25 = CUSTOMER_CTES | {"ct": CUSTOMER_CTES["ct"].replace("rk <= 3", "rk <= 25")}
register("metrics_by_customer_topics", "E6 Q8 W2", with_model(f"""
SELECT {M_COLS}, period_start, period_end FROM ({_mrow('top_topics', 'ct.n', dim='ct.tag', rank='ct.rk', scope=CUST_SCOPE)}
  FROM ct JOIN a ON a.customer_id = ct.customer_id) u(scope_type, scope_id, scope_label, metric_code, metric_label, value, unit, numerator,
    denominator, sample_size, dimension, rank, period_start, period_end)""", CUSTOMER_CTES_25))(
    lambda m: E.metrics_by_customer(m, PERIOD, metrics="top_topics", top_topics_limit=25))


FILE_FIELDS = ["ticket_id", "subject", "status", "priority", "requester_name", "assignee_name", "created_at", "tags", "satisfaction_rating"]


def _folder(m, kind: str) -> str:
    return scratch_path(m.tickets.sparkSession, f"{kind}-{uuid.uuid4().hex}")


def _csv_file(m):
    """The urgent tickets written as CSV and read back by Spark's own reader."""
    path = _folder(m, "csv")
    write_report(E.data_export(m, URGENT, fields=FILE_FIELDS), "csv", path)
    schema = ", ".join(f"{f} string" for f in FILE_FIELDS)
    read = m.tickets.sparkSession.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\x00").csv(path)
    return read.select(*[F.coalesce(f, F.lit("")).alias(f) for f in FILE_FIELDS])


register("export_csv_file", "E4 S4 X11 X12", with_model(
    "SELECT " + ", ".join(f"{_cell(c)} AS {c}" for c in FILE_FIELDS) + f" FROM ({RECORD_SQL} WHERE t.priority = 'URGENT') x"))(_csv_file)


SHEET_ROWS = 1001


def _xlsx_files(m):
    """The same as workbooks of at most 1,000 rows and a header each, found again in their folder."""
    manifest = write_report(E.data_export(m, URGENT, fields=FILE_FIELDS), "xlsx", _folder(m, "xlsx"), sheet_limit=SHEET_ROWS)
    spark = m.tickets.sparkSession
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    found = spark.read.format("binaryFile").load([r.path for r in manifest.collect()])
    joined = manifest.select(name, "rows").join(found.select(name, (F.hex(F.substring("content", 1, 4)) == "504B0304").alias("archive")), "name")
    return joined.agg(F.sum("rows").alias("rows"), F.bool_and(F.col("rows") < SHEET_ROWS).alias("within_limit"), F.bool_and("archive").alias("archives"))


register("export_xlsx_manifest", "E4 S5", with_model(
    "SELECT count(*) AS rows, TRUE AS within_limit, TRUE AS archives FROM m_tickets WHERE priority = 'URGENT'"))(_xlsx_files)


def _snapshot(m):
    """Every ticket as a JSON snapshot, twice; what a reader finds after."""
    spark, root = m.tickets.sparkSession, _folder(m, "snapshot")
    tickets = m.tickets.select("ticket_id", "status", "priority")
    write_json_snapshot(tickets.filter("status = 'OPEN'"), root)
    write_json_snapshot(tickets, root)
    return read_json_snapshot(spark, root, "ticket_id long, status string, priority string").groupBy("status", "priority").agg(F.count(F.lit(1)).alias("tickets"))


register("json_snapshot", "S6", with_model("SELECT status, priority, count(*) AS tickets FROM m_tickets GROUP BY 1, 2"))(_snapshot)


register("assignee_options", "S7 A16 U2", with_model(f"""
SELECT DISTINCT assignee_external_id AS external_id,
       coalesce(nullif(assignee_name, ''), '{K.ASSIGNEE_FALLBACK_PREFIX}' || CAST(assignee_external_id AS VARCHAR)) AS name
FROM m_tickets WHERE assignee_external_id IS NOT NULL"""))(lambda m: E.assignee_options(m))

register("tag_options", "S7", with_model("SELECT tag_id AS id, name FROM m_tags"))(lambda m: E.tag_options(m))

register("customer_options", "S7 S3", with_model(
    "SELECT customer_id AS id, requester_name, requester_email FROM m_customers"))(lambda m: E.customer_options(m))


# --- F19 bulk lookup, T8 ordered scan -----------------------------------------
from ..operators.filtering import apply_filters, lookup  # noqa: E402
from ..operators.listings import ordered_scan  # noqa: E402

register("lookup_customers", "F19 J11", with_model(f"""
SELECT customer_id, requester_name, requester_email FROM m_customers c
WHERE customer_id IN (SELECT customer_id FROM m_tickets t WHERE {P} AND t.priority = 'URGENT')"""))(
    lambda m: lookup(m.customers, "customer_id",
                     apply_filters(m, AnalyticsFilters.create(from_at=PERIOD.from_at, to_at=PERIOD.to_at,
                                                              priorities="urgent")).select("customer_id"))
    .select("customer_id", "requester_name", "requester_email"))

register("export_ordered_scan", "T8 E1 E2", with_model(f"""
SELECT ticket_id, status, priority, created_at, tags FROM ({RECORD_SQL} WHERE {P}) x"""))(
    lambda m: ordered_scan(_json_cols(E.data_export(m, PERIOD, fields="ticket_id,status,priority,created_at,tags")),
                           "ticket_id"))

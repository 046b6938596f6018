"""Ingestion queries (I1-I7, I10, J10, X6-X8) over the feed built from orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ingestion as I
from ..session import scratch_path, staged
from ..sources.feed import fixture_feed
from ..sources.fixtures import fixture_model
from ..sources.json_feed import read_feed, write_feed
from ..streaming.latest import latest, start_latest
from ..streaming.store import ingest_batch, ingest_log, ingestion_state, init_store, set_enabled
from .catalog import QuerySpec, REGISTRY
from .oracle_model import with_model


def register_feed(name: str, ids: str, oracle: str | None):
    """Like ``register`` but the builder receives (spark, sf_dir)."""
    def deco(fn):
        def build(spark, sf_dir):
            return fn(spark, sf_dir)
        build.__name__ = f"q_{name}"
        REGISTRY[name] = QuerySpec(name, build, oracle, ids)
        return fn
    return deco


def _validated(spark, sf_dir):
    return I.validate(fixture_feed(spark, sf_dir))


def _valid(spark, sf_dir):
    return _validated(spark, sf_dir).filter("is_valid")


def _staged(spark, sf_dir):
    """The batch's valid records, validated once for all that reads them."""
    return staged(_validated(spark, sf_dir), "batch").filter("is_valid").drop("errors")


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


FEED_CTES = {
    "f_base": """SELECT t.*, o.o_orderstatus, c.c_name
                 FROM m_tickets t JOIN orders o ON o.o_orderkey = t.ticket_id
                 JOIN customer c ON c.c_custkey = t.customer_id""",
    "f_raw": f"""
      SELECT ticket_id, 1 AS version, CASE WHEN ticket_id % 97 = 0 THEN '' ELSE 'ok' END AS subject,
             'open' AS status, c_name AS requester_name, c_name AS email_name,
             source_created_at + INTERVAL 60 MINUTE AS updated, NULL AS score, customer_id, source_created_at, priority
        FROM f_base
      UNION ALL
      SELECT ticket_id, 2, 'ok', CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'O' THEN 'open' ELSE 'unknown' END,
             c_name, c_name, source_created_at + INTERVAL 1440 MINUTE,
             CASE WHEN ticket_id % 2 = 0 THEN 'good' ELSE 'bad' END, customer_id, source_created_at, priority
        FROM f_base WHERE ticket_id % 3 = 0
      UNION ALL
      SELECT ticket_id, 3, 'resent', 'open', c_name || ' (resent)',
             CASE WHEN ticket_id % 35 = 0
                  THEN 'Customer#' || lpad(CAST((customer_id + 1) % (SELECT count(*) FROM customer) AS VARCHAR), 9, '0')
                  ELSE c_name END,
             source_created_at + INTERVAL 60 MINUTE, 'offered', customer_id, source_created_at, priority
        FROM f_base WHERE ticket_id % 5 = 0
      UNION ALL
      SELECT ticket_id, 4, 'late', 'new', c_name, c_name, source_created_at + INTERVAL 30 MINUTE, NULL,
             customer_id, source_created_at, priority
        FROM f_base WHERE ticket_id % 15 = 0""",
    "f_valid": """
      SELECT *, upper(status) AS ustatus, lower(replace(email_name, '#', '.')) || '@example.com' AS email,
             list_sort(list_distinct(['support', status])) AS tags,
             length(subject) BETWEEN 1 AND 500 AND upper(status) IN ('OPEN','CLOSED','SOLVED','NEW','PENDING','HOLD')
               AS is_valid,
             concat_ws('; ', CASE WHEN NOT length(subject) BETWEEN 1 AND 500 THEN 'subject: length must be 1..500' END,
                       CASE WHEN upper(status) NOT IN ('OPEN','CLOSED','SOLVED','NEW','PENDING','HOLD')
                            THEN 'status: invalid value' END) AS errors
      FROM f_raw""",
    "f_latest": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY updated DESC, version) AS rk
                     FROM f_valid WHERE is_valid) x WHERE rk = 1""",
}


register_feed("ingest_validate", "I1 S1 X6 X7 X8", with_model(
    "SELECT ticket_id, version, is_valid, errors FROM f_valid", FEED_CTES))(
    lambda spark, d: _validated(spark, d).select(
        F.col("ticket_id"), (F.col("seq").bitwiseAND(0) + F.shiftright("seq", 32)).cast("int").alias("version"),
        "is_valid", F.array_join("errors", "; ").alias("errors")))

register_feed("ingest_latest", "I4", with_model(f"""
SELECT ticket_id, version, upper(status) AS status, subject, requester_name,
       {_iso('updated')} AS updated_at, array_to_string(tags, ',') AS tags, upper(score) AS score
FROM f_latest""", FEED_CTES))(
    lambda spark, d: I.latest_versions(_staged(spark, d)).select(
        "ticket_id", F.shiftright("seq", 32).cast("int").alias("version"), "status", "subject", "requester_name",
        F.date_format("source_updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.array_join("tags", ",").alias("tags"), F.col("rating.score").alias("score")))

register_feed("ingest_applied", "I4 I11", with_model("""
SELECT ticket_id, version,
       coalesce(updated > max(updated) OVER (PARTITION BY ticket_id ORDER BY version
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS applied,
       row_number() OVER (PARTITION BY ticket_id ORDER BY version) = 1 AS created
FROM f_valid WHERE is_valid""", FEED_CTES))(
    lambda spark, d: I.apply_flags(_valid(spark, d)).select(
        "ticket_id", F.shiftright("seq", 32).cast("int").alias("version"), "applied", "created"))

register_feed("ingest_customers", "I2 Q10", with_model("""
SELECT customer_id AS external_requester_id, arg_min(email, version * 4294967296 + ticket_id) AS requester_email,
       arg_max(requester_name, version * 4294967296 + ticket_id) AS requester_name, TRUE AS created
FROM f_valid WHERE is_valid GROUP BY customer_id""", FEED_CTES))(
    lambda spark, d: I.customer_upserts(_valid(spark, d)).select(
        "external_requester_id", "requester_email", "requester_name", "created"))

CONFLICT_CTES = dict(FEED_CTES)
CONFLICT_CTES["obs"] = "SELECT DISTINCT customer_id AS id, email FROM f_valid WHERE is_valid"
CONFLICT_CTES["stored"] = "SELECT customer_id AS s_id, lower(requester_email) AS s_email FROM m_customers"
register_feed("ingest_conflicts", "I3 J10", with_model("""
SELECT DISTINCT * FROM (
  SELECT id AS external_requester_id, email AS requester_email, 'conflicting identity inside the batch' AS reason
    FROM obs WHERE id IN (SELECT id FROM obs GROUP BY id HAVING count(*) > 1)
               OR email IN (SELECT email FROM obs GROUP BY email HAVING count(*) > 1)
  UNION ALL
  SELECT id, email, 'identity conflicts with an existing customer' FROM obs JOIN stored ON s_id = id WHERE s_email <> email
  UNION ALL
  SELECT id, email, 'identity conflicts with an existing customer' FROM obs JOIN stored ON s_email = email WHERE s_id <> id
) x""", CONFLICT_CTES))(
    lambda spark, d: I.identity_conflicts(_valid(spark, d),
                                          fixture_model(spark, d).customers))

register_feed("ingest_new_tags", "I5", with_model("""
SELECT DISTINCT unnest(tags) AS name FROM (
  SELECT tags, coalesce(updated > max(updated) OVER (PARTITION BY ticket_id ORDER BY version
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS applied
  FROM f_valid WHERE is_valid) x WHERE applied""", FEED_CTES))(
    lambda spark, d: (lambda valid: I.new_tags(valid, I.apply_flags(valid)))(_staged(spark, d)))

register_feed("ingest_links", "I6", with_model(
    "SELECT ticket_id, unnest(tags) AS tag_id FROM f_latest", FEED_CTES))(
    lambda spark, d: I.replaced_links(I.latest_versions(_staged(spark, d))))

register_feed("ingest_ratings", "I7", with_model(f"""
SELECT ticket_id, upper(score) AS score,
       {_iso("source_created_at + INTERVAL 5 MINUTE")} AS offered_at,
       CASE WHEN score IN ('good', 'bad') THEN {_iso("source_created_at + INTERVAL 45 MINUTE")} END AS rated_at,
       '' AS comment
FROM f_latest WHERE score IS NOT NULL""", FEED_CTES))(
    lambda spark, d: I.synced_ratings(I.latest_versions(_staged(spark, d))).select(
        "ticket_id", "score", F.date_format("offered_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("offered_at"),
        F.date_format("rated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rated_at"), "comment"))

CHECK_CTES = dict(FEED_CTES)
CHECK_CTES["v1"] = "SELECT * FROM f_raw WHERE version = 1"
CHECK_CTES["n"] = "SELECT count(*) AS n FROM orders"
register_feed("batch_checks", "I10", with_model("""
SELECT * FROM (VALUES
  ('exact_count', (SELECT count(*) FROM v1) = (SELECT n FROM n), (SELECT count(*) FROM v1)),
  ('unique_ticket_ids', (SELECT count(DISTINCT ticket_id) FROM v1) = (SELECT n FROM n),
                        (SELECT count(DISTINCT ticket_id) FROM v1)),
  ('distinct_customers', (SELECT count(DISTINCT email_name) FROM v1) = (SELECT n FROM n),
                         (SELECT count(DISTINCT email_name) FROM v1)),
  ('all_statuses', (SELECT count(DISTINCT upper(status)) FROM v1) = 6
                   AND (SELECT count(*) FROM v1 WHERE upper(status) NOT IN ('OPEN','CLOSED','SOLVED','NEW','PENDING','HOLD')) = 0,
                   (SELECT count(DISTINCT upper(status)) FROM v1)),
  ('all_priorities', (SELECT count(DISTINCT upper(priority)) FROM v1) = 4
                     AND (SELECT count(*) FROM v1 WHERE upper(priority) NOT IN ('URGENT','HIGH','NORMAL','LOW')) = 0,
                     (SELECT count(DISTINCT upper(priority)) FROM v1))
) t("check", passed, observed)""", CHECK_CTES))(
    lambda spark, d: I.batch_checks(
        fixture_feed(spark, d).filter(F.shiftright("seq", 32) == 1),
        expected_count=spark.read.parquet(f"{d}/orders.parquet").select(F.count(F.lit(1))).scalar()))


POOL, YEAR = (0, 750), 1998
ALL_CTES = dict(FEED_CTES) | {"r": "SELECT f.*, t.first_response_at FROM f_raw f JOIN m_tickets t USING (ticket_id)"}
register_feed("batch_checks_all", "I10", with_model(f"""
SELECT "check", observed = wanted AS passed, observed FROM (
  SELECT 'exact_count' AS "check", count(*) AS observed, count(*) AS wanted FROM r
  UNION ALL SELECT 'unique_ticket_ids', count(DISTINCT ticket_id), count(*) FROM r
  UNION ALL SELECT 'distinct_customers', count(DISTINCT email_name), count(*) FROM r
  UNION ALL SELECT 'all_statuses', count(DISTINCT upper(status)),
                   CASE WHEN count(*) FILTER (upper(status) NOT IN ('OPEN','CLOSED','SOLVED','NEW','PENDING','HOLD')) = 0 THEN 6 ELSE -1 END FROM r
  UNION ALL SELECT 'all_priorities', count(DISTINCT upper(priority)),
                   CASE WHEN count(*) FILTER (upper(priority) NOT IN ('URGENT','HIGH','NORMAL','LOW')) = 0 THEN 4 ELSE -1 END FROM r
  UNION ALL SELECT 'customers_in_pool', count(*) FILTER (customer_id < {POOL[0]} OR customer_id >= {POOL[1]}), 0 FROM r
  UNION ALL SELECT 'timestamps_in_year', count(*) FILTER (year(source_created_at) <> {YEAR} OR year(updated) <> {YEAR}
                   OR coalesce(year(first_response_at) <> {YEAR}, FALSE)), 0 FROM r) x""", ALL_CTES))(
    lambda spark, d: (lambda feed: I.batch_checks(feed, feed.select(F.count(F.lit(1))).scalar(), POOL, YEAR))(fixture_feed(spark, d)))


# --- files, cycles and streams -------------------------------------------------
FEED_FILES = 8


def _feed_files(spark, sf_dir):
    """The whole feed written as array files and read back; then the same files with a wrong count, all of whose records
    must be refused."""
    folder = scratch_path(spark, f"feed-{uuid.uuid4().hex}")
    write_feed(fixture_feed(spark, sf_dir), folder, FEED_FILES)
    back = I.validate(read_feed(spark, folder))
    counted = I.validate(read_feed(spark, folder, expected_count=-1))
    refused = counted.agg(F.count_if(F.exists("errors", lambda e: e.startswith("file must contain exactly"))).alias("refused"))
    kinds = back.groupBy("status", "is_valid").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("ticket_id").alias("tickets"), F.count_distinct("seq").alias("places"),
        F.sum(F.size("tags")).alias("tags"), F.count("rating.score").alias("ratings"), F.min("source_updated_at").alias("first_update"),
        F.max("source_updated_at").alias("last_update"))
    one = F.lit(1).alias("one")
    return (kinds.select("*", one).join(refused.select("*", one), "one").drop("one")
            .withColumn("first_update", F.date_format("first_update", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd'T'HH:mm:ss'Z'")))


register_feed("feed_files", "S1", with_model(f"""
SELECT upper(status) AS status, is_valid, count(*) AS records, count(DISTINCT ticket_id) AS tickets, count(*) AS places,
       CAST(sum(len(tags)) AS BIGINT) AS tags, count(score) AS ratings, {_iso("min(updated)")} AS first_update, {_iso("max(updated)")} AS last_update,
       (SELECT count(*) FROM f_valid) AS refused
FROM f_valid GROUP BY upper(status), is_valid""", FEED_CTES))(_feed_files)

#: Cycles of the store: all records of a version are one batch.
VERSIONS = (1, 2, 3, 4)


def _cycles(spark, sf_dir):
    root = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    init_store(spark, root)
    feed = fixture_feed(spark, sf_dir)
    for v in VERSIONS:
        ingest_batch(spark, feed.filter(F.col("version") == v), root, v, strict=False)
    return root


def _cycle_log(spark, sf_dir):
    """The log after four batches, the last of them sent twice."""
    root = _cycles(spark, sf_dir)
    ingest_batch(spark, fixture_feed(spark, sf_dir).filter(F.col("version") == VERSIONS[-1]), root, VERSIONS[-1], strict=False)
    return ingest_log(spark, root).select("batch", "state", "records", "rejected", "customers_created", "tickets_created", "tickets_updated",
                                          "tickets_unchanged", "next_cursor")


CYCLE_CTES = dict(FEED_CTES)
CYCLE_CTES |= {
    "early": "SELECT DISTINCT customer_id AS id, email FROM f_valid WHERE is_valid AND version < 3",
    "known": "SELECT id, min(email) AS email FROM early GROUP BY id",
    "third": "SELECT DISTINCT customer_id AS id, email FROM f_valid WHERE is_valid AND version = 3",
    "torn": """SELECT id, email FROM third WHERE id IN (SELECT id FROM third GROUP BY id HAVING count(*) > 1)
                  OR email IN (SELECT email FROM third GROUP BY email HAVING count(*) > 1)
               UNION SELECT t.id, t.email FROM third t JOIN known k ON k.id = t.id WHERE k.email <> t.email
               UNION SELECT t.id, t.email FROM third t JOIN known k ON k.email = t.email WHERE k.id <> t.id""",
    "judged": """SELECT *, is_valid AND NOT (version = 3 AND EXISTS (SELECT 1 FROM torn WHERE torn.id = customer_id AND torn.email = f_valid.email)) AS kept
                 FROM f_valid""",
    "steps": """SELECT version, ticket_id, coalesce(updated > max(updated) OVER w, TRUE) AS applied, row_number() OVER o = 1 AS created
                FROM judged WHERE kept
                WINDOW w AS (PARTITION BY ticket_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                       o AS (PARTITION BY ticket_id ORDER BY version)""",
    "seen": "SELECT customer_id, min(version) AS version FROM judged WHERE kept GROUP BY customer_id",
}
register_feed("ingest_cycles", "I8 I11 S2", with_model("""
SELECT CAST(v.version AS VARCHAR) AS batch, 'SUCCESS' AS state, v.records, v.rejected,
       (SELECT count(*) FROM seen WHERE seen.version = v.version) AS customers_created,
       (SELECT count(*) FROM steps s WHERE s.version = v.version AND applied AND created) AS tickets_created,
       (SELECT count(DISTINCT ticket_id) FROM steps s WHERE s.version = v.version AND applied AND NOT created) AS tickets_updated,
       (SELECT count(*) FROM steps s WHERE s.version = v.version AND NOT applied) AS tickets_unchanged,
       CAST(sum(v.records) OVER (ORDER BY v.version) AS BIGINT) AS next_cursor
FROM (SELECT version, count(*) AS records, count(*) FILTER (NOT kept) AS rejected FROM judged GROUP BY version) v""", CYCLE_CTES))(_cycle_log)


def _control(spark, sf_dir):
    """The control row after a good batch, after a failed one, switched off, and switched on again."""
    root = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    init_store(spark, root)
    feed = fixture_feed(spark, sf_dir).filter(F.col("version") == 1)
    rows = []

    def note(step: str) -> None:
        r = ingestion_state(spark, root).first()
        rows.append((step, r.enabled, r.worker_state, r.cursor_position, r.last_success_at is not None, (r.last_error or "").split(":")[-1].strip() or None))

    ingest_batch(spark, feed, root, 1, strict=False)
    note("1 ingested")
    try:
        ingest_batch(spark, feed, root, 2)
    except RuntimeError:
        note("2 failed")
    set_enabled(spark, root, False)
    note("3 switched off")
    set_enabled(spark, root, True)
    ingest_batch(spark, feed, root, 3, strict=False)
    note("4 ingested again")
    return spark.createDataFrame(rows, "step string, enabled boolean, worker_state string, cursor_position long, succeeded boolean, last_error string")


register_feed("ingest_control", "I9 X17", with_model("""
SELECT step, enabled, worker_state, n * (SELECT count(*) FROM f_valid WHERE version = 1) AS cursor_position, TRUE AS succeeded,
       CASE WHEN n > 1 OR step <> '1 ingested' THEN 'length must be 1..500' END AS last_error
FROM (VALUES ('1 ingested', TRUE, 'IDLE', 1), ('2 failed', TRUE, 'ERROR', 1), ('3 switched off', FALSE, 'DISABLED', 1),
             ('4 ingested again', TRUE, 'IDLE', 2)) t(step, enabled, worker_state, n)""", FEED_CTES))(_control)

EVENT_COLUMNS = ["event_type", "value"]


def _stream_latest(spark, sf_dir):
    """§2.13: the events as a stream of versions of their user; the newest of each."""
    path, ckpt = (scratch_path(spark, f"{kind}-{uuid.uuid4().hex}") for kind in ("latest", "latest-checkpoint"))
    source = f"{sf_dir}/events.parquet*"  # a pattern, as a stream takes no single file
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    start_latest(stream, path, ckpt, "user_id", "ts", "event_id", EVENT_COLUMNS).awaitTermination()
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    wanted = ", ".join(f"{c} {kinds[c]}" for c in ("user_id", "ts", "event_id", *EVENT_COLUMNS))
    return latest(spark, path, wanted, "user_id", "ts", "event_id", EVENT_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


register_feed("stream_latest", "S2 I4", """
SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rk FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL) x WHERE rk = 1""")(_stream_latest)

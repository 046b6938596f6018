"""A ticket feed derived from the driver's orders (several versions per ticket).

Versions per order k, in feed order (all seq-1 records, then seq 2, ...):

* seq 1, every k: updated = created + 1 h, status ``open``, subject ``ok``
  (empty — invalid — when k % 97 = 0), no rating;
* seq 2, k % 3 = 0: updated = created + 24 h, status from the order
  (F -> ``solved``, O -> ``open``, P -> ``unknown``, invalid), rating good/bad;
* seq 3, k % 5 = 0: re-sent at created + 1 h (must not replace), subject
  ``resent``, requester name with a `` (resent)`` suffix, rating offered;
* seq 4, k % 15 = 0: late version at created + 30 min (must not replace),
  status ``new``, subject ``late``.

Records are source-shaped: lower-case enums, a padded upper-case e-mail, ISO
text times with ``Z``, untidy tag arrays — so validation has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .fixtures import map_priority, read_table, tickets_from_orders

SEQ_SHIFT = 1 << 32  # global order = version * 2^32 + ticket id


def _iso_z(c):
    """'2026-08-01T10:00:00Z' (timestamps here are whole seconds; a cast is
    much cheaper than a pattern formatter)."""
    return F.concat(F.replace(c.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def fixture_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    base = tickets_from_orders(spread(orders, "o_orderkey"), keep=("o_orderstatus", "o_orderpriority"))
    customers = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name"))
    base = base.join(customers, "customer_id", "inner")
    n_customers = customers.select(F.count(F.lit(1))).scalar()
    # Re-sent versions of k % 35 = 0 carry the next customer's e-mail: an
    # identity conflict (I3) inside the feed and against stored customers.
    next_id = F.when(n_customers > 0, (F.col("customer_id") + 1) % n_customers)
    next_name = F.concat(F.lit("Customer#"), F.lpad(next_id.cast("string"), 9, "0"))
    k = F.col("ticket_id")
    created = F.col("source_created_at")

    # One scan of orders: every order gets the array of its versions, then
    # one explode (no union of four scans).
    versions = F.filter(F.array(F.lit(1), F.when(k % 3 == 0, F.lit(2)), F.when(k % 5 == 0, F.lit(3)),
                                F.when(k % 15 == 0, F.lit(4))), lambda v: v.isNotNull())
    exploded = base.withColumn("version", F.explode(versions))
    v = F.col("version")
    order_status = (F.when(F.col("o_orderstatus") == "F", F.lit("solved"))
                    .when(F.col("o_orderstatus") == "O", F.lit("open"))
                    .otherwise(F.lit("unknown")))
    status = (F.when(v == 2, order_status).when(v == 4, F.lit("new")).otherwise(F.lit("open")))
    subject = (F.when(v == 1, F.when(k % 97 == 0, F.lit("")).otherwise(F.lit("ok")))
               .when(v == 3, F.lit("resent")).when(v == 4, F.lit("late")).otherwise(F.lit("ok")))
    updated_minutes = F.when(v == 2, F.lit(24 * 60)).when(v == 4, F.lit(30)).otherwise(F.lit(60))
    email_name = F.when((v == 3) & (k % 35 == 0), next_name).otherwise(F.col("c_name"))
    good_bad = F.struct(F.when(k % 2 == 0, F.lit("good")).otherwise(F.lit("bad")).alias("score"),
                        _iso_z(F.timestamp_add("MINUTE", F.lit(5), created)).alias("offered_at"),
                        _iso_z(F.timestamp_add("MINUTE", F.lit(45), created)).alias("rated_at"),
                        F.lit("").alias("comment"))
    offered = F.struct(F.lit("offered").alias("score"),
                       _iso_z(F.timestamp_add("MINUTE", F.lit(5), created)).alias("offered_at"),
                       F.lit(None).cast("string").alias("rated_at"),
                       F.lit(None).cast("string").alias("comment"))
    rating = F.when(v == 2, good_bad).when(v == 3, offered)
    return exploded.select(
        k.alias("ticket_id"),
        v.alias("version"),
        (v.cast("long") * SEQ_SHIFT + k).alias("seq"),
        subject.alias("subject"),
        F.concat(F.lit("Feed record of ticket "), k.cast("string")).alias("description"),
        status.alias("status"),
        F.lower(map_priority(F.col("o_orderpriority"))).alias("priority"),
        F.col("customer_id").alias("requester_id"),
        F.concat(F.col("c_name"), F.when(v == 3, F.lit(" (resent)")).otherwise(F.lit(""))).alias("requester_name"),
        F.concat(F.lit("  "), F.upper(F.replace(email_name, F.lit("#"), F.lit("."))),
                 F.lit("@EXAMPLE.COM ")).alias("requester_email"),
        F.col("assignee_external_id").alias("assignee_id"),
        F.col("assignee_name"),
        _iso_z(created).alias("created_at"),
        _iso_z(F.timestamp_add("MINUTE", updated_minutes, created)).alias("updated_at"),
        _iso_z(F.col("first_response_at")).alias("first_response_at"),
        F.array(F.lit(" support "), status, F.lit(""), F.lit("support")).alias("tags"),
        rating.alias("satisfaction_rating"),
    )

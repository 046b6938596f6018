"""Dashboard aggregates A1-A9 over the filtered tickets.

All aggregates are hash aggregations with map-side partial aggregation, so a
hot key (one customer, day, status or tag holding a large share of the rows)
is combined inside each map task before the shuffle.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..constants import TOP_CUSTOMERS
from ..filters import AnalyticsFilters
from ..functions import expressions as X
from ..model import TicketModel
from ..session import staged
from .filtering import apply_filters


def filtered_tickets(model: TicketModel, filters: AnalyticsFilters, with_score: bool = False) -> DataFrame:
    base = model.rated_tickets(("score",)) if with_score else model.tickets
    return apply_filters(model, filters, base)


def summary_aggs() -> list:
    """A17 building blocks of the period summary (A1)."""
    return [
        F.count(F.lit(1)).alias("total_tickets"),
        F.coalesce(F.sum(X.flag(X.is_resolved())), F.lit(0)).cast("long").alias("resolved_tickets"),
        X.round2(F.avg(X.valid_response_seconds())).alias("average_first_response_seconds"),
        F.coalesce(F.sum(X.flag(X.valid_response())), F.lit(0)).cast("long").alias("responded_tickets"),
        F.coalesce(F.sum(X.flag(X.is_good())), F.lit(0)).cast("long").alias("good_ratings"),
        F.coalesce(F.sum(X.flag(X.is_bad())), F.lit(0)).cast("long").alias("bad_ratings"),
    ]


# A1 -------------------------------------------------------------------------
def period_summary(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    """One row: total, resolved, avg valid response secs, responded, good, bad."""
    return filtered_tickets(model, filters, with_score=True).agg(*summary_aggs())


def period_snapshot(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    """A1 and A2 in one pass: per-customer partial sums (one shuffle, partial
    aggregation), then one row. Same values as ``period_summary`` and
    ``recurrence``; recurrence uses the telescoping gaps (last - first over
    n - 1 intervals per customer)."""
    t = filtered_tickets(model, filters, with_score=True)
    per = t.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(X.flag(X.is_resolved())).alias("resolved"),
        F.sum(X.valid_response_seconds()).alias("resp_sum"),
        F.count(X.valid_response_seconds()).alias("resp_n"),
        F.sum(X.flag(X.is_good())).alias("good"),
        F.sum(X.flag(X.is_bad())).alias("bad"),
        F.min("source_created_at").alias("first_at"),
        F.max("source_created_at").alias("last_at"),
    )
    multi = F.col("n") > 1
    gaps = F.sum(F.when(multi, X.seconds_between("last_at", "first_at")))
    intervals = F.sum(F.when(multi, F.col("n") - 1))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_tickets"),
        F.coalesce(F.sum("resolved"), F.lit(0)).cast("long").alias("resolved_tickets"),
        X.round2(F.try_divide(F.sum("resp_sum"), F.sum("resp_n"))).alias("average_first_response_seconds"),
        F.coalesce(F.sum("resp_n"), F.lit(0)).cast("long").alias("responded_tickets"),
        F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good_ratings"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad_ratings"),
        X.round2(F.try_divide(gaps, intervals)).alias("average_recurrence_seconds"),
        F.coalesce(intervals, F.lit(0)).cast("long").alias("recurrence_sample_intervals"),
        F.count(F.when(multi, F.lit(1))).alias("customers_with_recurrence"),
    )


# W1 / A2 / A11 ---------------------------------------------------------------
def customer_spans(tickets: DataFrame) -> DataFrame:
    """Per customer: ticket count and first/last creation instant.

    The gaps between consecutive tickets of a customer (LAG over
    source_created_at, id) telescope: their sum is last - first and their
    number is n - 1. So recurrence needs no window — a partial aggregation
    per customer, safe for customers holding a huge share of the tickets.
    """
    return tickets.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("source_created_at").alias("first_at"),
        F.max("source_created_at").alias("last_at"),
    )


def recurrence(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    """A2: avg seconds between consecutive tickets of a customer, number of
    intervals, customers with at least one interval (after filtering)."""
    spans = customer_spans(filtered_tickets(model, filters)).filter(F.col("n") > 1)
    total_gap = F.sum(X.seconds_between("last_at", "first_at"))
    intervals = F.sum(F.col("n") - 1)
    return spans.agg(
        X.round2(F.try_divide(total_gap, intervals)).alias("average_recurrence_seconds"),
        F.coalesce(intervals, F.lit(0)).cast("long").alias("recurrence_sample_intervals"),
        F.count(F.lit(1)).alias("customers_with_recurrence"),
    )


#: Most slices of ``ticket_gaps``; one broadcast row each.
SLICES = 20_000


def ticket_gaps(tickets: DataFrame, partitions: int | None = None) -> DataFrame:
    """W1 per ticket: the previous creation instant of the same customer by
    (source_created_at, ticket_id), and the gap in seconds.

    Skew-safe: rows are range-partitioned on (customer, created, id), so a
    customer holding a large share of the tickets spans many balanced
    slices instead of one task. The lag is taken inside each (slice,
    customer) group; the first row of a group then takes the last row of the
    nearest earlier non-empty slice when that row belongs to the same
    customer. The sliced rows are written once to the shared folder: both
    branches then read the same slices, whatever the planner reuses. The
    boundary frame has one row per slice (``SLICES`` at most), so it is
    broadcast."""
    spark = tickets.sparkSession
    n = min(SLICES, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["customer_id", "source_created_at", "ticket_id"]
    ranged = (tickets.select(*keys).repartitionByRange(n, *keys)
              .withColumn("slice", F.spark_partition_id()))
    ranged = staged(ranged, "gaps")
    w = Window.partitionBy("slice", "customer_id").orderBy("source_created_at", "ticket_id")
    local = ranged.withColumn("previous_at", F.lag("source_created_at").over(w))
    last_of_slice = ranged.groupBy("slice").agg(
        F.max_by(F.struct("customer_id", "source_created_at"), F.struct(*keys)).alias("last"))
    boundary = last_of_slice.select(
        F.col("slice"),
        F.lag("last").over(Window.orderBy("slice")).alias("before"))  # one row per slice
    joined = local.join(F.broadcast(boundary), "slice", "left")
    carried = F.when(F.col("previous_at").isNull() & (F.col("before.customer_id") == F.col("customer_id")),
                     F.col("before.source_created_at")).otherwise(F.col("previous_at"))
    return joined.select(
        "customer_id", "ticket_id", "source_created_at", carried.alias("previous_at"),
    ).withColumn("gap_seconds", X.seconds_between("source_created_at", "previous_at"))


# A3 -------------------------------------------------------------------------
def status_counts(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    """Count per status, count desc then label (Q2: ties get a second key)."""
    return (filtered_tickets(model, filters).groupBy(F.col("status").alias("label"))
            .agg(F.count(F.lit(1)).alias("value"))
            .orderBy(F.desc("value"), F.asc("label")))


# A4 -------------------------------------------------------------------------
def priority_aggregates(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    return (filtered_tickets(model, filters).groupBy("priority")
            .agg(F.count(F.lit(1)).alias("ticket_count"),
                 F.sum(X.flag(X.is_resolved())).cast("long").alias("resolved_tickets"),
                 X.round2(F.avg(X.valid_response_seconds())).alias("average_first_response_seconds"))
            .orderBy(F.desc("ticket_count"), F.asc("priority")))


# A5 / T1 ----------------------------------------------------------------------
def topic_aggregates(model: TicketModel, filters: AnalyticsFilters, limit: int | None = 10) -> DataFrame:
    """Per tag: distinct tickets, resolved, avg valid response; top ``limit``
    by count desc, name asc. The bridge is unique per (ticket, tag), so
    count(*) equals count(distinct ticket)."""
    t = filtered_tickets(model, filters).select("ticket_id", "status", "first_response_at", "source_created_at")
    joined = t.join(model.topic_links().select("ticket_id", "tag"), "ticket_id", "inner")
    agg = (joined.groupBy("tag")
           .agg(F.count(F.lit(1)).alias("ticket_count"),
                F.sum(X.flag(X.is_resolved())).cast("long").alias("resolved_tickets"),
                X.round2(F.avg(X.valid_response_seconds())).alias("average_first_response_seconds")))
    ordered = agg.orderBy(F.desc("ticket_count"), F.asc("tag"))
    return ordered.limit(limit) if limit else ordered


# A6 / T2 ----------------------------------------------------------------------
def timeline(model: TicketModel, filters: AnalyticsFilters, limit: int | None = 90) -> DataFrame:
    """Per calendar day of creation: opened, resolved (of those opened, Q7),
    avg response, good, bad; the latest ``limit`` days, ascending (Q3: days
    without tickets are absent)."""
    t = filtered_tickets(model, filters, with_score=True)
    agg = (t.groupBy(F.to_date("source_created_at").alias("date"))
           .agg(F.count(F.lit(1)).alias("opened"),
                F.sum(X.flag(X.is_resolved())).cast("long").alias("resolved"),
                X.round2(F.avg(X.valid_response_seconds())).alias("average_first_response_seconds"),
                F.sum(X.flag(X.is_good())).cast("long").alias("good_ratings"),
                F.sum(X.flag(X.is_bad())).cast("long").alias("bad_ratings")))
    if limit:
        agg = agg.orderBy(F.desc("date")).limit(limit)
    return agg.orderBy("date")


# A7 -------------------------------------------------------------------------
def response_buckets(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    return (filtered_tickets(model, filters)
            .groupBy(X.response_bucket().alias("bucket"))
            .agg(F.count(F.lit(1)).alias("ticket_count")))


# A8 -------------------------------------------------------------------------
def customer_behavior(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    """Two-level: tickets per customer, then unique / repeat / mean."""
    per_customer = (filtered_tickets(model, filters).groupBy("customer_id")
                    .agg(F.count(F.lit(1)).alias("ticket_count")))
    return per_customer.agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.coalesce(F.sum(X.flag(F.col("ticket_count") > 1)), F.lit(0)).cast("long").alias("repeat_customers"),
        X.round2(F.avg("ticket_count")).alias("average_tickets_per_customer"),
    ).withColumn("repeat_customer_rate", X.rate("repeat_customers", "unique_customers"))


# A9 / T3 ----------------------------------------------------------------------
def top_customers(model: TicketModel, filters: AnalyticsFilters, limit: int = TOP_CUSTOMERS) -> DataFrame:
    """Tickets per customer with identity; count desc, name asc, id asc.

    Tickets are counted per customer *before* the customer join, so the join
    sees one row per customer whatever the skew of the ticket table."""
    counts = (filtered_tickets(model, filters).groupBy("customer_id")
              .agg(F.count(F.lit(1)).alias("ticket_count")))
    named = counts.join(model.customers.select("customer_id", "requester_name", "requester_email"),
                        "customer_id", "inner")
    return (named.orderBy(F.desc("ticket_count"), F.asc("requester_name"), F.asc("customer_id"))
            .limit(limit))

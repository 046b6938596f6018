"""Per-customer metrics.

Tickets are aggregated per customer *before* the customer join, so the join
sees one row per customer whatever the ticket skew. Recurrence uses the
telescoping identity (no per-customer window over tickets); the per-customer
top-k topics window runs over (customer, tag) counts, at most one row per tag
per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..filters import CustomerMetricsArgs
from ..functions import expressions as X
from ..model import TicketModel
from .filtering import apply_filters
from .paging import offset_page


# A10 ------------------------------------------------------------------------
def customer_aggregates(model: TicketModel, args: CustomerMetricsArgs) -> DataFrame:
    """Volume, resolved, good, bad, avg valid response, recurrence per customer."""
    t = apply_filters(model, args.filters, model.rated_tickets(("score",)))
    per_customer = t.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("ticket_volume"),
        F.sum(X.flag(X.is_resolved())).cast("long").alias("resolved_tickets"),
        F.sum(X.flag(X.is_good())).cast("long").alias("good_ratings"),
        F.sum(X.flag(X.is_bad())).cast("long").alias("bad_ratings"),
        X.round2(F.avg(X.valid_response_seconds())).alias("average_first_response_seconds"),
        F.min("source_created_at").alias("first_at"),
        F.max("source_created_at").alias("last_at"),
    )
    # Consecutive gaps telescope to (last - first) over (n - 1) intervals.
    intervals = F.col("ticket_volume") - 1
    with_rec = per_customer.select(
        "*",
        F.when(intervals > 0, X.round2(X.seconds_between("last_at", "first_at") / intervals))
        .alias("average_recurrence_seconds"),
        intervals.alias("recurrence_sample_intervals"),
    ).drop("first_at", "last_at")
    customers = model.customers.select("customer_id", "external_requester_id",
                                       "requester_name", "requester_email")
    joined = with_rec.join(customers, "customer_id", "inner")
    rated = F.col("good_ratings") + F.col("bad_ratings")
    return joined.select(
        "customer_id", "external_requester_id", "requester_name", "requester_email",
        "ticket_volume", "resolved_tickets", "good_ratings", "bad_ratings",
        "average_first_response_seconds", "average_recurrence_seconds", "recurrence_sample_intervals",
        X.rate("resolved_tickets", "ticket_volume").alias("resolution_rate"),
        X.rate("good_ratings", rated).alias("satisfaction_rate"),
    )


# F17 ------------------------------------------------------------------------
def apply_metric_ranges(aggs: DataFrame, args: CustomerMetricsArgs) -> DataFrame:
    """HAVING-like bounds; a null satisfaction rate fails any rate bound."""
    if args.ticket_volume_min is not None:
        aggs = aggs.filter(F.col("ticket_volume") >= args.ticket_volume_min)
    if args.ticket_volume_max is not None:
        aggs = aggs.filter(F.col("ticket_volume") <= args.ticket_volume_max)
    if args.satisfaction_rate_min is not None:
        aggs = aggs.filter(F.col("satisfaction_rate") >= args.satisfaction_rate_min)
    if args.satisfaction_rate_max is not None:
        aggs = aggs.filter(F.col("satisfaction_rate") <= args.satisfaction_rate_max)
    return aggs


# A12 / W2 / A13 -----------------------------------------------------------------
def customer_topic_counts(model: TicketModel, args: CustomerMetricsArgs,
                          customers: DataFrame | None = None) -> DataFrame:
    """Distinct tickets per (customer, tag); optionally restricted (J11) to
    the customers of ``customers`` by a semi join."""
    t = apply_filters(model, args.filters).select("ticket_id", "customer_id")
    if customers is not None:
        # page first, enrich after: only the page customers' tickets, and only
        # their bridge rows (the model restricts its sources before building)
        t = t.join(customers.select("customer_id"), "customer_id", "left_semi")
        links = model.links_for(t).select("ticket_id", "tag")
    else:
        links = model.topic_links().select("ticket_id", "tag")
    return (t.join(links, "ticket_id", "inner")
            .groupBy("customer_id", "tag").agg(F.count(F.lit(1)).alias("ticket_count")))


def customer_top_topics(model: TicketModel, args: CustomerMetricsArgs,
                        customers: DataFrame | None = None) -> DataFrame:
    """Top ``k`` topics per customer (count desc, tag asc) as an ordered
    array<struct<tag, ticket_count>>."""
    counts = customer_topic_counts(model, args, customers)
    w = Window.partitionBy("customer_id").orderBy(F.desc("ticket_count"), F.asc("tag"))
    ranked = counts.withColumn("topic_rank", F.row_number().over(w)).filter(
        F.col("topic_rank") <= args.top_topics_limit)
    nested = ranked.groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct("topic_rank", "tag", "ticket_count"))).alias("ranked"))
    return nested.select(
        "customer_id",
        F.transform("ranked", lambda s: F.struct(s["tag"].alias("tag"),
                                                 s["ticket_count"].alias("ticket_count"))).alias("top_topics"))


def customer_top_topic_rows(model: TicketModel, args: CustomerMetricsArgs) -> DataFrame:
    """W2 in flat form: (customer_id, topic_rank, tag, ticket_count)."""
    counts = customer_topic_counts(model, args)
    w = Window.partitionBy("customer_id").orderBy(F.desc("ticket_count"), F.asc("tag"))
    return (counts.withColumn("topic_rank", F.row_number().over(w))
            .filter(F.col("topic_rank") <= args.top_topics_limit))


def _order():
    return (F.desc("ticket_volume"), F.asc("requester_name"), F.asc("customer_id"))


# D15 / T4 / J7 ------------------------------------------------------------------
def customer_metrics_page(model: TicketModel, args: CustomerMetricsArgs) -> DataFrame:
    """One offset page of customer metrics with top topics, plus page flags.

    The aggregates are computed once, in the order of the pages
    (``OrderedRows``), which gives the total and the page (at most 100
    customers); topics are then computed only for those customers through a
    semi join, as the reference does."""
    aggs = apply_metric_ranges(customer_aggregates(model, args), args)
    page, total = offset_page(aggs, list(_order()), args.page, args.page_size)
    topics = customer_top_topics(model, args, page)
    empty_topics = F.array().cast("array<struct<tag:string,ticket_count:bigint>>")
    enriched = page.join(topics, "customer_id", "left").withColumn(
        "top_topics", F.coalesce(F.col("top_topics"), empty_topics))
    return enriched.select(
        "*",
        F.lit(total).cast("long").alias("total"),
        F.lit(args.page * args.page_size < total).alias("has_next"),
        F.lit(args.page > 1).alias("has_previous"),
    ).orderBy("place").drop("place")


def customer_metrics_all(model: TicketModel, args: CustomerMetricsArgs) -> DataFrame:
    """Every customer's metrics with top topics (no paging; feeds E6)."""
    aggs = apply_metric_ranges(customer_aggregates(model, args), args)
    topics = customer_top_topics(model, args)
    empty_topics = F.array().cast("array<struct<tag:string,ticket_count:bigint>>")
    return aggs.join(topics, "customer_id", "left").withColumn(
        "top_topics", F.coalesce(F.col("top_topics"), empty_topics))

"""The whole dashboard as a handful of Spark jobs.

The reference issues up to 17 sequential statements per dashboard. Here:

1. one ``GROUPING SETS`` aggregation over the tickets of both windows gives
   the summary, status, priority, day and response-bucket rows (the Expand
   multiplies rows in memory, the table is read once);
2. one per-(customer, window) aggregation gives recurrence and customer
   behaviour (``metrics_comparison`` and ``customer_behavior``);
3. one pass over the tag bridge gives the topic breakdown.

The grouped result of (1) is small (one row per label per window). It is written
once to the shared folder, so every chart built from it is a cheap projection
and nothing stays cached. ``dashboard_bundle`` nests it all in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TIMELINE_LIMIT, TOP_TOPICS_LIMIT
from ..filters import AnalyticsFilters, check_limit
from ..functions import expressions as X
from ..model import TicketModel
from ..operators import comparison as C
from ..operators import dashboard as D
from ..operators import exports as E
from ..session import staged

DIMENSIONS = ("status", "priority", "day", "bucket")


def grouped_rows(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    """Long-form rows: (dimension, label, is_current, counts...) where
    dimension is 'all' for the window totals."""
    t, _ = C.two_period_tickets(model, filters, with_score=True)
    base = t.select(
        "is_current", "status", "priority",
        F.to_date("source_created_at").cast("string").alias("day"),
        X.response_bucket().alias("bucket"),
        X.flag(X.is_resolved()).alias("resolved"),
        X.valid_response_seconds().alias("resp"),
        X.flag(X.is_good()).alias("good"),
        X.flag(X.is_bad()).alias("bad"),
    )
    sets = [["is_current"]] + [["is_current", d] for d in DIMENSIONS]
    agg = base.groupingSets(sets, "is_current", *DIMENSIONS).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("ticket_count"),
        F.sum("resolved").cast("long").alias("resolved_tickets"),
        F.sum("resp").alias("resp_sum"),
        F.count("resp").alias("resp_n"),
        F.sum("good").cast("long").alias("good_ratings"),
        F.sum("bad").cast("long").alias("bad_ratings"),
    )
    # grouping_id has one bit per grouping column (is_current, status,
    # priority, day, bucket), set when the column is rolled up: the set that
    # keeps only ``d`` clears d's bit, so the row's dimension is read from the
    # bits, not from null labels.
    n = len(DIMENSIONS)
    dimension = F.lit("all")
    label = F.lit(None).cast("string")
    for i, d in enumerate(DIMENSIONS):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        dimension = F.when(F.col("gid") == gid, F.lit(d)).otherwise(dimension)
        label = F.when(F.col("gid") == gid, F.col(d)).otherwise(label)
    return agg.select(
        dimension.alias("dimension"), label.alias("label"), "is_current", "ticket_count",
        "resolved_tickets",
        X.round2(F.try_divide(F.col("resp_sum"), F.col("resp_n"))).alias("average_first_response_seconds"),
        "good_ratings", "bad_ratings",
    )


def scope(model: TicketModel, filters: AnalyticsFilters) -> DataFrame:
    """One row: the window asked for, the one it is compared with, and whether there is one."""
    before = filters.previous()
    times = {"from_at": filters.from_at, "to_at": filters.to_at, "previous_from_at": before and before.from_at, "previous_to_at": before and before.to_at}
    return model.tickets.sparkSession.range(1).select(
        *[F.lit(t).cast("timestamp_ntz").alias(name) for name, t in times.items()],
        F.lit(before is not None).alias("is_comparable"), F.lit("UTC").alias("timezone"))


#: Charts of several rows, and the order of their rows. Customers, which no bound holds, stay a frame of their own.
ORDERS = {
    "status_distribution": lambda: (-F.col("value"), F.col("label")),
    "priority_breakdown": lambda: (-F.col("ticket_count"), F.col("priority")),
    "priority_distribution": lambda: (-F.col("value"), F.col("label")),
    "top_topics": lambda: (F.col("rank"),),
    "operation_timeseries": lambda: (F.col("date"),),
    "tickets_over_time": lambda: (F.col("date"),),
    "first_response_distribution": lambda: (F.col("bucket_order"),),
    "top_customers": lambda: (-F.col("ticket_count"), F.col("requester_name"), F.col("customer_id")),
    "tag_options": lambda: (F.col("name"), F.col("id")),
    "assignee_options": lambda: (F.col("name"), F.col("external_id")),
}


def dashboard_bundle(model: TicketModel, filters: AnalyticsFilters, top_topics_limit: int = 10, timeline_limit: int = 90) -> DataFrame:
    """The dashboard as one row: ``scope``, ``metrics``, ``customer_behavior`` and ``summary`` as structs, every chart and the tag
    and assignee options as ordered arrays of structs."""
    frames = dashboard_overview(model, filters, top_topics_limit, timeline_limit)
    key = F.lit(1).alias("one")
    out = None
    for name in ("scope", "metrics", "customer_behavior", "summary"):
        row = frames[name].select(F.struct(*frames[name].columns).alias(name), key)
        out = row if out is None else out.join(row, "one")
    for name, order in ORDERS.items():
        df = frames[name]
        entry = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order())], F.struct(*df.columns).alias("entry"))
        rows = df.select(entry.alias("e")).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]).alias(name))
        out = out.join(rows.select(name, key), "one")
    return out.drop("one")


def dashboard_overview(model: TicketModel, filters: AnalyticsFilters, top_topics_limit: int = 10,
                       timeline_limit: int = 90) -> dict[str, DataFrame]:
    """Every dashboard result as a named DataFrame (lazy; nothing collected).

    The grouped rows are staged: they are few (one row per label and
    window, days bounded by the period) and every chart below reads them."""
    check_limit(top_topics_limit, TOP_TOPICS_LIMIT, "top_topics_limit")
    check_limit(timeline_limit, TIMELINE_LIMIT, "timeline_limit")
    rows = staged(grouped_rows(model, filters), "dashboard")
    cur = rows.filter("is_current")
    comparable = filters.previous() is not None

    def dim(name: str, current: bool = True) -> DataFrame:
        r = rows.filter(F.col("dimension") == name)
        return r.filter(F.col("is_current") == current)

    prev_counts = dim("status", False).select("label", F.col("ticket_count").alias("prev"))
    status = (dim("status").join(prev_counts, "label", "left")
              .select("label", F.col("ticket_count").alias("value"),
                      (F.coalesce("prev", F.lit(0)) if comparable else F.lit(None).cast("long")).alias("previous_value")))
    status = status.withColumn("change_percent", X.change_percent("value", "previous_value")).orderBy(F.desc("value"), "label")
    days = (dim("day").orderBy(F.desc("label")).limit(timeline_limit)
            .select(F.to_date("label").alias("date"), F.col("ticket_count").alias("opened"),
                    F.col("resolved_tickets").alias("resolved"), "average_first_response_seconds",
                    "good_ratings", "bad_ratings"))
    metrics = C.metrics_comparison(model, filters)
    topics = C.topic_breakdown(model, filters, top_topics_limit)
    total = cur.filter(F.col("dimension") == "all").select("ticket_count").scalar()
    buckets = C.bucket_domain(model.tickets.sparkSession)
    bucket_counts = dim("bucket").select(F.col("label").alias("bucket"), F.col("ticket_count").alias("n"))
    first_response = (F.broadcast(buckets).join(bucket_counts, "bucket", "left")
                      .select("bucket", "label", F.coalesce("n", F.lit(0)).alias("ticket_count"), "bucket_order")
                      .withColumn("share", X.rate("ticket_count", total)).orderBy("bucket_order"))
    prio_prev = dim("priority", False).select(F.col("label").alias("priority"), F.col("ticket_count").alias("prev"))
    priority = (dim("priority").select(F.col("label").alias("priority"), "ticket_count", "resolved_tickets",
                                       "average_first_response_seconds")
                .join(prio_prev, "priority", "left")
                .select("priority", "ticket_count", X.rate("ticket_count", total).alias("share"), "resolved_tickets",
                        X.rate("resolved_tickets", "ticket_count").alias("resolution_rate"),
                        "average_first_response_seconds",
                        (F.coalesce("prev", F.lit(0)) if comparable else F.lit(None).cast("long"))
                        .alias("previous_ticket_count"))
                .withColumn("change_percent", X.change_percent("ticket_count", "previous_ticket_count"))
                .orderBy(F.desc("ticket_count"), "priority"))
    return {
        "scope": scope(model, filters),
        "grouped": rows,
        "metrics": metrics,
        "status_distribution": status,
        "priority_breakdown": priority,
        "priority_distribution": priority.select(F.col("priority").alias("label"), F.col("ticket_count").alias("value")),
        "top_topics": topics,
        "operation_timeseries": C.operation_timeseries(days),
        "tickets_over_time": C.tickets_over_time(days),
        "first_response_distribution": first_response,
        "customer_behavior": D.customer_behavior(model, filters),
        "top_customers": D.top_customers(model, filters),
        "summary": C.dashboard_summary(metrics, topics),
        "tag_options": E.tag_options(model),
        "customer_options": E.customer_options(model),
        "assignee_options": E.assignee_options(model),
    }

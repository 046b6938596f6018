"""Exports (E1-E7, F18, U1, J8, A15, A16, S7).

The data export is one job: filtered tickets joined to their customer,
rating and sorted tag names, serialised with column expressions. The metric
export is a union of per-metric projections into one fixed 14-column shape.
Batching, keyset loops and offset re-queries of the reference disappear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ASSIGNEE_FALLBACK_PREFIX,
    EXPORT_FIELDS,
    EXPORT_PRESETS,
    METRIC_CODES,
    METRIC_EXPORT_ORDER,
    METRIC_LABELS,
    METRIC_UNITS,
    OVERALL_SCOPE_ID,
    OVERALL_SCOPE_LABEL,
)
from ..filters import AnalyticsFilters, CustomerMetricsArgs
from ..functions import expressions as X
from ..model import TICKET_CORE_COLUMNS, TicketModel
from ..session import staged
from . import customers as CM
from .dashboard import period_summary, recurrence, topic_aggregates
from .filtering import apply_filters


def resolve_fields(fields=None, preset: str | None = None) -> list[str]:
    """caller's order; preset names; empty -> all fields."""
    if preset:
        if preset not in EXPORT_PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        return list(EXPORT_PRESETS[preset])
    if isinstance(fields, str):
        fields = [f.strip() for f in fields.split(",") if f.strip()]
    if not fields:
        return list(EXPORT_FIELDS)
    bad = [f for f in fields if f not in EXPORT_FIELDS]
    if bad:
        raise ValueError(f"unknown export fields: {bad}")
    return list(fields)


# J8 -------------------------------------------------------------------------
def ticket_tag_names(model: TicketModel, tickets: DataFrame | None = None) -> DataFrame:
    """(ticket_id, tags) with the ticket's tag names sorted; of the given
    tickets only, if any are given (the bridge is restricted before it is built)."""
    links = model.topic_links() if tickets is None else model.links_for(tickets.select("ticket_id"))
    return links.groupBy("ticket_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


# E1 -------------------------------------------------------------------------
def export_records(model: TicketModel, filters: AnalyticsFilters, limit: int | None = None,
                   ranges: str | None = None) -> DataFrame:
    """Denormalised ticket records (typed), ordered by external ticket id.

    The narrow record (ticket, rating, customer, sorted tags) is assembled
    first and the text (subject, whole description) is attached last, so the
    wide text column crosses one shuffle instead of one per join, or none if
    the model deals the narrow records out by ``ranges``, the column by which
    the caller sorts."""
    rating_columns = ("score", "offered_at", "rated_at", "comment")
    if limit is None:
        t = apply_filters(model, filters, model.rated_tickets(rating_columns))
    else:  # preview: the first rows are cut on narrow columns, and everything else is joined to them only
        first = staged(apply_filters(model, filters).select(*TICKET_CORE_COLUMNS).orderBy("ticket_id").limit(limit), "preview")
        t = first.join(model.ratings.select("ticket_id", *rating_columns).join(first.select("ticket_id"), "ticket_id", "left_semi"), "ticket_id", "left")
    customers = model.customers.select("customer_id", "external_requester_id",
                                       "requester_name", "requester_email")
    tagged = ticket_tag_names(model, None if limit is None and filters == AnalyticsFilters() else t)
    narrow = t.join(customers, "customer_id", "inner").join(tagged, "ticket_id", "left")
    joined = model.attach_text(narrow, ranges=ranges)
    rating = F.when(F.col("score").isNotNull(), F.struct(
        F.col("score"), F.col("offered_at"), F.col("rated_at"),
        F.coalesce(F.col("comment"), F.lit("")).alias("comment")))
    return joined.select(
        F.col("ticket_id"), "subject", "description", "status", "priority",
        F.col("external_requester_id").alias("requester_id"), "requester_name", "requester_email",
        F.col("assignee_external_id").alias("assignee_id"), "assignee_name",
        F.col("source_created_at").alias("created_at"),
        F.col("source_updated_at").alias("updated_at"),
        "first_response_at",
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        rating.alias("satisfaction_rating"),
    )


# E2 -------------------------------------------------------------------------
def serialize_records(records: DataFrame, fields: list[str]) -> DataFrame:
    """Lower-case enums, ISO-Z times, rating struct with lower-case score."""
    r = F.col("satisfaction_rating")
    rating = F.when(r.isNotNull(), F.struct(
        F.lower(r["score"]).alias("score"),
        X.iso_z(r["offered_at"]).alias("offered_at"),
        X.iso_z(r["rated_at"]).alias("rated_at"),
        r["comment"].alias("comment")))
    complete = {
        "ticket_id": F.col("ticket_id"),
        "subject": F.col("subject"),
        "description": F.col("description"),
        "status": F.lower("status"),
        "priority": F.lower("priority"),
        "requester_id": F.col("requester_id"),
        "requester_name": F.col("requester_name"),
        "requester_email": F.col("requester_email"),
        "assignee_id": F.col("assignee_id"),
        "assignee_name": F.col("assignee_name"),
        "created_at": X.iso_z("created_at"),
        "updated_at": X.iso_z("updated_at"),
        "first_response_at": X.iso_z("first_response_at"),
        "tags": F.col("tags"),
        "satisfaction_rating": rating,
    }
    return records.select(*[complete[f].alias(f) for f in fields])


def data_export(model: TicketModel, filters: AnalyticsFilters, fields=None, preset=None) -> DataFrame:
    """E4 body: serialised rows in external-id order, chosen fields."""
    chosen = resolve_fields(fields, preset)
    ranges = "ticket_id" if "description" in chosen else None
    return serialize_records(export_records(model, filters, ranges=ranges).orderBy("ticket_id"), chosen)


# X12 ------------------------------------------------------------------------
def report_cells(df: DataFrame) -> DataFrame:
    """Every column rendered as report text (null -> '', JSON for nested,
    formula guard); the frame handed to a CSV/XLSX sink. The value of a metric
    that counts tickets is a whole number."""
    cells = {f.name: X.cell_text(F.col(f.name), f.dataType) for f in df.schema.fields}
    if {"metric_code", "value"} <= set(df.columns):
        whole = F.col("metric_code").isin("ticket_volume", "top_topics")
        cells["value"] = F.when(whole, F.coalesce(F.col("value").cast("long").cast("string"), F.lit(""))).otherwise(cells["value"])
    return df.select(*[c.alias(name) for name, c in cells.items()])


# E3 / A15 ---------------------------------------------------------------------
def export_preview(model: TicketModel, filters: AnalyticsFilters, fields=None, preset=None,
                   limit: int = 50) -> DataFrame:
    """Total matching + the first ``limit`` (1..100) serialised rows."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    chosen = resolve_fields(fields, preset)
    total = apply_filters(model, filters).select(F.count(F.lit(1))).scalar()
    first = export_records(model, filters, limit=limit)
    out = serialize_records(first, chosen if "ticket_id" in chosen else chosen + ["ticket_id"])
    return out.withColumn("total_matching", total).orderBy("ticket_id")  # the text join keeps no order


# E7 -------------------------------------------------------------------------
def _metric_row(scope_type: Column, scope_id: Column, scope_label: Column, code: str, value: Column, *,
                numerator: Column | None = None, denominator: Column | None = None,
                sample_size: Column | None = None, dimension: Column | None = None,
                rank: Column | None = None, period=(None, None)) -> list[Column]:
    def lit_or(c, dtype):
        return (c if c is not None else F.lit(None)).cast(dtype)

    return [
        scope_type.alias("scope_type"), scope_id.alias("scope_id"), scope_label.alias("scope_label"),
        F.lit(code).alias("metric_code"), F.lit(METRIC_LABELS[code]).alias("metric_label"),
        value.cast("double").alias("value"), F.lit(METRIC_UNITS[code]).alias("unit"),
        lit_or(numerator, "long").alias("numerator"), lit_or(denominator, "long").alias("denominator"),
        lit_or(sample_size, "long").alias("sample_size"), lit_or(dimension, "string").alias("dimension"),
        lit_or(rank, "int").alias("rank"),
        F.lit(period[0]).cast("string").alias("period_start"),
        F.lit(period[1]).cast("string").alias("period_end"),
    ]


def _period(filters: AnalyticsFilters):
    return (filters.from_at.isoformat() if filters.from_at else None,
            filters.to_at.isoformat() if filters.to_at else None)


def _check_topics(k: int) -> None:
    if not 1 <= k <= 50:
        raise ValueError("top_topics_limit must be within 1..50")


def _metrics(metrics) -> list[str]:
    if isinstance(metrics, str):
        metrics = [m.strip() for m in metrics.split(",") if m.strip()]
    if not metrics:
        return list(METRIC_CODES)
    bad = [m for m in metrics if m not in METRIC_CODES]
    if bad:
        raise ValueError(f"unknown metrics: {bad}")
    return list(metrics)


# E5 / U1 ----------------------------------------------------------------------
def metrics_overall(model: TicketModel, filters: AnalyticsFilters, metrics=None,
                    top_topics_limit: int = 10) -> DataFrame:
    """One row per selected metric, one per ranked topic (overall scope)."""
    _check_topics(top_topics_limit)
    chosen = _metrics(metrics)
    period = _period(filters)
    st, sid, slabel = F.lit("overall"), F.lit(OVERALL_SCOPE_ID), F.lit(OVERALL_SCOPE_LABEL)
    # A1 as one global aggregate row exploded into its metric rows, A2 as one
    # per-customer pass; each appears once in the plan
    summary = period_summary(model, filters)
    rec = recurrence(model, filters)
    rated = F.col("good_ratings") + F.col("bad_ratings")
    summary_rows: list[Column] = []
    parts: list[DataFrame] = []
    if "ticket_volume" in chosen:
        summary_rows.append(F.struct(*_metric_row(st, sid, slabel, "ticket_volume", F.col("total_tickets"),
                                                  period=period)))
    if "average_recurrence_seconds" in chosen:
        parts.append(rec.select(*_metric_row(st, sid, slabel, "average_recurrence_seconds",
                                             F.col("average_recurrence_seconds"),
                                             sample_size=F.col("recurrence_sample_intervals"), period=period)))
    if "resolution_rate" in chosen:
        summary_rows.append(F.struct(*_metric_row(
            st, sid, slabel, "resolution_rate", X.rate("resolved_tickets", "total_tickets"),
            numerator=F.col("resolved_tickets"), denominator=F.col("total_tickets"), period=period)))
    if "satisfaction_rate" in chosen:
        summary_rows.append(F.struct(*_metric_row(
            st, sid, slabel, "satisfaction_rate", X.rate("good_ratings", rated),
            numerator=F.col("good_ratings"), denominator=rated, sample_size=rated, period=period)))
    if "average_first_response_seconds" in chosen:
        summary_rows.append(F.struct(*_metric_row(
            st, sid, slabel, "average_first_response_seconds", F.col("average_first_response_seconds"),
            sample_size=F.col("responded_tickets"), period=period)))
    if summary_rows:
        parts.insert(0, summary.select(F.inline(F.array(*summary_rows))))
    if "top_topics" in chosen:
        topics = topic_aggregates(model, filters, top_topics_limit)
        from pyspark.sql import Window
        ranked = topics.withColumn("rank", F.row_number().over(
            Window.orderBy(F.desc("ticket_count"), F.asc("tag"))))  # at most k rows
        parts.append(ranked.select(*_metric_row(st, sid, slabel, "top_topics", F.col("ticket_count"),
                                                dimension=F.col("tag"), rank=F.col("rank"), period=period)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # export order, topics last by rank (at most 5 + 50 rows)
    position = F.array_position(F.array(*[F.lit(c) for c in METRIC_EXPORT_ORDER]), F.col("metric_code"))
    return out.orderBy(position, F.col("rank").asc_nulls_first())


# E6 -------------------------------------------------------------------------
def metrics_by_customer(model: TicketModel, filters: AnalyticsFilters, metrics=None,
                        top_topics_limit: int = 10) -> DataFrame:
    """Per-customer metric rows for every customer (no paging): one job that
    explodes an array of row structs per customer (Q9: no sample size on the
    customer response-time row)."""
    _check_topics(top_topics_limit)
    chosen = _metrics(metrics)
    period = _period(filters)
    args = CustomerMetricsArgs(filters=filters, page_size=100, top_topics_limit=top_topics_limit)
    cust = CM.customer_metrics_all(model, args)
    st = F.lit("customer")
    sid = F.col("customer_id").cast("string")
    slabel = X.requester_label()
    rated = F.col("good_ratings") + F.col("bad_ratings")
    rows: list[Column] = []

    def row(*cols):
        return F.struct(*cols)

    if "ticket_volume" in chosen:
        rows.append(F.array(row(*_metric_row(st, sid, slabel, "ticket_volume", F.col("ticket_volume"),
                                             period=period))))
    if "average_recurrence_seconds" in chosen:
        rows.append(F.array(row(*_metric_row(st, sid, slabel, "average_recurrence_seconds",
                                             F.col("average_recurrence_seconds"),
                                             sample_size=F.col("recurrence_sample_intervals"), period=period))))
    if "resolution_rate" in chosen:
        rows.append(F.array(row(*_metric_row(st, sid, slabel, "resolution_rate", F.col("resolution_rate"),
                                             numerator=F.col("resolved_tickets"),
                                             denominator=F.col("ticket_volume"), period=period))))
    if "satisfaction_rate" in chosen:
        rows.append(F.array(row(*_metric_row(st, sid, slabel, "satisfaction_rate", F.col("satisfaction_rate"),
                                             numerator=F.col("good_ratings"), denominator=rated,
                                             sample_size=rated, period=period))))
    if "average_first_response_seconds" in chosen:
        rows.append(F.array(row(*_metric_row(st, sid, slabel, "average_first_response_seconds",
                                             F.col("average_first_response_seconds"), period=period))))
    if "top_topics" in chosen:
        topic_rows = F.transform(
            F.col("top_topics"),
            lambda tpc, i: row(*_metric_row(st, sid, slabel, "top_topics", tpc["ticket_count"],
                                            dimension=tpc["tag"], rank=i + 1, period=period)))
        rows.append(topic_rows)
    all_rows = F.flatten(F.array(*rows)) if len(rows) > 1 else rows[0]
    ordered = cust.orderBy(F.desc("ticket_volume"), "requester_name", "customer_id")  # customers are sorted, not their rows
    return ordered.select(F.inline(all_rows))


# S7 / A16 ---------------------------------------------------------------------
def assignee_options(model: TicketModel) -> DataFrame:
    """Distinct (id, name) of assigned tickets ordered by name; a missing name
    falls back to a generated label."""
    t = model.tickets.filter(F.col("assignee_external_id").isNotNull())
    pairs = t.select(F.col("assignee_external_id").alias("external_id"),
                     F.col("assignee_name")).distinct()
    label = F.coalesce(F.nullif(F.col("assignee_name"), F.lit("")),
                       F.concat(F.lit(ASSIGNEE_FALLBACK_PREFIX), F.col("external_id").cast("string")))
    return pairs.select("external_id", label.alias("name")).orderBy("name", "external_id")


def tag_options(model: TicketModel) -> DataFrame:
    return model.tags.select(F.col("tag_id").alias("id"), "name").orderBy("name")


def customer_options(model: TicketModel) -> DataFrame:
    return (model.customers.select(F.col("customer_id").alias("id"), "requester_name", "requester_email")
            .orderBy("requester_name", "requester_email"))

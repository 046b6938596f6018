"""The conjunctive ticket filter.

Plain predicates are column filters (pushed into the Parquet scan where the
column is stored). EXISTS conditions (e-mail, tag, rating score) are
``left_semi`` joins: the filtered dimension side is usually tiny, so AQE turns
the semi join into a broadcast at run time; when it is not, it stays a
shuffle join — nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..filters import AnalyticsFilters
from ..model import TicketModel


def ts_literal(value) -> Column:
    """A naive datetime as a timestamp_ntz literal (built from text, so no
    time zone of the driver or the session is involved)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def period_predicate(filters: AnalyticsFilters, col: str = "source_created_at") -> Column | None:
    """inclusive on both ends."""
    conds = []
    if filters.from_at is not None:
        conds.append(F.col(col) >= ts_literal(filters.from_at))
    if filters.to_at is not None:
        conds.append(F.col(col) <= ts_literal(filters.to_at))
    return reduce(lambda a, b: a & b, conds) if conds else None


def column_predicates(filters: AnalyticsFilters) -> list[Column]:
    """Predicates on ticket columns only."""
    preds: list[Column] = []
    period = period_predicate(filters)
    if period is not None:
        preds.append(period)
    if filters.customer_ids:
        preds.append(F.col("customer_id").isin(list(filters.customer_ids)))
    if filters.statuses:
        preds.append(F.col("status").isin(list(filters.statuses)))
    if filters.priorities:
        preds.append(F.col("priority").isin(list(filters.priorities)))
    if filters.assignee_external_ids:
        preds.append(F.col("assignee_external_id").isin(list(filters.assignee_external_ids)))
    if filters.has_first_response is True:
        preds.append(F.col("first_response_at").isNotNull())
    elif filters.has_first_response is False:
        preds.append(F.col("first_response_at").isNull())
    return preds


def _text(col: str, collation: str | None) -> Column:
    return F.collate(F.col(col), collation) if collation else F.col(col)


def apply_filters(model: TicketModel, filters: AnalyticsFilters,
                  tickets: DataFrame | None = None) -> DataFrame:
    """AND of whichever conditions are set, on ``tickets`` (default: the
    model's tickets). Output keeps the input's columns and rows' identity."""
    df = model.tickets if tickets is None else tickets
    for pred in column_predicates(filters):
        df = df.filter(pred)
    # Partitioned layouts (sources/tables.py) add a coarse predicate on their
    # partition column, implied by the period, so whole partitions are pruned.
    month = getattr(model, "month_predicate", None)
    if month is not None and "created_month" in df.columns:
        coarse = month(filters.from_at, filters.to_at)
        if coarse is not None:
            df = df.filter(coarse)

    if filters.requester_emails:  # EXISTS customer with lower(email) in list
        matching = (model.customers
                    .filter((F.collate(F.lower("requester_email"), filters.collation) if filters.collation
                             else F.lower(F.col("requester_email"))).isin(list(filters.requester_emails)))
                    .select("customer_id"))
        df = df.join(matching, "customer_id", "left_semi")

    if filters.tag_ids or filters.tag_names:  # F8: the same tag satisfies both
        if model.tag_ids_are_names:
            links = model.ticket_tags
            if filters.tag_ids:
                links = links.filter(F.col("tag_id").isin(list(filters.tag_ids)))
            if filters.tag_names:
                links = links.filter(_text("tag_id", filters.collation).isin(list(filters.tag_names)))
            links = links.select("ticket_id")
        else:
            tags = model.tags
            if filters.tag_ids:
                tags = tags.filter(F.col("tag_id").isin(list(filters.tag_ids)))
            if filters.tag_names:
                tags = tags.filter(_text("name", filters.collation).isin(list(filters.tag_names)))
            links = model.ticket_tags.join(tags.select("tag_id"), "tag_id", "left_semi").select("ticket_id")
        df = df.join(links, "ticket_id", "left_semi")

    if filters.satisfaction_scores:  # unrated tickets never match
        rated = (model.rating_scores.filter(F.col("score").isin(list(filters.satisfaction_scores)))
                 .select("ticket_id"))
        df = df.join(rated, "ticket_id", "left_semi")
    return df


# F19 ------------------------------------------------------------------------
def lookup(table: DataFrame, key: str, ids: DataFrame | list) -> DataFrame:
    """Rows of ``table`` whose ``key`` is among ``ids`` (a frame of keys, or a
    short list of literal ids): a semi join, never a driver-side loop."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return table.filter(F.col(key).isin(list(ids)))

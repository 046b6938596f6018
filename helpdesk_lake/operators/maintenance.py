"""Bulk table maintenance (M1-M4), re-aimed from single-row CRUD.

Every operation takes frames of keys/rows and returns new frames (or a frame
of violations); constraints are joins: unique keys are ``groupBy`` counts,
foreign keys and RESTRICT rules are anti/semi joins, cascades are anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TicketModel


# M1 -------------------------------------------------------------------------
def insert_violations(existing: DataFrame, new_rows: DataFrame, key: list[str],
                      foreign_keys: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(key..., violation) for rows that would break a unique key (already
    present or repeated in the insert) or reference a missing parent."""
    keys = [F.col(k) for k in key]
    dup_existing = (new_rows.select(*key).join(existing.select(*key).distinct(), key, "left_semi")
                    .withColumn("violation", F.lit("duplicate key")))
    dup_batch = (new_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                 .select(*key).withColumn("violation", F.lit("duplicate key in insert")))
    out = dup_existing.unionByName(dup_batch)
    for column, (parent, parent_key) in (foreign_keys or {}).items():
        missing = (new_rows.join(parent.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")
                   .select(*key).withColumn("violation", F.lit(f"missing parent for {column}")))
        out = out.unionByName(missing)
    return out.distinct()


# M2 -------------------------------------------------------------------------
def patch_rows(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Null in the patch means "keep"; ids absent from the base are reported
    by ``unknown_patch_ids`` (``sinks.maintain.patch_tickets`` fails on them)."""
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = base.join(p, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                           for c in base.columns])


def unknown_patch_ids(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    return patch.select(key).join(base.select(key), key, "left_anti")


# M3 -------------------------------------------------------------------------
def delete_tickets(model: TicketModel, ticket_ids: DataFrame) -> dict[str, DataFrame]:
    """Ticket delete cascades to its rating and tag links."""
    ids = ticket_ids.select("ticket_id")
    return {
        "tickets": model.tickets.join(ids, "ticket_id", "left_anti"),
        "ratings": model.ratings.join(ids, "ticket_id", "left_anti"),
        "ticket_tags": model.ticket_tags.join(ids, "ticket_id", "left_anti"),
    }


def delete_tags(model: TicketModel, tag_ids: DataFrame) -> dict[str, DataFrame]:
    """Tag delete cascades to its links."""
    ids = tag_ids.select("tag_id")
    return {
        "tags": model.tags.join(ids, "tag_id", "left_anti"),
        "ticket_tags": model.ticket_tags.join(ids, "tag_id", "left_anti"),
    }


def refused_customer_deletes(model: TicketModel, customer_ids: DataFrame) -> DataFrame:
    """RESTRICT: customers that still have tickets cannot be deleted."""
    return customer_ids.select("customer_id").join(model.tickets.select("customer_id").distinct(), "customer_id", "left_semi")


def delete_customers(model: TicketModel, customer_ids: DataFrame) -> DataFrame:
    """Customers after deleting those of ``customer_ids`` that have no tickets."""
    allowed = customer_ids.select("customer_id").join(
        model.tickets.select("customer_id").distinct(), "customer_id", "left_anti")
    return model.customers.join(allowed, "customer_id", "left_anti")


# M4 -------------------------------------------------------------------------
def unlink(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Remove (ticket_id, tag_id) pairs; absent pairs are a no-op."""
    return links.join(pairs.select("ticket_id", "tag_id"), ["ticket_id", "tag_id"], "left_anti")

"""M1-M4 written back to the Parquet tables of ``sources.tables``.

A change rewrites the month partitions that hold its tickets, and no others
(dynamic partition overwrite: tasks write beside the table, the job's commit
puts the new partitions in place of the old). Rules are checked before
anything is written, and a broken rule raises. Months are few (their list is a
folder listing), ids are joined, never collected. Changes to one set of tables
are made one after the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..session import scratch_path
from ..sources.tables import OF_TICKETS, read_table, with_month


class RuleBroken(ValueError):
    """An insert, patch or delete that the constraints refuse."""


def _refuse(rows: DataFrame, what: str) -> None:
    first = rows.limit(3).collect()
    if first:
        raise RuleBroken(f"{what}: {', '.join(str(tuple(r)) for r in first)}")


def _months(spark: SparkSession, root: str, ticket_ids: DataFrame) -> list[str]:
    """The months of the given tickets."""
    t = read_table(spark, root, "tickets").select("ticket_id", "created_month")
    return [r[0] for r in t.join(ticket_ids.select("ticket_id"), "ticket_id", "left_semi").select("created_month").distinct().collect()]


def _rewrite(spark: SparkSession, root: str, name: str, months: list[str], change) -> None:
    """Put ``change`` of the months' rows in their place; a month left without rows loses its partition."""
    old = read_table(spark, root, name).filter(F.col("created_month").isin(months))
    old_months = {r[0] for r in old.select("created_month").distinct().collect()}
    if not old_months:
        return
    path = f"{root.rstrip('/')}/{name}"
    new = change(old).select(*old.columns).repartitionByRange("created_month", "ticket_id").sortWithinPartitions("created_month", "ticket_id")
    seen = Observation()  # the months written, told by the write itself: the change is not computed once more for them
    (new.observe(seen, F.collect_set("created_month").alias("months")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("created_month").parquet(path))
    kept = set(seen.get["months"] or ())
    for month in old_months - kept:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/created_month={month}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


# M1 -------------------------------------------------------------------------
def insert_tickets(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Append new tickets; a key that exists or repeats, or an unknown customer, refuses the whole insert."""
    existing, customers = read_table(spark, root, "tickets"), read_table(spark, root, "customers")
    _refuse(M.insert_violations(existing, rows, ["ticket_id"], {"customer_id": (customers, "customer_id")}), "insert refused")
    new = with_month(rows)
    (new.repartitionByRange("created_month", "customer_id", "ticket_id").sortWithinPartitions("created_month", "customer_id")
     .write.mode("append").partitionBy("created_month").parquet(f"{root.rstrip('/')}/tickets"))


# M2 -------------------------------------------------------------------------
def patch_tickets(spark: SparkSession, root: str, patch: DataFrame) -> None:
    """Null keeps; an unknown or repeated id refuses the whole patch. The month of a ticket does not change by a patch."""
    if "source_created_at" in patch.columns:
        raise RuleBroken("the creation time of a ticket can't be patched")
    _refuse(M.unknown_patch_ids(read_table(spark, root, "tickets"), patch, "ticket_id"), "unknown ticket")
    _refuse(patch.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ticket_id"), "ticket patched twice")
    _rewrite(spark, root, "tickets", _months(spark, root, patch), lambda old: M.patch_rows(old, patch, "ticket_id"))


# M3 -------------------------------------------------------------------------
def delete_tickets(spark: SparkSession, root: str, ticket_ids: DataFrame, tables: tuple[str, ...] = ("tickets", *OF_TICKETS)) -> None:
    """Tickets go with their rating, links and text; absent ids are no error."""
    months = _months(spark, root, ticket_ids)
    ids = ticket_ids.select("ticket_id")
    for name in (*[t for t in tables if t != "tickets"], "tickets"):  # the tickets last: a repeated call still finds their months
        _rewrite(spark, root, name, months, lambda old: old.join(ids, "ticket_id", "left_anti"))


def delete_tags(spark: SparkSession, root: str, tag_ids: DataFrame) -> None:
    """Tags go with their links."""
    ids = tag_ids.select("tag_id")
    links = read_table(spark, root, "ticket_tags")
    months = [r[0] for r in links.join(ids, "tag_id", "left_semi").select("created_month").distinct().collect()]
    _rewrite(spark, root, "ticket_tags", months, lambda old: old.join(ids, "tag_id", "left_anti"))
    tags = read_table(spark, root, "tags").join(ids, "tag_id", "left_anti")
    _replace(spark, root, "tags", tags)


def delete_customers(spark: SparkSession, root: str, customer_ids: DataFrame) -> None:
    """A customer with tickets refuses the whole delete."""
    ids = customer_ids.select("customer_id")
    held = read_table(spark, root, "tickets").select("customer_id").join(ids, "customer_id", "left_semi").distinct()
    _refuse(held, "customers with tickets")
    _replace(spark, root, "customers", read_table(spark, root, "customers").join(ids, "customer_id", "left_anti"))


def _replace(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """A table without partitions, written beside itself and copied over."""
    beside = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    rows.write.parquet(beside)
    spark.read.schema(rows.schema).parquet(beside).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


# M4 -------------------------------------------------------------------------
def unlink(spark: SparkSession, root: str, pairs: DataFrame) -> None:
    """Remove ticket-tag links; absent pairs are a no-op."""
    _rewrite(spark, root, "ticket_tags", _months(spark, root, pairs), lambda old: M.unlink(old, pairs))

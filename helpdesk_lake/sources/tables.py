"""S3: the model as plain Parquet tables laid out for the queries.

``write_model`` materialises any ``TicketModel`` (the ingested store's
current state, or the fixture model) into one folder per table:

* ``tickets`` partitioned by creation month (``created_month``) so a period
  filter (F2) prunes whole partitions, and sorted by (customer_id,
  source_created_at) inside each file so customer filters (F3) skip row
  groups by their min/max statistics;
* ``ticket_text``, ``ratings``, ``ticket_tags`` partitioned by their ticket's
  month too, so a change to some tickets rewrites the same few partitions
  everywhere, and sorted by ticket_id inside each file;
* ``customers`` sorted by customer_id; ``tags`` as is.

``parquet_model`` reads them back with explicit schemas as a ``TicketModel``;
the period predicate is also applied to ``created_month`` so partition
pruning happens even though the filter is written on source_created_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TICKET_CORE_COLUMNS, TicketModel

TABLE_SCHEMAS = {
    "customers": "customer_id long, external_requester_id long, requester_name string, requester_email string",
    "tickets": ("ticket_id long, customer_id long, status string, priority string, assignee_external_id long, "
                "assignee_name string, source_created_at timestamp_ntz, source_updated_at timestamp_ntz, "
                "first_response_at timestamp_ntz, created_month string"),
    "ticket_text": "ticket_id long, subject string, description string, created_month string",
    "ratings": "ticket_id long, score string, offered_at timestamp_ntz, rated_at timestamp_ntz, comment string, created_month string",
    "tags": "tag_id string, name string",
    "ticket_tags": "ticket_id long, tag_id string, created_month string",
}
#: Tables whose rows belong to a ticket.
OF_TICKETS = ("ticket_text", "ratings", "ticket_tags")


def _parts(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_month(tickets: DataFrame) -> DataFrame:
    return tickets.select(*TICKET_CORE_COLUMNS).withColumn("created_month", F.date_format("source_created_at", "yyyy-MM"))


def write_model(model: TicketModel, path: str, partitions: int | None = None, tables: tuple[str, ...] = tuple(TABLE_SCHEMAS)) -> None:
    root = path.rstrip("/")
    t = with_month(model.tickets)
    n = _parts(t, partitions)
    # range on (month, customer): a busy month or a hot customer spreads over
    # several files instead of one task
    if "tickets" in tables:
        (t.repartitionByRange(n, "created_month", "customer_id", "source_created_at")
         .sortWithinPartitions("created_month", "customer_id", "source_created_at")
         .write.mode("overwrite").partitionBy("created_month").parquet(f"{root}/tickets"))
    months = t.select("ticket_id", "created_month")
    for name in OF_TICKETS:
        if name in tables:
            (model.table(name).join(months, "ticket_id").repartitionByRange(n, "created_month", "ticket_id")
             .sortWithinPartitions("created_month", "ticket_id").write.mode("overwrite").partitionBy("created_month").parquet(f"{root}/{name}"))
    if "customers" in tables:
        model.customers.repartitionByRange(n, "customer_id").sortWithinPartitions("customer_id") \
            .write.mode("overwrite").parquet(f"{root}/customers")
    if "tags" in tables:
        model.tags.write.mode("overwrite").parquet(f"{root}/tags")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table as written, with its month."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


class ParquetTicketModel(TicketModel):
    """A model over ``write_model`` output; period filters also prune months."""

    def month_predicate(self, from_at, to_at):
        conds = []
        if from_at is not None:
            conds.append(F.col("created_month") >= F.lit(from_at.strftime("%Y-%m")))
        if to_at is not None:
            conds.append(F.col("created_month") <= F.lit(to_at.strftime("%Y-%m")))
        out = None
        for c in conds:
            out = c if out is None else out & c
        return out


def parquet_model(spark: SparkSession, path: str, tag_ids_are_names: bool = True) -> ParquetTicketModel:
    def read(name: str) -> DataFrame:
        found = read_table(spark, path, name)
        return found.drop("created_month") if name in OF_TICKETS else found

    return ParquetTicketModel(sources={
        "customers": lambda: read("customers"),
        "tickets": lambda: read("tickets"),
        "ticket_text": lambda: read("ticket_text"),
        "ratings": lambda: read("ratings"),
        "tags": lambda: read("tags"),
        "ticket_tags": lambda: read("ticket_tags"),
    }, tag_ids_are_names=tag_ids_are_names)

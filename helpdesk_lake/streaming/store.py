"""Ingested records (I8, I9, I11): one Parquet table, one partition a batch.

    records/batch=B/   every record of batch B, normalised, with its flags; rejected ones too
    control/           appended rows: enabled, disabled, failed

A batch is one write with dynamic partition overwrite, so it replaces its own
partition and nothing else: a failed batch leaves nothing behind, a repeated one
changes nothing. All tables are read from the records: a ticket's state is its
newest valid record (of equally new ones the first), chosen on narrow columns
and joined to the wide ones for the winners only.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TICKET_CORE_COLUMNS, TicketModel
from ..operators import ingestion as I
from ..schemas import BATCH_RECORD, CONTROL_EVENT
from ..session import staged


class IngestionError(RuntimeError):
    pass


class IngestionDisabled(IngestionError):
    pass


def init_store(spark: SparkSession, root: str) -> None:
    """The empty tables, where they do not exist."""
    spark.createDataFrame([], BATCH_RECORD).write.mode("ignore").partitionBy("batch").parquet(f"{root}/records")
    spark.createDataFrame([], CONTROL_EVENT).write.mode("ignore").parquet(f"{root}/control")


def records(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """All records, or those of all batches but one."""
    found = spark.read.schema(BATCH_RECORD).parquet(f"{root}/records")
    return found if without is None else found.filter(F.col("batch") != without)


# I9 -------------------------------------------------------------------------
def _note(spark: SparkSession, root: str, event: str, batch: str | None = None, error: str | None = None) -> None:
    row = (datetime.now(timezone.utc).replace(tzinfo=None), event, batch, error)
    spark.createDataFrame([row], CONTROL_EVENT).write.mode("append").parquet(f"{root}/control")


def set_enabled(spark: SparkSession, root: str, enabled: bool) -> None:
    """Switch ingestion on or off; off, batches are refused and streams stop before they read on."""
    _note(spark, root, "ENABLED" if enabled else "DISABLED")


def control_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(CONTROL_EVENT).parquet(f"{root}/control")


def is_enabled(spark: SparkSession, root: str) -> bool:
    switch = control_events(spark, root).filter(F.col("event").isin("ENABLED", "DISABLED"))
    return switch.agg(F.max_by("event", "at")).first()[0] != "DISABLED"


def ingestion_state(spark: SparkSession, root: str) -> DataFrame:
    """I9 as one row: DISABLED when switched off, else ERROR or IDLE by the
    latest attempt; the cursor counts the records of all batches."""
    done = records(spark, root).agg(F.count(F.lit(1)).alias("cursor_position"), F.max("ingested_at").alias("last_success_at"))
    failed, switch = F.col("event") == "ERROR", F.col("event").isin("ENABLED", "DISABLED")
    events = control_events(spark, root).agg(
        F.max_by("event", F.when(switch, F.col("at"))).alias("switch"), F.max(F.when(failed, F.col("at"))).alias("failed_at"),
        F.max_by("error", F.when(failed, F.col("at"))).alias("last_error"), F.max("at").alias("noted_at"))
    enabled = F.coalesce(F.col("switch") != "DISABLED", F.lit(True))
    state = (F.when(~enabled, F.lit("DISABLED")).when(F.coalesce(F.col("failed_at") > F.col("last_success_at"), F.col("failed_at").isNotNull()), F.lit("ERROR"))
             .otherwise(F.lit("IDLE")))
    one = F.lit(1).alias("one")  # both sides are one row
    return done.select("*", one).join(events.select("*", one), "one").select(
        enabled.alias("enabled"), state.alias("worker_state"), "cursor_position", "last_success_at", "last_error",
        F.greatest("last_success_at", "noted_at").alias("last_heartbeat_at"))


# I11 ------------------------------------------------------------------------
def ingest_log(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch, in the order of ingestion: what it did, and the cursor after it; failed attempts follow from the control
    table with their error."""
    r = records(spark, root)
    applied = F.col("is_valid") & F.col("applied")
    per = r.groupBy("batch").agg(
        F.max("ingested_at").alias("finished_at"), F.count(F.lit(1)).alias("records"),
        F.count_if(~F.col("is_valid")).alias("rejected"), F.count_if(applied & F.col("created")).alias("tickets_created"),
        F.count_distinct(F.when(applied & F.col("known"), F.col("ticket_id"))).alias("tickets_updated"),
        F.count_if(F.col("is_valid") & ~F.col("applied")).alias("tickets_unchanged"))
    first_seen = (r.filter("is_valid").groupBy("external_requester_id").agg(F.min_by("batch", "ingested_at").alias("batch"))
                  .groupBy("batch").agg(F.count(F.lit(1)).alias("customers_created")))
    before = F.sum("records").over(Window.orderBy("finished_at", "batch"))  # one row a batch
    done = per.join(first_seen, "batch", "left").select(
        "batch", F.lit("SUCCESS").alias("state"), "records", "rejected", F.coalesce("customers_created", F.lit(0).cast("long")).alias("customers_created"),
        "tickets_created", "tickets_updated", "tickets_unchanged", before.alias("next_cursor"), F.lit(None).cast("string").alias("error"), "finished_at")
    zero = F.lit(None).cast("long")
    failed = control_events(spark, root).filter("event = 'ERROR'").select(
        "batch", F.lit("ERROR").alias("state"), *[zero.alias(c) for c in done.columns[2:9]], "error", F.col("at").alias("finished_at"))
    return done.unionByName(failed)


# current tables ---------------------------------------------------------------
def current_versions(spark: SparkSession, root: str, columns: list[str], without: str | None = None) -> DataFrame:
    """``columns`` of the newest valid record of each ticket. The choice reads the ticket, its update time and the record's place."""
    r = records(spark, root, without).filter("is_valid")
    place = F.struct("source_updated_at", (-F.unix_micros(F.col("ingested_at").cast("timestamp"))).alias("age"), (-F.col("seq")).alias("back"))
    newest = r.groupBy("ticket_id").agg(F.max(place).alias("top"))
    if set(columns) <= {"ticket_id", "source_updated_at"}:
        return newest.select("ticket_id", F.col("top.source_updated_at").alias("source_updated_at")).select(*columns)
    keys = ["ticket_id", "source_updated_at", "age", "back"]
    at = r.withColumn("age", -F.unix_micros(F.col("ingested_at").cast("timestamp"))).withColumn("back", -F.col("seq"))
    wanted = list(dict.fromkeys([*keys, *columns]))
    return at.select(*wanted).join(newest.select("ticket_id", "top.*"), keys, "left_semi").select(*columns)


def current_customers(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """Each requester's first e-mail and latest name."""
    order = F.struct("ingested_at", "seq")
    per = records(spark, root, without).filter("is_valid").groupBy("external_requester_id").agg(
        F.min_by("requester_email", order).alias("requester_email"), F.max_by("requester_name", order).alias("requester_name"))
    return per.select(F.col("external_requester_id").alias("customer_id"), "external_requester_id", "requester_name", "requester_email")


def store_model(spark: SparkSession, root: str) -> TicketModel:
    """The ingested tables as a ``TicketModel`` (all analytics run on it)."""
    core = list(TICKET_CORE_COLUMNS)

    def versions(*columns: str) -> DataFrame:
        stored = [("external_requester_id" if c == "customer_id" else c) for c in columns]
        found = current_versions(spark, root, stored)
        return found.withColumnRenamed("external_requester_id", "customer_id") if "customer_id" in columns else found

    def tags() -> DataFrame:
        names = records(spark, root).filter("is_valid AND applied").select(F.explode("tags").alias("name")).distinct()
        return names.select(F.col("name").alias("tag_id"), "name")

    def rated_tickets(*more: str) -> DataFrame:
        return versions(*core, "rating", *more).select(
            *core, F.col("rating.score").alias("score"), F.col("rating.offered_at").alias("offered_at"),
            F.col("rating.rated_at").alias("rated_at"), F.col("rating.comment").alias("comment"), *more)

    return TicketModel(sources={
        "customers": lambda: current_customers(spark, root),
        "tickets": lambda: versions(*core),
        "ticket_text": lambda: versions("ticket_id", "subject", "description"),
        "ratings": lambda: versions("ticket_id", "rating").filter(F.col("rating").isNotNull()).select("ticket_id", "rating.*"),
        "tags": tags,
        "ticket_tags": lambda: versions("ticket_id", "tags").select("ticket_id", F.explode("tags").alias("tag_id")),
        "rated_tickets": rated_tickets,
        "full_tickets": lambda: rated_tickets("subject", "description"),
    }, tag_ids_are_names=True)


# I8 -------------------------------------------------------------------------
def _with_conflicts(validated: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Valid records whose identity conflicts become rejects that say so. The reasons are staged, so their size is known when the
    join is planned: the wide records cross no shuffle for a few of them."""
    pair = ["external_requester_id", "requester_email"]
    reasons = staged(conflicts.groupBy(*pair).agg(F.min("reason").alias("reason")), "reasons")
    joined = validated.join(reasons, pair, "left")
    bad = F.col("is_valid") & F.col("reason").isNotNull()
    errors = F.when(bad, F.array_append("errors", F.col("reason"))).otherwise(F.col("errors"))
    return joined.withColumn("errors", errors).withColumn("is_valid", ~bad & F.col("is_valid")).drop("reason")


def ingest_batch(spark: SparkSession, parsed: DataFrame, root: str, batch: int | str,
                 strict: bool = True, error_chars: int = 2000) -> dict:
    """Apply one batch of feed records (I1-I8, I11) and return its log row.

    ``strict`` follows the reference: any invalid record or identity conflict
    fails the whole batch. Otherwise such records are kept as rejects. The
    control table keeps ``error_chars`` characters of an error's text (X17)."""
    if not is_enabled(spark, root):
        raise IngestionDisabled("ingestion is switched off")
    batch = str(batch)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    validated = I.validate(parsed).persist()
    try:
        if strict:
            wrong = validated.filter(~F.col("is_valid")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.array_join("errors", "; "), "seq").alias("first")).first()
            if wrong.n:
                raise IngestionError(f"{wrong.n} invalid record(s): {wrong.first}")
        conflicts = I.identity_conflicts(validated.filter("is_valid"), current_customers(spark, root, without=batch))
        if strict:
            clash = conflicts.select("reason").first()
            if clash is not None:
                raise IngestionError(f"Requester identity conflict: {clash[0]}")
        kept = validated if strict else _with_conflicts(validated, conflicts)
        valid = kept.filter("is_valid")
        stored = current_versions(spark, root, ["ticket_id", "source_updated_at"], without=batch)
        flags = I.apply_flags(valid, stored).select("seq", "applied", "created", F.col("stored_updated_at").isNotNull().alias("known"))
        rows = kept.join(flags, "seq", "left").withColumn("ingested_at", F.lit(now)).withColumn("batch", F.lit(batch))
        for name in ("applied", "created", "known"):
            rows = rows.withColumn(name, F.coalesce(name, F.lit(False)))
        (rows.select(*[f.name for f in BATCH_RECORD.fields]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(f"{root}/records"))
    except Exception as exc:
        _note(spark, root, "ERROR", batch, (str(exc) or type(exc).__name__)[:error_chars])
        raise
    finally:
        validated.unpersist()
    row = ingest_log(spark, root).filter((F.col("batch") == batch) & (F.col("state") == "SUCCESS")).first()
    return row.asDict() if row else {"batch": batch, "state": "SUCCESS", "records": 0}


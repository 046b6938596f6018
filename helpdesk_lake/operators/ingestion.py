"""Ingestion operators (I1-I7, I10, J10, X6-X8, X17) as set-based Spark work.

The reference applies records one by one inside a transaction. Here a whole
batch is one DataFrame and the sequential rules are reproduced with order
columns (``seq`` = position of the record in the feed):

* I4 newest wins: a record applies iff its updated_at is strictly greater
  than both the stored version and every earlier record of the same ticket
  in the batch (ties keep the first) — a running maximum in slices.
* I2 customer name: the last name in feed order wins (``max_by``).
* I3 identity conflicts: an id seen with two e-mails or an e-mail with two
  ids, inside the batch or against stored customers (two equi joins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..constants import (
    EMAIL_MAX,
    EMAIL_MIN,
    COMMENT_MAX,
    NAME_MAX,
    PRIORITIES,
    SCORES,
    STATUSES,
    SUBJECT_MAX,
)
from ..functions import expressions as X
from ..session import staged


def _len_between(c: Column, low: int, high: int | None) -> Column:
    n = F.char_length(c)
    ok = c.isNotNull() & (n >= low)
    if high is not None:
        ok = ok & (n <= high)
    return ok


# I1 -------------------------------------------------------------------------
def validate(src: DataFrame) -> DataFrame:
    """Normalise every record and list its rule violations in ``errors``.

    Input: the source columns (strings for times) plus ``seq``; optional
    ``record_error`` / ``file_error`` columns from the reader are folded in.
    Two projections: times are parsed once, then every rule reads the
    parsed columns (parsing is the costly part)."""
    r = F.col("satisfaction_rating")
    extra = [c for c in ("record_error", "file_error") if c in src.columns]
    parsed = src.select(
        "seq", "ticket_id", "subject", "description", "requester_id", "requester_name",
        F.col("requester_email").alias("raw_email"), "assignee_id", "assignee_name",
        F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), X.strip_space).alias("tags"),
        F.upper("status").alias("status"),
        F.upper("priority").alias("priority"),
        F.col("first_response_at").alias("raw_first_response"),
        X.to_naive_utc("created_at").alias("created"),
        X.to_naive_utc("updated_at").alias("updated"),
        X.to_naive_utc("first_response_at").alias("first_resp"),
        r.isNotNull().alias("has_rating"),
        F.upper(r["score"]).alias("score"),
        r["offered_at"].alias("raw_offered"),
        r["rated_at"].alias("raw_rated"),
        X.to_naive_utc(r["offered_at"]).alias("offered"),
        X.to_naive_utc(r["rated_at"]).alias("rated"),
        F.coalesce(r["comment"], F.lit("")).alias("comment"),
        *extra,
    )
    c = F.col
    checks = [
        (c("ticket_id").isNull(), "ticket_id: required"),
        (~_len_between(c("subject"), 1, SUBJECT_MAX), "subject: length must be 1..500"),
        (~_len_between(c("description"), 1, None), "description: must not be empty"),
        (F.coalesce(~c("status").isin(*STATUSES), F.lit(True)), "status: invalid value"),
        (F.coalesce(~c("priority").isin(*PRIORITIES), F.lit(True)), "priority: invalid value"),
        (c("requester_id").isNull(), "requester_id: required"),
        (~_len_between(c("requester_name"), 1, NAME_MAX), "requester_name: length must be 1..255"),
        (~_len_between(c("raw_email"), EMAIL_MIN, EMAIL_MAX), "requester_email: length must be 3..255"),
        (c("assignee_name").isNotNull() & (F.char_length("assignee_name") > NAME_MAX),
         "assignee_name: at most 255 characters"),
        (c("created").isNull(), "created_at: invalid datetime"),
        (c("updated").isNull(), "updated_at: invalid datetime"),
        (c("raw_first_response").isNotNull() & c("first_resp").isNull(), "first_response_at: invalid datetime"),
        (c("has_rating") & F.coalesce(~c("score").isin(*SCORES), F.lit(True)),
         "satisfaction_rating.score: invalid value"),
        (c("has_rating") & (F.char_length("comment") > COMMENT_MAX), "satisfaction_rating.comment: at most 1000 characters"),
        (F.exists("tags", lambda t: F.char_length(t) > NAME_MAX), "tags: at most 255 characters each"),
        (c("has_rating") & c("raw_offered").isNotNull() & c("offered").isNull(),
         "satisfaction_rating.offered_at: invalid"),
        (c("has_rating") & c("raw_rated").isNotNull() & c("rated").isNull(), "satisfaction_rating.rated_at: invalid"),
    ]
    errors = F.array_remove(F.array(*[F.when(cond, F.lit(msg)).otherwise(F.lit("")) for cond, msg in checks],
                                    *[F.coalesce(c(e), F.lit("")) for e in extra]), "")
    rating = F.when(c("has_rating"), F.struct(
        c("score").alias("score"), c("offered").alias("offered_at"), c("rated").alias("rated_at"),
        c("comment").alias("comment")))
    return parsed.select(
        "seq", "ticket_id", "subject", "description", "status", "priority",
        c("requester_id").alias("external_requester_id"),
        "requester_name",
        F.lower(X.strip_space(c("raw_email"))).alias("requester_email"),
        c("assignee_id").alias("assignee_external_id"),
        "assignee_name",
        c("created").alias("source_created_at"),
        c("updated").alias("source_updated_at"),
        c("first_resp").alias("first_response_at"),
        X.distinct_tags("tags").alias("tags"),
        rating.alias("rating"),
        errors.alias("errors"),
    ).withColumn("is_valid", F.size("errors") == 0)


# I3 / J10 ---------------------------------------------------------------------
def identity_conflicts(valid: DataFrame, stored_customers: DataFrame | None = None) -> DataFrame:
    """Rows (external_requester_id, requester_email, reason) that break the
    one-id-one-email rule, inside the batch or against stored customers.

    Inside the batch: an id whose smallest and largest e-mail differ, or an
    e-mail whose smallest and largest id differ. Both are partial aggregates
    over the distinct pairs, so an id or e-mail that many records share is no
    hot group; the few that conflict are joined back.
    Against stored customers: two left equi joins — by id and by e-mail —
    never one OR-join."""
    obs = staged(valid.select("external_requester_id", "requester_email").distinct(), "identities")

    def torn(key: str, partner: str) -> DataFrame:
        ends = obs.groupBy(key).agg(F.min(partner).alias("_low"), F.max(partner).alias("_high"))
        return obs.join(ends.filter(F.col("_low") != F.col("_high")).select(key), key, "left_semi")

    inside = (torn("external_requester_id", "requester_email")
              .unionByName(torn("requester_email", "external_requester_id")).distinct()
              .withColumn("reason", F.lit("conflicting identity inside the batch")))
    if stored_customers is None:
        return inside
    by_id = stored_customers.select(F.col("external_requester_id").alias("_sid"),
                                    F.lower(X.strip_space("requester_email")).alias("_email_of_id"))
    by_email = stored_customers.select(F.lower(X.strip_space("requester_email")).alias("_semail"),
                                       F.col("external_requester_id").alias("_id_of_email"))
    j = (obs.join(by_id, obs["external_requester_id"] == by_id["_sid"], "left")
         .join(by_email, F.col("requester_email") == by_email["_semail"], "left"))
    clash = ((F.col("_email_of_id").isNotNull() & (F.col("_email_of_id") != F.col("requester_email")))
             | (F.col("_id_of_email").isNotNull() & (F.col("_id_of_email") != F.col("external_requester_id"))))
    against = j.filter(clash).select("external_requester_id", "requester_email",
                                     F.lit("identity conflicts with an existing customer").alias("reason"))
    return inside.unionByName(against)


# I2 -------------------------------------------------------------------------
def customer_upserts(valid: DataFrame, stored_customers: DataFrame | None = None) -> DataFrame:
    """One row per requester of the batch: identity, the last name in feed
    order (Q10: even when the ticket itself is unchanged), created flag."""
    per = valid.groupBy("external_requester_id").agg(
        F.min_by("requester_email", "seq").alias("requester_email"),
        F.max_by("requester_name", "seq").alias("requester_name"),
        F.max("seq").alias("seq"),
    )
    if stored_customers is None:
        return per.withColumn("created", F.lit(True))
    known = stored_customers.select("external_requester_id").distinct()
    flagged = per.join(known.withColumn("_known", F.lit(True)), "external_requester_id", "left")
    return flagged.withColumn("created", F.col("_known").isNull()).drop("_known")


# I4 -------------------------------------------------------------------------
#: Most slices of ``apply_flags``; two broadcast rows each.
SLICES = 20_000


def _stored_versions(versions: DataFrame | None, valid: DataFrame) -> DataFrame | None:
    """(ticket_id, stored_updated_at) of the stored tickets that the batch touches."""
    if versions is None:
        return None
    return (versions.join(valid.select("ticket_id").distinct(), "ticket_id", "left_semi")
            .groupBy("ticket_id").agg(F.max("source_updated_at").alias("stored_updated_at")))


def _with_stored(df: DataFrame, current: DataFrame | None) -> DataFrame:
    if current is None:
        return df.withColumn("stored_updated_at", F.lit(None).cast("timestamp_ntz"))
    return df.join(current, "ticket_id", "left")


def apply_flags(valid: DataFrame, stored_versions: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """(ticket_id, seq, source_updated_at, stored_updated_at, applied, created) of every valid record: the sequential
    newest-wins rule (ties keep the first) as a segmented running maximum.

    Only these narrow columns move. They are range-partitioned on (ticket,
    seq) and written once, so a ticket with a third of all records spans many
    slices. The maximum runs inside each (slice, ticket); what a slice's first
    ticket brings along from earlier slices is the running maximum over one
    row per slice and border ticket (at most ``SLICES`` times two, broadcast)."""
    spark = valid.sparkSession
    n = min(SLICES, slices or int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["ticket_id", "seq"]
    ranged = valid.select(*keys, "source_updated_at").repartitionByRange(n, *keys).withColumn("slice", F.spark_partition_id())
    ranged = staged(ranged, "flags")
    earlier = Window.partitionBy("slice", "ticket_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("before", F.max("source_updated_at").over(earlier))
    ends = ranged.groupBy("slice").agg(F.min("ticket_id").alias("low"), F.max(F.struct("ticket_id", "source_updated_at")).alias("high"))
    borders = (ends.select("slice", F.inline(F.array(
        F.struct(F.col("low").alias("ticket_id"), F.lit(None).cast("timestamp_ntz").alias("top")),
        F.struct(F.col("high.ticket_id").alias("ticket_id"), F.col("high.source_updated_at").alias("top")))))
        .groupBy("ticket_id", "slice").agg(F.max("top").alias("top")))
    passed = Window.partitionBy("ticket_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.withColumn("carried", F.max("top").over(passed)).filter(F.col("carried").isNotNull()).drop("top")
    df = _with_stored(local.join(F.broadcast(carried), ["slice", "ticket_id"], "left"), _stored_versions(stored_versions, ranged))
    in_batch = F.greatest("before", "carried")
    bar = F.greatest("stored_updated_at", in_batch)
    return df.select(*keys, "source_updated_at", "stored_updated_at",
                     F.coalesce(F.col("source_updated_at") > bar, F.lit(True)).alias("applied"),
                     (in_batch.isNull() & F.col("stored_updated_at").isNull()).alias("created"))


def latest_versions(valid: DataFrame, stored_versions: DataFrame | None = None) -> DataFrame:
    """Final state per changed ticket: its last applied record, which is the
    first of its newest ones, if newer than the stored version. Winners are one
    partial aggregate over (ticket, updated, seq); the full record is joined
    for them only."""
    newest = (valid.select("ticket_id", "seq", "source_updated_at").groupBy("ticket_id")
              .agg(F.max(F.struct("source_updated_at", (-F.col("seq")).alias("back"))).alias("top")))
    won = _with_stored(newest, _stored_versions(stored_versions, newest))
    won = won.filter(F.coalesce(F.col("top.source_updated_at") > F.col("stored_updated_at"), F.lit(True)))
    won = won.select("ticket_id", (-F.col("top.back")).alias("seq"))
    return valid.drop("errors", "is_valid").join(won, ["ticket_id", "seq"], "left_semi")


# I5 -------------------------------------------------------------------------
def new_tags(valid: DataFrame, flags: DataFrame, stored_tags: DataFrame | None = None) -> DataFrame:
    """Distinct tag names of applied records not known yet (a version that is
    applied and later superseded in the same batch still creates its tags)."""
    applied = valid.select("ticket_id", "seq", "tags").join(flags.filter("applied"), ["ticket_id", "seq"], "left_semi")
    names = applied.select(F.explode("tags").alias("name")).distinct()  # the names are normalised already
    if stored_tags is not None:
        names = names.join(stored_tags.select("name"), "name", "left_anti")
    return names


# I6 -------------------------------------------------------------------------
def replaced_links(latest: DataFrame, stored_links: DataFrame | None = None) -> DataFrame:
    """Links after the batch: stored links of untouched tickets plus the
    final tag set of every changed ticket."""
    fresh = latest.select("ticket_id", F.explode("tags").alias("tag_id"))
    if stored_links is None:
        return fresh
    kept = stored_links.join(latest.select("ticket_id"), "ticket_id", "left_anti")
    return kept.select("ticket_id", "tag_id").unionByName(fresh)


# I7 -------------------------------------------------------------------------
def synced_ratings(latest: DataFrame, stored_ratings: DataFrame | None = None) -> DataFrame:
    """Ratings after the batch: a changed ticket takes its final version's
    rating, or loses its rating when the version has none."""
    fresh = latest.filter(F.col("rating").isNotNull()).select("ticket_id", "rating.*")
    if stored_ratings is None:
        return fresh
    kept = stored_ratings.join(latest.select("ticket_id"), "ticket_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


# I10 ------------------------------------------------------------------------
def batch_checks(records: DataFrame, expected_count, customer_pool: tuple[int, int] | None = None,
                 year: int | None = None) -> DataFrame:
    """One aggregation over the batch, returned as one row per check:
    (check, passed, observed)."""
    aggs = [
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("ticket_id").alias("distinct_tickets"),
        F.count_distinct(F.lower(X.strip_space("requester_email"))).alias("distinct_customers"),
        F.count_distinct(F.upper("status")).alias("distinct_statuses"),
        F.count_distinct(F.upper("priority")).alias("distinct_priorities"),
        F.sum(X.flag(~F.upper("status").isin(*STATUSES))).alias("foreign_statuses"),
        F.sum(X.flag(~F.upper("priority").isin(*PRIORITIES))).alias("foreign_priorities"),
    ]
    if customer_pool is not None:
        lo, hi = customer_pool
        aggs.append(F.sum(X.flag((F.col("requester_id") < lo) | (F.col("requester_id") >= hi)))
                    .alias("outside_pool"))
    if year is not None:
        years = [F.year(X.to_naive_utc(c)) for c in ("created_at", "updated_at", "first_response_at")]
        outside = F.lit(False)
        for y in years:
            outside = outside | F.coalesce(y != year, F.lit(False))
        aggs.append(F.sum(X.flag(outside)).alias("outside_year"))
    row = records.agg(*aggs)
    checks = [
        ("exact_count", F.col("records") == expected_count, F.col("records")),
        ("unique_ticket_ids", F.col("distinct_tickets") == expected_count, F.col("distinct_tickets")),
        ("distinct_customers", F.col("distinct_customers") == expected_count, F.col("distinct_customers")),
        ("all_statuses", (F.col("distinct_statuses") == len(STATUSES)) & (F.col("foreign_statuses") == 0),
         F.col("distinct_statuses")),
        ("all_priorities", (F.col("distinct_priorities") == len(PRIORITIES)) & (F.col("foreign_priorities") == 0),
         F.col("distinct_priorities")),
    ]
    if customer_pool is not None:
        checks.append(("customers_in_pool", F.col("outside_pool") == 0, F.col("outside_pool")))
    if year is not None:
        checks.append(("timestamps_in_year", F.col("outside_year") == 0, F.col("outside_year")))
    entries = F.array(*[F.struct(F.lit(name).alias("check"), cond.alias("passed"),
                                 obs.cast("long").alias("observed")) for name, cond, obs in checks])
    return row.select(F.inline(entries))

"""Map the driver's TPC-H-like tables onto the help-desk model.

One order is one ticket (k = o_orderkey); one TPC-H customer is one requester;
the order's first line (by l_linenumber, l_partkey, l_suppkey, l_returnflag)
gives the subject part and the satisfaction score; the brands of an order's
parts are its tags; the description is a whole document text.

Every frame is built from the given tables only, so its work grows with them.
Joins are left to the planner (AQE turns a join into a broadcast only when the
runtime size is under the threshold), except the scalar document count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TicketModel
from ..session import spread

# --- fixed values: fixture mapping constants ------------------------------
CREATED_MULTIPLIER = 7919          # created = orderdate + (k * 7919) % 86400 s
RESPONSE_MULTIPLIER = 104729       # first response = created + (k * 104729) % 21600 s
RESPONSE_SPREAD_SECONDS = 21600
NO_RESPONSE_MODULUS = 7            # k % 7 == 0  -> no first response
EARLY_RESPONSE_MODULUS = 13        # k % 13 == 0 -> response one hour before creation
ASSIGNEE_MODULUS = 11              # k % 11 == 0 -> unassigned
ASSIGNEE_BASE = 9100
ASSIGNEE_PREFIX = "Agent "
EMAIL_DOMAIN = "@example.com"
NO_LINES_SUBJECT = "no lines"

#: Documents are sent to rows that are to be sorted in up to BROADCASTS pieces of about so many bytes of text; the rows stay where they lie.
BROADCAST_BYTES, BROADCASTS = 64 << 20, 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _created(k):
    return F.timestamp_add("SECOND", (k * CREATED_MULTIPLIER) % 86400, F.col("o_orderdate"))


def map_status(k, order_status):
    even = (k % 2) == 0
    return (F.when(order_status == "F", F.when(even, "SOLVED").otherwise("CLOSED"))
            .when(order_status == "O", F.when(even, "NEW").otherwise("OPEN"))
            .when(order_status == "P", F.when(even, "PENDING").otherwise("HOLD")))


def map_priority(order_priority):
    return (F.when(order_priority == "1-URGENT", "URGENT")
            .when(order_priority == "2-HIGH", "HIGH")
            .when(order_priority == "5-LOW", "LOW")
            .otherwise("NORMAL"))


def map_score(k, return_flag):
    even = (k % 2) == 0
    return (F.when(return_flag == "A", "GOOD")
            .when(return_flag == "R", "BAD")
            .when(return_flag == "N", F.when(even, "OFFERED").otherwise("UNOFFERED")))


def tickets_from_orders(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Narrow projection of orders: no join, no shuffle. ``keep`` carries
    extra order columns through."""
    k = F.col("o_orderkey")
    created = _created(k)
    assignee = F.when(k % ASSIGNEE_MODULUS != 0, F.lit(ASSIGNEE_BASE) + k % ASSIGNEE_MODULUS)
    first_response = (
        F.when(k % NO_RESPONSE_MODULUS == 0, F.lit(None))
        .when(k % EARLY_RESPONSE_MODULUS == 0, F.timestamp_add("HOUR", F.lit(-1), created))
        .otherwise(F.timestamp_add("SECOND", (k * RESPONSE_MULTIPLIER) % RESPONSE_SPREAD_SECONDS, created))
    )
    return orders.select(
        k.alias("ticket_id"),
        F.col("o_custkey").alias("customer_id"),
        map_status(k, F.col("o_orderstatus")).alias("status"),
        map_priority(F.col("o_orderpriority")).alias("priority"),
        assignee.cast("long").alias("assignee_external_id"),
        F.concat(F.lit(ASSIGNEE_PREFIX), assignee.cast("string")).alias("assignee_name"),
        created.alias("source_created_at"),
        F.timestamp_add("HOUR", F.lit(1), created).alias("source_updated_at"),
        first_response.alias("first_response_at"),
        *keep,
    )


def first_lines(lineitem: DataFrame) -> DataFrame:
    """One row per order: its first line. Partial aggregation keeps the
    shuffle at one row per order per map task."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("fl")
    return (lineitem.groupBy("l_orderkey").agg(first)
            .select(F.col("l_orderkey").alias("ticket_id"),
                    F.col("fl.l_partkey").alias("first_partkey"),
                    F.col("fl.l_returnflag").alias("first_returnflag")))


def rating_columns(k, created, return_flag):
    """Rating columns of a ticket from its first line's return flag."""
    score = map_score(k, return_flag)
    rated = score.isin("GOOD", "BAD")
    has = return_flag.isNotNull()
    return [
        score.alias("score"),
        F.when(has, F.timestamp_add("MINUTE", F.lit(5), created)).alias("offered_at"),
        F.when(has & rated, F.timestamp_add("MINUTE", F.lit(45), created)).alias("rated_at"),
        F.when(has, F.lit("")).alias("comment"),
    ]


def fixture_model(spark: SparkSession, sf_dir: str) -> TicketModel:
    """Build the lazily-evaluated model over the driver's tables."""

    def orders() -> DataFrame:
        return spread(read_table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), "o_orderkey")

    def lineitem() -> DataFrame:
        return spread(read_table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"), "l_orderkey")

    def part() -> DataFrame:
        return read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")

    def customers() -> DataFrame:
        c = read_table(spark, sf_dir, "customer")
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("external_requester_id"),
            F.col("c_name").alias("requester_name"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                     F.lit(EMAIL_DOMAIN)).alias("requester_email"),
        )

    def tickets() -> DataFrame:
        return tickets_from_orders(orders())

    def rated_tickets() -> DataFrame:
        t = tickets()
        fl = first_lines(lineitem()).select("ticket_id", "first_returnflag")
        joined = t.join(fl, "ticket_id", "left")
        return joined.select(
            *[F.col(c) for c in t.columns],
            *rating_columns(F.col("ticket_id"), F.col("source_created_at"), F.col("first_returnflag")),
        )

    def ratings() -> DataFrame:
        o = orders().select(F.col("o_orderkey").alias("ticket_id"), _created(F.col("o_orderkey")).alias("created"))
        fl = first_lines(lineitem()).select("ticket_id", "first_returnflag")
        return o.join(fl, "ticket_id", "inner").select(
            "ticket_id", *rating_columns(F.col("ticket_id"), F.col("created"), F.col("first_returnflag")))

    def rating_scores() -> DataFrame:
        fl = first_lines(lineitem())
        return fl.select("ticket_id", map_score(F.col("ticket_id"), F.col("first_returnflag")).alias("score"))

    def documents_by_slot() -> DataFrame:
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
        return docs

    def text_frame(base: DataFrame, k_col: str = "ticket_id", with_description: bool = True,
                   ranges: str | None = None) -> DataFrame:
        """Attach subject (first line's part) and description (a whole document).
        With ``ranges``, the rows are dealt out and sorted by that column while
        they are narrow, if the documents can be broadcast; the joins keep that order."""
        fl = first_lines(lineitem())
        p = part().select("p_partkey",
                          F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("part_subject"))
        with_line = base.join(fl, k_col, "left")
        with_part = with_line.join(p, with_line["first_partkey"] == p["p_partkey"], "left")
        if not with_description:
            return with_part.withColumn("subject", F.coalesce(F.col("part_subject"), F.lit(NO_LINES_SUBJECT)))
        docs = documents_by_slot()
        n_docs = docs.select(F.count(F.lit(1))).scalar()
        # an empty documents table gives no slot (ANSI mode would fail on % 0)
        slotted = with_part.withColumn("doc_slot", F.when(n_docs > 0, F.col(k_col) % n_docs))
        size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) if ranges else None
        if ranges and size <= BROADCASTS * BROADCAST_BYTES:
            # a number of its own: else AQE would join ranges by the size of the narrow rows
            rows = slotted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges).sortWithinPartitions(ranges)
            # always true, but to the optimizer it might not be, which would drop the sort below the joins and leave one of whole texts
            rows = rows.where(F.spark_partition_id() >= 0)
            pieces = max(1, -(-size // max(BROADCAST_BYTES, 1)))
            for k in range(pieces):  # all documents of an id are in one piece
                piece = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(pieces)) == k) if pieces > 1 else docs
                rows = rows.join(F.broadcast(piece.toDF(f"doc_id_{k}", f"text_{k}")), F.col("doc_slot") == F.col(f"doc_id_{k}"), "left")
            with_doc = rows.withColumn("text", F.coalesce(*[f"text_{k}" for k in range(pieces)]))
        else:
            with_doc = slotted.join(docs, slotted["doc_slot"] == docs["doc_id"], "left")
        return with_doc.withColumn(
            "subject", F.coalesce(F.col("part_subject"), F.lit(NO_LINES_SUBJECT))
        ).withColumn("description", F.col("text"))

    def attach_text(frame: DataFrame, columns=("subject", "description"), ranges: str | None = None) -> DataFrame:
        cols = [c for c in frame.columns]
        framed = text_frame(frame, with_description="description" in columns, ranges=ranges)
        return framed.select(*[F.col(c) for c in cols], *columns)

    def ticket_text() -> DataFrame:
        ids = orders().select(F.col("o_orderkey").alias("ticket_id"))
        return text_frame(ids).select("ticket_id", "subject", "description")

    def full_tickets() -> DataFrame:
        t = tickets()
        framed = text_frame(t)
        return framed.select(
            *[F.col(c) for c in t.columns],
            *rating_columns(F.col("ticket_id"), F.col("source_created_at"), F.col("first_returnflag")),
            "subject", "description",
        )

    def tags() -> DataFrame:
        names = read_table(spark, sf_dir, "part").select(F.lower(F.col("p_brand")).alias("name")).distinct()
        return names.select(F.col("name").alias("tag_id"), "name")

    def ticket_tags() -> DataFrame:
        li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        p = read_table(spark, sf_dir, "part").select("p_partkey", F.lower(F.col("p_brand")).alias("tag_id"))
        return (li.join(p, li["l_partkey"] == p["p_partkey"], "inner")
                .select(F.col("l_orderkey").alias("ticket_id"), "tag_id").distinct())

    def links_for(tickets: DataFrame) -> DataFrame:
        # restrict lineitem to the given tickets first (a semi join against a
        # small key set), then join part and de-duplicate only those lines
        ids = tickets.select(F.col("ticket_id").alias("l_orderkey")).distinct()
        li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(
            ids, "l_orderkey", "left_semi")
        p = read_table(spark, sf_dir, "part").select("p_partkey", F.lower(F.col("p_brand")).alias("tag_id"))
        return (li.join(p, li["l_partkey"] == p["p_partkey"], "inner")
                .select(F.col("l_orderkey").alias("ticket_id"), "tag_id").distinct()
                .withColumn("tag", F.col("tag_id")))

    return TicketModel(sources={
        "customers": customers,
        "tickets": tickets,
        "rated_tickets": rated_tickets,
        "ratings": ratings,
        "rating_scores": rating_scores,
        "ticket_text": ticket_text,
        "full_tickets": full_tickets,
        "attach_text": attach_text,
        "links_for": links_for,
        "tags": tags,
        "ticket_tags": ticket_tags,
    }, tag_ids_are_names=True)

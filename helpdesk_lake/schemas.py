"""Explicit schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

# Source record as it arrives in JSON. Times stay text until validated (a
# zoned ISO string declared as timestamp_ntz would silently become null).
RATING_SOURCE = T.StructType([
    T.StructField("score", T.StringType()),
    T.StructField("offered_at", T.StringType()),
    T.StructField("rated_at", T.StringType()),
    T.StructField("comment", T.StringType()),
])

TICKET_SOURCE = T.StructType([
    T.StructField("ticket_id", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("requester_id", T.LongType()),
    T.StructField("requester_name", T.StringType()),
    T.StructField("requester_email", T.StringType()),
    T.StructField("assignee_id", T.LongType()),
    T.StructField("assignee_name", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("first_response_at", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("satisfaction_rating", RATING_SOURCE),
])

# Normalised (validated) record.
RATING = T.StructType([
    T.StructField("score", T.StringType()),
    T.StructField("offered_at", T.TimestampNTZType()),
    T.StructField("rated_at", T.TimestampNTZType()),
    T.StructField("comment", T.StringType()),
])

# One record of an ingested batch.
BATCH_RECORD = T.StructType([
    T.StructField("ticket_id", T.LongType()),
    T.StructField("external_requester_id", T.LongType()),
    T.StructField("requester_name", T.StringType()),
    T.StructField("requester_email", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("assignee_external_id", T.LongType()),
    T.StructField("assignee_name", T.StringType()),
    T.StructField("source_created_at", T.TimestampNTZType()),
    T.StructField("source_updated_at", T.TimestampNTZType()),
    T.StructField("first_response_at", T.TimestampNTZType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("rating", RATING),
    T.StructField("seq", T.LongType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("applied", T.BooleanType()),
    T.StructField("created", T.BooleanType()),
    T.StructField("known", T.BooleanType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("batch", T.StringType()),
])

CONTROL_EVENT = T.StructType([
    T.StructField("at", T.TimestampNTZType()),
    T.StructField("event", T.StringType()),
    T.StructField("batch", T.StringType()),
    T.StructField("error", T.StringType()),
])

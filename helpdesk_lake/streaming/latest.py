"""§2.13: the newest version of each key of a stream, whatever is repeated, late or out of order.

The rule is I4's: a version counts if it is newer than all before; of equally
new ones the first (by ``seq``) stays. As a maximum over (updated, -seq) it does
not depend on the order of arrival, a repeated row changes nothing, and a late
one is never dropped by a watermark. It runs as a streaming aggregation: state
is one row a key in the state store, rows of a hot key are combined before
the shuffle, and a restart goes on from the checkpoint. Each micro-batch writes
the keys that changed to a partition of its own (dynamic overwrite, so a
repeated micro-batch replaces it); ``latest`` reads the newest change per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def newest(rows: DataFrame, key: str, updated: str, seq: str, columns: list[str]) -> DataFrame:
    """(key, updated, seq, columns) of each key's newest row; rows without key, time or seq count for nothing."""
    usable = rows.filter(F.col(key).isNotNull() & F.col(updated).isNotNull() & F.col(seq).isNotNull())
    place = F.struct(F.col(updated), (-F.col(seq)).alias("back"))
    best = usable.groupBy(key).agg(F.max_by(F.struct(updated, seq, *columns), place).alias("best"))
    return best.select(key, "best.*")


def start_latest(stream: DataFrame, path: str, checkpoint: str, key: str, updated: str, seq: str, columns: list[str],
                 available_now: bool = True, processing_time: str = "30 seconds") -> StreamingQuery:
    """Keep the newest rows of ``stream`` in ``path`` (shared storage, like the checkpoint)."""
    def put(changed: DataFrame, batch_id: int) -> None:
        (changed.withColumn("micro_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("micro_batch").parquet(path))

    writer = newest(stream, key, updated, seq, columns).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def latest(spark: SparkSession, path: str, schema: str, key: str, updated: str, seq: str, columns: list[str]) -> DataFrame:
    """The current rows: the newest change of each key. ``schema`` names all of them; no change yet gives no rows."""
    spark.createDataFrame([], schema + ", micro_batch long").write.mode("ignore").partitionBy("micro_batch").parquet(path)
    return newest(spark.read.schema(schema).parquet(path), key, updated, seq, columns)

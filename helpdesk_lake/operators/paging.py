"""Order statistics of a frame: places in a total order, and offset pages by them.

The rows are range-partitioned on the order, sorted inside each slice and
written once with their number in the slice. Counts per slice (one small row
each) give the total and the place where any page starts, so a page, however
far, reads only the slices that it lies in, by row numbers: no offset is
skipped in one task, and nothing is sorted again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Most slices; one count each reaches the driver.
SLICES = 20_000


class OrderedRows:
    """``df`` in the order of ``keys`` (columns of a total order), in shared storage."""

    def __init__(self, df: DataFrame, keys: list[Column], slices: int | None = None) -> None:
        spark = df.sparkSession
        n = min(SLICES, slices or int(spark.conf.get("spark.sql.shuffle.partitions")))
        path = scratch_path(spark, f"ordered-{uuid.uuid4().hex}")
        # the high bits of the id number the slice, the low ones the rows in it
        placed = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
                  .withColumn("_slice", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))
        placed.write.partitionBy("_slice").parquet(path)
        self.columns = df.columns
        self.rows = spark.read.schema(placed.schema).parquet(path)
        self.counts = [(r["_slice"], r["count"]) for r in self.rows.groupBy("_slice").count().orderBy("_slice").collect()]
        self.total = sum(c for _, c in self.counts)

    def between(self, start: int, stop: int) -> DataFrame:
        """The rows at places ``start`` to ``stop`` (exclusive), with their place from 0 as ``place``."""
        wanted, first, before = F.lit(False), F.lit(0).cast("long"), 0
        for s, count in self.counts:
            if before < stop and start < before + count:
                inside = (F.col("_slice") == s) & (F.col("_row") >= start - before) & (F.col("_row") < stop - before)
                wanted, first = wanted | inside, F.when(F.col("_slice") == s, F.lit(before)).otherwise(first)
            before += count
        return self.rows.filter(wanted).select(*self.columns, (first + F.col("_row")).alias("place"))


def offset_page(df: DataFrame, keys: list[Column], page: int, page_size: int) -> tuple[DataFrame, int]:
    """(rows of the page, total); pages count from 1."""
    ordered = OrderedRows(df, keys)
    start = (page - 1) * page_size
    return ordered.between(start, start + page_size), ordered.total

"""Ticket feed files through Spark's JSON source.

``read_feed`` takes files that hold one JSON array of nested records each
(multi-line mode; such a file can't be split, but its records are rows from
the start). ``read_feed_lines`` takes one record a line, which Spark splits into
blocks. Both read every field as text, so a value of a wrong type spoils its
record only; the nested parts and the numbers are parsed from that text, and
what fails is listed in ``record_error``. A file that is no array, or whose record
count differs from ``expected_count``, carries ``file_error`` on all its rows, and on
one row of its own if it has none. An array that the JSON source refuses (an
element is no object) is split into its elements as a text; those files are
exceptions, and only they are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TICKET_SOURCE
from ..session import apply_missing

CORRUPT = "_corrupt_record"
#: seq = number of the file among the names in order, times this, plus the place in the file.
SEQ_FILE_SHIFT = 1 << 40
TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType()) for f in TICKET_SOURCE.fields] + [T.StructField(CORRUPT, T.StringType())])


def _typed(field: T.StructField) -> Column:
    text = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return text
    if isinstance(field.dataType, T.LongType):
        return text.try_cast("long")
    return F.when(text.startswith("{" if isinstance(field.dataType, T.StructType) else "["), F.from_json(text, field.dataType))


def _records(placed: DataFrame, pos: Column, file_error: Column, record_error: Column | None = None) -> DataFrame:
    """``placed``: text columns, source_file and file_rank."""
    fields = TICKET_SOURCE.fields
    wrong = F.array_compact(F.array(*[F.when(F.col(f.name).isNotNull() & _typed(f).isNull(), F.lit(f.name))
                                      for f in fields if not isinstance(f.dataType, T.StringType)]))
    mistyped = F.when(F.size(wrong) > 0, F.concat(F.lit("malformed record: "), F.array_join(wrong, ", ")))
    return placed.select(
        "source_file", pos.alias("pos"), (F.col("file_rank") * SEQ_FILE_SHIFT + pos).alias("seq"), *[_typed(f).alias(f.name) for f in fields],
        (mistyped if record_error is None else F.coalesce(record_error, mistyped)).alias("record_error"), file_error.alias("file_error"))


def _numbered_files(rows: DataFrame) -> list:
    """(source_file, first, n, broken) of the files, whose list the driver holds anyway. The ids are read so that every record is
    really parsed."""
    return rows.groupBy("source_file").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"), F.max("ticket_id"),
                                           F.max(F.col(CORRUPT).isNotNull()).alias("broken")).collect()


def _openers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first character of each file that is no white space ('' where there is none)."""
    every = {r[0]: "" for r in spark.read.format("binaryFile").load(paths).select("_metadata.file_path").collect()}  # a listing: no content is read
    lines = (spark.read.text(paths).filter(F.trim("value") != "")
             .select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))
             .withColumn("row", F.monotonically_increasing_id()))
    found = lines.groupBy("source_file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("block", "row")).alias("c")).collect()
    return every | {r.source_file: r.c for r in found}


def read_feed(spark: SparkSession, paths: str | list[str], expected_count: int | None = None) -> DataFrame:
    """Batch read of array files (files, folders or globs)."""
    # by default Spark fetches each number, array and object that is read as text by a read of its own at its place in the file;
    # without it they come from the parser (a fraction as its shortest numeral)
    apply_missing(spark, {"spark.sql.json.enableExactStringParsing": "false"})
    paths = [paths] if isinstance(paths, str) else list(paths)
    openers = _openers(spark, paths)
    rank = {name: k for k, name in enumerate(sorted(openers))}
    raw = spark.read.schema(TEXT_SCHEMA).option("multiLine", True).json(paths)
    rows = raw.select("*", F.col("_metadata.file_path").alias("source_file")).withColumn("row", F.monotonically_increasing_id())
    stats = {r.source_file: r for r in _numbered_files(rows)}
    arrays = {name for name, c in openers.items() if c == "["}
    whole = [(name, rank[name], r.first, r.n) for name, r in stats.items() if name in arrays and not r.broken]
    table = spark.createDataFrame(whole, "source_file string, file_rank long, first long, n long")
    # a file lies in one partition, so row numbers rise through it without gaps
    counted = lambda n: F.when(n != expected_count, F.lit(f"file must contain exactly {expected_count} records"))
    none = F.lit(None).cast("string")
    placed = rows.join(F.broadcast(table), "source_file")
    out = _records(placed, F.col("row") - F.col("first") + 1, none if expected_count is None else counted(F.col("n")))
    broken = [name for name, r in stats.items() if name in arrays and r.broken]
    if broken:
        out = out.unionByName(_split_arrays(spark, broken, rank, none if expected_count is None else counted(F.col("n"))))
    bare = [(name, rank[name], "file is not a JSON array") for name in openers if name not in arrays]
    if expected_count:
        bare += [(name, rank[name], f"file must contain exactly {expected_count} records") for name in arrays if name not in stats]
    if bare:
        errors = spark.createDataFrame(bare, "source_file string, file_rank long, error string")
        for f in TEXT_SCHEMA.fields:
            errors = errors.withColumn(f.name, none)
        out = out.unionByName(_records(errors, F.lit(0).cast("long"), F.col("error")))
    return out


def _split_arrays(spark: SparkSession, files: list[str], rank: dict[str, int], file_error: Column) -> DataFrame:
    """The elements of array files as texts, each parsed by itself; a file that is no JSON at all keeps one row with its error."""
    table = spark.createDataFrame([(f, rank[f]) for f in files], "source_file string, file_rank long")
    texts = spark.read.option("wholetext", True).text(files).select("value", F.col("_metadata.file_path").alias("source_file")).join(F.broadcast(table), "source_file")
    items = texts.select("source_file", "file_rank", F.from_json("value", "array<string>").alias("items"))
    each = items.select("source_file", "file_rank", F.size("items").alias("n"), F.col("items").isNull().alias("unread"), F.posexplode_outer("items").alias("k", "raw"))
    read = each.select("*", F.from_json("raw", TEXT_SCHEMA, {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("*", "r.*")
    malformed = F.when(F.col("raw").isNotNull() & (F.col(CORRUPT).isNotNull() | ~F.ltrim("raw").startswith("{")), F.lit("malformed record"))
    error = F.when(F.col("unread"), F.lit("file is not a JSON array")).otherwise(file_error)
    return _records(read, F.coalesce("k", F.lit(-1)).cast("long") + 1, error, malformed)


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of line-delimited files, in blocks of any number; a broken line is a ``record_error`` of its own."""
    raw = spark.read.schema(TEXT_SCHEMA).json(path)
    rows = (raw.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))
            .withColumn("row", F.monotonically_increasing_id()))
    starts = rows.groupBy("source_file", "block").agg(F.min("row").alias("block_first"), F.max("ticket_id").alias("_id")).drop("_id")
    files = sorted(r.source_file for r in _numbered_files(rows))
    table = spark.createDataFrame([(name, k) for k, name in enumerate(files)], "source_file string, file_rank long")
    placed = rows.join(F.broadcast(table), "source_file").join(starts, ["source_file", "block"])
    # a record takes two bytes at least, so the block's start plus the row within the block rises through the file
    pos = F.col("block") + F.col("row") - F.col("block_first") + 1
    return _records(placed, pos, F.lit(None).cast("string"), F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed record: not JSON")))


#: Spark's JSON source holds the records of an array file together, so a file gets no more than about this many.
FILE_RECORDS = 50_000


def write_feed(records: DataFrame, path: str, files: int) -> None:
    """Source-shaped records as array files through Spark's text sink, in order of ``seq``: ``files`` at most, but more where a file
    would hold over ``FILE_RECORDS``."""
    files = max(files, -(-records.count() // FILE_RECORDS))
    body = F.to_json(F.struct(*[f.name for f in TICKET_SOURCE.fields]), {"ignoreNullFields": "false"})
    lines = records.repartitionByRange(files, "seq").sortWithinPartitions("seq").select(body.alias("value"))
    lines.mapInArrow(_as_array, "value string").write.mode("overwrite").text(path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition as those of one array; none for an empty partition."""
    mark = "["
    for b in batches:
        if b.num_rows:
            lines = pc.binary_join_element_wise(pa.array([mark] + [","] * (b.num_rows - 1)), b.column(0), "")
            yield pa.RecordBatch.from_arrays([lines], ["value"])
            mark = ","
    if mark == ",":
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

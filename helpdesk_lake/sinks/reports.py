"""Report sinks (S4 CSV, S5 XLSX, S6 JSON snapshot).

All writers are Spark's own file sinks, so they reach every file system that
Spark does, and a failed or repeated task leaves nothing behind. They have
written when they return; no report passes through the driver.
"""

from __future__ import annotations

import io
import re
import string
import uuid
import zipfile
from datetime import datetime, timezone
from itertools import chain, islice, product
from typing import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_SHEET_NAME
from ..operators.exports import report_cells
from ..session import staged


# S4 -------------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with header and RFC quoting (embedded quotes doubled, fields with
    separators, quotes or newlines quoted, outer spaces kept), a byte order
    mark in front and rows ended by CR LF. Cells are rendered first (X12), so
    nulls are '' and nested values JSON."""
    cols = columns or df.columns
    if not cols:
        raise ValueError("no columns to write")
    cells = report_cells(df.select(*cols))
    cells = cells.withColumnRenamed(cols[0], "\ufeff" + cols[0])
    (cells.write.mode(mode).option("lineSep", "\r\n")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", "UTF-8")
     .csv(path))


# S5 -------------------------------------------------------------------------
#: Rows that a worksheet of the file format can hold, its header included.
SHEET_ROWS = 1_048_576
SHEET_NAME_CHARS = 31

# --- fixed values: the parts that the package format demands of any one-sheet workbook
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
OPEN_XML, MAIN = "http://schemas.openxmlformats.org", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = {
    "[Content_Types].xml": f'{XML}<Types xmlns="{OPEN_XML}/package/2006/content-types">'
                           '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                           '<Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                           '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>',
    "_rels/.rels": f'{XML}<Relationships xmlns="{OPEN_XML}/package/2006/relationships"><Relationship Id="book" '
                   f'Type="{OPEN_XML}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'{XML}<Relationships xmlns="{OPEN_XML}/package/2006/relationships"><Relationship Id="sheet" '
                                  f'Type="{OPEN_XML}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def sheet_title(name: str, chars: int = SHEET_NAME_CHARS) -> str:
    """A legal sheet name: the format's seven forbidden characters become '_', at most ``chars`` characters."""
    return re.sub(r"[][:*?/\\]", "_", name).strip()[:chars] or DEFAULT_SHEET_NAME


def _cell(text: Column) -> Column:
    """One inline-string cell; rows and cells need no references, they count in order."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One column ``row``: the XML of each row, made by Spark."""
    return cells.select(F.concat(F.lit("<row>"), *[_cell(F.col(f"`{c}`")) for c in cells.columns], F.lit("</row>")).alias("row"))


#: The archive's end record announces a comment of one byte: the line end that the text sink adds.
COMMENT = b"\n"


def workbook(header: str, rows: Iterator[str], width: int, sheet: str) -> tuple[bytes, int]:
    """One workbook around ready row XML, without the last byte of its archive comment, and its data rows; the header gets a filter."""
    count, held = 0, io.BytesIO()
    with zipfile.ZipFile(held, "w", compression=zipfile.ZIP_DEFLATED) as book:
        for name, text in PACKAGE.items():
            book.writestr(name, text)
        book.writestr("xl/workbook.xml", f'{XML}<workbook xmlns="{MAIN}" xmlns:r="{OPEN_XML}/officeDocument/2006/relationships"><sheets>'
                                         f'<sheet name={quoteattr(sheet_title(sheet))} sheetId="1" r:id="sheet"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'{XML}<worksheet xmlns="{MAIN}"><sheetData>{header}'.encode())
            for row in rows:
                out.write(row.encode())
                count += 1
            out.write(f'</sheetData><autoFilter ref="A1:{last_column(width)}1"/></worksheet>'.encode())
        book.comment = COMMENT
    return held.getvalue()[:-len(COMMENT)], count


def last_column(width: int) -> str:
    """Letters of the last of ``width`` columns: the names in order are A..Z, AA..ZZ, AAA.."""
    letters = string.ascii_uppercase
    names = chain.from_iterable(map("".join, product(letters, repeat=n)) for n in (1, 2, 3))
    return next(islice(names, width - 1, None))


def write_xlsx_parts(df: DataFrame, folder: str, columns: list[str] | None = None,
                     sheet: str = "Relatorio", partitions: int | None = None, sheet_limit: int = SHEET_ROWS) -> DataFrame:
    """S5 re-aimed: a workbook per partition, in a fresh folder under
    ``folder``; returns the manifest (path, rows). Partitions are cut so that
    none passes ``sheet_limit`` rows, its header included, and hold up to
    that many in memory, zipped. Spark's text sink writes the bytes: one
    value a file, its line end being the archive's comment, under the sink's
    commit protocol. The committed files then get their names."""
    cols = columns or df.columns
    if not cols:
        raise ValueError("no columns to write")
    spark = df.sparkSession
    cells = report_cells(df.select(*cols))
    names = spark.createDataFrame([tuple(cols)], ", ".join(f"c{k} string" for k in range(len(cols))))
    header = sheet_rows(names).first()[0]
    target = f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}"
    if partitions:
        cells = cells.repartition(partitions)
    rows = staged(sheet_rows(cells).withColumn("id", F.monotonically_increasing_id()), "sheet")
    # the rows of a partition in pieces of a sheet each, in order
    book = F.concat_ws("-", F.shiftright("id", 33).cast("string"), F.floor(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) / (sheet_limit - 1)).cast("string"))

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((b.column(0)[k].as_py(), b.column(1)[k].as_py()) for b in batches for k in range(b.num_rows))
        first = next(pairs, None)
        while first is not None:
            following: list = [None]

            def inside(start: tuple) -> Iterator[str]:
                yield start[1]
                for pair in pairs:
                    if pair[0] != start[0]:
                        following[0] = pair
                        return
                    yield pair[1]

            data, n = workbook(header, inside(first), len(cols), sheet)
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["book", "rows", "data"])
            first = following[0]

    sheets = rows.select(book.alias("book"), "row", "id").repartition("book").sortWithinPartitions("book", "id").select("book", "row")
    made = staged(sheets.mapInArrow(write_part, "book string, rows long, data binary"), "workbooks")
    # a value's bytes are written as they are; one folder and file a workbook
    made.select("book", F.col("data").cast("string").alias("value")).repartition("book").write.partitionBy("book").text(target)
    counts = {r.book: r.rows for r in made.select("book", "rows").collect()}  # a line per workbook
    return spark.createDataFrame(sorted((_named(spark, f"{target}/book={b}", f"{target}/{b}.xlsx"), n) for b, n in counts.items()), "path string, rows long")


def _named(spark: SparkSession, folder: str, path: str) -> str:
    """Give the one data file of a committed folder its name."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    part = [f.getPath() for f in fs.listStatus(to(folder)) if f.getPath().getName().startswith("part-")][0]
    if not fs.rename(part, to(path)):
        raise OSError(f"{path} cannot be named")
    fs.delete(to(folder), True)
    return path


# S6 -------------------------------------------------------------------------
POINTER = "at timestamp_ntz, folder string, digest string, rows long"


def tree_digest(spark: SparkSession, folder: str) -> str:
    """SHA-256 over the lines "name digest" of a folder's data files, by name; files are hashed where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    lines = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda f: F.concat(f["name"], F.lit(" "), f["digest"])), "\n")
    return lines.agg(F.sha2(joined, 256)).first()[0]  # a line per file


def write_json_snapshot(df: DataFrame, root: str, rows_per_file: int = 1_000_000) -> str:
    """Write JSON lines to a folder of their own under ``root``, then append
    a pointer to it: readers take the newest pointer, so they find the old
    snapshot or the new one whole, never a gap. Returns the tree digest."""
    spark, place = df.sparkSession, root.rstrip("/")
    folder = f"{place}/data-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).json(folder)
    digest = tree_digest(spark, folder)
    rows = spark.read.text(folder).count()
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(now, folder, digest, rows)], POINTER).write.mode("append").parquet(f"{place}/pointers")
    return digest


def current_snapshot(spark: SparkSession, root: str):
    """The newest pointer: (at, folder, digest, rows)."""
    return spark.read.schema(POINTER).parquet(f"{root.rstrip('/')}/pointers").orderBy(F.desc("at"), F.desc("folder")).first()


def read_json_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(current_snapshot(spark, root).folder)


def expire_snapshots(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the data of all but the newest ``keep`` snapshots; returns how many went."""
    old = spark.read.schema(POINTER).parquet(f"{root.rstrip('/')}/pointers").orderBy(F.desc("at"), F.desc("folder")).collect()[keep:]
    to = spark._jvm.org.apache.hadoop.fs.Path
    return sum(to(r.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(to(r.folder), True) for r in old)


# The report format is an argument (no writer registry) ----------------
REPORT_FORMATS = ("csv", "xlsx")


def write_report(df: DataFrame, fmt: str, path: str, columns: list[str] | None = None,
                 sheet: str = DEFAULT_SHEET_NAME, partitions: int | None = None, sheet_limit: int = SHEET_ROWS) -> DataFrame | None:
    """Write ``df`` as CSV or XLSX parts under ``path``; an unknown format is
    an error. XLSX returns its manifest frame (path, rows); CSV returns None."""
    fmt = fmt.lower()
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"unknown report format {fmt!r}; expected one of {REPORT_FORMATS}")
    if fmt == "csv":
        write_csv(df if not partitions else df.repartition(partitions), path, columns)
        return None
    return write_xlsx_parts(df, path, columns, sheet=sheet, partitions=partitions, sheet_limit=sheet_limit)

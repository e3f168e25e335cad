"""Report CSV files: listing (S1, S2, S12) and one-pass tolerant reading.

A directory holds ``table_<n>.csv`` files; the largest ``n`` is the *active* file, the rest are
historical. Files may or may not have a header line (a headerless file starts with a reporter
address), header names may be encoded (``+AF8-`` / ``%5F`` for ``_``), columns may be missing or
reordered, rows may be short or long, and cells may hold junk.

Reading takes every file as text lines and cuts a line into as many cells as it has (quotes respected), so a file may
be of any width. The first line of a file decides its layout: a header if it holds a known column name (then cells map
by name), else positional. Layouts are one row per file; while the number of files stays under
``BROADCAST_FILES`` they are broadcast, so rows don't move, beyond that they are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake import constants as K
from reportlake.functions.casts import to_bool, to_integral
from reportlake.schema import REPORT_COLUMNS, REPORT_TYPES

BROADCAST_FILES = 100_000
# a cell: quoted (quotes doubled or behind a backslash) or bare, at the start or behind a comma
CELL = r'(?:^|,)("(?:[^"\\]++|""|\\.)*+"[^,]*|[^,]*)'
FILE_NAME_IN_PATH = r"(table_\d+\.csv)(/[^/]*)?$"


def file_name_of(path: str | Column) -> Column:
    """``table_<n>.csv`` of a path (also inside a ``key=table_<n>.csv/part-...`` directory)."""
    p = F.col(path) if isinstance(path, str) else path
    found = F.regexp_extract(p, FILE_NAME_IN_PATH, 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(p, r"([^/]+)$", 1))


def instance_of(path: str | Column, pattern: str = r"source_tables_([^/]+)/") -> Column:
    """The chain instance of a path (``.../source_tables_<instance>/...``), NULL if none."""
    p = F.col(path) if isinstance(path, str) else path
    found = F.regexp_extract(p, pattern, 1)
    return F.when(found != "", found)


def list_report_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, filename, file_number, size, mtime`` of the ``table_<n>.csv`` files (content unread)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    name = file_name_of("path")
    number = F.regexp_extract(name, K.REPORT_FILE_PATTERN, 1).try_cast("long")
    return files.select("path", name.alias("filename"), number.alias("file_number"), "size", "mtime").where(
        F.col("file_number").isNotNull()
    )


def classify_files(files: DataFrame, keep_historical: int | None = None,
                   max_historical_bytes: int | None = None) -> DataFrame:
    """The largest number is ``active``; others ``historical`` (newest ``keep_historical`` kept,
    files above ``max_historical_bytes`` skipped). Caps are options; ``None`` turns them off.

    The newest file is a scalar subquery; the kept set is a TakeOrdered of ``keep_historical + 1``
    files joined back by path, so no window spans the whole file list.
    """
    newest = files.select(F.max("file_number")).scalar()
    active = F.col("file_number") == newest
    out = files.withColumn("type", F.when(active, F.lit("active")).otherwise(F.lit("historical")))
    hist_ok = F.lit(True)
    if keep_historical is not None:
        kept = (
            files.orderBy(F.col("file_number").desc(), F.col("path").desc())
            .limit(keep_historical + 1)
            .select("path", F.lit(True).alias("__kept"))
        )
        out = out.join(F.broadcast(kept), "path", "left")
        hist_ok = hist_ok & F.coalesce(F.col("__kept"), F.lit(False))
    if max_historical_bytes is not None:
        hist_ok = hist_ok & (F.col("size") <= max_historical_bytes)
    out = out.withColumn("skipped", ~(active | hist_ok)).withColumn("warn_large", active & (F.col("size") > K.ACTIVE_WARN_BYTES))
    return out.drop("__kept")


def clean_name(c: Column) -> Column:
    """Decode ``+AF8-`` and ``%5F`` to ``_`` and trim."""
    return F.trim(F.replace(F.replace(c, F.lit("+AF8-"), F.lit("_")), F.lit("%5F"), F.lit("_")))


def line_columns(text: DataFrame) -> DataFrame:
    """``file_path, block_start, line`` of a text source (batch or stream)."""
    return text.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
    )


def read_report_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    return line_columns(reader.format("text").load(paths))


def line_cells(line: Column) -> Column:
    """The cells of a CSV line: bare cells as they are (empty is NULL), quoted ones without their quotes."""

    def bare(c: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(c, r'^"(.*)"[^"]*$', 1), r'""|\\"', '"')
        return F.when(c.startswith('"'), inner).when(c != "", c)

    return F.transform(F.regexp_extract_all(line, F.lit(CELL), F.lit(1)), bare)


def file_layouts(lines: DataFrame) -> DataFrame:
    """Per file: header or not, its first line, and the 1-based cell index of every report column (0 = missing)."""
    # a growing file's first line comes again at block -1 with the ranges that follow it
    first = lines.where((F.col("block_start") <= 0) & (F.trim("line") != "")).withColumn("__row", F.monotonically_increasing_id())
    first = first.groupBy("file_path").agg(F.min_by("line", F.struct("block_start", "__row")).alias("first_line"))
    names = F.transform(line_cells(F.col("first_line")), lambda x: clean_name(F.coalesce(x, F.lit(""))))
    known = F.array(*[F.lit(c) for c in REPORT_COLUMNS])
    first = first.select("file_path", "first_line", names.alias("__names")).withColumn("has_header", F.arrays_overlap("__names", known))
    idx = [
        F.when(F.col("has_header"), F.array_position("__names", c).cast("int")).otherwise(F.lit(pos + 1)).alias(f"__i_{c}")
        for pos, c in enumerate(REPORT_COLUMNS)
    ]
    return first.select("file_path", "first_line", "has_header", *idx)


def _coerce(c: str, cell: Column) -> Column:
    """The fixed type of a report column from its text; a bad cell becomes NULL."""
    t = REPORT_TYPES[c]
    if isinstance(t, T.BooleanType):
        return to_bool(F.trim(cell))
    if isinstance(t, T.IntegerType):
        return to_integral(F.trim(cell), "int")
    if isinstance(t, T.LongType):
        return to_integral(F.trim(cell), "long")
    return cell


def project_lines(lines: DataFrame, with_instance: bool = False, few_files: bool = True) -> DataFrame:
    """S3-S8 (+S12) of text lines, see :func:`read_reports`."""
    layouts = file_layouts(lines)
    rows = lines.withColumn("row_id", F.monotonically_increasing_id()).where((F.col("block_start") >= 0) & (F.trim("line") != ""))
    rows = rows.join(F.broadcast(layouts) if few_files else layouts, "file_path")
    # a header line is no row, also where it is repeated
    rows = rows.where(~F.col("has_header") | (F.col("line") != F.col("first_line")))
    rows = rows.withColumn("cells", F.explode(F.array(line_cells(F.col("line")))))  # cut once, not once a column
    out = []
    for c in REPORT_COLUMNS:
        cell = F.when(F.col(f"__i_{c}") > 0, F.get("cells", F.col(f"__i_{c}") - 1))
        out.append(_coerce(c, cell).cast(REPORT_TYPES[c]).alias(c))
    out.append(file_name_of("file_path").alias("source_file"))
    out.append(F.col("block_start").alias("line_block"))
    out.append(F.col("row_id").alias("line_no"))
    if with_instance:
        out.append(instance_of("file_path").alias("instance"))
    return rows.select(*out)


def read_reports(spark: SparkSession, paths: str | Sequence[str], with_instance: bool = False) -> DataFrame:
    """S3-S8 (+S12): report rows of all files with the fixed schema, ``source_file`` and line order.

    Output: the report columns, ``source_file``, ``line_block``, ``line_no`` (order within the file:
    sort by both) and, with ``with_instance``, the chain ``instance`` of the file's directory.
    """
    lines = read_report_lines(spark, paths)
    return project_lines(lines, with_instance, few_files=len(lines.inputFiles()) <= BROADCAST_FILES)


def read_report_dir(spark: SparkSession, directory: str, with_instance: bool = False) -> DataFrame:
    """S1+S3: read only the ``table_<n>.csv`` files of a folder (other names are ignored)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "table_[0-9]*.csv")
    lines = line_columns(reader.format("text").load(directory))
    return project_lines(lines, with_instance, few_files=len(lines.inputFiles()) <= BROADCAST_FILES)


def loaded_files(reports: DataFrame) -> DataFrame:
    """Distinct source files already in the table."""
    return reports.select("source_file").distinct()

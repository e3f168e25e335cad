"""Writes report rows as untidy ``table_<n>.csv`` files (the layouts the reader must accept).

Used to land derived data for round-trip checks and streams: files of even day numbers get a header
with encoded names (``+AF8-`` / ``%5F``), a different column order and an extra trailing column;
odd ones are headerless and positional. One file per ``source_file``, rows in ``line_no`` order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.functions.core import idiv
from reportlake.schema import REPORT_COLUMNS

ENCODED = {"TX_HASH": "TX+AF8-HASH", "QUERY_ID": "QUERY%5FID", "TRUSTED_VALUE": "TRUSTED+AF8-VALUE"}


def _text(c: str):
    return F.col(c).cast("string").alias(c)


def write_dirty_report_csv(raw: DataFrame, path: str) -> None:
    day = idiv(F.regexp_extract("source_file", r"table_(\d+)\.csv", 1).cast("long"), 86400)
    rows = raw.withColumn("__even", day % 2 == 0)
    ordered = lambda df: df.repartition("source_file").sortWithinPartitions("source_file", "line_no")
    headed_cols = list(reversed(REPORT_COLUMNS))
    headed = rows.where(F.col("__even")).select(
        *[_text(c).alias(ENCODED.get(c, c)) for c in headed_cols], F.lit("x").alias("EXTRA"), "source_file", "line_no"
    )
    ordered(headed).drop("line_no").write.mode("append").option("header", "true").partitionBy("source_file").csv(path)
    plain = rows.where(~F.col("__even")).select(*[_text(c) for c in REPORT_COLUMNS], "source_file", "line_no")
    ordered(plain).drop("line_no").write.mode("append").option("header", "false").partitionBy("source_file").csv(path)


def write_report_parquet_by_file(reports: DataFrame, path: str) -> None:
    """One Parquet folder per source file (stream input)."""
    reports.repartition("source_file").write.mode("overwrite").partitionBy("source_file").parquet(path)


def write_report_lines(raw: DataFrame, path: str) -> None:
    """Report lines with a header, in (file number, line) order over the part files: text for :func:`append_bytes`."""
    order = [F.regexp_extract("source_file", r"table_(\d+)\.csv", 1).cast("long"), F.col("line_no")]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REPORT_COLUMNS]
    raw.orderBy(*order).select(F.concat_ws(",", *cells).alias("value")).write.text(path)


def append_bytes(parts: str, target: str, share: tuple[int, int], head: bytes) -> None:
    """Appends the k-th of n equal shares of the bytes of ``parts`` (a folder) to one file, as a process does that writes
    while others read: a share may end inside a line. The first share begins with ``head``."""
    from reportlake.sources.growing import _opened, pafs

    fs, root = _opened(parts)
    _, to = _opened(target)
    files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith("part-"))
    sizes = {f: fs.get_file_info(f).size for f in files}
    k, n = share
    low, high = (sum(sizes.values()) * x // n for x in (k, k + 1))
    if k == 0:
        fs.create_dir(to.rpartition("/")[0])
    with fs.open_append_stream(to) as out:
        out.write(head if k == 0 else b"")
        for f in files:
            with fs.open_input_file(f) as part:
                part.seek(min(max(low, 0), sizes[f]))
                left = max(0, min(high, sizes[f]) - max(low, 0))
                while left:
                    block = part.read(min(left, 1 << 20))
                    out.write(block)
                    left -= len(block)
            low, high = low - sizes[f], high - sizes[f]

"""Sinks and stored-table maintenance (K2, K7, K8, K9).

Tables are written as Parquet into a caller-given folder; on a cluster that folder must be shared
storage (for scratch work use the folder named by ``spark.checkpoint.dir``, see
:func:`reportlake.session.ensure_checkpoint_dir`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.functions.casts import to_double
from reportlake.functions.metrics import symmetric_agreement
from reportlake.keyindex import SLOT_KEYS, KeyIndex, folders
from reportlake.operators.dedupe import KEY


def _by_file(reports: DataFrame) -> DataFrame:
    """Rows grouped by source file for a partitioned write; a large file is split over many tasks."""
    return reports.repartitionByRange("source_file", "TX_HASH")


def write_report_table(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store reports as Parquet partitioned by ``source_file`` (one folder per source file)."""
    (_by_file(reports).write.mode(mode).partitionBy("source_file").parquet(path))


def ingest_reports(reports: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Store the deduplicated fact table once (E1), partitioned by ``day`` (of TIMESTAMP, UTC).

    Rows are range-partitioned on TIMESTAMP and TX_HASH (Spark samples the bounds, so a day or a block holding
    a third of all rows is spread over many tasks) and sorted by time within each task before the partitioned write:
    time-window queries prune whole ``day`` folders (see :func:`reportlake.functions.buckets.time_range`)
    and skip row groups by their TIMESTAMP statistics. ``files`` defaults to the shuffle partitions.
    """
    spark = reports.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        reports.withColumn("day", F.call_function("div", F.col("TIMESTAMP"), F.lit(86400000)))
        .repartitionByRange(n, "TIMESTAMP", "TX_HASH")
        .sortWithinPartitions("day", "TIMESTAMP", "TX_HASH")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def _write_blocks(spark: SparkSession, path: str, index: DataFrame) -> None:
    """A new version of the store's block index; readers of the one before aren't disturbed."""
    newest = folders(spark, f"{path}/blocks")
    v = int(newest[-1].removeprefix("v=")) + 1 if newest else 0
    index.write.mode("overwrite").parquet(f"{path}/blocks/v={v:012d}")


def _read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the store's block index."""
    return spark.read.parquet(f"{path}/blocks/{folders(spark, f'{path}/blocks')[-1]}")


def ingest_all(inputs, path: str) -> None:
    """Load every source once into stored tables under ``path`` (as the dashboard loads its tables at
    start): ``reports`` (deduplicated, see :func:`ingest_reports`), its block index ``blocks`` (one row
    per block), ``registry``, ``mappings`` and ``snapshots``. Queries then read them with ``Inputs(..., store=path)``."""
    from concurrent.futures import ThreadPoolExecutor

    from reportlake.operators.blocks import block_index

    def facts() -> None:
        ingest_reports(inputs.reports, f"{path}/reports")
        _write_blocks(inputs.spark, path, block_index(_read_stored(inputs.spark, path)))

    def dimension(name: str) -> None:
        getattr(inputs, name).write.mode("overwrite").parquet(f"{path}/{name}")

    # independent Spark jobs submitted concurrently (the scheduler interleaves their tasks)
    with ThreadPoolExecutor(max_workers=4) as pool:
        futures = [pool.submit(facts)] + [pool.submit(dimension, n) for n in ("registry", "mappings", "snapshots")]
        for f in futures:
            f.result()


def _read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored reports; the schema is given, so an empty table reads as one."""
    from pyspark.sql import types as T

    from reportlake.schema import REPORT_SCHEMA

    schema = T.StructType([*REPORT_SCHEMA.fields, T.StructField("day", T.LongType(), True)])
    return spark.read.schema(schema).parquet(f"{path}/reports")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored reports with their block index, see :func:`ingest_all`. The index must hold the table's rows of each
    day (a count that reads no column); a table written past it is refused."""
    from reportlake.operators.blocks import use_block_index

    stored = _read_stored(spark, path)
    index = _read_blocks(spark, path)
    there = stored.where(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    known = index.groupBy(F.call_function("div", F.col("TIMESTAMP"), F.lit(86400000)).alias("day")).agg(F.sum("rows").alias("m"))
    differ = there.join(known, "day", "full").where(~F.col("n").eqNullSafe(F.col("m")))
    if not differ.isEmpty():
        raise ValueError(f"the block index of {path} doesn't match its reports: append with append_to_store, or rebuild it")
    return use_block_index(stored, index)


def append_to_store(spark: SparkSession, path: str, incoming: DataFrame, slot_keys: int = SLOT_KEYS) -> None:
    """K3: lands the rows of ``incoming`` whose TX_HASH isn't stored, and renews the block index.

    Stored keys are looked up in the store's key index (:class:`~reportlake.keyindex.KeyIndex`), which is built from the
    reports at the first append: later ones read the slots that may hold their keys, not the stored table. New rows are
    appended to their ``day`` folders; the block index gets a new version, the old one plus the new rows' blocks (one row
    per block). If the step is cut short, :func:`open_store` refuses the table until :func:`rebuild_index` ran.
    """
    from reportlake.operators.blocks import block_index, merged_index
    from reportlake.operators.dedupe import dedupe_reports
    from reportlake.schema import REPORT_SCHEMA

    columns = REPORT_SCHEMA.fieldNames()
    keys = KeyIndex(spark, f"{path}/keys", slot_keys=slot_keys)
    if keys.is_empty():
        keys.add(_read_stored(spark, path), 0)
    run = keys.next_run()
    # the batch and its new rows as tables of their own, so that every step sees the same ones
    batch = f"{path}/incoming/run={run:012d}"
    dedupe_reports(incoming.select(*[c for c in incoming.columns if c in columns or c in ("line_no", "line_block")])).write.mode("overwrite").parquet(f"{batch}-all")
    keys.absent(spark.read.parquet(f"{batch}-all"), run).write.mode("overwrite").parquet(batch)
    fresh = spark.read.parquet(batch).select(*columns)
    both = merged_index(_read_blocks(spark, path).unionByName(block_index(fresh)))
    ingest_reports(fresh, f"{path}/reports", mode="append")
    keys.add(fresh, run)
    _write_blocks(spark, path, both)


def rebuild_index(spark: SparkSession, path: str) -> None:
    """Renews the block index, and the key index if there is one, from the stored reports."""
    from reportlake.operators.blocks import block_index

    reports = _read_stored(spark, path)
    _write_blocks(spark, path, block_index(reports))
    keys = KeyIndex(spark, f"{path}/keys")
    if not keys.is_empty():
        keys.add(keys.absent(reports.select(KEY)), keys.next_run())


def replace_file_partition(rows_of_files: DataFrame, path: str) -> None:
    """K2: replace the stored rows of exactly the files present in ``rows_of_files``.

    Dynamic partition overwrite rewrites only the ``source_file`` folders being written; all other
    files' rows stay untouched.
    """
    (
        _by_file(rows_of_files)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_file")
        .parquet(path)
    )


def read_report_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_search_csv(rows: DataFrame, path: str) -> DataFrame:
    """K7: search results as CSV with display columns; returns the exported frame.

    Timestamps are rendered from epoch milliseconds as ISO-8601 UTC text.
    """
    v, t = to_double("VALUE"), to_double("TRUSTED_VALUE")
    ms = F.col("TIMESTAMP")
    iso = F.concat(
        F.date_format(F.date_from_unix_date(F.call_function("div", ms, F.lit(86400000)).cast("int")), "yyyy-MM-dd"),
        F.lit("T"),
        F.lpad((F.call_function("div", ms, F.lit(3600000)) % 24).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.call_function("div", ms, F.lit(60000)) % 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.call_function("div", ms, F.lit(1000)) % 60).cast("string"), 2, "0"),
        F.lit("."),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
        F.lit("Z"),
    )
    out = rows.select(
        F.col("QUERY_ID").alias("Query ID"),
        F.col("VALUE").alias("Reported Value"),
        F.col("TRUSTED_VALUE").alias("Trusted Value"),
        F.when(v == t, "100%").otherwise(F.coalesce(F.concat(F.format_number(symmetric_agreement(v, t), 1), F.lit("%")), F.lit("N/A"))).alias("Agreement"),
        F.col("REPORTER").alias("Reporter"),
        F.col("POWER").alias("Power"),
        iso.alias("Timestamp"),
        F.when(F.col("DISPUTABLE"), F.lit("Yes")).otherwise(F.lit("No")).alias("Disputable"),
    )
    out.write.mode("overwrite").option("header", "true").csv(path)
    return out


def write_snapshots_json(snapshots: DataFrame, path: str) -> None:
    """K8: snapshots as ``[{height, power, timestamp}]`` documents (one per day, timestamp in seconds),
    the layout the snapshot source (S11) reads."""
    from reportlake.sources.doc_writers import write_snapshot_docs

    write_snapshot_docs(snapshots, path)


def load_totals(inventory: DataFrame) -> DataFrame:
    """K9: one row over :func:`load_inventory`: rows and files in all, and the active file's name, number and size."""
    active = F.max(F.when(F.col("type") == "active", F.struct("timestamp", "filename", "size_mb")))
    out = inventory.agg(
        F.sum("rows").cast("long").alias("total_rows"),
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("type") == "historical").alias("historical_files"),
        active.alias("a"),
    )
    return out.select("total_rows", "files", "historical_files", F.col("a.filename").alias("active_filename"),
                      F.col("a.timestamp").alias("active_timestamp"), F.col("a.size_mb").alias("active_size_mb"))


def load_inventory(files: DataFrame, reports: DataFrame) -> DataFrame:
    """K9: per listed file: rows loaded, size in MB (2 decimals), file number and type."""
    counts = reports.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    typed = files.withColumn(
        "type",
        F.when(F.col("file_number") == files.select(F.max("file_number")).scalar(), F.lit("active")).otherwise(
            F.lit("historical")
        ),
    )
    return typed.join(counts, typed.filename == counts.source_file, "left").select(
        "filename",
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
        F.round(F.col("size") / (1024.0 * 1024.0), 2).alias("size_mb"),
        F.col("file_number").alias("timestamp"),
        "type",
    )

"""Structured Streaming forms of the report pipeline.

* T1 ``report_file_stream``: new report CSV files as they land (file source reads a file once, so
  writers must land closed files; a growing file is re-read in batch with K3).
* T2 ``ingest_stream``: ``foreachBatch`` applies the batch reader's per-file layout logic to each
  micro-batch and appends only keys not stored yet (exact insert-or-ignore across batches, by a key index), or
  ``dedupe_within_watermark`` for a bounded-state variant. T9: its block sums take late rows at any time.
* T3/T5 ``complete_blocks``: block aggregates emitted once a newer block has been seen: an event-time
  watermark on the block timestamp, ``LATENESS`` behind by default.
* T4 ``stream_histogram``: tumbling event-time windows (epoch aligned).
* T8 ``stream_questionable``: stateless filter.
* T10 ``stream_bucket_activity``: windowed distinct reporters / median block power.
* T7 lives in :mod:`reportlake.operators.snapshots` (``applyInPandasWithState``).

Every sink here is a file sink in a caller-given folder with a checkpoint location, so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reportlake import constants as K
from reportlake.functions.metrics import questionable
from reportlake.keyindex import SLOT_KEYS, KeyIndex, folders
from reportlake.operators.dedupe import KEY, dedupe_reports
from reportlake.schema import REPORT_SCHEMA
from reportlake.sources import report_files as rf


#: How far behind the newest block a row may arrive: the two files that are read again span at most two days.
LATENESS = "2 days"


def report_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming lines of new CSV files with their file and block position."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return rf.line_columns(reader.format("text").load(path))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written at ``path``; any other trouble with it fails."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and len(fs.listStatus(p)) > 0


def ingest_stream(spark: SparkSession, source: str | DataFrame, table: str, checkpoint: str,
                  max_files_per_trigger: int | None = None,
                  available_now: bool = True, processing_time: str = "10 seconds", slot_keys: int = SLOT_KEYS) -> StreamingQuery:
    """T1+T2: land new files of the folder ``source`` (or lines of a stream like :func:`report_file_stream`) into the table at
    ``table``, insert-or-ignore on TX_HASH.

    Each micro-batch is deduplicated (first writer wins) and cleared of the keys that earlier batches stored, which the
    key index finds without reading the stored keys (:class:`~reportlake.keyindex.KeyIndex`). Its new rows, their keys and
    their blocks (T9: rows and power to add to each block, whatever its age) are three folders named by the batch. A
    batch that is retried looks at earlier batches only and overwrites its own folders, so no try counts twice.
    """
    from reportlake.operators.blocks import block_index

    def upsert(batch: DataFrame, batch_id: int) -> None:
        keys = KeyIndex(spark, f"{table}/keys", slot_keys=slot_keys)
        rows = dedupe_reports(rf.project_lines(batch)).persist()
        own = f"{table}/rows/batch={batch_id:012d}"
        keys.absent(rows, batch_id).select(*REPORT_SCHEMA.fieldNames()).write.mode("overwrite").parquet(own)
        rows.unpersist()
        fresh = spark.read.schema(REPORT_SCHEMA).parquet(own)
        block_index(fresh).write.mode("overwrite").parquet(f"{table}/blocks/batch={batch_id:012d}")
        keys.add(fresh, batch_id)

    lines = report_file_stream(spark, source, max_files_per_trigger) if isinstance(source, str) else source
    writer = lines.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def _batches(table: str, part: str, spark: SparkSession) -> list[str]:
    return [f"{table}/{part}/{x}" for x in folders(spark, f"{table}/{part}")]


def read_ingested(spark: SparkSession, table: str) -> DataFrame:
    """The rows that :func:`ingest_stream` has stored."""
    paths = _batches(table, "rows", spark)
    return spark.read.schema(REPORT_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], REPORT_SCHEMA)


def read_ingested_blocks(spark: SparkSession, table: str) -> DataFrame:
    """Rows and POWER sum of each block, merged from the batches' shares when read: a row counts in its block
    however late it came, where a watermark would drop it."""
    schema = "TIMESTAMP long, rows long, POWER_OF_AGGR long"
    paths = _batches(table, "blocks", spark)
    shares = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return shares.groupBy("TIMESTAMP").agg(F.sum("rows").alias("rows"), F.sum("POWER_OF_AGGR").cast("long").alias("POWER_OF_AGGR"))


def parquet_report_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of landed report rows (Parquet with the fixed report schema)."""
    reader = spark.readStream.schema(REPORT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def _event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis("TIMESTAMP"))


def dedupe_within_watermark(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """T2 (bounded state): drop repeated TX_HASH among rows within ``delay`` of event time."""
    return _event_time(stream).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([KEY])


def complete_blocks(stream: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Per block rows and POWER sum, emitted (append mode) once a block newer by ``delay`` is seen. Rows later
    than that are left out; Spark counts them (``numRowsDroppedByWatermark`` in the query's progress)."""
    return (
        _event_time(stream)
        .withWatermark("event_time", delay)
        .groupBy("event_time", "TIMESTAMP")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("POWER").cast("long").alias("POWER_OF_AGGR"))
        .drop("event_time")
    )


def stream_histogram(stream: DataFrame, interval: str = "30 minutes", delay: str = LATENESS) -> DataFrame:
    """T4: reports per tumbling event-time window (epoch aligned), emitted when the window closes."""
    w = F.window("event_time", interval)
    return (
        _event_time(stream)
        .withWatermark("event_time", delay)
        .groupBy(w.alias("w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.unix_millis(F.col("w.start")).alias("window_start_ms"),
            F.unix_millis(F.col("w.end")).alias("window_end_ms"),
            "count",
        )
    )


def stream_questionable(stream: DataFrame, now_ms: int) -> DataFrame:
    """Live disputable reports younger than 72 h at ``now_ms`` (stateless)."""
    return stream.where(questionable(now_ms)).select(
        KEY, "TIMESTAMP", "REPORTER", "QUERY_ID", questionable(now_ms, K.URGENT_WINDOW_MS).alias("urgent")
    )


def stream_bucket_activity(stream: DataFrame, interval: str = "30 minutes", delay: str = LATENESS) -> DataFrame:
    """Per tumbling window, reports and the exact median block power (A22 without D20).

    Two chained stateful aggregations: complete blocks (watermark on the block time), then windows
    over the emitted blocks with ``percentile(power, 0.5, rows)``: the median over the window's rows,
    computed from one row per block. State holds one row per open block and window.
    """
    blocks = (
        _event_time(stream)
        .withWatermark("event_time", delay)
        .groupBy("event_time")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("POWER").cast("long").alias("poa"))
    )
    return (
        blocks.groupBy(F.window("event_time", interval).alias("w"))
        .agg(
            F.sum("n").alias("total_reports"),
            F.percentile(F.coalesce("poa", F.lit(0).cast("long")), F.lit(0.5), F.col("n")).alias(
                "representative_power_of_aggr"
            ),
        )
        .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"), "total_reports", "representative_power_of_aggr")
    )


def stream_active_reporters(stream: DataFrame, interval: str = "30 minutes", delay: str = LATENESS) -> DataFrame:
    """T10 (distinct part): exact distinct reporters per tumbling window: one state row per window and reporter, then
    a count of them per window."""
    pairs = (
        _event_time(stream)
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", interval).alias("w"), "REPORTER")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        pairs.groupBy(F.window(F.window_time("w"), interval).alias("v"))
        .agg(F.count("REPORTER").alias("active_reporters"))
        .select(F.unix_millis(F.col("v.start")).alias("window_start_ms"), "active_reporters")
    )


def run_to_table(stream_df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a streaming frame with ``availableNow`` into a Parquet folder; caller awaits termination."""
    return (
        stream_df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def registry_refresh_stream(spark: SparkSession, dumps: str, table: str, checkpoint: str, fetched_at: int,
                            available_now: bool = True, processing_time: str = "60 seconds") -> StreamingQuery:
    """Registry dumps (JSON documents) landing in ``dumps`` are upserted into the registry
    table at ``table`` (K4: newest ``fetched_at`` per address wins, vanished addresses stay).

    The registry is a dimension, so each batch rewrites it whole into a fresh folder version;
    readers take the newest version (``<table>/v=<batch>``).
    """
    from reportlake.operators.registry import upsert_registry
    from reportlake.sources.documents import DUMP_SCHEMA, flatten_dump

    def upsert(batch: DataFrame, batch_id: int) -> None:
        incoming = flatten_dump(batch, fetched_at + batch_id)
        # versions before this batch only: a retried batch doesn't read what it overwrites
        current = registry_before(spark, table, batch_id)
        upsert_registry(current, incoming).write.mode("overwrite").parquet(f"{table}/v={batch_id:012d}")

    stream = spark.readStream.schema(DUMP_SCHEMA).option("multiLine", "true").json(dumps)
    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def registry_before(spark: SparkSession, table: str, batch_id: int) -> DataFrame:
    """The newest registry version older than ``batch_id``, empty if there is none."""
    from reportlake.schema import REGISTRY_SCHEMA

    if not _exists(spark, table):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    versions = spark.read.schema(T.StructType([*REGISTRY_SCHEMA.fields, T.StructField("v", T.LongType())])).parquet(table)
    older = versions.where(F.col("v") < batch_id)
    return older.where(F.col("v") == older.select(F.max("v")).scalar()).drop("v")


def latest_registry(spark: SparkSession, table: str) -> DataFrame:
    """The newest registry version written by :func:`registry_refresh_stream`."""
    versions = spark.read.parquet(table)
    newest = versions.select(F.max("v")).scalar()
    return versions.where(F.col("v") == newest).drop("v")

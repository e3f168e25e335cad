"""Streams equal their batch operators when files arrive in time order, one file per micro-batch."""

import os

from pyspark.sql import functions as F

from reportlake.operators import blocks, dedupe, snapshots
from reportlake.schema import REPORT_SCHEMA
from reportlake.streaming import reports as streams

HEADER = "REPORTER,QUERY_TYPE,QUERY_ID,AGGREGATE_METHOD,CYCLELIST,POWER,TIMESTAMP,TRUSTED_VALUE,TX_HASH,CURRENT_TIME,TIME_DIFF,VALUE,DISPUTABLE"


def _rows(day):
    out = []
    for k in range(6):
        ts = day * 86400000 + (k // 2) * 600000
        out.append(f"rep1r{k},SpotPrice,q{k % 3},weighted-median,true,{10 + k},{ts},1.0,TX{day}-{k},{ts + 5},5,1.1,{k == 0}")
    out.append(f"rep1dup,SpotPrice,q0,weighted-median,true,1,{day * 86400000},1.0,TX0-0,{day * 86400000},0,1.0,false")
    return out


def _land(folder, days):
    os.makedirs(folder, exist_ok=True)
    for i, day in enumerate(days):
        p = os.path.join(folder, f"table_{day * 86400}.csv")
        with open(p, "w") as f:
            f.write("\n".join([HEADER] + _rows(day)) + "\n")
        os.utime(p, (1_000_000 + i * 100, 1_000_000 + i * 100))


def test_ingest_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    _land(src, [19700, 19701, 19702])
    table, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    streams.ingest_stream(spark, src, table, ck, max_files_per_trigger=1).awaitTermination()
    got = streams.read_ingested(spark, table)
    from reportlake.sources.report_files import read_reports

    want = dedupe.dedupe_reports(read_reports(spark, src))
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert got.where(F.col("TX_HASH") == "TX0-0").count() == 1


def test_complete_blocks_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    _land(src, [19700, 19701, 19702])
    from reportlake.sources.report_files import read_reports

    batch = dedupe.dedupe_reports(read_reports(spark, src))
    landed = str(tmp_path / "landed")
    for i, f in enumerate(sorted(batch.select("source_file").distinct().collect())):
        part = os.path.join(landed, f.source_file.replace(".csv", ""))
        batch.where(F.col("source_file") == f.source_file).select(*REPORT_SCHEMA.fieldNames()).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            os.utime(os.path.join(part, name), (2_000_000 + i * 100, 2_000_000 + i * 100))
    stream = streams.parquet_report_stream(spark, landed + "/*", max_files_per_trigger=1)
    out = str(tmp_path / "out")
    streams.run_to_table(streams.complete_blocks(stream, delay="1 millisecond"), out, str(tmp_path / "ck")).awaitTermination()
    got = {(r.TIMESTAMP, r.rows, r.POWER_OF_AGGR) for r in spark.read.parquet(out).collect()}
    safe = blocks.safe_block_filter(batch)
    want = {(r.TIMESTAMP, r.rows, r.POWER_OF_AGGR) for r in safe.groupBy("TIMESTAMP").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("POWER").cast("long").alias("POWER_OF_AGGR")).collect()}
    assert got == want


def test_throttle_stream_equals_batch(spark, tmp_path):
    hour = 3600000
    rows = [(i, t, 1, "realtime", i) for i, t in enumerate([0, 10, hour, hour + 1, 2 * hour + 5, 5 * hour, 5 * hour + 2])]
    schema = "height long, timestamp_ms long, maximal_power long, sample_type string, created_at long"
    src = str(tmp_path / "snaps")
    for i, r in enumerate(rows):
        part = os.path.join(src, f"p{i:02d}")
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            os.utime(os.path.join(part, name), (3_000_000 + i * 100, 3_000_000 + i * 100))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src + "/*")
    out = str(tmp_path / "out")
    streams.run_to_table(snapshots.snapshot_throttle_stream(stream), out, str(tmp_path / "ck")).awaitTermination()
    got = sorted(r.timestamp_ms for r in spark.read.parquet(out).collect())
    want = sorted(r.timestamp_ms for r in snapshots.snapshot_throttle(spark.createDataFrame(rows, schema)).collect())
    assert got == want == [0, hour + 1, 2 * hour + 5, 5 * hour]


def _land_parquet(spark, folder, batches):
    for i, rows in enumerate(batches):
        part = os.path.join(folder, f"b{i:02d}")
        spark.createDataFrame(rows, REPORT_SCHEMA).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            os.utime(os.path.join(part, name), (4_000_000 + i * 100, 4_000_000 + i * 100))


def _row(ts, power, tx):
    return ("r", "SpotPrice", "q", "m", True, power, ts, "1", tx, ts, 0, "1", False, "table_1.csv")


def test_late_rows_stream_versus_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    batches = [
        [_row(1000, 1, "a"), _row(2000, 2, "b")],
        [_row(3000, 4, "c"), _row(1000, 8, "late")],  # arrives in the batch that closes block 1000: counted
        [_row(4000, 32, "d"), _row(1000, 16, "very-late")],  # one batch later: behind the watermark, dropped
    ]
    _land_parquet(spark, src, batches)
    out = str(tmp_path / "out")
    stream = streams.parquet_report_stream(spark, src + "/*", max_files_per_trigger=1)
    streams.run_to_table(streams.complete_blocks(stream, delay="1 millisecond"), out, str(tmp_path / "ck")).awaitTermination()
    got = {r.TIMESTAMP: r.POWER_OF_AGGR for r in spark.read.parquet(out).collect()}
    assert got == {1000: 9, 2000: 2, 3000: 4}  # the newest block (4000) stays open
    rows = [r for b in batches for r in b]
    batch = blocks.safe_block_filter(spark.createDataFrame(rows, REPORT_SCHEMA))  # the batch path is authoritative
    assert {r.TIMESTAMP: r.p for r in batch.groupBy("TIMESTAMP").agg(F.sum("POWER").alias("p")).collect()} == {
        1000: 25, 2000: 2, 3000: 4}


def test_stream_histogram_epoch_aligned(spark, tmp_path):
    src = str(tmp_path / "src")
    half_hour = 1_800_000
    rows = [_row(5 * half_hour + 10, 1, "a"), _row(5 * half_hour + 20, 1, "b"), _row(6 * half_hour + 1, 1, "c"),
            _row(9 * half_hour, 1, "d")]
    _land_parquet(spark, src, [rows])
    out = str(tmp_path / "out")
    streams.run_to_table(streams.stream_histogram(streams.parquet_report_stream(spark, src + "/*"), delay="1 millisecond"), out,
                         str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.window_start_ms, r["count"]) for r in spark.read.parquet(out).collect())
    assert got == [(5 * half_hour, 2), (6 * half_hour, 1)]  # the window of the newest block is still open

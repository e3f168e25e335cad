"""Table maintenance and sinks on small hand-made inputs (K1 quarantine, K2, K3, K7, S2 caps)."""

from pyspark.sql import functions as F

from reportlake import sinks
from reportlake.operators import dedupe
from reportlake.schema import REPORT_SCHEMA
from reportlake.sources import report_files


def _rows(spark, rows):
    full = [("r", "SpotPrice", "q", "m", True, p, ts, "1.0", tx, ts, 0, v, d, f) for tx, ts, p, v, d, f in rows]
    return spark.createDataFrame(full, REPORT_SCHEMA)


def test_replace_file_partition_touches_only_that_file(spark, tmp_path):
    path = str(tmp_path / "t")
    base = _rows(spark, [("a", 1, 1, "1", False, "table_1.csv"), ("b", 2, 2, "2", False, "table_2.csv")])
    sinks.write_report_table(base, path)
    sinks.replace_file_partition(_rows(spark, [("c", 3, 3, "3", False, "table_2.csv")]), path)
    got = {(r.TX_HASH, r.source_file) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "table_1.csv"), ("c", "table_2.csv")}


def test_append_new_rows_and_null_keys(spark):
    stored = _rows(spark, [("a", 1, 1, "1", False, "table_1.csv")])
    incoming = _rows(spark, [("a", 1, 9, "9", False, "table_2.csv"), ("b", 2, 2, "2", False, "table_2.csv"),
                             (None, 3, 3, "3", False, "table_2.csv")]).withColumn("line_no", F.lit(0).cast("long"))
    fresh = dedupe.append_new_rows(stored, incoming)
    assert [r.TX_HASH for r in fresh.collect()] == ["b"]
    assert dedupe.null_key_reports(incoming).count() == 1


def test_export_search_csv(spark, tmp_path):
    rows = _rows(spark, [("a", 1706659199999, 5, "100.0", True, "table_1.csv")]).withColumn("TRUSTED_VALUE", F.lit("99"))
    path = str(tmp_path / "export")
    sinks.export_search_csv(rows, path)
    back = spark.read.option("header", "true").csv(path).collect()[0].asDict()
    assert back == {"Query ID": "q", "Reported Value": "100.0", "Trusted Value": "99", "Agreement": "99.0%", "Reporter": "r",
                    "Power": "5", "Timestamp": "2024-01-30T23:59:59.999Z", "Disputable": "Yes"}


def test_classify_caps(spark):
    files = spark.createDataFrame(
        [(f"/d/table_{n}.csv", f"table_{n}.csv", n, size, 0) for n, size in [(1, 10), (2, 999), (3, 10), (4, 10)]],
        "path string, filename string, file_number long, size long, mtime long",
    )
    out = {r.filename: (r.type, r.skipped) for r in report_files.classify_files(files, keep_historical=2, max_historical_bytes=500).collect()}
    assert out == {"table_4.csv": ("active", False), "table_3.csv": ("historical", False),
                   "table_2.csv": ("historical", True), "table_1.csv": ("historical", True)}

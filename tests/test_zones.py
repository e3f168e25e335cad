"""CURRENT_TIME bounds on a stored table: the block index names the day folders that may hold such rows."""

import pytest
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake import sinks
from reportlake.operators import blocks, registry, stats
from reportlake.schema import REPORT_SCHEMA

DAY = K.DAY_MS


def _reports(spark, rows):
    """rows: (TX_HASH, REPORTER, TIMESTAMP, CURRENT_TIME)"""
    df = spark.createDataFrame(rows, "TX_HASH string, REPORTER string, TIMESTAMP long, CURRENT_TIME long")
    given = {f.name for f in df.schema}
    return df.select(*[F.col(f.name) if f.name in given else F.lit(1 if f.name == "POWER" else None).cast(f.dataType).alias(f.name) for f in REPORT_SCHEMA.fields])


#: A day for each block; "late" reports an old block today, "loose" has no block, "never" no CURRENT_TIME.
ROWS = [(f"h{d}", f"r{d}", d * DAY, d * DAY + 5000) for d in range(10, 30)] + [
    ("late", "late", 12 * DAY, 29 * DAY + 5000), ("loose", "loose", None, 29 * DAY + 4000), ("never", "never", 15 * DAY, None)]


def _stored(spark, path, rows):
    reports = _reports(spark, rows)
    sinks.ingest_reports(reports, f"{path}/reports", files=2)
    sinks.rebuild_index(spark, path)
    return reports, sinks.open_store(spark, path)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    return _stored(spark, str(tmp_path_factory.mktemp("zones")), ROWS)


def _names(df, col="TX_HASH"):
    return sorted(r[0] for r in df.select(col).collect())


@pytest.mark.parametrize("lo", [0, 12 * DAY, 28 * DAY + 5000, 28 * DAY + 5001, 29 * DAY + 5000, 29 * DAY + 5001, 99 * DAY])
def test_rows_seen_since(both, lo):
    raw, stored = both
    want = _names(raw.where(F.col("CURRENT_TIME") >= lo))
    assert _names(stored.where(blocks.seen_since(stored, F.lit(lo)))) == want


def test_operators_on_the_store(both):
    raw, stored = both
    assert _names(registry.active_addresses(stored), "address") == _names(registry.active_addresses(raw), "address") == ["late", "loose", "r29"]
    assert stats.recent_activity(stored).first() == stats.recent_activity(raw).first()
    assert blocks.newest_seen(stored) is not None
    now = 29 * DAY + 6000
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(stats.absent_reporters(stored, now)) == key(stats.absent_reporters(raw, now)) != []


def test_loose_row_is_the_newest(spark, tmp_path):
    raw, stored = _stored(spark, str(tmp_path), [*ROWS, ("newest", "x", None, 40 * DAY)])
    assert _names(registry.active_addresses(stored), "address") == _names(registry.active_addresses(raw), "address") == ["x"]


def test_empty_table(spark, tmp_path):
    raw, stored = _stored(spark, str(tmp_path), [])
    assert registry.active_addresses(stored).count() == 0
    assert stats.recent_activity(stored).first()[0] == 0


def test_only_those_day_folders_are_read(both):
    _, stored = both
    since = blocks.seen_since(stored, F.lit(28 * DAY))
    files = {f.split("day=")[1].split("/")[0] for f in stored.where(since).where("TIMESTAMP > %d" % (20 * DAY)).select("_metadata.file_path").distinct().toPandas()["file_path"]}
    assert files == {"28", "29"}
    plan = stored.where(since)._jdf.queryExecution().explainString(stored.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert "day" in line and "subquery" in line.lower()


def test_append_renews_the_zones(spark, tmp_path):
    path = str(tmp_path)
    _stored(spark, path, ROWS)
    sinks.append_to_store(spark, path, _reports(spark, [("more", "more", 11 * DAY, 50 * DAY)]))
    stored = sinks.open_store(spark, path)
    assert _names(registry.active_addresses(stored), "address") == ["more"]

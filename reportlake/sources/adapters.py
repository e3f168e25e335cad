"""Adapters that shape the driver's tables into the report data model.

``reports_from_events``   events   -> raw report rows (before dedupe), one per event
``registry_from_customers`` customer -> reporter registry (all accounts)
``mappings_from_events``  events   -> query id -> display name dimension
``snapshots_from_reports`` reports -> network power snapshots, one per block

Only integer/text expressions are used so that a SQL engine computes identical rows (see
``reportlake.plans.oracle`` for the SQL twins). The modulo expressions below derive *values*
(duplicates, bad cells, flags); no adapter drops rows by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.constants import FIXTURE_NOW_MS
from reportlake.functions.core import idiv


def _epoch_ms(ts: str) -> Column:
    # events.ts is TIMESTAMP_NTZ: difference to the epoch in microseconds is zone-free.
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) div 1000")


def _cents_text(cents: Column) -> Column:
    return F.concat(idiv(cents, 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def reports_from_events(events: DataFrame) -> DataFrame:
    """Raw report rows with the fixed report schema plus ``line_no`` (order within its file)."""
    ms = _epoch_ms("ts")
    eid = F.col("event_id")
    vc = F.round(F.col("value") * 100).cast("long")
    tc = F.greatest(vc + eid % 21 - 10, F.lit(0).cast("long"))
    base = events.select(
        eid.alias("event_id"),
        F.col("user_id"),
        F.col("event_type"),
        ms.alias("ms"),
        vc.alias("vc"),
        tc.alias("tc"),
    )
    ms, eid, vc, tc = F.col("ms"), F.col("event_id"), F.col("vc"), F.col("tc")
    current_time = ms + 5000 + eid % 7000
    timestamp = idiv(ms, 600000) * 600000
    return base.select(
        F.concat(F.lit("reporter1"), F.lpad(F.col("user_id").cast("string"), 24, "0")).alias("REPORTER"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), F.lit("SpotPrice"))
        .otherwise(F.lit("Other"))
        .alias("QUERY_TYPE"),
        F.md5(F.concat(F.col("event_type"), F.lit("-"), (eid % 13).cast("string"))).alias("QUERY_ID"),
        F.lit("weighted-median").alias("AGGREGATE_METHOD"),
        (eid % 2 == 0).alias("CYCLELIST"),
        (F.lit(1) + (F.col("user_id") * 37) % 1200).cast("int").alias("POWER"),
        timestamp.alias("TIMESTAMP"),
        F.when(eid % 103 == 0, F.lit(None).cast("string")).otherwise(_cents_text(tc)).alias("TRUSTED_VALUE"),
        F.upper(F.md5(F.when(eid % 50 == 49, eid - 1).otherwise(eid).cast("string"))).alias("TX_HASH"),
        current_time.alias("CURRENT_TIME"),
        (current_time - timestamp).cast("int").alias("TIME_DIFF"),
        F.when(eid % 97 == 0, F.lit("0xdead"))
        .when(eid % 89 == 0, F.lit(None).cast("string"))
        .otherwise(_cents_text(vc))
        .alias("VALUE"),
        (eid % 40 == 0).alias("DISPUTABLE"),
        F.concat(F.lit("table_"), (idiv(ms, 86400000) * 86400).cast("string"), F.lit(".csv")).alias("source_file"),
        eid.alias("line_no"),
    )


def registry_from_customers(customer: DataFrame, now_ms: int = FIXTURE_NOW_MS) -> DataFrame:
    """Reporter registry: one row per customer account. Times are epoch milliseconds.
    """
    key = F.col("c_custkey")
    jailed = (F.col("c_mktsegment") == "MACHINERY") & (key % 3 == 0)
    return customer.select(
        F.concat(F.lit("reporter1"), F.lpad(key.cast("string"), 24, "0")).alias("address"),
        F.when(key % 11 == 0, F.lit("")).otherwise(F.col("c_name")).alias("moniker"),
        F.concat((F.col("c_nationkey") + 1).cast("string"), F.lit("0000000000000000")).alias("commission_rate"),
        jailed.alias("jailed"),
        F.when(jailed, F.lit(now_ms) + (key % 5) * 86400000).alias("jailed_until"),
        (F.lit(now_ms) - (key % 720) * 3600000).alias("last_updated"),
        F.lit(1000000).cast("long").alias("min_tokens_required"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("int").alias("power"),
        F.lit(now_ms).alias("fetched_at"),
        F.lit(now_ms).alias("updated_at"),
    )


def registry_from_suppliers(supplier: DataFrame, now_ms: int = FIXTURE_NOW_MS) -> DataFrame:
    """The same registry rows from the supplier accounts, which aren't all reporters."""
    as_customers = supplier.select(
        F.col("s_suppkey").alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("MACHINERY").alias("c_mktsegment"),
    )
    return registry_from_customers(as_customers, now_ms)


def mappings_from_events(events: DataFrame) -> DataFrame:
    """Query id -> display name, for every id."""
    eid = F.col("event_id")
    return (
        events.select(
            F.md5(F.concat(F.col("event_type"), F.lit("-"), (eid % 13).cast("string"))).alias("query_id"),
            F.concat(F.upper(F.col("event_type")), F.lit("/"), (eid % 13).cast("string")).alias("name"),
        )
        .distinct()
    )


def snapshots_from_reports(reports: DataFrame) -> DataFrame:
    """Network power snapshots: one per report block; height from 6 s block time."""
    blocks = reports.where(F.col("TIMESTAMP").isNotNull()).groupBy("TIMESTAMP").agg(
        F.sum("POWER").cast("long").alias("maximal_power"),
        F.max("CURRENT_TIME").alias("created_at"),
    )
    return blocks.select(
        idiv("TIMESTAMP", 6000).alias("height"),
        F.col("TIMESTAMP").alias("timestamp_ms"),
        F.col("maximal_power"),
        F.col("created_at"),
        F.when(idiv("TIMESTAMP", 600000) % 6 == 5, F.lit("realtime")).otherwise(F.lit("historical")).alias(
            "sample_type"
        ),
    )


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}

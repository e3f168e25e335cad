"""Dashboard statistics over the report table.

All results are small aggregates; the plans are single scans with map-side partial aggregation.
Scalars relative to the data (its max CURRENT_TIME, the safe block) are scalar subqueries.
Top-k lists are TakeOrdered with explicit tie-breaks (count desc, key asc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions.buckets import time_range
from reportlake.functions.casts import to_double
from reportlake.functions.core import exact_mean
from reportlake.functions.metrics import agreement_pct, query_display_name, reporter_display_name, share_pct
from reportlake.operators.blocks import in_block, newest_seen, safe_block_filter, safe_timestamp_value, seen_since

TS = "TIMESTAMP"


def stats_counts(reports: DataFrame, safe: bool = True, approx: bool = False) -> DataFrame:
    """A1: rows, distinct reporters, distinct query types (safe filter by default)."""
    rows = safe_block_filter(reports) if safe else reports
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        distinct("REPORTER").alias("unique_reporters"),
        distinct("QUERY_TYPE").alias("unique_query_types"),
    )


def unique_query_ids(reports: DataFrame, now_ms: int, window_ms: int = K.UNIQUE_IDS_WINDOW_MS) -> DataFrame:
    """A2: distinct query ids with ``TIMESTAMP >= now - 30d`` (safe filter)."""
    rows = safe_block_filter(reports).where(time_range(reports, now_ms - window_ms, None))
    return rows.agg(F.countDistinct("QUERY_ID").alias("unique_query_ids_30d"))


def average_agreement(reports: DataFrame) -> DataFrame:
    """A3: mean agreement % over rows with both numeric values (no safe filter), 2 decimals."""
    v, t = to_double("VALUE"), to_double("TRUSTED_VALUE")
    rows = reports.select(v.alias("V"), t.alias("T")).where(F.col("V").isNotNull() & F.col("T").isNotNull())
    return rows.agg(F.round(F.avg(agreement_pct("V", "T")), 2).alias("average_agreement"))


def value_stats(reports: DataFrame, approx: bool = False) -> DataFrame:
    """A4: min, max and median of the numeric VALUE over all rows.

    The exact median is a radix selection (:func:`reportlake.operators.ranks.select_value`), whose first pass also gives
    the extremes; its passes run when this is called. ``approx=True`` uses a ``percentile_approx`` sketch in one scan.
    """
    v = to_double("VALUE")
    if approx:
        med = F.percentile_approx(v, 0.5, 10000).cast("double")
        return reports.agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), med.alias("median_value"))
    from reportlake.operators.ranks import select_value

    found = select_value(reports, v) or (None, None, None)
    return reports.sparkSession.createDataFrame([found], "min_value double, max_value double, median_value double")


def recent_activity(reports: DataFrame, window_ms: int = K.RECENT_ACTIVITY_MS) -> DataFrame:
    """A5: rows with ``CURRENT_TIME > max(CURRENT_TIME) - 1h`` (relative to the data)."""
    since = newest_seen(reports) - (window_ms - 1)
    return reports.where(seen_since(reports, since)).agg(F.count(F.lit(1)).alias("recent_activity"))


def questionable_stats(reports: DataFrame, now_ms: int) -> DataFrame:
    """Disputable reports younger than 72 h, of them younger than 48 h, and whether any is."""
    age = F.lit(now_ms) - F.col(TS)
    recent = time_range(reports, now_ms - K.QUESTIONABLE_WINDOW_MS + 1, None)  # same rows as the age test
    rows = reports.where(recent & (F.col("DISPUTABLE") == F.lit(True)) & (age < K.QUESTIONABLE_WINDOW_MS))
    out = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(age < K.URGENT_WINDOW_MS, F.lit(1))).alias("urgent"),
    )
    return out.withColumn("has_urgent", F.col("urgent") > 0)


def top_counts(reports: DataFrame, key: str, k: int | None) -> DataFrame:
    """Reports per key, most frequent first (ties by key), ``k`` rows or all."""
    out = reports.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.col("count").desc(), F.col(key).asc_nulls_last())
    return out.limit(k) if k is not None else out


def top_reporters(reports: DataFrame, k: int = K.TOP_REPORTERS) -> DataFrame:
    return top_counts(reports, "REPORTER", k)


def top_query_ids(reports: DataFrame, k: int = K.TOP_QUERY_IDS) -> DataFrame:
    return top_counts(reports, "QUERY_ID", k)


def query_type_distribution(reports: DataFrame) -> DataFrame:
    return top_counts(reports, "QUERY_TYPE", None)


def queries_24h(reports: DataFrame, now_ms: int, mappings: DataFrame | None = None,
                k: int = K.TOP_QUERIES_24H) -> DataFrame:
    """Query ids reported since ``now - 24h``: reports and distinct reporters, top ``k``."""
    rows = reports.where(time_range(reports, now_ms - K.ACTIVE_WINDOW_MS, None))
    top = (
        rows.groupBy("QUERY_ID")
        .agg(F.count(F.lit(1)).alias("report_count"), F.countDistinct("REPORTER").alias("unique_reporters"))
        .orderBy(F.col("report_count").desc(), F.col("QUERY_ID").asc_nulls_last())
        .limit(k)
    )
    return _name_queries(top, mappings)


def _name_queries(df: DataFrame, mappings: DataFrame | None) -> DataFrame:
    if mappings is None:
        return df.withColumn("short_name", query_display_name("QUERY_ID", F.lit(None).cast("string")))
    names = mappings.select(F.col("query_id").alias("QUERY_ID"), F.col("name").alias("__name"))
    return df.join(names, "QUERY_ID", "left").withColumn("short_name", query_display_name("QUERY_ID", "__name")).drop(
        "__name"
    )


def _name_reporters(df: DataFrame, registry: DataFrame | None, col: str = "REPORTER") -> DataFrame:
    if registry is None:
        return df.withColumn("short_name", reporter_display_name(col, F.lit(None).cast("string")))
    names = registry.select(F.col("address").alias(col), F.col("moniker").alias("__moniker"))
    return df.join(names, col, "left").withColumn("short_name", reporter_display_name(col, "__moniker")).drop(
        "__moniker"
    )


def latest_block_rows(reports: DataFrame, query_id: str | Column | None = None) -> DataFrame:
    """Rows of the newest block of each query id (or of one ``query_id``)."""
    rows = reports.where(F.col("QUERY_ID").isNotNull() & F.col(TS).isNotNull())
    if query_id is not None:
        rows = rows.where(F.col("QUERY_ID") == (F.lit(query_id) if isinstance(query_id, str) else query_id))
    newest = rows.groupBy("QUERY_ID").agg(F.max(TS).alias(TS))  # one row per query id
    return rows.join(newest, ["QUERY_ID", TS], "left_semi")


def power_distribution_query(reports: DataFrame, registry: DataFrame | None = None,
                             query_id: str | Column | None = None) -> DataFrame:
    """The newest block of a query id: reporter, power, value, trusted value (per report)."""
    rows = latest_block_rows(reports, query_id).select("QUERY_ID", TS, "REPORTER", "POWER", "VALUE", "TRUSTED_VALUE")
    return _name_reporters(rows, registry)


def query_block_info(reports: DataFrame, query_id: str | Column | None = None) -> DataFrame:
    """Per query type within that newest block: reports, reporters, avg/min/max value.

    All groups are returned (the original keeps only the first).
    """
    rows = latest_block_rows(reports, query_id)
    v = to_double("VALUE")
    return rows.groupBy("QUERY_ID", TS, "QUERY_TYPE").agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.countDistinct("REPORTER").alias("unique_reporters"),
        exact_mean(v).alias("avg_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def power_distribution_overall(reports: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row per report of the safe block (D6) with its power, total power and share."""
    target = safe_timestamp_value(reports)
    rows = reports.where(in_block(reports, target)).select(TS, "REPORTER", "POWER", "TX_HASH")
    total = rows.select(F.sum("POWER").cast("long")).scalar()
    out = rows.select("*", total.alias("total_power"), share_pct("POWER", total).alias("power_share"))
    return _name_reporters(out, registry)


def absent_reporters(reports: DataFrame, now_ms: int, registry: DataFrame | None = None,
                     window_ms: int = K.RECENT_ACTIVITY_MS) -> DataFrame:
    """Reporters seen since ``now - 1h`` but absent from the safe block, with their last report."""
    target = safe_timestamp_value(reports)
    # whoever reported in the last hour has their last report there too: only rows of that hour are aggregated
    recent = reports.where(seen_since(reports, F.lit(now_ms - window_ms)))
    last = recent.groupBy("REPORTER").agg(F.max_by(F.struct("POWER", "CURRENT_TIME"), F.struct("CURRENT_TIME", "TX_HASH")).alias("__last"))
    present = reports.where(in_block(reports, target)).select("REPORTER")
    last = last.where(F.col("REPORTER").isNotNull()).join(present, "REPORTER", "left_anti").select(
        "REPORTER", F.col("__last.POWER").alias("last_power"), F.col("__last.CURRENT_TIME").alias("last_report_time")
    )
    return _name_reporters(last, registry)


def reporter_tx_stats(reports: DataFrame, reporter: str | None = None) -> DataFrame:
    """Per reporter transactions, distinct queries, mean value, first/last TIMESTAMP."""
    rows = reports if reporter is None else reports.where(F.col("REPORTER") == reporter)
    v = to_double("VALUE")
    return rows.groupBy("REPORTER").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.countDistinct("QUERY_ID").alias("unique_queries"),
        exact_mean(v).alias("avg_value"),
        F.min(TS).alias("first_transaction"),
        F.max(TS).alias("last_transaction"),
    )

"""Reporter registry joins and views.

The registry is a dimension (one row per reporter address). Joins against it are left/semi/anti
equi-joins on ``address``; Spark broadcasts it while its measured size is under the broadcast
threshold and shuffles otherwise. Sets derived from the report table (active or unknown reporters)
are DISTINCT aggregates with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions.core import exact_mean
from reportlake.functions.metrics import commission_pct, reporter_status, share_pct
from reportlake.operators.blocks import newest_seen, seen_since
from reportlake.operators.filters import page_limit


def active_addresses(reports: DataFrame, window_ms: int = K.ACTIVE_WINDOW_MS) -> DataFrame:
    """Reporters with ``CURRENT_TIME > max(CURRENT_TIME) - 24h`` (relative to the data's max)."""
    since = newest_seen(reports) - (window_ms - 1)
    return reports.where(seen_since(reports, since)).select(F.col("REPORTER").alias("address")).distinct()


def with_active_flag(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """Registry rows with ``active_24h``."""
    active = active_addresses(reports).withColumn("__active", F.lit(True))
    return registry.join(active, "address", "left").select(
        *registry.columns, F.coalesce(F.col("__active"), F.lit(False)).alias("active_24h")
    )


def active_power(registry: DataFrame, reports: DataFrame, now_ms: int,
                 window_ms: int = K.ACTIVE_WINDOW_MS) -> DataFrame:
    """Registry reporters that reported with ``CURRENT_TIME >= now - 24h``: count and power."""
    seen = reports.where(seen_since(reports, F.lit(now_ms - window_ms))).select(F.col("REPORTER").alias("address"))
    rows = registry.join(seen, "address", "left_semi")
    return rows.agg(
        F.countDistinct("address").alias("active_reporter_count"),
        F.coalesce(F.sum("power").cast("long"), F.lit(0).cast("long")).alias("total_active_power"),
    )


def valid_reporter(c: str | Column = "REPORTER") -> Column:
    """not NULL and not empty."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def unknown_reporters(reports: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct valid reporters of the report table missing from the registry."""
    seen = reports.where(valid_reporter()).select(F.col("REPORTER").alias("address")).distinct()
    return seen.join(registry.select("address"), "address", "left_anti")


def placeholder_reporters(reports: DataFrame, registry: DataFrame, fetched_at: int) -> DataFrame:
    """Registry plus a placeholder row per unknown reporter (existing rows are kept as they are)."""
    unknown = unknown_reporters(reports, registry)
    ph = unknown.select(
        "address",
        F.concat(F.lit("Unknown ("), F.substring("address", 1, K.PLACEHOLDER_PREFIX), F.lit("...)")).alias("moniker"),
        F.lit("0").alias("commission_rate"),
        F.lit(False).alias("jailed"),
        F.lit(None).cast("long").alias("jailed_until"),
        F.lit(None).cast("long").alias("last_updated"),
        F.lit(0).cast("long").alias("min_tokens_required"),
        F.lit(0).cast("int").alias("power"),
        F.lit(fetched_at).cast("long").alias("fetched_at"),
        F.lit(fetched_at).cast("long").alias("updated_at"),
    )
    return registry.unionByName(ph.select(*registry.columns))


def upsert_registry(current: DataFrame, incoming: DataFrame, order: str = "fetched_at") -> DataFrame:
    """K4: insert-or-replace per ``address``: the newest row by ``order`` wins, vanished ones stay.

    ``max_by`` over a struct is partially aggregated, so a hot address costs one row per map task.
    """
    both = current.unionByName(incoming.select(*current.columns))
    cols = [c for c in current.columns if c != "address"]
    latest = both.groupBy("address").agg(
        F.max_by(F.struct(*cols), F.struct(F.col(order), F.col("updated_at"), *[F.col(c) for c in cols])).alias("__r")
    )
    return latest.select("address", *[F.col(f"__r.{c}").alias(c) for c in cols])


def _sort(sort_by: str) -> Column:
    """power descending; the others ascending. commission_rate sorts by number (``commission_text``: as text)."""
    return {
        "power": lambda: F.col("power").desc_nulls_last(),
        "moniker": lambda: F.col("moniker").asc_nulls_last(),
        "commission_rate": lambda: F.col("commission_rate").try_cast("decimal(38,0)").asc_nulls_last(),
        "commission_text": lambda: F.col("commission_rate").asc_nulls_last(),
        "last_updated": lambda: F.col("last_updated").asc_nulls_last(),
    }[sort_by]()


def reporters_page(registry: DataFrame, reports: DataFrame, search: str | None = None, jailed_only: bool = False,
                   sort_by: str = "power", limit: int = K.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """filtered, sorted page of the registry with the ``active_24h`` flag (address breaks ties)."""
    limit = page_limit(limit)
    rows = with_active_flag(registry, reports)
    if search:
        rows = rows.where(F.col("moniker").contains(search) | F.col("address").contains(search))
    if jailed_only:
        rows = rows.where(F.col("jailed") == F.lit(True))
    ordered = rows.orderBy(_sort(sort_by), F.col("address").asc())
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def reporters_total(registry: DataFrame, search: str | None = None, jailed_only: bool = False) -> DataFrame:
    rows = registry
    if search:
        rows = rows.where(F.col("moniker").contains(search) | F.col("address").contains(search))
    if jailed_only:
        rows = rows.where(F.col("jailed") == F.lit(True))
    return rows.agg(F.count(F.lit(1)).alias("total"))


def reporter_detail(registry: DataFrame, address: str | Column) -> DataFrame:
    """F8: one registry row by address."""
    a = F.lit(address) if isinstance(address, str) else address
    return registry.where(F.col("address") == a)


def reporters_summary(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals over the registry with the active flag; zeros for an empty registry."""
    rows = with_active_flag(registry, reports)
    return rows.agg(
        F.count(F.lit(1)).alias("total_reporters"),
        F.count(F.when(F.col("jailed") == F.lit(True), F.lit(1))).alias("jailed_reporters"),
        F.count(F.when(F.col("active_24h"), F.lit(1))).alias("active_reporters"),
        F.coalesce(exact_mean("power"), F.lit(0.0)).alias("avg_power"),
        F.coalesce(F.max("power"), F.lit(0)).alias("max_power"),
        F.coalesce(F.sum("power").cast("long"), F.lit(0).cast("long")).alias("total_power"),
    )


def top_power(registry: DataFrame, k: int = K.TOP_POWER) -> DataFrame:
    """Reporters with power > 0, strongest first (address breaks ties)."""
    return (
        registry.where(F.col("power") > 0)
        .select("moniker", "address", "power")
        .orderBy(F.col("power").desc(), F.col("address").asc())
        .limit(k)
    )


def commission_distribution(registry: DataFrame, k: int = K.TOP_COMMISSION) -> DataFrame:
    """Reporters per commission rate, most common first (rate text breaks ties)."""
    return (
        registry.groupBy("commission_rate")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("commission_rate").asc_nulls_last())
        .limit(k)
    )


def power_utilization(registry: DataFrame, reports: DataFrame, now_ms: int) -> DataFrame:
    """Active power / total registry power in percent (1 decimal); NULL when either is 0."""
    act = active_power(registry, reports, now_ms)
    total = registry.select(F.sum("power").cast("long")).scalar()
    return act.select(
        "total_active_power",
        total.alias("total_power"),
        F.when((F.col("total_active_power") > 0) & (total > 0),
               F.round(F.col("total_active_power") / total * 100.0, 1)).alias("power_utilization"),
    )


def registry_view(registry: DataFrame, reports: DataFrame) -> DataFrame:
    """D23/D24/D25 per registry row: commission %, status, active text, power bar and share."""
    rows = with_active_flag(registry, reports)
    max_power = registry.select(F.max("power")).scalar()
    total = registry.select(F.sum("power").cast("long")).scalar()
    return rows.select(
        "address",
        commission_pct("commission_rate").alias("commission_pct"),
        reporter_status("jailed", "power").alias("status"),
        F.when(F.col("active_24h"), F.lit("Active")).otherwise(F.lit("Inactive")).alias("activity"),
        share_pct("power", max_power).alias("power_bar"),
        share_pct("power", total).alias("power_share"),
    )

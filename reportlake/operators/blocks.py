"""Block logic: a *block* is the set of reports sharing one ``TIMESTAMP``.

Scale notes
* Block power (D1) is a grouped sum joined back on ``TIMESTAMP``, not a window over the block: the
  sum is partially aggregated map-side, so a block holding a third of all rows costs one row per map
  task in the shuffle. The joined side has one row per block (two longs); Spark broadcasts it when
  its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time)
  and shuffles otherwise, with AQE skew-join splitting a hot block on the big side.
* Whole-table facts (newest block, its predecessor) are scalar subqueries: one small aggregate job,
  no cross join, no driver round trip before the plan runs.
"""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.constants import DAY_MS, RECENT_BLOCKS
from reportlake.functions.core import idiv

TS = "TIMESTAMP"


def block_index_of(reports: DataFrame) -> DataFrame | None:
    """The stored block index declared for ``reports`` (see :func:`use_block_index`), if any."""
    return _INDEX.get(reports)


def block_power(reports: DataFrame) -> DataFrame:
    """One row per block: ``TIMESTAMP, POWER_OF_AGGR = sum(POWER)`` (long)."""
    return reports.groupBy(TS).agg(F.sum("POWER").cast("long").alias("POWER_OF_AGGR"))


def power_of_aggr(reports: DataFrame) -> DataFrame:
    """Every row gets ``POWER_OF_AGGR``, the sum of POWER over all rows of its block.

    Rows without a TIMESTAMP belong to no block and get NULL.
    """
    base = reports.drop("POWER_OF_AGGR") if "POWER_OF_AGGR" in reports.columns else reports
    index = _INDEX.get(reports)
    sums = index.select(TS, "POWER_OF_AGGR") if index is not None else block_power(base).where(F.col(TS).isNotNull())
    return base.join(sums, on=TS, how="left")


def newest_blocks(reports: DataFrame, n: int = RECENT_BLOCKS) -> DataFrame:
    """The ``n`` newest distinct timestamps (a TakeOrdered of at most ``n`` rows)."""
    return reports.where(F.col(TS).isNotNull()).select(TS).distinct().orderBy(F.col(TS).desc()).limit(n)


def power_of_aggr_recent(reports: DataFrame, n: int = RECENT_BLOCKS) -> DataFrame:
    """Rows of the ``n`` newest blocks with their recomputed POWER_OF_AGGR.

    The recent set has at most ``n`` rows, so it is broadcast by construction.
    """
    recent = reports.join(F.broadcast(newest_blocks(reports, n)), on=TS, how="left_semi")
    return power_of_aggr(recent)


def power_of_aggr_file(reports: DataFrame, source_file: str | Column) -> DataFrame:
    """D3: rows of one file, with block sums computed over **all** files (then filtered)."""
    target = F.lit(source_file) if isinstance(source_file, str) else source_file
    return power_of_aggr(reports).where(F.col("source_file") == target)


def power_stats(with_power: DataFrame) -> DataFrame:
    """Distinct blocks, rows, min/max POWER_OF_AGGR over rows that have one."""
    return with_power.where(F.col("POWER_OF_AGGR").isNotNull()).agg(
        F.countDistinct(TS).alias("unique_timestamps"),
        F.count(F.lit(1)).alias("total_rows"),
        F.min("POWER_OF_AGGR").alias("min_power_of_aggr"),
        F.max("POWER_OF_AGGR").alias("max_power_of_aggr"),
    )


_BOUNDS: "weakref.WeakKeyDictionary[DataFrame, tuple[Column, Column]]" = weakref.WeakKeyDictionary()
_INDEX: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()


def use_block_index(reports: DataFrame, index: DataFrame) -> DataFrame:
    """Declare ``index`` (one row per block, written at ingest by :func:`block_index`) as the block index of the stored
    table ``reports``. Whole-table block facts (newest/oldest block) are then read from the index instead of the fact
    table's TIMESTAMP column, and a bound on CURRENT_TIME becomes one on ``day`` (:func:`seen_since`)."""
    _INDEX[reports] = index
    return reports


def block_index(reports: DataFrame) -> DataFrame:
    """One row per block with its row count, power sum and newest CURRENT_TIME: a small table (blocks, not reports)."""
    return reports.where(F.col(TS).isNotNull()).groupBy(TS).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("POWER").cast("long").alias("POWER_OF_AGGR"),
        F.max("CURRENT_TIME").cast("long").alias("last_seen"),
    )


def merged_index(shares: DataFrame) -> DataFrame:
    """The block index of a table from those of its parts."""
    return shares.groupBy(TS).agg(
        F.sum("rows").alias("rows"),
        F.sum("POWER_OF_AGGR").cast("long").alias("POWER_OF_AGGR"),
        F.max("last_seen").alias("last_seen"),
    )


def _zones(reports: DataFrame) -> DataFrame | None:
    """The block index, where it tells CURRENT_TIME and the table is stored by ``day``."""
    index = _INDEX.get(reports)
    return index if index is not None and "last_seen" in index.columns and "day" in reports.columns else None


def newest_seen(reports: DataFrame) -> Column:
    """The table's newest CURRENT_TIME as a scalar: from the block index and the rows outside blocks (their own ``day``
    folder), or from a scan where there is no index."""
    zones = _zones(reports)
    if zones is None:
        return reports.select(F.max("CURRENT_TIME")).scalar()
    loose = reports.where(F.col("day").isNull()).select(F.max("CURRENT_TIME").cast("long")).scalar()
    return F.greatest(zones.select(F.max("last_seen")).scalar(), loose)


def seen_since(reports: DataFrame, lo: Column) -> Column:
    """``CURRENT_TIME >= lo``. On a stored table the blocks whose newest CURRENT_TIME reaches ``lo`` bound ``day``, so only
    their folders (and that of rows outside blocks) are read, however CURRENT_TIME and TIMESTAMP differ."""
    cond = F.col("CURRENT_TIME") >= lo
    zones = _zones(reports)
    if zones is None:
        return cond
    days = zones.where(F.col("last_seen") >= lo).select(
        F.struct(F.min(idiv(TS, DAY_MS)).alias("low"), F.max(idiv(TS, DAY_MS)).alias("high"))).scalar()
    day = F.col("day")
    return cond & (day.isNull() | ((day >= days.getField("low")) & (day <= days.getField("high"))))


def in_block(reports: DataFrame, block: Column) -> Column:
    """``TIMESTAMP = block``, within the block's ``day`` folder on a stored table."""
    cond = F.col(TS) == block
    return cond & (F.col("day") == idiv(block, DAY_MS)) if "day" in reports.columns else cond


def _bounds(reports: DataFrame) -> tuple[Column, Column]:
    """Scalar subqueries ``(mn, mx)`` of the non-NULL timestamps, memoised per input frame so every
    safe predicate of one query shares the same two subqueries. With a block index the bounds are a
    scan of the index (one row per block) instead of the fact table's TIMESTAMP column."""
    cached = _BOUNDS.get(reports)
    if cached is None:
        source = _INDEX.get(reports, reports)
        b = source.select(F.struct(F.min(TS).alias("mn"), F.max(TS).alias("mx"))).scalar()
        cached = _BOUNDS[reports] = (b.getField("mn"), b.getField("mx"))
    return cached


def safe_block_predicate(reports: DataFrame) -> Column:
    """D5 predicate: with two or more distinct blocks drop the newest (possibly incomplete) one.

    With 0 or 1 distinct timestamps every row passes. NULL timestamps never pass once two blocks
    exist (the comparison is NULL).
    """
    mn, mx = _bounds(reports)
    return mx.isNull() | (mn == mx) | (F.col(TS) < mx)


def safe_block_filter(reports: DataFrame) -> DataFrame:
    """``reports`` without the newest block (see :func:`safe_block_predicate`)."""
    return reports.where(safe_block_predicate(reports))


def safe_timestamp_value(reports: DataFrame) -> Column:
    """D6 as a scalar: second newest distinct timestamp, else the only one, else NULL
    (read from the block index when the stored table has one)."""
    source = _INDEX.get(reports, reports)
    mx = source.select(F.max(TS)).scalar()
    second = source.where(F.col(TS) < mx).select(F.max(TS)).scalar()
    return F.coalesce(second, mx)


def safe_timestamp(reports: DataFrame) -> DataFrame:
    """D6 as a one-row frame ``safe_timestamp``."""
    spark = reports.sparkSession
    return spark.range(1).select(safe_timestamp_value(reports).alias("safe_timestamp"))


def block_consistency(with_power: DataFrame) -> DataFrame:
    """Per block rows, sum(POWER), min/max stored POWER_OF_AGGR and two audit flags."""
    out = with_power.groupBy(TS).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("POWER").cast("long").alias("total_power"),
        F.min("POWER_OF_AGGR").alias("min_power_of_aggr"),
        F.max("POWER_OF_AGGR").alias("max_power_of_aggr"),
    )
    return out.select(
        "*",
        F.when(F.col("min_power_of_aggr") == F.col("max_power_of_aggr"), F.lit("CONSISTENT"))
        .otherwise(F.lit("INCONSISTENT"))
        .alias("consistency"),
        F.when(F.col("total_power") == F.col("min_power_of_aggr"), F.lit("CORRECT"))
        .otherwise(F.lit("INCORRECT"))
        .alias("verification"),
    )


def first_n_per_block(with_power: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` rows of each block by REPORTER (TX_HASH breaks ties).

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the shuffle, so each
    map task forwards at most ``n`` rows per block even for a very large block.
    """
    w = Window.partitionBy(TS).orderBy(F.col("REPORTER").asc_nulls_last(), F.col("TX_HASH"))
    return (
        with_power.select(TS, "REPORTER", "POWER", "POWER_OF_AGGR", "TX_HASH")
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= n)
        .select(TS, "REPORTER", "POWER", "POWER_OF_AGGR", F.col("rn").cast("long").alias("rn"))
    )

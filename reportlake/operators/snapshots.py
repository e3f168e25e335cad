"""Network power snapshots.

A snapshot is ``(height, timestamp_ms, maximal_power, created_at, sample_type)``; heights are chain
block numbers (6 s blocks). Grids of heights are generated with ``sequence`` from parameters that
are scalar subqueries over the data, so nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake import constants as K
from reportlake.functions.casts import to_integral
from reportlake.functions.core import exact_mean
from reportlake.session import ship_package


def network_power_at_height(dumps: DataFrame, height: str = "height", power: str = "power") -> DataFrame:
    """Total power per height over registry dumps carrying a height (power text cast to long)."""
    return dumps.groupBy(height).agg(
        F.coalesce(F.sum(to_integral(F.col(power).cast("string"), "long")), F.lit(0).cast("long")).alias("maximal_power")
    )


_GRID_CHUNK = 10_000


def height_grid(spark: SparkSession, end: Column | int, days: int = 30, interval: int = K.HEIGHT_STEP) -> DataFrame:
    """Heights to sample: ``end`` plus every multiple of ``interval`` in ``[start, end]``,
    ``start = max(0, end - days * 14400)`` (every multiple, as documented; see Q9 in the README)."""
    end_c = end if isinstance(end, Column) else F.lit(end).cast("long")
    start = F.greatest(F.lit(0).cast("long"), end_c - F.lit(days * K.BLOCKS_PER_DAY))
    first = F.call_function("div", start + (interval - 1), F.lit(interval)) * interval
    last = F.call_function("div", end_c, F.lit(interval)) * interval
    step = F.lit(interval).cast("long")
    span = F.lit(_GRID_CHUNK * interval).cast("long")
    # chunks of the grid, then the heights of each: no row holds more than a chunk
    ends = spark.range(1).select(first.alias("first"), last.alias("last"), end_c.alias("end"))
    chunks = ends.where("first <= last").select("last", F.explode(F.sequence("first", "last", span)).alias("at"))
    grid = chunks.select(F.explode(F.sequence("at", F.least("last", F.col("at") + span - step), step)).alias("height"))
    return grid.unionByName(ends.where(F.col("end") % interval != 0).select(F.col("end").alias("height")))


def estimate_height_time(spark: SparkSession, height: Column | int, ts_seconds: Column | float,
                         points: int = K.ESTIMATE_POINTS, step: int = K.ESTIMATE_STEP_BLOCKS,
                         block_seconds: int = K.ESTIMATE_BLOCK_SECONDS) -> DataFrame:
    """``points`` heights ``step`` blocks apart going back, times estimated at 6 s per block."""
    h = height if isinstance(height, Column) else F.lit(height).cast("long")
    ts = ts_seconds if isinstance(ts_seconds, Column) else F.lit(float(ts_seconds))
    i = F.col("i")
    return (
        spark.range(points)
        .select(F.col("id").alias("i"))
        .select(i, (h - i * step).alias("height"), (ts - i * (step * block_seconds)).cast("double").alias("timestamp"))
        .where(F.col("height") > 0)
    )


def recent_snapshots(snapshots: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    """Snapshots with ``timestamp >= now - hours``, oldest first."""
    return snapshots.where(F.col("timestamp_ms") >= F.lit(now_ms - hours * K.HOUR_MS)).orderBy("timestamp_ms", "height")


def all_snapshots(snapshots: DataFrame) -> DataFrame:
    """Every snapshot, oldest first."""
    return snapshots.orderBy("timestamp_ms", "height")


def snapshot_summary(snapshots: DataFrame, enough: int = 5) -> DataFrame:
    """Per sample type and overall (``sample_type = 'all'``): points, min/max/avg power,
    points with power > 0 and whether there are enough points."""
    aggs = [
        F.count(F.lit(1)).alias("points"),
        F.min("maximal_power").alias("min_power"),
        F.max("maximal_power").alias("max_power"),
        exact_mean("maximal_power").alias("avg_power"),
        F.count(F.when(F.col("maximal_power") > 0, F.lit(1))).alias("positive_points"),
    ]
    per_type = snapshots.groupBy("sample_type").agg(*aggs)
    overall = snapshots.agg(*aggs).select(F.lit("all").alias("sample_type"), "*")
    return per_type.unionByName(overall).withColumn("enough", F.col("points") > enough)


def upsert_snapshots(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """K5: last writer wins per height (ordered by ``created_at``, then the other columns)."""
    both = current.unionByName(incoming.select(*current.columns))
    cols = [c for c in current.columns if c != "height"]
    latest = both.groupBy("height").agg(
        F.max_by(F.struct(*cols), F.struct(F.col("created_at"), *[F.col(c) for c in cols])).alias("__r")
    )
    return latest.select("height", *[F.col(f"__r.{c}").alias(c) for c in cols])


# ---------------------------------------------------------------- T7: realtime snapshot throttle

THROTTLE_SCHEMA = T.StructType(
    [
        T.StructField("instance", T.StringType()),
        T.StructField("height", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("maximal_power", T.LongType()),
    ]
)


def _greedy(pdf: pd.DataFrame, last_kept: int | None, gap_ms: int) -> tuple[pd.DataFrame, int | None]:
    """Keep a row when no kept row lies within ``gap_ms`` before it (time order, ties by height)."""
    pdf = pdf.sort_values(["timestamp_ms", "height"], kind="mergesort")
    keep = []
    for ts in pdf["timestamp_ms"].to_numpy():
        ok = last_kept is None or ts - last_kept > gap_ms
        keep.append(ok)
        if ok:
            last_kept = int(ts)
    return pdf[keep], last_kept


def snapshot_throttle(snapshots: DataFrame, gap_ms: int = K.SNAPSHOT_THROTTLE_MS, instance: str | None = None) -> DataFrame:
    """T7 (batch): realtime snapshots kept by the hourly throttle, per chain instance.

    The rule is greedy and sequential in time, so each instance is one group for
    ``applyInPandas``; the group holds only that instance's *realtime* snapshots, whose number is
    bounded by elapsed time (at most one per block), not by the report volume.
    """
    ship_package(snapshots.sparkSession)
    rt = snapshots.where(F.col("sample_type") == "realtime").select(
        (F.col(instance) if instance else F.lit("default")).alias("instance"), "height", "timestamp_ms", "maximal_power"
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, _ = _greedy(pdf, None, gap_ms)
        return kept[["instance", "height", "timestamp_ms", "maximal_power"]]

    return rt.groupBy("instance").applyInPandas(run, THROTTLE_SCHEMA)


def snapshot_throttle_stream(stream: DataFrame, gap_ms: int = K.SNAPSHOT_THROTTLE_MS) -> DataFrame:
    """T7 (stream): same rule with ``applyInPandasWithState``; state = last kept time per instance.

    Equals the batch result when snapshots arrive in time order (append mode, no timeout).
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship_package(stream.sparkSession)
    rt = stream.where(F.col("sample_type") == "realtime").select(
        F.lit("default").alias("instance"), "height", "timestamp_ms", "maximal_power"
    )

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in pdfs:
            kept, last = _greedy(pdf, last, gap_ms)
            if len(kept):
                yield kept[["instance", "height", "timestamp_ms", "maximal_power"]]
        if last is not None:
            state.update((last,))

    return rt.groupBy("instance").applyInPandasWithState(
        run, THROTTLE_SCHEMA, "last_kept long", "append", GroupStateTimeout.NoTimeout
    )

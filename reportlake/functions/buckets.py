"""Time buckets: spec (D18), bucket id (D17), labels (D21), dense bucket frame.

All epoch arithmetic is done on longs (milliseconds), independent of the session time zone; labels
are rendered in UTC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions.core import col_, idiv


@dataclass(frozen=True)
class BucketSpec:
    timeframe: str
    interval_ms: int
    n: int
    now_ms: int

    @property
    def start_ms(self) -> int:
        return self.now_ms - self.n * self.interval_ms


def bucket_spec(timeframe: str, now_ms: int, resolution: str = "fine") -> BucketSpec:
    """Timeframe (``24h|7d|30d``) x resolution (``fine|medium|coarse``) -> buckets ending at now."""
    interval_ms, n = K.BUCKET_SPECS[timeframe][resolution]
    return BucketSpec(timeframe, interval_ms, n, now_ms)


def time_range(df: DataFrame, lo_ms: int | None, hi_ms: int | None, ts: str = "TIMESTAMP") -> Column:
    """``lo <= ts < hi`` (either bound optional); on a table stored by ``day`` (UTC days of ``ts``) the
    equivalent day bounds are added so that Spark prunes whole day folders before reading."""
    t = F.col(ts)
    cond = F.lit(True)
    if lo_ms is not None:
        cond = cond & (t >= F.lit(lo_ms))
    if hi_ms is not None:
        cond = cond & (t < F.lit(hi_ms))
    if "day" in df.columns:
        if lo_ms is not None:
            cond = cond & (F.col("day") >= F.lit(lo_ms // K.DAY_MS))
        if hi_ms is not None:
            cond = cond & (F.col("day") <= F.lit((hi_ms - 1) // K.DAY_MS))
    return cond


def in_window(spec: BucketSpec, ts: str | Column = "TIMESTAMP", df: DataFrame | None = None) -> Column:
    """``start <= ts < now`` (with day pruning when ``df`` is stored by day)."""
    if df is not None and isinstance(ts, str):
        return time_range(df, spec.start_ms, spec.now_ms, ts)
    ts = col_(ts)
    return (ts >= F.lit(spec.start_ms)) & (ts < F.lit(spec.now_ms))


def bucket_id(spec: BucketSpec, ts: str | Column = "TIMESTAMP") -> Column:
    """``(ts - start) div interval`` (the window keeps ts >= start, so this is the floor)."""
    return idiv(col_(ts) - F.lit(spec.start_ms), spec.interval_ms)


def time_label(spec: BucketSpec, bucket: str | Column = "bucket_id") -> Column:
    """Bucket start in UTC as ``HH:mm`` (24h), ``MM/dd HH:mm`` (7d) or ``MM/dd`` (30d)."""
    start = F.lit(spec.start_ms) + col_(bucket).cast("long") * F.lit(spec.interval_ms)
    # date_from_unix_date is zone-free; formatting a DATE round-trips in any session zone
    day = F.date_format(F.date_from_unix_date(idiv(start, K.DAY_MS).cast("int")), "MM/dd")
    hh = F.lpad((idiv(start, K.HOUR_MS) % 24).cast("string"), 2, "0")
    mm = F.lpad((idiv(start, K.MINUTE_MS) % 60).cast("string"), 2, "0")
    hhmm = F.concat(hh, F.lit(":"), mm)
    fmt = K.LABEL_FORMATS[spec.timeframe]
    if fmt == "HH:mm":
        return hhmm
    if fmt == "MM/dd":
        return day
    return F.concat(day, F.lit(" "), hhmm)


def bucket_frame(spark: SparkSession, spec: BucketSpec) -> DataFrame:
    """The dense bucket ids ``0..n-1`` (n <= 48: broadcast-sized by construction)."""
    return spark.range(0, spec.n, 1, numPartitions=1).select(F.col("id").alias("bucket_id"))

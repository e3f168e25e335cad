"""Bucketed time series: histogram (A10), keyed top-k series (A11, A12, A17-A20) and the
reporter activity series (A22, flagship) with network power carried forward (D19, D20).

Plan shape (all keyed series): one filtered scan -> top-k ranking (TakeOrdered, <= k rows) ->
``left_semi`` of the rows against the broadcast top-k -> one ``groupBy(key, bucket)`` with map-side
partial aggregation -> left join onto the dense grid ``top-k x 0..n-1`` (generated by ``explode``
of a ``sequence``; <= k*n rows, bounded by the parameters, never by the data). Nothing is collected.
Series are returned long ``(key, bucket_id, ...)`` so results are order-free rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions.buckets import BucketSpec, bucket_frame, bucket_id, in_window, time_label
from reportlake.functions.casts import to_double
from reportlake.functions.core import exact_mean
from reportlake.functions.metrics import deviation_pct, query_display_name, reporter_display_name
from reportlake.operators.blocks import block_index_of, safe_block_predicate

TS = "TIMESTAMP"


def _windowed(reports: DataFrame, spec: BucketSpec, safe: bool, safe_source: DataFrame | None = None) -> DataFrame:
    rows = reports.where(in_window(spec, df=reports))
    if safe:
        rows = rows.where(safe_block_predicate(safe_source if safe_source is not None else reports))
    return rows.withColumn("bucket_id", bucket_id(spec))


def _dense(spec: BucketSpec, keys: DataFrame) -> DataFrame:
    """Grid ``keys x 0..n-1`` by ``explode(sequence)``: bounded by k*n rows."""
    return keys.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spec.n - 1).cast("long"))).alias("bucket_id"))


def top_keys(rows: DataFrame, key: str, k: int, count_name: str = "total_count") -> DataFrame:
    """Top ``k`` keys by row count (ties by key), as a TakeOrdered of at most ``k`` rows."""
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.col(count_name).desc(), F.col(key).asc())
        .limit(k)
    )


def reports_histogram(reports: DataFrame, spec: BucketSpec, safe: bool = False) -> DataFrame:
    """A10: reports per bucket, empty buckets 0 (the original applies no safe filter)."""
    counts = _windowed(reports, spec, safe).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("count"))
    frame = bucket_frame(reports.sparkSession, spec)
    return frame.join(F.broadcast(counts), "bucket_id", "left").select(
        "bucket_id",
        (F.lit(spec.start_ms) + F.col("bucket_id") * spec.interval_ms).alias("bucket_start_ms"),
        time_label(spec).alias("time_label"),
        F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count"),
    )


def keyed_series(
    reports: DataFrame,
    spec: BucketSpec,
    key: str,
    aggs: Mapping[str, Column],
    fill: Mapping[str, Column | None],
    top_n: int,
    rank_filter: Column | None = None,
    series_filter: Column | None = None,
    safe_rank: bool = True,
    safe_series: bool = True,
) -> DataFrame:
    """Top ``top_n`` keys in the window, each with a dense series of ``aggs`` per bucket.

    ``rank_filter`` restricts the rows that rank keys, ``series_filter`` the rows aggregated into the
    series. ``fill`` gives the value of an empty bucket per aggregate (None keeps NULL).
    """
    ranked_rows = _windowed(reports, spec, safe_rank, reports)
    if rank_filter is not None:
        ranked_rows = ranked_rows.where(rank_filter)
    top = top_keys(ranked_rows, key, top_n)
    series_rows = _windowed(reports, spec, safe_series, reports)
    if series_filter is not None:
        series_rows = series_rows.where(series_filter)
    series_rows = series_rows.join(F.broadcast(top.select(key)), key, "left_semi")
    per_bucket = series_rows.groupBy(key, "bucket_id").agg(*[agg.alias(name) for name, agg in aggs.items()])
    grid = _dense(spec, F.broadcast(top))
    out = grid.join(per_bucket, [key, "bucket_id"], "left")
    cols = [F.col(key), F.col("total_count"), F.col("bucket_id"), time_label(spec).alias("time_label")]
    for name in aggs:
        default = fill.get(name)
        cols.append(F.coalesce(F.col(name), default).alias(name) if default is not None else F.col(name))
    return out.select(*cols)


def _with_query_names(series: DataFrame, mappings: DataFrame | None) -> DataFrame:
    if mappings is None:
        return series.withColumn("short_name", query_display_name("QUERY_ID", F.lit(None).cast("string")))
    names = mappings.select(F.col("query_id").alias("QUERY_ID"), F.col("name").alias("__name"))
    # the mapping dimension has one row per query id; broadcast under Spark's size threshold
    return series.join(names, "QUERY_ID", "left").withColumn(
        "short_name", query_display_name("QUERY_ID", "__name")
    ).drop("__name")


def query_series(reports: DataFrame, spec: BucketSpec, mappings: DataFrame | None = None,
                 top_n: int = K.TOP_SERIES_QUERIES) -> DataFrame:
    """Top query ids in the window (safe filter), report counts per bucket, gaps 0."""
    s = keyed_series(
        reports, spec, "QUERY_ID",
        aggs={"count": F.count(F.lit(1))}, fill={"count": F.lit(0).cast("long")}, top_n=top_n,
    )
    return _with_query_names(s, mappings)


def reporter_series(reports: DataFrame, spec: BucketSpec, registry: DataFrame | None = None,
                    top_n: int = K.TOP_SERIES_REPORTERS, safe_series: bool = False) -> DataFrame:
    """Top reporters (ranked with the safe filter), counts per bucket (series without it)."""
    s = keyed_series(
        reports, spec, "REPORTER",
        aggs={"count": F.count(F.lit(1))}, fill={"count": F.lit(0).cast("long")}, top_n=top_n,
        safe_series=safe_series,
    )
    if registry is None:
        return s.withColumn("display_name", reporter_display_name("REPORTER", F.lit(None).cast("string")))
    names = registry.select(F.col("address").alias("REPORTER"), F.col("moniker").alias("__moniker"))
    return s.join(names, "REPORTER", "left").withColumn(
        "display_name", reporter_display_name("REPORTER", "__moniker")
    ).drop("__moniker")


def agreement_series(reports: DataFrame, spec: BucketSpec, mappings: DataFrame | None = None,
                     top_n: int = K.TOP_SERIES_QUERIES) -> DataFrame:
    """Ids ranked over rows with a non-zero trusted value; mean deviation % per bucket, gaps NULL."""
    v, t = to_double("VALUE"), to_double("TRUSTED_VALUE")
    s = keyed_series(
        reports, spec, "QUERY_ID",
        aggs={"avg_deviation": F.avg(deviation_pct(v, t))}, fill={}, top_n=top_n,
        rank_filter=t.isNotNull() & (t != 0),
    )
    return _with_query_names(s, mappings)


def _latest(reports: DataFrame, series: DataFrame, spot: Column, **values: Column) -> DataFrame:
    """Most recent numeric value of each kind per query id of ``series`` over all time (ties by TX_HASH), safe filter
    on: one aggregation of the rows of the ids shown (``top_n`` at most, broadcast)."""
    shown = F.broadcast(series.select("QUERY_ID").distinct())
    rows = reports.where(spot & safe_block_predicate(reports)).join(shown, "QUERY_ID", "left_semi")
    at = F.struct(TS, "TX_HASH")
    return rows.groupBy("QUERY_ID").agg(*[F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in values.items()])


def value_series(reports: DataFrame, spec: BucketSpec, mappings: DataFrame | None = None,
                 top_n: int = K.TOP_VALUE_QUERIES, column: str = "VALUE") -> DataFrame:
    """A18 (A19 with ``column='TRUSTED_VALUE'``): SpotPrice ids, mean numeric value per bucket, gaps NULL,
    plus the most recent value of each id."""
    spot = F.col("QUERY_TYPE") == "SpotPrice"
    x = to_double(column)
    s = keyed_series(
        reports, spec, "QUERY_ID",
        aggs={"avg_value": exact_mean(x)}, fill={}, top_n=top_n,
        rank_filter=spot, series_filter=spot & x.isNotNull(),
    )
    return _with_query_names(s.join(_latest(reports, s, spot, most_recent_value=x), "QUERY_ID", "left"), mappings)


def overlay_series(reports: DataFrame, spec: BucketSpec, mappings: DataFrame | None = None,
                   top_n: int = K.TOP_VALUE_QUERIES) -> DataFrame:
    """Both series (reported and trusted) and both latest values per SpotPrice id."""
    spot = F.col("QUERY_TYPE") == "SpotPrice"
    v, t = to_double("VALUE"), to_double("TRUSTED_VALUE")
    s = keyed_series(
        reports, spec, "QUERY_ID",
        aggs={"avg_value": exact_mean(v), "avg_trusted_value": exact_mean(t)}, fill={}, top_n=top_n,
        rank_filter=spot, series_filter=spot,
    )
    latest = _latest(reports, s, spot, most_recent_value=v, most_recent_trusted_value=t)
    return _with_query_names(s.join(latest, "QUERY_ID", "left"), mappings)


def network_power_series(snapshots: DataFrame, spec: BucketSpec) -> DataFrame:
    """Last snapshot per bucket (time order), carried forward, 0 before the first one.

    Input rows are snapshots in ``start <= ts <= now``; the carried series has ``n`` rows, so the
    final window (no partition key) runs over at most ``n`` rows by construction.
    """
    ts = F.col("timestamp_ms")
    b = bucket_id(spec, ts)
    snaps = snapshots.where((ts >= spec.start_ms) & (ts <= spec.now_ms)).select(
        b.alias("bucket_id"), ts, "height", F.coalesce(F.col("maximal_power"), F.lit(0).cast("long")).alias("p")
    ).where((F.col("bucket_id") >= 0) & (F.col("bucket_id") < spec.n))
    last = snaps.groupBy("bucket_id").agg(F.max_by("p", F.struct("timestamp_ms", "height")).alias("p"))
    frame = bucket_frame(snapshots.sparkSession, spec)
    dense = frame.join(F.broadcast(last), "bucket_id", "left")
    w = Window.orderBy("bucket_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.coalesce(F.last("p", ignorenulls=True).over(w), F.lit(0).cast("long"))
    return dense.select("bucket_id", carried.alias("maximal_power_network"))


def activity_series(reports: DataFrame, spec: BucketSpec, snapshots: DataFrame | None = None,
                    safe: bool = True, approx: bool = False) -> DataFrame:
    """A22 (flagship): per bucket distinct reporters, reports and the median block power, with the
    network power series (D20) and whether any of it is positive.

    The median of POWER_OF_AGGR over the rows of a bucket equals the median over its blocks weighted
    by their row counts (all rows of a block share the value and every filter here is on the block
    timestamp), so the rows are first reduced to one row per block and Spark's exact ``percentile``
    runs with a frequency column: nothing of the size of the data reaches a single task.
    ``approx=True`` counts distinct reporters with HyperLogLog++ (one aggregation level less).
    """
    rows = _windowed(reports, spec, safe)
    index = block_index_of(reports)
    if index is not None:  # stored table: the block index already holds rows and power per block
        blocks_in = index.where(in_window(spec))
        if safe:
            blocks_in = blocks_in.where(safe_block_predicate(reports))
        per_block = blocks_in.select(TS, F.col("rows").alias("n"), F.col("POWER_OF_AGGR").alias("poa"))
    else:
        per_block = rows.groupBy(TS).agg(F.count(F.lit(1)).alias("n"), F.sum("POWER").cast("long").alias("poa"))
    per_block = per_block.withColumn("bucket_id", bucket_id(spec))
    power = per_block.groupBy("bucket_id").agg(
        F.sum("n").alias("total_reports"),
        F.percentile(F.coalesce(F.col("poa"), F.lit(0).cast("long")), F.lit(0.5), F.col("n")).alias(
            "representative_power_of_aggr"
        ),
    )
    distinct = F.approx_count_distinct("REPORTER") if approx else F.countDistinct("REPORTER")
    active = rows.groupBy("bucket_id").agg(distinct.alias("active_reporters"))
    frame = bucket_frame(reports.sparkSession, spec)
    out = frame.join(F.broadcast(active), "bucket_id", "left").join(F.broadcast(power), "bucket_id", "left")
    out = out.select(
        "bucket_id",
        time_label(spec).alias("time_label"),
        F.coalesce("active_reporters", F.lit(0).cast("long")).alias("active_reporters"),
        F.coalesce("total_reports", F.lit(0).cast("long")).alias("total_reports"),
        F.coalesce("representative_power_of_aggr", F.lit(0.0)).alias("representative_power_of_aggr"),
    )
    if snapshots is None:
        return out.withColumn("maximal_power_network", F.lit(0).cast("long")).withColumn(
            "has_maximal_power_data", F.lit(False)
        )
    net = network_power_series(snapshots, spec)
    out = out.join(net, "bucket_id", "left")
    any_w = Window.partitionBy(F.lit(0))  # n rows, bounded by the spec
    return out.withColumn("has_maximal_power_data", F.max(F.col("maximal_power_network") > 0).over(any_w))

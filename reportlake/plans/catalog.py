"""Registered queries: one per operator with a table result, each ``Inputs -> DataFrame``.

Every query reads the driver's tables through :class:`~reportlake.plans.context.Inputs` (whole
tables, no id subsets) and fixes its parameters explicitly (``now_ms`` = ``Inputs.now_ms``).
The SQL twins live in :mod:`reportlake.plans.oracle` under the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake import sinks
from reportlake.functions import metrics
from reportlake.functions.buckets import bucket_spec
from reportlake.functions.casts import numeric_values, to_double
from reportlake.functions.core import exact_mean, idiv
from reportlake.schema import REPORT_COLUMNS
from reportlake.operators import blocks, dedupe, filters, registry, series, snapshots, stats
from reportlake.plans.context import Inputs
from reportlake.sources import doc_writers, documents, report_files
from reportlake.sources.dirty_csv import append_bytes, write_dirty_report_csv, write_report_lines, write_report_parquet_by_file
from reportlake.sources.growing import growing_lines
from reportlake.streaming import reports as streams

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(name: str):
    def register(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = fn
        return fn

    return register


# ---------------------------------------------------------------- dedupe and block logic


@query("dedupe_reports")
def _dedupe_reports(i: Inputs) -> DataFrame:
    return i.reports


@query("power_of_aggr")
def _power_of_aggr(i: Inputs) -> DataFrame:
    return blocks.power_of_aggr(i.reports)


@query("power_of_aggr_recent")
def _power_of_aggr_recent(i: Inputs) -> DataFrame:
    return blocks.power_of_aggr_recent(i.reports)


@query("power_of_aggr_file")
def _power_of_aggr_file(i: Inputs) -> DataFrame:
    # the newest file (largest number): its rows, with sums over all files
    newest = i.reports.select(F.max_by("source_file", F.regexp_extract("source_file", r"(\d+)", 1).cast("long"))).scalar()
    return blocks.power_of_aggr_file(i.reports, newest)


@query("power_stats")
def _power_stats(i: Inputs) -> DataFrame:
    return blocks.power_stats(blocks.power_of_aggr(i.reports))


@query("safe_block_filter")
def _safe_block_filter(i: Inputs) -> DataFrame:
    return blocks.safe_block_filter(i.reports)


@query("safe_timestamp")
def _safe_timestamp(i: Inputs) -> DataFrame:
    return blocks.safe_timestamp(i.reports)


@query("block_consistency")
def _block_consistency(i: Inputs) -> DataFrame:
    return blocks.block_consistency(blocks.power_of_aggr(i.reports))


@query("first_n_per_block")
def _first_n_per_block(i: Inputs) -> DataFrame:
    return blocks.first_n_per_block(blocks.power_of_aggr(i.reports), 3)


# ---------------------------------------------------------------- series


def _register_timeframes() -> None:
    for tf in ("24h", "7d", "30d"):
        sfx = "" if tf == "24h" else f"_{tf}"

        def activity(i: Inputs, tf=tf) -> DataFrame:
            return series.activity_series(i.reports, bucket_spec(tf, i.now_ms), i.snapshots)

        def histogram(i: Inputs, tf=tf) -> DataFrame:
            return series.reports_histogram(i.reports, bucket_spec(tf, i.now_ms))

        def queries_(i: Inputs, tf=tf) -> DataFrame:
            return series.query_series(i.reports, bucket_spec(tf, i.now_ms), i.mappings)

        QUERIES[f"activity_series{sfx}"] = activity
        QUERIES[f"reports_histogram{sfx}"] = histogram
        QUERIES[f"query_series{sfx}"] = queries_


_register_timeframes()


@query("reports_histogram_24h_medium")
def _hist_medium(i: Inputs) -> DataFrame:
    return series.reports_histogram(i.reports, bucket_spec("24h", i.now_ms, "medium"))


@query("reports_histogram_30d_coarse")
def _hist_coarse(i: Inputs) -> DataFrame:
    return series.reports_histogram(i.reports, bucket_spec("30d", i.now_ms, "coarse"))


@query("reporter_series")
def _reporter_series(i: Inputs) -> DataFrame:
    return series.reporter_series(i.reports, bucket_spec("7d", i.now_ms), i.registry)


@query("agreement_series")
def _agreement_series(i: Inputs) -> DataFrame:
    return series.agreement_series(i.reports, bucket_spec("7d", i.now_ms), i.mappings).withColumn(
        "avg_deviation", F.round("avg_deviation", 6)
    )


@query("value_series")
def _value_series(i: Inputs) -> DataFrame:
    return series.value_series(i.reports, bucket_spec("7d", i.now_ms), i.mappings).withColumn(
        "avg_value", F.round("avg_value", 6)
    )


@query("trusted_value_series")
def _trusted_value_series(i: Inputs) -> DataFrame:
    return series.value_series(i.reports, bucket_spec("7d", i.now_ms), i.mappings, column="TRUSTED_VALUE").withColumn(
        "avg_value", F.round("avg_value", 6)
    )


@query("overlay_series")
def _overlay_series(i: Inputs) -> DataFrame:
    return (
        series.overlay_series(i.reports, bucket_spec("30d", i.now_ms), i.mappings)
        .withColumn("avg_value", F.round("avg_value", 6))
        .withColumn("avg_trusted_value", F.round("avg_trusted_value", 6))
    )


@query("locf_series")
def _locf_series(i: Inputs) -> DataFrame:
    return series.network_power_series(i.snapshots, bucket_spec("24h", i.now_ms))


# ---------------------------------------------------------------- statistics



@query("stats_counts")
def _stats_counts(i: Inputs) -> DataFrame:
    return stats.stats_counts(i.reports)


@query("unique_query_ids_30d")
def _unique_ids(i: Inputs) -> DataFrame:
    return stats.unique_query_ids(i.reports, i.now_ms)


@query("average_agreement")
def _average_agreement(i: Inputs) -> DataFrame:
    return stats.average_agreement(i.reports)


@query("value_stats")
def _value_stats(i: Inputs) -> DataFrame:
    return stats.value_stats(i.reports)


@query("recent_activity")
def _recent_activity(i: Inputs) -> DataFrame:
    return stats.recent_activity(i.reports)


@query("questionable_stats")
def _questionable_stats(i: Inputs) -> DataFrame:
    return stats.questionable_stats(i.reports, i.now_ms)


@query("top_reporters")
def _top_reporters(i: Inputs) -> DataFrame:
    return stats.top_reporters(i.reports)


@query("top_query_ids")
def _top_query_ids(i: Inputs) -> DataFrame:
    return stats.top_query_ids(i.reports)


@query("query_type_distribution")
def _query_types(i: Inputs) -> DataFrame:
    return stats.query_type_distribution(i.reports)


@query("queries_24h")
def _queries_24h(i: Inputs) -> DataFrame:
    return stats.queries_24h(i.reports, i.now_ms, i.mappings)


@query("power_distribution_query")
def _power_distribution_query(i: Inputs) -> DataFrame:
    return stats.power_distribution_query(i.reports, i.registry)


@query("query_block_info")
def _query_block_info(i: Inputs) -> DataFrame:
    return stats.query_block_info(i.reports)


@query("power_distribution_overall")
def _power_distribution_overall(i: Inputs) -> DataFrame:
    return stats.power_distribution_overall(i.reports, i.registry)


@query("absent_reporters")
def _absent_reporters(i: Inputs) -> DataFrame:
    return stats.absent_reporters(i.reports, i.now_ms, i.registry)


@query("reporter_tx_stats")
def _reporter_tx_stats(i: Inputs) -> DataFrame:
    return stats.reporter_tx_stats(i.reports)


# ---------------------------------------------------------------- registry


@query("active_power")
def _active_power(i: Inputs) -> DataFrame:
    return registry.active_power(i.registry, i.reports, i.now_ms)


@query("unknown_reporters")
def _unknown_reporters(i: Inputs) -> DataFrame:
    return registry.unknown_reporters(i.reports, i.supplier_registry)


@query("placeholder_reporters")
def _placeholder_reporters(i: Inputs) -> DataFrame:
    return registry.placeholder_reporters(i.reports, i.supplier_registry, i.now_ms)


@query("upsert_registry")
def _upsert_registry(i: Inputs) -> DataFrame:
    # a later dump of the building segment with refreshed power and names
    later = (
        i.registry.join(i.table("customer").select(F.concat(F.lit("reporter1"), F.lpad(F.col("c_custkey").cast("string"), 24, "0")).alias("address"), "c_mktsegment"), "address")
        .where(F.col("c_mktsegment") == "BUILDING")
        .drop("c_mktsegment")
        .withColumn("power", F.col("power") + 7)
        .withColumn("moniker", F.concat(F.col("moniker"), F.lit(" v2")))
        .withColumn("fetched_at", F.col("fetched_at") + 60000)
        .withColumn("updated_at", F.col("updated_at") + 60000)
    )
    return registry.upsert_registry(i.registry, later)


@query("reporters_page")
def _reporters_page(i: Inputs) -> DataFrame:
    return registry.reporters_page(i.registry, i.reports, sort_by="power", limit=100, offset=0)


@query("reporters_page_search")
def _reporters_page_search(i: Inputs) -> DataFrame:
    return registry.reporters_page(i.registry, i.reports, search="00001", sort_by="commission_rate", limit=50, offset=10)


@query("reporters_page_jailed")
def _reporters_page_jailed(i: Inputs) -> DataFrame:
    return registry.reporters_page(i.registry, i.reports, jailed_only=True, sort_by="last_updated", limit=1000)


@query("reporter_detail")
def _reporter_detail(i: Inputs) -> DataFrame:
    strongest = i.registry.orderBy(F.col("power").desc(), F.col("address")).limit(1).select("address").scalar()
    detail = registry.reporter_detail(i.registry, strongest)
    tx = stats.reporter_tx_stats(i.reports.where(F.col("REPORTER") == strongest)).withColumnRenamed("REPORTER", "address")
    return detail.join(tx, "address", "left")


@query("reporters_summary")
def _reporters_summary(i: Inputs) -> DataFrame:
    return registry.reporters_summary(i.registry, i.reports)


@query("top_power")
def _top_power(i: Inputs) -> DataFrame:
    return registry.top_power(i.registry)


@query("commission_distribution")
def _commission_distribution(i: Inputs) -> DataFrame:
    return registry.commission_distribution(i.registry)


@query("power_utilization")
def _power_utilization(i: Inputs) -> DataFrame:
    return registry.power_utilization(i.registry, i.reports, i.now_ms)


@query("registry_view")
def _registry_view(i: Inputs) -> DataFrame:
    return registry.registry_view(i.registry, i.reports)


# ---------------------------------------------------------------- filters, pages, search

SEARCH_TERM = "12"


def _filtered(i: Inputs) -> DataFrame:
    return filters.filter_reports(i.reports, i.now_ms, reporter="0001", query_type="SpotPrice", min_value=10.0, max_value=50.0)


@query("filter_reports")
def _filter_reports(i: Inputs) -> DataFrame:
    return _filtered(i)


@query("filter_questionable")
def _filter_questionable(i: Inputs) -> DataFrame:
    return filters.filter_reports(i.reports, i.now_ms, questionable_only=True)


@query("reports_page")
def _reports_page(i: Inputs) -> DataFrame:
    return filters.reports_page(_filtered(i), limit=100, offset=200)


@query("reports_page_last")
def _reports_page_last(i: Inputs) -> DataFrame:
    # an offset past the end returns the full last page
    return filters.null_defaults(filters.reports_page(filters.filter_reports(i.reports, i.now_ms), limit=250, offset=10**9))


@query("search_reports")
def _search_reports(i: Inputs) -> DataFrame:
    return filters.search_reports(i.reports, SEARCH_TERM, limit=100, offset=50)


@query("search_count")
def _search_count(i: Inputs) -> DataFrame:
    return filters.search_count(i.reports, SEARCH_TERM, limit=100, offset=50)


@query("search_stats")
def _search_stats(i: Inputs) -> DataFrame:
    return filters.search_stats(i.reports, SEARCH_TERM)


@query("search_top_reporter")
def _search_top_reporter(i: Inputs) -> DataFrame:
    return filters.search_top(i.reports, SEARCH_TERM, "REPORTER")


@query("search_top_query")
def _search_top_query(i: Inputs) -> DataFrame:
    return filters.search_top(i.reports, SEARCH_TERM, "QUERY_ID")


@query("report_detail")
def _report_detail(i: Inputs) -> DataFrame:
    return filters.report_detail(i.reports)


# ---------------------------------------------------------------- per-row metrics


def _vt(i: Inputs) -> DataFrame:
    return numeric_values(i.reports).select("TX_HASH", "V", "T")


@query("numeric_values")
def _numeric_values(i: Inputs) -> DataFrame:
    return _vt(i)


@query("agreement_pct")
def _agreement_pct(i: Inputs) -> DataFrame:
    return _vt(i).select(
        "TX_HASH",
        F.round(metrics.agreement_pct("V", "T"), 6).alias("agreement_pct"),
        F.round(metrics.agreement_pct("V", "T", zero_is_null=True), 6).alias("agreement_pct_ui"),
    )


@query("agreement_class")
def _agreement_class(i: Inputs) -> DataFrame:
    return _vt(i).select("TX_HASH", metrics.agreement_class("V", "T").alias("agreement_class"))


@query("symmetric_agreement")
def _symmetric_agreement(i: Inputs) -> DataFrame:
    return _vt(i).select(
        "TX_HASH",
        F.round(metrics.symmetric_agreement("V", "T"), 6).alias("symmetric_agreement"),
        metrics.symmetric_class("V", "T").alias("symmetric_class"),
    )


@query("deviation_pct")
def _deviation_pct(i: Inputs) -> DataFrame:
    return _vt(i).select("TX_HASH", F.round(metrics.deviation_pct("V", "T"), 6).alias("deviation_pct"))


@query("exact_match_rate")
def _exact_match_rate(i: Inputs) -> DataFrame:
    vt = _vt(i)
    return vt.agg(exact_mean(metrics.exact_match("V", "T")).alias("exact_match_rate"))


@query("query_display_name")
def _query_display_name(i: Inputs) -> DataFrame:
    ids = i.reports.select("QUERY_ID").distinct()
    names = i.mappings.select(F.col("query_id").alias("QUERY_ID"), "name")
    return ids.join(names, "QUERY_ID", "left").select("QUERY_ID", metrics.query_display_name("QUERY_ID", "name").alias("short_name"))


@query("reporter_display_name")
def _reporter_display_name(i: Inputs) -> DataFrame:
    reps = i.reports.select("REPORTER").distinct()
    names = i.registry.select(F.col("address").alias("REPORTER"), "moniker")
    return reps.join(names, "REPORTER", "left").select(
        "REPORTER", metrics.reporter_display_name("REPORTER", "moniker").alias("display_name")
    )


@query("questionable")
def _questionable(i: Inputs) -> DataFrame:
    from reportlake import constants as K

    return i.reports.where(metrics.questionable(i.now_ms)).select(
        "TX_HASH", "TIMESTAMP", metrics.questionable(i.now_ms, K.URGENT_WINDOW_MS).alias("urgent")
    )


# ---------------------------------------------------------------- sources and sinks


_LANDED: dict[tuple, str] = {}


def landed_csv(i: Inputs) -> str:
    """The raw reports landed once per session as untidy CSV files (derived from ``events``)."""
    key = (i.spark.sparkContext.applicationId, i.sf_dir)
    if key not in _LANDED:
        path = i.scratch("csv")
        write_dirty_report_csv(i.raw_reports, path)
        _LANDED[key] = path
    return _LANDED[key]


@query("csv_roundtrip")
def _csv_roundtrip(i: Inputs) -> DataFrame:
    raw = report_files.read_reports(i.spark, landed_csv(i))
    return dedupe.dedupe_reports(raw)


@query("load_inventory")
def _load_inventory(i: Inputs) -> DataFrame:
    path = landed_csv(i)
    files = report_files.list_report_files(i.spark, path)
    raw = report_files.read_reports(i.spark, path)
    return sinks.load_inventory(files, dedupe.dedupe_reports(raw)).drop("size_mb")


@query("instance_scan")
def _instance_scan(i: Inputs) -> DataFrame:
    """The raw reports landed as two chains' folders, read in one scan and told apart by folder."""
    path = i.scratch("instances")
    chain = F.when(F.col("QUERY_TYPE") == "SpotPrice", "main").otherwise("test")
    for name in ("main", "test"):
        write_dirty_report_csv(i.raw_reports.where(chain == name), f"{path}/source_tables_{name}")
    raw = report_files.read_reports(i.spark, path, with_instance=True)
    return raw.groupBy("instance").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("TX_HASH").alias("hashes"), F.sum("POWER").cast("long").alias("power"))


@query("malformed_rows")
def _malformed_rows(i: Inputs) -> DataFrame:
    """Headerless lines of uneven width: every third row lacks its last cell, every third has 30 more."""
    path = i.scratch("uneven")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REPORT_COLUMNS]
    kind = F.col("line_no") % 3
    line = F.when(kind == 0, F.concat_ws(",", *cells[:-1])).when(kind == 1, F.concat_ws(",", *cells, F.repeat(F.lit("x,"), 29))).otherwise(F.concat_ws(",", *cells))
    i.raw_reports.select(line.alias("value")).write.text(f"{path}/source_file=table_1.csv")
    raw = report_files.project_lines(report_files.line_columns(i.spark.read.format("text").load(path)))
    return raw.select("TX_HASH", "POWER", "VALUE", "DISPUTABLE", "source_file")


@query("load_totals")
def _load_totals(i: Inputs) -> DataFrame:
    path = landed_csv(i)
    files = report_files.list_report_files(i.spark, path)
    inventory = sinks.load_inventory(files, dedupe.dedupe_reports(report_files.read_reports(i.spark, path)))
    return sinks.load_totals(inventory).drop("active_size_mb")  # the landed files' sizes are Spark's


@query("parse_block_header")
def _parse_block_header(i: Inputs) -> DataFrame:
    """The block headers of all snapshots, dumped as text and parsed back."""
    time = F.concat(F.date_format(F.date_from_unix_date(idiv("timestamp_ms", 86400000).cast("int")), "yyyy-MM-dd"), F.lit("T"),
                    *[x for k, (unit, n, end) in enumerate(((3600000, 24, ":"), (60000, 60, ":"), (1000, 60, ".000000000Z")))
                      for x in (F.lpad((idiv("timestamp_ms", unit) % n).cast("string"), 2, "0"), F.lit(end))])
    dump = F.concat(F.lit("header:\n  height: \""), F.col("height").cast("string"), F.lit("\"\n  time: \""), time, F.lit("\"\n"))
    return i.snapshots.select("height", documents.parse_block_header(dump).alias("b")).select(
        "height", F.col("b.height").alias("parsed_height"), F.col("b.time_ms").alias("time_ms")
    )


@query("loaded_files")
def _loaded_files(i: Inputs) -> DataFrame:
    return report_files.loaded_files(i.reports)


@query("classify_files")
def _classify_files(i: Inputs) -> DataFrame:
    files = report_files.list_report_files(i.spark, landed_csv(i))
    return report_files.classify_files(files, keep_historical=20).select("filename", "file_number", "type", "skipped")


@query("append_new_rows")
def _append_new_rows(i: Inputs) -> DataFrame:
    num = dedupe.file_number("source_file")
    newest = i.raw_reports.select(F.max(num)).scalar()
    second = i.raw_reports.where(num < newest).select(F.max(num)).scalar()
    stored = dedupe.dedupe_reports(i.raw_reports.where(num < newest))
    incoming = i.raw_reports.where(num >= second)  # the two newest files are re-read
    return dedupe.append_new_rows(stored, incoming)


def _appended_store(i: Inputs) -> str:
    """A store of all reports but every second row of the newest block, then appended with those."""
    path = i.scratch("store")
    newest = i.raw_reports.select(F.max("TIMESTAMP")).scalar()
    late = (F.col("TIMESTAMP") == newest) & (F.col("line_no") % 2 == 1)
    first = dedupe.dedupe_reports(i.raw_reports.where(F.coalesce(~late, F.lit(True))))
    sinks.ingest_reports(first, f"{path}/reports")
    sinks.rebuild_index(i.spark, path)
    sinks.append_to_store(i.spark, path, i.raw_reports)
    return path


@query("append_to_store")
def _append_to_store(i: Inputs) -> DataFrame:
    return sinks.open_store(i.spark, _appended_store(i))


@query("power_of_aggr_after_append")
def _power_of_aggr_after_append(i: Inputs) -> DataFrame:
    stored = sinks.open_store(i.spark, _appended_store(i))
    return blocks.power_of_aggr(stored).groupBy("TIMESTAMP").agg(
        F.max("POWER_OF_AGGR").alias("POWER_OF_AGGR"), F.count(F.lit(1)).alias("rows")
    ).where(F.col("TIMESTAMP").isNotNull())


@query("replace_file_partition")
def _replace_file_partition(i: Inputs) -> DataFrame:
    path = i.scratch("table")
    base = i.reports.withColumn("POWER_OF_AGGR", F.lit(None).cast("long"))
    sinks.write_report_table(base, path)
    newest = i.reports.select(F.max_by("source_file", dedupe.file_number("source_file"))).scalar()
    recomputed = blocks.power_of_aggr(i.reports).where(F.col("source_file") == newest)
    sinks.replace_file_partition(recomputed.select(*base.columns), path)
    return sinks.read_report_table(i.spark, path).select(*base.columns)


# ---------------------------------------------------------------- snapshots


@query("network_power_at_height")
def _network_power_at_height(i: Inputs) -> DataFrame:
    from reportlake.functions.core import idiv

    dumps = i.raw_reports.select(idiv("TIMESTAMP", 6000).alias("height"), F.col("POWER").cast("string").alias("power"))
    return snapshots.network_power_at_height(dumps.where(F.col("height").isNotNull()))


@query("height_grid")
def _height_grid(i: Inputs) -> DataFrame:
    end = i.snapshots.select(F.max("height")).scalar()
    return snapshots.height_grid(i.spark, end, days=30)


@query("skip_existing_heights")
def _skip_existing_heights(i: Inputs) -> DataFrame:
    end = i.snapshots.select(F.max("height")).scalar()
    grid = snapshots.height_grid(i.spark, end, days=30, interval=100)
    return dedupe.skip_existing(grid, i.snapshots.select("height"))


@query("estimate_height_time")
def _estimate_height_time(i: Inputs) -> DataFrame:
    newest = i.snapshots.select(F.max_by(F.struct("height", "timestamp_ms"), "height")).scalar()
    return snapshots.estimate_height_time(i.spark, newest.getField("height"), newest.getField("timestamp_ms") / 1000.0)


@query("recent_snapshots")
def _recent_snapshots(i: Inputs) -> DataFrame:
    return snapshots.recent_snapshots(i.snapshots, i.now_ms, 24)


@query("all_snapshots")
def _all_snapshots(i: Inputs) -> DataFrame:
    return snapshots.all_snapshots(i.snapshots)


@query("snapshot_summary")
def _snapshot_summary(i: Inputs) -> DataFrame:
    return snapshots.snapshot_summary(i.snapshots)


@query("upsert_snapshot")
def _upsert_snapshot(i: Inputs) -> DataFrame:
    # a later pass re-measures the realtime heights
    later = (
        i.snapshots.where(F.col("sample_type") == "realtime")
        .withColumn("maximal_power", F.col("maximal_power") + 1)
        .withColumn("created_at", F.col("created_at") + 1000)
    )
    return snapshots.upsert_snapshots(i.snapshots, later)


@query("snapshot_throttle")
def _snapshot_throttle(i: Inputs) -> DataFrame:
    return snapshots.snapshot_throttle(i.snapshots)


# ---------------------------------------------------------------- streams (T1-T5, T8, T10), run availableNow


def _landed_parquet(i: Inputs) -> str:
    key = (i.spark.sparkContext.applicationId, i.sf_dir, "parquet")
    if key not in _LANDED:
        path = i.scratch("landed")
        write_report_parquet_by_file(i.reports, path)
        _LANDED[key] = path
    return _LANDED[key]


# the landed files hold whole days in no order and are read in one batch: blocks close as soon as a newer one is seen
AT_ONCE = "1 millisecond"


def _run_stream(i: Inputs, name: str, frame: DataFrame, mode: str = "append") -> DataFrame:
    out, ck = i.scratch(f"{name}-out"), i.scratch(f"{name}-ck")
    q = streams.run_to_table(frame, out, ck, mode)
    q.awaitTermination()
    return i.spark.read.parquet(out)


#: Micro-batches of the ingest queries; each lands its files and runs the query from its checkpoint.
STEPS = 4


def _ingested(i: Inputs, name: str, step) -> str:
    """The table of an ingest query that gets the raw reports in STEPS micro-batches, in ascending ``step``."""
    source, table, ck, shares = (i.scratch(f"{name}-{x}") for x in ("csv", "table", "ck", "shares"))
    # the shares are cut once; each step reads its own
    dealt = i.raw_reports.withColumn("__step", step.cast("int"))
    dealt.write.partitionBy("__step").parquet(shares)
    cut = i.spark.read.schema(dealt.schema).parquet(shares)
    for k in range(STEPS):
        write_dirty_report_csv(cut.where(F.col("__step") == k).drop("__step"), f"{source}/step={k}")
        streams.ingest_stream(i.spark, source, table, ck, slot_keys=1 << 10).awaitTermination()
    return table


def _step(i: Inputs):
    """Ascending file numbers in STEPS shares of the days."""
    day = idiv(dedupe.file_number("source_file"), 86400)
    span = i.raw_reports.select(F.struct(F.min(day).alias("low"), F.max(day).alias("high"))).scalar()
    low, high = span.getField("low"), span.getField("high")
    return F.call_function("div", (day - low) * STEPS, high - low + 1)


@query("stream_dedupe")
def _stream_dedupe(i: Inputs) -> DataFrame:
    return streams.read_ingested(i.spark, _ingested(i, "dedupe", _step(i)))


@query("late_block_power")
def _late_block_power(i: Inputs) -> DataFrame:
    """Rows of every fifth group of 50 arrive in the last micro-batch, whatever the age of their blocks."""
    step = F.when(idiv("line_no", 50) % 5 == 0, F.lit(STEPS - 1)).otherwise(_step(i))
    return streams.read_ingested_blocks(i.spark, _ingested(i, "late", step))


@query("stream_growing_file")
def _stream_growing_file(i: Inputs) -> DataFrame:
    """All raw reports as one file that grows three times; each time the stream reads what is new."""
    text, folder, table, ck = (i.scratch(f"growing-{x}") for x in ("text", "csv", "table", "ck"))
    write_report_lines(i.raw_reports, text)
    for k in range(3):
        append_bytes(text, f"{folder}/table_1.csv", (k, 3), (",".join(REPORT_COLUMNS) + "\n").encode())
        lines = growing_lines(i.spark, folder, part_bytes=1 << 18)
        streams.ingest_stream(i.spark, lines, table, ck).awaitTermination()
    return streams.read_ingested(i.spark, table).drop("source_file")


@query("complete_blocks")
def _complete_blocks(i: Inputs) -> DataFrame:
    return _run_stream(i, "blocks", streams.complete_blocks(streams.parquet_report_stream(i.spark, _landed_parquet(i)), delay=AT_ONCE))


@query("stream_histogram")
def _stream_histogram(i: Inputs) -> DataFrame:
    return _run_stream(i, "hist", streams.stream_histogram(streams.parquet_report_stream(i.spark, _landed_parquet(i)), delay=AT_ONCE))


@query("stream_questionable")
def _stream_questionable(i: Inputs) -> DataFrame:
    return _run_stream(i, "quest", streams.stream_questionable(streams.parquet_report_stream(i.spark, _landed_parquet(i)), i.now_ms))


@query("stream_bucket_activity")
def _stream_bucket_activity(i: Inputs) -> DataFrame:
    return _run_stream(i, "activity", streams.stream_bucket_activity(streams.parquet_report_stream(i.spark, _landed_parquet(i)), delay=AT_ONCE))


@query("stream_active_reporters")
def _stream_active_reporters(i: Inputs) -> DataFrame:
    return _run_stream(i, "active", streams.stream_active_reporters(streams.parquet_report_stream(i.spark, _landed_parquet(i)), delay=AT_ONCE))


def _in_steps(i: Inputs, name: str, operator) -> DataFrame:
    """A streaming operator with its own delay over reports that land in STEPS shares of ascending days. Each share is a
    micro-batch of the query, which goes on from its checkpoint and state."""
    source, out, ck = (i.scratch(f"{name}-{x}") for x in ("landed", "out", "ck"))
    rows, step = i.reports, _step(i)
    for k in range(STEPS):
        rows.where(step == k).write.mode("append").parquet(source)
        frame = operator(streams.parquet_report_stream(i.spark, source))
        streams.run_to_table(frame, out, ck).awaitTermination()
    return i.spark.read.parquet(out)


@query("complete_blocks_delayed")
def _complete_blocks_delayed(i: Inputs) -> DataFrame:
    return _in_steps(i, "blocks-steps", streams.complete_blocks)


@query("stream_histogram_delayed")
def _stream_histogram_delayed(i: Inputs) -> DataFrame:
    return _in_steps(i, "hist-steps", streams.stream_histogram)


@query("stream_bucket_activity_delayed")
def _stream_bucket_activity_delayed(i: Inputs) -> DataFrame:
    return _in_steps(i, "activity-steps", streams.stream_bucket_activity)


@query("stream_active_reporters_delayed")
def _stream_active_reporters_delayed(i: Inputs) -> DataFrame:
    return _in_steps(i, "active-steps", streams.stream_active_reporters)


# ---------------------------------------------------------------- document sources



@query("read_query_mappings")
def _read_query_mappings(i: Inputs) -> DataFrame:
    path = i.scratch("mappings")
    doc_writers.write_mapping_docs(i.mappings, i.table("events"), path)
    return documents.read_query_mappings(i.spark, path)


@query("read_registry_dump")
def _read_registry_dump(i: Inputs) -> DataFrame:
    path = i.scratch("dump-json")
    doc_writers.write_registry_json(i.registry, path)
    return documents.read_registry_json(i.spark, path, i.now_ms)


@query("read_registry_yaml")
def _read_registry_yaml(i: Inputs) -> DataFrame:
    path = i.scratch("dump-yaml")
    doc_writers.write_registry_yaml(i.registry, path)
    return documents.read_registry_yaml(i.spark, path, i.now_ms)


@query("read_power_snapshots")
def _read_power_snapshots(i: Inputs) -> DataFrame:
    path = i.scratch("snap-json")
    sinks.write_snapshots_json(i.snapshots, path)
    return documents.read_power_snapshots(i.spark, path)


@query("export_search_csv")
def _export_search_csv(i: Inputs) -> DataFrame:
    path = i.scratch("export")
    sinks.export_search_csv(filters.search_reports(i.reports, SEARCH_TERM, limit=1000), path)
    return i.spark.read.option("header", "true").schema(
        "`Query ID` string, `Reported Value` string, `Trusted Value` string, Agreement string, Reporter string, Power int, "
        "Timestamp string, Disputable string"
    ).csv(path)


@query("stream_dedupe_watermark")
def _stream_dedupe_watermark(i: Inputs) -> DataFrame:
    key = (i.spark.sparkContext.applicationId, i.sf_dir, "raw-parquet")
    if key not in _LANDED:
        path = i.scratch("landed-raw")
        write_report_parquet_by_file(i.raw_reports.drop("line_no"), path)
        _LANDED[key] = path
    frame = streams.dedupe_within_watermark(streams.parquet_report_stream(i.spark, _LANDED[key]), "1 day")
    return _run_stream(i, "dedupe-wm", frame.select("TX_HASH"))


@query("registry_refresh")
def _registry_refresh(i: Inputs) -> DataFrame:
    dumps, table, ck = i.scratch("dumps"), i.scratch("registry"), i.scratch("registry-ck")
    doc_writers.write_registry_json(i.registry, dumps)
    streams.registry_refresh_stream(i.spark, dumps, table, ck, i.now_ms).awaitTermination()
    return streams.latest_registry(i.spark, table)


@query("registry_refresh_later_dump")
def _registry_refresh_later_dump(i: Inputs) -> DataFrame:
    """Two dumps, one after the other: jailed reporters vanish from the second, which renames the others."""
    dumps, table, ck = i.scratch("dumps"), i.scratch("registry"), i.scratch("registry-ck")
    later = i.registry.where(~F.col("jailed")).withColumn("moniker", F.concat("moniker", F.lit(" II")))
    for k, dump in enumerate((i.registry, later)):
        doc_writers.write_registry_json(dump, f"{dumps}/dump={k}")
        streams.registry_refresh_stream(i.spark, dumps, table, ck, i.now_ms).awaitTermination()
    return streams.latest_registry(i.spark, table)


@query("commission_pct")
def _commission_pct(i: Inputs) -> DataFrame:
    return i.registry.select("address", "commission_rate", metrics.commission_pct("commission_rate").alias("commission_pct"))


@query("reporter_status")
def _reporter_status(i: Inputs) -> DataFrame:
    flagged = registry.with_active_flag(i.registry, i.reports)
    return flagged.select(
        "address",
        metrics.reporter_status("jailed", "power").alias("status"),
        F.when(F.col("active_24h"), F.lit("Active")).otherwise(F.lit("Inactive")).alias("activity"),
    )


@query("power_share")
def _power_share(i: Inputs) -> DataFrame:
    total = i.registry.select(F.sum("power").cast("long")).scalar()
    top = i.registry.select(F.max("power")).scalar()
    return i.registry.select(
        "address", metrics.share_pct("power", total).alias("power_share"), metrics.share_pct("power", top).alias("power_bar")
    )


@query("reporters_page_total")
def _reporters_page_total(i: Inputs) -> DataFrame:
    return registry.reporters_total(i.registry, search="00001")

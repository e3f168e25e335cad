"""Report filters, pages and search.

Filters are plain predicates, so Catalyst pushes the column comparisons into the Parquet scan.
A first page is a TakeOrdered of ``limit`` rows; a page at an offset counts the rows of the blocks, which names the blocks
it lies in, and reads their days only. Search matches literal substrings (``contains``), not LIKE patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake import constants as K
from reportlake.functions.buckets import time_range
from reportlake.functions.casts import to_double
from reportlake.functions.core import exact_mean
from reportlake.functions.metrics import exact_match, questionable, symmetric_agreement, symmetric_class
from reportlake.operators.blocks import safe_block_predicate
from reportlake.operators.ranks import page_after_rank

TS = "TIMESTAMP"


def newest_first() -> list[Column]:
    return [F.col(TS).desc_nulls_last(), F.col("TX_HASH").asc()]


def filter_reports(reports: DataFrame, now_ms: int, reporter: str | None = None, query_type: str | None = None,
                   query_id: str | None = None, min_value: float | None = None, max_value: float | None = None,
                   source_file: str | None = None, questionable_only: bool = False, safe: bool = True) -> DataFrame:
    """AND of the optional conditions, plus the safe block filter."""
    conds: list[Column] = []
    if reporter:
        conds.append(F.col("REPORTER").contains(reporter))
    if query_type:
        conds.append(F.col("QUERY_TYPE") == query_type)
    if query_id:
        conds.append(F.col("QUERY_ID").contains(query_id))
    if min_value is not None:
        conds.append(to_double("VALUE") >= F.lit(float(min_value)))
    if max_value is not None:
        conds.append(to_double("VALUE") <= F.lit(float(max_value)))
    if source_file:
        conds.append(F.col("source_file") == source_file)
    if questionable_only:
        conds.append(questionable(now_ms))
    if safe:
        conds.append(safe_block_predicate(reports))
    rows = reports
    for c in conds:
        rows = rows.where(c)
    return rows


def page_limit(limit: int) -> int:
    """A page's size: 1 to ``PAGE_MAX``; asking for more is an error, not a shorter page."""
    if limit > K.PAGE_MAX:
        raise ValueError(f"a page holds at most {K.PAGE_MAX} rows; use search_matches or filter_reports for all")
    return max(1, int(limit))


def page_offset(total: int, limit: int, offset: int) -> tuple[int, int]:
    """F2 paging rule: the last page is always full."""
    limit = page_limit(limit)
    return limit, min(int(offset), max(0, int(total) - limit))


def reports_page(filtered: DataFrame, limit: int = K.PAGE_DEFAULT, offset: int = 0, total: int | None = None) -> DataFrame:
    """newest first (TX_HASH breaks ties); runs one count job when ``total`` is not given."""
    if total is None:
        total = filtered.count()
    limit, offset = page_offset(total, limit, offset)
    return _page(filtered, offset, limit)


#: Rows of its first block that a page may skip by sorting; beyond, the row is found by rank.
SKIP_MAX = 10_000


def _page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit - 1``, newest first.

    One job counts the rows of each block (TIMESTAMP) and sums them by day, then inside the days; it gives the driver the
    blocks that the page touches, ``limit`` + 1 at most. The page itself reads their ``day`` folders only."""
    if not offset:
        return rows.orderBy(*newest_first()).limit(limit)
    per_block = rows.groupBy(TS).agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.call_function("div", F.col(TS), F.lit(86400000)))
    later_days = Window.orderBy(F.col("day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    days = per_block.groupBy("day").agg(F.sum("n").alias("m")).withColumn("later", F.coalesce(F.sum("m").over(later_days), F.lit(0)))
    days = days.where((F.col("later") < offset + limit) & (F.col("later") + F.col("m") > offset)).drop("m")
    newer = Window.partitionBy("day").orderBy(F.col(TS).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    held = per_block.join(F.broadcast(days), per_block["day"].eqNullSafe(days["day"])).drop(days["day"])  # days of a page
    held = held.withColumn("before", F.col("later") + F.coalesce(F.sum("n").over(newer), F.lit(0)))
    held = held.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).select(TS, "before").collect()
    if not held:
        return rows.limit(0)
    times = [r[TS] for r in held if r[TS] is not None]
    inside = F.col(TS).isNull() if len(times) < len(held) else F.lit(False)
    if times:
        inside = inside | time_range(rows, min(times), max(times) + 1)
    skip = offset - min(r.before for r in held)
    page = rows.where(inside)
    if skip > SKIP_MAX:
        return page_after_rank(page, newest_first(), [TS, "TX_HASH"], skip, limit)
    return page.orderBy(*newest_first()).offset(skip).limit(limit)


def null_defaults(page: DataFrame) -> DataFrame:
    """Page rows with NULL text as '', NULL numbers as 0 and NULL flags as false."""
    fills: dict[str, object] = {}
    for f in page.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            fills[f.name] = ""
        elif t in ("int", "bigint", "double", "smallint", "float"):
            fills[f.name] = 0
        elif t == "boolean":
            fills[f.name] = False
    return page.na.fill(fills)


def search_predicate(q: str) -> Column:
    """literal, case-sensitive substring of REPORTER, QUERY_ID, TX_HASH or VALUE."""
    return (
        F.col("REPORTER").contains(q)
        | F.col("QUERY_ID").contains(q)
        | F.col("TX_HASH").contains(q)
        | F.col("VALUE").contains(q)
    )


def search_matches(reports: DataFrame, q: str, safe: bool = True) -> DataFrame:
    rows = reports.where(search_predicate(q))
    return rows.where(safe_block_predicate(reports)) if safe else rows


def search_reports(reports: DataFrame, q: str, limit: int = K.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """a page of matches, newest first."""
    limit = page_limit(limit)
    return _page(search_matches(reports, q), int(offset), limit)


def search_count(reports: DataFrame, q: str, limit: int = K.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """number of matches and whether a next page exists."""
    limit = page_limit(limit)
    return search_matches(reports, q).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "has_more", F.lit(offset + limit) < F.col("total")
    )


def search_stats(reports: DataFrame, q: str) -> DataFrame:
    """one aggregate over the matches (NULL ranges when nothing matches)."""
    m = search_matches(reports, q)
    v, t = to_double("VALUE"), to_double("TRUSTED_VALUE")
    return m.agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.countDistinct("REPORTER").alias("unique_reporters"),
        F.countDistinct("QUERY_ID").alias("unique_query_ids"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        exact_mean(exact_match(v, t)).alias("avg_agreement"),
        F.min(TS).alias("oldest_timestamp"),
        F.max(TS).alias("newest_timestamp"),
        F.sum("POWER").cast("long").alias("total_power"),
    )


def search_top(reports: DataFrame, q: str, key: str) -> DataFrame:
    """the most frequent ``key`` among the matches (ties by key) and its count."""
    return (
        search_matches(reports, q)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(key).asc_nulls_last())
        .limit(1)
    )


def report_detail(reports: DataFrame, tx_hash: str | Column | None = None) -> DataFrame:
    """Reports (one by key, or all) with Yes/No flags and the symmetric agreement."""
    rows = reports
    if tx_hash is not None:
        rows = rows.where(F.col("TX_HASH") == (F.lit(tx_hash) if isinstance(tx_hash, str) else tx_hash))
    v, t = to_double("VALUE"), to_double("TRUSTED_VALUE")
    yes_no = lambda c: F.when(F.col(c), F.lit("Yes")).otherwise(F.lit("No"))
    return rows.select(
        "TX_HASH", "REPORTER", "QUERY_TYPE", "QUERY_ID", "VALUE", "TRUSTED_VALUE", "POWER", TS,
        yes_no("CYCLELIST").alias("cyclelist_text"),
        yes_no("DISPUTABLE").alias("disputable_text"),
        F.round(symmetric_agreement(v, t), 6).alias("agreement"),
        symmetric_class(v, t).alias("agreement_class"),
    )

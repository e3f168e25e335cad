"""Exact rank selection without gathering data in one task: the k-th row of an ordering.

Used for exact medians over unbounded value sets (A4, :func:`select_value`) and for pages deep in one block (F2/F3), where
a ``percentile`` buffer or a TakeOrdered of ``offset + limit`` rows would grow with the data.

Plan of :func:`select_ranks`: project the ordering keys (and a weight), range-partition them into ``P`` balanced partitions
(Spark samples the bounds), tag each row with its partition and cut the lineage with ``checkpoint()``
into the shared checkpoint folder, so the tags are fixed data (a recomputation could otherwise move
rows between partitions). Per-partition weights (``P`` rows) give each partition's first rank; only the
partition(s) holding the wanted ranks are ordered with a running-sum window. The largest task handles
one range partition, i.e. about ``1/P`` of the distinct keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.session import ensure_checkpoint_dir


def _partitioned(df: DataFrame, order: Sequence[Column], keys: Sequence[str], weight: Column | None,
                 partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    projected = df.select(*[F.col(k) for k in keys], (weight if weight is not None else F.lit(1).cast("long")).alias("__w"))
    tagged = projected.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id())
    return tagged.checkpoint(eager=True)


def select_ranks(df: DataFrame, order: Sequence[Column], keys: Sequence[str], ranks: Column,
                 weight: Column | None = None, partitions: int | None = None) -> DataFrame:
    """Rows holding the 0-based ``ranks`` (an array column, e.g. from scalar subqueries) in ``order``.

    With ``weight`` every row counts ``weight`` times (pre-aggregated values). Output: ``keys`` and
    ``rank`` (one row per requested rank that exists). ``order`` must be total over ``keys`` (unique),
    otherwise ties are broken arbitrarily.
    """
    tagged = _partitioned(df, order, keys, weight, partitions)
    counts = tagged.groupBy("__pid").agg(F.sum("__w").alias("__cnt"))  # at most P rows
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__cnt").over(before), F.lit(0).cast("long")))
    wanted = starts.select("__pid", "__start", "__cnt", F.explode(F.array_distinct(ranks)).alias("rank")).where(
        (F.col("rank") >= F.col("__start")) & (F.col("rank") < F.col("__start") + F.col("__cnt"))
    )
    local = tagged.join(F.broadcast(wanted.select("__pid", "__start", "rank")), "__pid")  # rows of target partitions
    running = Window.partitionBy("__pid", "rank").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.sum("__w").over(running)
    hit = local.withColumn("__cum", cum).where(
        (F.col("__start") + F.col("__cum") - F.col("__w") <= F.col("rank")) & (F.col("rank") < F.col("__start") + F.col("__cum"))
    )
    return hit.select(*keys, "rank")


#: Buckets of a first pass: so many for each factor e of magnitude (23 284 for all doubles at most).
_PER_E = 8
_SPLIT = 4096


def _magnitude(v: Column) -> Column:
    """An order-preserving bucket of a double: its sign and the logarithm of its magnitude, NaN last as in sorting."""
    top = F.lit(1 << 20)
    size = F.floor(F.log(F.abs(v)) * _PER_E) + (1 << 16)
    out = F.when(F.isnan(v), top + 1).when(v == float("inf"), top).when(v == float("-inf"), -top)
    return out.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def select_value(df: DataFrame, value: str | Column, p: float = 0.5, split: int = _SPLIT) -> tuple[float, float, float] | None:
    """(min, max, PERCENTILE_CONT(p)) of a double column, NULLs ignored; None without values.

    Radix selection: a pass counts the values by bucket (with each bucket's least and greatest value), the bucket that
    holds the wanted rank is the range of the next pass, which cuts it into ``split`` parts, until the bucket holds one
    value or ends at the rank. A pass is one scan whose shuffle carries bucket counts, not values, and gives the driver
    23 284 rows at most; two or three passes find the median of decimal text, six that of any doubles.
    """
    values = df.select((F.col(value) if isinstance(value, str) else value).alias("v")).where(F.col("v").isNotNull())
    bucket, rows, low = _magnitude(F.col("v")), values, None
    before, extremes, pos = 0, None, 0.0
    while True:
        found = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        parts = sorted(found.collect(), key=lambda r: r.b)
        if not parts:
            return None
        if extremes is None:
            total = sum(r.n for r in parts)
            extremes, pos = (parts[0].lo, parts[-1].hi), (total - 1) * p
        low = int(pos)
        for k, r in enumerate(parts):
            if before + r.n > low:
                break
            before += r.n
        if pos > low and before + r.n == low + 1:  # the ranks around pos lie in two buckets
            return (*extremes, r.hi + (parts[k + 1].lo - r.hi) * (pos - low))
        if r.lo == r.hi or r.lo != r.lo:
            return (*extremes, r.lo)
        width = F.lit(r.hi) - F.lit(r.lo)
        rows = values.where(F.col("v").between(r.lo, r.hi))
        bucket = F.least(F.floor((F.col("v") - r.lo) / width * split), F.lit(split - 1))


def exact_percentile(df: DataFrame, value: str | Column, p: float = 0.5, partitions: int | None = None) -> DataFrame:
    """PERCENTILE_CONT(p) of ``value`` (NULLs ignored) as a one-row frame ``percentile``, by :func:`select_value`;
    ``partitions`` is the number of parts of a pass."""
    found = select_value(df, value, p, max(2, partitions or _SPLIT))
    return df.sparkSession.createDataFrame([(found[2] if found else None,)], "percentile double")


def page_after_rank(df: DataFrame, order: Sequence[Column], keys: Sequence[str], offset: int, limit: int,
                    partitions: int | None = None) -> DataFrame:
    """Rows ``offset .. offset + limit - 1`` of ``order`` (a total order over ``keys``) for any offset:
    the row at rank ``offset`` is selected exactly, then a TakeOrdered of ``limit`` rows runs from it."""
    boundary = select_ranks(df, order, keys, F.array(F.lit(offset).cast("long")), partitions=partitions)
    b = boundary.select(F.struct(*keys).alias("b")).scalar()
    return df.where(_at_or_after(order, keys, b)).orderBy(*order).limit(limit)


def _at_or_after(order: Sequence[Column], keys: Sequence[str], b: Column) -> Column:
    """Lexicographic ``row >= boundary`` under the given sort directions and NULL placement."""
    cond = F.lit(True)
    for key, o in reversed(list(zip(keys, order))):
        text = str(o)
        desc = " DESC" in text
        nulls_last = "NULLS LAST" in text
        c, bk = F.col(key), b.getField(key)
        cmp = (c < bk) if desc else (c > bk)
        null_after = (c.isNull() & bk.isNotNull()) if nulls_last else (c.isNotNull() & bk.isNull())
        strictly = F.coalesce(cmp, F.lit(False)) | null_after
        cond = strictly | (c.eqNullSafe(bk) & cond)
    return cond

"""What the operators share: tables in the shared scratch folder, hashes, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.session import ensure_checkpoint_dir, ship_package

U64 = np.uint64
#: Bytes of rows that go to a Python worker at once. Both the JVM, outside its heap, and the worker hold a batch.
ARROW_BYTES = 4 << 20
_ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes and rereads a table: its rows survive a lost executor and aren't computed twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand rows to Python workers by ``ARROW_BYTES`` (a single row may be larger) in place of up to
    10 000 rows of any length; the session's own setting holds again afterwards."""
    before = spark.conf.get(_ARROW_KEY, None)
    spark.conf.set(_ARROW_KEY, ARROW_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ARROW_KEY)
        else:
            spark.conf.set(_ARROW_KEY, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held(df: DataFrame, expr: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once for each row: a generator of one row, which the optimizer doesn't
    merge into the expressions (and lambdas) that use the column."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def ready(spark: SparkSession) -> SparkSession:
    """Python in tasks imports this package by name."""
    ship_package(spark)
    return spark


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that hands its freed memory back to the system at the end: Spark keeps Python workers for reuse,
    beside the JVM tasks of the next stage."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def text_key(col: Column) -> Column:
    """128 bits of a text as one binary value; null and empty texts are equal."""
    return F.unhex(F.md5(F.coalesce(col, F.lit("")).cast("binary")))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components", limit: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node reachable.

    Alternates large-star and small-star steps (every node points its larger, then its smaller neighbours at its
    smallest one), O(log^2) rounds of two joins each; a node with a third of all edges is one key of a
    partially aggregated minimum and of a join that adaptive execution may split. Each round is a stored table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, name)
    seen = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(e.distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"{name}: no fixpoint after {limit} rounds")
    roots = e.groupBy(F.col("v").alias("node")).agg(F.lit(1)).select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


Query = Callable[[SparkSession, str], DataFrame]

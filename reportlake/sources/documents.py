"""Document sources: query-name mappings (S9), registry dumps (S10), power snapshot lists.

Each file is one document; many files are read in parallel and flattened with ``explode``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportlake.functions.casts import to_integral
from reportlake.schema import REGISTRY_SCHEMA

SENTINEL_TIME = "0001-01-01T00:00:00Z"  # fixed value: "no time" in registry dumps

_META = T.StructType(
    [
        T.StructField("commission_rate", T.StringType()),
        T.StructField("jailed", T.BooleanType()),
        T.StructField("jailed_until", T.StringType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("min_tokens_required", T.StringType()),
        T.StructField("moniker", T.StringType()),
    ]
)
_REPORTER = T.StructType(
    [T.StructField("address", T.StringType()), T.StructField("metadata", _META), T.StructField("power", T.StringType())]
)
DUMP_SCHEMA = T.StructType(
    [
        T.StructField("pagination", T.StructType([T.StructField("total", T.StringType())])),
        T.StructField("reporters", T.ArrayType(_REPORTER)),
    ]
)


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_query_mappings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``{query_id: name}`` JSON documents -> ``(query_id, name)``; a ``0x`` prefix is dropped.

    When several documents name the same id, the one from the greatest file path wins.
    """
    docs = spark.read.text(_paths(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("m")
    )
    pairs = docs.select("file", F.explode("m").alias("query_id", "name")).select(
        F.regexp_replace("query_id", r"^0[xX]", "").alias("query_id"), "name", "file"
    )
    return pairs.groupBy("query_id").agg(F.max_by("name", "file").alias("name"))


def _time_ms(c: Column) -> Column:
    """ISO-8601 text (up to 9 fractional digits, ``Z``) -> epoch ms; sentinel or junk -> NULL."""
    trimmed = F.regexp_replace(c, r"(\.\d{1,6})\d*", "$1")
    ts = F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"))
    return F.when(c != SENTINEL_TIME, F.unix_millis(ts))


def flatten_dump(docs: DataFrame, fetched_at: int) -> DataFrame:
    """Rows of ``reporters[]`` with the registry defaults; rows without an address are skipped."""
    r = docs.select(F.explode_outer("reporters").alias("r")).where(F.col("r.address").isNotNull())
    m = "r.metadata"
    return r.select(
        F.col("r.address").alias("address"),
        F.coalesce(F.col(f"{m}.moniker"), F.lit("")).alias("moniker"),
        F.coalesce(F.col(f"{m}.commission_rate"), F.lit("0")).alias("commission_rate"),
        F.coalesce(F.col(f"{m}.jailed"), F.lit(False)).alias("jailed"),
        _time_ms(F.col(f"{m}.jailed_until")).alias("jailed_until"),
        _time_ms(F.col(f"{m}.last_updated")).alias("last_updated"),
        F.coalesce(to_integral(F.col(f"{m}.min_tokens_required"), "long"), F.lit(0).cast("long")).alias("min_tokens_required"),
        F.coalesce(to_integral(F.col("r.power"), "int"), F.lit(0)).alias("power"),
        F.lit(fetched_at).cast("long").alias("fetched_at"),
        F.lit(fetched_at).cast("long").alias("updated_at"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in REGISTRY_SCHEMA.fields])


def parse_block_header(text: str | Column) -> Column:
    """``struct(height long, time_ms long)`` from the text dump of a block header; NULL fields where it names none."""
    c = F.col(text) if isinstance(text, str) else text
    height = F.regexp_extract(c, r"""height:\s*["']?([0-9]+)""", 1)
    time = F.regexp_extract(c, r"""time:\s*["']([^"']+)["']""", 1)
    return F.struct(F.when(height != "", height.try_cast("long")).alias("height"), _time_ms(F.when(time != "", time)).alias("time_ms"))


def read_block_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Block header dumps, one document per file: ``file, height, time_ms``."""
    docs = spark.read.text(_paths(paths), wholetext=True)
    return docs.select(F.col("_metadata.file_name").alias("file"), parse_block_header("value").alias("b")).select("file", "b.*")


def read_registry_json(spark: SparkSession, paths: str | Sequence[str], fetched_at: int) -> DataFrame:
    """S10 for JSON dumps (a file holds one document or an array of them)."""
    docs = spark.read.schema(DUMP_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(_paths(paths))
    return flatten_dump(docs, fetched_at)


def read_registry_yaml(spark: SparkSession, paths: str | Sequence[str], fetched_at: int) -> DataFrame:
    """S10 for YAML dumps: each file is parsed in its task (``mapInPandas``) into the dump schema,
    then flattened with the same Spark expressions as JSON dumps. A file holds one document or a stream of them;
    unparsable files yield no rows."""
    import yaml

    from reportlake.session import ship_package

    ship_package(spark)

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for text in pdf["value"]:
                try:
                    docs = [doc or {} for doc in yaml.safe_load_all(text)]
                except yaml.YAMLError:
                    continue
                for doc in docs:
                    reps = []
                    for r in doc.get("reporters") or []:
                        if not isinstance(r, dict):
                            continue
                        meta = r.get("metadata") or {}
                        reps.append(
                            {
                                "address": r.get("address"),
                                "power": None if r.get("power") is None else str(r.get("power")),
                                "metadata": {
                                    k: (None if meta.get(k) is None else (bool(meta[k]) if k == "jailed" else str(meta[k])))
                                    for k in _META.fieldNames()
                                },
                            }
                        )
                    total = (doc.get("pagination") or {}).get("total")
                    out.append({"pagination": {"total": None if total is None else str(total)}, "reporters": reps})
            yield pd.DataFrame(out, columns=["pagination", "reporters"])

    text = spark.read.text(_paths(paths), wholetext=True)
    return flatten_dump(text.mapInPandas(parse, DUMP_SCHEMA), fetched_at)


SNAPSHOT_DOC = T.StructType(
    [T.StructField("height", T.LongType()), T.StructField("power", T.LongType()), T.StructField("timestamp", T.DoubleType())]
)


def read_power_snapshots(spark: SparkSession, paths: str | Sequence[str], sample_type: str = "historical") -> DataFrame:
    """``[{height, power, timestamp(epoch seconds)}]`` documents -> snapshot rows (ms)."""
    rows = spark.read.schema(SNAPSHOT_DOC).option("multiLine", "true").json(_paths(paths))
    return rows.where(F.col("height").isNotNull()).select(
        "height",
        F.round(F.col("timestamp") * 1000).cast("long").alias("timestamp_ms"),
        F.col("power").alias("maximal_power"),
        F.round(F.col("timestamp") * 1000).cast("long").alias("created_at"),
        F.lit(sample_type).alias("sample_type"),
    )

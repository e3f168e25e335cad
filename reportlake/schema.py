"""Fixed schemas of the report model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: report columns in file order (headerless files are positional in this order) ---
REPORT_COLUMNS = [
    "REPORTER",
    "QUERY_TYPE",
    "QUERY_ID",
    "AGGREGATE_METHOD",
    "CYCLELIST",
    "POWER",
    "TIMESTAMP",
    "TRUSTED_VALUE",
    "TX_HASH",
    "CURRENT_TIME",
    "TIME_DIFF",
    "VALUE",
    "DISPUTABLE",
]

REPORT_TYPES: dict[str, T.DataType] = {
    "REPORTER": T.StringType(),
    "QUERY_TYPE": T.StringType(),
    "QUERY_ID": T.StringType(),
    "AGGREGATE_METHOD": T.StringType(),
    "CYCLELIST": T.BooleanType(),
    "POWER": T.IntegerType(),
    "TIMESTAMP": T.LongType(),
    "TRUSTED_VALUE": T.StringType(),
    "TX_HASH": T.StringType(),
    "CURRENT_TIME": T.LongType(),
    "TIME_DIFF": T.IntegerType(),
    "VALUE": T.StringType(),
    "DISPUTABLE": T.BooleanType(),
}

REPORT_SCHEMA = T.StructType(
    [T.StructField(c, REPORT_TYPES[c], True) for c in REPORT_COLUMNS] + [T.StructField("source_file", T.StringType(), True)]
)

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("address", T.StringType(), False),
        T.StructField("moniker", T.StringType(), True),
        T.StructField("commission_rate", T.StringType(), True),
        T.StructField("jailed", T.BooleanType(), True),
        T.StructField("jailed_until", T.LongType(), True),
        T.StructField("last_updated", T.LongType(), True),
        T.StructField("min_tokens_required", T.LongType(), True),
        T.StructField("power", T.IntegerType(), True),
        T.StructField("fetched_at", T.LongType(), True),
        T.StructField("updated_at", T.LongType(), True),
    ]
)

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("height", T.LongType(), False),
        T.StructField("timestamp_ms", T.LongType(), True),
        T.StructField("maximal_power", T.LongType(), True),
        T.StructField("created_at", T.LongType(), True),
        T.StructField("sample_type", T.StringType(), True),
    ]
)

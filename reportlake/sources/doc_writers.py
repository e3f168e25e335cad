"""Lands derived data as the documents the document sources read (mapping maps, registry dump pages,
snapshot lists). Documents are built per bounded group (an event type, a page of at most 100
reporters, a day of snapshots), never from a whole table in one task. A file of a registry dump holds up to
``FILE_PAGES`` pages: a reader lists every file through the driver, so a file a page would send it the more
the larger the registry is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.core import idiv
from reportlake.sources.documents import SENTINEL_TIME

#: Pages of about 100 reporters in a file of a registry dump, a few megabytes.
FILE_PAGES = 128


def iso_ms(ms: Column) -> Column:
    """Epoch ms -> ``yyyy-MM-ddTHH:mm:ss.fffffffffZ`` (zone-free arithmetic; 9 fractional digits)."""
    day = F.date_format(F.date_from_unix_date(idiv(ms, 86400000).cast("int")), "yyyy-MM-dd")
    part = lambda d, m: F.lpad((idiv(ms, d) % m).cast("string"), 2, "0")
    frac = F.concat(F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("000000"))
    return F.concat(day, F.lit("T"), part(3600000, 24), F.lit(":"), part(60000, 60), F.lit(":"), part(1000, 60),
                    F.lit("."), frac, F.lit("Z"))


def write_mapping_docs(mappings: DataFrame, events: DataFrame, path: str) -> None:
    """One ``{query_id: name}`` document per event type; the click ids carry a ``0x`` prefix."""
    typed = mappings.join(
        events.select(F.md5(F.concat("event_type", F.lit("-"), (F.col("event_id") % 13).cast("string"))).alias("query_id"),
                      "event_type").distinct(),
        "query_id",
    )
    key = F.when(F.col("event_type") == "click", F.concat(F.lit("0x"), "query_id")).otherwise(F.col("query_id"))
    docs = typed.groupBy("event_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, "name")))).alias("value"))
    docs.write.mode("overwrite").partitionBy("event_type").text(path)


def _dump_rows(registry: DataFrame) -> DataFrame:
    meta = F.struct(
        F.col("commission_rate"),
        F.when(F.col("jailed"), F.lit(True)).alias("jailed"),
        F.coalesce(iso_ms(F.col("jailed_until")), F.lit(SENTINEL_TIME)).alias("jailed_until"),
        F.coalesce(iso_ms(F.col("last_updated")), F.lit(SENTINEL_TIME)).alias("last_updated"),
        F.col("min_tokens_required").cast("string").alias("min_tokens_required"),
        F.col("moniker"),
    )
    # pages of about 100 reporters: hash the address into ceil(n / 100) pages
    pages = registry.select(F.greatest(F.lit(1).cast("long"), idiv(F.count(F.lit(1)) + 99, 100))).scalar()
    page = F.pmod(F.xxhash64("address"), pages)
    return registry.select(
        page.alias("page"),
        F.struct("address", meta.alias("metadata"), F.when(F.col("power") > 0, F.col("power").cast("string")).alias("power")).alias("r"),
    )


def _write_files(docs: DataFrame, path: str, separator: str, frame: tuple[str, str] = ("", "")) -> None:
    """Documents (``page, value``) as files of FILE_PAGES pages each, in one folder."""
    files = docs.groupBy(idiv("page", FILE_PAGES).alias("file")).agg(F.array_join(F.collect_list("value"), separator).alias("value"))
    text = F.concat(F.lit(frame[0]), "value", F.lit(frame[1])).alias("value")
    files.select(text).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_registry_json(registry: DataFrame, path: str) -> None:
    """Registry dump pages of about 100 reporters (dealt by a hash), one JSON document per page, files as arrays of them."""
    docs = _dump_rows(registry).groupBy("page").agg(
        F.to_json(F.struct(F.struct(F.count(F.lit(1)).cast("string").alias("total")).alias("pagination"),
                           F.collect_list("r").alias("reporters"))).alias("value")
    )
    _write_files(docs, path, ",\n", ("[", "]"))


def write_registry_yaml(registry: DataFrame, path: str) -> None:
    """The same pages rendered as YAML text (per page in its task), files as streams of them."""
    import yaml

    from reportlake.session import ship_package

    ship_package(registry.sparkSession)

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = []
        for r in pdf["r"]:
            rec = {"address": r["address"], "metadata": {k: v for k, v in dict(r["metadata"]).items() if v is not None}}
            if r["power"] is not None:
                rec["power"] = r["power"]
            reps.append(rec)
        text = yaml.safe_dump({"pagination": {"total": str(len(reps))}, "reporters": reps}, sort_keys=False)
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "value": [text]})

    docs = _dump_rows(registry).groupBy("page").applyInPandas(render, "page long, value string")
    _write_files(docs, path, "---\n")


def write_snapshot_docs(snapshots: DataFrame, path: str) -> None:
    """One ``[{height, power, timestamp}]`` document per day of snapshots (timestamp in seconds)."""
    docs = snapshots.groupBy(idiv("timestamp_ms", 86400000).alias("day")).agg(
        F.to_json(F.collect_list(F.struct("height", F.col("maximal_power").alias("power"),
                                          (F.col("timestamp_ms") / 1000.0).alias("timestamp")))).alias("value")
    )
    docs.write.mode("overwrite").partitionBy("day").text(path)

"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

1. toxicity: documents scored 0.5 or more go.
2. minhash_near_dedup: one document of each group of near copies stays.
3. benchmark_decontamination: documents that overlap a benchmark item go.
4. mixing: every document stays at least once; documents of small sources repeat until the sources' weights reach
   the target entropy.
5. token_ids: the documents as token-id segments; its rows are the index read back from them.

Each stage judges all rows its predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import decontaminate, mixing, neardup, tokens, toxicity
from reportlake.llm.common import ready, stored, table

MIX = mixing.Target(min_entropy=0.9, max_repeats=4.0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(ready(spark), sf_dir, "labels"))
    return toxicity.score(docs, model, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.token_count(F.col("text")), MIX).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: Compression distance, consistent sampling and byte-pair encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

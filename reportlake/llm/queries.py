"""Registered queries of the subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import collocations, decontaminate, embeddings, extract, linededup, mixing, neardup, packing, prefixtrie, secrets, tokens, toxicity, urlfilter
from reportlake.llm.common import Query, ready, stored, table


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = urlfilter.page_captures(table(spark, sf_dir, "pages"))
    return urlfilter.url_filter(captures, urlfilter.page_entries(captures))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return extract.main_text(table(spark, sf_dir, "pages"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"))
    out = mixing.mix(stored(docs, "mix-docs"), F.col("n_tokens"))
    return out.withColumnsRenamed({"mix_epoch": "epoch", "mix_block": "block", "mix_order_key": "order_key"})


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.packed(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_ids": op1_token_ids,
    "op2_url_filter": op2_url_filter,
    "op3_html_extraction": op3_html_extraction,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op2_url_filter": urlfilter.SQL,
    "op5_line_dedup": linededup.SQL,
    "op9_mixing": mixing.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_prefix_trie": prefixtrie.SQL,
    "op13_collocations": collocations.SQL,
}

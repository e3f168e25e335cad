"""Operator 10: benchmark decontamination by spaced seeds. DataFrame operations only.

A text becomes the lower-case runs of letters and digits. ``MASKS`` are fixed patterns over ``SPAN`` neighbouring
tokens: a 1 is read, a 0 ignored, so a seed still hits where a token under a 0 was substituted. Every position of
every document is hashed under every mask and joined with the seeds of the benchmark; a hit names a diagonal (the
document position of the item's first token). On each hit diagonal the item is laid over the document token by token,
and the pair counts where some window of ``min(item tokens, WINDOW)`` item tokens agrees in at least ``MIN_SHARE``.

Defined results: null and empty texts and items hold no token and never match; items under ``SPAN`` tokens are too
short to tell and never match; repeated doc_ids (and a null doc_id) are one document whose rows' best overlap counts,
likewise item_ids; empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import held, stored

MASKS = ("11100111", "10111101")
SHORT_MASK = "110101"
SPAN = 8
WINDOW = 24
MIN_SHARE = 0.8
#: Benchmark seeds are broadcast up to this many rows (of 24 bytes), and joined by a shuffle beyond.
BROADCAST_SEEDS = 2_000_000


def tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def _seeds(tok: Column, k: int, mask: str) -> Column:
    """One hash for each position of a mask; none where the text is shorter than the mask."""
    read, last = [j for j, bit in enumerate(mask) if bit == "1"], F.size(tok) - len(mask)
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(k), *[tok[i + j] for j in read]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _positions(df: DataFrame, key: str, text_col: str, pos: str, items: bool = False) -> DataFrame:
    """(key, pos, seed) of all texts under every mask; of ``items`` only those of SPAN tokens or more, and SHORT_MASK only
    where they have under WINDOW tokens."""
    t = held(df.select(key, text_col), tokens(F.col(text_col)), "_t").where(F.size("_t") >= (SPAN if items else len(SHORT_MASK)))
    tok = F.col("_t")
    short = _seeds(tok, len(MASKS), SHORT_MASK)
    if items:
        short = F.when(F.size(tok) < WINDOW, short).otherwise(F.array().cast("array<bigint>"))
    seeds = F.concat(*[_seeds(tok, k, m) for k, m in enumerate(MASKS)], short)
    t = t.select(key, F.greatest(F.size("_t") - (SPAN - 1), F.lit(0)).alias("_p"), seeds.alias("_s"))
    t = t.select(key, "_p", F.posexplode("_s").alias("_i", "seed"))
    masked = F.col("_p") * len(MASKS)
    return t.select(key, F.when(F.col("_i") < masked, F.col("_i") % F.col("_p")).otherwise(F.col("_i") - masked).alias(pos), "seed")


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, doc_start (token of the document under the item's first), n_matched (equal
    tokens on that diagonal), n_item (tokens of the item), best_window (equal tokens in the best window)."""
    bench = bench.select("item_id", "text")
    seeds = stored(_positions(bench, "item_id", "text", "item_pos", items=True).distinct(), "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    hits = _positions(docs, "doc_id", "text", "doc_pos").join(seeds, "seed")
    hits = hits.select("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal")).distinct()
    hits = stored(hits, "hits")
    hit_docs = stored(hits.select("doc_id").distinct(), "hit-docs")
    doc = docs.select("doc_id", "text").alias("d").join(hit_docs.alias("h"), F.expr("d.doc_id <=> h.doc_id"), "left_semi")
    doc = doc.select(F.col("doc_id").alias("_d"), tokens(F.col("text")).alias("_t"))
    item = bench.select(F.col("item_id").alias("_i"), tokens(F.col("text")).alias("_b")).where(F.size("_b") >= SPAN)
    pairs = hits.join(item, F.expr("item_id <=> _i")).join(doc, F.expr("doc_id <=> _d"))
    n, at = F.size("_b"), F.col("diagonal")
    same = F.transform("_b", lambda w, j: F.coalesce(F.when(j + at >= 0, F.get("_t", j + at) == w), F.lit(False)).cast("int"))
    pairs = pairs.select("doc_id", "item_id", at.alias("doc_start"), n.alias("n_item"), F.least(n, F.lit(WINDOW)).alias("_w"), "_t", "_b", "diagonal")
    pairs = held(pairs, same, "_m")
    total = F.aggregate("_m", F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_item") - F.col("_w") + 1), lambda i: F.aggregate(F.slice("_m", i, F.col("_w")), F.lit(0), lambda a, x: a + x)))
    pairs = pairs.select("doc_id", "item_id", "doc_start", total.alias("n_matched"), "n_item", best.alias("best_window"), "_w")
    pairs = pairs.where(F.col("best_window") * 100 >= F.col("_w") * round(100 * MIN_SHARE))
    first = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("best_window"), F.desc("n_matched"), "doc_start", "n_item")
    pairs = pairs.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return pairs.select("doc_id", "item_id", "doc_start", "n_matched", "n_item", "best_window")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document overlaps no benchmark item."""
    bad = stored(overlaps(docs, bench).select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad"]), "left_anti")


def _sql_seeds() -> str:
    parts = []
    for k, mask in enumerate((*MASKS, SHORT_MASK)):
        read = " || ' ' || ".join(f"t[p + {j + 1}]" for j, bit in enumerate(mask) if bit == "1")
        which = f" WHERE kind = 0 OR len(t) BETWEEN {SPAN} AND {WINDOW - 1}" if mask == SHORT_MASK else f" WHERE len(t) >= {SPAN}"
        at = f"SELECT kind, id, t, unnest(range(0, len(t) - {len(mask) - 1})) AS p FROM words{which}"
        parts.append(f"SELECT kind, id, p, '{k} ' || {read} AS seed FROM ({at})")
    return " UNION ALL ".join(parts)


SQL = f"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') FROM benchmark
), seeds AS ({_sql_seeds()}),
hits AS (
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.p - b.p AS doc_start
  FROM seeds d JOIN seeds b ON d.seed = b.seed WHERE d.kind = 0 AND b.kind = 1
), laid AS (
  SELECT h.*, len(b.t) AS n_item, least(len(b.t), {WINDOW}) AS w,
    list_transform(range(0, len(b.t)), lambda j: CASE WHEN j + doc_start >= 0 AND j + doc_start < len(d.t) AND d.t[j + doc_start + 1] = b.t[j + 1] THEN 1 ELSE 0 END) AS m
  FROM hits h JOIN words d ON d.kind = 0 AND d.id = h.doc_id JOIN words b ON b.kind = 1 AND b.id = h.item_id
), scored AS (
  SELECT doc_id, item_id, doc_start, list_sum(m) AS n_matched, n_item, w,
    list_max(list_transform(range(1, n_item - w + 2), lambda i: list_sum(m[i : i + w - 1]))) AS best_window
  FROM laid
)
SELECT doc_id, item_id, CAST(doc_start AS INTEGER) AS doc_start, CAST(n_matched AS INTEGER) AS n_matched, CAST(n_item AS INTEGER) AS n_item, CAST(best_window AS INTEGER) AS best_window
FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best_window DESC, n_matched DESC, doc_start, n_item) AS r
  FROM scored WHERE best_window * 100 >= w * {round(100 * MIN_SHARE)}
) WHERE r = 1
"""

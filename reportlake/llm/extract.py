"""Operator 3: main text of HTML pages by wrapper induction.

Each page becomes a tree of block elements. Skeletons (trees in which siblings of equal shape are one node) of the
pages of a host are aligned by simple tree matching and merged into the host's wrapper; distinct skeletons are merged
in groups, then their wrappers, so a host with a third of all pages is many small tasks. Every page is aligned to its
host's wrapper: a block's place is a wrapper slot. Spark counts on how many different pages of the host a slot holds
the same text. A text on at least CONSTANT of them (MIN_PAGES or more) is template, what varies is content. A slot that
CONSTANT of them hold and in which CONSTANT of its pages hold nothing but texts of MIN_PAGES or more pages is template
too, with all those texts (a frame in several languages).
Role marks (elements and class tokens of menus, headers, footers, sidebars, notices, adverts, forms, comments) leave
the tree before that, and the article elements (without one, the main elements) bound the content where a page has them.

Pages with equal main text count as one page, and where more than half of a page's main text is constant its pages are
copies rather than framed by a template: all of it is kept. A host with few pages has no constant node: the roles and
the region decide alone.

Defined results: null and empty html give an empty text; a null url (or one without a host) makes pages of the host
""; repeated rows give a row each; a page cut off inside a tag ends there; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import lean, stored, text_key
from reportlake.llm.htmltree import Page, align, candidates, from_json, merge, skeleton, to_json

CONSTANT = 0.6
MIN_PAGES = 5
_MERGE = 64


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _parsed(pages: DataFrame) -> DataFrame:
    """key (of the html), host, skeleton (JSON), main (hash of the main text), nodes and hashes and lengths of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(2):
                page = Page(text.as_py())
                out_of = page.inherit()
                tree, number = skeleton(page, out_of)
                found = candidates(page, out_of)
                texts = [t for _, t in found]
                out.append((json.dumps(to_json(tree)), _hash(" ".join(texts)), [number[i] for i, _ in found], [_hash(t) for t in texts], [len(t) for t in texts]))
            types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["key", "host", "tree", "main", "nodes", "hashes", "sizes"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(text_key(F.col("html")).alias("key"), host.alias("host"), "html")
    return rows.mapInArrow(lean(run), "key binary, host string, tree string, main long, nodes array<int>, hashes array<long>, sizes array<int>")


def _wrappers(parsed: DataFrame) -> DataFrame:
    """(host, wrapper): the merged skeletons of each host with pages of different main texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int, str]]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for (host, part), group in groupby(rows(), key=lambda r: r[:2]):
            whole, memo = None, {}
            for _, _, tree in group:
                t = from_json(json.loads(tree))
                whole = t if whole is None else merge(whole, t, memo)
                if len(memo) > 100_000:
                    memo = {}
            yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([part // _MERGE], pa.int32()), pa.array([json.dumps(to_json(whole))])], names=["host", "part", "tree"])

    many = parsed.groupBy("host").agg(F.min("main").alias("lo"), F.max("main").alias("hi")).where("lo <> hi").select("host")
    trees = parsed.select("host", "tree").distinct().join(many, "host")
    trees = trees.select("host", F.pmod(F.xxhash64("tree"), F.lit(_MERGE * _MERGE)).cast("int").alias("part"), "tree")
    for _ in range(3):  # 4096 parts, then 64, then the host
        trees = trees.repartition("host", "part").sortWithinPartitions("host", "part", "tree").mapInArrow(lean(run), "host string, part int, tree string")
    return trees.select("host", F.col("tree").alias("wrapper"))


def _slots(parsed: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row per block: key, host, main, at (its number in the page), slot, hash, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            slots = []
            for tree, wrapper, nodes in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                if (tree, wrapper) not in seen:
                    if len(seen) > 5000:
                        seen.clear()
                    seen[tree, wrapper] = align(from_json(json.loads(tree)), from_json(json.loads(wrapper)))
                at = seen[tree, wrapper]
                slots.append([at[i] if i >= 0 else -1 for i in nodes])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 6, 7)), pa.array(slots, pa.list_(pa.int32()))], names=["key", "host", "main", "hashes", "sizes", "slots"])

    rows = parsed.join(wrappers, "host").select("key", "host", "main", "tree", "wrapper", "nodes", "hashes", "sizes")
    rows = rows.mapInArrow(lean(run), "key binary, host string, main long, hashes array<long>, sizes array<int>, slots array<int>")
    rows = rows.select("key", "host", "main", F.posexplode(F.arrays_zip("slots", "hashes", "sizes")).alias("at", "b"))
    return rows.select("key", "host", "main", "at", F.col("b.slots").alias("slot"), F.col("b.hashes").alias("hash"), F.col("b.sizes").alias("size"))


def template_blocks(pages: DataFrame) -> DataFrame:
    """(key, host, drop): the numbers of the blocks in a page's main text that belong to its host's template."""
    parsed = stored(_parsed(pages).dropDuplicates(["key", "host"]), "parsed")
    wrappers = stored(_wrappers(parsed), "wrappers")
    blocks = stored(_slots(parsed, wrappers), "blocks")
    of_host = parsed.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    held = stored(blocks.where("slot >= 0").select("host", "slot", "hash", "main").distinct(), "held")
    texts = stored(held.groupBy("host", "slot", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES), "texts")
    per_slot = held.join(texts.select("host", "slot", "hash", F.lit(1).alias("r")), ["host", "slot", "hash"], "left")
    per_slot = per_slot.groupBy("host", "slot", "main").agg(F.min(F.coalesce("r", F.lit(0))).alias("closed"))
    per_slot = per_slot.groupBy("host", "slot").agg(F.count("*").alias("holders"), F.sum("closed").alias("closed"))
    constant = texts.join(per_slot, ["host", "slot"]).join(of_host, "host")
    frame = (F.col("holders") >= CONSTANT * F.col("pages")) & (F.col("closed") >= CONSTANT * F.col("holders"))
    constant = stored(constant.where((F.col("n") >= CONSTANT * F.col("pages")) | frame).select("host", "slot", "hash"), "constant")
    hit = blocks.join(constant.withColumn("c", F.lit(1)), ["host", "slot", "hash"], "left")
    per_page = hit.groupBy("key", "host").agg(F.collect_list(F.when(F.col("c") == 1, F.col("at"))).alias("drop"), F.sum(F.when(F.col("c") == 1, F.col("size")).otherwise(0)).alias("same"), F.sum("size").alias("size"))
    return stored(per_page.where("size(drop) > 0 and 2 * same <= size").select("key", "host", "drop"), "template")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    drop = template_blocks(pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.withColumn("key", text_key(F.col("html"))).withColumn("host", host).join(drop, ["key", "host"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, gone in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                gone = set(gone or ())
                texts.append(" ".join(t for i, (_, t) in enumerate(candidates(Page(text.as_py()))) if i not in gone))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "drop").mapInArrow(lean(run), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")

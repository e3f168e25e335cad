"""Operator 4: near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. A Count-Sketch of document frequencies is summed over all documents: its size is fixed, whatever the corpus.
   A shingle weighs tf * (1 + IDF_SPAN * idf), idf = 1 - log df / log N in [0, 1]. The narrow span keeps weighted
   similarity near plain similarity, also in large groups of copies, whose shared shingles have a low idf.
2. Each text gets K consistent weighted samples, banded by ROWS; equal texts are one class (smallest doc_id).
3. In each band bucket the members are compared with one leader, so a bucket of many copies costs one comparison a
   member. Pairs whose samples agree too rarely (``ESTIMATE_FLOOR``) are left to step 4; the others are verified by
   exact weighted Jaccard similarity >= THRESHOLD over whole texts.
   For members of large buckets the share u of a text's weight in shingles that no other such member has is counted
   exactly. Two texts can't be more similar than 1 / (1 / (1 - u1) + 1 / (1 - u2) - 1), so pairs whose bound is under
   the threshold are never made: texts that share only a common passage leave the bucket at once, and the member
   with the least u, the middle of a group of copies, is its leader.
4. The members of each bucket that are still in different components meet: a bucket is dealt into blocks of bounded size,
   each pair of blocks is one task's work, and a pair of texts never becomes a row. Inside, weights summed by hash cell
   bound the similarity of two texts from above; pairs that the bound allows are computed exactly, until their
   components are one. No pair of a bucket is cut.
5. Links make connected components; a document's class_id is the smallest doc_id of its component.

Defined results: null and empty texts are equal texts without shingles: one class, near nothing else; repeated rows
give a row each, all of which ``keep_one`` keeps or drops alike; rows with a null doc_id keep a null doc_id, get the class of their text and link nothing; ties go to
the smaller doc_id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import U64, components, lean, mix, stored, text_key
from reportlake.llm.shingles import shingles

THRESHOLD = 0.8
IDF_SPAN = 0.25
BANDS, ROWS = 12, 3
K = BANDS * ROWS
ESTIMATE_FLOOR = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5
SKETCH_ROWS, SKETCH_BITS = 3, 18
_BLOCKS = 8
_FAN_IN = 64
#: A block of members that meets another one: texts, and bytes of their shingles.
BLOCK_TEXTS, BLOCK_BYTES = 256, 8 << 20
_CELLS = 1 << 12
#: Buckets of more members count what their texts hold alone before any pair is made.
LARGE = 32


def _cells(x: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, sign) of shingles in a row of the sketch."""
    z = mix(x ^ U64(0xA24BAED4963EE407 * (row + 1) & (1 << 64) - 1))
    return (z & U64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1 - 2 * ((z >> U64(40)) & U64(1)).astype(np.int32)


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Count-Sketch (SKETCH_ROWS x 2^SKETCH_BITS) of document frequencies over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for b in batches:
            held, size = [], 0
            for x, _ in shingles(b.column(0).to_pylist()):
                held.append(x)
                size += len(x)
                if size > 1 << 18:
                    _add(table, held)
                    held, size = [], 0
            _add(table, held)
        part = TaskContext.get().partitionId()
        cells = [(r, k, part, c.tobytes()) for r in range(SKETCH_ROWS) for k, c in enumerate(np.split(table[r], _BLOCKS))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*cells, strict=True)], names=["row", "block", "part", "cells"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in rows["cells"])
        return pd.DataFrame({"row": [key[0]], "block": [key[1]], "part": [key[2]], "cells": [total.tobytes()]})

    schema = "row long, block long, part long, cells binary"
    sums = docs.select("text").mapInArrow(lean(count), schema)
    parts = docs.rdd.getNumPartitions()
    while True:  # a tree: no group holds more than _FAN_IN blocks
        sums = sums.withColumn("part", F.floor(F.col("part") / _FAN_IN)).groupBy("row", "block", "part").applyInPandas(merge, schema)
        parts = -(-parts // _FAN_IN)
        if parts <= 1:
            break
    table = np.zeros((SKETCH_ROWS, _BLOCKS, (1 << SKETCH_BITS) // _BLOCKS), np.int64)
    for r, k, _, cells in sums.collect():  # SKETCH_ROWS * _BLOCKS rows, 6 MB
        table[r, k] += np.frombuffer(cells, np.int64)
    return table.reshape(SKETCH_ROWS, -1).astype(np.float32)


def _add(table: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        x = np.concatenate(held)
        for r in range(SKETCH_ROWS):
            cell, sign = _cells(x, r)
            table[r] += np.bincount(cell, weights=sign, minlength=1 << SKETCH_BITS).astype(np.int64)


class Weights:
    """TF-IDF weights of a text's shingles."""

    def __init__(self, sketch: np.ndarray, n_docs: int):
        self.sketch, self.log_n = sketch, float(np.log(max(n_docs, 2)))

    def __call__(self, x: np.ndarray, tf: np.ndarray) -> np.ndarray:
        found = []
        for r in range(SKETCH_ROWS):
            cell, sign = _cells(x, r)
            found.append(self.sketch[r, cell] * sign)
        df = np.maximum(np.median(found, axis=0), 1.0)
        idf = 1.0 - np.minimum(np.log(df) / self.log_n, 1.0)
        return tf * (1.0 + IDF_SPAN * idf)


class Sampler:
    """ICWS: sample k of a weighted set is its element with the least a = c / exp(r (t - beta + 1)), where
    t = floor(log(weight) / r + beta); r and c ~ Gamma(2, 1), beta ~ U(0, 1) are drawn from tables by a hash of
    (element, k)."""

    BITS = 16

    def __init__(self, seed: int = 29):
        rng, n = np.random.default_rng(seed), 1 << self.BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n, np.float32)
        self.keys = rng.integers(1, 1 << 63, K, dtype=np.uint64) * U64(2) + U64(1)

    def __call__(self, x: np.ndarray, w: np.ndarray, block: int = 512) -> np.ndarray:
        best, ids, cols = np.full(K, np.inf, np.float32), np.zeros(K, U64), np.arange(K)
        low = U64((1 << self.BITS) - 1)
        log_w = np.log(w).astype(np.float32)[:, None]
        for i in range(0, len(x), block):
            e = x[i : i + block]
            z = (e[:, None] ^ self.keys) * self.keys
            z ^= z >> U64(31)
            r, beta = self.r[z & low], self.beta[(z >> U64(16)) & low]
            t = np.floor(log_w[i : i + block] / r + beta)
            log_a = self.log_c[(z >> U64(32)) & low] - r * (t - beta + 1.0)
            at = log_a.argmin(0)
            a = log_a[at, cols]
            new = a < best
            best[new] = a[new]
            ids[new] = mix(e[at] ^ (t[at, cols].astype(np.int64).astype(U64) * U64(0x9FB21C651E98DF25)))[new]
        return ids


def _signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, text key, band keys (null without shingles), one byte of each sample."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, sample = shared.value, Sampler()
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for b in batches:
            bands, sigs = [], []
            for x, tf in shingles(b.column(2).to_pylist()):
                if not len(x):
                    bands.append(None)
                    sigs.append(None)
                    continue
                ids = sample(x, weigh(x, tf))
                key = salt.copy()
                for j in range(ROWS):
                    key = mix(key * U64(0x2545F4914F6CDD1D) + ids[j::ROWS])
                bands.append(key.view(np.int64))
                sigs.append((ids & U64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "key", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, key binary, bands array<long>, sig binary")


def _promising(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough, from (a, b, sig_a, sig_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, K) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).mean(1) >= ESTIMATE_FLOOR))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """Pairs of weighted Jaccard similarity >= THRESHOLD over whole texts: a, b, similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, last, held = shared.value, None, None
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, (y, tf) in enumerate(shingles(b.column(3).to_pylist())):
                if last != ids[i]:
                    (x, tx), last = next(shingles([b.column(2)[i].as_py()])), ids[i]
                    held = x, weigh(x, tx)
                out.append(_similarity(held, (y, weigh(y, tf))))
            s = pa.array(out, pa.float64())
            keep = pa.array([v >= THRESHOLD for v in out])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), s], names=["a", "b", "similarity"]).filter(keep)

    t = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    t = t.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    return t.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long, similarity double")


def _alone(texts: DataFrame, ids: DataFrame, weights: Weights) -> DataFrame:
    """(cid, u): the share of a text's weight in shingles that no other text of ``ids`` holds."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        for b in batches:
            for cid, (x, tf) in zip(b.column(0).to_pylist(), shingles(b.column(1).to_pylist()), strict=True):
                w = weigh(x, tf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), cid)), pa.array(x.view(np.int64)), pa.array(w / max(w.sum(), 1e-12))], names=["cid", "x", "w"])

    rows = texts.join(ids, "cid", "left_semi").select("cid", "text").mapInArrow(lean(run), "cid long, x long, w double")
    once = rows.groupBy("x").agg(F.count("*").alias("n"), F.min("cid").alias("cid"), F.min("w").alias("w")).where("n = 1")
    return once.groupBy("cid").agg(F.sum("w").alias("u"))


def _possible(u: Column, v: Column) -> Column:
    """Whether texts that hold the shares u and v alone can reach THRESHOLD."""
    return 1 / (1 - F.least(u, F.lit(0.999))) + 1 / (1 - F.least(v, F.lit(0.999))) - 1 <= 1 / THRESHOLD + 1e-9


def _crowded(active: DataFrame) -> DataFrame:
    """Members (band, bucket, cid, u) of buckets in which they can still meet a partner."""
    low = active.groupBy("band", "bucket").agg(F.min("u").alias("low"))
    active = active.join(low, ["band", "bucket"]).where(_possible(F.col("u"), F.col("low"))).drop("low")
    some = active.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("band", "bucket")
    return active.join(some, ["band", "bucket"])


def _similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (ascending shingles, weights)."""
    _, p, q = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(x[1][p], y[1][q]).sum())
    return both / max(float(x[1].sum() + y[1].sum()) - both, 1e-12)


def _shapes(texts: DataFrame, weights: Weights) -> DataFrame:
    """(cid, shape, size): a text's shingles and weights as bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        for b in batches:
            blobs = [x.tobytes() + weigh(x, tf).tobytes() for x, tf in shingles(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary()), pa.array([len(x) for x in blobs], pa.int64())], names=["cid", "shape", "size"])

    return texts.select("cid", "text").mapInArrow(lean(run), "cid long, shape binary, size long")


class _Meeting:
    """Members of two blocks of a bucket: which pairs link different components."""

    def __init__(self, cids: list[int], components: list[int], left: list[bool], right: list[bool], shapes: list[bytes]):
        self.cids, self.components, self.left, self.right = cids, components, left, right
        self.shapes = [(np.frombuffer(x, U64, len(x) // 16), np.frombuffer(x, np.float64, len(x) // 16, len(x) // 2)) for x in shapes]

    def links(self) -> Iterator[tuple[int, int, float]]:
        n, root = len(self.cids), {c: c for c in self.components}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        cells = min(_CELLS, 1 << int(4 * max(1, np.median([len(x) for x, _ in self.shapes]))).bit_length())
        table = np.stack([np.bincount((x & U64(cells - 1)).astype(np.int64), w, cells) for x, w in self.shapes]).astype(np.float32)
        total = np.array([w.sum() for _, w in self.shapes])
        own, right = np.array(self.components), np.array(self.right)
        order = np.arange(n)
        for i in range(n):
            if not self.left[i]:
                continue
            # two blocks meet across; a block that meets itself has both marks
            others = np.flatnonzero(right & (own != own[i]) & (~np.array(self.left) | (order > i)))
            if not len(others):
                continue
            both = np.minimum(table[i], table[others]).sum(1, dtype=np.float64)
            could = both / np.maximum(total[i] + total[others] - both, 1e-12) >= THRESHOLD - 1e-3
            for j in others[could].tolist():
                a, b = find(self.components[i]), find(self.components[j])
                if a != b and (s := _similarity(self.shapes[i], self.shapes[j])) >= THRESHOLD:
                    root[max(a, b)] = min(a, b)
                    yield min(self.cids[i], self.cids[j]), max(self.cids[i], self.cids[j]), s


def _met(members: DataFrame, found: DataFrame, shapes: DataFrame) -> DataFrame:
    """Links (a, b, similarity) between members (band, bucket, cid) of one bucket that the links found leave in different
    components: enough to connect what is linked."""
    comp = components(found, name="links-components").withColumnRenamed("node", "cid")
    rows = members.select("band", "bucket", "cid").join(comp, "cid", "left").join(shapes.select("cid", "size"), "cid")
    rows = stored(rows.withColumn("component", F.coalesce("component", "cid")), "bucket-members")
    split = rows.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    rows = rows.join(split.where("low < high").select("band", "bucket", blocks.cast("long").alias("blocks")), ["band", "bucket"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid", "band"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", "bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "cid", "component", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))
    rows = rows.join(shapes.select("cid", "shape"), "cid").repartition("band", "bucket", "p", "q").sortWithinPartitions("band", "bucket", "p", "q", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(held: list[tuple]) -> pa.RecordBatch:
            out = list(_Meeting(*(list(c) for c in zip(*held, strict=True))).links()) if len({r[1] for r in held}) > 1 else []
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "similarity"])

        group, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:4] != group:
                    if held:
                        yield met(held)
                    group, held = row[:4], []
                held.append(row[4:])
        if held:
            yield met(held)

    return rows.select("band", "bucket", "p", "q", "cid", "component", "left", "right", "shape").mapInArrow(lean(run), "a long, b long, similarity double")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, key), (classes: key, cid), (verified links between classes: a, b, similarity)."""
    docs = docs.select("doc_id", "text")
    weights = Weights(frequency_sketch(docs), docs.count())
    sigs = stored(_signatures(docs, weights), "signatures")
    classes = sigs.groupBy("key").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stored(classes, "classes")
    member = classes.where("cid is not null and bands is not null").select("cid", F.posexplode("bands").alias("band", "bucket"))
    sizes = member.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    active = stored(member.join(sizes, ["band", "bucket"]), "buckets")
    ids = stored(active.select("cid").distinct(), "members")
    sig = stored(classes.select("cid", "sig").join(ids, "cid"), "member-signatures")
    texts = docs.join(ids, docs.doc_id == ids.cid, "left_semi").select(F.col("doc_id").alias("cid"), "text")
    reps = classes.select("key", "cid")
    texts = texts.withColumn("key", text_key(F.col("text"))).join(reps, ["cid", "key"], "left_semi")
    texts = stored(texts.groupBy("cid").agg(F.first("text").alias("text")), "member-texts")
    large = stored(active.where(F.col("n") > LARGE).select("cid").distinct(), "large-members")
    alone = stored(_alone(texts, large, weights), "alone")
    active = active.join(alone, "cid", "left")
    active = active.select("band", "bucket", "cid", F.when(F.col("n") > LARGE, F.coalesce("u", F.lit(0.0))).otherwise(F.lit(0.0)).alias("u"))
    active = stored(_crowded(active), "buckets")
    order = F.struct("u", "cid")
    leaders = active.groupBy("band", "bucket").agg(F.min(order).alias("o"))
    meets = active.join(leaders, ["band", "bucket"]).where((F.col("o") < order) & _possible(F.col("u"), F.col("o.u")))
    pairs = meets.select(F.least("o.cid", "cid").alias("a"), F.greatest("o.cid", "cid").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = pairs.join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
    found = stored(_verified(stored(_promising(pairs), "pairs"), texts, weights), "links")
    shapes = stored(_shapes(texts.join(active.select("cid").distinct(), "cid", "left_semi"), weights), "shapes")
    found = found.unionByName(stored(_met(active, found, shapes), "links"))
    return sigs.select("doc_id", "key"), reps, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its near-duplicates, its own included),
    exact_id (smallest doc_id with an equal text), kept (doc_id = class_id)."""
    rows, classes, found = links(docs)
    comp = components(found, name="neardup")
    ids = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    ids = stored(ids.select("key", F.col("cid").alias("exact_id"), F.coalesce("component", "cid").alias("class_id")), "class-ids")
    return rows.join(ids, "key").select("doc_id", "class_id", "exact_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their class_id, and those without a doc_id."""
    drop = near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("copy")).distinct()
    drop = stored(drop, "near-copies")
    return docs.join(drop, docs["doc_id"] == drop["copy"], "left_anti")

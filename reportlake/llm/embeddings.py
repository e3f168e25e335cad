"""Operator 7: near-duplicate vectors by randomised-rotation binary codes (RaBitQ).

Equal vectors are one class. A random rotation turns a unit vector o into o'; its code is the signs of o', its
correction factor f = <sign(o') / sqrt(d), o'>. For a vector q the estimate <sign(o') / sqrt(d), q'> / f of <o, q> is
unbiased, with a bound of EPSILON * sqrt((1 - f^2) / f^2 / (d - 1)). Candidates share a band of code bits: the codes of
several rotations are cut into bands of r ~ log2(classes) bits, as many bands as find a pair at THRESHOLD with
probability RECALL. Pairs of a band bucket whose estimate plus bound stays under THRESHOLD are dropped (in the first
band they share); the others are recomputed exactly, in double precision, and link at a cosine >= THRESHOLD.

A large bucket is cut into blocks of about BLOCK classes by hash, and each pair of blocks is a task group of its own;
pairs leave a task only if the estimate keeps them.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing and is
its own component; so does a row with a null vec_id, whose component is null. Vectors of different lengths never link.
Repeated rows count as vectors of their own; a repeated vec_id is one node of the components. An empty table gives an
empty result. Extra columns are ignored; labels are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import components, lean, stored

THRESHOLD = 0.95
RECALL = 0.9995
EPSILON = 3.0
BLOCK = 1024
_SEED = 4099
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random rotation of d dimensions."""
    if (d, k) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng((_SEED, d, k)).standard_normal((d, d)))
        _rotations[d, k] = q * np.sign(np.diag(r))
    return _rotations[d, k]


def bands_for(n: int) -> tuple[int, int]:
    """(bits of a band, bands) for n classes."""
    bits = min(30, max(8, round(math.log2(max(n, 2)))))
    hit = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, key (of the vector, null if it can't link), vec (its doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = None
                if i is not None and x and None not in x:
                    v = np.asarray(x, "<f8") + 0.0
                    big = np.abs(v).max()
                    if np.isfinite(big) and big > 0:
                        raw = v.tobytes()
                keys.append(xxhash.xxh3_128_digest(raw) if raw else None)
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(lean(run), "vec_id long, key binary, vec binary")


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, "<f8")
    v = v / np.abs(v).max()  # no overflow in the norm
    return v / np.sqrt(v @ v)


def _coded(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """cid, keys (one of each band), code (signs of the first rotation), factor, turned (float32, first rotation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                u = _unit(raw)
                d = len(u)
                first = rotation(d, 0) @ u
                more = [rotation(d, k) @ u for k in range(1, -(-bits * bands // d))]
                sign = np.concatenate([first, *more])[: bits * bands] > 0
                keys = sign.reshape(bands, bits) @ (1 << np.arange(bits)) ^ (d * 2654435761 & 0x3FFFFFFF)
                code = np.packbits(first > 0)
                out.append((keys.astype(np.int32), code.tobytes(), float(np.abs(first).sum() / math.sqrt(d)), first.astype("<f4").tobytes()))
            types = [pa.list_(pa.int32()), pa.binary(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=["cid", "keys", "code", "factor", "turned"])

    return classes.select("cid", "vec").mapInArrow(lean(run), "cid long, keys array<int>, code binary, factor double, turned binary")


def _kept_pairs(group: np.ndarray, side: np.ndarray, band: np.ndarray, keys: np.ndarray, sign: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the groups (ascending) that the estimate keeps, in the first band they share."""
    d = sign.shape[1]
    bound = EPSILON * np.sqrt(np.maximum(1 / factor**2 - 1, 0) / max(d - 1, 1))
    sizes = np.diff(np.flatnonzero(np.diff(group, prepend=-1, append=-1)))
    for shift in range(1, int(sizes.max(initial=1))):
        a = np.flatnonzero(group[:-shift] == group[shift:])
        a = a[(side[a] < 0) | (side[a] != side[a + shift])]
        for i in range(0, len(a), 1 << 15):
            x = a[i : i + (1 << 15)]
            y = x + shift
            there = np.einsum("ij,ij->i", sign[x], turned[y]) / (math.sqrt(d) * factor[x])
            back = np.einsum("ij,ij->i", sign[y], turned[x]) / (math.sqrt(d) * factor[y])
            near = (there + back + bound[x] + bound[y]) / 2 >= THRESHOLD
            x, y = x[near], y[near]
            first = (keys[x] == keys[y]).argmax(1) == band[x]
            yield x[first], y[first]


def _candidates(coded: DataFrame, bands: int) -> DataFrame:
    """Pairs (a, b) of classes that exact recomputation has to decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [rows.column(i).combine_chunks() for i in range(rows.num_columns)]
            cell = np.stack([cols[i].to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            group = np.cumsum(np.concatenate([[0], (cell[:, 1:] != cell[:, :-1]).any(0)]))
            ids, side, factor = (cols[i].to_numpy(zero_copy_only=False) for i in (4, 5, 8))
            keys = cols[6].flatten().to_numpy().reshape(-1, bands)
            codes, turned = cols[7].to_pylist(), cols[9].to_pylist()
            width = np.array([len(t) for t in turned])
            for w in np.unique(width):  # vectors of one length
                at = np.flatnonzero(width == w)
                q = np.frombuffer(b"".join(turned[i] for i in at), "<f4").reshape(len(at), -1)
                sign = np.unpackbits(np.frombuffer(b"".join(codes[i] for i in at), np.uint8).reshape(len(at), -1), axis=1, count=q.shape[1])
                for x, y in _kept_pairs(group[at], side[at], cell[0][at], keys[at], 2 * sign.astype(np.float32) - 1, factor[at], q):
                    a, b = ids[at[x]], ids[at[y]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            # whole cells only: what follows the last change of cell waits for the next batch
            cell = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            change = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1
            if held and (cell[:, 0] != np.array([held[-1].column(i)[-1].as_py() for i in range(4)])).any():
                change = np.append(0, change)
            if not len(change):
                held.append(batch)
                continue
            cut = int(change[-1])
            done = [*held, batch.slice(0, cut)] if cut else held
            held = [batch.slice(cut)]
            if sum(x.num_rows for x in done):
                yield from work(pa.Table.from_batches(done))
        if sum(x.num_rows for x in held):
            yield from work(pa.Table.from_batches(held))

    rows = coded.select("cid", F.posexplode("keys").alias("band", "bucket"))
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "bucket"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(_SEED)), blocks).cast("int")
    rows = rows.select("cid", "band", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("cid", "band", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") < F.col("other")).cast("int")).alias("side"))
    rows = rows.join(coded, "cid").select("band", "bucket", "i", "j", "cid", "side", "keys", "code", "factor", "turned")
    rows = rows.repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "cid")
    return rows.mapInArrow(lean(run), "a long, b long")


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).to_pylist() for i in (2, 3))
            keep = [float(_unit(p) @ _unit(q)) >= THRESHOLD for p, q in zip(x, y, strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    p = pairs.join(classes.select(F.col("cid").alias("a"), F.col("vec").alias("x")), "a")
    p = p.join(classes.select(F.col("cid").alias("b"), F.col("vec").alias("y")), "b")
    return p.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = stored(_keyed(vectors), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    classes = stored(classes, "vector-classes")
    bits, bands = bands_for(classes.count())
    coded = stored(_coded(classes, bits, bands), "codes")
    pairs = stored(_candidates(coded, bands), "candidates")
    links = stored(_exact(pairs, classes), "vector-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("cid").alias("b"), "n"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("far"))
    comp = components(links, name="vectors").select(F.col("node").alias("cid"), "component")
    info = classes.select("key", "cid", "n").join(degree, "cid", "left").join(comp, "cid", "left")
    info = stored(info.select("key", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id")), "vector-info")
    out = rows.select("vec_id", "key").join(info, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

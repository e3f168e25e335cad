"""Operator 11: the prefix trie of conversations, its subtrees summed by the Euler-tour technique.

1. Turns get their place in a conversation by one range-partitioned sort and sums over ranges, so a conversation with a
   third of all rows is many tasks. ``rebuilt`` makes the conversations that the trie holds (see there).
2. A node is a distinct sequence of first d turns. Its key is the sum of two 64-bit hashes of (place, role, text) over
   the sequence, 128 bits, which prefix sums give for all d at once. Nodes are counted by key, and numbered.
3. Each node but the root has an enter and an exit arc. An enter arc is followed by that of the node's first child, or by
   the node's exit arc; an exit arc by the enter arc of the next sibling, or by the parent's exit arc. Siblings are dealt
   into about sqrt(children) buckets and linked inside and across them, so a node with a third of all nodes as children
   has no long window.
4. The tour is ranked as a linked list: in each round an arc whose coin is heads swallows a successor whose coin is tails
   (a quarter of the list is expected to go); the weights of swallowed arcs move to their swallower. The list of at most
   ``SHORT`` arcs that remains is followed in one task, then the rounds are undone in reverse. Work and shuffle are in
   proportion to the arcs, whatever the depth.
5. Leaves and savings of all arcs are prefix-summed in tour order, in blocks of 2^``BITS`` positions; a subtree's figures
   are the differences between its exit and enter positions.

Defined results: rows with a null conv_id belong to no conversation and are left out; null roles and texts are empty;
a null turn sorts first; rows of equal turn are ordered by role, the text's first 64 characters, then a hash; repeated
rows are turns each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import lean, scratch, stored

BITS = 12
#: Arcs that one task follows at last: 24 bytes each.
SHORT = 1 << 16
GROUP = 5
HEADS = 9
_CHUNK = 1 << 16
KEY = ["h1", "h2", "depth"]


def _before(values: str, *by: str, order: str) -> Column:
    """The sum of ``values`` in the rows before, within ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(values).over(w), F.lit(0))


def running(df: DataFrame, by: list[str], at: str, sums: dict[str, str]) -> DataFrame:
    """``df`` with ``sums[c]`` = the sum of column c over rows of equal ``by`` up to and with position ``at`` (unique,
    from 0), in three levels of blocks: no window has more than 2^BITS rows below 2^(3 BITS) positions."""
    df = df.withColumn("_b", F.shiftright(at, BITS)).withColumn("_g", F.shiftright(at, 2 * BITS))
    blocks = df.groupBy(*by, "_g", "_b").agg(*(F.sum(c).alias(c) for c in sums))
    groups = blocks.groupBy(*by, "_g").agg(*(F.sum(c).alias(c) for c in sums))
    groups = groups.select(*by, "_g", *(_before(c, *by, order="_g").alias(f"_g_{c}") for c in sums))
    blocks = blocks.join(groups, [*by, "_g"])
    blocks = blocks.select(*by, "_b", *((F.col(f"_g_{c}") + _before(c, *by, "_g", order="_b")).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *(F.sum(c).over(inside).alias(f"_i_{c}") for c in sums)).join(blocks, [*by, "_b"])
    return df.select("*", *((F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(new) for c, new in sums.items())).drop("_b", "_g", *(f"_{x}_{c}" for x in "bi" for c in sums))


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, place from 1, role, text) of conversations by turn."""
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("_h", F.xxhash64("role", "text")).withColumn("_t", F.substring("text", 1, 64)).withColumn("_r", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.col("_t"), F.col("_h"), F.col("_r")]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    t = stored(t.select("conv_id", "role", "text", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "turns")
    parts = t.groupBy("conv_id", "_part").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    parts = parts.select("conv_id", "_part", "first", _before("n", "conv_id", order="_part").alias("before"))
    t = t.join(parts, ["conv_id", "_part"])  # a range's rows of a conversation have ascending ids without gaps
    return t.select("conv_id", (F.col("before") + F.col("_id") - F.col("first") + 1).alias("place"), "role", "text")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conv_id c, rebuilt: the first h turns of conversation c - c % GROUP (all if fewer, none if absent), then
    c's own turns after its first h; h = crc32(decimal c) % HEADS. Returns (conv_id, place from 1, role, text); a
    conversation without turns has one row of place 0."""
    own = stored(ordered(turns), "ordered-turns")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = own.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    convs = stored(convs.withColumn("base", base), "conversations")
    length = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("_n"))
    convs = stored(convs.join(length, "base", "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n"), "conversations")
    heads = own.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("base", "conv_id", "taken"), "base").where("place <= taken").select("conv_id", "place", "role", "text")
    tails = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "role", "text")
    none = convs.where((F.col("taken") == 0) & (F.col("own") <= F.col("h"))).select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"))
    return heads.unionByName(tails).unionByName(none)


def _members(convs: DataFrame) -> DataFrame:
    """One row for each conversation and node on its path: h1, h2, depth, conv_id, the parent's u1, u2, bytes."""
    d = "decimal(20,0)"
    rows = convs.select("conv_id", F.col("place").alias("depth"), F.xxhash64(F.lit(1), "place", "role", "text").cast(d).alias("x1"), F.xxhash64(F.lit(2), "place", "role", "text").cast(d).alias("x2"), F.octet_length("text").cast("long").alias("bytes"))
    path = running(rows.where("depth > 0").withColumn("_at", F.col("depth") - 1), ["conv_id"], "_at", {"x1": "s1", "x2": "s2"})
    big = "decimal(38,0)"
    path = path.select(F.col("s1").cast(big).alias("h1"), F.col("s2").cast(big).alias("h2"), "depth", "conv_id", (F.col("s1") - F.col("x1")).cast(big).alias("u1"), (F.col("s2") - F.col("x2")).cast(big).alias("u2"), "bytes")
    zero = F.lit(0).cast(big)
    root = rows.select("conv_id").distinct().select(zero.alias("h1"), zero.alias("h2"), F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast(big).alias("u1"), F.lit(None).cast(big).alias("u2"), F.lit(0).cast("long").alias("bytes"))
    return stored(path.unionByName(root), "members")


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): lowercase SHA-256 hex of a node's conv_ids, ascending, comma-joined.

    The ids are range-sorted by (node, conv_id) and joined into chunks of bounded size; then a node's chunks are fed in
    order to one hash, which is sequential by nature, without holding more than a chunk."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, node, held, size, out = TaskContext.get().partitionId(), 0, None, [], 0, []
        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (n != node or size >= _CHUNK):
                    out.append((node, part, at, ",".join(held)))
                    at, held, size = at + 1, [], 0
                node = n
                held.append(str(c))
                size += len(held[-1]) + 1
            yield _rows(out)
            out = []
        yield _rows([(node, part, at, ",".join(held))] if held else [])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["node", "part", "at", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            out: list[tuple[int, str]] = []
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n == node:
                    h.update(b"," + ids.encode())
                    continue
                if h is not None:
                    out.append((node, h.hexdigest()))
                node, h = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    ids = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id")
    texts = ids.mapInArrow(lean(chunks), "node long, part int, at long, ids string")
    texts = texts.repartition("node").sortWithinPartitions("node", "part", "at").select("node", "ids")
    return texts.mapInArrow(lean(digest), "node long, ends_sha256 string")


def _tour(nodes: DataFrame) -> DataFrame:
    """(arc, next) of the Euler tour of (node, parent, conv_id): enter arcs are 2 * node, exit arcs 2 * node + 1; the
    root's exit arc, the last one, has no next."""
    kids = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"))
    child = nodes.where("parent is not null").select("node", "parent").join(kids, "parent")
    child = child.withColumn("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.sqrt("kids"))))
    inside = Window.partitionBy("parent", "bucket").orderBy("node")
    child = child.withColumn("sibling", F.lead("node").over(inside)).withColumn("_first", F.lag("node").over(inside).isNull())
    child = stored(child.select("node", "parent", "bucket", "sibling", "_first"), "siblings")
    first = child.where("_first").select("parent", "bucket", F.col("node").alias("head"))
    across = Window.partitionBy("parent").orderBy("bucket")
    first = first.withColumn("following", F.lead("head").over(across)).withColumn("_first", F.lag("head").over(across).isNull())
    first = stored(first, "first-siblings")
    child = child.join(first.select("parent", "bucket", "following"), ["parent", "bucket"])
    follow = F.coalesce("sibling", "following")
    exits = child.select((F.col("node") * 2 + 1).alias("arc"), F.coalesce(follow * 2, F.col("parent") * 2 + 1).alias("next"))
    down = nodes.select("node").join(first.where("_first").select(F.col("parent").alias("node"), "head"), "node", "left")
    enters = down.select((F.col("node") * 2).alias("arc"), F.coalesce(F.col("head") * 2, F.col("node") * 2 + 1).alias("next"))
    top = nodes.where("parent is null").select((F.col("node") * 2 + 1).alias("arc"), F.lit(None).cast("long").alias("next"))
    return exits.unionByName(enters).unionByName(top)


def list_rank(arcs: DataFrame, n: int, short: int = SHORT) -> DataFrame:
    """(arc, position) of a linked list (arc, next) of n arcs; the first has position 0."""
    live = stored(arcs.select("arc", "next", F.lit(1).cast("long").alias("w")), "list")
    undo: list[DataFrame] = []
    while n > short:
        turn = len(undo)
        heads = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 0
        tails = live.where(~heads(F.col("arc"))).select(F.col("arc").alias("t"), F.col("next").alias("t_next"), F.col("w").alias("t_w"))
        pairs = live.where(heads(F.col("arc"))).join(tails, F.col("next") == F.col("t"), "left")
        pairs = stored(pairs, "swallowed")
        gone = pairs.where("t is not null").select(F.col("t").alias("arc"), F.col("arc").alias("into"), F.col("w").alias("offset"))
        kept = pairs.select("arc", F.when(F.col("t").isNull(), F.col("next")).otherwise(F.col("t_next")).alias("next"), (F.col("w") + F.coalesce("t_w", F.lit(0))).alias("w"))
        alone = tails.select(F.col("t").alias("arc"), F.col("t_next").alias("next"), F.col("t_w").alias("w")).join(gone.select("arc"), "arc", "left_anti")
        live = stored(kept.unionByName(alone), "list")
        undo.append(gone)
        n = live.count()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.concatenate(c) for c in zip(*([x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches), strict=True)]
        if not table:
            return
        arc, after, w = table
        order = np.argsort(arc)
        arc, after, w = arc[order], after[order], w[order]
        to = np.searchsorted(arc, after)
        start = np.ones(len(arc), bool)
        start[to[after >= 0]] = False
        place, i, at, last = np.zeros(len(arc), np.int64), int(np.flatnonzero(start)[0]), 0, len(arc)
        to = np.where(after >= 0, to, last).tolist()
        each = w.tolist()
        while i != last:
            place[i] = at
            at += each[i]
            i = to[i]
        yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(place)], names=["arc", "position"])

    ends = live.select("arc", F.coalesce("next", F.lit(-1)).alias("next"), "w").repartition(1)
    ranks = stored(ends.mapInArrow(lean(follow), "arc long, position long"), "ranks")
    for gone in reversed(undo):
        back = gone.join(ranks.withColumnRenamed("arc", "into"), "into").select("arc", (F.col("position") + F.col("offset")).alias("position"))
        ranks = stored(ranks.unionByName(back), "ranks")
    return ranks


def prefix_trie(turns: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, turn, role, text), as they are or ``rebuilt``: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = _members(stored(rebuilt(turns) if rebuild else ordered(turns), "rebuilt"))
    last = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.first("bytes").alias("bytes"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    up = nodes.select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(up, ["u1", "u2", "depth"], "left").select("node", *KEY, "conv_id", "n_convs", "parent", "parent_conv_id", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    nodes = stored(nodes, "linked-nodes")
    n = nodes.count()
    arcs = stored(_tour(nodes.select("node", "parent")), "tour")
    place = list_rank(arcs, 2 * n)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    weights = nodes.select((F.col("node") * 2).alias("arc"), (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    line = place.join(weights, "arc", "left").select("arc", "position", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved"))
    line = stored(running(line, [], "position", {"leaf": "leaves", "saved": "savings"}), "tour-sums")
    enter = line.where("arc % 2 = 0").select(F.shiftright("arc", 1).alias("node"), (F.col("leaves") - F.col("leaf")).alias("l0"), (F.col("savings") - F.col("saved")).alias("s0"))
    leave = line.where("arc % 2 = 1").select(F.shiftright("arc", 1).alias("node"), F.col("leaves").alias("l1"), F.col("savings").alias("s1"))
    ends = last.join(paths.select("conv_id", "h1", "h2", "depth"), ["conv_id", "depth"]).join(nodes.select(*KEY, "node"), KEY).select("node", "conv_id")
    out = nodes.join(enter, "node").join(leave, "node").join(_digests(stored(ends, "ends")), "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l1") - F.col("l0")).alias("n_leaves"), (F.col("s1") - F.col("s0")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


_BYTE = "xor(a, ascii(substr(s, CAST(i AS INTEGER), 1)))"
SQL = f"""
WITH RECURSIVE t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS a, 0 AS bit FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, s, CASE WHEN bit = 8 THEN i + 1 ELSE i END, CASE WHEN bit = 0 THEN {_BYTE} ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END
  FROM crc WHERE i <= length(s)
), heads AS (SELECT conv_id, xor(a, 4294967295) % {HEADS} AS h, conv_id - conv_id % {GROUP} AS base FROM crc WHERE i > length(s)),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
convs AS (SELECT c.conv_id, h, base, least(h, coalesce(n, 0)) AS taken FROM heads c LEFT JOIN sizes b ON b.conv_id = c.base),
r AS (
  SELECT c.conv_id, t.place AS d, role, text FROM convs c JOIN t ON t.conv_id = c.base AND t.place <= c.taken
  UNION ALL
  SELECT c.conv_id, t.place - h + taken, role, text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h
), keyed AS (
  SELECT conv_id, d, strlen(text) AS bytes, list(md5(md5(role) || md5(text))) OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
), paths AS (
  SELECT conv_id, d, bytes, key FROM keyed UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), marked AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS depth_end FROM paths),
nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = depth_end), '')) AS ends_sha256
  FROM marked GROUP BY key, d
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON p.d = c.d - 1 AND c.d > 0 AND p.key = c.key[1:c.d - 1]
), kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM linked WHERE d > 0 GROUP BY ALL),
weighed AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k USING (conv_id, d)),
above AS (SELECT p.key, p.d, w.saved, w.n_children FROM weighed w JOIN marked p ON p.conv_id = w.conv_id AND p.d <= w.d),
sums AS (SELECT key, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY key, d)
SELECT conv_id, CAST(w.d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM weighed w JOIN sums s ON s.d = w.d AND s.key = w.key
"""

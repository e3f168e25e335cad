"""Operator 1: token-id output as directly addressable codes (DAC).

The ids of a document, ended by ``END_ID``, are appended to a segment in ascending (doc_id, text) order. Inside a
segment each id is split into 8-bit chunks: level 0 holds the lowest chunk of every id, level k + 1 the next chunk of
those ids that go on after level k. Each level has a continuation bitmap, and its rank directory (ones before every
512th bit) turns a position into the next level's, so any single token is read by at most four byte lookups, without
decoding its neighbours.

Segment image, little-endian: magic ``DACT``, u32 version, u32 documents, u64 tokens, u32 levels; i64 doc ids; u8 null
flags of the ids; u64 document offsets (documents + 1); then for each level: u64 length, chunk bytes, continuation
bits (packed, lowest bit first, padded to bytes), u64 directory entries of 8 bytes.

The file format is a Parquet table of segment images (columns part, seg, first_doc, last_doc, n_docs, n_tokens,
payload): Spark's committer makes it whole if an executor is lost, and the small columns address a segment. Parts are
ascending ranges of (doc_id, text hash), segments ascend in a part. A segment takes whole documents until it holds
``SEGMENT_TOKENS`` ids, so a task holds one segment besides its longest document.

Defined results: null and empty texts hold the end id alone; a null doc_id sorts first; repeated doc_ids are kept,
ordered by the hash of their texts (equal rows stay equal rows); an empty table gives an empty index. Extra columns
are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportlake.llm.common import lean, scratch, small_batches
from reportlake.llm.encoding import Units, UnitTable, sorted_ids

END_ID = 2
SEGMENT_TOKENS = 1 << 20
RANK_STEP = 512
BATCH_BYTES = 1 << 19
TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"DACT"
_HEAD = struct.Struct("<4sIIQI")
_SEGMENTS = "part int, seg int, first_doc long, last_doc long, n_docs int, n_tokens long, payload binary"
# Texts that aren't words between single spaces and newlines, and those with the mark of special tokens.
_ODD = "^[ \\n]|[ \\n]$|[ \\n][ \\n]|[\\t\\v\\f\\r\\x1c-\\x1f\\x00\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]|<\\|"
_JOIN = 256
_SPACE = np.array([b == 32 for b in range(256)])
_NEWLINE = np.array([b == 10 for b in range(256)])


class Encoder:
    """Ids of whole texts by the tokenizers library. Units are words with the newline they stand behind, or behind a
    space, and final marks; a unit this task has seen is looked up."""

    def __init__(self, path: str, max_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.table = UnitTable(self._learn, max_words)
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose text begins with a space
        for t, i in vocab.items():
            self.opens[i] = t.startswith("Ġ")
        self.newline = int(self._ids("\n")[0])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, encoded many in a text: each begins at an id that opens with its space, or at its newline's
        id. A glued mark has ids of its own."""
        kind = np.array([0 if w[0] == 0 else 1 if w[0] == 10 else 2 for w in words])
        size, flat, order = np.zeros(len(words), np.int64), [], []
        for i in np.flatnonzero(kind == 0).tolist():
            flat.append(self._ids(words[i][1:].decode()))
            size[i] = len(flat[-1])
            order.append([i])
        for k in (1, 2):
            part = np.flatnonzero(kind == k)
            groups = [part[i : i + _JOIN] for i in range(0, len(part), _JOIN)]
            texts = [(b"" if k == 1 else b" ") + (b"" if k == 1 else b" ").join([words[i] for i in g.tolist()]) for g in groups]
            for g, e in zip(groups, self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(ids == self.newline if k == 1 else self.opens[ids])
                size[g] = np.diff(at, append=len(ids))
                flat.append(ids)
                order.append(g)
        return sorted_ids(flat, size, np.concatenate(order))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian u32 ids of each text (null: empty). A text of words between single spaces and newlines is cut
        there, where the byte-level pre-tokenizer always cuts; any other text is encoded in one call."""
        col = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(col, _ODD).to_numpy(zero_copy_only=False)
        whole = {i: self._ids(col[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        # each text stands behind a newline, whose id is taken off again
        raw = [b"" if x else t.encode() for t, x in zip(col.to_pylist(), odd, strict=True)]
        ends = np.cumsum([len(x) + 1 for x in raw])
        units = Units(b"\n" + b"\n".join(raw) if raw else b"", _SPACE, _NEWLINE)
        ids, before = self.table.ids(units)
        cuts = before[np.searchsorted(units.start, [0, *ends])].tolist()
        return [(whole[i] if i in whole else ids[a + 1 : b]).tobytes() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """This process's encoder of a tokenizer file, by default that of the installed public_tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(docs: list[tuple[int | None, bytes]]) -> bytes:
    """docs: (doc_id, u32 ids with the end id)."""
    offsets = np.zeros(len(docs) + 1, "<u8")
    np.cumsum([len(x) // 4 for _, x in docs], out=offsets[1:])
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    levels = []
    while len(ids):
        more = ids > 255
        rank = np.add.reduceat(more, np.arange(0, len(ids), RANK_STEP), dtype=np.uint64)
        directory = np.concatenate([np.zeros(1, "<u8"), np.cumsum(rank)[:-1]]).astype("<u8")
        levels.append((len(ids), (ids & 255).astype(np.uint8), np.packbits(more, bitorder="little"), directory))
        ids = ids[more] >> np.uint32(8)
    out = [_HEAD.pack(MAGIC, 1, len(docs), int(offsets[-1]), len(levels))]
    out.append(np.array([d or 0 for d, _ in docs], "<i8").tobytes())
    out.append(np.array([d is None for d, _ in docs], "u1").tobytes())
    out.append(offsets.tobytes())
    for n, chunk, bits, directory in levels:
        out += [struct.pack("<Q", n), chunk.tobytes(), bits.tobytes(), directory.tobytes()]
    return b"".join(out)


class Segment:
    """A read segment image; ``access`` reads one token, ``decode`` all."""

    def __init__(self, image: bytes):
        magic, version, n, self.n_tokens, levels = _HEAD.unpack_from(image)
        if magic != MAGIC or version != 1:
            raise ValueError("not a DAC segment")
        at = _HEAD.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(image, dtype, count, at)
            at += x.nbytes
            return x

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.offsets = take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", image, at)
            at += 8
            self.levels.append((take("u1", m), take("u1", -(-m // 8)), take("<u8", -(-m // RANK_STEP))))

    def access(self, i: int) -> int:
        """Token i of the segment: one chunk of each level it reaches, found by rank."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunk, bits, directory in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_STEP
            before = bits[block * RANK_STEP // 8 : i >> 3]
            inside = int(np.bitwise_count(before).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(directory[block]) + inside
            shift += 8
        return value

    def decode(self) -> np.ndarray:
        ids = np.zeros(0, "<u4")
        for chunk, bits, _ in reversed(self.levels):
            upper, ids = ids, chunk.astype("<u4")
            ids[np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))] |= upper << np.uint32(8)
        return ids

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token in the segment, ids)."""
        ids = self.decode()
        for d, a, b in zip(self.doc_ids, self.offsets, self.offsets[1:], strict=False):
            yield d, int(a), ids[a:b]


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encodes ``docs`` (doc_id, text) into a segment table at ``path``; ``tokenizer`` is a file every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        part, seg, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            row = (part, seg, held[0][0], held[-1][0], len(held), size, pack(held))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])

        for b in batches:
            group = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                texts = b.slice(i, j - i)
                for d, x in zip(texts.column(0).to_pylist(), enc.encode(texts.column(1)), strict=True):
                    held.append((d, x + end))
                    size += len(x) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield flush()
                        seg, held, size = seg + 1, [], 0
        if held:
            yield flush()
        enc.table.clear()  # the worker may go on with other tasks

    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), key)
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    with small_batches(docs.sparkSession):
        rows.mapInArrow(lean(run), _SEGMENTS).write.parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Reads a segment table back: doc_id, start, n_tokens, ids_crc32, part, seg, offset (in the segment).

    ``start`` is a two-level sum: over the parts (one row for each writing task) and over a part's segments."""
    segs = spark.read.schema(_SEGMENTS).parquet(path)
    small = segs.select("part", "seg", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.select("part", "seg", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seg_start"))
    starts = starts.join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(2)]
            for part, seg, image in zip(*cols, b.column(2), strict=True):
                rows = [(d, a, len(x), zlib.crc32(x.tobytes()), part, seg) for d, a, x in Segment(image.as_py()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.int32()] * 2, strict=True)], names=["doc_id", "offset", "n_tokens", "ids_crc32", "part", "seg"])

    docs = segs.select("part", "seg", "payload").mapInArrow(lean(run), "doc_id long, offset long, n_tokens long, ids_crc32 long, part int, seg int")
    out = docs.join(starts, ["part", "seg"])
    return out.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "seg", "offset")


def token_ids(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the segment table of ``docs`` to the shared scratch folder and returns its index, read back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, tokenizer)
    return index(spark, path)

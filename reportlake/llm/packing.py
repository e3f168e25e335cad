"""Operator 12: best-fit packing of token sequences.

Documents are encoded (end id appended) and cut into pieces of at most ``CAPACITY`` tokens. Pieces are dealt by hash to
packing tasks of about ``TASK_PIECES`` and stream through bounded-space best-fit, longest first: a fixed number of open
bins stands in a bitset keyed by free space, whose lowest set bit at or above a piece's length is the best fit. A piece
that fits nowhere opens a bin; where ``OPEN_BINS`` are open, the fullest closes first.

Best-fit leaves at most one bin of a task half empty. The pieces of the ``LEFT`` emptiest bins of each task (at most
``LEFT_PIECES``) are dealt again to fewer tasks and packed together, level by level, until one task ends the packing; so
many tasks don't mean many sequences that are half full. Only (id, length) of a piece moves, and a task's memory is that
of its open bins.

Defined results: null and empty texts hold the end id alone; rows with a null doc_id keep it; repeated rows are
documents of their own; ties of length go by hash; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import lean, stored
from reportlake.llm.encoding import Units, UnitTable, sorted_ids

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
OPEN_BINS = 1 << 14
TASK_PIECES = 1 << 15
LEFT, LEFT_PIECES = 8, 1 << 11
BATCH_BYTES = 1 << 19
_JOIN = 64
_BLANK = np.array([chr(b) in " \t\n\r" for b in range(256)])
_NO_HEADS = np.zeros(256, bool)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Letters that no normal form or lower case turns into others than letters, and the words of a unit as the tokenizer cuts it.
_LETTERS = "a-zA-Z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f"
_COUNTED = re.compile(f"[{_LETTERS}0-9!-/:;=>?@[-`{{|}}~]+")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts by the tokenizers library's lower-casing word tokenizer, whose words never reach across a
    blank. Units are the runs between blanks, in lower case, and final marks."""

    def __init__(self, path: str, max_units: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        for t, i in vocab.items():
            self.closes[i] = t.endswith("</w>")
        self.special = [t.encode() for t, i in vocab.items() if t.startswith("<|")]
        self.table = UnitTable(self._learn, max_units)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: those whose words can be counted are encoded many in a text, whose words each close with one id;
        other units one by one."""
        size, flat, order = np.zeros(len(units), np.int64), [], []
        texts = [x.lstrip(b"\0").decode() for x in units]
        words = np.array([1 if w.isalpha() else len(_WORD.findall(t)) if _COUNTED.fullmatch(t) else 0 for w, t in zip(units, texts, strict=True)])
        rest, part = np.flatnonzero(words == 0), np.flatnonzero(words)
        groups = [part[i : i + _JOIN] for i in range(0, len(part), _JOIN)]
        joined = [" ".join([texts[i] for i in g.tolist()]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at, last = np.flatnonzero(self.closes[ids]), np.cumsum(words[g])
            if len(at) != last[-1] or at[-1] != len(ids) - 1:
                rest = np.concatenate([rest, g])
                continue
            size[g] = np.diff(at[last - 1], prepend=-1)
            flat.append(ids)
            order.append(g)
        for i, e in zip(rest.tolist(), self.tok.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, "<u4"))
            size[i] = len(flat[-1])
            order.append([i])
        return sorted_ids(flat, size, np.concatenate([np.zeros(0, np.int64), *order]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: empty)."""
        raw = [(t or "").encode() for t in texts]
        # special tokens count only as they are written: their texts go by one call each; zero bytes mark glued units
        whole = {i: self._ids(texts[i]) for i, x in enumerate(raw) if b"\0" in x or b"<|" in x and any(s in x for s in self.special)}
        raw = [b"" if i in whole else x.translate(_LOWER) for i, x in enumerate(raw)]
        units = Units(b"\n".join(raw), _BLANK, _NO_HEADS)
        ids, before = self.table.ids(units)
        cuts = before[np.searchsorted(units.start, np.cumsum([0, *(len(x) + 1 for x in raw)]))].tolist()
        return [whole[i] if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """This process's encoder of a tokenizer file, by default that of the installed public_tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([END_ID], "<u4")
        names = [x.split()[0] for x in _PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            group = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                rows = []
                for d, ids in zip(b.column(0)[i:j].to_pylist(), enc.encode(b.column(1)[i:j].to_pylist()), strict=True):
                    ids = np.concatenate([ids, end])
                    rows += [(d, k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        enc.table.clear()  # the worker may go on with other tasks

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _PIECES)


class Bins:
    """Open bins in a bitset keyed by free space. ``put`` returns (bin, tokens in it before); the fullest bin closes
    first, when a bin must open and ``most`` are open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.at[free]
        if len(stack) == 1:
            self.bits ^= 1 << free
        self.open -= 1
        return stack.pop()

    def put(self, length: int) -> tuple[int, int]:
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            own = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            own, free = self.made, self.capacity
            self.made += 1
        rest = free - length
        if rest:
            if not self.at[rest]:
                self.bits |= 1 << rest
            self.at[rest].append(own)
            self.open += 1
        return own, self.capacity - free

    def emptiest(self, n: int) -> list[int]:
        return [b for _, b in heapq.nlargest(n, ((free, b) for free, s in enumerate(self.at) for b in s))]


def pack(items: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES) -> DataFrame:
    """(id, sequence_id, offset) for rows (id long, length long) with 1 <= length <= capacity."""
    done, level = None, 0
    todo = stored(items.select("id", "length"), "pack")
    n = todo.count()
    while True:
        last = n <= task_pieces

        def run(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            bins, top = Bins(capacity, OPEN_BINS), level << 56 | TaskContext.get().partitionId() << 24
            ids, lengths, own, offsets = [], [], [], []
            for b in batches:
                size = b.column(1).to_pylist()
                put = [bins.put(x) for x in size]
                ids.append(b.column(0).to_numpy())
                lengths += size
                own += [x for x, _ in put]
                offsets += [x for _, x in put]
            if not own:
                return
            bin_of = np.array(own)
            count = np.bincount(bin_of)
            back: set[int] = set()
            room = LEFT_PIECES
            for x in [] if last else bins.emptiest(LEFT):
                if count[x] <= room:
                    back.add(x)
                    room -= int(count[x])
            again = np.isin(bin_of, list(back))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(lengths, pa.int64()), pa.array(bin_of + top), pa.array(offsets, pa.int64()), pa.array(again)], names=["id", "length", "sequence_id", "offset", "again"])

        order = F.xxhash64(F.lit(level), "id")
        dealt = todo.repartition(1) if last else todo.repartition(-(-n // task_pieces), order)
        dealt = dealt.sortWithinPartitions(F.col("length").desc(), order, "id")
        out = stored(dealt.mapInArrow(lean(run), "id long, length long, sequence_id long, offset long, again boolean"), "packed")
        kept = out.where("not again").select("id", "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        todo = stored(out.where("again").select("id", "length"), "pack")
        n, level = todo.count(), level + 1


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stored(pieces(docs, tokenizer, capacity).withColumn("id", F.monotonically_increasing_id()), "pieces")
    return rows.join(pack(rows, capacity), "id").drop("id")
